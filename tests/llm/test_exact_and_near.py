"""Exact and near duplicates against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from boxwise.llm import common, exact_dedup, ngram_join
from boxwise.llm.shingles import shingles

DOCS = "doc_id bigint, text string, keep_id string, group_size string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup_matches_brute_force(spark, keep):
    rows = [(1, "Same Text"), (2, "same text"), (3, None), (4, ""), (5, "É a"), (6, "é a"), (7, "x" * 200_000), (8, "X" * 200_000), (9, "own"), (9, "own")]
    got = exact_dedup.exact_dedup(docs(spark, rows), keep=keep, memtable_rows=3, fanout=2).collect()
    groups = {}
    for k, t in rows:
        groups.setdefault(lower(t), []).append(k)
    pick = min if keep == "min" else max
    want = sorted((k, pick(groups[lower(t)]), len(groups[lower(t)]), k == pick(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for k, t in rows)
    assert sorted(map(tuple, got)) == want


def test_exact_dedup_verifies_bytes_where_digests_clash(spark):
    rows = [(k, t) for k, t in enumerate(["aa", "ab", "aa", "b", "ab", "aa"])]
    weak = lambda text: F.substring(text, 1, 1).cast("binary")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs(spark, rows), digest=weak).collect()}
    assert got == {0: (0, 3), 1: (1, 2), 2: (0, 3), 3: (3, 1), 4: (1, 2), 5: (0, 3)}


def test_exact_dedup_of_nothing_and_of_null_ids(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    got = exact_dedup.exact_dedup(docs(spark, [(None, "a"), (None, "a"), (3, "a"), (None, "b")])).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (0, 3, False), (0, 3, False), (3, 3, True)]


def test_compaction_and_lookup(spark):
    rows = spark.createDataFrame([(k, bytes([k % 7])) for k in range(50)], "id bigint, digest binary")
    index = exact_dedup.compact(exact_dedup.flush(rows, 9, F.min), 9, 3, F.min)
    assert {r["digest"][0]: (r["keep_id"], r["n"]) for r in index.collect()} == {d: (d, len(range(d, 50, 7))) for d in range(7)}
    assert exact_dedup.lookup(index, [bytes([3]), bytes([99])]).count() == 1


def test_filters_let_through_what_runs_share(spark):
    """Of 3000 digests 60 are in two runs or more; compaction leaves the others as they are."""
    rows = spark.range(3000).select("id", F.sha2(F.when(F.col("id") < 120, F.col("id") % 60).otherwise(F.col("id")).cast("string"), 256).cast("binary").alias("digest"))
    runs = exact_dedup.flush(rows, 6, F.min)
    assert runs.select("run").distinct().count() == 6
    truth = runs.groupBy("digest").agg(F.count(F.lit(1)).alias("runs"))
    asked = exact_dedup.probed(runs, 3, 6).join(truth, "digest")
    assert asked.where("runs > 1 and not maybe").count() == 0
    assert asked.where("runs = 1 and maybe").count() < 0.05 * runs.count()
    index = exact_dedup.compact(runs, 6, 3, F.min)  # two levels
    assert index.select("run").distinct().count() == 1 and index.count() == 2940
    assert {r["keep_id"] for r in index.where("n = 2").collect()} == set(range(60))


def test_memtables_flush_several_runs():
    assert [exact_dedup.memtables(n, 2048, 16) for n in (0, 1, 2048, 10_000, 51_282, 10**12)] == [1, 1, 1, 5, 16, 16]


def test_exact_dedup_of_rows_named_by_structs(spark):
    rows = docs(spark, [(None, "a"), (1, "A"), (1, "a"), (2, "b")]).select(F.struct("doc_id", F.monotonically_increasing_id().alias("n")).alias("doc_id"), "text")
    got = exact_dedup.exact_dedup(rows, keep="max", memtable_rows=1).where("kept").select("doc_id.doc_id").collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2]


def test_key_filter_loses_nothing(spark):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    df = spark.range(3000).withColumnRenamed("id", "k")
    assert common.without(df, "k", keys).count() == 2000
    assert common.without(df, "k", keys, bits=1 << 15).where("k % 3 = 0").count() == 0
    assert common.without(df.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k")), "k", keys).where("k IS NULL").count() == 1


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 230)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: find(k) for k in root if any(k in e and e[0] != e[1] for e in edges)}


def test_few_keys_make_a_small_filter(spark, monkeypatch):
    asked, made = [], common.key_filter
    monkeypatch.setattr(common, "key_filter", lambda keys, key, bits: asked.append(made(keys, key, bits)) or asked[-1])
    df = spark.range(30_000).withColumnRenamed("id", "k")
    assert common.without(df, "k", df.where("k % 10 = 0")).count() == 27_000
    assert asked[0].count() * 4096 <= 3000 * 16  # bytes of bitmaps, which all reach the driver


def test_stars_need_no_round(spark, monkeypatch):
    names, write = [], common.written
    monkeypatch.setattr(common, "written", lambda df, name: names.append(name) or write(df, name))
    star = [(1, k) for k in range(2, 9)] + [(20, 21)]
    got = common.components(spark.createDataFrame(star, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in got} == {k: 1 for k in range(1, 9)} | {20: 20, 21: 20}
    assert names == ["edges"]
    chain = spark.createDataFrame([(2, 1), (3, 2)], "a bigint, b bigint")
    assert not common.are_stars(chain) and not common.are_stars(spark.createDataFrame([(3, 1), (3, 2)], "a bigint, b bigint"))
    assert common.are_stars(chain.where("a < 0"))


def near_truth(rows, t=0.8):
    sets = [set(shingles(x).tolist()) for _, x in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= t] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        for i, near in enumerate(links):
            root[i] = min([root[i], *(root[j] for j in near)])
    return {k: (min(rows[j][0] for j in range(len(rows)) if root[j] == root[i]), len(links[i])) for i, (k, _) in enumerate(rows)}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([6, 40, 150]))]
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, "?! ..."), (903, "two words"), (904, "Two, words!"), (905, "w " * 50_000), (906, rows[0][1].upper())]
    # small blocks deal groups to pairs of blocks
    got = ngram_join.near_duplicates(docs(spark, rows), block=4).collect()
    assert {r["doc_id"]: (r["class_id"], r["links"]) for r in got} == near_truth(rows)


def test_near_duplicates_of_nothing_and_repeated_rows(spark):
    assert ngram_join.near_duplicates(docs(spark, [])).count() == 0
    text = "one two three four five six seven"
    got = ngram_join.near_duplicates(docs(spark, [(1, text), (1, text), (None, text), (5, "other words than those that came before")])).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"], r["links"], r["copies"]) for r in got) == [(0, 1, 2, 3), (1, 1, 2, 3), (1, 1, 2, 3), (5, 5, 0, 1)]


def test_pruning_keeps_what_may_reach_the_threshold():
    # at 0.8 about 13 of 16 values match; 5 of 16 have next to no chance, 12 a good one
    least = ngram_join.least_matches(16, 0.8, 1e-4)
    assert 5 <= least <= 9
    from math import comb

    posterior = lambda m, n: sum(comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m + 1))
    assert posterior(least, 16) >= 1e-4 > posterior(least - 1, 16)


def test_whole_groups_are_never_split():
    import numpy as np
    import pyarrow as pa

    keys = sorted(random.Random(1).choices(range(9), k=60))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + 7])], ["k"]) for a in range(0, 60, 7)]
    seen = [(batch.column(0)[a].as_py(), b - a) for batch, bounds in ngram_join.whole_groups(iter(batches), lambda x: [x.column(0).to_numpy()]) for a, b in bounds]
    assert seen == [(k, keys.count(k)) for k in np.unique(keys).tolist()]


def test_large_groups_meet_by_band(spark):
    """Groups of more blocks than bands: pairs meet in several bands, and each counts once."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for size in (70, 50):
        base = [word() for _ in range(60)]
        for _ in range(size):
            copy = list(base)
            copy[rng.randrange(60)] = word()
            rows.append((len(rows), " ".join(copy)))
            base = copy if rng.random() < 0.3 else base  # drifts, so that not all pairs are links
    got = ngram_join.near_duplicates(docs(spark, rows), block=2).collect()
    assert {r["doc_id"]: (r["class_id"], r["links"]) for r in got} == near_truth(rows)


def test_recall_of_links_against_all_rows(spark):
    """Every row whose id is divisible by 50 against all rows: links found of those that are there."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    sets = {k: set(shingles(t).tolist()) for k, t in rows}
    queries = {k: s for k, s in sets.items() if k % 50 == 0 and s}
    by = {}
    for k, s in queries.items():
        for x in s:
            by.setdefault(x, []).append(k)
    truth = dict.fromkeys(queries, 0)
    for k, s in sets.items():
        common_ = {}
        for x in s:
            for q in by.get(x, ()):
                common_[q] = common_.get(q, 0) + 1
        for q, n in common_.items():
            truth[q] += q != k and n / (len(s) + len(queries[q]) - n) >= 0.8
    got = {r["doc_id"]: r["links"] for r in ngram_join.near_duplicates(docs(spark, rows)).where("doc_id % 50 = 0").collect()}
    assert sum(truth.values()) > 20 and all(got[q] <= n for q, n in truth.items())
    assert sum(got[q] for q in truth) >= 0.99 * sum(truth.values())


def test_near_copies_with_null_ids_link(spark):
    base = " ".join(f"word{k}" for k in range(60))
    rows = [(None, base + " one"), (None, base + " two"), (4, base + " three"), (5, "something else altogether, which nobody repeats here"), (None, " ".join(f"other{k}" for k in range(40)) + " x"), (None, " ".join(f"other{k}" for k in range(40)) + " y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r["doc_id"] or 0, r["class_id"], r["links"], r["copies"]) for r in ngram_join.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(0, 4, 2, 1), (0, 4, 2, 1), (4, 4, 2, 1), (5, 5, 0, 1), (0, None, 1, 1), (0, None, 1, 1)], key=str)
