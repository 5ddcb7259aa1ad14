"""WARC derivatives, media, mixing, packing and the pipeline: exact round trips and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boxwise.llm import common, media, mixing, packing, queries, warc
from tests.llm.test_exact_and_near import lower, near_truth
from tests.test_queries import compare, duck  # noqa: F401

from boxwise.llm.oracles import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, duck, name):  # noqa: F811
    compare(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df())


def test_warc_links_and_digests(spark):
    html = "<html lang='en'><title>A &amp; B</title><body><script>x</p></script><p>One&nbsp; two<br>three &#233;&#x41;</p><a href='x'>l</a><!-- no --></body>"
    pages = spark.createDataFrame([(1, "http://e.com/", html, "r"), (2, None, None, "r"), (3, "u", "plain", "r"), (3, "u", "plain", "r"), (4, "u", "<p>" + "x " * 100_000, "r")], "page_id bigint, url string, html string, record_id string")
    responses = warc.as_responses(pages)
    got = warc.derive(responses).collect()
    source = {r["record_id"]: r for r in responses.collect()}
    assert len(got) == 10 and {r["refers_to"] for r in got} == set(source)
    assert all(r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest() and r["content_length"] == len(r["block"].encode()) for r in got)
    text = next(r for r in got if r["id"] == 1 and r["warc_type"] == "conversion")
    assert text["block"] == "A & B\nOne two\nthree éA\nl" and text["source_payload_digest"] == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    facts = next(r for r in got if r["id"] == 1 and r["warc_type"] == "metadata")
    assert "title: A & B\r\nlanguage: en\r\nlinks: 1\r\n" in facts["block"] and text["record_id"] in facts["block"]
    assert next(r for r in got if r["id"] == 2 and r["warc_type"] == "conversion")["block"] == ""
    assert warc.derive(responses.limit(0)).count() == 0
    record = warc.serialised(warc.derive(responses)).where("id = 1").collect()[1]["record"].decode()
    head, _, rest = record.partition("\r\n\r\n")
    assert head.startswith("WARC/1.1\r\nWARC-Type: conversion") and f"WARC-Refers-To: {text['refers_to']}" in head and rest == text["block"] + "\r\n\r\n"


def test_warc_without_headers(spark):
    rows = spark.createDataFrame([(1, "<urn:a>", "u", "d", "no headers"), (2, "<urn:b>", "u", "d", None)], "id int, record_id string, target_uri string, date string, block string")
    got = warc.derive(rows).where("warc_type = 'conversion'").orderBy("id").collect()
    assert [(r["block"], r["source_status"]) for r in got] == [("no headers", None), ("", None)]


def test_sequences_keep_positions_and_captions(spark):
    digest = "ab" * 32
    html = f"<p>one</p><figure><img src='sha256:{digest}'><img src='x.png' alt='own'><figcaption>cap <b>tion</b></figcaption></figure><p>two &lt;3</p><img src='y' alt='alone'><script>no</script>"
    rows = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<figure><img src='z'>cut")], "id bigint, html string")
    got = {r["id"]: [(i["kind"], i["text"], i["caption"], i["digest"]) for i in r["items"]] for r in media.sequences(rows, "id", "html").collect()}
    assert got[1] == [("text", "one", None, None), ("media", None, "cap tion", digest), ("media", None, "cap tion", None), ("text", "two <3", None, None), ("media", None, "alone", None)]
    assert got[2] == got[3] == [] and got[4] == [("media", None, None, None), ("text", "cut", None, None)]


def test_media_query_matches_brute_force(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 96), (5, "x" * 193), (6, "abc"), (6, "abc"), (7, "a<b>&amp;\n\nc\r\n"), (8, "long " * 40_000), (None, "null id")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, media string")
    pages, store = media.text_pages(docs)
    got = media.interleave(pages, store).where("kind = 'media'").collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        text = dict(rows)[r["id"]] or ""
        raw = text.encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["media_sha256"] == r["digest"] and r["caption"] == f"Document {'' if r['id'] is None else r['id']}".strip()
        by[text].add((r["media_sha256"], r["feature"], r["media_bytes"]))
    assert all(len(v) == 1 for v in by.values())
    texts = {r["id"]: [i["text"] for i in r["items"] if i["kind"] == "text"] for r in media.sequences(pages, "id", "html").collect()}
    assert texts[7] == ["a<b>&amp;", "c"]
    lost = media.interleave(pages, store.limit(0)).where("kind = 'media'")
    assert lost.where("payload_sha256 IS NULL").count() == len(rows)


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 80)), rng.choice(["a", "b", "c", None, "é"])) for k in range(4000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, source string, rate double")
    got = mixing.mix_sources(docs).collect()
    for name in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == name]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], rel=0.005) and own[0]["source_size"] == sum(r["size"] for r in own)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(1.5 * total)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))
    copies = Counter(r["doc_id"] for r in mixing.emit_mix(docs).collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]}) and mixing.emit_mix(docs).columns == docs.columns


def test_mix_plans_hash_an_id_once(spark):
    sized = spark.createDataFrame([(k, "ab"[k % 2], k) for k in range(9)], "id bigint, source string, size bigint")
    plan = mixing.plan_mix(sized)._jdf.queryExecution().optimizedPlan().toString()  # 16 draws share two halves of a digest
    assert plan.count("md5(") <= 2 and "Window" not in plan


def test_mix_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, " \t\n", "b"), (None, "x y", None), (5, "x\u00a0y z", "c"), (5, "x\u00a0y z", "c")], "doc_id bigint, text string, source string")
    got = {(r["doc_id"], r["source"]): (r["size"], r["taken"]) for r in mixing.mix_sources(docs).collect()}
    assert got[1, "a"] == (0, 0) and got[3, "b"] == (0, 0) and got[5, "c"][0] == 2 and got[None, None][0] == 2
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.emit_mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("lengths", [[], [1], [2048], [5000, 3, 2048, 2047, 1], [700] * 11, list(range(1, 400))])
def test_assignment_fills_sequences_exactly(lengths):
    pieces = packing.assign(lengths, 2048, 1.0, 1 / 2048)
    covered, rooms = defaultdict(list), defaultdict(list)
    for doc, start, length, sequence, offset in pieces:
        covered[doc].append((start, length))
        rooms[sequence].append((offset, length))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(covered[doc]):
            assert start == at and length > 0
            at += length
        assert at == n
    for held in rooms.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048 and (at & (at - 1)) == 0


def test_documents_go_to_the_cheapest_of_all_sequences_with_room():
    rng = random.Random(1)
    for _ in range(30):
        lengths = [rng.randint(1, 60) for _ in range(200)]
        pieces = packing.assign(lengths, 64, 1.0, 1 / 64)
        total = sum(lengths)
        rooms = [64] * (total // 64) + [1 << b for b in reversed(range(7)) if total % 64 >> b & 1]
        cost, want = [packing.attention_cost(64 - room, 1.0, 1 / 64) for room in rooms], []
        for doc in sorted(range(200), key=lambda d: (-lengths[d], d)):
            left = lengths[doc]
            while left:
                k = min((k for k, room in enumerate(rooms) if room >= left), key=lambda k: (cost[k], k), default=None)
                if k is None:
                    k = min((k for k, room in enumerate(rooms) if room), key=lambda k: (cost[k], k))
                take = min(left, rooms[k])
                rooms[k], left, cost[k] = rooms[k] - take, left - take, cost[k] + packing.attention_cost(take, 1.0, 1 / 64)
                want.append((doc, take, k))
        assert [(doc, length, k) for doc, _, length, k, _ in pieces] == want


def test_packing_ids_are_those_of_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [t["text"] for t in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [None, "", "a<|endoftext|>b", "\u00e9 \U0001f600\n\n  x"]
    docs = spark.createDataFrame([(k, t, "o") for k, t in enumerate(texts)], "doc_id bigint, text string, offset string")
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = defaultdict(list)
    for r in packing.pack(docs, window_tokens=5000).collect():
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        got[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
    for k, text in enumerate(texts):
        want = [*slow.encode(text or "", add_special_tokens=False).ids, 1]
        assert [i for _, ids, _ in sorted(got[k]) for i in ids] == want and {n for _, _, n in got[k]} == {len(want)}


def test_packing_of_nothing_and_unique_sequences(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    assert packing.pack(docs.limit(0)).count() == 0
    many = docs.crossJoin(spark.range(500).drop("id").repartition(5)).repartition(5)
    pieces = packing.pack(many, with_ids=False)
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), (F.max(F.col("offset") + F.col("length"))).alias("end"))
    assert used.where("n <> end").count() == 0 and pieces.agg(F.sum("length")).first()[0] == 1000


def test_pipeline_stages(spark):
    """Each stage against what it must leave, on planted documents."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    clean = [(k, " ".join(word() for _ in range(60)), "en", f"s{k % 3}", 1) for k in range(150)]
    toxic = [(k, f"{' '.join(word() for _ in range(20))} idiot moron {word()}", "en", "s0", 1) for k in range(200, 300)]
    copies = [(400, clean[0][1].upper(), "en", "s1", 1), (401, clean[0][1], "en", "s1", 1)]
    near = [(500, clean[5][1] + " tail", "en", "s1", 1)]
    docs = spark.createDataFrame(clean + toxic + copies + near, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(150)] + [(k, 1, 1) for k in range(200, 300)], "doc_id bigint, quality int, toxic int")
    root = f"{common.shared_dir(spark)}/planted"
    labels.write.mode("overwrite").parquet(f"{root}/labels.parquet")
    docs.write.mode("overwrite").parquet(f"{root}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    held = docs
    stages = dict(corpus_pipeline.STAGES)
    held = common.written(stages["toxicity"](spark, held, root), "a")
    assert ids(held) == sorted(r[0] for r in clean + copies + near) and held.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in held.collect()]
    best = {}
    for k, t in rows:
        best[lower(t)] = max(best.get(lower(t), k), k)
    held = common.written(stages["exact dedup"](spark, held, root), "b")
    assert ids(held) == sorted(best.values())
    rows = [(r["doc_id"], r["text"]) for r in held.collect()]
    held = common.written(stages["n-gram Jaccard join"](spark, held, root), "c")
    assert ids(held) == sorted(k for k, (c, _) in near_truth(rows).items() if k == c)
    mixed = common.written(stages["mixing"](spark, held, root), "d")
    assert set(ids(mixed)) <= set(ids(held)) and mixed.columns == docs.columns
    packed = stages["packing"](spark, mixed, root)
    assert packed.where("start = 0").count() == mixed.count()
    assert corpus_pipeline.run(spark, root).agg(F.sum("length")).first()[0] == packed.agg(F.sum("length")).first()[0]


def test_pipeline_stages_choose_among_rows(spark):
    """Repeated and null ids, repeated rows, empty and very long texts, extra columns."""
    long = "very long text " * 20_000
    words = "one two three four five six seven eight nine ten"
    rows = [
        (9, "text A", "en", "s", 1, "x"), (10, "Text a", "en", "s", 1, "x"), (9, "quite another text", "en", "s", 1, "x"),
        (None, "null id", "en", "s", 1, "x"), (None, "NULL id", "en", "s", 1, "x"), (4, "twice", "en", "s", 1, "x"), (4, "twice", "en", "s", 1, "x"),
        (20, None, "en", None, 0, "x"), (21, "", "en", None, 0, "x"), (30, long, "en", "s", 1, "x"), (31, long.upper(), "en", "s", 1, "x"),
        (50, words, "en", "s", 1, "x"), (50, words + "!", "en", "s", 1, "x"), (None, words + "?", "en", "s", 1, "x"), (51, "?!", "en", "s", 1, "x"), (52, "...", "en", "s", 1, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _maybe string")
    stages = dict(corpus_pipeline.STAGES)
    shown = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    best = {}
    for k, t, *_ in rows:
        best[lower(t)] = max(best.get(lower(t), (-1, "")), (-1 if k is None else k, t or ""))
    got = stages["exact dedup"](spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((-1 if k is None else k, lower(t)) for k, t in shown(got).elements()) == sorted((k, lower(t)) for t, (k, _) in best.items())
    got = stages["n-gram Jaccard join"](spark, common.written(docs, "rows"), "")
    assert got.columns == docs.columns
    kept = shown(got)
    assert kept[None, words + "?"] == 1 and sum(n for (_, t), n in kept.items() if (t or "").startswith(words)) == 1
    assert kept[9, "quite another text"] == 1 and kept[4, "twice"] == 1 and sum(kept[k] for k in ((20, None), (21, ""), (51, "?!"), (52, "..."))) == 4
    assert sum(n for (_, t), n in kept.items() if (t or "").lower() == "null id") == 1 and kept[30, long] == 1 and kept[31, long.upper()] == 0
    mixed = shown(stages["mixing"](spark, docs, ""))
    assert set(mixed) <= set(shown(docs)) and mixed[4, "twice"] in (0, 2, 4)
    packed = stages["packing"](spark, docs, "").collect()
    assert sum(r["start"] == 0 for r in packed) == len(rows) and {r["doc_tokens"] for r in packed if r["doc_id"] in (20, 21)} == {1}


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_pipeline_stages_of_nothing(spark, name):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
    root = f"{common.shared_dir(spark)}/nothing"
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.mode("overwrite").parquet(f"{root}/labels.parquet")
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, root)
    assert got.count() == 0 and (name == "packing" or got.columns == docs.columns)


def test_toxic_stage_keeps_rows_as_they_are(spark):
    rows = [(k, f"the {'idiot' if k % 2 else 'table'} of th{k}", "x") for k in range(80)] + [(90, None, "x"), (None, "", "x"), (1, "kept", "x"), (91, "a table", "x"), (91, "a table", "x"), (None, "an 1d1ot", "x"), (92, "word " * 30_000 + "idiot", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label string")
    root = f"{common.shared_dir(spark)}/labelled"
    spark.createDataFrame([(k, 0, k % 2) for k in range(80)], "doc_id bigint, quality int, toxic int").write.mode("overwrite").parquet(f"{root}/labels.parquet")
    got = Counter((r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, root).collect())
    assert got == Counter((k, t) for k, t, _ in rows if "idiot" not in (t or "") and "1d1ot" not in (t or ""))


def test_packing_of_random_and_long_texts(spark):
    """Ids of random Unicode, of long texts and of the special token's string, against the tokenizer's library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(11)
    pools = ["abc XYZ 019 .,!?'\n\t ", "äöüßéèñçøå œ", "日本語中文한국어", "🙂👩‍👩‍👧é́‍‮ 　", "".join(map(chr, range(1, 0x250)))]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 300))) for _ in range(250)]
    texts += ["".join(chr(c) for c in (rng.randrange(1, 0x2FFFF) for _ in range(200)) if not 0xD800 <= c <= 0xDFFF) for _ in range(40)]
    texts += ["word and more " * 30_000, "x" * 20_000, "é" * 5_000, " " * 3_000, *["a<|endoftext|>b " * 3] * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = defaultdict(list)
    for r in packing.pack(docs).collect():
        got[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    for k, text in enumerate(texts):
        assert [i for _, ids in sorted(got[k]) for i in ids] == [*slow.encode(text, add_special_tokens=False).ids, 1], text[:50]


def test_feature_matches_brute_force():
    rng = random.Random(6)
    for n in (1, 2, 7):
        payload = bytes(rng.randrange(256) for _ in range(192 * n))
        columns = [sum(payload[192 * y + 6 * k + x] for y in range(n) for x in range(6)) for k in range(32)]
        middle = sorted(columns)[16]
        bits = "".join("1" if c > middle else "0" for c in columns)
        shares = [sum(v // 16 == k for v in payload) for k in range(16)]
        want = f"{int(bits, 2):08x}-" + "".join(f"{-(-15 * s // len(payload)):x}" for s in shares)
        assert media.feature_of(payload) == want


def test_media_of_nothing_and_of_one_hot_digest(spark):
    docs = spark.createDataFrame([(k, "same" if k % 3 else f"own {k}") for k in range(60)], "doc_id bigint, text string")
    pages, store = media.text_pages(docs.limit(0))
    assert media.interleave(pages, store).count() == 0
    pages, store = media.text_pages(docs)
    got = media.interleave(pages, store).where("kind = 'media'").groupBy("payload_sha256").count().collect()
    assert sorted(r["count"] for r in got) == [1] * 20 + [40]


def test_sequences_of_real_pages(spark):
    """Every page's items in order hold the text that stands between its tags, and each its position."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in media.sequences(pages, "page_id", "html").join(pages.select(F.col("page_id").alias("id"), "html"), "id").collect():
        assert [i["position"] for i in r["items"]] == list(range(len(r["items"])))
        at, html = 0, r["html"].replace("&copy;", "©").replace("&middot;", "·").replace("&amp;", "&")
        for item in r["items"]:
            word = (item["text"] or "").split(" ")[0]
            found = html.find(word, at)
            assert item["kind"] == "text" and found >= at and "<" not in item["text"] and "track(" not in item["text"]
            at = found


def test_mix_of_very_long_texts(spark):
    docs = spark.createDataFrame([(k, "w " * (200_000 if k == 0 else 20), "a" if k % 2 else "b") for k in range(40)], "doc_id bigint, text string, source string")
    got = mixing.mix_sources(docs).collect()
    assert next(r["size"] for r in got if r["doc_id"] == 0) == 200_000 and all(r["taken"] <= 2 * r["size"] for r in got)
