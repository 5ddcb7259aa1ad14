"""BPE, source divergence and resampling against the tokenizers library and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from boxwise.llm import bpe, divergence, queries, resampling
from boxwise.sources.tables import table

SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def digests(ids, text):
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_every_character_is_cut_and_encoded_as_the_library_does(library):
    own = bpe.codec("byte_bpe_50k.json")
    for base in [*range(0, 0x33000, 0x1000), 0xE0000, 0xF0000, 0x10F000]:  # what lies between is unassigned
        text = "".join(f"a{c}1{c}!{c} {c}b " for c in map(chr, range(base, base + 0x1000)) if not 0xD800 <= ord(c) < 0xE000)
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_random_texts_and_long_pieces_encode_as_the_library_does(library):
    rng, own = random.Random(4), bpe.Codec(bpe_path(), pattern(), kept=50)  # so small that what it keeps changes generation
    texts = ["".join(rng.choice(["a", "b", "é", " ", "\t", "\n", "'s", "ll", "0", "12", ".", "漢", SPECIAL, "<|end", "the "]) for _ in range(rng.randrange(80))) for _ in range(600)]
    texts += ["", SPECIAL, "a" * 20_000, "".join(rng.choice("etaoin") for _ in range(3000)), "".join(rng.choice("ab") for _ in range(66)), " " * 500 + "x"]
    for at in range(0, len(texts), 97):
        for text, ids in zip(texts[at : at + 97], own.encode(texts[at : at + 97]), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
            assert own.decode(ids) == text
    for ids in ([50256, 1, 220], [160, 109], [list(range(100, 400))][0]):  # bytes that are no UTF-8 as well
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def bpe_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pattern():
    import public_tokenizers

    return public_tokenizers.PATTERN


def test_trees_merge_the_leftmost_pair_of_lowest_rank():
    rng = random.Random(5)
    own = bpe.codec("byte_bpe_50k.json")
    for _ in range(300):
        piece = bytes(rng.choice(b"etaoinshr \xc3\xa9") for _ in range(rng.randrange(1, 40)))
        symbols = [int(own.first[b]) for b in piece]
        while True:
            ranked = [(own.ranks[symbols[i] << 32 | symbols[i + 1]], i) for i in range(len(symbols) - 1) if symbols[i] << 32 | symbols[i + 1] in own.ranks]
            if not ranked:
                break
            found, i = min(ranked)
            symbols[i : i + 2] = [found & 0xFFFFFFFF]
        assert bpe.merged([int(own.first[b]) for b in piece], own.ranks) == symbols == list(own.merged_all([piece])[0]) == list(own.merged_all([piece], widest=0)[0])


def test_bpe_edges(spark, library):
    rows = [(1, "Hello world"), (2, None), (3, ""), (None, SPECIAL + " x"), (1, "Hello world"), (5, "long " * 60_000), (6, "ü" * 5000)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, ids int")
    got = bpe.encode(docs).collect()
    want = [(k, library.encode(t or "", add_special_tokens=False).ids, t or "") for k, t in rows]
    shown = [(str(k), len(ids), *digests(ids, t), t, ids) for k, ids, t in want]
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["decoded"], r["ids"]) for r in got) == sorted(shown)
    assert bpe.encode(docs.limit(0)).count() == 0
    back = bpe.decode(bpe.encode(docs.where("doc_id = 6")).select("doc_id", "ids"))
    assert back.columns == ["doc_id", "ids", "decoded"] and back.first()["decoded"] == "ü" * 5000
    odd = spark.createDataFrame([(None,), ([15496, None, 99_999_999],), ([],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(odd).collect()] == [None, "Hello", ""]


def test_bpe_query_matches_the_library(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    got = queries.op11_bpe(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), *digests(ids, library.decode(ids, skip_special_tokens=False)))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def divergence_truth(rows, least=3, top=200):
    occurs, held, members = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        members.add((lang, source))
        occurs[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang in {a for a, _ in members}:
        kept = [t for t, n in held[lang].items() if n >= least]
        own = {s: occurs[lang, s] for a, s in members if a == lang}
        whole = sum(own.values(), Counter())
        total = {s: sum(c[t] for t in kept) for s, c in own.items()} | {None: sum(whole[t] for t in kept)}
        p = {s: {t: 1 + 1_000_000_000 * (c[t] + 1) // (total[s] + len(kept)) for t in kept} for s, c in [*own.items(), (None, whole)]}
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            parts = {"pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s], "term": [(f(p[s][t], p[None][t]), t) for t in kept if own[s][t] and p[s][t] > p[None][t]]}
            for part, found in parts.items():
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found if part == "pair" else found[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "chunk", "slab", "top"), [(8, 4096, 4, 200), (2, 8, 1, 5), (1, 3, 2, 1)])
def test_divergence_matches_brute_force_for_any_tiling(spark, block, chunk, slab, top):
    rng = random.Random(6)
    words = [f"w{'abcdefghij'[k % 10]}{'xyz'[k // 10]}" for k in range(30)] + ["Été", "été", "ÉTÉ", "x9y", "日本"]
    rows = [(" ".join(rng.choice(words[: 5 + 3 * len(source or "")]) for _ in range(rng.randrange(30))), lang, source) for lang in ("en", "de", None) for source in ("a", "bb", "ccc", None, "ddddd", "é") for _ in range(6)]
    rows += [(None, "en", "silent"), ("", "en", "silent"), ("only once here", "xx", "a"), ("but not there", "xx", "b"), ("alone", "yy", "a"), rows[0], rows[0], ("long LONG " * 20_000, "de", "a")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, term int, grp int").repartition(5)
    got = divergence.source_divergence(docs, block=block, chunk=chunk, slab=slab, top=top).collect()
    assert sorted(map(tuple, got)) == divergence_truth(rows, top=top)


def test_divergence_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.source_divergence(docs).count() == 0


def test_shares_do_not_overflow(spark):
    counts, total = [0, 5, 9_300_000_000_000], 9_400_000_000_000
    want = [1 + 1_000_000_000 * (c + 1) // total for c in counts]
    assert divergence.shares(np.array([counts]), np.array([total]))[0].tolist() == want
    df = spark.createDataFrame([(c, total) for c in counts], "c bigint, t bigint")
    assert [r[0] for r in df.select(divergence.share(df["c"], df["t"])).collect()] == want


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORDS.findall(lower(text))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def resampling_truth(docs, target, percent=5, least=20):
    bucket = lambda x: zlib.crc32(x.encode()) % 10_000
    count = lambda texts: Counter(bucket(x) for t in texts for x in features(t)[1])
    s, t = count(d[1] for d in docs), count(target)
    every = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (every[0] + 10_000) / ((s[b] + 1) * (every[1] + 10_000))))
    rows = []
    for doc_id, text in docs:
        words, own = features(text)
        weight = sum(gain(bucket(x)) for x in own)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= least])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted(map(str, (tuple(r[:5]) for r in rows)))


@pytest.mark.parametrize("percent", [5, 40, 100, 0])
def test_resampling_matches_brute_force(spark, percent):
    rng = random.Random(7)
    words = ["Alpha", "beta", "été", "x" * 60, "1st", "of", "the", "q"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for k in range(300)]
    docs += [(None, "alpha beta " * 30), (7, docs[7][1]), (7, docs[7][1]), (400, None), (401, ""), (402, "-- !"), (403, "long the " * 30_000), (404, "x" * 100_000)]
    target = ["the beta of alpha", "été été 1st", None, "", "q"]
    frame = spark.createDataFrame([(*d, 3, 4) for d in docs], "doc_id bigint, text string, score int, weight int").repartition(4)
    got = resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(str, map(tuple, got.collect()))) == resampling_truth(docs, target, percent)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert resampling.resample(none, none).count() == 0
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id bigint, text string")
    assert resampling.resample(some, none).first()["rank"] is None


def test_first_ranks_over_many_ranges(spark):
    rng = random.Random(8)
    scores = [rng.randrange(-50, 50) for _ in range(2000)] + [10**9, -(10**9)]
    got = {r["score"]: (r["n"], r["above"]) for r in resampling.first_ranks(spark.createDataFrame([(s,) for s in scores], "score bigint")).collect()}
    assert got == {s: (n, sum(x > s for x in scores)) for s, n in Counter(scores).items()}
