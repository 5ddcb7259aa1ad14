"""The lexicon as judge of the decoder: clean text stays, disguised words come back."""

import random
from collections import Counter

import numpy as np
import pytest

from boxwise.llm import lexicon, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def restore(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.language_model(toxicity.char_counts(docs, "text"))
    known = lexicon.known_words(lexicon.word_counts(docs, "text"))
    return toxicity.restorer(model, lexicon=known), known


def test_counts_are_those_of_all_words(spark):
    texts = ["A b a, A! über_x 1a", None, "", "b" * 65, "b" * 64, "the the THE"] * 3
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for held in (2, 200_000):
        got = {r["word"]: r["n"] for r in lexicon.word_counts(docs, "text", held).collect()}
        want = Counter(w if len(w) <= lexicon.LONGEST else None for t in texts for w in lexicon.WORDS.findall((t or "").lower()))
        assert got == want


def test_known_words_are_bounded_by_their_share(spark):
    rows = [(f"w{'x' * k}", 2**k) for k in range(10)] + [(None, 1)]
    counts = spark.createDataFrame(rows, "word string, n bigint")
    for share in (0.0, 0.01, 0.1, 1.0):
        known = lexicon.known_words(counts, share)
        assert known.total == 1024 and known.counts == {w: n for w, n in rows if w and n >= share * 1024}
    nothing = lexicon.known_words(counts.limit(0))
    assert nothing.counts == {} and nothing.split("abc") is None and not nothing.accepts("1diot", "idiot", 5.0)


@pytest.mark.parametrize(
    ("seen", "want"),
    [
        ("57up1d", "stupid"), ("57up1d57up1d57", "stupid stupid st"), ("i    d    i    o    t", "idiot"), ("i" + " " * 50 + "d i o t", "idiot"),
        ("s t u p i d fool", "stupid fool"), ("i d i o t x", "idiot x"), ("s t u p i d m o r o n", "stupid moron"), ("w0rthless", "worthless"),
        ("ıdıot", "idiot"), ("іdiot", "idiot"), ("id​iot", "idiot"), ("stu-pid", "stupid"), ("stuuuupid", "stupid"), ("id10t!", "idiot!"),
    ],
)
def test_disguise_of_known_words(restore, seen, want):
    assert restore[0](f"the {seen} and") == f"the {want} and"


@pytest.mark.parametrize(
    "text",
    ["class, off MP3 h2o covid19", "J. R. R. Tolkien", "worthless", "a 1 b 2 c", "$$$ !!! ||| $15 5+6", "2b0cb261201f091f991b2c1144c292e775ffe40a", "1    2    3", "123456789 a1", "", "что она", "kısa", "y.o.u" * 9],
)
def test_what_no_known_word_explains_stays(restore, text):
    assert restore[0](text) == text


def test_signs_alone_are_read_where_the_word_is_known(spark, restore):
    docs = spark.createDataFrame([("the ass and the horse of some men",)] * 50, "text string")
    model, known = toxicity.language_model(toxicity.char_counts(docs, "text")), lexicon.known_words(lexicon.word_counts(docs, "text"))
    judged = toxicity.restorer(model, lexicon=known)
    assert judged("the @$$ and $$$") == "the ass and $$$" and restore[0]("the @$$") == "the @$$"


def test_words_of_the_corpus_stand(spark, restore):
    """Of the words of clean rows under one in a thousand change, of all words with a doubled letter under one in a hundred."""
    judged, known = restore
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0")
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").join(labels, "doc_id").select("text").collect()]
    words, changed = 0, 0
    for text in texts:
        before = Counter(text.split())
        words += before.total()
        changed += (before - Counter(judged(text).split())).total()
    assert words > 100_000 and changed < words / 1000
    doubled = [w for w in known.counts if any(a == b for a, b in zip(w, w[1:], strict=False)) and known.count(w) > 1]
    assert sum(judged(w) != w for w in doubled) < len(doubled) / 100


def disguised(word: str, how: int, draw: random.Random) -> str:
    signs = {"i": "1!", "o": "0", "e": "3", "a": "4@", "s": "5$", "t": "7+"}
    if how == 0:
        return "".join(draw.choice(signs[c]) if c in signs and draw.random() < 0.7 else c for c in word)
    if how == 1:
        return draw.choice([" ", ".", "-", "_", "  ", "     "]).join(word)
    if how == 2:
        k = draw.randrange(1, len(word))
        return word[:k] + word[k] * draw.randint(2, 5) + word[k + 1 :]
    k = draw.randrange(2, len(word) - 1)
    return word[:k] + draw.choice([".", "-", "_", "​"]) + word[k:]


def test_planted_disguises_come_back(restore):
    """``los-er`` stays, as its pieces are words of other languages here."""
    judged, known = restore
    words = [w for w in ("idiot", "stupid", "moron", "pathetic", "worthless", "loser", "trash", "scum", "clown") if known.count(w)]
    assert len(words) >= 5
    rates = []
    for how in range(4):
        draw = random.Random(how)
        planted = [(w, d) for w in words for _ in range(40) if (d := disguised(w, how, draw)) != w]
        rates.append(sum(judged(f"the {d}, and") == f"the {w}, and" for w, d in planted) / len(planted))
    assert min(rates) >= 0.9 and sum(rates) / 4 >= 0.95


def test_words_with_the_same_end_are_decoded_once(restore, monkeypatch):
    """Signs at the end depend on the three letters before them alone, in each way of reading, and are not decoded for each word."""
    calls = []
    decode = toxicity._decode
    monkeypatch.setattr(toxicity, "_decode", lambda *args: calls.append(1) or decode(*args))
    letters = "bdfgklmnprtvz"
    words = [f"{a}u{b}{c}ano" for a in letters for b in letters for c in letters if b != c] + [f"{a}é{b}ano" for a in letters for b in letters]
    ends = ("$$$", "!!", "***")
    known = restore[1]
    model = np.log(np.full(toxicity.CODES**toxicity.ORDER, 1 / toxicity.CODES, np.float32))
    judged = toxicity.batch_restorer(model, lexicon=known)
    got = judged([f"the {word}{end} and" for word in words for end in ends])
    assert len(got) == len(words) * len(ends) and len(calls) <= 30


@pytest.mark.parametrize("end", ["$", "$$$", "!!", "10", ".$$", "|1!", "5!.5"])
@pytest.mark.parametrize("letters", ["stupid", "éano", "añoé", "x²y", "ıdio", "idiо", "ab"])
def test_ends_decoded_alone_are_those_of_the_whole_span(restore, spark, letters, end):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 100")
    model = toxicity.language_model(toxicity.char_counts(docs, "text"))
    in_parts = toxicity._restore_in_parts(model, True)
    for plain_ends in (False, True):
        assert in_parts(letters + end, plain_ends) == toxicity._cheapest(toxicity._readings(letters + end, True, plain_ends), letters + end, model, 0)


def test_distinct_words_are_those_of_the_whole_text():
    draw = random.Random(3)
    signs = "abé²½ñσΣıİ_1٣-.,;:'$*  \t\n\x1c\x85\u00a0\u200b\u2003\U0001d400\U00010400"
    for _ in range(2000):
        text = "".join(draw.choices(signs, k=draw.randrange(40))).lower()
        assert lexicon.distinct_words(text) == set(lexicon.WORDS.findall(text))


def test_odd_parts_are_counted_as_their_words(spark):
    draw = random.Random(4)
    signs = "abAé²½ñσΣıİ_1٣-.,;:'$*  \t\n\x00\x1c\x85\u00a0\u200b\u2003\U0001d400\U00010400"
    texts = ["".join(draw.choices(signs, k=draw.randrange(60))) for _ in range(500)] + ["ab-" * 50, "é" * 65 + " " + "é" * 64, "_" + "c" * 65 + "1"]
    want = Counter(w if len(w) <= lexicon.LONGEST else None for t in texts for w in lexicon.WORDS.findall(t.lower()))
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for held in (1, 50, 200_000):
        assert {r["word"]: r["n"] for r in lexicon.word_counts(docs, "text", held).collect()} == want
