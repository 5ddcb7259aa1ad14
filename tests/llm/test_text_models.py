"""Toxicity, language identification, URLs and chat: held-out accuracy and brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwise.llm import chat, language_id, queries, toxicity, url_filter

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return toxicity.language_model(toxicity.char_counts(docs, "text"))


def test_language_model_is_a_distribution(model):
    assert np.exp(model.reshape(-1, toxicity.CODES)).sum(axis=1) == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize(("seen", "want"), [("id1ot", "idiot"), ("1d10t", "idiot"), ("m0r0n", "moron"), ("tr@sh", "trash"), ("cl0wwwn", "clown"), ("$tupid", "stupid"), ("stuuuupid", "stupid")])
def test_restoring(model, seen, want):
    assert toxicity.restorer(model)(f"the {seen} on, and") == f"the {want} on, and"


def test_spaced_letters_are_joined(model):
    restore = toxicity.restorer(model)
    assert restore("an i d i o t, of") == "an idiot, of" and restore("p.a.t.h.e.t.i.c") == "pathetic"


@pytest.mark.parametrize(("seen", "want"), [("idi07", "idiot"), ("lose5", "loses"), ("scumm", "scum"), ("stuupid", "stupid"), ("stu.pid", "stupid"), ("i_diot", "idiot"), ("b a d", "bad"), ("id10t!", "idiot!"), ("mor€n!!", "moren!!")])
def test_disguise_at_the_end_doubled_or_partly_spaced(model, seen, want):
    assert toxicity.restorer(model)(f"the {seen} on, and") == f"the {want} on, and"


@pytest.mark.parametrize("token", ["hat3", "lose5", "tras4", "idi07", "h473", "scumm", "stu.pid", "stu-pid", "st_upid", "a€b", "is!"])
def test_each_disguise_reaches_the_lattice(token):
    assert toxicity.suspects(f"({token}), x") == ([(1, 1 + len(token))], False)


def test_wildcards_are_decoded_over_all_states(model):
    read = toxicity._readings("i***t*a**")
    assert toxicity.restore("i***t*a**", model) == toxicity._decode(read, model)[1]


@pytest.mark.parametrize("text", ["", "a", "plain words of a clean text.", "OF!! THE!! AND%%%", "12 345 6.7", "é à ü", "*** &&& $$$"])
def test_clean_text_stays(model, text):
    assert toxicity.restorer(model)(text) == text


def test_long_spans_are_decoded_in_full(model):
    restore = toxicity.restorer(model)
    sentence = "youareastupididiot" * 12
    assert restore("on " + ".".join(sentence)).count("idiot") == 12
    assert restore("st" + "u" * 300 + "pid") == "stupid"
    long = restore("y.o.u." * 20_000 + "x")
    assert long.replace(".", "") == "you" * 20_000 + "x" and long.count(".") <= 20_000


@pytest.mark.parametrize("seen", ["i  d  i  o  t", "i d  i o t", "i _ d i . o t", "id.iot", "iidiott", "i-d-i-o-t", "1 d 1 0 t"])
def test_uneven_gaps_and_mixed_disguise(model, seen):
    assert toxicity.restorer(model)(f"the {seen} and") == "the idiot and"


def test_a_wide_gap_ends_a_word(model):
    assert toxicity.restorer(model)("the s t u p i d   m o r o n and") == "the stupid moron and"


def test_codes_keep_their_digits(model):
    for text in ("2b0cb261201f091f991b2c1144c292e775ffe40a", "key 9f86d081884c7d65 of"):
        assert toxicity.restorer(model)(text) == text


def test_what_is_decided_in_parts_is_what_the_lattice_says(spark, model):
    """Closed forms of doubled letters and cached ends of words against Viterbi over every suspect span."""
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300").select("text").collect()]
    texts += ["Éééch", "bOOk, ooze", "aabbccdd", "worthless***", "x$$$ yy$$", "hatte** l00se!!", "ab@@", "", "a"]
    many = toxicity.batch_restorer(model)
    got = [t for part in toxicity.in_parts(texts, 50_000) for t in many(part)]
    for text, found in zip(texts, got, strict=True):
        spans, spaced = toxicity.suspects(text)
        if spaced:
            continue
        want, at = [], 0
        for a, b in spans:
            read = toxicity.restore(text[a:b], model)
            want += [text[at:a], text[a:b] if read == text[a:b].lower() else read]
            at = b
        assert found == "".join([*want, text[at:]])


def viterbi_with_separators(span, model):
    """The least cost over all readings of a span that may hold separators, by trying every one."""
    read = toxicity._readings(span)
    best = (np.inf, "")

    def walk(k, codes, cost, text):
        nonlocal best
        if k == len(read):
            ended = codes[-1] == 0 and text and not text[-1].isdigit()
            total = cost - (0.0 if ended else float(model[((codes[-3] * 28 + codes[-2]) * 28 + codes[-1]) * 28]))
            best = min(best, (total, text))
            return
        for letter, price in read[k]:
            now, seen = cost + price, codes
            if letter:
                code = toxicity._code(letter)
                if code or codes[-1]:
                    now -= float(model[((codes[-3] * 28 + codes[-2]) * 28 + codes[-1]) * 28 + code])
                    seen = [*codes, code]
            walk(k + 1, seen, now, text + letter)

    walk(0, [0, 0, 0], 0.0, "")
    return best[1]


@pytest.mark.parametrize("span", ["i d i o t", "i.d i o  t", "st.up1d", "m0-r0n", "a$$", "is!", "i_d", "l o s e r", "s c_u m m"])
def test_lattices_with_separators_match_brute_force(model, span):
    assert toxicity.restore(span, model) == viterbi_with_separators(span, model)


def viterbi_by_trying(span, model):
    """The least cost over all ways to read a span, without dynamic programming."""
    best = (np.inf, "")

    def walk(k, state, cost, text):
        nonlocal best
        if k == len(span):
            total = cost - float(model[state * toxicity.CODES])
            best = min(best, (total, text))
            return
        char = span[k]
        options = [(char, 0.0)] if char.isalpha() else [(x, toxicity.SIGN) for x in toxicity.LEET.get(char, "")] + [(char, toxicity.SIGN_KEPT)]
        if k and span[k - 1] == char:
            run = char.isalpha() and not (k > 1 and span[k - 2] == char or span[k + 1 : k + 2] == char)
            options.append(("", toxicity.DROP_DOUBLE if run else toxicity.DROP_REPEAT))
        for letter, price in options:
            if letter:
                code = state * toxicity.CODES + toxicity._code(letter)
                walk(k + 1, code % toxicity.CODES**3, cost + price - float(model[code]), text + letter)
            else:
                walk(k + 1, state, cost + price, text)

    walk(0, 0, 0.0, "")
    return best[1]


@pytest.mark.parametrize("span", ["id1ot", "w0rthl3ss", "1d10t", "loooser", "b6g8", "al1ly"])
def test_viterbi_finds_the_cheapest_reading(model, span):
    assert toxicity.restore(span, model) == viterbi_by_trying(span, model)


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op7_toxicity(spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    clean, toxic = got[got["toxic"] == 0], got[got["toxic"] == 1]
    assert (clean["predicted"] == 0).mean() > 0.98 and (toxic["predicted"] == 1).mean() >= 0.5 and got["score"].between(0, 1).all()
    assert toxic["score"].mean() > clean["score"].mean() + 0.4


def test_toxicity_catches_disguise_and_edges(spark):
    rows = [(k, f"the {'idiot' if k % 2 else 'table'} of th{k} and en{k}", "s") for k in range(120)]
    rows += [(500, "an 1d10t of some and", "s"), (501, "an i d i o t of some", "s"), (502, None, "s"), (503, "", "s"), (503, "", "s"), (None, "the idiot", "s"), (505, "word " * 20_000 + "1diot", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)] + [(7, None), (None, 1)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert got[500]["predicted"] == got[501]["predicted"] == got[None]["predicted"] == got[505]["predicted"] == 1
    assert got[502]["predicted"] == 0 and got[502]["score"] == got[503]["score"] and got[500]["restored"] == "an idiot of some and"
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k in range(0, 120, 2)} | {502, 503}


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.score_toxicity(docs, none).first()["score"] == 0.5
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_language_edges(spark):
    rows = [(k, "the of and in to a " * 3 if k % 2 else "der und die von ein ", "en" if k % 2 else "de", "x") for k in range(60)]
    rows += [(100, None, "en", "x"), (101, "", "en", "x"), (102, "123 !?", None, "x"), (103, "the of and " * 30_000, None, "x"), (104, "の", None, "x"), (None, "der und", "de", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify_language(docs).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[103][0] == "en" and got[None][0] == "de" and got[104][0] in ("de", "en")
    assert language_id.identify_language(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_kernel_values_match_sets():
    texts = ["the cat sat", "The cat!", "on the mat", "ein tag"]
    sets = [np.unique(language_id.grams(t)) for t in texts]
    marks = language_id.Landmarks.of(sets)
    table = language_id.GramTable(marks.codes)
    assert sorted(table.columns(marks.codes).tolist()) == list(range(len(marks.codes)))
    got = language_id.kernel_rows(texts, table, marks.presence)
    want = [[len(set(a) & set(b)) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets]
    assert got == pytest.approx(np.array(want), abs=1e-5)


def parts(url):
    head, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


URLS = [
    "http://A.Example.COM/en/7?x=1", "https://b.com/en/", "http://x.net/de/9#a", "http://q.example.net/de/88", "ftp://org/es/", "http://notexample.com/en/7", "no scheme", None, "", "x://", "http://h?q=http://com/en/",
    "http://example.com", "http://e.com/fr/1", "a://b://c.com/en/", "http://ÉX.com/en/é", "http://x.org/ES/1", "http://" + "a" * 50_000 + ".com/en/",
]


def test_url_rules_match_brute_force(spark):
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(URLS + URLS)], "page_id bigint, url string")
    seeds = spark.createDataFrame([(f"http://bad-{k}.com/x", 1) for k in range(30)] + [(f"http://good{k}.org/y", 0) for k in range(30)], "url string, label int")
    got = url_filter.judge(rows, url_filter.train(seeds), queries.URL_RULES).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path = parts(r["url"])
        fits = [(len(rule), v, rule) for v, rule in queries.URL_RULES for name, _, rest in [rule.partition("/")] if (host == name or host.endswith("." + name)) and path.startswith("/" + rest)]
        _, verdict, rule = max(fits, default=(0, None, None))
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))


def test_trees_judge_hosts_that_they_have_not_seen(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url")
    bad = lambda names: url_filter.host_of(F.col("url")).rlike("|".join(names)).cast("int")
    marked = pages.select("url", bad(queries.SEED_HOSTS).alias("label"), bad(["casino", "ads-", "adult"]).alias("unseen"))
    model = url_filter.train(marked.where("unseen = 0"))
    got = model.score(marked.distinct()).groupBy("label").agg(F.avg((F.col("score") >= 0.5).cast("double")).alias("blocked"))
    rates = {r["label"]: r["blocked"] for r in got.collect()}
    assert rates[0] < 0.05 and rates[1] > 0.6


def test_url_statistics_are_those_of_all_labelled_urls(spark):
    rows = [(f"http://h.site{k % 100}.com/{k}", k % 100 // 50) for k in range(400)]
    model = url_filter.train(spark.createDataFrame(rows, "url string, label int"), sample=40, trees=2)
    got = {r["domain"]: (r["domain_share"], r["domain_rate"]) for r in model.domains.collect()}
    assert got == {f"site{k}.com": pytest.approx((4 / 400, (4 * (k // 50) + 2.5) / 9)) for k in range(100)}
    seen = model.with_features(spark.createDataFrame(rows, "url string, label int")).where("domain_share = 0.01 and suffix_share = 1")
    assert seen.count() == 400


def url_features(url):
    """The lexical features of a URL, stated again."""
    from math import log2

    url = url or ""
    host, path = parts(url)
    dots = [x for x in host.split(".") if x]
    counts = [url.count(c) / len(url) for c in set(url)]
    depth = sum(a == "/" and b != "/" for a, b in zip(path, path[1:], strict=False))
    named = 0
    for k, c in enumerate(url):
        if c in "?&":
            name = ""
            for x in url[k + 1 :]:
                if x in "?&#":
                    name = ""
                    break
                if x == "=":
                    break
                name += x
            else:
                name = ""
            named += bool(name)
    return {
        "length": len(url), "host_length": len(host), "path_length": len(path), "depth": depth, "labels": len(dots), "hyphens": host.count("-"),
        "digit_ratio": sum(c in "0123456789" for c in url) / len(url) if url else 0.0, "entropy": -sum(p * log2(p) for p in counts), "parameters": named,
        "suffix": dots[-1] if dots else "", "domain": ".".join(dots[-2:]),
    }


def test_url_features_match_brute_force(spark):
    urls = [u for u in URLS if u is None or len(u) < 1000] + ["http://a-b.c-d.co.uk//x//y/?a=1&b=&=3&cc=4#q=1", "https://x.y/1/2/3?k", "http://..a..b./", "HTTP://UP.Case/Ab?&a=b?c=d"]
    got = url_filter.lexical(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    for r in got:
        want = url_features(r["url"])
        assert all(r[k] == (pytest.approx(v) if isinstance(v, float) else v) for k, v in want.items()), (r, want)


def test_url_statistics_leave_out_the_own_fold(spark):
    rows = [(f"http://h{k % 40}.site{k % 7}.com/{k}", float(k % 3 == 0)) for k in range(300)]
    labelled = url_filter.lexical(spark.createDataFrame(rows, "url string, label double").withColumn("fold", url_filter.fold_of(F.col("url"), 4)))
    got = url_filter.out_of_fold(labelled, labelled, "domain", 4, 0.25).collect()
    held = [(r["domain"], r["fold"], r["label"]) for r in labelled.collect()]
    assert len(got) == 300
    for r in got:
        other = [x for x in held if x[1] != r["fold"]]
        same = [label for domain, _, label in other if domain == r["domain"]]
        assert r["domain_share"] == pytest.approx(len(same) / len(other)) and r["domain_rate"] == pytest.approx((sum(same) + 5 * 0.25) / (len(same) + 5))


def test_url_judging_of_clashing_columns_and_of_nothing(spark):
    seeds = spark.createDataFrame([(f"http://bad-{k}.com/x", 1) for k in range(30)] + [(f"http://good{k}.org/y", 0) for k in range(30)], "url string, label int")
    rows = spark.createDataFrame([(1, "http://x.net/de/", "s", "h", 0.5, "kept"), (1, "http://x.net/de/", "s", "h", 0.5, "kept"), (2, None, "s", "h", 0.5, "kept")], "page_id int, url string, suffix string, host string, score double, domain_rate string")
    for model in (url_filter.train(seeds), url_filter.train(seeds.limit(0))):
        got = url_filter.judge(rows, model, queries.URL_RULES)
        assert got.columns == ["page_id", "url", "suffix", "domain_rate", "host", "path", "rule", "verdict", "score"]
        shown = sorted(map(str, got.collect()))
        assert len(shown) == 3 and shown[0] == shown[1] and "rule='net/'" not in shown[0] and "domain_rate='kept'" in shown[0] and "rule='net/de/'" in shown[0]
        assert url_filter.judge(rows.limit(0), model, queries.URL_RULES).count() == 0


def test_url_trees_on_hosts_and_urls_held_out(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url")
    marked = pages.withColumn("label", url_filter.host_of(F.col("url")).rlike("|".join(queries.SEED_HOSTS)).cast("int"))
    held = F.pmod(F.xxhash64("url"), F.lit(3)) == 1
    model = url_filter.train(marked.where(~held))
    rates = {r["label"]: r["blocked"] for r in model.score(marked.where(held)).groupBy("label").agg(F.avg((F.col("score") >= 0.5).cast("double")).alias("blocked")).collect()}
    assert rates[0] < 0.05 and rates[1] > 0.8


def test_url_model_without_labels(spark):
    none = spark.createDataFrame([], "url string, label int")
    got = url_filter.judge(spark.createDataFrame([(1, "http://e.com/fr/")], "page_id int, url string"), url_filter.train(none), queries.URL_RULES).first()
    assert got["verdict"] == "allow" and got["score"] == 0.0


def whole_viterbi(model, symbols):
    steps = model.steps(symbols)
    score, back = steps[0][0], []
    for m in steps[1:]:
        through = score[:, None] + m
        back.append(through.argmax(axis=0))
        score = through.max(axis=0)
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_chat_is_one_viterbi_over_each_conversation(spark, monkeypatch):
    # small blocks, so that conversations span several, and one turn more than one
    for name, value in (("TURNS", 3), ("TIES", 2), ("FAN", 2)):
        monkeypatch.setattr(chat, name, value)
    turns = spark.read.parquet(f"{SF}/conversations.parquet").where("conv_id < 40")
    long = [(1000, t, "user" if t % 2 == 0 else "assistant", f"{'Is it so?' if t % 2 == 0 else 'It is.'} {t}") for t in range(40)]
    ties = [(1001, 0, "user", f"text {k}") for k in range(7)] + [(1001, 1, "assistant", "answer"), (1001, None, "system", "Note: first")]
    extra = spark.createDataFrame(long + ties, "conv_id bigint, turn bigint, role string, text string")
    raw = chat.as_transcripts(turns.unionByName(extra)).withColumn("segment", F.lit("clash"))
    model = chat.train(raw, "conv_id", "turn", "text", "role")
    got = chat.parse(raw.drop("role"), model)
    rows = raw.select("conv_id", F.coalesce("turn", F.lit(-1)).alias("t"), F.xxhash64("text").alias("h"), "text").distinct().orderBy("conv_id", "t", "h").collect()
    want, by = {}, {}
    for r in rows:
        by.setdefault(r["conv_id"], []).append(r)
    for conv, held in by.items():
        symbols = [chat.symbol(x, k == 0) for r in held for k, x in enumerate(chat.lines_of(r["text"]))]
        want[conv] = [model.roles[s - 1] for s in whole_viterbi(model, symbols)]
    shown = {}
    for r in got.withColumn("h", F.xxhash64("text")).collect():
        shown.setdefault(r["conv_id"], []).extend([r["role"]] * (r["text"].count("\n") + 1))
    assert {k: sorted(v) for k, v in shown.items()} == {k: sorted(v) for k, v in want.items()}
    one = got.where("conv_id = 1000").orderBy("turn", "segment").collect()
    assert [r["role"] for r in one for _ in range(r["text"].count("\n") + 1)] == want[1000]


def test_chat_accuracy_and_rendering(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    got = queries.op3_chat(spark, SF).join(turns.select("conv_id", "turn", F.col("role").alias("true")).distinct(), ["conv_id", "turn"])
    assert got.agg(F.avg((F.col("role") == F.col("true")).cast("double"))).first()[0] > 0.95


def test_chat_edges(spark):
    rows = [(1, 0, "user", "Q: hi there?"), (1, 1, "assistant", "A: yes"), (1, 1, "assistant", "A: yes"), (2, 0, "user", None), (None, 0, "user", "User: x\nAssistant: y"), (3, 0, None, "")]
    chunks = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    model = chat.train(chunks, "conv_id", "turn", "text", "role")
    got = chat.parse(chunks, model).collect()
    first = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["turn"])
    assert [(r["role"], r["text"], r["copies"], r["rendered"]) for r in first] == [("user", "hi there?", 1, "<|user|>\nhi there?\n"), ("assistant", "yes", 2, "<|assistant|>\nyes\n")]
    assert [(r["role"], r["text"]) for r in sorted((r for r in got if r["conv_id"] is None), key=lambda r: r["segment"])] == [("user", "x"), ("assistant", "y")]
    assert chat.parse(chunks.limit(0), model).count() == 0
    assert chat.parse(chunks, chat.train(chunks.limit(0), "conv_id", "turn", "text", "role")).count() == 0


@pytest.mark.parametrize("text", ["²", "½ ①", "Ⅷ", "٣", "__", "12"])
def test_numbers_are_no_letters(text):
    assert not language_id.has_letter(text)


def test_small_languages_are_learned(spark):
    """A language with a thousandth of the rows is in the sample, and all learned ones follow from all rows."""
    rows = [(k, f"the of and in to a {k}", "en") for k in range(3000)] + [(10_000 + k, f"ja nein und der die {k}", "de") for k in range(12)]
    usable = spark.createDataFrame(rows, "id bigint, text string, lang string")
    chosen, languages = language_id.language_sample(usable, 100, 400)
    counts = {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()}
    assert languages == ["de", "en"] and counts["de"] == 12 and 50 < counts["en"] < 130
    assert language_id.language_sample(usable, 100, 1)[1] == ["en"] and language_id.language_sample(usable.limit(0), 100, 9)[1] == []


def test_ridge_is_the_direct_solution():
    """The Nystrom map and weights against kernel ridge regression worked out in one piece."""
    rng = np.random.default_rng(3)
    marks = rng.random((6, 9))
    between, x = marks @ marks.T, rng.random((40, 9))
    kernel, labels = x @ marks.T, rng.integers(0, 3, 40)
    got = language_id.ridge(kernel.astype(np.float32), labels, between, 3, 0.7)
    # the same in the space of kernel values: minimise the weighted squares + penalty * w' K w, with an intercept
    weight = np.sqrt((40 / (3 * np.bincount(labels, minlength=3)))[labels])
    target = np.where(labels[:, None] == np.arange(3), 1.0, -1.0)
    design = np.c_[kernel, np.ones(40)] * weight[:, None]
    penalty = np.zeros((7, 7))
    penalty[:6, :6] = 0.7 * between
    want = np.linalg.solve(design.T @ design + penalty, design.T @ (target * weight[:, None]))
    assert np.c_[kernel, np.ones(40)] @ got == pytest.approx(np.c_[kernel, np.ones(40)] @ want, abs=1e-3)


def test_language_ties_and_repeated_rows(spark):
    rows = [(k, "same words in all", "xx" if k % 2 else "aa") for k in range(40)] + [(50, "same words in all", None), (50, "same words in all", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language_id.identify_language(docs).where("doc_id = 50").collect()
    assert len(got) == 2 and got[0] == got[1] and got[0]["lang_pred"] in ("aa", "xx") and got[0]["score"] == pytest.approx(0.5, abs=0.2)


def test_chat_of_very_long_chunks_and_many_copies(spark):
    long = "\n".join(["User: is it so?", "Assistant: it is"] * 3000)
    rows = [(1, 0, "user", "User: hi"), (1, 1, "assistant", "Assistant: " + "word " * 50_000), (2, 0, "user", long)] + [(3, 0, "user", "User: same")] * 500
    chunks = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    raw = chat.as_transcripts(spark.read.parquet(f"{SF}/conversations.parquet"))
    model = chat.train(raw, "conv_id", "turn", "text", "role")
    got = chat.parse(chunks, model).collect()
    shown = [r["role"] for r in sorted((r for r in got if r["conv_id"] == 2), key=lambda r: r["segment"]) for _ in range(r["text"].count("\n") + 1)]
    assert shown == [model.roles[s - 1] for s in whole_viterbi(model, [chat.symbol(x, k == 0) for k, x in enumerate(chat.lines_of(long))])]
    assert [(r["copies"], r["text"]) for r in got if r["conv_id"] == 3] == [(500, "same")]
    assert any(len(r["text"]) > 200_000 and r["role"] == "assistant" for r in got if r["conv_id"] == 1)


def test_chat_on_held_out_conversations(spark):
    """Counts from two thirds of the conversations, roles of the others."""
    raw = chat.as_transcripts(spark.read.parquet(f"{SF}/conversations.parquet"))
    held = F.pmod(F.xxhash64("conv_id"), F.lit(3)) == 0
    model = chat.train(raw.where(~held), "conv_id", "turn", "text", "role")
    true = raw.where(held).select("conv_id", "turn", F.col("role").alias("true")).distinct()
    got = chat.parse(raw.where(held).drop("role"), model).join(true, ["conv_id", "turn"])
    right = got.agg(F.avg((F.col("role") == F.col("true")).cast("double"))).first()[0]
    print("held-out role accuracy", right)
    assert right > 0.9


def test_conversations_whose_ids_look_alike_stay_apart(spark):
    ids = ["", None, "a", "a\0", "\0", "null", "=a"]
    chunks = spark.createDataFrame([(c, t, f"User: hello {t}" if t % 2 == 0 else f"Assistant: fine {t}") for c in ids for t in range(3)], "conv_id string, turn bigint, text string").coalesce(1)
    known = spark.createDataFrame([("k", 0, "User: hello", "user"), ("k", 1, "Assistant: fine", "assistant"), ("k", 2, "User: hello", "user")], "conv_id string, turn bigint, text string, role string")
    got = chat.parse(chunks, chat.train(known, "conv_id", "turn", "text", "role")).collect()
    assert Counter(r["conv_id"] for r in got) == Counter({c: 3 for c in ids})


def test_every_language_is_learned(spark):
    rows = [(k, f"{chr(0x4E00 + k % 450) * 4}", f"l{k % 450}") for k in range(2700)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language_id.identify_language(docs, sample=1000).collect()
    assert np.mean([r["lang_pred"] == f"l{r['doc_id'] % 450}" for r in got]) > 0.95
