"""URL filtering: host and path rules, else gradient-boosted trees on lexical features.

The trees are Spark ML's, trained on a bounded sample of labelled URLs. Their
features come from the characters of the URL alone, and from statistics of the
host's suffixes among all labelled URLs. In training a URL's statistics leave
out the fold that it is in (by the hash of its host), so that the trees never
see a statistic that its own label, or that of its host, is part of. URLs are
judged row by row; the only joins are with the tables of suffixes and domains.
"""

from __future__ import annotations

import string

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import bounded_sample, written

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FEATURES = [
    "length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio", "entropy", "parameters",
    "suffix_share", "suffix_rate", "domain_share", "domain_rate",
]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(verdict, rule) of the longest rule that fits, else null; ``rules`` are (verdict, host/path), a short list."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits for each character of a text."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    total = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda acc, c: acc - F.when(F.length(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    return F.when(n > 0, total).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (url, ...) with the lexical features and the suffix and domain of the host."""
    url, host, path = F.coalesce("url", F.lit("")), host_of(F.col("url")), path_of(F.col("url"))
    dots = F.array_remove(F.split(host, r"\."), "")
    return urls.withColumns({
        "length": F.length(url), "host_length": F.length(host), "path_length": F.length(path),
        "depth": F.regexp_count(path, F.lit("/[^/]")), "labels": F.size(dots), "hyphens": F.regexp_count(host, F.lit("-")),
        "digit_ratio": F.coalesce(F.try_divide(F.regexp_count(url, F.lit("[0-9]")), F.length(url)), F.lit(0.0)), "entropy": entropy(url),
        "parameters": F.regexp_count(url, F.lit(r"[?&][^?&#=]+=")),
        "suffix": F.coalesce(F.try_element_at(dots, F.lit(-1)), F.lit("")),
        "domain": F.array_join(F.slice(dots, F.greatest(F.size(dots) - 1, F.lit(1)), F.lit(2)), "."),
    })


def fold_of(url: Column, folds: int) -> Column:
    """The fold of a URL, that of all URLs of its host."""
    return F.pmod(F.xxhash64(host_of(url)), F.lit(folds))


def out_of_fold(rows: DataFrame, labelled: DataFrame, column: str, folds: int, rate: float, prior: float = 5.0) -> DataFrame:
    """``rows`` (fold, ``column``, ...) with the statistics of ``column`` over the labelled URLs of all other folds."""
    counts = labelled.groupBy(column, "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones"))
    known = written(counts, f"{column}-folds")
    everything = known.groupBy(column).agg(F.sum("n").alias("_n"), F.sum("ones").alias("_ones"))
    sizes = {r["fold"]: r["n"] for r in known.groupBy("fold").agg(F.sum("n").alias("n")).collect()}
    others = F.element_at(F.array(*[F.lit(float(sum(n for f, n in sizes.items() if f != k))) for k in range(folds)]), (F.col("fold") + 1).cast("int"))
    own = known.withColumnsRenamed({"n": "_own", "ones": "_own_ones"})
    joined = rows.join(everything, column, "left").join(own, [column, "fold"], "left")
    n = F.coalesce(F.col("_n") - F.coalesce("_own", F.lit(0)), F.lit(0))
    ones = F.coalesce(F.col("_ones") - F.coalesce("_own_ones", F.lit(0.0)), F.lit(0.0))
    return joined.withColumns({
        f"{column}_share": F.coalesce(F.try_divide(n, others), F.lit(0.0)), f"{column}_rate": (ones + prior * rate) / (n + prior),
    }).drop("_n", "_ones", "_own", "_own_ones")


def suffix_statistics(labelled: DataFrame, column: str, prior: float = 5.0) -> DataFrame:
    """By value of ``column``: its share of the labelled URLs and its smoothed rate of label 1."""
    total = labelled.agg(F.count(F.lit(1)).alias("all"), F.avg("label").alias("rate"))
    counts = labelled.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones"))
    known = total.first()
    n, rate = max(1, known["all"]), known["rate"] or 0.0
    return counts.select(
        column, (F.col("n") / float(n)).alias(f"{column}_share"), ((F.col("ones") + prior * rate) / (F.col("n") + prior)).alias(f"{column}_rate")
    )


class UrlModel:
    """Trees and suffix statistics; None in place of the trees if the labels do not differ."""

    def __init__(self, trees: PipelineModel | None, suffixes: DataFrame, domains: DataFrame, rate: float):
        self.trees, self.suffixes, self.domains, self.rate = trees, suffixes, domains, rate

    def with_features(self, urls: DataFrame) -> DataFrame:
        # both tables grow with the hosts; Spark broadcasts them only where it measures them to be small
        joined = lexical(urls).join(self.suffixes, "suffix", "left").join(self.domains, "domain", "left")
        return joined.fillna({"suffix_share": 0.0, "domain_share": 0.0, "suffix_rate": self.rate, "domain_rate": self.rate})

    def score(self, urls: DataFrame) -> DataFrame:
        """``urls`` with ``score``, the probability of label 1, which takes the place of a column of that name."""
        kept = [F.col(f"_row.`{c}`") for c in urls.columns if c.lower() != "score"]
        rows = urls.select("url", F.struct("*").alias("_row"))
        if self.trees is None:
            return rows.select(*kept, F.lit(self.rate).alias("score"))
        return self.trees.transform(self.with_features(rows)).select(*kept, vector_to_array("probability")[1].alias("score"))


def train(labelled: DataFrame, sample: int = 20_000, trees: int = 20, depth: int = 3, seed: int = 5, folds: int = 5) -> UrlModel:
    """Trees from about ``sample`` labelled URLs (url, label 0 or 1), chosen by the hash of the URL; suffix statistics from all.

    URLs or labels that are null are not used, and repeated rows count as often
    as they occur. Without two different labels there are no trees, and every
    URL scores the share of label 1, 0 without any label.
    """
    usable = labelled.where("url is not null and label is not null").select("url", F.col("label").cast("double").alias("label"))
    usable = usable.withColumn("fold", fold_of(F.col("url"), folds))
    chosen = written(lexical(bounded_sample(usable, "url", sample)), "labelled-urls")
    every = lexical(usable)
    suffixes, domains = (written(suffix_statistics(every, c), f"{c}-statistics") for c in ("suffix", "domain"))
    rate = float(usable.agg(F.avg("label")).first()[0] or 0.0)
    model = UrlModel(None, suffixes, domains, rate)
    if chosen.select("label").distinct().count() > 1:
        ready = chosen
        for c in ("suffix", "domain"):
            ready = out_of_fold(ready, every, c, folds, rate)
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        ready = written(ready.select("url", "label", *FEATURES).orderBy("url").coalesce(2), "labelled-features")
        gbt = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed, checkpointInterval=-1, cacheNodeIds=False)
        model.trees = PipelineModel([assembler, gbt.fit(assembler.transform(ready))])
    return model


def judge(urls: DataFrame, model: UrlModel, rules: list[tuple[str, str]], threshold: float = 0.5) -> DataFrame:
    """``urls`` (url, ...) with host, path, rule, verdict and the trees' score.

    The longest rule that fits decides; else a score of ``threshold`` or more
    blocks. A null URL, or one without ``://``, has an empty host and path and
    is scored like any text; URLs may be of any length. Repeated rows are
    judged alike; an empty table gives an empty result. Columns of ``urls``
    that have the name of a result are left out, all others stay.
    """
    results = ["host", "path", "rule", "verdict", "score"]
    rows = urls.select("url", F.struct("*").alias("_row"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = model.score(rows).withColumns({"host": host, "path": path, "_rule": rule_of(host, path, rules)}).withColumns({
        "rule": F.col("_rule.rule"),
        "verdict": F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow")),
    })
    return judged.select(*[F.col(f"_row.`{c}`") for c in urls.columns if c.lower() not in results], *results)
