"""Mixing sources to target weights: repetition rates and hash-seeded copies.

Token counts are summed per source, each source's target gives a repetition
rate, and every document is taken floor(rate) times plus one Bernoulli copy
whose probability is the fraction of the rate. The Bernoulli draw depends on
the document's id and a seed alone, so reruns and retried tasks agree. A single
seed's total strays from the target with the spread of the document sizes;
therefore the same aggregation sums ``seeds`` draws at once and each source
takes the seed whose total comes nearest. A document is then still taken with
the probability of the fraction, but the draws of a source's documents are no
longer independent of each other, as they are chosen for their sum.

Targets are worked out over one row per source in one task, which holds for
sources as they are mixed by weight, thousands of them; hosts are not sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwise.llm.common import written

#: Everything but white space of ASCII.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """The number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def halves(key: Column) -> tuple[Column, Column]:
    """Two 32-bit halves of the key's MD5."""
    text = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    half = lambda at: F.conv(F.substring(text, at, 8), 16, 10).cast("bigint")
    return half(1), half(9)


def combined(first: Column, second: Column, seed: Column | int) -> Column:
    step = F.lit(seed) if isinstance(seed, int) else seed
    return F.pmod(first + second * step, F.lit(1 << 32)) / float(1 << 32)


def draw(key: Column, seed: Column | int) -> Column:
    """A number in [0, 1) for each key and seed: two 32-bit halves of an MD5, combined."""
    return combined(*halves(key), seed)


def water_filled(sources: DataFrame, weights: tuple[float, ...], share: float, ceiling: float) -> DataFrame:
    """Targets of sources (source, source_size): ``share`` of the total, by weight, none above its ceiling.

    Resharing an excess by weight until no source is above its ceiling ends
    at level x weight, or the ceiling where that is less. Sources in the order
    of ceiling / weight reach their ceilings first, so the level follows from
    running sums. The windows run over one row per source.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    named = sources.withColumn("rank", F.row_number().over(by_name))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    named = named.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    levels = named.withColumn("place", F.row_number().over(order)).withColumn(
        "level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    )
    # the level holds from the first source that it leaves at or below its ceiling
    settles = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("place", "level"))
    settled = levels.withColumn("settled", F.min(settles).over(every)["level"])
    return settled.select(
        "source", "source_size", F.round(F.least("cap", F.coalesce(F.col("settled") * F.col("weight"), F.col("cap"))), 6).alias("target")
    )


def plan_mix(
    sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0, seeds: int = 16
) -> DataFrame:
    """From (id, source, size), one row per source: by, source_size, target, rate, seed."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = (
        water_filled(sizes, weights, share, ceiling)
        .withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
        .withColumnRenamed("source", "by")
    )
    # written, as it is read twice: the plans that follow are small, and its size is known
    # few sources are broadcast by that; many join by hash
    rates = written(rates, "rates")
    part = F.col("rate") - F.floor("rate")
    first, second = halves(F.col("id"))
    keyed = sized.select("source", "size", first.alias("first"), second.alias("second"))
    draws = [F.sum(F.when(combined(F.col("first"), F.col("second"), k) < part, F.col("size")).otherwise(0)) for k in range(seeds)]
    totals = keyed.join(rates, F.col("source").eqNullSafe(F.col("by"))).groupBy("by").agg(F.array(*draws).alias("drawn"))
    plan = rates.join(totals.withColumnRenamed("by", "of"), F.col("by").eqNullSafe(F.col("of"))).drop("of")
    off = F.transform("drawn", lambda x: F.abs(x - part * F.col("source_size")))
    return plan.select(
        "by", "source_size", "target", "rate", (F.array_position(off, F.array_min(off)) - 1).cast("bigint").alias("seed")
    )


def copies(key: Column) -> Column:
    """How often the mix takes the document ``key``, beside its source's rate and seed."""
    part = F.col("rate") - F.floor("rate")
    return (F.floor("rate") + F.when(draw(key, F.col("seed")) < part, 1).otherwise(0)).cast("bigint")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken.

    Sources take ``weights`` in turn, in code point order with null last, and
    share ``share`` times all sizes; a target stops at ``ceiling`` times its
    source's size. A source without words has target 0 and its documents are
    not taken. Rows that repeat an id draw alike. Null ids draw as empty text.
    Further columns are ignored; an empty table gives an empty result.
    """
    sized = written(_sized(docs, id_col, text_col, source_col), "sized")
    mixed = sized.join(written(plan_mix(sized, **how), "mix"), F.col("source").eqNullSafe(F.col("by"))).withColumn("copies", copies(F.col("id")))
    return mixed.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        "copies", (F.col("copies") * F.col("size")).alias("taken"),
    )


def emit_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it."""
    # the written plan has a known size: it is broadcast where that is small, so texts stay where they are
    plan = written(plan_mix(written(_sized(docs, id_col, text_col, source_col), "sized"), **how), "mix")
    rows = docs.select(F.struct("*").alias("row"))  # kept apart from the plan's names
    taken = rows.join(plan, F.col("row")[source_col].eqNullSafe(F.col("by"))).withColumn("copies", copies(F.col("row")[id_col]))
    return taken.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
