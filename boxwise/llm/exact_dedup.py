"""Exact deduplication through a log-structured merge index of text digests.

Rows go to *memtables* by the hash of their id. Each memtable is flushed as a
sorted run: one row for each of its digests, in Parquet with a Bloom filter and
min/max statistics on the digest. To find what a run shares with others, every
run also has a filter of its digests: bitmaps of 4 kB, one for each *slot* of
the digests' space. Compaction takes ``fanout`` runs at a time; it brings runs
and filters together by slot, asks the filters of the other runs for each
digest, and merges the digests that one of them may hold. All others move to the
next level as they are. Merged digests keep one identifier and the sum of their
counts, until one run is left.

A digest that more than one row has is a hit, and hits are verified by their
bytes: the least and the greatest text of the digest must be the same. All of
it is DataFrame operations.

A hot text never meets in one task: memtables combine on the map side before
anything is dealt by slot, and verification sends one least and one greatest
text per task.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import bits_for, key_filter, maybe_in, split_by_filter, written

#: Bits of one of Spark's bitmaps, and digests that share one: about 1 in 16 bits is then set.
BITMAP_BITS, SLOT_DIGESTS = 1 << 15, 1 << 11


def normalised(text: Column) -> Column:
    """``text`` with A-Z in lower case and null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def flush(rows: DataFrame, n_runs: int, pick) -> DataFrame:
    """Level 0: rows (id, digest) as ``n_runs`` sorted runs (run, digest, keep_id, n)."""
    runs = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n_runs)).alias("run"), "digest").agg(
        pick("id").alias("keep_id"), F.count(F.lit(1)).alias("n")
    )
    return _write_runs(runs, "run-0")


def probed(runs: DataFrame, slots: int, fanout: int) -> DataFrame:
    """``runs`` with slot, parent, and ``maybe``: whether the filter of another run of the same parent may hold the digest.

    The runs are dealt by slot once; filters, probes and what follows by slot
    stay in that partitioning.
    """
    hashed = F.xxhash64("digest")
    bit = F.pmod(hashed, F.lit(BITMAP_BITS))
    dealt = runs.withColumns({"slot": F.pmod(F.shiftright(hashed, 20), F.lit(slots)), "parent": F.floor(F.col("run") / fanout)}).repartition("slot")
    filters = dealt.groupBy("slot", "parent", "run").agg(F.bitmap_construct_agg(bit).alias("bits"))
    together = filters.groupBy("slot", "parent").agg(F.collect_list(F.struct("run", "bits")).alias("filters"))
    byte = lambda bits: F.conv(F.hex(F.substring(bits, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    holds = lambda f: (f["run"] != F.col("run")) & (F.call_function("shiftright", byte(f["bits"]), (bit % 8).cast("int")).bitwiseAND(1) == 1)
    return dealt.join(together, ["slot", "parent"]).withColumn("maybe", F.exists("filters", holds)).drop("filters")


def merged(runs: DataFrame, slots: int, fanout: int, pick) -> DataFrame:
    """One level of compaction: runs (run, digest, keep_id, n) of the next level."""
    asked = probed(runs, slots, fanout)
    moved = asked.where("not maybe").select(F.col("parent").alias("run"), "digest", "keep_id", "n")
    met = asked.where("maybe").groupBy("slot", "parent", "digest").agg(pick("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    return moved.unionByName(met.select(F.col("parent").alias("run"), "digest", "keep_id", "n"))


def compact(index: DataFrame, n_runs: int, fanout: int, pick) -> DataFrame:
    """Merges ``fanout`` runs at a time until one run is left."""
    level = 0
    while n_runs > 1:
        level, n_runs = level + 1, -(-n_runs // fanout)
        slots = max(1, -(-index.count() // SLOT_DIGESTS))
        index = _write_runs(merged(index, slots, fanout, pick), f"run-{level}")
    return index


def _write_runs(runs: DataFrame, name: str) -> DataFrame:
    return written(
        runs.sortWithinPartitions("run", "digest"),
        name,
        **{"parquet.bloom.filter.enabled#digest": "true"},
    )


def lookup(index: DataFrame, digests: list[bytes]) -> DataFrame:
    """The index rows of a few digests; filters and statistics skip row groups without them."""
    return index.where(F.col("digest").isin([F.lit(bytearray(d)) for d in digests]))


def memtables(rows: int, memtable_rows: int, most: int) -> int:
    """How many memtables so many rows are flushed by."""
    return max(1, min(most, -(-rows // memtable_rows)))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    memtable_rows: int = 2048,
    most_memtables: int = 16,
    fanout: int = 16,
    filter_bits: int | None = None,
    digest=sha256_digest,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same bytes after A-Z are lower-cased;
    null counts as empty. Of equal texts the row with the smallest id
    (``keep="min"``) or largest (``"max"``) stays. Rows that repeat an id and
    a text all count, and all rows with the kept id are ``kept``; a null id
    is never picked while the group has another, and a group of null ids keeps
    those rows. Ids may be structs, as of rows. Further columns of ``docs``
    are ignored. Texts may be of any length. An empty table gives an empty
    result.

    Memtables hold ``memtable_rows`` rows, and more where there would be over
    ``most_memtables`` of them; each is dealt to many tasks. ``filter_bits``
    sets the size of the broadcast bitmap of hits, which else follows from
    their number up to 32 MB; where it fills up, more texts than needed are
    verified, never fewer.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    source = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    rows = written(source.select("id", digest(F.col("norm")).alias("digest")), "digests")
    n_runs = memtables(rows.count(), memtable_rows, most_memtables)
    index = compact(flush(rows, n_runs, pick), n_runs, fanout, pick)

    hits = index.where("n > 1").select("digest", "keep_id", "n")
    bits = filter_bits or bits_for(hits.count())
    bitmaps = written(key_filter(hits, "digest", bits), "hits")
    maybe = maybe_in(source.withColumn("digest", digest(F.col("norm"))), "digest", bitmaps, bits)
    clashing = written(
        maybe.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"))
        .where("least <> greatest").select("digest"),
        "clashing",
    )
    alone, asked = split_by_filter(rows, "digest", bitmaps, bits)  # rows without a hit need no join
    alone = alone.withColumns({"keep_id": F.col("id"), "n": F.lit(1).cast("bigint")})
    own = {"keep_id": F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")), "n": F.coalesce("n", F.lit(1))}
    if clashing.isEmpty():
        found = asked.join(hits, "digest", "left").withColumns(own)
    else:  # different texts of one digest: their rows are told apart by the text itself
        texts = source.withColumn("digest", digest(F.col("norm"))).join(clashing, "digest", "left_semi")
        told = texts.groupBy("digest", "norm").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        plain = asked.join(clashing, "digest", "left_anti").join(hits, "digest", "left").withColumns(own)
        found = plain.unionByName(texts.join(told, ["digest", "norm"]).drop("norm"))
    shown = F.lower(F.hex("digest"))
    if digest is not sha256_digest:
        shown = F.lit(None).cast("string")
    return alone.unionByName(found).select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("n").cast("bigint").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        shown.alias("text_sha256"),
    )
