"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its
    own; on a cluster a machine-local folder would lose data, so that raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _LOCAL.get(app) or tempfile.mkdtemp(prefix="boxwise-")
        _LOCAL[app] = root
    return root.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    Cuts the lineage in a way that survives the loss of any executor, and
    lets several later steps read one result instead of computing it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/boxwise-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most ``rows`` rows a batch between Spark and Python, as whole texts are large.

    The size of batches is a setting of the session, which is lowered where it
    is higher; both Spark and Python hold a batch or two for each task.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def in_small_batches(df: DataFrame, function, schema) -> DataFrame:
    small_batches(df.sparkSession)

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()  # workers live on after their tasks

    return df.mapInArrow(released, schema)


def in_parts(texts: list[str | None], size: int = 200_000) -> Iterator[list[str]]:
    """Texts, null as empty, in lists of about ``size`` characters."""
    held, n = [], 0
    for text in texts:
        held.append(text or "")
        n += len(held[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fraction_of(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on ``key`` and ``seed`` alone."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def bounded_sample(df: DataFrame, key: str, bound: int, seed: int = 7) -> DataFrame:
    """About ``bound`` rows of ``df`` (all if it has fewer), chosen by the hash of ``key``.

    The choice depends on the keys alone, so a rerun or a retried task makes
    the same one. The count stays within a few standard deviations of the bound.
    """
    n = df.count()
    return df if n <= bound else df.where(fraction_of(F.col(key), seed) < bound / n)


def key_filter(keys: DataFrame, key: str, bits: int = 1 << 26) -> DataFrame:
    """A bitmap of hashed keys: at most ``bits / 32768`` rows of 4 kB, whatever the number of keys."""
    bit = _bit(F.col(key), bits)
    return keys.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bitmap")
    )


def _flagged(df: DataFrame, key: str, bitmaps: DataFrame, bits: int) -> DataFrame:
    """``df`` with ``_maybe``: whether the key's bit is set. The broadcast is bounded by ``bits`` (8 MB at 1 << 26)."""
    bit = _bit(F.col(key), bits)
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_bitmap", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1) == 1
    joined = df.join(F.broadcast(bitmaps), F.bitmap_bucket_number(bit) == F.col("_bucket"), "left")
    return joined.withColumn("_maybe", F.coalesce(found, F.lit(False))).drop("_bucket", "_bitmap")


def maybe_in(df: DataFrame, key: str, bitmaps: DataFrame, bits: int = 1 << 26) -> DataFrame:
    """The rows of ``df`` whose key may be among those of ``key_filter``; none that is there is lost.

    Where the bitmap fills up, more rows than needed pass, never fewer.
    """
    return _flagged(df, key, bitmaps, bits).where("_maybe").drop("_maybe")


def split_by_filter(df: DataFrame, key: str, bitmaps: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose key is not among those of ``key_filter``, and those whose key may be."""
    flagged = _flagged(df, key, bitmaps, bits)
    return flagged.where("not _maybe").drop("_maybe"), flagged.where("_maybe").drop("_maybe")


def bits_for(keys: int, least: int = 1 << 16, most: int = 1 << 28) -> int:
    """A power of two with 16 bits for each key, within bounds."""
    return min(most, max(least, 1 << (16 * keys).bit_length()))


def few_asked(keys: DataFrame) -> int:
    """Bits of a filter of ``keys`` that lets hardly any other key through, 8 MB at most: few keys make a small broadcast."""
    return bits_for(4 * keys.count(), most=1 << 26)


def without(df: DataFrame, key: str, keys: DataFrame, bits: int | None = None) -> DataFrame:
    """The rows of ``df`` whose key is not in ``keys`` (one column of the same name), which are read more than once.

    Only rows that the bitmap of keys lets through are joined, so wide rows
    are not shuffled to find out that they stay. Rows with a null key stay.
    ``bits``, the size of that bitmap, else follows from the number of keys.
    """
    bits = bits or few_asked(keys)
    rows = df.select(F.col(key).alias("key"), F.struct("*").alias("row"))  # kept apart from the filter's names
    gone = keys.select(F.col(key).alias("key"))
    stay, asked = split_by_filter(rows, "key", key_filter(gone, "key", bits), bits)
    return stay.unionByName(asked.join(gone.distinct(), "key", "left_anti")).select("row.*")


def numbered_rows(docs: DataFrame) -> DataFrame:
    """(at, row): the rows of ``docs`` as structs, each with its place in the files that it is read from.

    Two rows never share a place, be they alike in all columns, and it does
    not change when rows are read again. A DataFrame that is not read from
    Parquet is written first.
    """
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("line"))
    try:
        return docs.select(place.alias("at"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    except AnalysisException:
        return written(docs, "rows").select(place.alias("at"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def are_stars(edges: DataFrame) -> bool:
    """Whether each node of distinct edges (a, b), b the lesser, is either the centre of a star or has one edge, to its centre."""
    side = lambda end, up: edges.select(F.col(end).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    ends = side("a", 1).unionByName(side("b", 0)).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.agg(F.max(F.col("up") + F.col("down") * F.signum("up") > 1)).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) for each node, root being its least node.

    Alternates large-star and small-star steps: every node links its larger
    neighbours, then its smaller ones, to the least node it sees. Each step is
    a minimum that combines on the map side and a join that AQE may split, so
    a node with very many neighbours does not meet in one task. The edges of
    each round are written; rounds end when all edges make up stars, which
    edges between the members and the least node of each group do at once.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not are_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join has two plain sides: small ones are broadcast, large hot ones split by AQE
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = written(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
