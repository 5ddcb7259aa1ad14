"""Resampling of documents towards a target distribution, by importance weights.

Features are runs of words, hashed into buckets. How much commoner a bucket is
among the target texts than among the documents is its gain, the sum of gains a
document's weight; documents are drawn without replacement by adding Gumbel
noise to the weight and taking the highest scores.

Buckets are counted in the tasks; the gains, one array of fixed size, go to all
tasks. Scores are whole numbers, so the draw needs no sort of the documents:
their histogram, dealt by ranges of scores, is summed from above, which gives
each score its first rank and the cutoff; only documents at or above it meet, by
score, and are numbered within it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwise.llm.common import in_small_batches, written

#: Bytes of words, A-Z lower-cased: digits, letters, and all that is not ASCII.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Words of more bytes, and the features that hold one, are hashed one by one.
_SHORT = 40


@lru_cache(1)
def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The CRC-32 of one byte, and what L further zero bytes make of a CRC, by L, byte of the CRC, and its value."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(0xEDB88320), one >> 1)
    moved = np.empty((_SHORT + 2, 4, 256), np.uint32)
    moved[0] = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    for n in range(1, len(moved)):
        moved[n] = one[moved[n - 1] & 255] ^ moved[n - 1] >> 8
    return one, moved


def _then(crc: np.ndarray, after: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of two strings one after the other, from theirs and the length of the second."""
    moved = _crc_tables()[1]
    return moved[length, 0, crc & 255] ^ moved[length, 1, crc >> 8 & 255] ^ moved[length, 2, crc >> 16 & 255] ^ moved[length, 3, crc >> 24] ^ after


def word_features(texts: list[bytes], longest: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The number of words of each text, and for runs of 1 to ``longest`` words (text, bucket) of each run.

    Words are hashed side by side, byte by byte; the hash of a run comes from
    those of its words.
    """
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    inside = np.concatenate([[False], _WORD[data]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]  # the line end after the last text closes its last word
    owner = np.searchsorted(ends_of_texts, starts, side="right")
    one = _crc_tables()[0]
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] <= _SHORT]
    at, left = starts[order], lengths[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(_SHORT):
        n = np.searchsorted(-left, -k, side="left")  # words of more than k bytes come first
        if not n:
            break
        crc[:n] = one[(crc[:n] ^ data[at[:n] + k]) & 255] ^ crc[:n] >> 8
    words = np.zeros(len(starts), np.uint32)
    words[order] = ~crc
    long = lengths > _SHORT
    for k in np.flatnonzero(long):
        words[k] = zlib.crc32(data[starts[k] : starts[k] + lengths[k]].tobytes())
    short = np.minimum(lengths, _SHORT)
    spaced = _then(np.full(len(words), zlib.crc32(b" "), np.uint32), words, short)  # of a blank and the word
    runs, out = words, []
    for size in range(1, longest + 1):
        if size > 1:  # runs[i] becomes that of the words from i on; a long word is appended by itself
            runs = _then(runs[:-1], spaced[size - 1 :], short[size - 1 :] + 1)
        n = len(starts) - size + 1
        whole = owner[: max(n, 0)] == owner[size - 1 :] if n > 0 else np.zeros(0, bool)
        runs = runs[: max(n, 0)]
        if size > 1:
            for k in np.flatnonzero(np.convolve(long, np.ones(size, bool))[size - 1 : size - 1 + n] & whole) if n > 0 else ():
                runs[k] = zlib.crc32(b" ".join(data[starts[i] : starts[i] + lengths[i]].tobytes() for i in range(k, k + size)))
        out.append((owner[: max(n, 0)][whole], (runs[whole] % np.uint32(buckets)).astype(np.int64)))
    return np.bincount(owner, minlength=len(texts)), out


def _pieces(texts: pa.Array, size: int = 4_000_000) -> Iterator[list[bytes]]:
    """Runs of texts of about so many bytes, which bounds what arrays of words hold at once."""
    run, n = [], 0
    for text in texts:
        run.append(text.as_buffer().to_pybytes())
        n += len(run[-1])
        if n >= size:
            yield run
            run, n = [], 0
    if run:
        yield run


def bucket_counts(df: DataFrame, text_col: str, longest: int = 3, buckets: int = 10_000) -> np.ndarray:
    """The number of features of ``df`` in each bucket. Each task gives one row a bucket at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for texts in _pieces(batch.column(0)):
                for _, found in word_features(texts, longest, buckets)[1]:
                    n += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n[used], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    rows = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for row in in_small_batches(rows, counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares of each bucket, target over source."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str, longest: int = 3) -> DataFrame:
    """(id, n_words, n_features, weight): the sum of the gains of each document's features."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    names = [id_col, "n_words", "n_features", "weight"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], []]
            for texts in _pieces(batch.column(1)):
                words, features = word_features(texts, longest, len(gains))
                weight, n = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                for owner, found in features:
                    np.add.at(weight, owner, gains[found])
                    n += np.bincount(owner, minlength=len(texts))
                for column, values in zip(columns, (words, n, weight), strict=True):
                    column.append(values)
            made = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=names)

    return in_small_batches(rows, scored, f"`{id_col}` {kind}, n_words bigint, n_features bigint, weight bigint")


def first_ranks(scores: DataFrame) -> DataFrame:
    """(score, n, above): of each whole score the number of rows and the number above it.

    The histogram is dealt by ranges of scores; sums of ranges, one row each,
    are summed from above, and then the scores within each range.
    """
    histogram = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    dealt = written(histogram.repartitionByRange(F.desc("score")).select("score", "n", F.spark_partition_id().alias("part")), "histogram")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    parts = dealt.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above_part"))
    higher = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(parts), "part").select("score", "n", (F.col("above_part") + F.coalesce(F.sum("n").over(higher), F.lit(0))).alias("above"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42, longest: int = 3, buckets: int = 10_000) -> DataFrame:
    """One row per row: id, n_features, weight, score, rank.

    ``rank`` is 1, 2, 3 ... over the floor(percent * N / 100) highest scores of
    the N documents of at least ``least_words`` words, ties to the smaller id,
    null elsewhere. A null text counts as empty and has no features, weight 0
    and a score, as short ones have. A null id draws as an empty one and comes
    last among ties; rows that repeat an id draw alike, so they tie, and those
    with fewer features come first. Without target texts all gains follow from
    smoothing alone. Whole texts are read, in pieces of a few million bytes or
    one text. Further columns are ignored; an empty table gives no rows.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, text_col, longest, buckets))
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((hashed + 0.5) / F.lit(4294967296.0))))
    able = F.col("n_words") >= least_words
    scored = written(weighed(docs, gains, id_col, text_col, longest).withColumn("score", F.col("weight") + noise), "scores")
    ranks = written(first_ranks(scored.where(able).select("score")), "ranks")
    drawn = ranks.agg(F.sum("n")).first()[0] or 0
    drawn = drawn * percent // 100
    cutoff = ranks.where(F.col("above") < drawn).agg(F.min("score")).first()[0]
    columns = [id_col, "n_features", "weight", "score"]
    if cutoff is None:
        return scored.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    chosen = able & (F.col("score") >= cutoff)
    within = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last(id_col), "n_features"))
    high = scored.where(chosen).join(ranks.where(F.col("score") >= cutoff).select("score", "above"), "score").withColumn("rank", F.col("above") + within)
    high = high.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return high.unionByName(scored.where(~chosen).select(*columns, F.lit(None).cast("bigint").alias("rank")))
