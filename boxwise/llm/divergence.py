"""Audit of how the sources of a language differ in what they say.

Terms are counted by language and source; a language keeps the terms that
enough of its documents hold. Every source gets a smoothed share of each kept
term, in whole billionths, and sources are compared in pairs, term by term, and
with their language as a whole. All arithmetic is on whole numbers.

Pairs are computed by tiles: the sources of a language are dealt into blocks,
its vocabulary into chunks. Each source's packed counts of a chunk go to the
tasks of its block with every block, and a task walks over the chunks of its
slab in order, two blocks of one chunk in memory at a time.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwise.llm.common import in_small_batches, written

SCALE = 1_000_000_000
_TERMS = re.compile(rb"[a-z\x80-\xff]+").findall


def term_counts(docs: DataFrame, text_col: str, group: str, member: str, most: int = 150_000) -> DataFrame:
    """(grp, member, term, n, docs): occurrences and documents of each term, and a row without a term for each pair.

    Counts are added up in the task first, up to ``most`` of them at a time.
    """
    columns = {"grp": group, "member": member, "text": text_col}
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in columns.items()])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = defaultdict(Counter)
        held: dict[tuple, Counter] = defaultdict(Counter)

        def emit() -> pa.RecordBatch:
            keys = [key for key, own in n.items() for _ in range(len(own) + 1)]
            terms = [t for own in n.values() for t in (None, *own)]
            out = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(terms, pa.binary()).cast(pa.string())]
            out += [pa.array([x for key in n for x in (0, *(own[key][t] for t in n[key]))], pa.int64()) for own in (n, held)]
            n.clear()
            held.clear()
            return pa.RecordBatch.from_arrays(out, names=["grp", "member", "term", "n", "docs"])

        size = 0
        for batch in batches:
            for grp, member_, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = _TERMS(text.encode().lower())  # bytes: A-Z alone are lower-cased
                own, new = n[grp, member_], set(found)
                size -= len(own)
                own.update(found)
                held[grp, member_].update(new)
                size += len(own)
                if size >= most:
                    yield emit()
                    size = 0
        if n:
            yield emit()

    found = in_small_batches(rows, counted, "grp string, member string, term string, n bigint, docs bigint")
    return found.groupBy("grp", "member", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), by long division in steps of a thousand, which no count overflows; 1 without a total."""
    rest, out = count + 1, F.lit(0).cast("bigint")
    for _ in range(3):
        out = out * 1000 + _div(rest * 1000, total)
        rest = (rest * 1000) % total
    return F.when(total > 0, out + 1).otherwise(F.lit(1).cast("bigint"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """``share`` over arrays: a row of counts for each total."""
    rest, out = counts.astype(np.int64) + 1, np.zeros(counts.shape, np.int64)
    totals = np.maximum(totals, 1)[:, None]
    for _ in range(3):
        rest *= 1000
        out = out * 1000 + rest // totals
        rest %= totals
    return out + 1


def tile(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """values[i, j]: the sum over columns of floor((p - q)^2 / q), p the shares in own[i] and q those in others[j]."""
    out = np.empty((len(own), len(others)), np.int64)
    for i, p in enumerate(own):
        off = p - others
        out[i] = (off * off // others).sum(1)
    return out


def kept_terms(counts: DataFrame, least_docs: int, chunk: int) -> tuple[DataFrame, int]:
    """(grp, term, all_n, chunk, place): the terms of at least ``least_docs`` documents, and the number of chunks that they are dealt into.

    All groups are dealt into as many chunks, by the terms' hashes, so that the
    terms of one large group do not meet in a task; a chunk of a group has
    about ``chunk`` terms at most.
    """
    kept = counts.where("term is not null").groupBy("grp", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = written(kept.drop("docs"), "kept-terms")
    chunks = max(1, -(-kept.count() // chunk))
    dealt = kept.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int"))
    return dealt.withColumn("place", F.row_number().over(Window.partitionBy("grp", "chunk").orderBy("term")) - 1), chunks


def source_divergence(
    docs: DataFrame, text_col: str = "text", group: str = "lang", member: str = "source", least_docs: int = 3, top: int = 200, block: int = 8, chunk: int = 4096, slab: int = 4
) -> DataFrame:
    """(group, member, part, item, value, rank): how each member of a group differs from the others and from the group.

    ``part`` pair: ``item`` is each other member of the group, ``value`` the
    sum over all kept terms of floor((p - q)^2 / q), where p and q are the
    shares of the member and of the other. ``part`` term: ``item`` is a term
    that the member has a greater share of than its group, q the group's
    share; the ``top`` greatest alone. Ranks start at 1, greater values first,
    ties by the UTF-8 bytes of the item.

    Null texts, groups and members count as empty strings, so an empty name is
    a member like any other. A group without kept terms gives pairs of value
    0; a member without terms is compared by its smoothing alone; a group of
    one member gives no pairs. Repeated rows count as often as they occur.
    Whole texts are read. Further columns are ignored, whatever their names;
    an empty table gives no rows. ``block``, ``chunk`` and ``slab`` (chunks
    that a task walks over) decide the work and not the result.
    """
    counts = written(term_counts(docs, text_col, group, member), "term-counts")
    terms, chunks = kept_terms(counts, least_docs, chunk)
    terms = written(terms, "terms")
    cells = written(counts.where("term is not null").drop("docs").join(terms, ["grp", "term"]), "cells")
    sums = cells.groupBy("grp", "member").agg(F.sum("n").alias("total"))
    sizes = terms.groupBy("grp").agg(F.sum("all_n").alias("grp_total"), F.count(F.lit(1)).alias("v"))
    members = counts.where("term is null").select("grp", "member").join(sums, ["grp", "member"], "left").join(sizes, "grp", "left").fillna(0, ["total", "grp_total", "v"])
    members = written(members.withColumn("number", F.row_number().over(Window.partitionBy("grp").orderBy("member")) - 1), "members")
    pairs, best = _pairs(cells, members, block, -(-chunks // slab)), _best_terms(cells, members, top)
    return pairs.unionByName(best).select(F.col("grp").alias(group), F.col("member").alias(member), "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def _pairs(cells: DataFrame, members: DataFrame, block: int, slabs: int) -> DataFrame:
    """The pair part. Tasks give what a pair's terms have over the value of an absent one; that is added for all terms at the end."""
    named = members.withColumn("block", F.floor(F.col("number") / block).cast("int"))
    blocks = named.groupBy("grp").agg((F.max("block") + 1).alias("blocks"))
    named = written(named.join(blocks, "grp"), "blocks")
    packed = cells.groupBy("grp", "member", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("packed"))
    vectors = packed.join(named, ["grp", "member"]).select("grp", "number", "total", "v", "block", "blocks", F.pmod("chunk", F.lit(slabs)).alias("slab"), "chunk", F.col("packed.place").alias("places"), F.col("packed.n").alias("counts"))
    # a member's header goes before its chunks, so that those without terms are known as well
    none = [F.array().cast(f"array<{kind}>").alias(name) for kind, name in (("int", "places"), ("bigint", "counts"))]
    headers = named.select("grp", "number", "total", "v", "block", "blocks", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"), F.lit(-1).alias("chunk"), *none)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = headers.unionByName(vectors).select("*", other).select("grp", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "slab", "chunk", "block", "number", "total", "v", "places", "counts")
    keys = ["grp", "one", "two", "slab"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "chunk", "block", "number")
    found = in_small_batches(dealt, _tiles, "grp string, number bigint, against bigint, value bigint").groupBy("grp", "number", "against").agg(F.sum("value").alias("value"))
    name = named.select("grp", F.col("number").cast("bigint").alias("number"), "member")
    found = found.join(name, ["grp", "number"]).join(name.select("grp", F.col("number").alias("against"), F.col("member").alias("item")), ["grp", "against"])
    place = F.row_number().over(Window.partitionBy("grp", "member").orderBy(F.desc("value"), "item"))
    return found.select("grp", "member", F.lit("pair").alias("part"), "item", "value", place.alias("rank"))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tiles of one partition: rows come by task, chunk, block and number."""
    at, tiles = None, None

    def done() -> pa.RecordBatch:
        rows = tiles.rows()
        columns = [pa.array([at[0]] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))]
        return pa.RecordBatch.from_arrays(columns, names=["grp", "number", "against", "value"])

    for batch in batches:
        for row in _rows(batch):
            key = row[:4]
            if key != at:
                if at is not None:
                    yield done()
                at, tiles = key, _Tiles(*key[1:])
            tiles.add(*row[4:])
    if at is not None:
        yield done()


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows with their lists as numpy arrays."""
    plain = [c.to_pylist() for c in batch.columns[:-2]]
    lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in batch.columns[-2:]]
    for k, row in enumerate(zip(*plain, strict=True)):
        yield *row, *(values[offsets[k] : offsets[k + 1]] for offsets, values in lists)


class _Tiles:
    """The pairs of two blocks of members over the chunks of a slab, added up chunk by chunk."""

    def __init__(self, one: int, two: int, slab: int) -> None:
        self.one, self.two, self.slab = one, two, slab
        self.members: dict[int, dict[int, int]] = {one: {}, two: {}}  # by block: total by number
        self.v, self.chunk = 0, -1
        self.vectors: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.sums: list[np.ndarray] | None = None

    def add(self, chunk: int, block: int, number: int, total: int, v: int, places: np.ndarray, counts: np.ndarray) -> None:
        if chunk != self.chunk:
            self._close()
            self.chunk = chunk
        if chunk < 0:
            self.members[block][number] = total
            self.v = v
        else:
            self.vectors[block, number] = places, counts

    def _dense(self, block: int, places: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.members[block]), len(places)), np.int64)
        for k, number in enumerate(self.members[block]):
            if (block, number) in self.vectors:
                own, counts = self.vectors[block, number]
                out[k, np.searchsorted(places, own)] = counts
        return out

    def _close(self) -> None:
        """Adds the chunk that has been read: its terms' values, less that of a term which neither has."""
        if self.sums is None and self.chunk < 0 and any(self.members.values()):
            self.totals = [np.array(list(self.members[b].values()), np.int64) + self.v for b in (self.one, self.two)]
            own, others = (shares(np.zeros((len(t), 1), np.int64), t) for t in self.totals)
            self.absent = [tile(own, others), tile(others, own)]
            self.sums = [np.zeros_like(a) for a in self.absent]
        if not self.vectors:
            return
        places = np.unique(np.concatenate([p for p, _ in self.vectors.values()]))
        own, others = (shares(self._dense(b, places), t) for b, t in zip((self.one, self.two), self.totals, strict=True))
        self.sums[0] += tile(own, others) - len(places) * self.absent[0]
        if self.one != self.two:
            self.sums[1] += tile(others, own) - len(places) * self.absent[1]
        self.vectors = {}

    def rows(self) -> list[tuple[int, int, int]]:
        """(number, other's number, value); the first slab adds the value of an absent term for all terms of the group."""
        self._close()
        names = list(self.members[self.one]), list(self.members[self.two])
        out = []
        for k in range(1 if self.one == self.two else 2):
            values = self.sums[k] + (self.v * self.absent[k] if self.slab == 0 else 0)
            out += [(a, b, int(values[i, j])) for i, a in enumerate(names[k]) for j, b in enumerate(names[1 - k]) if a != b]
        return out


def _best_terms(cells: DataFrame, members: DataFrame, top: int) -> DataFrame:
    """The term part: the ``top`` terms of each member; Spark keeps no more than these of each task before they meet."""
    own = cells.join(members, ["grp", "member"])
    own = own.withColumn("p", share(F.col("n"), F.col("total") + F.col("v"))).withColumn("q", share(F.col("all_n"), F.col("grp_total") + F.col("v")))
    over = own.where("n > 0 and p > q").select("grp", "member", F.col("term").alias("item"), _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("grp", "member").orderBy(F.desc("value"), "item"))
    return over.withColumn("rank", place).where(F.col("rank") <= top).select("grp", "member", F.lit("term").alias("part"), "item", "value", "rank")
