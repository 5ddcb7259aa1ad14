"""N-gram Jaccard self-join with Bayesian candidate pruning.

1. Every text becomes its set of word shingles; texts with one set are one
   *node*, so exact copies are handled once. A MinHash signature is kept of
   each node.
2. Bands of the signature give candidates: nodes that share a band. With
   4 values a band and 20 bands a pair of similarity 0.8 is missed with
   probability (1 - 0.8^4)^20 = 3e-5.
3. Candidates compare their MinHash values a step at a time. A pair is dropped
   as soon as the posterior probability that its similarity reaches the
   threshold, with a uniform prior, falls below the tolerance.
4. The pairs that survive are verified exactly on their shingle sets, each
   once, and the links that hold make up the classes.

Pairs are compared inside tasks, in blocks of at most ``block`` nodes against
``block`` nodes, and only sums and spanning edges leave them: their number
follows the nodes, not the pairs. Step 3 first runs on signatures alone, to
find out which nodes must meet with their shingle sets. A group of nodes that
surviving pairs connect meets in one place where it is small. A large one,
which a chain of weak candidates may make, meets by band instead, so that its
nodes only meet where they share a band. A band or group of any size is dealt
to many tasks as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import components, few_asked, in_small_batches, key_filter, maybe_in, written
from boxwise.llm.shingles import fixed_bytes, minhash_family, runs, shingles, signatures

NODE = 16


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest matches among ``n`` MinHash values with which a pair is kept.

    With a uniform prior the similarity after m matches is Beta(m + 1,
    n - m + 1), and its probability of reaching t is that of at most m
    successes in n + 1 trials at t.
    """
    below = 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n


def prune(signature: np.ndarray, a: np.ndarray, b: np.ndarray, step: int, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of rows that stay likely enough at every step."""
    matches = np.zeros(len(a), np.int32)
    for k, enough in enumerate(least):
        part = np.ascontiguousarray(signature[:, k * step : (k + 1) * step])
        matches += (part[a] == part[b]).sum(axis=1, dtype=np.int32)
        keep = matches >= enough
        a, b, matches = a[keep], b[keep], matches[keep]
    return a, b


def pair_rows(block: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of one group: within a block, or between two."""
    if lo == hi:
        return np.triu_indices(len(block), 1)
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    return np.repeat(left, len(right)), np.tile(right, len(left))


def shared_bands(signature: np.ndarray, a: np.ndarray, b: np.ndarray, rows_per_band: int) -> np.ndarray:
    """The first band that each pair (a, b) shares, or -1; a pair is a candidate where it shares one."""
    found = np.full(len(a), -1, np.int16)
    left = np.arange(len(a))
    for band in range(signature.shape[1] // rows_per_band):
        part = np.ascontiguousarray(signature[:, band * rows_per_band : (band + 1) * rows_per_band])
        same = (part[a[left]] == part[b[left]]).all(axis=1)
        found[left[same]] = band
        left = left[~same]
    return found


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each row is connected to."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            break
    return root


def dealt(groups: DataFrame, size: Column, key: list[str], block: int) -> DataFrame:
    """Rows (key..., node, ...) dealt to pairs of blocks (lo, hi) of their group; ``size`` is the group's."""
    n = F.greatest(F.ceil(size / block), F.lit(1)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    rows = (
        groups.withColumn("_n", n)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
        .select("*", other.alias("_x"))
        .withColumns({"lo": F.least("block", "_x"), "hi": F.greatest("block", "_x")})
        .drop("_n", "_x")
    )
    deal = [*key, "lo", "hi"]
    return rows.repartition(*deal).sortWithinPartitions(*deal, "node")


def whole_groups(batches: Iterator[pa.RecordBatch], key_of) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """Batches cut so that no group of sorted rows is split, with the groups' bounds."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            batch = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        bounds = list(runs(*key_of(batch)))
        cut = bounds[-1][0]
        if cut:
            yield batch.slice(0, cut), bounds[:-1]
        held = [batch.slice(cut)]
    if held:
        yield held[0], [(0, held[0].num_rows)]


def _sketch(docs: DataFrame, id_col: str, text_col: str, size: int, family) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = [shingles(t.as_py(), size) for t in batch.column(1)]
                some = [s for s in sets if len(s)]
                signature = iter(signatures(some, family)) if some else iter(())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([next(signature).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["id", "node", "n", "signature"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return in_small_batches(rows, sketched, f"id {kind}, node binary, n int, signature binary")


def _band_keys(bands: int, rows_per_band: int) -> Column:
    width = 4 * rows_per_band
    return F.array(*[F.xxhash64(F.lit(k), F.substring("signature", k * width + 1, width)) for k in range(bands)])


def _candidate_edges(nodes: DataFrame, bands: int, rows_per_band: int, n_hashes: int, block: int, step: int, least: list[int]) -> DataFrame:
    """Edges that connect what surviving candidates connect."""
    banded = nodes.select("node", F.explode(_band_keys(bands, rows_per_band)).alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = banded.join(shared, "band")
    rows = members.join(nodes.select("node", "signature"), "node").select(
        "band", "node", "size", F.concat("node", "signature").alias("body")
    )
    rows = dealt(rows, F.col("size"), ["band"], block).select("band", "lo", "hi", "block", "body")

    def connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in whole_groups(batches, lambda b: [b.column(k).to_numpy() for k in range(3)]):
            body = fixed_bytes(batch.column(4), NODE + 4 * n_hashes)
            node, signature = body[:, :NODE], np.ascontiguousarray(body[:, NODE:]).view("<u4")
            lo, hi, own = (batch.column(k).to_numpy() for k in (1, 2, 3))
            left, right, waiting = [], [], 0
            for start, end in [*bounds, (None, None)]:
                if waiting > 100_000 or start is None and waiting:
                    a, b = prune(signature, np.concatenate(left), np.concatenate(right), step, least)
                    root = local_roots(len(body), a, b)
                    member = np.flatnonzero(root != np.arange(len(root)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(map(bytes, node[x]), pa.binary()) for x in (member, root[member])], ["a", "b"]
                    )
                    left, right, waiting = [], [], 0
                if start is not None and end - start > 1:
                    a, b = pair_rows(own[start:end], lo[start], hi[start])
                    left.append(a + start)
                    right.append(b + start)
                    waiting += len(a)

    return in_small_batches(rows, connected, "a binary, b binary").distinct()


def exact_links(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float, columns: int = 4096) -> np.ndarray:
    """For each pair (a, b) of sets whether their Jaccard similarity reaches the threshold."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(a) <= 2 * len(sets):
        common = np.fromiter((len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)), np.int64, len(a))
    else:  # by products of membership matrices, some columns of the vocabulary at a time
        every = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), sizes)
        _, column, df = np.unique(every, return_inverse=True, return_counts=True)
        use = df[column] > 1
        row, column = row[use], np.unique(column[use], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        total = np.zeros((len(sets), len(sets)), np.float32)
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
            x, y = np.searchsorted(column, (first, first + columns))
            member = np.zeros((len(sets), columns), np.float32)
            member[row[x:y], column[x:y] - first] = 1
            total += member @ member.T
        common = total[a, b].astype(np.int64)
    # sizes are whole numbers, so the quotient is rounded once on both sides of a threshold such as 0.8
    return common / np.maximum(sizes[a] + sizes[b] - common, 1) >= threshold


def _places(wanted: DataFrame, bands: int, rows_per_band: int, block: int) -> DataFrame:
    """Where nodes meet: (node, places), each place a key, its band (-1 for all) and the size of what meets there.

    A group of up to ``bands`` blocks meets as a whole, which brings a node to
    no more tasks than meeting by band would.
    """
    whole = F.ceil(F.col("weight") / block) <= bands
    small = wanted.where(whole).select("node", F.array(F.struct(F.xxhash64("root").alias("key"), F.lit(-1).alias("band"), F.col("weight").alias("size"))).alias("places"))
    banded = wanted.where(~whole).select("node", "n", F.posexplode(_band_keys(bands, rows_per_band)).alias("band", "key"))
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")).where("members > 1")
    sizes = sizes.select("key", F.greatest("members", F.ceil(F.col("shingles") / 4000)).alias("size"))
    large = banded.join(sizes, "key").groupBy("node").agg(F.collect_list(F.struct("key", "band", "size")).alias("places"))
    return small.unionByName(large)


def _verified(
    docs: DataFrame, id_col: str, text_col: str, size: int, nodes: DataFrame, found: DataFrame,
    bands: int, rows_per_band: int, block: int, step: int, least: list[int], threshold: float,
) -> DataFrame:
    """From groups (node, root) of surviving candidates, per node and task: node, peer (of a link), links."""
    wanted = nodes.select("node", "rep", "n", "copies", "signature").join(found, "node")
    sizes = found.join(nodes.select("node", "n"), "node").groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    sizes = sizes.select("root", F.greatest("members", F.ceil(F.col("shingles") / 4000)).alias("weight"))
    wanted = written(wanted.join(sizes, "root"), "wanted")
    places = _places(wanted, bands, rows_per_band, block)
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).cast("string").alias("text")).where("rep is not null")
    bits = few_asked(wanted)
    texts = maybe_in(texts, "rep", key_filter(wanted, "rep", bits), bits).join(wanted.select("rep", "node", "copies", "signature"), "rep")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [shingles(t.as_py(), size) for t in batch.column(0)]
                held = pa.array([s.tobytes() for s in sets], pa.binary())
                right = pa.array([xxhash.xxh3_128_digest(s.tobytes()) == n.as_py() for s, n in zip(sets, batch.column(1), strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(1, 4)] + [held], ["node", "copies", "signature", "held"]).filter(right)

    sets = in_small_batches(texts.select("text", "node", "copies", "signature"), shingled, "node binary, copies bigint, signature binary, held binary")

    def of_nulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            held = [shingles(t.as_py(), size).tobytes() for t in whole.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(h) for h in held], pa.binary()), pa.array(held, pa.binary())], ["node", "held"])

    # texts that only rows with a null id hold are found by the digest of their shingles
    nameless = docs.where(F.col(id_col).isNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"))
    nameless = in_small_batches(nameless, of_nulls, "node binary, held binary")
    nameless = nameless.join(wanted.where("rep is null").select("node", "copies", "signature"), "node")
    sets = sets.unionByName(nameless.select("node", "copies", "signature", "held"))
    meeting = sets.join(places, "node").withColumn("place", F.explode("places")).select("place.*", "node", "copies", "signature", "held")
    rows = dealt(meeting, F.col("size"), ["key", "band"], block).select("key", "band", "lo", "hi", "block", "node", "copies", "signature", "held")
    names = ["node", "peer", "links"]

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (part.slice(at, 2000) for part in batches for at in range(0, part.num_rows, 2000))
        for batch, bounds in whole_groups(small, lambda b: [b.column(k).to_numpy() for k in range(4)]):
            nodes, peers, links = [], [], []
            for start, end in bounds:
                node = batch.column(5).slice(start, end - start).to_pylist()
                once = np.array([k for k, x in enumerate(node) if not k or x != node[k - 1]])  # a repeated id brings its row again
                node = [node[k] for k in once]
                own, copies = (batch.column(k).to_numpy()[start:end][once] for k in (4, 6))
                band, lo, hi = (batch.column(k)[start].as_py() for k in (1, 2, 3))
                signature = np.stack([np.frombuffer(batch.column(7)[start + int(k)].as_buffer(), "<u4") for k in once])
                a, b = pair_rows(own, lo, hi)
                first = shared_bands(signature, a, b, rows_per_band)
                candidate = first >= 0 if band < 0 else first == band  # so a pair that meets by several bands counts once
                a, b = prune(signature, a[candidate], b[candidate], step, least)
                if not len(a):
                    continue
                held = [np.frombuffer(batch.column(8)[start + int(k)].as_buffer(), "<u8") for k in once]
                sizes = np.array([len(s) for s in held])
                fit = np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9
                a, b = a[fit], b[fit]
                ok = exact_links(held, a, b, threshold)
                a, b = a[ok], b[ok]
                count = np.zeros(len(node), np.int64)
                np.add.at(count, a, copies[b])
                np.add.at(count, b, copies[a])
                root = local_roots(len(node), a, b)
                for k in np.flatnonzero(count):
                    nodes.append(node[k])
                    peers.append(node[root[k]])
                    links.append(int(count[k]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(peers, pa.binary()), pa.array(links, pa.int64())], names)

    return written(in_small_batches(rows, checked, "node binary, peer binary, links bigint"), "links")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
    bands: int = 20,
    rows_per_band: int = 4,
    step: int = 16,
    tolerance: float = 1e-4,
    block: int = 512,
) -> DataFrame:
    """One row per row of ``docs``: id, class_id, links, copies.

    ``class_id`` is the least id of the class, the documents connected by
    links; a link is a shingle similarity of ``threshold`` or more. ``links``
    counts the other documents that a document is linked to, copies included;
    ``copies`` those with the same shingle set, itself included. A text
    without words (null, empty, punctuation) is in a class of its own with no
    links. Repeated rows are copies of each other. Rows with a null id count
    and link as others; a class of null ids alone has a null id. Further
    columns are ignored; an empty table gives an empty result.
    """
    n_hashes = bands * rows_per_band
    sketched = written(_sketch(docs, id_col, text_col, shingle, minhash_family(n_hashes)), "sketches")
    nodes = written(
        sketched.where("node is not null").groupBy("node").agg(
            F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("signature").alias("signature")
        ),
        "nodes",
    )
    least = [least_matches(k * step, threshold, tolerance) for k in range(1, n_hashes // step + 1)]
    # smaller blocks for the bands' rows, which are short: a hot band is dealt more evenly
    found = components(_candidate_edges(nodes, bands, rows_per_band, n_hashes, max(1, block // 2), step, least))
    links = _verified(docs, id_col, text_col, shingle, nodes, found, bands, rows_per_band, block, step, least, threshold)
    classes = components(links.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    named = classes.join(nodes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("class_id"))
    linked = links.groupBy("node").agg(F.sum("links").alias("links"))
    described = (
        nodes.select("node", "rep", "copies")
        .join(classes.join(named, "root").select("node", "class_id"), "node", "left")
        .join(linked, "node", "left")
        .select("node", "copies", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    # written, so that the join has two plain sides, of which AQE splits what is hot
    described = written(described, "described")
    rows = sketched.where("node is not null").select("id", "node").join(described, "node")
    shown = rows.select(F.col("id").alias(id_col), "class_id", (F.col("links") + F.col("copies") - 1).alias("links"), "copies")
    wordless = sketched.where("node is null").select(
        F.col("id").alias(id_col), F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("links"), F.lit(1).cast("bigint").alias("copies")
    )
    return shown.unionByName(wordless)
