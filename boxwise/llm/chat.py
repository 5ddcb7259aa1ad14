"""Transcript parsing with a hidden Markov model, and canonical rendering of turns.

A transcript comes as chunks in order, each of one or more lines. The states are
the speakers' roles; a line shows a symbol made of its speaker marker (if any),
its length, whether it asks, and whether it begins a chunk. Start, transition
and emission counts are learned from chunks whose role is known. Viterbi then
finds the likeliest roles of all lines of a conversation.

A conversation may hold any share of all rows, so it is decoded in blocks of
consecutive turns: each block gives a max-plus matrix (best score of its lines
from every role before it to every role at its end), matrices multiply in groups
of 64 until one is left for each conversation, and the chosen roles at the ends
of blocks go back down the same levels. The result is the path of one Viterbi
over the whole conversation.

All of this works on symbols, a byte for each line. Texts are read once to make
them, and meet the roles of their lines by a key of 128 bits at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import in_small_batches, written
from boxwise.llm.ngram_join import whole_groups

#: Words that mark a speaker, by kind (1, 2, 3).
MARKERS = (
    ("user", "human", "customer", "question", "q", "prompt", "instruction", "me"),
    ("assistant", "ai", "bot", "agent", "answer", "a", "response", "gpt", "model"),
    ("system", "context", "note"),
)
_KIND = {word: k for k, words in enumerate(MARKERS, 1) for word in words}
MARKER = re.compile(rf"^\s*[#*\[<|]*\s*({'|'.join(_KIND)})\s*[\]>|*]*\s*[:>]\s*", re.IGNORECASE)
SYMBOLS = 4 * 3 * 2 * 2
TURNS, TIES, FAN = 64, 256, 64


def symbol(line: str, first: bool) -> int:
    found = MARKER.match(line)
    n = len(line)
    size = 0 if n < 40 else 1 if n < 200 else 2
    return ((_KIND[found[1].lower()] if found else 0) * 3 + size) * 4 + 2 * line.rstrip().endswith("?") + first


def lines_of(text: str | None) -> list[str]:
    """Lines with something on them; a text without any is one empty line."""
    return [x for x in (text or "").split("\n") if x.strip()] or [""]


@dataclass
class Model:
    """Log probabilities. State 0 stands before a conversation; states 1.. are the roles."""

    roles: list[str]
    transition: np.ndarray  # 0: within a chunk to a line without a marker; 1: to a line that may begin a turn
    emission: np.ndarray

    def steps(self, symbols: list[int]) -> np.ndarray:
        """One max-plus matrix for each line: transition, then emission."""
        s = np.array(symbols)
        return self.transition[((s % 2 == 1) | (s // 12 > 0)).astype(int)] + self.emission[:, s].T[:, None, :]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None]).max(axis=1)


def product(matrices: np.ndarray) -> np.ndarray:
    out = matrices[0]
    for m in matrices[1:]:
        out = times(out, m)
    return out


def best_path(matrices: np.ndarray, entry: int, leave: int) -> list[int]:
    """The states after each matrix on a best path from ``entry`` to ``leave``, least states first in ties."""
    score = matrices[0][entry]
    back = []
    for m in matrices[1:]:
        through = score[:, None] + m
        back.append(through.argmax(axis=0))
        score = through.max(axis=0)
    path = [leave]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def train(chunks: DataFrame, conv_col: str, turn_col: str, text_col: str, role_col: str) -> Model:
    """A model from chunks with known roles; chunks with a null role are not used.

    All counts are sums over all rows; only sums by role and symbol reach the
    driver. Of several rows of one conversation and turn the least role counts
    in transitions.
    """
    known = chunks.where(F.col(role_col).isNotNull()).select(
        F.col(conv_col).alias("c"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], int] = {}
        for batch in batches:
            for role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = lines_of(text)
                for k, line in enumerate(lines):
                    key = (role, symbol(line, k == 0))
                    total[key] = total.get(key, 0) + 1
        rows = [(r, s, n) for (r, s), n in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64()))], ["role", "symbol", "n"])

    shown = in_small_batches(known.select("role", "text"), counted, "role string, symbol int, n bigint").groupBy("role", "symbol").agg(F.sum("n").alias("n")).collect()
    roles = sorted({r["role"] for r in shown})
    if len(roles) > 200:
        raise ValueError("more than 200 roles; states are kept as bytes")
    at = {r: k + 1 for k, r in enumerate(roles)}
    n = len(roles) + 1
    emission, transition = np.full((n, SYMBOLS), 0.5), np.zeros((2, n, n))
    for r in shown:
        emission[at[r["role"]], r["symbol"]] += r["n"]
    turns = written(known.groupBy("c", "turn").agg(F.min("role").alias("role")), "turns")
    following = turns.select("c", (F.col("turn") - 1).alias("turn"), F.col("role").alias("after"))
    for r in turns.join(following, ["c", "turn"]).groupBy("role", "after").agg(F.count(F.lit(1)).alias("n")).collect():
        transition[1, at[r["role"]], at[r["after"]]] += r["n"]
    for r in turns.groupBy("c").agg(F.min_by("role", "turn").alias("role")).groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect():
        transition[:, 0, at[r["role"]]] += r["n"]
    # a line that is not the first of its chunk has the role of the line before
    for k in range(1, n):
        transition[0, k, k] += sum(r["n"] for r in shown if at[r["role"]] == k and r["symbol"] % 2 == 0)
    transition[:, :, 1:] += 0.5
    with np.errstate(divide="ignore"):
        return Model(roles, np.log(transition / np.maximum(transition.sum(2, keepdims=True), 1e-9)), np.log(emission / emission.sum(1, keepdims=True)))


def _keyed(chunks: DataFrame, conv_col: str, turn_col: str, text_col: str) -> DataFrame:
    """Chunks (k1, k2, c, conv, own_turn, h, text); the same chunks have the same key."""
    c = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("null"))  # no id is taken for a null
    turn, text = F.col(turn_col).cast("bigint"), F.col(text_col).cast("string")
    rows = chunks.select(c.alias("c"), F.col(conv_col).alias("conv"), turn.alias("own_turn"), text.alias("text"))
    known = F.coalesce(F.col("own_turn").cast("string"), F.lit("")), F.coalesce("text", F.lit("\0"))
    return rows.withColumns({"k1": F.xxhash64("c", *known), "k2": F.xxhash64(F.lit(1), "c", *known), "h": F.xxhash64("text")})


def _blocks(keyed: DataFrame) -> tuple[DataFrame, int]:
    """Distinct chunks with their place: (k1, k2, c, conv, own_turn, h, symbols, copies, turn, g, t, sub), and the largest g."""

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bytes(symbol(line, k == 0) for k, line in enumerate(lines_of(t.as_py()))) for t in batch.column(6)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(found, pa.binary())], [*batch.schema.names[:6], "symbols"])

    names = ["k1", "k2", "c", "conv", "own_turn", "h"]
    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema.fields}
    rows = in_small_batches(keyed.select(*names, "text"), shown, ", ".join([*(f"{n} {kinds[n]}" for n in names), "symbols binary"]))
    rows = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), *[F.first(x).alias(x) for x in (*names[2:], "symbols")])
    rows = written(rows, "chunks")
    low, high = rows.agg(F.min("own_turn"), F.max("own_turn")).first()
    low = low or 0
    turn = F.coalesce(F.col("own_turn") - low + 1, F.lit(0))  # a null turn comes first
    rows = rows.withColumn("turn", turn)
    # turns with very many texts are dealt to blocks by the texts' hashes, in whose order they stand
    sizes = rows.groupBy("c", "turn").agg(F.ceil(F.count(F.lit(1)) / TIES).alias("subs")).withColumn("g", F.floor(F.col("turn") / TURNS))
    wide = sizes.groupBy("c", "g").agg((F.max("subs") > 1).alias("wide"))
    sizes = sizes.join(wide, ["c", "g"]).select("c", "turn", "g", "subs", "wide")
    share = (F.col("h").cast("double") / 2.0**64) + 0.5
    placed = rows.join(sizes, ["c", "turn"]).withColumns({
        "t": F.when(F.col("wide"), F.col("turn")).otherwise(0),
        "sub": F.when(F.col("wide"), F.least(F.floor(share * F.col("subs")), F.col("subs") - 1)).otherwise(0),
    })
    return placed.drop("subs", "wide"), ((high or 0) - low + 1) // TURNS


ORDER = ["g", "t", "sub"]


def _grouped(df: DataFrame, by: list, order: list[str]) -> DataFrame:
    """Rows with ``bid``, together and in order within each group."""
    return df.withColumn("bid", F.xxhash64(*by)).repartition("bid").sortWithinPartitions("bid", *by, *order)


def _names(column: pa.Array) -> np.ndarray:
    """Strings as objects: numpy's own strings would take those for equal that differ by NULs at the end."""
    return np.array(column.to_pylist(), dtype=object)


def _matrix(buffer, n: int) -> np.ndarray:
    return np.frombuffer(buffer, np.float64).reshape(n, n)


def _up(nodes: DataFrame, n: int) -> DataFrame:
    """Products of the matrices of up to FAN neighbouring groups."""
    parent = nodes.withColumn("p", F.floor(F.col("g") / FAN))

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in whole_groups(batches, lambda b: [_names(b.column(0)), b.column(1).to_numpy()]):
            firsts = [a for a, _ in bounds]
            held = batch.column(2).to_pylist()
            made = [product(np.stack([_matrix(x, n) for x in held[a:b]])).tobytes() for a, b in bounds]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(firsts)), batch.column(1).take(pa.array(firsts)), pa.array(made, pa.binary())], ["c", "g", "matrix"])

    rows = _grouped(parent, ["c", "p"], ORDER).select("c", "p", "matrix")
    out = rows.mapInArrow(multiplied, "c string, g bigint, matrix binary")
    return written(out.select("c", "g", F.lit(0).cast("bigint").alias("t"), F.lit(0).cast("bigint").alias("sub"), "matrix"), "matrices")


def _down(nodes: DataFrame, ends: DataFrame, n: int) -> DataFrame:
    """Entry and exit of every node, from those of its parents (c, g, entry, leave)."""
    parents = ends.select("c", F.col("g").alias("p"), "entry", "leave")
    rows = nodes.withColumn("p", F.floor(F.col("g") / FAN)).join(parents, ["c", "p"])

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in whole_groups(batches, lambda b: [_names(b.column(0)), b.column(1).to_numpy()]):
            held = batch.column(5).to_pylist()
            entries, leaves = [], []
            for a, b in bounds:
                entry, leave = batch.column(6)[a].as_py(), batch.column(7)[a].as_py()
                path = best_path(np.stack([_matrix(x, n) for x in held[a:b]]), entry, leave)
                leaves += path
                entries += [entry, *path[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in (0, 2, 3, 4)] + [pa.array(entries, pa.int32()), pa.array(leaves, pa.int32())], ["c", "g", "t", "sub", "entry", "leave"])

    ready = _grouped(rows, ["c", "p"], ORDER).select("c", "p", *ORDER, "matrix", "entry", "leave")
    return written(ready.mapInArrow(settled, "c string, g bigint, t bigint, sub bigint, entry int, leave int"), "ends")


def parse(chunks: DataFrame, model: Model, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """One row per run of lines of one role within a chunk: conv, turn, segment, role, starts_turn, text, rendered, copies.

    Chunks stand in the order of their turn, null first; chunks of one turn in
    the order of a hash of their text. Repeated chunks (same conversation,
    turn and text) are one, counted in ``copies``. A null conversation is one
    conversation of its own; a null or empty text is one empty line. Markers
    are taken off the text. ``rendered`` opens a turn with ``<|role|>`` where
    the role changes: the rows of a conversation in order are its canonical
    form. Without known roles, or rows, the result is empty. Further columns
    are ignored.
    """
    n = len(model.roles) + 1
    keyed = _keyed(chunks, conv_col, turn_col, text_col)
    placed, top = _blocks(keyed)
    if not model.roles:
        placed = placed.where(F.lit(False))
    placed = written(placed, "placed")
    within = ["turn", "h", "k1", "k2"]
    block_key = lambda b: [_names(b.column(0)), *[b.column(k).to_numpy() for k in (1, 2, 3)]]

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in whole_groups(batches, block_key):
            held = batch.column(4).to_pylist()
            made = [product(model.steps(list(b"".join(held[a:b])))).tobytes() for a, b in bounds]
            firsts = pa.array([a for a, _ in bounds])
            yield pa.RecordBatch.from_arrays([batch.column(k).take(firsts) for k in range(4)] + [pa.array(made, pa.binary())], ["c", *ORDER, "matrix"])

    rows = _grouped(placed, ["c", *ORDER], within).select("c", *ORDER, "symbols").mapInArrow(multiplied, "c string, g bigint, t bigint, sub bigint, matrix binary")
    levels = [written(rows, "matrices")]
    while True:  # at least once, as blocks of one g may be many
        levels.append(_up(levels[-1], n))
        top //= FAN
        if top == 0:
            break

    def first_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leave = [int(_matrix(x, n)[0].argmax()) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([0] * len(leave), pa.int32()), pa.array(leave, pa.int32())], ["c", "g", "entry", "leave"])

    ends = levels[-1].select("c", "g", "matrix").mapInArrow(first_ends, "c string, g bigint, entry int, leave int")
    for level in reversed(levels[:-1]):
        ends = _down(level, ends, n)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state before each chunk and those of its lines."""
        for batch, bounds in whole_groups(batches, block_key):
            held, out = batch.column(4).to_pylist(), []
            for a, b in bounds:
                entry = batch.column(5)[a].as_py()
                path = bytes([entry, *best_path(model.steps(list(b"".join(held[a:b]))), entry, batch.column(6)[a].as_py())])
                at = 0
                for symbols in held[a:b]:
                    out.append(path[at : at + len(symbols) + 1])
                    at += len(symbols)
            yield pa.RecordBatch.from_arrays([*batch.columns[7:], pa.array(out, pa.binary())], ["k1", "k2", "conv", "own_turn", "copies", "states"])

    kind = placed.schema["conv"].dataType.simpleString()
    carried = ["k1", "k2", "conv", "own_turn", "copies"]
    ready = _grouped(placed.join(ends, ["c", *ORDER]), ["c", *ORDER], within).select("c", *ORDER, "symbols", "entry", "leave", *carried)
    states = written(ready.mapInArrow(decoded, f"k1 bigint, k2 bigint, conv {kind}, own_turn bigint, copies bigint, states binary"), "states")

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for row in range(batch.num_rows):
                path = batch.column(0)[row].as_py()
                state, segments = path[0], []
                for to, line in zip(path[1:], lines_of(batch.column(1)[row].as_py()), strict=True):
                    line = MARKER.sub("", line, count=1)
                    if segments and to == state:
                        segments[-1][2].append(line)
                    else:
                        segments.append([to, to != state, [line]])
                    state = to
                for k, (to, starts, held) in enumerate(segments):
                    role, text = model.roles[to - 1], "\n".join(held)
                    for column, value in zip(out, (row, k, role, starts, text, (f"<|{role}|>\n" if starts else "") + text + "\n"), strict=True):
                        column.append(value)
            place = pa.array(out[0], pa.int64())
            kinds = (pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(k).take(place) for k in (2, 3, 4)] + [pa.array(c, t) for c, t in zip(out[1:], kinds, strict=True)], ["conv", "own_turn", "copies", "segment", "role", "starts_turn", "text", "rendered"])

    # the only shuffle of texts; repeated ones are one before it
    texts = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    both = texts.join(states, ["k1", "k2"]).select("states", "text", "conv", "own_turn", "copies")
    out = in_small_batches(both, rendered, f"conv {kind}, own_turn bigint, copies bigint, segment int, role string, starts_turn boolean, text string, rendered string")
    return out.select(F.col("conv").alias(conv_col), F.col("own_turn").alias(turn_col), "segment", "role", "starts_turn", "text", "rendered", "copies")


def as_transcripts(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns as raw transcripts write them: in one of four styles of markers for each conversation, a quarter of them left out."""
    styles = [("User: ", "Assistant: ", "System: "), ("Human: ", "AI: ", "Context: "), ("Q: ", "A: ", "Note: "), ("", "", "")]
    style = F.pmod(F.xxhash64(conv_col), F.lit(4))
    bare = F.pmod(F.xxhash64(conv_col, turn_col, F.lit(1)), F.lit(4)) == 0
    marker: Column = F.lit("")
    for k, words in enumerate(styles):
        for role, word in zip(("user", "assistant", "system"), words, strict=True):
            marker = F.when((style == k) & (F.col(role_col) == role) & ~bare, word).otherwise(marker)
    return turns.withColumn(text_col, F.concat(marker, F.coalesce(F.col(text_col), F.lit(""))))
