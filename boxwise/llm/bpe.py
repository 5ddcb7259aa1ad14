"""Byte-level BPE: texts to ids and back, by a segment tree over adjacent pair ranks.

A text is cut at the special token's string, then into pieces by the
tokenizer's pattern. Over the symbols of a piece stands a segment tree whose
leaves are the ranks of adjacent pairs: its root names the leftmost pair of
lowest rank, and a merge changes three leaves, so n bytes take O(n log n) steps
whatever the piece's length. The trees of many short pieces stand side by side
in one array and merge in step. Pieces recur, so each worker keeps what it has
encoded in two generations of bounded size; what is forgotten is encoded again.

Row by row, without a shuffle: no key can be hot.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import in_small_batches

_CODECS: dict = {}
#: A leaf without a mergeable pair; below it a node is rank << 40 | place, so that the least is the leftmost of lowest rank.
NONE = (1 << 63) - 1
PLACE = (1 << 40) - 1


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(plain)))}


def merged(symbols: list[int], ranks: dict[int, int]) -> list[int]:
    """``symbols`` after all merges. ``ranks``: (left << 32 | right) to (rank << 32 | made symbol)."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length()
    tree = array("q", [NONE]) * (2 * size)
    find = ranks.get
    for i in range(n - 1):
        found = find(symbols[i] << 32 | symbols[i + 1])
        if found is not None:
            tree[size + i] = found >> 32 << 40 | i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(place: int, value: int) -> None:
        node = size + place
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            value = value if value < other else other
            node >>= 1
            if tree[node] == value:
                return
            tree[node] = value

    while (best := tree[1]) != NONE:
        i = best & PLACE
        j = after[i]
        symbols[i] = ranks[symbols[i] << 32 | symbols[j]] & 0xFFFFFFFF
        symbols[j] = -1
        k = after[i] = after[j]
        if j < n - 1:
            put(j, NONE)
        found = None
        if k < n:
            before[k] = i
            found = find(symbols[i] << 32 | symbols[k])
        put(i, NONE if found is None else found >> 32 << 40 | i)
        if (h := before[i]) >= 0:
            found = find(symbols[h] << 32 | symbols[i])
            put(h, NONE if found is None else found >> 32 << 40 | h)
    return [s for s in symbols if s >= 0]


class Codec:
    """Encodes and decodes with the vocabulary and merges of a ``tokenizers`` file of byte-level BPE."""

    def __init__(self, path: str, pattern: str, kept: int = 150_000, longest: int = 64) -> None:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        vocab, letters = held["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        pairs = ((k, *(m if isinstance(m, list) else m.split(" "))) for k, m in enumerate(held["model"]["merges"]))
        self.ranks = {vocab[a] << 32 | vocab[b]: k << 32 | vocab[a + b] for k, a, b in pairs}
        self.pairs = np.array(sorted(self.ranks), dtype=np.int64)
        self.found = np.array([self.ranks[p] for p in self.pairs.tolist()], dtype=np.int64)
        self.first = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        back = {c: b for b, c in letters.items()}
        self.pieces = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, k in vocab.items():
            self.pieces[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, k in self.special.items():
            self.pieces[k] = token.encode()
        self.decimal = [str(k) for k in range(len(self.pieces))]
        self.split = regex.compile(pattern).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.kept, self.longest = kept, longest
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def encode(self, texts: list[str]) -> list[array]:
        """The ids of each text; the special tokens' strings give their ids."""
        parts = [[self.split(part) if k % 2 == 0 else part for k, part in enumerate(self.cut(text) if self.cut and any(s in text for s in self.special) else [text])] for text in texts]
        known = self._known(set(chain.from_iterable(part for own in parts for part in own[::2])))
        out = []
        for own in parts:
            ids = array("i")
            for k, part in enumerate(own):
                if k % 2:
                    ids.append(self.special[part])
                else:
                    ids.extend(chain.from_iterable(map(known.__getitem__, part)))
            out.append(ids)
        return out

    def _known(self, pieces: set[str]) -> dict[str, tuple]:
        """The ids of these pieces at least, by piece: of the younger generation, else the older one, else encoded."""
        if len(self.young) > self.kept:
            self.young, self.old = {}, self.young
        new = []
        for piece in pieces - self.young.keys():
            if (ids := self.old.get(piece)) is not None:
                self.young[piece] = ids
            else:
                new.append(piece)
        made = dict(zip(new, self.merged_all([p.encode() for p in new]), strict=True))
        self.young |= {p: ids for p, ids in made.items() if len(p) <= self.longest}
        long = {p: ids for p, ids in made.items() if len(p) > self.longest}
        return self.young | long if long else self.young

    def merged_all(self, pieces: list[bytes], widest: int = 64) -> list[tuple]:
        """The ids of each piece. Those of more than ``widest`` + 1 bytes get a tree by itself."""
        out: list = [None] * len(pieces)
        sizes: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            sizes.setdefault(1 << max(len(piece) - 2, 0).bit_length(), []).append(k)
        for size, places in sizes.items():
            if size > widest:
                for k in places:
                    out[k] = tuple(merged(self.first[np.frombuffer(pieces[k], np.uint8)].tolist(), self.ranks))
            else:
                for at in range(0, len(places), 1 << 14):
                    part = places[at : at + (1 << 14)]
                    for k, ids in zip(part, self._side_by_side([pieces[k] for k in part], size), strict=True):
                        out[k] = ids
        return out

    def _side_by_side(self, pieces: list[bytes], size: int) -> list[tuple]:
        """``merged`` for pieces of at most ``size`` + 1 bytes, with one tree of ``size`` leaves each, all in step."""
        n, width = len(pieces), size + 2  # symbols, and a place after the last
        lengths = np.array([len(p) for p in pieces])
        filled = np.arange(width) < lengths[:, None]
        symbols = np.full((n, width), -1, dtype=np.int64)
        symbols[filled] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        tree = np.full((n, 2 * size), NONE, dtype=np.int64)
        tree[:, size:] = self._leaves(symbols[:, :size], symbols[:, 1 : size + 1], np.arange(size))
        for node in range(size - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        after = np.broadcast_to(np.minimum(np.arange(width) + 1, width - 1), (n, width)).copy()
        before = np.broadcast_to(np.arange(width) - 1, (n, width)).copy()
        symbols, tree, after, before = symbols.ravel(), tree.ravel(), after.ravel(), before.ravel()
        rows = np.flatnonzero(tree[1 :: 2 * size] != NONE)
        while len(rows):
            own, root = rows * width, rows * 2 * size
            best = tree[root + 1]
            i = best & PLACE
            j = after[own + i]
            k = after[own + j]
            h = before[own + i]
            symbols[own + i] = self._made(symbols[own + i], symbols[own + j])
            symbols[own + j] = -1
            after[own + i] = k
            before[own + k] = i
            first = np.maximum(h, 0)  # where nothing stands before, the first leaf is i's own and set last
            left = np.where(h >= 0, symbols[own + first], -1)
            inner = j < size
            tree[(root + size + j)[inner]] = NONE
            tree[root + size + first] = self._leaves(left, symbols[own + i], first)
            tree[root + size + i] = self._leaves(symbols[own + i], symbols[own + k], i)
            nodes = [size + i, size + first, size + np.where(inner, j, i)]
            for _ in range(size.bit_length() - 1):
                nodes = [node >> 1 for node in nodes]
                for node in nodes:
                    below = root + 2 * node
                    tree[root + node] = np.minimum(tree[below], tree[below + 1])
            rows = rows[tree[root + 1] != NONE]
        kept = symbols.reshape(n, width) >= 0
        ids, ends = symbols[kept.ravel()].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the ranks hold for pairs, and whether they hold them; a symbol of -1 is in no pair."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return self.found[at], self.pairs[at] == pair

    def _leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        found, held = self._looked_up(left, right)
        return np.where(held, found >> 32 << 40 | place, NONE)

    def _made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self._looked_up(left, right)[0] & 0xFFFFFFFF

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, ids that the vocabulary lacks become nothing."""
        try:
            return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")
        except IndexError:
            return self.decode([k for k in ids if k < len(self.pieces)])

    def listed(self, ids) -> str:
        return ",".join(map(self.decimal.__getitem__, ids))


def codec(vocabulary: str, pattern: str | None = None) -> Codec:
    """The codec of a file of public_tokenizers, or of a path with a slash, read once by each worker."""
    import public_tokenizers

    if (vocabulary, pattern) not in _CODECS:
        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        _CODECS[vocabulary, pattern] = Codec(path, pattern or public_tokenizers.PATTERN)
    return _CODECS[vocabulary, pattern]


FIELDS = [("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_sha256", pa.string()), ("decoded", pa.string()), ("decoded_sha256", pa.string())]
KINDS = "n_tokens bigint, ids array<int>, ids_sha256 string, decoded string, decoded_sha256 string"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", pattern: str | None = None, with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """One row per row: id, n_tokens, ids, ids_sha256, decoded, decoded_sha256.

    ``decoded`` is the text that the ids give back; the digests are those of
    the decimal ids joined by commas and of the decoded text in UTF-8. ``ids``
    and ``decoded`` are null unless asked for, so that long columns need not
    leave the worker. A null text is an empty one, which has no ids and
    decodes to itself. Rows are independent: repeated rows, ties and null ids
    come back as often as they are there. Whole texts are encoded, however
    long; a piece without any cut takes memory in proportion to itself.
    Further columns are ignored; an empty table gives none.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    id_type = rows.schema[0].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in batches:
            columns: list[list] = [[] for _ in FIELDS]
            for ids in chain.from_iterable(map(own.encode, _by_size(batch.column(1)))):
                back = own.decode(ids)
                row = (len(ids), np.frombuffer(ids, np.int32) if with_ids else None, _sha256(own.listed(ids)), back if with_text else None, _sha256(back))
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            made = [pa.array(c, type=t) for c, (_, t) in zip(columns, FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=[id_col, *(name for name, _ in FIELDS)])

    return in_small_batches(rows, encoded, f"`{id_col}` {id_type}, {KINDS}")


def decode(df: DataFrame, ids_col: str = "ids", into: str = "decoded", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """``df`` with the text of an array of ids. Null ids give null, null entries and ids outside the vocabulary nothing."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            texts = [None if ids is None else own.decode([k for k in ids if k is not None and k >= 0]) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.string())], names=[*batch.schema.names, into])

    kept = df.drop(into)
    return in_small_batches(kept, decoded, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", `{into}` string")


def _by_size(texts: pa.Array, characters: int = 4_000_000) -> Iterator[list[str]]:
    """Runs of texts of about so many characters, so that what is held at once does not grow with the texts."""
    run, n = [], 0
    for text in texts:
        run.append(text.as_py())
        n += len(run[-1])
        if n >= characters:
            yield run
            run, n = [], 0
    if run:
        yield run


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
