"""Cost-balanced packing of documents into training sequences.

A document's attention cost is estimated as a linear plus a quadratic term of
its tokens. Whole sequences are cut off documents that are longer than one;
what remains goes, in descending order, to the sequence with the lowest cost so
far that has room for it, and is cut only where none has. The
sequences of a window hold exactly its tokens: all are full but a last few,
whose lengths are powers of two and so need no padding.

Tokenizing and packing happen in one pass over each partition, a bounded window
of tokens at a time; nothing is shuffled, and no key can be hot. A retried task
makes its whole partition again.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import in_small_batches

#: Written after each document's ids.
END_ID = 1
SPECIAL = "<|endoftext|>"
_ENCODERS: dict = {}


def encoder(vocabulary: str, ranks: str):
    """text -> ids of the byte-level BPE in the file ``vocabulary``, without added special tokens.

    The ids come from the same vocabulary as ranks (file ``ranks``), which is
    read several times faster; a text that holds the special token's string
    goes to the ``tokenizers`` library itself, which knows it. A test holds
    the two against each other.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    if (vocabulary, ranks) not in _ENCODERS:
        with open(public_tokenizers.path(ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

        slow = lru_cache(1)(lambda: Tokenizer.from_file(public_tokenizers.path(vocabulary)))  # read when a text first needs it

        def encode(text: str) -> np.ndarray:
            if SPECIAL in text:
                ids = slow().encode(text, add_special_tokens=False).ids
            else:
                ids = fast.encode_ordinary(text)
            return np.array([*ids, END_ID], dtype="<u4")

        _ENCODERS[vocabulary, ranks] = encode
    return _ENCODERS[vocabulary, ranks]


def attention_cost(tokens: int, linear: float, quadratic: float) -> float:
    return linear * tokens + quadratic * tokens * tokens


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths.

    Sequences are numbered from 0; their lengths are ``capacity``, but for
    the binary parts of what is left over at the end.
    """
    pieces, rest, n_sequences = [], [], 0
    for doc, length in enumerate(lengths):
        whole = length // capacity
        for k in range(whole):
            pieces.append((doc, k * capacity, capacity, n_sequences, 0))
            n_sequences += 1
        if length > whole * capacity:
            rest.append((length - whole * capacity, doc, whole * capacity))
    total = sum(r[0] for r in rest)
    rooms = [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if total % capacity >> b & 1]
    used = [0] * len(rooms)
    # short sequences start as if what they lack were filled, so that long documents avoid them
    # by room a heap of (cost, sequence), and over the rooms a tree of least entries
    full = (math.inf, -1)
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    size = 1 << capacity.bit_length()
    tree = [full] * (2 * size)

    def renew(room: int) -> None:
        at = size + room
        tree[at] = heaps[room][0] if heaps[room] else full
        while at > 1:
            at >>= 1
            tree[at] = min(tree[2 * at], tree[2 * at + 1])

    def cheapest(least_room: int) -> tuple[float, int]:
        low, high, found = size + least_room, 2 * size, full
        while low < high:
            if low & 1:
                found = min(found, tree[low])
                low += 1
            low, high = low >> 1, high >> 1
        return found

    for k, room in enumerate(rooms):
        heapq.heappush(heaps[room], (attention_cost(capacity - room, linear, quadratic), k))
    for room in set(rooms):
        renew(room)
    for length, doc, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        while length:
            cost, k = cheapest(length)
            if k < 0:
                cost, k = cheapest(1)
            room = rooms[k] - used[k]
            heapq.heappop(heaps[room])
            take = min(length, room)
            pieces.append((doc, start, take, n_sequences + k, used[k]))
            used[k] += take
            length -= take
            start += take
            if take < room:
                heapq.heappush(heaps[room - take], (cost + attention_cost(take, linear, quadratic), k))
                renew(room - take)
            renew(room)
    return pieces


FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    window_tokens: int = 1_000_000,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    vocabulary: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken",
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Null texts count as empty and hold the end id alone; every row is a
    document of its own, so repeated rows and repeated ids are packed as often
    as they occur. Ties in length keep the order of rows. ``ids`` are
    little-endian unsigned 32-bit, null unless ``with_ids``. Further columns
    are ignored; an empty table gives no pieces. A window holds
    ``window_tokens`` and one document at most, which bounds memory.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    id_type = pa.int64() if rows.schema[0].dataType.typeName() in ("long", "integer", "short", "byte") else pa.string()
    rows = rows.withColumn(id_col, rows[id_col].cast("bigint" if id_type == pa.int64() else "string"))
    fields = [(id_col, id_type), *FIELDS]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        task = TaskContext.get().partitionId() << 36
        held, doc_ids, tokens, n = [], [], 0, 0

        def emit() -> pa.RecordBatch:
            nonlocal n
            columns: list[list] = [[] for _ in fields]
            top = -1
            for doc, start, length, sequence, offset in assign([len(x) for x in held], capacity, linear, quadratic):
                ids = held[doc][start : start + length].tobytes()
                row = (doc_ids[doc], start, length, zlib.crc32(ids), len(held[doc]), task + n + sequence, offset, ids if with_ids else None)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
                top = max(top, sequence)
            n += top + 1
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, fields, strict=True)], schema=pa.schema(fields))

        for batch in batches:
            texts = batch.column(1)
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                held.append(encode(texts[k].as_py()))
                doc_ids.append(doc_id)
                tokens += len(held[-1])
                if tokens >= window_tokens:
                    yield emit()
                    held, doc_ids, tokens = [], [], 0
        if held:
            yield emit()

    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    return in_small_batches(rows, packed, ", ".join(f"`{name}` {kinds[t]}" for name, t in fields))
