"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams of one to three
characters that both contain, over the square root of the product of their own
numbers (blended-spectrum presence kernel, cosine-normalised). Landmark texts
give a Nyström map of it, and kernel ridge regression, one language against the
rest, is fitted on mapped texts of a bounded labelled sample. Whole texts are
scored in batches: presence matrix x landmark matrix x map and weights.

The n-grams are those of the landmarks' texts; a text's n-grams outside them
meet no landmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwise.llm.common import fraction_of, held_out, in_small_batches, written

WORD_CHARACTERS = re.compile(r"[^\W\d_]+")
NO_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def has_letter(text: str) -> bool:
    """Whether a text has a letter; numbers such as one half or a Roman numeral's sign are none."""
    return any(any(map(str.isalpha, found[0])) for found in WORD_CHARACTERS.finditer(text))


def grams(text: str) -> np.ndarray:
    """Codes of the n-grams (1 to 3 code points) at each place of a text.

    Letters are lower-cased and what stands between words counts as one
    blank. A code holds 21 bits for each code point, so no two share one.
    """
    points = np.frombuffer(f" {NO_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    two = (points[:-1] << np.uint64(21)) | points[1:]
    return np.concatenate([points, two, (two[:-1] << np.uint64(21)) | points[2:]])


class GramTable:
    """Code -> column, by hashing into tables with one code a slot; ``codes`` are distinct."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.bits = codes, max(12, int(len(codes)).bit_length() + 3)
        self.tables = []
        left = np.arange(len(codes))
        for turn in range(64):
            if not len(left):
                break
            slots = self._slot(codes[left], turn)
            _, first = np.unique(slots, return_index=True)
            table = np.full(1 << self.bits, -1, np.int32)
            table[slots[first]] = left[first]
            self.tables.append(table)
            left = np.delete(left, first)

    def _slot(self, codes: np.ndarray, turn: int) -> np.ndarray:
        return (((codes ^ np.uint64(turn * 0x5851F42D)) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def columns(self, codes: np.ndarray) -> np.ndarray:
        """The columns of those codes that are known, with repeats."""
        found = []
        for turn, table in enumerate(self.tables):
            at = table[self._slot(codes, turn)]
            hit = at >= 0
            right = np.zeros(len(codes), bool)
            right[hit] = self.codes[at[hit]] == codes[hit]
            found.append(at[right])
            codes = codes[~right]
        return np.concatenate(found) if found else np.empty(0, np.int64)


@dataclass
class Landmarks:
    """The distinct n-grams of the landmark texts, and which of them each text has."""

    codes: np.ndarray
    presence: np.ndarray  # landmarks x codes, rows divided by the root of their number

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Landmarks:
        codes = np.unique(np.concatenate(sets))
        presence = np.zeros((len(sets), len(codes)), np.float32)
        for row, s in zip(presence, sets, strict=True):
            row[np.searchsorted(codes, s)] = 1 / np.sqrt(len(s))
        return cls(codes, presence)


def kernel_rows(texts: list[str], table: GramTable, presence: np.ndarray, columns: int = 8192) -> np.ndarray:
    """Kernel values of texts against all landmarks: products of presence matrices, some columns at a time.

    The texts' presence is kept as places and spread out for ``columns``
    n-grams at once, so that memory does not grow with the vocabulary.
    """
    seen, held = np.zeros(presence.shape[1], bool), []
    for text in texts:
        seen[table.columns(grams(text))] = True
        held.append(np.flatnonzero(seen))
        seen[held[-1]] = False
    row, column = np.repeat(np.arange(len(texts)), [len(h) for h in held]), np.concatenate([*held, np.empty(0, np.int64)])
    out = np.zeros((len(texts), len(presence)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order].astype(np.int64)
    for first in range(0, presence.shape[1], columns):
        a, b = np.searchsorted(column, (first, first + columns))
        x = np.zeros((len(texts), min(columns, presence.shape[1] - first)), np.float32)
        x[row[a:b], column[a:b] - first] = 1
        out += x @ presence[:, first : first + columns].T
    return out / np.sqrt(np.maximum([len(h) for h in held], 1))[:, None].astype(np.float32)


@dataclass
class Classifier:
    languages: list[str]
    landmarks: Landmarks
    weights: np.ndarray  # (landmarks + 1) x languages: Nyström map times ridge weights, and intercepts
    sharpness: float = 6.0

    def scores(self, kernel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language, and a score in 0..1, for rows of kernel values."""
        f = kernel @ self.weights[:-1] + self.weights[-1]
        p = np.exp(self.sharpness * (f - f.max(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        best = f.argmax(axis=1)
        return best, p[np.arange(len(f)), best]


def ridge(kernel: np.ndarray, labels: np.ndarray, between: np.ndarray, n_languages: int, penalty: float) -> np.ndarray:
    """Weights on kernel values from ridge regression on the Nyström map of ``kernel``."""
    value, vector = np.linalg.eigh(between.astype(np.float64))
    keep = value > 1e-6 * value.max()
    nystrom = vector[:, keep] / np.sqrt(value[keep])
    mapped = kernel.astype(np.float64) @ nystrom
    target = np.where(labels[:, None] == np.arange(n_languages), 1.0, -1.0)
    count = np.bincount(labels, minlength=n_languages)
    weight = (len(labels) / (n_languages * count))[labels][:, None]  # languages weigh the same
    middle, goal = (weight * mapped).sum(0) / weight.sum(), (weight * target).sum(0) / weight.sum()
    a = mapped - middle
    w = np.linalg.solve(a.T @ (weight * a) + penalty * np.eye(a.shape[1]), a.T @ (weight * (target - goal)))
    return np.vstack([nystrom @ w, goal - middle @ w]).astype(np.float32)


def language_sample(usable: DataFrame, sample: int, most_languages: int | None = None) -> tuple[DataFrame, list[str]]:
    """About ``sample`` of the rows (id, lang, text), as many of each language as there are, and the languages.

    Rows are counted over all of ``usable``, so a language is learned however
    small its share is; where there are more languages than ``sample``, about
    one row of each is taken. A caller may ask for the ``most_languages`` with
    the most rows alone, ties by name.
    """
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")
    counts = (counts if most_languages is None else counts.limit(most_languages)).collect()  # one row for each name of a language
    if not counts:
        return usable.limit(0), []
    # what a small language leaves is shared by the larger ones
    left, each = sample, {}
    for k, r in enumerate(sorted(counts, key=lambda r: (r["n"], r["lang"]))):
        each[r["lang"]] = min(r["n"], max(1, left // (len(counts) - k)))
        left -= each[r["lang"]]
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], each[r["lang"]] / r["n"])])
    return usable.where(fraction_of(F.col("id"), 11) < F.try_element_at(share, F.col("lang"))), sorted(each)


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int, n_landmarks: int, penalty: float) -> Classifier | None:
    """A classifier from about ``sample`` labelled rows; None if no row is labelled.

    Only n-gram codes of the landmarks and one row of kernel values for each
    sampled row reach the driver: both are bounded by the parameters. Of a
    language's sampled rows those of up to 20 000 bytes are landmarks first,
    so that a few very long texts do not make up the vocabulary.
    """
    id_, lang = F.col(id_col), F.col(lang_col).cast("string")
    usable = docs.where(id_.isNotNull() & lang.isNotNull() & ~held_out(id_) & F.col(text_col).rlike(r"\p{L}"))
    usable = usable.select(id_.alias("id"), lang.alias("lang"), F.col(text_col).cast("string").alias("text"))
    chosen, languages = language_sample(usable, sample)
    if not languages:
        return None
    texts = written(chosen, "language-sample")
    each = max(2 if 2 * len(languages) <= sample else 1, n_landmarks // len(languages))
    order = Window.partitionBy("lang").orderBy(F.octet_length("text") > 20_000, fraction_of(F.col("id"), 12), "id", "text")
    marks = texts.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= each).select("lang", "_place", "text")

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([np.unique(grams(t.as_py())).tobytes() for t in batch.column(2)], pa.binary())],
                ["lang", "place", "codes"],
            )

    found = sorted(in_small_batches(marks, codes, "lang string, place int, codes binary").collect(), key=lambda r: (r["lang"], r["place"]))
    shared = docs.sparkSession.sparkContext.broadcast(Landmarks.of([np.frombuffer(r["codes"], np.uint64) for r in found]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        landmarks = shared.value
        table = GramTable(landmarks.codes)
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch = whole.slice(at, 250)
                kernel = kernel_rows(batch.column(1).to_pylist(), table, landmarks.presence)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k.tobytes() for k in kernel], pa.binary())], ["lang", "kernel"])

    fitted = in_small_batches(texts.select("lang", "text"), rows, "lang string, kernel binary").toArrow()
    fitted = fitted.sort_by([("lang", "ascending"), ("kernel", "ascending")])  # sums then do not depend on the order of tasks
    kernel = np.frombuffer(b"".join(fitted["kernel"].to_pylist()), np.float32).reshape(len(fitted), -1)
    languages = sorted(set(fitted["lang"].to_pylist()))  # a hash may leave out the only row of one
    known = {x: k for k, x in enumerate(languages)}
    labels = np.array([known[x] for x in fitted["lang"].to_pylist()])
    presence = shared.value.presence
    weights = ridge(kernel, labels, presence @ presence.T, len(languages), penalty)
    return Classifier(languages, shared.value, weights)


def identify_language(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = 6000,
    n_landmarks: int = 96,
    penalty: float = 1.0,
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score.

    Languages are learned from about ``sample`` labelled rows, as many of each
    language as there are, chosen by the hash of their ids and never held out
    (crc32 of the id as text, modulo 3, is 1). Every language of these rows is
    learned. A text that is null or has no letter is ``und`` with score 0; so are all texts if nothing is labelled. Ties go to the
    language that sorts first. Repeated rows score alike. Further columns are ignored; an empty
    table gives an empty result.
    """
    model = fit(docs, id_col, text_col, lang_col, sample, n_landmarks, penalty)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = GramTable(model.landmarks.codes) if model else None
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch = whole.slice(at, 250)
                held = batch.column(1).to_pylist()
                known = [k for k, t in enumerate(held) if model and t and has_letter(t)]
                names, scores = [UNKNOWN] * len(held), [0.0] * len(held)
                if known:
                    best, score = model.scores(kernel_rows([held[k] for k in known], table, model.landmarks.presence))
                    for k, b, s in zip(known, best, score, strict=True):
                        names[k], scores[k] = model.languages[b], float(s)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    kind = texts.schema["id"].dataType.simpleString()
    out = in_small_batches(texts, scored, f"id {kind}, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
