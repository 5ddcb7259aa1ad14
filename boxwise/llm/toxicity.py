"""Toxicity by noisy-channel deobfuscation.

1. A character language model (four characters, interpolated down to one) is
   counted over every document of the corpus.
2. Suspect spans (words that hold a digit, sign, inner separator or doubled
   letter, and three or more letters that are spaced out) become lattices:
   leetspeak signs stand for letters, separators and repeats may have been
   inserted. Viterbi finds the likeliest original under the language model; the
   rest of the text passes unchanged. What Viterbi would say of doubled letters
   that stand apart from each other is worked out in closed form. An original
   replaces its span only if the corpus holds its words, and often enough beside
   those of the span (``lexicon.py``); so codes, names and words with doubled
   letters stand, and no limit on digits or gaps is needed.
3. The restored text is scored by a logistic regression on its words and word
   beginnings. L1 regularisation selects them from a bounded sample of labelled
   rows, and a second fit on the selected ones sets their weights.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import bounded_sample, held_out, in_parts, in_small_batches, written
from boxwise.llm.lexicon import UNSEEN, WORDS, Lexicon, distinct_words, known_words, word_counts

#: Characters of the language model: 0 is anything that is no letter, 1-26 are a-z, 27 other letters.
CODES, ORDER = 28, 4
#: What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "*": "abcdefghijklmnopqrstuvwxyz",
}
SEPARATORS = " ._-*"
#: Letters of other alphabets that look like one of a-z.
LOOKALIKES = {
    "\u0131": "i", "\u0261": "g", "\u0430": "a", "\u0435": "e", "\u043e": "o", "\u0440": "p", "\u0441": "c", "\u0443": "y", "\u0445": "x", "\u0455": "s",
    "\u0456": "i", "\u0458": "j", "\u04bb": "h", "\u0501": "d", "\u03b1": "a", "\u03b9": "i", "\u03bd": "v", "\u03bf": "o", "\u03c1": "p",
}
#: Costs of the channel, in nats; dropping a character also saves its share of the model's cost.
SIGN, SIGN_KEPT, DROP_SEPARATOR, DROP_REPEAT, DROP_DOUBLE = 0.7, 4.0, 2.0, 1.5, 4.0
#: Of signs that plain texts have as well: separators inside a word, and signs after its end.
SEPARATOR_KEPT, END_KEPT = 0.5, 1.0
#: Of separators between letters that are spaced out: a gap kept, and a gap dropped that is wider than others.
SPACED_KEPT, WIDE_DROPPED = 2.5, 2.0
#: Without a lexicon, a span with more digits than this, and half as many as letters, is taken for a code whose signs stand for themselves.
MOST_DIGITS = 6

#: Letters and digits that are spaced out: without a lexicon with up to three separators between each two, with one by any number.
WIDEST_GAP = 3
SPACED = re.compile(rf"(?<![^\W_])[^\W_](?:[ ._*-]{{1,{WIDEST_GAP}}}[^\W_]){{2,}}(?![^\W_])")
SPACED_ANYHOW = re.compile(r"(?<![^\W_])[^\W_](?:[ ._*-]+[^\W_]){2,}(?![^\W_])")
#: Classes of code points; from 0x10000 all are letters. ``DOUBLED`` is a letter's that repeats the one before it.
LETTER, DIGIT, SIGN_CLASS, SEPARATOR, PLAIN_LETTER, LOOKS, SIGN_ALONE, DOUBLED = (1 << k for k in range(8))


def _class(char: str) -> int:
    digit = char in "0123456789"
    letter = char.isalnum() and not digit
    return (
        LETTER * letter | DIGIT * digit | SIGN_CLASS * (char in "@$!|+*€") | SEPARATOR * (char in SEPARATORS + UNSEEN)
        | PLAIN_LETTER * (letter and char.isascii()) | LOOKS * (letter and _lower(char) in LOOKALIKES) | SIGN_ALONE * (char in "@$!|€")
    )


def _lower(char: str) -> str:
    return low if len(low := char.lower()) == 1 else char


_POINTS = 0x110000
_CLASS = np.full(_POINTS, LETTER, np.uint8)
_CLASS[:0x10000] = [_class(chr(k)) for k in range(0x10000)]
_LOWER = np.arange(_POINTS, dtype=np.uint32)
_LOWER[:0x10000] = [ord(_lower(chr(k))) for k in range(0x10000)]
#: The language model's code of each letter, 0 of what is none.
_LETTER_CODE = np.where(_CLASS & LETTER, np.uint8(CODES - 1), np.uint8(0))
_LETTER_CODE[:0xAA] = [ord(c.lower()) - 96 if c.isascii() and c.isalpha() else 0 for c in map(chr, range(0xAA))]
#: The code of each character of a lower-cased text below 0xAA, and that of all above.
_TEXT_CODE = np.array([k - 96 if 97 <= k <= 122 else 0 for k in range(0xAA)] + [CODES - 1], np.uint8)


def char_codes(text: str) -> np.ndarray:
    """Codes of a lower-cased text, runs of 0 as one, with 0 at both ends."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    codes = _TEXT_CODE[np.minimum(points, 0xAA)]
    seen = codes > 0
    seen[1:] |= seen[:-1].copy()
    seen[0] = True
    return codes[seen].astype(np.int64)


def char_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(code, n): how often each sequence of four characters occurs in all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES**ORDER, np.int64)
        for batch in batches:
            texts, waiting, size = [], [], 0
            for k in range(batch.num_rows):
                waiting.append(batch.column(0)[k].as_py() or "")
                size += len(waiting[-1])
                if size > 1_000_000 or k == batch.num_rows - 1:
                    c = char_codes("   ".join(waiting))
                    if len(c) >= ORDER:
                        total += np.bincount(((c[:-3] * CODES + c[1:-2]) * CODES + c[2:-1]) * CODES + c[3:], minlength=len(total))
                    waiting, size = [], 0
        used = np.flatnonzero(total)
        for at in range(0, len(used), 20_000):
            part = used[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["code", "n"])

    return in_small_batches(docs.select(F.col(text_col).cast("string")), counted, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame, weight: float = 5.0) -> np.ndarray:
    """log P(character | three before it), by code; the table has 28^4 entries at most."""
    grams = np.zeros(CODES**ORDER, np.float64)
    rows = counts.toArrow()
    grams[rows["code"].to_numpy()] = rows["n"].to_numpy()
    p = np.full(CODES, 1.0 / CODES)
    for order in range(1, ORDER + 1):
        n = grams.reshape(-1, CODES**order).sum(axis=0).reshape(-1, CODES)
        p = (n + weight * np.tile(p.reshape(-1, CODES), (CODES, 1))[: len(n)]) / (n.sum(axis=1, keepdims=True) + weight) if order > 1 else (n + weight * p) / (n.sum() + weight)
    return np.log(p).astype(np.float32).ravel()


def _code(char: str) -> int:
    return ord(char) - 96 if "a" <= char <= "z" else CODES - 1 if char.isalpha() else 0


def _readings(span: str, judged: bool = False, plain_ends: bool = False) -> list[list[tuple[str, float]]]:
    """For each character of a lower-cased span what it may have been, with prices; an empty text drops it.

    Where a lexicon judges the result (``judged``), no span counts as a code,
    gaps may have any width, and letters may be lookalikes of others. With
    ``plain_ends`` signs after the last letter are no likelier to stand than others.
    """
    spaced = bool((SPACED_ANYHOW if judged else SPACED).fullmatch(span))
    inside = [k for k, char in enumerate(span) if char.isalnum()] or [0]
    # in letters that are spaced out a gap is dropped as a rule, and a wider gap than the least may well end a word;
    # three letters alone are found in plain texts as well, more hardly ever
    gap = min((b - a - 1 for a, b in zip(inside, inside[1:], strict=False)), default=0) if spaced else 0
    digits = sum(char in "0123456789" for char in span)
    coded = not judged and digits > MOST_DIGITS and 2 * digits > sum(map(str.isalpha, span))
    read = []
    for k, char in enumerate(span):
        options: list[tuple[str, float]] = []
        if char.isalpha():
            options.append((char, 0.0))
            if judged and char in LOOKALIKES:
                options.append((LOOKALIKES[char], SIGN))
            if k and span[k - 1] == char:
                run = k > 1 and span[k - 2] == char or span[k + 1 : k + 2] == char
                options.append(("", DROP_REPEAT if run else DROP_DOUBLE))
        elif coded and char not in SEPARATORS:
            options.append((char, 0.0))
        else:
            for letter in LEET.get(char, ""):
                options.append((letter, SIGN + (1.5 if char == "*" else 0.0)))
            if char in SEPARATORS:
                first = not k or span[k - 1].isalnum()
                wide = spaced and first and len(span[k:]) - len(span[k:].lstrip(SEPARATORS)) > gap
                free = judged and spaced and not first  # the first separator of a gap has paid
                options.append(("", 0.0 if free else WIDE_DROPPED if wide else DROP_SEPARATOR * (0.1 if spaced else 1.0)))
            if char in UNSEEN:
                options.append(("", 0.1))
            elif k and span[k - 1] == char:
                options.append(("", DROP_REPEAT))
            outside = not plain_ends and k > inside[-1] or char == "*" and k < inside[0]
            kept = (SPACED_KEPT if spaced and len(inside) > 3 else SEPARATOR_KEPT) if char in SEPARATORS and char != "*" else END_KEPT if outside else SIGN_KEPT
            options.append((char, kept))
        read.append(options)
    return read


def _decode(read: list[list[tuple[str, float]]], model: np.ndarray | array, widest: int | None = None, bound: float = math.inf, start: int = 0) -> tuple[float, str]:
    """Least cost and its text, among paths that cost ``bound`` or less; over the ``widest`` best states alone where that is set.

    ``start`` is the state before the first character, its last three codes.
    """
    square, pair = CODES**3, CODES * CODES
    least = [min([price for _, price in options]) for options in read]
    left = sum(least)
    # state: the last three codes; value: (cost, link to the text so far), so no text is copied
    best: dict[int, tuple[float, tuple | None]] = {start: (0.0, None)}
    for options, cheapest in zip(read, least, strict=True):
        left -= cheapest
        most = bound - left + 1e-6
        coded = [(letter, price, _code(letter) if letter else 0) for letter, price in options]
        following: dict[int, tuple[float, tuple | None]] = {}
        for state, (cost, text) in best.items():
            for letter, price, code in coded:
                to, now = state, cost + price
                if now > most:  # the model's prices are not negative
                    continue
                if letter:
                    code += state * CODES
                    if code % pair:  # the model counts a run of characters that are no letters as one
                        to, now = code % square, now - model[code]
                        if now > most:
                            continue
                held = following.get(to)
                if held is None or now < held[0]:
                    following[to] = now, (text, letter) if letter else text
        if widest and len(following) > widest:
            following = dict(sorted(following.items(), key=lambda x: (x[1][0], x[0]))[:widest])
        best = following
    ended = lambda state, text: text is not None and not state % CODES and not text[1].isdigit()
    cost, _, text = min(((cost - (0.0 if ended(state, text) else model[state * CODES]), state, text) for state, (cost, text) in best.items()), key=lambda x: x[:2])
    letters = []
    while text:
        text, letter = text
        letters.append(letter)
    return cost, "".join(reversed(letters))


def restore(span: str, model: np.ndarray | array) -> str:
    """The likeliest original of an obfuscated span, in lower case.

    Time and memory are in proportion to its length. Signs that stand for any
    letter multiply the states; there a narrow search first gives the cost of
    one reading, and states that cannot become cheaper than that are left out,
    as no price is negative. The result is that of all states.
    """
    span = span.lower()
    return _cheapest(_readings(span), span, model, 0)


def _cheapest(read: list[list[tuple[str, float]]], span: str, model: np.ndarray | array, start: int) -> str:
    bound = _decode(read, model, 8, math.inf, start)[0] if "*" in span else math.inf
    return _decode(read, model, None, bound, start)[1]


#: Letters, none of them twice in a row, and signs after the last of them.
SIGNS_AT_END = re.compile(r"((?:([^\W\d_])(?!\2))+)([\W\d_]+)")


def _restore_in_parts(model: array, judged: bool = False) -> Callable[..., str]:
    """``restore`` that decodes the signs at the end of plain letters by the three letters before them, and keeps what it found."""

    @lru_cache(60_000)
    def end_of(state: int, tail: str, plain_ends: bool) -> str:
        return _cheapest(_readings("xy" + tail, judged, plain_ends)[2:], tail, model, state)

    def one_reading(letters: str) -> bool:
        return letters.isascii() or letters.isalpha() and LOOKALIKES.keys().isdisjoint(letters)

    def restored(span: str, plain_ends: bool = False) -> str:
        span = span.lower()
        found = SIGNS_AT_END.fullmatch(span)
        if found is None or len(found[1]) < 2 or judged and not one_reading(found[1]) or not judged and sum(map(str.isdigit, found[3])) > MOST_DIGITS:
            return _cheapest(_readings(span, judged, plain_ends), span, model, 0)
        state = 0
        for char in found[1][-3:]:
            state = state * CODES + _code(char)
        return found[1] + end_of(state, found[3], plain_ends)

    return restored


def _judged_by(lexicon: Lexicon, model: array, typo: float) -> Callable[[str], str]:
    """The decoder's reading of a span in lower case where the lexicon holds its words, else the span."""
    decoded = _restore_in_parts(model, True)

    def restored(span: str) -> str:
        span = span.lower()
        found = decoded(span)
        if found == span and not any(c.isdigit() for c in span) and (words := WORDS.findall(span)) and all(map(lexicon.count, words)):
            return span
        # a word may have doubled letters of its own, which cost the decoder more than they need
        for reading in (lambda: found, lambda: lexicon.respelled(found), lambda: lexicon.respelled(decoded(span, True))):
            read = reading()
            if lexicon.accepts(span, read, typo):
                return read
            if read is not found and (span[-1] not in LEET or span[-1] == "*"):
                break  # the last way differs in the signs at the end alone; a wildcard there says nothing
        if SPACED_ANYHOW.fullmatch(span):
            words = lexicon.split("".join(WORDS.findall(found)))
            return span if words is None else words
        if any(c in LEET for c in span):
            words = lexicon.split_run(span, found)
            if words is not None:
                return words
        return span

    return restored


class _Marked:
    """What the characters of texts are, and their suspect spans as arrays of starts and ends.

    The texts stand one after another with two line feeds after each, so that
    no span is in two of them; ``firsts`` is where each begins.
    """

    def __init__(self, texts: list[str], judged: bool = False):
        self.firsts = np.cumsum([0, *(len(t) + 2 for t in texts)])
        self.points = points = np.frombuffer("\n\n".join([*texts, ""]).encode("utf-32-le"), np.uint32).astype(np.intp)
        self.kind = kind = _CLASS[points]
        letter = (kind & LETTER) > 0
        folded = _LOWER[points]
        self.double = np.zeros(len(points), bool)
        np.logical_and(folded[1:] == folded[:-1], letter[1:] & letter[:-1], out=self.double[1:])
        kind[self.double] |= DOUBLED
        core = (kind & (LETTER | DIGIT | SIGN_CLASS)) > 0
        # runs of characters of words and of separators inside them, from the first of a word to the last
        run = core | ((kind & SEPARATOR) > 0) & (points != 32)
        edge = np.flatnonzero(run[1:] != run[:-1]) + 1  # the last character is a line feed, so no run is open there
        edge = np.r_[0, edge] if len(run) and run[0] else edge
        starts, ends = edge[::2].copy(), edge[1::2].copy()
        late, early = np.flatnonzero(~core[starts]), np.flatnonzero(~core[ends - 1])
        if len(late) or len(early):
            at = np.r_[-1, np.flatnonzero(core), len(points)]
            starts[late] = at[np.searchsorted(at, starts[late])]
            ends[early] = at[np.searchsorted(at, ends[early]) - 1] + 1
            held = starts < ends
            starts, ends = starts[held], ends[held]
        self.starts, self.ends = starts, ends
        any_of, all_of = self.over_spans(np.bitwise_or), self.over_spans(np.bitwise_and)
        lettered, plain = (any_of & LETTER) > 0, (all_of & LETTER) > 0
        odd = lettered & (~plain | ((any_of & DOUBLED) > 0))
        mixed = np.zeros(len(starts), bool)
        if judged:
            # letters among lookalikes of others, and words of signs alone
            mixed = (any_of & LOOKS) > 0
            odd |= mixed & ((any_of & PLAIN_LETTER) > 0)
            for k in np.flatnonzero(~lettered & (ends - starts > 2) & ((any_of & SIGN_ALONE) > 0)).tolist():
                span = kind[starts[k] : ends[k]]
                signs = np.count_nonzero(span & SIGN_ALONE)
                odd[k] = signs > 1 and signs >= np.count_nonzero(span & DIGIT)
        self.starts, self.ends, self.mixed, self.plain = starts[odd], ends[odd], mixed[odd], plain[odd]
        # three letters or digits that stand alone, with nothing but separators between them
        alone = np.zeros(len(points) + 2, bool)
        np.greater(kind & (LETTER | DIGIT), 0, out=alone[1:-1])
        at = np.flatnonzero(alone[1:-1] & ~alone[:-2] & ~alone[2:])
        near = np.zeros(max(0, len(at) - 1), bool)
        if len(near):
            between = np.bitwise_and.reduceat(kind, np.column_stack([at[:-1] + 1, at[1:]]).ravel())[::2]
            near = ((at[1:] - at[:-1] - 1 <= WIDEST_GAP) | judged) & ((between & SEPARATOR) > 0)
        self.spaced = np.unique(np.searchsorted(self.firsts, at[:-2][near[1:] & near[:-1]], side="right") - 1)

    def over_spans(self, combine: np.ufunc) -> np.ndarray:
        """The classes of each span's characters, combined."""
        if not len(self.starts):
            return np.zeros(0, np.uint8)
        return combine.reduceat(self.kind, np.column_stack([self.starts, self.ends]).ravel())[::2]

    def read_best_as_they_are(self, model: np.ndarray) -> np.ndarray:
        """Spans of letters alone of which no doubled letter is worth dropping.

        Dropping a letter changes the model's prices of itself and the three
        characters after it. Where doubled letters stand four places apart or
        more, each is decided by itself, and so in closed form; spans in which
        they stand closer are left to the lattice, and so are near ties.
        """
        plain, last = self.plain, len(self.points) - 1
        place = np.flatnonzero(self.double)
        span = np.searchsorted(self.starts, place, side="right") - 1
        inside = span >= 0
        inside[inside] = (place[inside] < self.ends[span[inside]]) & plain[span[inside]]
        place, span = place[inside], span[inside]
        close = np.r_[False, (span[1:] == span[:-1]) & (place[1:] - place[:-1] < 4)]
        # the letter itself is c[3]; what lies outside of the span is set to 0 below
        c = [_LETTER_CODE[self.points[np.clip(place + k, 0, last)]].astype(np.int64) for k in range(-3, 4)]
        first, length = self.starts[span], self.ends[span]
        for k in range(3):
            c[k] = np.where(place - 3 + k >= first, c[k], 0)
        for k in range(1, 4):
            c[3 + k] = np.where(place + k < length, c[3 + k], 0)
        price = lambda w, x, y, z: -model[((w * CODES + x) * CODES + y) * CODES + z]
        kept, dropped = price(*c[:4]), np.zeros(len(place), model.dtype)
        for k in range(1, 4):
            counts = place + k <= length  # up to the end of the word
            kept = kept + np.where(counts, price(*c[k : k + 4]), 0)
            dropped = dropped + np.where(counts, price(*[x for j, x in enumerate(c[k - 1 : k + 4]) if j != 4 - k]), 0)
        worth = kept - dropped > DROP_DOUBLE - 1e-3
        doubtful = np.zeros(len(self.starts), bool)
        doubtful[span[worth | close]] = True
        return plain & ~doubtful


def suspects(text: str) -> tuple[list[tuple[int, int]], bool]:
    """The spans of suspect words of a text, and whether letters may be spaced out in it.

    A word is what stands between blanks and other punctuation, from its first
    to its last letter, digit or sign. It is suspect if it holds a letter and
    a digit, a sign, a separator inside, or a letter twice in a row.
    """
    marked = _Marked([text])
    return list(zip(marked.starts.tolist(), marked.ends.tolist(), strict=True)), len(marked.spaced) > 0


def batch_restorer(model: np.ndarray, cached_length: int = 200, lexicon: Lexicon | None = None, typo: float = 5.0) -> Callable[[list[str]], list[str]]:
    """texts -> texts with their suspect spans restored; those that read best as they are keep their case.

    With a lexicon a span is replaced only by words that it holds; ``typo`` is
    the price (in nats) of a disguise that is made of known words itself.
    """
    prices = np.asarray(model, np.float32)
    fast = array("f", prices.tobytes())  # whose single values are read faster
    judged = lexicon is not None
    decoded = _judged_by(lexicon, fast, typo) if judged else _restore_in_parts(fast)
    spaced_out = SPACED_ANYHOW if judged else SPACED

    def plain(span: str) -> str:
        found = decoded(span)
        return span if found == span.lower() else found

    cache = lru_cache(60_000)(plain)
    cached = lambda span: (cache if len(span) <= cached_length else plain)(span)
    # the model does not tell letters outside a-z apart, so three of them say nothing
    joined = lambda m: cached(m[0]) if len(m[0]) > 5 or any(c.isascii() and c.isalnum() for c in m[0]) else m[0]

    def respell(texts: list[str], marked: _Marked) -> None:
        asked = marked.mixed | ~marked.read_best_as_they_are(prices)
        starts, ends = marked.starts[asked], marked.ends[asked]
        of = np.searchsorted(marked.firsts, starts, side="right") - 1
        first = marked.firsts[of]
        spans: dict[int, list[tuple[int, int]]] = {}
        for k, a, b in zip(of.tolist(), (starts - first).tolist(), (ends - first).tolist(), strict=True):
            spans.setdefault(k, []).append((a, b))
        for k, held in spans.items():
            text, parts, at = texts[k], [], 0
            for a, b in held:
                parts += [text[at:a], cached(text[a:b])]
                at = b
            texts[k] = "".join([*parts, text[at:]])

    def restored(texts: list[str]) -> list[str]:
        texts = list(texts)
        marked = _Marked(texts, judged)
        spaced = marked.spaced.tolist()
        closed = [spaced_out.sub(joined, texts[k]) for k in spaced]
        respell(texts, marked)
        if spaced:  # these alone are marked anew
            respell(closed, _Marked(closed, judged))
            for k, text in zip(spaced, closed, strict=True):
                texts[k] = text
        return texts

    return restored


def restorer(model: np.ndarray, cached_length: int = 200, lexicon: Lexicon | None = None) -> Callable[[str], str]:
    """text -> text with its suspect spans restored."""
    many = batch_restorer(model, cached_length, lexicon)
    return lambda text: many([text])[0]


def features(word: str) -> list[str]:
    """A word in lower case and its beginnings."""
    return [word] + [word[:k] + "~" for k in (4, 5, 6) if len(word) >= k]


def fit(
    labelled: DataFrame, model: np.ndarray, lexicon: Lexicon | None = None, l1: float = 3e-4, l2: float = 1e-5, least_rows: int = 3, least_lift: float = 2.0
) -> tuple[float, dict[str, float]]:
    """Intercept and weights of features, from rows (text, label); the caller bounds their number, and so that of features.

    Features speak for label 1: they are seen in at least ``least_rows`` such
    rows, and ``least_lift`` times as often in them as by chance.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deobfuscate = batch_restorer(model, lexicon=lexicon)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                texts = [t for part in in_parts(batch.column(0).to_pylist()) for t in deobfuscate(part)]
                found = [sorted({f for w in distinct_words(t.lower()) for f in features(w)}) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column(1)], ["tokens", "label"])

    rows = written(in_small_batches(labelled.select(F.col("text").cast("string"), F.col("label").cast("double")), tokens, "tokens array<string>, label double"), "labelled")
    if rows.select("label").distinct().count() < 2:  # nothing to tell apart: the share of label 1 is all there is to know
        share = rows.agg(F.avg("label")).first()[0]
        return (0.0 if share is None else 20.0 * (2 * share - 1)), {}
    share = rows.agg(F.avg("label")).first()[0]
    seen = rows.select(F.explode("tokens").alias("token"), "label").groupBy("token").agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n"))
    useful = seen.where((F.col("ones") >= least_rows) & (F.col("ones") > least_lift * share * F.col("n"))).orderBy("token")
    vocabulary = [r["token"] for r in useful.select("token").collect()]
    if not vocabulary:
        return math.log(share / (1 - share)), {}
    vectorizer = CountVectorizerModel.from_vocabulary(vocabulary, "tokens", "features").setBinary(True)
    train = vectorizer.transform(rows).select("features", "label").persist()
    first = LogisticRegression(regParam=l1, elasticNetParam=1.0, maxIter=40, standardization=False).fit(train)
    chosen = [int(k) for k in first.coefficients.toArray().nonzero()[0]]
    if not chosen:
        train.unpersist()
        return float(first.intercept), {}
    sliced = VectorSlicer(inputCol="features", outputCol="chosen", indices=chosen).transform(train).select("chosen", "label").persist()
    second = LogisticRegression(featuresCol="chosen", regParam=l2, elasticNetParam=0.0, maxIter=60, standardization=False).fit(sliced)
    train.unpersist()
    sliced.unpersist()
    return float(second.intercept), {vocabulary[k]: float(w) for k, w in zip(chosen, second.coefficients.toArray(), strict=True)}


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[np.ndarray, Lexicon, float, dict[str, float]]:
    """Language model and known words of all texts; intercept and weights from about ``sample`` labelled rows that are not held out."""
    model = language_model(char_counts(docs, text_col))
    lexicon = known_words(word_counts(docs, text_col))
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    usable = usable.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    chosen = F.broadcast(bounded_sample(written(usable, "usable-labels"), "id", sample))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return model, lexicon, *fit(texts.join(chosen, "id"), model, lexicon)


def scorer(model: np.ndarray, lexicon: Lexicon | None, intercept: float, weights: dict[str, float]) -> Callable[[list[str]], list[tuple[float, str]]]:
    """texts -> score and restored text of each."""
    deobfuscate = batch_restorer(model, lexicon=lexicon)
    known = lru_cache(50_000)(lambda word: tuple(f for f in features(word) if f in weights))
    heads = frozenset(f[:4] for f in weights)  # of a word and of its beginnings the first four letters are the same

    def score(texts: list[str]) -> list[tuple[float, str]]:
        out = []
        for restored in deobfuscate(texts):
            found = {f for w in distinct_words(restored.lower()) if w[:4] in heads for f in known(w)}
            z = intercept + math.fsum(weights[f] for f in found)
            out.append((1 / (1 + math.exp(-max(-500.0, min(500.0, z)))), restored))
        return out

    return score


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.7,
    sample: int = 20_000,
    with_text: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted, restored.

    Labels are learned from at most about ``sample`` labelled ids, chosen by
    hash, never from held-out ones (crc32 of the id as text, modulo 3, is 1).
    Of an id labelled twice the higher label counts; labels that are null are
    not used. Null texts score as empty ones, whose score is that of a text
    without known words. Without any labels every score is 0.5. Repeated rows
    score alike. Further columns are ignored; an empty table gives an empty
    result. ``restored`` is the text that was scored, null unless ``with_text``.
    Only words that the corpus holds replace what looks disguised; a disguise
    of a word that it holds nowhere in plain letters stays as it is.
    """
    model, lexicon, intercept, weights = learn(docs, labels, id_col, text_col, label_col, sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model, lexicon, intercept, weights)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                found = [x for part in in_parts(batch.column(1).to_pylist()) for x in score(part)]
                restored = [r if with_text else None for _, r in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array(restored, pa.string())], ["id", "score", "restored"]
                )

    out = in_small_batches(texts, scored, f"id {texts.schema['id'].dataType.simpleString()}, score double, restored string")
    return out.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "restored",
    )


def without_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, sample: int = 20_000
) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns, in one pass and no shuffle."""
    model, lexicon, intercept, weights = learn(docs, labels, id_col, text_col, label_col, sample)
    at_text = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model, lexicon, intercept, weights)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                yield batch.filter(pa.array([x < threshold for part in in_parts(batch.column(at_text).to_pylist()) for x, _ in score(part)], pa.bool_()))

    return in_small_batches(docs, kept, docs.schema)
