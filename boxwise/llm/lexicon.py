"""Words that a corpus holds, as the judge of what a decoder makes of a span.

Counts cover every word of every document. A word is known if it makes up at
least a share of all words, so at most ``1 / share`` words are known whatever
the corpus: that bounds what is broadcast, and the rule is the same at every size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import in_parts, in_small_batches, written

WORDS = re.compile(r"[^\W\d_]+")
#: Of the first 128 code points those that are in no word.
NO_LETTERS = "".join(c for c in map(chr, range(128)) if not c.isalpha())
#: Longer runs of letters count among all words but are never known.
LONGEST = 64
#: Code points that are not seen (zero-width space, word joiner, byte order mark, soft hyphen).
UNSEEN = "\u200b\u2060\ufeff\u00ad"
REPEATS = re.compile(r"(.)\1+", re.S)


def distinct_words(text: str) -> set[str]:
    """The words of a text, each once. What stands between blanks is looked at once as well, and only searched if it is no word as it is."""
    parts = set(text.split())
    words = set(filter(str.isalpha, parts))
    words.update(WORDS.findall(" ".join(parts - words)))
    return words


def word_counts(docs: DataFrame, text_col: str, held: int = 200_000) -> DataFrame:
    """(word, n): how often each word occurs in all texts, in lower case; null for the words longer than ``LONGEST``.

    A task counts what stands between blanks, without the signs around it, and
    looks for words in each distinct part of these only. It hands on its counts
    whenever it holds ``held`` parts, so its memory does not grow with the corpus.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = no_parts = pa.table({"part": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        for batch in batches:
            for texts in in_parts(batch.column(0).to_pylist(), 2_000_000):
                parts = pc.utf8_split_whitespace(pa.array([t.lower() for t in texts], pa.string())).flatten()
                found = pc.ascii_trim(parts, characters=NO_LETTERS).value_counts()
                n = pa.concat_tables([n, pa.table({"part": found.field(0), "n": found.field(1)})])
                if n.num_rows >= held:
                    n = summed(n)
                if n.num_rows >= held:
                    yield from handed_on(n)
                    n = no_parts
        yield from handed_on(n)

    def summed(parts: pa.Table) -> pa.Table:
        """One row per part; by numpy, as loading Arrow's engine for tables takes some 45 MB of each worker."""
        found = parts["part"].combine_chunks().dictionary_encode()
        total = np.zeros(len(found.dictionary), np.int64)
        np.add.at(total, found.indices.to_numpy(), parts["n"].to_numpy())
        return pa.table({"part": found.dictionary, "n": total})

    def handed_on(parts: pa.Table) -> Iterator[pa.RecordBatch]:
        as_it_is = pc.and_(pc.ascii_is_alpha(parts["part"]), pc.less_equal(pc.binary_length(parts["part"]), LONGEST))
        words, rest = parts.filter(as_it_is), parts.filter(pc.invert(as_it_is))
        n: Counter[str | None] = Counter()
        for part, times in zip(rest["part"].to_pylist(), rest["n"].to_pylist(), strict=True):
            for word in WORDS.findall(part):
                n[word if len(word) <= LONGEST else None] += times
        for table in (words.rename_columns(["word", "n"]), pa.table({"word": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})):
            yield from table.combine_chunks().to_batches(20_000)

    return in_small_batches(docs.select(F.col(text_col).cast("string")), counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def known_words(counts: DataFrame, share: float = 2e-6) -> Lexicon:
    """The words that make up at least ``share`` of all words; at most ``1 / share`` of them reach the driver."""
    counts = written(counts, "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("word").isNotNull() & (F.col("n") >= share * total)).toArrow()
    return Lexicon(dict(zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True)), total)


class Lexicon:
    """Known words with their counts."""

    def __init__(self, counts: dict[str, int], total: int):
        self.counts, self.total = counts, total
        self.longest = max(map(len, counts), default=0)
        #: the most frequent known word (the least in ties) of those with repeated letters that are alike without repeats
        self.doubled: dict[str, str] = {}
        for word in sorted(counts, key=lambda w: (counts[w], [-ord(c) for c in w])):
            if (single := REPEATS.sub(r"\1", word)) != word:
                self.doubled[single] = word

    def count(self, word: str) -> int:
        """0 for single letters, which stand for themselves in every text."""
        return self.counts.get(word, 0) if len(word) > 1 else 0

    def respelled(self, found: str) -> str:
        """``found`` with each unknown word as the most frequent known word that differs from it in repeated letters alone."""

        def known(m: re.Match) -> str:
            if self.count(m[0]):
                return m[0]
            single = REPEATS.sub(r"\1", m[0])
            best = max((self.doubled.get(single, ""), single), key=self.count)
            return best if self.count(best) else m[0]

        return WORDS.sub(known, found)

    def accepts(self, span: str, found: str, typo: float) -> bool:
        """Whether ``found`` reads better than ``span`` does; both in lower case.

        The words that are new in ``found`` must be known and have three
        letters or more. Where the span is made of known words itself, the
        rarest of them must be rarer than the new ones by the factor
        ``exp(-typo)``, the price of the disguise.
        """
        before = WORDS.findall(span)
        new = [w for w in WORDS.findall(found) if w not in before]
        if not new or any(len(w) < 3 for w in new):
            return False
        least = min(map(self.count, new))
        if not least:
            return False
        if not before or any(c.isdigit() or c in UNSEEN for c in span):
            return True
        return min(map(self.count, before)) < least * math.exp(-typo)

    def split(self, letters: str, single: float = 14.0) -> str | None:
        """The likeliest division of letters into known words and single letters; None without a known word of three letters."""
        best: list[tuple[float, int]] = [(0.0, 0)]
        counts, total, longest = self.counts, self.total, self.longest
        for end in range(1, len(letters) + 1):
            options = [(best[end - 1][0] + single, end - 1)]
            for at in range(max(0, end - longest), end - 1):
                if (word := letters[at:end]) in counts and (n := counts[word]):
                    options.append((best[at][0] + math.log(total / n), at))
            best.append(min(options))
        words, end = [], len(letters)
        while end:
            words.append(letters[best[end][1] : end])
            end = best[end][1]
        return " ".join(reversed(words)) if any(len(w) > 2 for w in words) else None

    def split_run(self, span: str, found: str, share: float = 0.8) -> str | None:
        """The division of words that run together in ``found``, if known words of four letters that ``span`` does not show make up ``share`` of it."""
        letters = "".join(WORDS.findall(found))
        words = self.split(letters)
        if words is None:
            return None
        before = WORDS.findall(span)
        new = sum(len(w) for w in words.split() if len(w) > 3 and w not in before and self.count(w))
        return words if new >= share * len(letters) else None
