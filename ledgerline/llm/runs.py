"""Periodic runs of words, found by online dyadic square catching.

A run is a stretch of consecutive words with smallest period q (words q apart are identical),
at least ``exponent`` * q and ``shortest`` words long, that no neighbouring word extends.

The words of a text are appended one by one. Words up to 3 apart are compared directly. For
every power of two L from 4 on, each completed block of L words gets a catcher, which looks for a copy of its block L to 2L - 1 words further on. Each
appended word advances the catchers' suffix comparisons: the longest suffix of the text that
starts the block, kept by the block's failure function, so a word is never compared anew. A
copy at distance q means that words q apart agree over the block; the stretch on which they do
is widened to the left at once and to the right with every further word. A stretch of 2q words
is a square, and all squares of one stretch are thereby merged; when it ends it is reported as
a run if it is long enough and no divisor of q is a period of it.

* A run of at least four periods holds, among its first 2L - 1 words, a block of the largest L
  <= q and that block's copy at distance q, so none is missed (``exponent`` is at least 4).
* A block that is itself a repetition (period d <= L / 2) has many copies in a repetition of
  d. It is widened by the words up to the first that breaks d: in a run of period q that word
  comes again at distance q. Copies of the widened block lie over L / 2 apart, so a catcher
  finds at most a few distances, and the work for n words is O(n log n) whatever the words.

A word is kept unless a run contains it after that run's first q words (``collapse``).

Texts are independent, so nothing is shuffled; a task holds one Arrow slice of texts and the
words of one text.

Defined results: a null text is empty. An empty text or table has no runs. Repeated rows and
ids are answered each on its own. The result's own columns are ``runs`` and ``collapsed``; a
carried column of either name is an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import carried, map_arrow

# Shortest run in words, least length in periods.
SHORTEST = 6
EXPONENT = 4
#: Words of the smallest block that gets a catcher.
SMALLEST = 4
#: texts that a task handles at a time
SLICE = 256


class _Catcher:
    """A block of ``size`` words from ``start``; its first ``matched`` words end the text so far."""

    __slots__ = ("start", "size", "matched", "fail", "target", "period", "broken")

    def __init__(self, start: int, size: int):
        self.start, self.size = start, size
        self.matched, self.fail = 0, [0, 0]
        self.target = 0  # words of the widened block; 0 until known
        self.period, self.broken = 0, start + size

    def shorter(self, words: Sequence, matched: int) -> int:
        """The next shorter prefix of the block that ends its first ``matched`` words."""
        fail, start = self.fail, self.start
        while len(fail) <= matched:
            i, k = len(fail) - 1, fail[-1]
            word = words[start + i]
            while k and words[start + k] != word:
                k = fail[k]
            fail.append(k + 1 if words[start + k] == word else 0)
        return fail[matched]

    def widened(self, words: Sequence, now: int) -> int:
        """Words of the block with those up to the first that breaks its repetition; 0 if none has by ``now``."""
        if not self.target:
            if not self.period:
                self.period = self.size - self.shorter(words, self.size)
                if 2 * self.period > self.size:
                    self.target = self.size
                    return self.target
            at, period = self.broken, self.period
            while at <= now and words[at] == words[at - period]:
                at += 1
            self.broken = at
            if at <= now:
                self.target = at + 1 - self.start
        return self.target


class SquareCatcher:
    """Runs of the words appended so far (any hashable ones)."""

    def __init__(self, shortest: int = SHORTEST, exponent: int = EXPONENT):
        if exponent < 4:
            raise ValueError("catchers are complete for runs of at least 4 periods")
        self.shortest, self.exponent = shortest, exponent
        self.words: list = []
        self.open: dict[int, int] = {}  # distance -> first word of the stretch that still goes on
        self.found: list[tuple[int, int, int]] = []
        self.waiting: dict[tuple, list] = {}  # first two words of a block -> its start and size, or its catcher
        self.active: list[_Catcher] = []

    def extend(self, words: Sequence) -> None:
        """Appends the words one after another."""
        text, open_, waiting = self.words, self.open, self.waiting
        for word in words:
            now = len(text)
            text.append(word)
            if open_:
                for distance in [q for q in open_ if text[now - q] != word]:
                    self._close(distance, now)
            # at distances under SMALLEST the word itself is block enough
            if now > 2:
                if word == text[now - 1] and 1 not in open_:
                    open_[1] = now - 1
                if word == text[now - 2] and 2 not in open_:
                    open_[2] = now - 2
                if word == text[now - 3] and 3 not in open_:
                    open_[3] = now - 3
            elif now:
                for distance in range(1, now + 1):
                    if word == text[now - distance] and distance not in open_:
                        open_[distance] = now - distance
            if self.active:
                self._advance(now, word)
            if now:
                pair = (text[now - 1], word)
                if pair in waiting:
                    self._wake(pair, now)
            # the blocks that this word completes
            done, size = now + 1, SMALLEST
            while not done & (size - 1):
                start = done - size
                pair = (text[start], text[start + 1])
                if pair in waiting:
                    waiting[pair].append((start, size))
                else:
                    waiting[pair] = [(start, size)]
                size += size

    def _advance(self, now: int, word) -> None:
        text, left = self.words, []
        for c in self.active:
            while c.matched and text[c.start + c.matched] != word:
                c.matched = c.shorter(text, c.matched)
            if text[c.start + c.matched] == word:
                c.matched += 1
                if c.matched >= c.size:
                    self._caught(c, now)
            # a copy starts at most 2 size - 1 words on, and a widened block has under 3 size words
            if now + 1 - c.matched < c.start + 2 * c.size and c.matched < 3 * c.size:
                if c.matched:
                    left.append(c)
                else:
                    self.waiting.setdefault((text[c.start], text[c.start + 1]), []).append(c)
        self.active = left

    def _wake(self, pair: tuple, now: int) -> None:
        """Makes the catchers active whose block starts with the two last words."""
        stay = []
        for c in self.waiting.pop(pair):
            start, size = c if c.__class__ is tuple else (c.start, c.size)
            if now - 1 < start + size:
                stay.append(c)
            elif now - 1 < start + 2 * size:
                if c.__class__ is tuple:
                    c = _Catcher(start, size)
                c.matched = 2
                self.active.append(c)
        if stay:
            self.waiting[pair] = stay

    def _caught(self, c: _Catcher, now: int) -> None:
        if c.matched != c.widened(self.words, now):
            return
        distance = now + 1 - c.matched - c.start
        c.matched = c.shorter(self.words, c.matched)
        if not c.size <= distance < 2 * c.size or distance in self.open:
            return
        if any(distance % q == 0 and begin <= c.start for q, begin in self.open.items()):
            return  # inside a stretch of a divisor of it
        text, begin = self.words, c.start
        while begin and text[begin - 1] == text[begin - 1 + distance]:
            begin -= 1
        self.open[distance] = begin

    def _close(self, distance: int, end: int) -> None:
        begin = self.open.pop(distance)
        if end - begin >= max(self.shortest, self.exponent * distance):
            self.found.append((begin, end - begin, distance))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs, with those that go on to the last word, in order."""
        end = len(self.words)
        going = [(b, end - b, q) for q, b in self.open.items() if end - b >= max(self.shortest, self.exponent * q)]
        by_period: dict[int, list[tuple[int, int]]] = {}
        out = []
        for begin, n, q in sorted({*self.found, *going}, key=lambda r: r[2]):
            divisors = (d for d in by_period if q % d == 0)
            if not any(b <= begin and begin + n <= b + m for d in divisors for b, m in by_period[d]):
                out.append((begin, n, q))
                by_period.setdefault(q, []).append((begin, n))
        return sorted(out, key=lambda r: (r[0], r[2]))


def find_runs(words: Sequence, shortest: int = SHORTEST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, ordered by start and period."""
    catcher = SquareCatcher(shortest, exponent)
    catcher.extend(words)
    return catcher.runs()


def collapse(words: Sequence, runs: Sequence[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    gone = bytearray(len(words))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\x01" * (length - period)
    return [w for w, g in zip(words, gone) if not g] if runs else list(words)


def periodic_runs(
    docs: DataFrame,
    text_col: str = "text",
    carry: Sequence[str] = ("doc_id",),
    shortest: int = SHORTEST,
    exponent: int = EXPONENT,
) -> DataFrame:
    """One row per row of ``docs``: the ``carry`` columns, ``runs`` (array of ``start``,
    ``length``, ``period``, by start and period; numbered in words from 0) and ``collapsed``
    (the kept words, joined by one space)."""
    rows, schema = carried(docs, carry, text_col, "runs array<struct<start: long, length: long, period: long>>, collapsed string")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                found, texts = [], []
                for text in part.column(part.num_columns - 1).to_pylist():
                    words = (text or "").encode().split()
                    runs = find_runs(words, shortest, exponent)
                    found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                    texts.append(b" ".join(collapse(words, runs)).decode())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, kind), pa.array(texts)], names=schema.names)

    return map_arrow(rows, run, schema)
