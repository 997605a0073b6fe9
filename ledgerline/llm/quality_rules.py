"""Quality rules as a short-circuit cascade, ordered by rejections per cost.

Each rule is a predicate over a document's measures; a document is kept when no rule
rejects it. ``rule_order`` runs every rule on a sample of at most ``SAMPLE_ROWS`` rows,
timing it and counting what it rejects, and orders the rules by rejections per second:
cheap and selective rules run first, and a rejected document never reaches the rest. A
measure is computed when first asked for and kept for the next rule. The order changes
the time, never the verdict.

Defined results: a null or empty text has no words, so the base rule rejects it. Texts are
measured whole. An empty table gives an empty result. ``filter_quality``
carries all columns, whatever their names; ``judge`` those named in ``carry``, and a result
column wins over a carried one of its name.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import SPACES, carried, map_arrow

#: rows on which cost and selectivity are estimated
SAMPLE_ROWS = 2000
SAMPLE_PARTS = 40
# The symbols that count, and the limits of the rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50


class Measures:
    """Counts of one text, each computed on first use."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        # bytes.split() splits at exactly the six white-space characters of a word's definition
        return self.text.encode().split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_exclaims(self) -> int:
        return self.text.count("!")

    @cached_property
    def lines(self) -> list[str]:
        """The lines that have a word."""
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_lines(self) -> int:
        return len(self.lines)

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a 3-word window that is found at least twice."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        found = Counter(windows)
        covered, end = 0, 0  # end: words before it are counted
        for i, window in enumerate(windows):
            if found[window] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
        return covered


# name -> whether the rule rejects the document; whole numbers only, so SQL agrees to the last row
BASE_RULES: dict[str, Callable[[Measures], bool]] = {
    "too_few_words": lambda m: m.n_words < MIN_WORDS,
    "repeated_windows": lambda m: 100 * m.n_repeat_words > 50 * m.n_words,
}
RULES: dict[str, Callable[[Measures], bool]] = BASE_RULES | {
    "symbols": lambda m: 10 * m.n_symbols > m.n_words,
    "exclamations": lambda m: 4 * m.n_exclaims > m.n_words,
    "word_length": lambda m: not 2 * m.n_words <= m.word_chars <= 20 * m.n_words,
    "duplicate_lines": lambda m: 10 * m.n_dup_lines > 3 * m.n_lines,
}
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_order(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of RULES by rejections per second on a sample, best first.

    The sample is the first rows of evenly spaced partitions, so nothing is shuffled; the rows
    of the others are dropped right after the scan and don't reach Python. A rule's time includes
    the measures it asks for. A few sums per rule come back."""
    parts = max(1, docs.rdd.getNumPartitions())
    used = min(parts, SAMPLE_PARTS)
    each, step = -(-sample_rows // used), parts / used
    chosen = {int(i * step) for i in range(used)}

    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0)
        left = each
        for batch in batches:
            texts = batch.column(0).slice(0, left).to_pylist()
            left -= len(texts)
            for text in texts:
                for name, rejects in RULES.items():
                    began = time.perf_counter()
                    rejected[name] += rejects(Measures(text))
                    spent[name] += time.perf_counter() - began
            if not left:
                break  # the rest of the partition is not asked for
        yield pa.RecordBatch.from_pydict(
            {"rule": list(RULES), "seconds": list(spent.values()), "rejected": list(rejected.values())}
        )

    rows = docs.select(F.col(text_col).alias("__t")).where(F.spark_partition_id().isin(*chosen))
    sums = map_arrow(rows, trial, "rule string, seconds double, rejected long").groupBy("rule")
    found = {r.rule: (r.s, r.n) for r in sums.agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("n")).collect()}
    rate = {name: n / max(s, 1e-9) for name, (s, n) in found.items()}
    return sorted(RULES, key=lambda name: (-rate.get(name, 0.0), list(RULES).index(name)))


def passes(m: Measures, order: Sequence[str]) -> bool:
    """Runs the rules in ``order`` up to the first that rejects."""
    return not any(RULES[name](m) for name in order)


def judge(docs: DataFrame, text_col: str = "text", order: Sequence[str] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: the columns named in ``carry``, REPORTED measures,
    ``base_failed`` and ``kept``. The cascade decides first; measures it did not need are
    computed for the report only."""
    order = list(order or rule_order(docs, text_col))
    made = "".join(f"{n} long, " for n in REPORTED) + "base_failed boolean, kept boolean"
    rows, schema = carried(docs, carry, text_col, made)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in (*REPORTED, "base_failed", "kept")}
            for text in batch.column(batch.num_columns - 1).to_pylist():
                m = Measures(text)
                out["kept"].append(passes(m, order))
                out["base_failed"].append(any(rejects(m) for rejects in BASE_RULES.values()))
                for n in REPORTED:
                    out[n].append(getattr(m, n))
            kept = {n: pa.array(v, pa.bool_() if n in ("base_failed", "kept") else pa.int64()) for n, v in out.items()}
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *kept.values()], names=schema.names)

    return map_arrow(rows, measured, schema)


def filter_quality(docs: DataFrame, text_col: str = "text", order: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    order = list(order or rule_order(docs, text_col))
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([passes(Measures(t), order) for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_arrow(docs, keep, docs.schema)
