"""Secret scanning: wide candidate patterns, then a random forest that removes false positives.

``candidates`` finds every run of 12 or more key-like characters with a digit (a run ends at
``=`` but for the padding of base64), every quoted value after ``:`` or ``=``, every value of
whatever length, quoted or not, that is assigned to a name that speaks of a credential, and
what follows ``Bearer``. Values that open a bracket are no values. Each is described by its
length, character classes and entropy, by the character transitions of ordinary text, by how
much of it dictionary words cover, by its path and by the words around it, but not by the
name it is assigned to, from which the labels come. Spark ML trains the forest on at most
``SAMPLE_FINDINGS`` labelled findings (chosen by a hash of the id, none of them held out)
and scores all candidates.

Dictionary and character transitions are counted over all documents without their candidates
(``language_of``). The dictionary has every word of 4 to ``LONGEST_WORD`` letters that is at
least ``LEAST_SHARE`` of all such words, the transitions every pair of letters that is at
least that share of all pairs: so at most 1 / ``LEAST_SHARE`` of each are broadcast.

Labels are the caller's: a column ``label`` (1 secret, 0 not, null unknown) on the
findings. ``label_by_rule`` is the rule that the registered query labels by: the value is
assigned to a name that speaks of a credential. What only such a name makes a candidate is
labelled too but not learned from, as it has no like with another name.

Defined results: a null or empty text has no findings; positions are code points; repeated rows give
repeated findings; a null path is an empty one. With labels of only one kind, or none, every
probability is the share of label 1 (0.5 without labels). Texts are scanned whole. An
empty table gives an empty result. Further columns are carried by name.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import held_out, map_arrow, written

SAMPLE_FINDINGS = 8000
TREES, DEPTH, SEED = 24, 6, 11
AROUND = 60
# Least share of a word among the words of 4 to LONGEST_WORD letters, and of a pair among the pairs.
LEAST_SHARE = 2e-6
LONGEST_WORD = 64
TASK_WORDS = 100_000
PATH_BUCKETS, WORD_BUCKETS = 4, 12
THRESHOLD = 0.5

RUN = re.compile(r"[A-Za-z0-9+/_\-]{12,}(?:={1,2}(?![A-Za-z0-9+/=_\-\"']))?")
QUOTED = re.compile(r"[:=]\s{0,3}([\"'])([^\"'\s]{8,400})\1")
WORDS = re.compile(r"[^\W\d_]+")
ORDINARY = re.compile(r"(?<![^\W_])[^\W\d_]++(?!\d)")  # letters beside a digit are no word
# Words that speak of a credential, and words that speak of something else.
CREDENTIAL = frozenset("token secret password passwd pwd apikey key auth credential credentials bearer private access authorization".split())
HARMLESS = frozenset("sha md commit revision checksum digest hash uuid guid example sample test dummy fingerprint version id ref".split())
NAME = r"([A-Za-z][A-Za-z0-9_.\-]{0,60})[\"']?\]?\s{0,8}"  # quoted keys and subscripts too
SIGN = r"(?::=|=>|={1,3}|(?<!:):(?!:))"
SCHEME = r"(?:(?i:bearer|basic)\s{1,3})"
ASSIGNED = re.compile(rf"(?:{NAME}{SIGN}\s{{0,8}}[\"']?{SCHEME}?|(?<![A-Za-z0-9])((?i:bearer))\s{{1,3}})\Z")
NAMED, SIGNS = re.compile(NAME + r"\Z"), re.compile(SIGN)
VALUE = re.compile(
    rf"[ \t]{{0,8}}(?:([\"']){SCHEME}?((?:(?!\1)[^\n\\]|\\.)+)\1|[\"']?{SCHEME}?((?![{{\[(\"'])(?:(?!=[\"'])\S)+))"
)
BEARER = re.compile(r"(?<![A-Za-z0-9])(?i:bearer)[ \t]{1,3}([A-Za-z0-9\-._~+/]+=*)")
NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
TEST_PATH = re.compile(r"test|example|sample|doc|vendor|mock", re.I)


def _credential(name: str) -> bool:
    return any(w.lower() in CREDENTIAL for w in NAME_WORD.findall(name))


def speaks_of_credential(before: str) -> bool:
    """Whether the text before a candidate assigns it to a name that speaks of a credential."""
    m = ASSIGNED.search(before)
    return bool(m) and _credential(m[1] or m[2])


def _bare_end(value: str) -> int:
    """Length of an unquoted value without the signs that close what is around it."""
    n = len(value)
    extra = {close: value.count(close) - value.count(open_) for open_, close in ("()", "[]", "{}")}
    while n and (value[n - 1] in ",;\"'" or extra.get(value[n - 1], 0) > 0):
        n -= 1
        extra[value[n]] = extra.get(value[n], 0) - 1
    return n


def _named(text: str) -> list[tuple[int, int]]:
    """Spans of the values assigned to names that speak of a credential, or after ``Bearer``."""
    out, at = [], 0
    for sign in SIGNS.finditer(text):
        if sign.start() < at:  # inside the value before
            continue
        name = NAMED.search(text, max(0, sign.start() - AROUND), sign.start())
        value = VALUE.match(text, sign.end()) if name and _credential(name[1]) else None
        if value and value[2]:
            out.append(value.span(2))
        elif value:
            start = value.start(3)
            out.append((start, start + _bare_end(value[3])))
        if value:
            at = out[-1][1]
    for m in BEARER.finditer(text):
        if any(map(str.isdigit, m[1])) or text[max(0, m.start() - 1) : m.start()] in ("'", '"'):
            out.append(m.span(1))
    return [(a, b) for a, b in out if b > a]


def _spans(text: str | None) -> list[tuple[int, int, bool]]:
    """Spans of the candidates in order and without overlaps, and whether only a name makes them candidates."""
    text = text or ""
    wide = {m.span(2) for m in QUOTED.finditer(text)}
    for m in RUN.finditer(text):
        if any(map(str.isdigit, m[0])):
            padded = m[0][-1] != "=" or len(m[0]) % 4 == 0
            wide.add((m.start(), m.end() if padded else m.start() + len(m[0].rstrip("="))))
    first = lambda s: (s[0], -s[1])
    named: list[tuple[int, int]] = []
    for span in sorted(set(_named(text)), key=first):
        if not named or span[0] >= named[-1][1]:
            named.append(span)
    # a named value goes before what overlaps it
    out, at, last = [(*span, span not in wide) for span in named], 0, 0
    for start, end in sorted(wide.difference(named), key=first):
        while at < len(named) and named[at][1] <= start:
            at += 1
        if start >= last and (at == len(named) or named[at][0] >= end):
            out.append((start, end, False))
            last = end
    return sorted(out)


def find(text: str | None) -> list[tuple[int, int]]:
    """Spans of the candidates, in order and without overlaps."""
    return [(start, end) for start, end, _ in _spans(text)]


def candidates(docs: DataFrame, text_col: str = "text", path_col: str | None = "source", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per candidate: the columns in ``carry``, start, end, candidate, before, after, path, by_name."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(*carry, path.alias("__path"), F.col(text_col).alias("__text"))
    schema = rows.schema[:-2]
    for name in ("start", "end"):
        schema = schema.add(name, "long")
    for name in ("candidate", "before", "after", "path"):
        schema = schema.add(name, "string")
    schema = schema.add("by_name", "boolean")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, (path, text) in enumerate(zip(batch.column(len(carry)).to_pylist(), batch.column(len(carry) + 1).to_pylist())):
                for a, b, by_name in _spans(text):
                    at.append(i)
                    out.append((a, b, text[a:b], text[max(0, a - AROUND) : a], text[b : b + AROUND], path, by_name))
            if out:
                kept = [c.take(pa.array(at, pa.int64())) for c in batch.columns[: len(carry)]]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, k) for v, k in zip(zip(*out), kinds))], names=schema.names)

    return map_arrow(rows, scan, schema)


def label_by_rule(findings: DataFrame) -> DataFrame:
    """``findings`` with ``label``: 1 where the name before an assignment speaks of a credential,
    else 0; and ``learn``: false where only that name makes it a candidate."""
    names = findings.columns
    at = names.index("before")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [int(speaks_of_credential(x)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*names, "label"])

    schema = findings.select("*").schema.add("label", "integer")
    return map_arrow(findings, label, schema).withColumn("learn", ~F.col("by_name"))


def _ordinary(text: str | None) -> list[str]:
    """The words of a text outside its candidates."""
    text, at, parts = text or "", 0, []
    for start, end in find(text):
        parts.append(text[at:start])
        at = end
    return ORDINARY.findall(" ".join([*parts, text[at:]]).lower())


def _pairs(words: Counter) -> Counter:
    pairs: Counter = Counter()
    for w, n in words.items():
        for p in map("".join, zip(w, w[1:])):
            pairs[p] += n
    return pairs


def _in_dictionary(word: str) -> bool:
    return 4 <= len(word) <= LONGEST_WORD


@dataclass
class Language:
    """Ordinary text: its words, and its character transitions."""

    words: frozenset[str]
    transitions: dict[str, float]
    unseen: float

    @classmethod
    def of(cls, texts: Sequence[str]) -> Language:
        words = Counter(w for text in texts for w in _ordinary(text))
        pairs = _pairs(words)
        words = Counter({w: n for w, n in words.items() if _in_dictionary(w)})
        least = LEAST_SHARE * words.total()
        return cls.counted((w for w, n in words.items() if n >= least), pairs, pairs.total())

    @classmethod
    def counted(cls, words: Iterable[str], pairs: Mapping[str, int], total: int) -> Language:
        """From the dictionary, the counts of pairs and the number of all pairs."""
        total += 1
        known = {k: math.log(n / total) for k, n in pairs.items() if n >= LEAST_SHARE * total}
        return cls(frozenset(words), known, math.log(0.5 * max(LEAST_SHARE, 1 / total)))

    @cached_property
    def lengths(self) -> dict[str, list[int]]:
        """Lengths of the words by their first four letters, longest first."""
        found: dict[str, set[int]] = {}
        for w in self.words:
            found.setdefault(w[:4], set()).add(len(w))
        return {k: sorted(v, reverse=True) for k, v in found.items()}

    def transition(self, text: str) -> float:
        """Mean log share of the candidate's character pairs."""
        pairs = list(map("".join, zip(text, text[1:])))
        return sum(self.transitions.get(p, self.unseen) for p in pairs) / len(pairs) if pairs else 0.0

    def coverage(self, text: str) -> float:
        """Share of the characters that dictionary words cover, longest word first from the left."""
        at = covered = 0
        while at < len(text):
            size = next((n for n in self.lengths.get(text[at : at + 4], ()) if text[at : at + n] in self.words), 0)
            covered += size
            at += size or 1
        return covered / len(text)


def language_of(texts: DataFrame, text_col: str = "text") -> Language:
    """The language of all rows of ``texts``, counted in tasks and added up in a shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def counts() -> pa.RecordBatch:
            rows = [(False, w, n) for w, n in words.items() if _in_dictionary(w)]
            rows += [(True, p, n) for p, n in _pairs(words).items()]
            columns = zip(*rows) if rows else ((), (), ())
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, (pa.bool_(), pa.string(), pa.int64()))], names=["pair", "key", "n"])

        for batch in batches:
            for text in batch.column(0):
                words.update(_ordinary(text.as_py()))
                if len(words) > TASK_WORDS:
                    yield counts()
        yield counts()

    rows = map_arrow(texts.select(F.col(text_col).alias("text")), count, "pair boolean, key string, n long")
    table = written(rows.groupBy("pair", "key").agg(F.sum("n").alias("n")), "secret-words")
    totals = {r["pair"]: r["n"] for r in table.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    least = F.when(F.col("pair"), LEAST_SHARE * totals.get(True, 0)).otherwise(LEAST_SHARE * totals.get(False, 0))
    found = table.where(F.col("n") >= least).toArrow().to_pydict()  # at most 2 / LEAST_SHARE rows
    kept = list(zip(found["pair"], found["key"], found["n"]))
    return Language.counted((k for pair, k, _ in kept if not pair), {k: n for pair, k, n in kept if pair}, totals.get(True, 0))


def _bucket(word: str, n: int) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=4).digest(), "big") % n


def describe(candidate: str, before: str, after: str, path: str, language: Language) -> list[float]:
    """The numbers that the forest sees: nothing of what ``label_by_rule`` reads, so the words
    around are those before the assigned name."""
    n, low = len(candidate), candidate.lower()
    counts = Counter(candidate)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    share = lambda test: sum(c for ch, c in counts.items() if test(ch)) / n
    named = ASSIGNED.search(before)
    near = [w.lower() for w in WORDS.findall(before[: named.start()] if named else before)[-3:] + WORDS.findall(after)[:3]]
    numbers = [
        n, entropy, len(counts) / n, share(str.isdigit), share(str.isupper), share(str.islower),
        share(lambda ch: ch in "+/=_-"), float(all(ch in "0123456789abcdef" for ch in low)), float(candidate.isdigit()),
        language.transition(low), language.coverage(low),
        float(before.rstrip("\"' ").endswith(("=", ":"))), float(before.endswith(("'", '"'))),
        float(any(w in CREDENTIAL for w in near)), float(any(w in HARMLESS for w in near)),
        float(bool(TEST_PATH.search(path))),
    ]
    folder, around = [0.0] * PATH_BUCKETS, [0.0] * WORD_BUCKETS
    for w in re.findall(r"\w+", path.lower()):
        folder[_bucket(w, PATH_BUCKETS)] += 1
    for w in near:
        around[_bucket(w, WORD_BUCKETS)] += 1
    return [*numbers, *folder, *around]


def described(findings: DataFrame, language: Language) -> DataFrame:
    """``findings`` with ``features``."""
    shared = findings.sparkSession.sparkContext.broadcast(language)  # at most 1 / LEAST_SHARE words, and pairs
    names = findings.columns
    at = [names.index(c) for c in ("candidate", "before", "after", "path")]

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [describe(*row, shared.value) for row in zip(*(batch.column(i).to_pylist() for i in at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*names, "features"])

    schema = findings.select("*").schema.add("features", T.ArrayType(T.DoubleType()))
    return map_arrow(findings, numbers, schema).withColumn("features", array_to_vector("features"))


def scan(
    findings: DataFrame,
    id_col: str = "doc_id",
    sample_findings: int = SAMPLE_FINDINGS,
    threshold: float = THRESHOLD,
    docs: DataFrame | None = None,
    text_col: str = "text",
) -> DataFrame:
    """``findings`` (a written table with ``label``) without the texts: the id, ``start``, ``end``,
    ``candidate_sha256``, ``label``, ``probability`` and ``is_secret``. Ordinary text is that of
    ``docs``, or without them what stands around all findings."""
    known = findings.where(F.col("label").isNotNull() & ~held_out(id_col))
    if "learn" in findings.columns:
        known = known.where("learn")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        # nothing to learn: one kind of label
        probability = F.lit(float(sizes.get(1, 0) / total) if total else 0.5)
        scored = findings.withColumn("probability", probability)
    else:
        half = {y: min(n, max(sample_findings // 2, sample_findings - sizes.get(1 - y, 0))) for y, n in sizes.items()}
        share = F.create_map(*[F.lit(v) for y, n in sizes.items() for v in (y, half[y] / n)])
        place = F.pmod(F.xxhash64(id_col, "start"), F.lit(1 << 20))
        sample = written(known.where(place < F.lit(1 << 20) * share[F.col("label")]).limit(2 * sample_findings), "secret-sample")
        if docs is None:
            docs, text_col = findings.select(F.concat_ws(" ", "before", "after").alias("text")), "text"
        language = language_of(docs, text_col)
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features", probabilityCol="p")
        model = forest.fit(written(described(sample, language).select("features", F.col("label").cast("double")), "secret-train"))
        scored = model.transform(described(findings, language)).withColumn("probability", vector_to_array("p")[1])
    return scored.select(
        id_col, "start", "end", F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), "label",
        "probability", (F.col("probability") >= threshold).alias("is_secret"),
    )
