"""Language identification in two steps: the family first, then its closely related languages.

A text becomes the hashed counts of its byte 1- to 3-grams (A-Z lower-cased). A linear
softmax names the language family; inside the family, a linear support vector machine for
each pair of languages casts a vote, and the most votes (then the largest margins) win.

Training takes at most ``SAMPLE_ROWS`` labelled rows, spread evenly over the languages and
chosen by a hash of the id; they are never held-out rows. Families come from ``FAMILIES``;
a language that it lacks is a family of its own.

Defined results: a null text or one without a letter is ``und`` with score 0; null labels
are not learned from; without any labelled row every text is ``und``. Texts are read
whole. An empty table gives an empty result. The columns named in ``carry`` come along;
a result column wins over a carried one of its name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import ASCII_LOWER, carried, held_out, map_arrow

SAMPLE_ROWS = 3000
BUCKETS = 4096
UNKNOWN = "und"
# Language codes by family.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk tr uz",
    "semitic": "ar he mt",
    "indo_aryan": "bn gu hi mr ne pa ur",
    "sinitic": "yue zh",
}


def family(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), f"other:{code}")


#: bytes of a text that are counted at a time, which bounds the memory for a long text
CHUNK = 1 << 20


def features(text: str) -> np.ndarray:
    """Square roots of the hashed n-gram counts, scaled to length 1."""
    data = np.frombuffer(text.encode().translate(ASCII_LOWER), np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.float64)
    for i in range(0, len(data), CHUNK):
        old = min(i, 2)  # bytes of the chunk before, for the n-grams that span both
        b = data[i - old : i + CHUNK]
        pair = b[:-1] * 257 + b[1:]
        for grams in (b[old:], pair[old and 1 :], pair[:-1] * 257 + b[2:]):
            counts += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
    counts = np.sqrt(counts)
    return (counts / (np.linalg.norm(counts) or 1.0)).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _train_families(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 200, rate: float = 20.0) -> np.ndarray:
    """Softmax regression by gradient descent; the last row holds the biases."""
    w = np.zeros((x.shape[1] + 1, classes), np.float32)
    target = np.eye(classes, dtype=np.float32)[y] / np.bincount(y, minlength=classes)[y][:, None] / classes
    weight = target.sum(axis=1, keepdims=True)
    for _ in range(steps):
        wrong = weight * _softmax(x @ w[:-1] + w[-1]) - target
        w[:-1] -= rate * (x.T @ wrong + 1e-5 * w[:-1])
        w[-1] -= rate * wrong.sum(axis=0)
    return w


def _train_svm(x: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 5.0) -> np.ndarray:
    """Squared-hinge linear SVM (y is -1 or 1, classes weighted alike) by gradient descent; last: the bias.
    A step that makes the loss worse is taken back and the rate halved, so labels that no plane parts don't diverge."""
    w = np.zeros(x.shape[1] + 1, np.float32)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    best, least = w, np.inf
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ w[:-1] + w[-1]))
        loss = float((share * slack**2).sum() + 5e-5 * (w[:-1] ** 2).sum())
        if not loss <= least:
            w, rate = best.copy(), rate / 2
            continue
        best, least = w.copy(), loss
        g = -2 * share * slack * y
        w[:-1] -= rate * (x.T @ g + 1e-4 * w[:-1])
        w[-1] -= rate * g.sum()
    return best


@dataclass
class Model:
    families: list[str]
    members: list[list[str]]  # languages of each family
    family_weights: np.ndarray
    pair_weights: list[np.ndarray]  # of each family: one column per pair of its languages

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        x = features(text)
        shares = _softmax(x @ self.family_weights[:-1] + self.family_weights[-1])
        k = int(shares.argmax())
        langs = self.members[k]
        if len(langs) == 1:
            return langs[0], float(shares[k])
        margins = x @ self.pair_weights[k][:-1] + self.pair_weights[k][-1]
        votes, sums, least = np.zeros(len(langs)), np.zeros(len(langs)), np.full(len(langs), np.inf)
        for (i, j), m in zip(combinations(range(len(langs)), 2), margins):
            votes[i if m > 0 else j] += 1
            for a, own in ((i, m), (j, -m)):
                sums[a] += own
                least[a] = min(least[a], own)
        best = max(range(len(langs)), key=lambda a: (votes[a], sums[a]))
        return langs[best], float(shares[k] / (1 + np.exp(-4 * np.clip(least[best], -20, 20))))


def fit(x: np.ndarray, langs: Sequence[str]) -> Model:
    """The model of feature rows ``x`` with the languages ``langs``."""
    names = sorted(set(langs))
    families = sorted({family(n) for n in names})
    members = [[n for n in names if family(n) == f] for f in families]
    lang = np.array(langs)
    weights = _train_families(x, np.array([families.index(family(n)) for n in langs], int), len(families)) if names else np.zeros((1, 0))
    pairs = []
    for group in members:
        columns = []
        for a, b in combinations(group, 2):
            at = (lang == a) | (lang == b)
            columns.append(_train_svm(x[at], np.where(lang[at] == a, 1, -1).astype(np.float32)))
        pairs.append(np.stack(columns, axis=1) if columns else np.zeros((BUCKETS + 1, 0), np.float32))
    return Model(families, members, weights, pairs)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from labelled rows that are not held out. The sample's features, two bytes a
    bucket, come to the driver: at most ``sample_rows`` of them."""
    labelled = docs.select(id_col, text_col, F.col(lang_col).alias("__lang")).where(
        F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)
    )
    sizes = labelled.groupBy("__lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.orderBy(F.desc("n"), "__lang").limit(sample_rows).collect()  # rarer languages than rows in the sample can't be learned
    if not sizes:
        return fit(np.zeros((0, BUCKETS), np.float32), [])
    each = sample_rows / len(sizes)
    share = F.create_map(*[F.lit(v) for r in sizes for v in (r["__lang"], min(1.0, each / r["n"]))])
    chosen = labelled.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < F.lit(1 << 20) * share[F.col("__lang")])

    def to_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t).astype(np.float16).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], names=["x", "lang"])

    rows = map_arrow(chosen.select(text_col, "__lang"), to_features, "x binary, lang string").limit(2 * sample_rows).toArrow()
    rows = rows.sort_by([("lang", "ascending"), ("x", "ascending")])  # the same sums in every run
    x = np.stack([np.frombuffer(b, np.float16) for b in rows["x"].to_pylist()]).astype(np.float32) if len(rows) else np.zeros((0, BUCKETS), np.float32)
    return fit(x, rows["lang"].to_pylist())


def identify(docs: DataFrame, model: Model, text_col: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the columns named in ``carry``, ``lang_pred`` and ``score`` (0 to 1)."""
    rows, schema = carried(docs, carry, text_col, "lang_pred string, score double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS and the languages

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.columns[-1].to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=schema.names)

    return map_arrow(rows, predicted, schema)
