"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Each passage is encoded by a
linear layer over its features (hashed byte pairs, character classes, repeated words);
gated attention, ``softmax(w . (tanh(V h) * sigmoid(U h)))``, weighs the passages, and the
weighted passage representation is scored by a logistic unit. Only documents have labels:
encoder, attention and score are learned together from them.

Training takes at most ``SAMPLE_ROWS`` labelled documents, as many of each label as there
are, chosen by a hash of the id; held-out rows are never among them. The features come to the
driver in pieces of ``BUCKETS + 16`` half-precision numbers a passage: at most ``FIT_PASSAGES``
evenly spaced ones of a text, and at most twice as many texts as the sample has when ids repeat.

Defined results: a null or empty text is one empty passage and is scored like any other;
with labels of only one kind, or none, every score is the share of label 1 (0.5 without
labels). Texts are scored whole. An empty table gives an empty result. The columns named in
``carry`` come along; a result column wins over a carried one of its name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import carried, held_out, map_arrow

SAMPLE_ROWS = 2400
#: passages of one text that take part in the fit (scoring uses all)
FIT_PASSAGES = 512
PASSAGE_WORDS = 64
BUCKETS = 128
HIDDEN = 24
ATTENTION = 12
STEPS = 200
SEED = 7
THRESHOLD = 0.3

# Byte classes counted for a passage.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!", b"?", b"#*$%&|<>", b"\n", b"\"'()-:;/@=+_")
CLASS_OF = np.full(256, len(CLASSES), np.uint8)
for _i, _chars in enumerate(CLASSES):
    CLASS_OF[np.frombuffer(_chars, np.uint8)] = _i
CLASS_OF[128:] = len(CLASSES) + 1
N_CLASSES = len(CLASSES) + 2
WIDTH = BUCKETS + N_CLASSES + 4
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _repeated(values: np.ndarray) -> np.ndarray:
    """True where the value occurs more than once."""
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    out = np.zeros(len(values), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def features(text: str | None) -> np.ndarray:
    """One row of WIDTH numbers per passage of the text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    space = SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return np.zeros((1, WIDTH), np.float32)
    first = starts[::PASSAGE_WORDS]
    n = len(first)
    passage = np.zeros(len(data), np.int64)
    passage[first[1:]] = 1
    passage = np.cumsum(passage)
    sizes = np.bincount(passage, minlength=n)[:, None].astype(np.float32)
    out = np.empty((n, WIDTH), np.float32)
    pairs = (data[:-1].astype(np.uint32) * 257 + data[1:]) * np.uint32(2654435761) >> np.uint32(25)
    out[:, :BUCKETS] = np.sqrt(np.bincount(passage[:-1] * BUCKETS + pairs, minlength=n * BUCKETS).reshape(n, BUCKETS) / sizes)
    kinds = np.bincount(passage * N_CLASSES + CLASS_OF[data], minlength=n * N_CLASSES)
    out[:, BUCKETS : BUCKETS + N_CLASSES] = kinds.reshape(n, N_CLASSES) / sizes
    # a number for each word from its bytes and their places, and for each three words in a row
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(starts, np.diff(starts, append=len(data))).astype(np.uint64) if starts[0] == 0 else None
    if place is None:
        lead = np.zeros(starts[0], np.uint64)
        place = np.concatenate((lead, np.arange(starts[0], len(data), dtype=np.uint64) - np.repeat(starts, np.diff(starts, append=len(data))).astype(np.uint64)))
    mixed = np.where(space, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * (place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)))
    words = np.add.reduceat(mixed, starts)
    of = passage[starts]
    count = np.bincount(of, minlength=n).astype(np.float32)
    out[:, -4] = np.bincount(of, _repeated(words), minlength=n) / count
    three = words.copy()
    three[:-1] += words[1:] * np.uint64(3)
    three[:-2] += words[2:] * np.uint64(7)
    out[:, -3] = np.bincount(of, _repeated(three), minlength=n) / count
    out[:, -2] = count / PASSAGE_WORDS
    out[:, -1] = np.log1p(sizes[:, 0] / count) / 5
    return out


@dataclass
class Model:
    """Parameters of the encoder (e), the gates (v, u, w) and the score (c); ``base`` alone if nothing was learned."""

    base: float = 0.5
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """x: standardised passages of all bags, one bag after another from ``starts``."""
        p = self.p
        h = np.tanh(x @ p["e"] + p["eb"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        a = (t * s) @ p["w"]
        bag = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(x)))
        a = np.exp(a - np.maximum.reduceat(a, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"h": h, "t": t, "s": s, "a": a, "bag": bag, "z": z, "y": 1 / (1 + np.exp(-(z @ p["c"] + p["cb"])))}

    def standardised(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8).astype(np.float32)

    def score(self, text: str | None) -> float:
        if not self.p:
            return self.base
        return float(self.forward(self.standardised(features(text)), np.array([0]))["y"][0])


def fit(bags: Sequence[np.ndarray], labels: Sequence[int], steps: int = STEPS) -> Model:
    """Full-batch Adam on the mean log loss of the bags."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(base=float(y.mean()) if len(y) else 0.5)
    x = np.concatenate(bags).astype(np.float32)
    starts = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1]))
    model = Model(mean=x.mean(axis=0), scale=x.std(axis=0) + 1e-3)
    x = model.standardised(x)
    rng = np.random.default_rng(SEED)
    shapes = {"e": (WIDTH, HIDDEN), "eb": (HIDDEN,), "v": (HIDDEN, ATTENTION), "u": (HIDDEN, ATTENTION), "w": (ATTENTION,), "c": (HIDDEN,), "cb": (1,)}
    p = model.p = {k: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32) * (len(s) > 1 or k in "wc") for k, s in shapes.items()}
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        f = model.forward(x, starts)
        dy = (f["y"] - y) / len(y)
        g = {"c": f["z"].T @ dy, "cb": dy.sum(keepdims=True)}
        dz = (dy[:, None] * p["c"])[f["bag"]]
        along = (dz * f["h"]).sum(axis=1)
        da = f["a"] * (along - np.add.reduceat(f["a"] * along, starts)[f["bag"]])
        g["w"] = (f["t"] * f["s"]).T @ da
        gate = da[:, None] * p["w"]
        dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
        g["v"], g["u"] = f["h"].T @ dt, f["h"].T @ ds
        dh = (f["a"][:, None] * dz + dt @ p["v"].T + ds @ p["u"].T) * (1 - f["h"] ** 2)
        g["e"], g["eb"] = x.T @ dh, dh.sum(axis=0)
        for k in p:
            grad = g[k] + 1e-4 * p[k]
            m1[k] = 0.9 * m1[k] + 0.1 * grad
            m2[k] = 0.99 * m2[k] + 0.01 * grad**2
            p[k] -= (0.02 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def spaced(passages: np.ndarray, most: int = FIT_PASSAGES) -> np.ndarray:
    """At most ``most`` of the passages, evenly spaced."""
    return passages if len(passages) <= most else passages[np.linspace(0, len(passages) - 1, most).astype(int)]


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS
) -> Model:
    """Learns from the rows of ``labels`` that are not held out; a row of ``docs`` without a label is not used."""
    known = labels.select(id_col, F.col(label_col).alias("__y")).where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    sizes = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model()
    order = F.pmod(F.xxhash64(id_col), F.lit(1 << 20))
    # half of the sample for each label; the rows of one that has fewer go to the other
    half = {y: min(n, max(sample_rows // 2, sample_rows - sizes.get(1 - y, 0))) for y, n in sizes.items()}
    share = F.create_map(*[F.lit(v) for y, n in sizes.items() for v in (y, half[y] / n)])
    chosen = known.where(order < F.lit(1 << 20) * share[F.col("__y")]).limit(2 * sample_rows)
    rows = docs.select(id_col, F.col(text_col).alias("__text")).join(F.broadcast(chosen), id_col)

    def to_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spaced(features(t)).astype(np.float16).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2).cast(pa.int32())], names=["id", "x", "y"])

    found = map_arrow(rows.select(F.col(id_col).cast("string"), "__text", "__y"), to_features, "id string, x binary, y int").limit(2 * sample_rows).toArrow()
    found = found.sort_by([("id", "ascending"), ("x", "ascending")])  # the same sums in every run
    bags = [np.frombuffer(b, np.float16).reshape(-1, WIDTH) for b in found["x"].to_pylist()]
    model = fit(bags, found["y"].to_pylist())
    if model.p:
        # the sample has another share of label 1 than the labels: shift the log odds to theirs
        y = np.array(found["y"].to_pylist())
        odds = lambda one, zero: np.log(max(one, 1) / max(zero, 1))
        model.p["cb"] = (model.p["cb"] + odds(sizes.get(1, 0), sizes.get(0, 0)) - odds((y == 1).sum(), (y == 0).sum())).astype(np.float32)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", carry: Sequence[str] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: the columns named in ``carry``, ``score`` and ``predicted``."""
    rows, schema = carried(docs, carry, text_col, "score double, predicted int")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([shared.value.score(t) for t in batch.columns[-1].to_pylist()])
            columns = [pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=schema.names)

    return map_arrow(rows, scored, schema)
