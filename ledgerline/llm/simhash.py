"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's words (A-Z lower-cased) give 3-word shingles; bit i of the 64-bit fingerprint is 1
when over half of the shingles' XXH64 values (seed 42) have it set. Fingerprints within
``RADIUS`` = 3 bits are linked and linked groups are the components.

* Equal fingerprints meet first, so the rest works on distinct ones.
* Two fingerprints at most 3 bits apart have a point between them that is at most one bit
  from one (its near ball, 65 variants) and two from the other (its far ball, 2,016 more).
  Every fingerprint emits its variants, the shuffle brings equal variants together, and
  within a variant everything is linked to its smallest near fingerprint. Each such link
  is verified; since any near and any other member are within 3 bits, no pair is lost
  although no bucket is expanded into pairs. A bucket has at most 65 + 2,016 members.
* The far ball is costly, so ``crowded`` first finds, by the same ball hashing on fewer
  bits, the fingerprints that can have a neighbour at all. Clear one of four 16-bit blocks
  that holds a differing bit: at most 2 of the other 48 bits differ, so the near balls of
  the cleared fingerprints (49 variants) meet. A fingerprint whose 4 x 49 variants meet
  nothing has no neighbour. This drops work, never a link.
* Components: the smallest label travels along the links and the labels are followed to
  their own label in each round, so long chains take few rounds. Every round is a written
  table. Nothing is gathered on the driver.

Defined results: a null or empty text has fingerprint zero and is linked like any other;
with fewer than three words the whole sequence is the one shingle. ``component_id`` is
the smallest id reachable, null only if all of them are null; the row that stays is the one with
that id (of repeated ids, the first by row number). An empty table gives an empty result.
Further columns are carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm.common import ASCII_LOWER, attach, map_arrow, narrow_side, written

# Shingle length in words, most differing bits, XXH64 seed.
SHINGLE = 3
RADIUS = 3
SEED = 42
BITS = 64
#: shingles whose bits are counted at a time, which bounds the memory for a long text
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, as an unsigned number."""
    words = (text or "").encode().translate(ASCII_LOWER).split()
    if not words:
        return 0
    hash_, join = xxhash.xxh64_intdigest, b" ".join
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    values = np.fromiter((hash_(join(g), SEED) for g in grams), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(values), CHUNK):
        part = values[i : i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprints(docs: DataFrame, id_col: str, text_col: str, carry_row: bool, shingle: int = SHINGLE) -> DataFrame:
    """Written table of ``__uid`` (a row number), the id, ``__fp`` (signed) and, if asked for, the row."""
    rows = docs.select(
        *([F.struct("*").alias("__row")] if carry_row else []),
        F.col(id_col).alias("__id"),
        F.col(text_col).alias("__text"),
    )
    names = rows.columns[:-1]

    def with_fp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([_signed(fingerprint(t, shingle)) for t in batch.column(len(names)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fps], names=[*names, "__fp"])

    return written(map_arrow(rows, with_fp, rows.schema[:-1].add("__fp", "long")).withColumn("__uid", F.monotonically_increasing_id()), "simhash-rows")


def crowded(fps: DataFrame) -> DataFrame:
    """The distinct fingerprints that share a variant, with one 16-bit block cleared, with another."""
    blocks = [((1 << 16) - 1) << (16 * b) for b in range(4)]
    # the block's number is put into its cleared bits, so variants of different blocks rarely meet
    flips = [(_signed(((1 << BITS) - 1) ^ m), _signed((b << (16 * b)) ^ f)) for b, m in enumerate(blocks) for f in (0, *(1 << i for i in range(BITS) if not m >> i & 1))]
    masks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).alias("f")) for k, f in flips])
    variants = F.transform(masks, lambda m: F.col("__fp").bitwiseAND(m["k"]).bitwiseXOR(m["f"]))
    emitted = fps.select("__fp", F.explode(variants).alias("v"))
    many = F.min("__fp").over(Window.partitionBy("v")) != F.max("__fp").over(Window.partitionBy("v"))
    return emitted.withColumn("many", many).where("many").select("__fp").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of fingerprints at most RADIUS bits apart whose graph has the same
    components as that of all such pairs."""
    near = [0, *(1 << i for i in range(BITS))]
    far = [(1 << i) | (1 << j) for i in range(BITS) for j in range(i)]
    flips = F.lit([_signed(f) for f in near + far])
    emitted = fps.select("__fp", F.posexplode(F.transform(flips, lambda f: F.col("__fp").bitwiseXOR(f))).alias("p", "v"))
    centre = F.min(F.when(F.col("p") < len(near), F.col("__fp"))).over(Window.partitionBy("v"))
    pairs = emitted.withColumn("a", centre).where("a != __fp").select("a", F.col("__fp").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` for every node of the written table ``edges`` (a, b): the smallest node of its component."""
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "simhash-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "simhash-labels")
    total = F.sum(F.col("label").cast("decimal(38,0)")).alias("s")
    last = labels.agg(total).first()["s"]
    while last is not None:
        heard = both.join(labels, F.col("a") == F.col("node")).groupBy("b").agg(F.min("label").alias("heard"))
        told = labels.join(heard, F.col("node") == F.col("b"))
        # a node takes the smallest label it hears and passes it on to the node it was labelled with
        news = told.select(F.explode(F.array(F.struct("node", F.least("label", "heard").alias("label")), F.struct(F.col("label").alias("node"), F.least("label", "heard").alias("label")))).alias("n"))
        labels = written(news.select("n.*").groupBy("node").agg(F.min("label").alias("label")), "simhash-labels")
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("top"))
        labels = written(labels.join(up, F.col("label") == F.col("up")).select("node", F.col("top").alias("label")), "simhash-labels")
        now = labels.agg(total).first()["s"]
        if now == last:
            break
        last = now
    return labels


def _grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For ``fingerprints`` rows: one row per distinct fingerprint (size, first id and row), and linked ones' labels."""
    first = F.min(F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("id"), F.col("__uid").alias("uid")))
    groups = written(rows.groupBy("__fp").agg(first.alias("first"), F.count(F.lit(1)).alias("__n")), "simhash-groups")
    edges = written(links(written(crowded(groups.select("__fp")), "simhash-crowded")), "simhash-links")
    return groups, components(edges)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: the id, ``fingerprint`` (16 hex digits) and ``component_id``."""
    rows = fingerprints(docs, id_col, text_col, carry_row=False, shingle=shingle)
    groups, labels = _grouped(rows)
    linked = groups.join(labels, F.col("__fp") == F.col("node"))
    smallest = linked.groupBy("label").agg(F.min("first").alias("best"))
    named = linked.join(smallest, "label").select("__fp", "best")
    known = groups.join(named, "__fp", "left").select("__fp", "__n", F.coalesce("best.id", "first.id").alias("component_id"))
    out = attach(rows, written(known, "simhash-named"), "__fp", "__n", rows.count())
    return out.select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that have the smallest id of their component."""
    rows = fingerprints(docs, id_col, text_col, carry_row=True, shingle=shingle)
    groups, labels = _grouped(rows.drop("__row"))
    linked = groups.join(labels, F.col("__fp") == F.col("node"), "left")
    best = linked.groupBy(F.coalesce("label", "__fp").alias("__c")).agg(F.min("first.uid").alias("any"), F.min("first").alias("best"))
    stays = written(best.select(F.col("best.uid").alias("__uid")), "simhash-stays")
    gone = written(rows.select("__uid").join(stays, "__uid", "left_anti"), "simhash-gone")
    return rows.join(narrow_side(gone, gone.count()), "__uid", "left_anti").select("__row.*")
