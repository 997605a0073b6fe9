"""Packing documents into fixed-length sequences by cutting-stock column generation.

* A document's ids are cut into pieces of the full length and a rest; pieces are written
  with their ids, their length class (length over ``unit``, rounded up) and their number
  within task and class. Short pieces (under ``SHORT`` units) that stand in one of the slices
  in which a task reads its rows are laid end to end into bundles of up to twice that, which
  share a class, a number and so a place, as one piece would.
* The histogram of classes (at most ``length / unit`` rows) is the cutting-stock problem:
  its linear program over patterns is solved by column generation, in which a knapsack
  dynamic program prices the columns. Each pattern is used a rounded-down number of times.
* Within a class the pieces are ranked (counts per task, prefix sums, number within the
  task: no sort), and the rank names the pattern, its copy and the place in it.
* Rounding leaves at most one fractional copy of each of the ``length / unit`` patterns, so
  the pieces left over are bounded whatever the input. They are laid end to end and cut
  into full sequences, and the end into powers of two, so they need no padding.

A piece of ``SHORT`` units or more, or a bundle, takes at most ``unit - 1`` ids more than its
length in the patterns, which is nearly all of the padding. Bundles are longer than ``SHORT``
units but for the last of a slice.

Defined results: a null text is empty (its only id is the end id). Rows that repeat an id
are packed like any others. An empty table gives an empty result. Further columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm.common import map_arrow, narrow_side, slices, written
from ledgerline.llm.tokens import encoder

# Ids in a sequence; ids in a unit of the patterns.
LENGTH = 4096
UNIT = 16
#: Units below which a piece is bundled with others.
SHORT = 16
#: The program stops here at the latest; every basis on the way is a valid packing.
MAX_PIVOTS = 4000


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack: how many of each size to take for the most worth."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fit = np.searchsorted(sizes, room, "right")
        best[room], choice[room] = best[room - 1], -1
        if fit:
            value = worth[:fit] + best[room - sizes[:fit]]
            j = int(value.argmax())
            if value[j] > best[room] + 1e-12:
                best[room], choice[room] = value[j], j
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        j = choice[room]
        if j < 0:
            room -= 1
        else:
            pattern[j] += 1
            room -= sizes[j]
    return pattern


def cutting_stock(demand: dict[int, int], capacity: int, max_pivots: int = MAX_PIVOTS) -> list[tuple[int, dict[int, int]]]:
    """Patterns (size -> how many) that fit ``capacity`` and how often to use each; together
    they take no more pieces of a size than ``demand`` has."""
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), int)
    if not len(sizes):
        return []
    wanted = np.array([demand[s] for s in sizes], float)
    basis = np.diag((capacity // sizes).astype(float))  # columns are patterns
    inverse = np.linalg.inv(basis)
    used = inverse @ wanted
    for pivot in range(1, max_pivots + 1):
        price = inverse.sum(axis=0)
        column = _best_pattern(sizes, price, capacity)
        if price @ column <= 1 + 1e-7:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        if pivot % 100 == 0:
            inverse = np.linalg.inv(basis)
            used = np.maximum(inverse @ wanted, 0)
        else:
            inverse[out] /= step[out]
            step[out] = 0
            inverse -= np.outer(step, inverse[out])
            used = np.maximum(used - ratio[out] * step, 0)
            used[out] = ratio[out]
    found = []
    left = wanted.astype(int)
    for times, pattern in zip(used, basis.T.astype(int)):
        has = pattern > 0
        times = min(int(times + 1e-6), int((left[has] // pattern[has]).min()))
        if times > 0:
            left -= times * pattern
            found.append((times, {int(s): int(n) for s, n in zip(sizes[has], pattern[has])}))
    return found


def _slots(patterns: list[tuple[int, dict[int, int]]]) -> tuple[list[tuple[int, ...]], int]:
    """For each size and pattern: the ranks [lo, hi) it takes, how many to a copy, its first sequence."""
    rows, taken, sequence = [], Counter(), 0
    for times, pattern in patterns:
        for size, n in pattern.items():
            rows.append((size, taken[size], taken[size] + times * n, n, sequence))
            taken[size] += times * n
        sequence += times
    return rows, sequence


def rest_sequences(total: int, length: int) -> list[tuple[int, int]]:
    """(first id, ids) of the sequences for the end of ``total`` ids laid end to end, after
    the full ones: its powers of two, largest first."""
    at, out = total - total % length, []
    for bit in reversed(range(length.bit_length())):
        if (total % length) >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def cut(first: int, last: int, total: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Cuts the ids [first, last) of ``total`` where sequences end: (from, to, sequence, offset)."""
    full = total // length
    ends = rest_sequences(total, length)
    while first < last:
        if first < full * length:
            k, begin, n = first // length, first // length * length, length
        else:
            k, begin, n = next((full + i, b, n) for i, (b, n) in enumerate(ends) if b <= first < b + n)
        to = min(last, begin + n)
        yield first, to, k, first - begin
        first = to


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pieces(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, word_level: bool, length: int, unit: int) -> DataFrame:
    """Written table of the documents' pieces, with their ids and their number within task and class."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = rows.schema[:1]
    for name, kind in (("start", "long"), ("length", "long"), ("crc", "long"), ("doc_tokens", "long"), ("size", "integer"), ("task", "integer"), ("nth", "long"), ("within", "long"), ("ids", "binary")):
        schema = schema.add(name, kind)

    def to_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seen = encoder(tokenizer, word_level), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for part in slices(batch, 1):
                out, at, bundle, bundled = [], [], [], 0

                def place(group: list, ids: int) -> None:
                    size, within = -(-ids // unit), 0
                    for row, start, piece, tokens in group:
                        out.append((start, len(piece), _crc(piece), tokens, size, task, seen[size], within, piece.tobytes()))
                        at.append(row)
                        within += len(piece)
                    seen[size] += 1

                found, ends = enc.encode(part.column(1), end_id)
                for row in range(part.num_rows):
                    ids = found[ends[row] : ends[row + 1]]
                    for start in range(0, len(ids), length):
                        piece = ids[start : start + length]
                        if len(piece) >= SHORT * unit:
                            place([(row, start, piece, len(ids))], len(piece))
                            continue
                        if bundle and bundled + len(piece) > min(2 * SHORT * unit, length):
                            place(bundle, bundled)
                            bundle, bundled = [], 0
                        bundle.append((row, start, piece, len(ids)))
                        bundled += len(piece)
                if bundle:
                    place(bundle, bundled)
                first = part.column(0).take(pa.array(at, pa.int64()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([first, *(pa.array(v, k) for v, k in zip(zip(*out), kinds))], names=schema.names)

    return written(map_arrow(rows, to_pieces, schema), "pack-pieces")


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    word_level: bool = False,
    length: int = LENGTH,
    unit: int = UNIT,
) -> DataFrame:
    """One row per piece: the id, ``start`` (ids of the document before it), ``length``,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    table = pieces(docs, tokenizer, end_id, id_col, text_col, word_level, length, unit)
    width = encoder(tokenizer, word_level).dtype.itemsize
    counts = written(table.groupBy("size", "task").agg(F.count_if(F.col("within") == 0).alias("n")), "pack-counts")
    demand = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    slots, sequences = _slots(cutting_stock(demand, length // unit))

    # rank within the class: pieces of the tasks before (one row per task and class) plus the number in the task
    before = F.sum("n").over(Window.partitionBy("size").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("size", "task", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = table.join(narrow_side(base, counts.count()), ["size", "task"]).withColumn("rank", F.col("base") + F.col("nth"))

    slot = spark.createDataFrame(slots, "s int, lo long, hi long, n long, first long")
    placed = ranked.join(F.broadcast(slot), (F.col("size") == F.col("s")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    at = F.col("rank") - F.col("lo")
    order = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "place", "within").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        placed.withColumns({"sequence_id": F.col("first") + F.expr("(rank - lo) div n"), "place": at % F.col("n")})
        .select("id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "size", "place", "within")
        .withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
        .drop("size", "place", "within")
    )

    # the bounded rest of the pieces, end to end
    taken = Counter()
    for size, _, hi, _, _ in slots:
        taken[size] = max(taken[size], hi)
    full = spark.createDataFrame([(s, taken[s]) for s in demand], "s int, taken long")
    rest = ranked.join(F.broadcast(full), F.col("size") == F.col("s")).where("rank >= taken")
    rest = written(rest.select("id", "start", "length", "doc_tokens", "size", "rank", "within", "ids"), "pack-rest")
    line = Window.orderBy("size", "rank", "within").rowsBetween(Window.unboundedPreceding, -1)
    laid = rest.withColumn("at", F.coalesce(F.sum("length").over(line), F.lit(0)))
    total = rest.agg(F.sum("length").alias("n")).first()["n"] or 0

    names = placed.columns

    def to_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, row = [], []
            for i, (start, n, doc_tokens, ids, at) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                found = np.frombuffer(ids, f"<u{width}")
                for first, last, k, offset in cut(at, at + n, total, length):
                    out.append((start + first - at, last - first, _crc(found[first - at : last - at]), doc_tokens, sequences + k, offset))
                    row.append(i)
            if out:
                ids = batch.column(0).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, pa.int64()) for v in zip(*out))], names=names)

    schema = placed.select("id").schema
    for name in names[1:]:
        schema = schema.add(name, "long")
    cuts = map_arrow(laid.select("id", "start", "length", "doc_tokens", "ids", "at"), to_cuts, schema)
    out = placed.unionByName(cuts)
    return out.select(F.col("id").alias(id_col), *names[1:])
