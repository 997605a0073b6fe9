"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

A row's size is its number of words, its place in its source a 60-bit hash of its id. Each
source has a budget of words; rows below a hash threshold are taken. The threshold is
found without sorting: a histogram sums the sizes by source and hash bucket, the running
sum names the bucket in which the budget ends, and only that bucket is split further by
the next bits until a single hash is left. Budgets are nested: large rows, with over 1/LARGE
of their source's words, get their share of the source's budget first (to the nearest row);
what they leave is the budget of the others. The row at a threshold does not fit, so the
words still missing are again a budget, for the rows not taken that fit in it. ``ROUNDS``
of these bring the total near the target. A source with a target above its size takes every
row once and spends the rest of the budget on second copies.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; a row without an id is placed by its text. Rows that repeat an id share its hash
and are taken or left together. An empty table gives an empty result. Further columns are
carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm.common import WORD, attach, narrow_side, written

# Weights in code-point order of the sources, repeating; share of all words; most copies.
WEIGHTS = (5, 2, 1)
SHARE = (3, 2)
COPIES = 2
#: nested budgets per source (the first one is that of the large rows), and hash bits resolved by each histogram
ROUNDS = 4
LARGE = 50
HASH_BITS = 60
LEVEL_BITS = 12


def with_size_and_hash(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``docs`` with ``size``, ``__hash`` and ``__src`` (the source as a non-null key)."""
    key = F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))
    return docs.withColumns(
        {
            "size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint"),
            "__hash": F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint"),
            "__src": F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")),
        }
    )


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """``__src``, ``source_size``, ``__rows`` -> also ``target``: the budget shared by weight, where a
    source stops at COPIES times its size and the excess goes to the others by weight.

    Sorted by cap over weight, the capped sources come first; the first source whose share
    of what they leave is under its cap sets the level for it and all that follow. The
    sources are the mixing table's configuration, so the two windows over all of them are
    small."""
    num, den = SHARE
    order = Window.orderBy((F.col("__src") == "").asc(), "__src")
    w = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    by_cap = Window.orderBy(F.col("__cap") / F.col("__w"), "__rank")
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(num) * F.sum("source_size").over(everything) - F.lit(den) * F.coalesce(F.sum("__cap").over(before), F.lit(0))
    return (
        sizes.withColumn("__rank", F.row_number().over(order) - 1)
        .withColumns({"__w": w, "__cap": F.lit(COPIES) * F.col("source_size")})
        .withColumns({"__left": left, "__rest": F.lit(den) * F.sum("__w").over(after)})
        .withColumn("__open", F.col("__left") * F.col("__w") <= F.col("__cap") * F.col("__rest"))
        .withColumn("__level", F.min(F.when(F.col("__open"), F.struct(F.col("__cap") / F.col("__w"), "__rank", "__left", "__rest"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("__open"), (F.col("__level.__left") * F.col("__w")).cast("double") / F.col("__level.__rest")).otherwise(
                F.col("__cap").cast("double")
            ),
        )
        .withColumn("base", F.when(F.col("target") >= F.col("source_size"), 1).otherwise(0))
        .select("__src", "source_size", "__rows", "target", "base")
    )


def _fits(round_: int) -> F.Column:
    """Whether nested budget ``round_`` is open to the row."""
    if round_ == 0:
        return F.col("size") * LARGE > F.col("source_size")
    return (F.col("size") > 0) & (F.col("size") <= F.col(f"__r{round_}")) & ~_taken_before(round_)


def _taken_in(round_: int) -> F.Column:
    """Whether nested budget ``round_`` takes the row: below the threshold (null: every row that fits is taken)."""
    return _fits(round_) & (F.col(f"__t{round_}").isNull() | (F.col("__hash") < F.col(f"__t{round_}")))


def _taken_before(round_: int) -> F.Column:
    out = F.lit(False)
    for i in range(round_):
        out = out | _taken_in(i)
    return out


def _threshold(rows: DataFrame, budgets: DataFrame, sources: int, total: int, nearest: bool) -> DataFrame:
    """For each source the hash at which its ``budget`` ends in ``rows`` (null: never) and the
    sum below it. The row at the end is taken only if that is ``nearest`` to the budget."""
    state = budgets.select("__src", "__rows", "budget", F.lit(0).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("bucket"))
    done: list[DataFrame] = []
    shift = HASH_BITS
    while True:
        inside = attach(rows, state, "__src", "__rows", total, counted=sources).where(F.shiftright("__hash", shift) == F.col("bucket"))
        shift -= LEVEL_BITS
        hist = inside.groupBy("__src", F.shiftright("__hash", shift).alias("at")).agg(
            F.sum("size").alias("words"), F.min("__hash").alias("lo"), F.max("__hash").alias("hi")
        )
        hist = hist.join(narrow_side(state.drop("bucket"), sources), "__src")
        upto = F.sum("words").over(Window.partitionBy("__src").orderBy("at")) + F.col("sum")
        over = F.col("upto") > F.col("budget")
        first = F.min(F.when(over, F.struct("at", (F.col("upto") - F.col("words")).alias("sum"), "lo", "hi", "words")))
        found = hist.withColumn("upto", upto).groupBy("__src", "__rows", "budget").agg(first.alias("f"), F.max("upto").alias("all"))
        found = written(
            found.select(
                "__src", "__rows", "budget", F.coalesce("f.sum", "all").alias("sum"), F.col("f.at").alias("bucket"),
                F.col("f.lo").alias("threshold"), F.col("f.words").alias("words"), (F.col("f.lo") < F.col("f.hi")).alias("open"),
            ),
            "mix-level",
        )
        done.append(found.where("open is null or not open").select("__src", "threshold", "sum", "words", "budget"))
        state = found.where("open").select("__src", "__rows", "budget", "sum", "bucket")
        if shift == 0 or state.isEmpty():
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    end = F.lit(nearest) & F.coalesce(F.col("sum") + F.col("words") / 2 <= F.col("budget"), F.lit(False))
    return out.select(
        "__src",
        (F.col("threshold") + F.when(end, 1).otherwise(0)).alias("threshold"),
        (F.col("sum") + F.when(end, F.col("words")).otherwise(0)).alias("sum"),
    )


def plan(rows: DataFrame, weights: Sequence[int] = WEIGHTS) -> tuple[DataFrame, int, int]:
    """The mixing table (one row per source: target, copies of every row, budgets and
    thresholds) for ``rows`` (size, __hash, __src), its number of rows and that of ``rows``."""
    sizes = written(rows.groupBy("__src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows")), "mix-sources")
    sources, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("__rows"), F.lit(0))).first()
    state = source_targets(sizes, weights).withColumn("__r0", F.col("target") - F.col("base") * F.col("source_size"))
    state = written(state, "mix-targets")
    for i in range(ROUNDS):
        open_rows = attach(rows, state, "__src", "__rows", total, counted=sources).where(_fits(i))
        budget = F.col(f"__r{i}")
        if i == 0:
            large = written(open_rows.groupBy("__src").agg(F.sum("size").alias("__large")), "mix-large")
            budgets = state.join(large, "__src").select("__src", "__rows", (budget * F.col("__large") / F.col("source_size")).alias("budget"))
        else:
            budgets = state.select("__src", "__rows", budget.alias("budget"))
        found = _threshold(open_rows.select("__src", "size", "__hash"), budgets, sources, total, nearest=i == 0)
        found = found.withColumnRenamed("threshold", f"__t{i}")
        left = F.col(f"__r{i}") - F.coalesce("sum", F.lit(0))
        state = written(state.join(found, "__src", "left").withColumn(f"__r{i + 1}", left).drop("sum"), "mix-state")
    return state, sources, total


def _mixed(rows: DataFrame, state: DataFrame, sources: int, total: int) -> DataFrame:
    copies = F.col("base") + F.when(_taken_before(ROUNDS), 1).otherwise(0)
    return attach(rows, state, "__src", "__rows", total, counted=sources).withColumn("copies", copies)


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int]):
    rows = with_size_and_hash(docs.select(id_col, text_col, source_col), id_col, text_col, source_col)
    rows = written(rows.select(id_col, "size", "__hash", "__src"), "mix-rows")
    return rows, *plan(rows, weights)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``source_size``, ``target`` (of its
    source) and ``copies``, how often the mix takes it (0, 1 or 2)."""
    rows, state, sources, total = _planned(docs, id_col, text_col, source_col, weights)
    return _mixed(rows, state, sources, total).select(id_col, "size", "source_size", "target", "copies")


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
) -> DataFrame:
    """The mixed corpus: each row of ``docs``, with all its columns, as often as the mix
    takes it. The texts are read a second time and not shuffled."""
    _, state, sources, total = _planned(docs, id_col, text_col, source_col, weights)
    rows = docs.select(F.struct("*").alias("__row"), id_col, text_col, source_col)
    rows = with_size_and_hash(rows, id_col, text_col, source_col).select("__row", "size", "__hash", "__src")
    taken = _mixed(rows, state, sources, total).where("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")
