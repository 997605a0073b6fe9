"""Exact deduplication by two-pass Bloom filtering, with DataFrame functions only.

Texts are equal when identical after deleting every space, tab, LF, VT, FF and CR.

* Pass 1 reads each text once, writes its digest (id, SHA-256, length) to the shared
  folder and counts how often each of the digest's Bloom positions is hit; the positions
  hit at least twice are the second filter, which holds every repeated digest.
* Pass 2 probes the filter. A row with a position hit once is unique for certain and
  passes straight through; only the others are shuffled, to find the exact groups.

The filter has at most ``max_filter_bits`` bits whatever the input, which bounds the
broadcast (one 64-bit word for each 64 bits that has any bit set). With more rows than
that suits, more rows are shuffled; the result stays exact.

Defined results: a null text counts as empty. Of equal texts the row with the most code
points stays, then the smallest id; a null id comes last. Rows that repeat both id and
text get the same answer from ``exact_groups``; ``exact_dedup`` keeps one of them. An
empty table gives an empty result. Further columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import SPACES, attach, written

PROBES = 2
BITS_PER_ROW = 16


def with_digest(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_sha256`` of the text without white space and ``__len`` of the text as it is."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = text
    for ch in SPACES:
        bare = F.replace(bare, F.lit(ch), F.lit(""))
    return docs.withColumns({"text_sha256": F.sha2(bare.cast("binary"), 256), "__len": F.length(text)})


def _positions(bits: int) -> list[F.Column]:
    return [F.pmod(F.xxhash64(F.col("text_sha256"), F.lit(i)), F.lit(bits)) for i in range(PROBES)]


def repeat_filter(digests: DataFrame, bits: int) -> DataFrame:
    """Words (index, 64 bits) of the filter of positions that at least two rows hit."""
    hit = digests.select(F.explode(F.array(*_positions(bits))).alias("pos")).groupBy("pos").count()
    return (
        hit.where("count > 1")
        .groupBy(F.shiftright("pos", 6).alias("__word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(pos & 63 as int)))").alias("__bits"))
    )


def probe(rows: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """``rows`` with ``__repeated``: false is certain, true may be a false positive."""
    flag = F.lit(True)
    for i, pos in enumerate(_positions(bits)):
        side = F.broadcast(words.select(F.col("__word").alias(f"__w{i}"), F.col("__bits").alias(f"__b{i}")))
        rows = rows.withColumn(f"__p{i}", pos).join(side, F.shiftright(f"__p{i}", 6) == F.col(f"__w{i}"), "left")
        flag = flag & F.coalesce(F.expr(f"getbit(__b{i}, cast(__p{i} & 63 as int)) = 1"), F.lit(False))
    return rows.withColumn("__repeated", flag).drop(*[f"__{x}{i}" for i in range(PROBES) for x in "wpb"])


def _plan(docs: DataFrame, id_col: str, text_col: str, max_filter_bits: int):
    digests = written(with_digest(docs.select(id_col, text_col), text_col).drop(text_col), "exact-digests")
    total = digests.count()
    bits = 1024
    while bits < min(BITS_PER_ROW * total, max_filter_bits):
        bits *= 2
    words = written(repeat_filter(digests, bits), "exact-filter")
    best = F.min(F.struct((-F.col("__len")).alias("l"), F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id")))
    groups = (
        probe(digests, words, bits)
        .where("__repeated")
        .groupBy("text_sha256")
        .agg(best.alias("b"), F.count(F.lit(1)).alias("__n"))
        .where("__n > 1")
        .select("text_sha256", F.col("b.id").alias("__keep"), (-F.col("b.l")).alias("__keep_len"), "__n")
    )
    return digests, total, lambda rows: probe(rows, words, bits), written(groups, "exact-groups")


def _answer(rows: DataFrame, id_col: str, probed, groups: DataFrame, total: int) -> DataFrame:
    rows = probed(rows)
    single = {"__keep": groups.schema["__keep"].dataType, "__keep_len": groups.schema["__keep_len"].dataType, "__n": "bigint"}
    straight = rows.where("not __repeated").withColumns({c: F.lit(None).cast(t) for c, t in single.items()})
    found = attach(rows.where("__repeated"), groups, "text_sha256", "__n", total, "left")
    same = F.col("__keep").eqNullSafe(F.col(id_col)) & (F.col("__len") == F.col("__keep_len"))
    return straight.unionByName(found).withColumns(
        {
            "keep_id": F.when(F.col("__n").isNull(), F.col(id_col)).otherwise(F.col("__keep")),
            "group_size": F.coalesce("__n", F.lit(1).cast("bigint")),
            "kept": F.col("__n").isNull() | same,
        }
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bits: int = 1 << 28
) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    digests, total, probed, groups = _plan(docs, id_col, text_col, max_filter_bits)
    out = _answer(digests, id_col, probed, groups, total)
    return out.select(id_col, "keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bits: int = 1 << 28
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (whatever their names).

    The texts are read a second time rather than written. A text is shuffled only when
    the groups are too many to broadcast, or when the row that stays is itself repeated."""
    digests, total, probed, groups = _plan(docs, id_col, text_col, max_filter_bits)
    stays = F.col("__keep").eqNullSafe(F.col(id_col)) & (F.col("__len") == F.col("__keep_len"))
    rows_that_stay = attach(probed(digests).where("__repeated"), groups, "text_sha256", "__n", total).where(stays)
    twins = written(rows_that_stay.groupBy("text_sha256").count().where("count > 1").select("text_sha256"), "exact-twins")
    marked = groups.join(twins.withColumn("__twins", F.lit(True)), "text_sha256", "left")
    marked = written(marked.fillna(False, ["__twins"]), "exact-marked")

    rows = docs.select(F.struct("*").alias("__row"), id_col, text_col)
    rows = probed(with_digest(rows, text_col).drop(text_col))
    found = attach(rows.where("__repeated"), marked, "text_sha256", "__n", total, "left", counted=marked.count())
    found = found.where(F.col("__twins").isNull() | stays)
    one = found.where("__twins").dropDuplicates(["text_sha256"])
    out = rows.where("not __repeated").select("__row").unionByName(found.where("__twins is null or not __twins").select("__row"))
    return out.unionByName(one.select("__row")).select("__row.*")
