r"""Conversations as one formatted string each, with a loss mask, in Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role
become one block by array functions (each turn looks at its neighbours' roles: only the first of
a block gets its start, only the last its end); the pieces are then aggregated into one string.
The template of a block is

    <s>role[INST]text[/INST]text of the next turn of the same role</s>

Inside roles and texts a control string (``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) gets a
backslash after its first character, and one that already has backslashes there gets one more,
so no text holds a mark and ``parse_turns`` gives back every turn as it was.

``loss_spans`` are the pieces of ``formatted`` to learn from, in bytes of its UTF-8 form: the
text of each turn whose role is in ``loss_roles``, without any mark.

Work and memory grow in proportion to a conversation's length, not with its square. One result
row is one conversation, so it must fit a Spark string (2 GB); ``collect_list`` gathers partial
lists before the shuffle, which then carries one row per conversation and task.

Defined results: a null text or role is empty. Turns are ordered by turn (nulls first), then
role, then text, so ties come in a fixed order; repeated rows stay repeated turns. Rows with
a null conversation id form one conversation. An empty table gives an empty result. Further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings, and the pattern of one with any backslashes in it.
BLOCK, TEXT, NEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = r"(<|\[)(\\*/?(?:s>|INST\]))"
ESCAPED = r"(<|\[)\\(\\*/?(?:s>|INST\]))"
#: elements summed by one fold, which copies the sums so far at each step
FOLD = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function`` of a value that is computed once, however often a lambda in it is called."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def sums_before(numbers: Column) -> Column:
    """For each number of the array the sum of those before it, by folds over parts of ``FOLD``."""
    zero = F.lit(0).cast("bigint")

    def fold(part: Column, start: Column) -> Column:
        sums = F.aggregate(part, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(sums, 1, F.size(part))

    def in_parts(all_: Column) -> Column:
        last = F.size(all_) - 1
        return F.transform(
            F.sequence(F.lit(0), F.floor(last / FOLD).cast("int")),
            lambda i: F.transform(F.sequence(i * FOLD, F.least((i + 1) * FOLD - 1, last)), lambda j: F.get(all_, j)),
        )

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda acc, x: acc + x)

    return bound(numbers, lambda n: bound(in_parts(n), lambda parts: F.flatten(F.zip_with(parts, fold(F.transform(parts, total), zero), fold))))


def format_chat(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_roles: Sequence[str] = ("assistant",),
) -> DataFrame:
    """One row per conversation: its id, ``n_turns``, ``n_blocks``, ``formatted`` and
    ``loss_spans`` (``start``, ``length`` in bytes of ``formatted``)."""
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    grouped = rows.select(F.col(conv_col).alias("id"), turn.alias("t")).groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    # a piece is a text with the marks before and after it; a neighbour of the same role shares its block
    def piece(turn: Column, i: Column) -> Column:
        first = (i == 0) | (F.get("turns", i - 1)["role"] != turn["role"])
        last = (i == F.size("turns") - 1) | (F.get("turns", i + 1)["role"] != turn["role"])
        return F.struct(
            F.when(first, F.concat(F.lit(BLOCK), escape(turn["role"]), F.lit(TEXT))).otherwise(F.lit(NEXT)).alias("before"),
            escape(turn["text"]).alias("text"),
            F.when(last, F.lit(END)).otherwise(F.lit("")).alias("after"),
            turn["role"].isin(*loss_roles).alias("loss"),
        )

    cut = grouped.select("id", F.transform("turns", piece).alias("pieces"))
    bytes_of = lambda p: F.octet_length(p["before"]) + F.octet_length(p["text"]) + F.octet_length(p["after"])
    laid = cut.withColumns(
        {
            "n_turns": F.size("pieces").cast("bigint"),
            "n_blocks": F.size(F.filter("pieces", lambda p: p["after"] != "")).cast("bigint"),
            "formatted": F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), ""),
            "at": sums_before(F.transform("pieces", bytes_of)),
        }
    )
    spans = F.zip_with(
        "pieces",
        "at",
        lambda p, at: F.struct(
            (at + F.octet_length(p["before"])).cast("bigint").alias("start"),
            F.octet_length(p["text"]).cast("bigint").alias("length"),
            p["loss"].alias("loss"),
        ),
    )
    kept = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["length"]))
    return laid.select(F.col("id").alias(conv_col), "n_turns", "n_blocks", "formatted", kept.alias("loss_spans"))


def _split(text: Column, mark: str) -> Column:
    return F.split(text, F.lit(r"\Q" + mark + r"\E"), -1)


def parse_turns(formatted: str) -> Column:
    """The turns (``role``, ``text``) in the column ``formatted``, as they were before formatting."""
    blocks = F.filter(_split(F.col(formatted), END), lambda b: b != "")
    # a block's start mark goes; its role ends at its one TEXT mark
    parts = F.transform(blocks, lambda b: _split(F.substr(b, F.lit(len(BLOCK) + 1)), TEXT))
    return F.flatten(
        F.transform(
            parts,
            lambda p: F.transform(
                _split(F.get(p, F.lit(1)), NEXT),
                lambda text: F.struct(unescape(F.get(p, F.lit(0))).alias("role"), unescape(text).alias("text")),
            ),
        )
    )


def loss_texts(formatted: str, spans: str) -> Column:
    """The unescaped texts under the loss mask, in order (cut from the bytes, so in linear time)."""

    def cut(raw: Column) -> Column:
        return F.transform(spans, lambda s: unescape(F.substring(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string")))

    return bound(F.col(formatted).cast("binary"), cut)
