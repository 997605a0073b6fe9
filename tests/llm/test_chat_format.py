from __future__ import annotations

import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string"
MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "</", "<", "[", "\\", "s>", "INST]", "/", "é", "中", "\n", "a", " "]


def result(spark, rows, schema=SCHEMA):
    out = C.format_chat(spark.createDataFrame(rows, schema).repartition(3))
    out = out.withColumns({"turns": C.parse_turns("formatted"), "loss": C.loss_texts("formatted", "loss_spans")})
    return {r["conv_id"]: r for r in out.collect()}


def check(rows, found):
    """Every conversation comes back turn by turn; its mask holds its assistant texts and nothing else."""
    def key(r):
        return (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")

    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append(r)
    assert set(found) == set(by_id)
    for id_, turns in by_id.items():
        turns = [(r[2] or "", r[3] or "") for r in sorted(turns, key=key)]
        got = found[id_]
        assert [tuple(t) for t in got["turns"]] == turns
        assert got["loss"] == [t for role, t in turns if role == "assistant"]
        assert got["n_turns"] == len(turns)
        blocks = [role for role, _ in itertools.groupby(turns, key=lambda t: t[0])]
        assert got["n_blocks"] == len(blocks) == got["formatted"].count("<s>") == got["formatted"].count("</s>")
        raw = got["formatted"].encode()
        assert all(0 <= s["start"] and s["start"] + s["length"] <= len(raw) for s in got["loss_spans"])


@settings(max_examples=12, deadline=None)
@given(st.integers(0, 10**9))
def test_round_trip_of_hostile_texts(spark, seed):
    rng = random.Random(seed)
    hostile = lambda: rng.choice([None, "", "".join(rng.choice(MARKS) for _ in range(rng.randint(0, 12)))])
    rows = [(rng.choice([None, 1, 2, 3, -1]), rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", "assistant", hostile()]), hostile()) for _ in range(60)]
    check(rows, result(spark, rows))


def test_ties_repeats_and_a_long_conversation(spark):
    rows = [(7, i // 2, ("user", "assistant")[i // 3 % 2], f"t{i} " * (i % 5)) for i in range(5000)]
    rows += [(8, 0, "assistant", "x" * 300_000), (8, 0, "assistant", "x" * 300_000), (8, 0, "user", "")]
    check(rows, result(spark, rows))


def test_other_columns_are_ignored(spark):
    rows = [(1, 0, "user", "a", "x", 5), (1, 1, "assistant", "b", "y", 6)]
    found = result(spark, rows, SCHEMA + ", formatted string, id long")
    check([r[:4] for r in rows], found)
    assert found[1]["formatted"] == "<s>user[INST]a</s><s>assistant[INST]b</s>"


def test_sums_before_crosses_its_parts(spark):
    n = 3 * C.FOLD + 5
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(n)).alias("x"))
    assert df.select(C.sums_before(F.col("x")).alias("s")).first()["s"] == [i * (i + 1) // 2 for i in range(n)]


def test_empty_table(spark):
    assert result(spark, []) == {}
