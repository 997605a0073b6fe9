from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import quality_rules
from tests.llm.conftest import DOCS, corpus

CLEAN = " ".join(f"word{i} stands here" for i in range(40))
AWKWARD = [
    None, "", "\n\n", "one", CLEAN, CLEAN + " #" * 20, CLEAN + "\n" + CLEAN, "a a a a", "line one\nline one\n \nline one\n \n" + CLEAN,
    "a b c x a b c", "a b c\x1cd", "x" * 3000 + " " + CLEAN, "LOUD!! " * 60, "same line\n" * 80, "k " * 30000, "a\r\nb\x0bc\x0cd",
]


def brute(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    found = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if found[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    n, chars, symbols = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text))
    base = n < 50 or 100 * len(covered) > 50 * n
    bad = 10 * symbols > n or 4 * text.count("!") > n or chars < 2 * n or chars > 20 * n or 10 * dup > 3 * len(lines)
    return n, chars, symbols, dup, len(covered), base, not (base or bad)


@pytest.mark.parametrize("text", AWKWARD)
def test_measures(text):
    m = quality_rules.Measures(text)
    found = tuple(getattr(m, n) for n in quality_rules.REPORTED)
    assert found == brute(text)[:5]


def test_judge_matches_brute_force(spark, docs):
    rows = corpus() + [(10_000 + i, t, None, None, None) for i, t in enumerate(AWKWARD)]
    found = quality_rules.judge(spark.createDataFrame(rows, DOCS).repartition(3), carry=("doc_id",))
    assert found.columns == ["doc_id", *quality_rules.REPORTED, "base_failed", "kept"]
    assert {tuple(r) for r in found.collect()} == {(r[0], *brute(r[1])) for r in rows}


def test_order_is_by_rejections_per_cost_and_does_not_change_the_verdict(docs):
    order = quality_rules.rule_order(docs)
    assert sorted(order) == sorted(quality_rules.RULES)
    want = {r.doc_id for r in quality_rules.filter_quality(docs, order=order).collect()}
    for other in (order[::-1], sorted(order)):
        assert {r.doc_id for r in quality_rules.filter_quality(docs, order=other).collect()} == want
    assert want == {r[0] for r in corpus() if brute(r[1])[-1]}


def test_cheap_selective_rules_run_first(spark):
    # every text is too short, and none has repeated windows: the count of words must come first
    rows = [(i, f"only a few words {i}", None, None, None) for i in range(300)]
    order = quality_rules.rule_order(spark.createDataFrame(rows, DOCS))
    assert order[0] == "too_few_words" and order.index("repeated_windows") > 0


def test_cascade_stops_at_the_first_rejection(monkeypatch):
    asked = []
    rules = {n: (lambda m, n=n: asked.append(n) or n == "b") for n in "abc"}
    monkeypatch.setattr(quality_rules, "RULES", rules)
    assert not quality_rules.passes(quality_rules.Measures("x"), ["a", "b", "c"])
    assert asked == ["a", "b"]


def test_rows_that_stay_keep_all_columns(docs, empty):
    clash = docs.withColumns({"kept": F.lit("x"), "n_words": F.lit(None).cast("int"), "__text": F.lit(3), "a b": F.array(F.lit(1))})
    found = quality_rules.filter_quality(clash)
    assert found.schema == clash.schema
    assert sorted(r.doc_id for r in found.collect()) == sorted(r[0] for r in corpus() if brute(r[1])[-1])
    assert quality_rules.filter_quality(empty).collect() == [] and quality_rules.judge(empty, carry=("doc_id",)).collect() == []


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, CLEAN, None, None, None)] * 3 + [(4, None, None, None, None)] * 2, DOCS)
    found = sorted((r.doc_id or -1, r.kept) for r in quality_rules.judge(docs, carry=("doc_id",)).collect())
    assert found == [(-1, True)] * 3 + [(4, False)] * 2
