from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import common, exact_dedup
from tests.llm.conftest import DOCS, corpus


def brute(rows):
    groups: dict[str, list] = {}
    for id_, text, *_ in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(hashlib.sha256(bare.encode()).hexdigest(), []).append((-len(text or ""), id_))
    return {(i, min(g)[1], len(g), i == min(g)[1], sha) for sha, g in groups.items() for _, i in g}


@pytest.mark.parametrize("bits", [1 << 10, 1 << 20])
def test_groups_match_brute_force(docs, bits):
    # with 1,024 bits the filter is nearly full: more rows move, the result is the same
    found = exact_dedup.exact_groups(docs, max_filter_bits=bits)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert {tuple(r) for r in found.collect()} == brute(corpus())


def test_rows_that_stay(docs):
    stays = {r[0] for r in brute(corpus()) if r[3]}
    found = exact_dedup.exact_dedup(docs)
    assert found.schema == docs.schema
    assert sorted(r.doc_id for r in found.collect()) == sorted(stays)


def test_rows_that_stay_of_more_groups_than_are_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_SHARE", 10)  # so that some are hot and some are not
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(docs).collect()) == sorted(r[0] for r in brute(corpus()) if r[3])
    twice = spark.createDataFrame([(7, "ab", None, None, 2)] * 5 + [(8, "c", None, None, 1)], DOCS)
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(twice).collect()) == [7, 8]


def test_one_hot_group(spark):
    # a third of all rows is one text: it is the broadcast group, the rest is joined
    rows = [(i, "same text" if i % 3 == 0 else f"text {i // 2}", None, None, None) for i in range(6000)]
    found = exact_dedup.exact_groups(spark.createDataFrame(rows, DOCS))
    assert {tuple(r) for r in found.collect()} == brute(rows)


def test_null_ids_ties_and_repeated_rows(spark):
    rows = [(None, "a b", None, None, 1), (7, "ab", None, None, 1), (7, "ab", None, None, 2), (4, "a b", None, None, 3), (None, "z", None, None, 4)]
    docs = spark.createDataFrame(rows, DOCS)
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()}
    assert found == {(None, 4, 4, False), (7, 4, 4, False), (4, 4, 4, True), (None, None, 1, True)}
    twice = spark.createDataFrame([(7, "ab", None, None, 2)] * 5, DOCS)
    assert [r.kept for r in exact_dedup.exact_groups(twice).collect()] == [True] * 5
    assert exact_dedup.exact_dedup(twice).count() == 1


def test_empty_and_clashing_columns(empty, docs):
    assert exact_dedup.exact_groups(empty).collect() == []
    assert exact_dedup.exact_dedup(empty).collect() == []
    clash = docs.withColumns({"kept": F.lit("x"), "text_sha256": F.lit(1), "group_size": F.lit(None), "__n": F.lit(2)})
    found = exact_dedup.exact_dedup(clash)
    assert found.columns == clash.columns
    assert {r.kept for r in found.collect()} == {"x"}
    assert found.count() == exact_dedup.exact_dedup(docs).count()


def test_plan_is_native_and_texts_do_not_move(docs):
    plan = exact_dedup.exact_groups(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
