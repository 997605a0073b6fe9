"""The corpus pipeline against a brute-force version, and the registered queries' contracts."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerline.llm import queries
from tests.llm.conftest import DOCS, components, corpus, sentence
from tests.llm.test_exact_dedup import brute as exact_brute
from tests.llm.test_mixing import brute as mix_brute
from tests.llm.test_quality_rules import brute as rules_brute
from tests.llm.test_simhash import brute_fingerprint

SMALL = "/root/testdata/sf0.001"


def long_corpus() -> list[tuple]:
    """``corpus`` with more texts that pass the rules, copies of them, and near copies."""
    rng = random.Random(21)
    rows = corpus(80)
    for i in range(150):
        words = [f"{w}{rng.randint(0, 999)}" for w in sentence(rng, rng.randint(60, 200)).split()]
        text = " ".join(words)
        rows.append((1000 + 4 * i, text, "en", rng.choice("abc"), len(text)))
        if i % 5 == 0:
            rows.append((1001 + 4 * i, text.replace(" ", "  ", 4), "en", "d", 0))
        if i % 7 == 0:
            rows.append((1002 + 4 * i, text + " end", "en", None, 0))
    return rows


def brute_run(rows) -> Counter:
    """(doc_id -> copies) of the documents that reach the packing."""
    rows = [r for r in rows if rules_brute(r[1])[-1]]
    stays = {r[0] for r in exact_brute(rows) if r[3]}
    rows = [r for r in rows if r[0] in stays]
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows}
    best = components(fps)
    rows = [r for r in rows if best[r[0]] == r[0]]
    size, _, _, taken = mix_brute(rows)
    return Counter({r[0]: taken[i] // size[i] for i, r in enumerate(rows) if taken[i]})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(long_corpus(), DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_run_matches_brute_force(spark, folder, tokenizer):
    found = corpus_pipeline.run(spark, folder).collect()
    copies = brute_run(long_corpus())
    t = Tokenizer.from_file(tokenizer)
    text = {r[0]: r[1] for r in long_corpus()}
    seen = Counter()
    for r in found:
        ids = [*t.encode(text[r.doc_id], add_special_tokens=False).ids, 2]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        seen[r.doc_id] += r.length
    assert {d: n / (len(t.encode(text[d], add_special_tokens=False).ids) + 1) for d, n in seen.items()} == copies
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_an_empty_table(spark, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").collect() == [], name


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles_on_small_tables(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    found = queries.QUERIES[name](spark, SMALL)
    cur = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(cur.fetchall())


def test_one_query_per_operator(spark):
    numbers = sorted(int(m[1]) for n in queries.QUERIES if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 14)) and "pipeline" in queries.QUERIES
