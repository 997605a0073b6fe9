from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerline.llm import simhash
from tests.llm.conftest import DOCS, WORDS, components, corpus, sentence


def brute_fingerprint(text: str | None, shingle: int = 3) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [words[i : i + shingle] for i in range(len(words) - shingle + 1)] or [words]
    hashes = [xxhash.xxh64(" ".join(g).encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "Éa b c d", sentence(random.Random(1), 500), "a b c " * 40])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_counts_in_chunks(monkeypatch):
    text = sentence(random.Random(2), 700)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text) == whole


def test_spark_hash_is_the_same(spark):
    # the contract's hash is also what Spark's xxhash64 gives
    row = spark.range(1).select(F.xxhash64(F.lit("über drei worte")).alias("h")).first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest("über drei worte".encode(), 42)


def test_components_match_brute_force(docs):
    fps = {r[0]: brute_fingerprint(r[1]) for r in corpus()}
    want = components(fps)
    found = simhash.near_duplicates(docs)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert {tuple(r) for r in found.collect()} == {(i, f"{fps[i]:016x}", want[i]) for i in fps}
    stays = sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect())
    assert stays == sorted(set(want.values()))


def fingerprint_rows(seed: int) -> list[int]:
    """Distinct fingerprints at chosen distances: balls around centres, long chains, random ones."""
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1}
    for _ in range(4):
        centre = rng.getrandbits(64)
        out.add(centre)
        for _ in range(25):
            x = centre
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << bit
            out.add(x)
    link = rng.getrandbits(64)
    for _ in range(30):
        for bit in rng.sample(range(64), 3):
            link ^= 1 << bit
        out.add(link)
    out.update(rng.getrandbits(64) for _ in range(40))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_ball_hashing_loses_no_link(spark, seed):
    fps = fingerprint_rows(seed)
    signed = {simhash._signed(f): f for f in fps}
    table = spark.createDataFrame([(s,) for s in signed], "__fp long")
    want = components({s: f for s, f in signed.items()})
    near = {s for s in signed if sum((signed[s] ^ f).bit_count() <= 3 for f in fps) > 1}
    crowded = {r[0] for r in simhash.crowded(table).collect()}
    assert near <= crowded
    edges = simhash.links(simhash.crowded(table))
    for a, b in edges.collect():
        assert (signed[a] ^ signed[b]).bit_count() <= 3
    labels = {r.node: r.label for r in simhash.components(edges).collect()}
    assert {s: labels.get(s, s) for s in signed} == want


def test_components_of_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)], "a long, b long")
    found = {r.node: r.label for r in simhash.components(edges).collect()}
    assert found == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}


def test_null_ids_repeated_rows_and_empty_texts(spark, empty):
    rows = [(None, "same text here now", None, None, 1), (9, "same text here now", None, None, 2), (9, "same text here now", None, None, 3)]
    rows += [(5, None, None, None, 4), (4, "", None, None, 5), (None, "other words far away from it", None, None, 6)]
    docs = spark.createDataFrame(rows, DOCS)
    found = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect() if r.component_id is not None)
    assert found == [(False, 4, 4), (False, 5, 4), (False, 9, 9), (False, 9, 9), (True, 0, 9)]
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == [(-1, "other words far away from it"), (4, ""), (9, "same text here now")]
    assert simhash.near_duplicates(empty).collect() == [] and simhash.drop_near_duplicates(empty).collect() == []


def test_one_hot_group(spark):
    rng = random.Random(4)
    rows = [(i, "one and the same text" if i % 3 == 0 else sentence(rng, 12) + f" {WORDS[i % 5]}{i}", None, None, None) for i in range(3000)]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(found) == 3000 and all(found[i] == 0 for i in range(0, 3000, 3))


def test_clashing_columns_are_carried(docs):
    clash = docs.withColumns({"fingerprint": F.lit("x"), "label": F.lit(1), "__fp": F.lit(None).cast("int"), "a b": F.lit(2)})
    found = simhash.drop_near_duplicates(clash)
    assert found.dtypes == clash.dtypes and {r.fingerprint for r in found.collect()} == {"x"}
