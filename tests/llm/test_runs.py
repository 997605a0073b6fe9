from __future__ import annotations

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import runs
from ledgerline.llm.queries import with_planted_runs


def brute(words, shortest=6, exponent=4):
    """Every maximal stretch of every distance, without those of a smaller period."""
    n, out = len(words), []
    for q in range(1, n):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            begin = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            smaller = any(q % d == 0 and all(words[k] == words[k - d] for k in range(begin + d, i)) for d in range(1, q))
            if i - begin >= max(shortest, exponent * q) and not smaller:
                out.append((begin, i - begin, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


word = st.integers(0, 2)
repeated = st.tuples(st.lists(word, min_size=1, max_size=12), st.integers(1, 90)).map(lambda t: (t[0] * 90)[: t[1]])
texts = st.lists(st.one_of(repeated, st.lists(st.integers(0, 9), max_size=8)), max_size=6).map(lambda parts: [w for p in parts for w in p])


@settings(max_examples=600, deadline=None)
@given(texts)
def test_equals_brute_force(words):
    assert runs.find_runs(words) == brute(words)


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(1, 4))
def test_repeated_whole_texts_equal_brute_force(words, times):
    words = words[:60] * times * 2
    assert runs.find_runs(words) == brute(words)


@settings(max_examples=100, deadline=None)
@given(texts, st.lists(st.integers(1, 9), min_size=1, max_size=9))
def test_words_may_come_in_any_portions(words, portions):
    catcher, at = runs.SquareCatcher(), 0
    while at < len(words):
        n = portions[at % len(portions)]
        catcher.extend(words[at : at + n])
        at += n
        assert catcher.runs() == brute(words[:at])


def test_time_is_near_linear_on_repetitive_texts():
    fib = ["a"], ["a", "b"]
    while len(fib[1]) < 60_000:
        fib = fib[1], fib[1] + fib[0]
    hard = (["a"] * 60_000, (["a"] * 15_000 + ["c"]) * 4, ["a", "b"] * 30_000, fib[1][:60_000], ["a"] * 30_000 + ["c"] + ["a"] * 30_000)
    for words in hard:
        began = time.process_time()
        runs.find_runs(words)
        assert time.process_time() - began < 20  # some 2 s; comparing at every distance takes hours


def test_fewer_periods_are_refused():
    with pytest.raises(ValueError):
        runs.find_runs(["a"], exponent=2)


def expected(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    found = brute(words)
    return found, " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found))


def test_rows_with_nulls_ties_and_clashing_names(spark):
    texts = [None, "", " \n", "a a a a a a", "a b a b a b a b\tx x x x x x x", "é é é é " * 5, "x " * 5000 + "y", "a a a a a a"]
    rows = [(i if i else None, t, f"r{i}", t) for i, t in enumerate(texts)] + [(3, texts[3], "again", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, __t string").repartition(3)
    out = runs.periodic_runs(docs, carry=("doc_id", "text", "runs", "__t"))
    assert out.columns == ["doc_id", "text", "__t", "runs", "collapsed"]  # a result column wins over a carried one
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert ([tuple(x) for x in r["runs"]], r["collapsed"]) == expected(r["text"])


def test_planted_texts(spark, docs):
    import zlib

    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in with_planted_runs(docs).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", rows[r["doc_id"]] or "")
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 or not n:
            assert r["text"] == rows[r["doc_id"]]
            continue
        a, g = h // 10 % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        assert r["text"] == " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))


def test_empty_table(empty):
    assert runs.periodic_runs(empty).collect() == []
