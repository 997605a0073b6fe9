"""Token files and packing, held against the plain tokenizer."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm import packing, token_files
from ledgerline.llm.common import new_path
from ledgerline.llm.tokens import Encoder
from tests.llm.conftest import DOCS, corpus


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def plain(tokenizer: str, rows, end_id: int) -> dict:
    t = Tokenizer.from_file(tokenizer)
    return {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, end_id] for r in rows}


TEXTS = [
    "It's WE'VE they'll'd 'tis don''t", "x.y,z!! ###$$$ a-b", "Éé É İstanbul ǅ ß ﬁ Σίσυφος", "12 3.4 5a6 ٣", "中文字 かな 한국어",
    "a b c\x1cd\x85e", "́start ‍ zero​width", "emoji 👩‍👩‍👧!? 🇩🇪", "<|endoftext|> <|startoftext|>x", "x" * 3000, "A.B.C. (d) [e] {f}_g^h~i`",
    "word—dash… “quotes” ’s 's", "é, ö. a̧!!", "9,9 a9, 9a.", "\x00\x01 ctrl\x7f",
]


@pytest.mark.parametrize("text", TEXTS)
def test_word_by_word_equals_whole_text(tokenizer, text):
    want = [*Tokenizer.from_file(tokenizer).encode(text, add_special_tokens=False).ids, 2]
    for word_level in (True, False):
        ids, ends = Encoder(tokenizer, word_level).encode(pa.array([None, text, ""]), 2)
        assert ids.tolist() == [2, *want, 2] and ends.tolist() == [0, 1, 1 + len(want), 2 + len(want)]


def test_random_texts_word_by_word(tokenizer):
    rng = random.Random(8)
    pool = [chr(c) for c in [*range(9, 14), *range(32, 127), 0xE9, 0xDF, 0x130, 0x301, 0x2019, 0x4E2D, 0x1F600, 0xA0, 0xAD]]
    whole, parts = Encoder(tokenizer, False), Encoder(tokenizer, True)
    for _ in range(40):
        texts = pa.array(["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(10)])
        for one, other in zip(whole.encode(texts, 1), parts.encode(texts, 1)):
            assert one.tolist() == other.tolist(), repr(texts)


def test_words_with_marks_and_letters_of_many_kinds(tokenizer):
    rng = random.Random(9)
    pool = list("abcXYZ019.,;:!?\"()-_<>|éÉßẞñçÀŸİıŉǰªºµ½²…“”—\u0301\u0308Åﬁ中Σσςǅɐ℃ \u200b\xad\x00\x85\x1c")
    pool += ["'", "'s", "'ll", " ", "\n", "<|endoftext|>", "word", "Straße", "naïve", "e\u0301", "I\u0307"]
    texts = pa.array(["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(8000)])
    for one, other in zip(Encoder(tokenizer, False).encode(texts, 7), Encoder(tokenizer, True).encode(texts, 7)):
        assert one.tolist() == other.tolist()


def test_no_texts(tokenizer):
    for word_level in (True, False):
        ids, ends = Encoder(tokenizer, word_level).encode(pa.array([], pa.string()), 2)
        assert ids.tolist() == [] and ends.tolist() == [0]


def test_full_cache_is_emptied(tokenizer, monkeypatch):
    from ledgerline.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    enc = Encoder(tokenizer, True)
    for text in ("alpha, beta. gamma delta! alpha, epsilon", "zeta eta alpha beta theta"):
        text = pa.array([text])
        assert enc.encode(text, 1)[0].tolist() == Encoder(tokenizer, False).encode(text, 1)[0].tolist()
    assert len(enc.words) <= 3


def test_files_round_trip(spark, docs, tokenizer):
    path = new_path(spark, "test-files")
    manifest = token_files.write_token_files(docs, path, tokenizer, 1, word_level=True)
    want = plain(tokenizer, corpus(), 1)
    assert manifest.agg(F.sum("ids")).first()[0] == sum(map(len, want.values()))
    found = {r.doc_id: r for r in token_files.read_token_files(spark, path).collect()}
    start = 0
    for doc_id in sorted(want):
        r = found[doc_id]
        assert (r.start, r.n_tokens) == (start, len(want[doc_id]))
        assert np.frombuffer(r.ids, "<u4").tolist() == want[doc_id]
        start += len(want[doc_id])
    assert len(found) == len(want)


def test_files_without_word_level_use_the_library_alone(spark, tokenizer):
    byte_level = tokenizer.replace("word_bpe_49k", "byte_bpe_50k")
    rows = [(1, "Two  spaces\n\nand lines", None, None, None), (2, None, None, None, None)]
    path = new_path(spark, "test-files")
    token_files.write_token_files(spark.createDataFrame(rows, DOCS), path, byte_level, 50256)
    found = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.read_token_files(spark, path).collect()}
    assert found == plain(byte_level, rows, 50256)


def test_files_left_by_a_lost_attempt_are_not_read(spark, docs, tokenizer):
    path = new_path(spark, "test-files")
    token_files.write_token_files(docs, path, tokenizer, 1, word_level=True)
    folder = path.removeprefix("file:").replace("//", "/")
    with open(f"{folder}/part-000000-lost.bin", "wb") as f:
        f.write(b"half")
    assert token_files.read_token_files(spark, path).count() == docs.count()


def test_files_of_null_ids_repeats_and_empty_tables(spark, empty, tokenizer):
    rows = [(None, "b", None, None, None), (3, "c d", None, None, None), (3, "c d", None, None, None), (-5, None, None, None, None)]
    path = new_path(spark, "test-files")
    token_files.write_token_files(spark.createDataFrame(rows, DOCS), path, tokenizer, 1, word_level=True)
    found = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read_token_files(spark, path).collect())
    assert found == [(0, None, 2), (2, -5, 1), (3, 3, 3), (6, 3, 3)]
    path = new_path(spark, "test-files")
    assert token_files.write_token_files(empty, path, tokenizer, 1).count() == 0
    assert token_files.read_token_files(spark, path).collect() == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cutting_stock_is_valid_and_near_the_bound(seed):
    rng = random.Random(seed)
    demand = {s: rng.randint(1, 4000) for s in rng.sample(range(1, 257), 120)}
    found = packing.cutting_stock(demand, 256)
    taken = defaultdict(int)
    for times, pattern in found:
        assert times > 0 and sum(s * n for s, n in pattern.items()) <= 256
        for s, n in pattern.items():
            taken[s] += times * n
    assert all(taken[s] <= demand[s] for s in demand)
    left = sum(s * (demand[s] - taken[s]) for s in demand)
    assert left <= 256 * len(demand)  # at most a copy of each pattern
    assert sum(t for t, _ in found) <= dual_bound(demand, 256) * 1.003


def dual_bound(demand, capacity):
    """What no packing can do better than: the best of the dual feasible functions that count,
    for a threshold k, sizes over capacity - k as whole sequences and drop those under k."""
    best = 0
    for k in range(capacity // 2 + 1):
        worth = lambda s: 1 if s > capacity - k else 0 if s < k else s / capacity  # noqa: E731, B023
        best = max(best, sum(n * worth(s) for s, n in demand.items()))
    return best


def test_cutting_stock_edges():
    assert packing.cutting_stock({}, 256) == []
    assert packing.cutting_stock({256: 5}, 256) == [(5, {256: 1})]
    assert packing.cutting_stock({100: 7}, 256) == [(3, {100: 2})]
    stopped = packing.cutting_stock({s: 1000 for s in range(1, 200)}, 256, max_pivots=3)
    assert all(sum(s * n for s, n in p.items()) <= 256 for _, p in stopped)


@pytest.mark.parametrize("total", [0, 1, 4095, 4096, 4097, 10000])
def test_rest_is_cut_into_full_sequences_and_powers_of_two(total):
    sizes = defaultdict(int)
    at = 0
    for first, last, k, offset in packing.cut(0, total, total, 4096):
        assert (first, offset) == (at, sizes[k])
        sizes[k] += last - first
        at = last
    assert at == total and all(n & (n - 1) == 0 for n in sizes.values())


def check_packing(rows, want, length):
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == crc(ids[r.start : r.start + r.length])
        covered[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, ids in want.items():
        at = 0
        for start, n in sorted(covered[doc_id]):
            assert start == at and n > 0
            at += n
        assert at == len(ids)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding / sum(map(len, want.values()))


@pytest.mark.parametrize("length,unit", [(4096, 16), (64, 8)])
def test_packing_covers_every_id_once(docs, tokenizer, length, unit):
    want = plain(tokenizer, corpus(), 2)
    found = packing.pack(docs, tokenizer, 2, word_level=True, length=length, unit=unit)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert check_packing(found.collect(), want, length) < 0.12


def test_packing_many_documents_has_little_padding(spark, tokenizer):
    rng = random.Random(6)
    rows = [(i, "stone " * int(rng.lognormvariate(6, 1)), None, None, None) for i in range(1500)]
    found = packing.pack(spark.createDataFrame(rows, DOCS).repartition(4), tokenizer, 2, word_level=True)
    assert check_packing(found.collect(), plain(tokenizer, rows, 2), 4096) < 0.01


def test_packing_of_null_ids_one_hot_length_and_empty_table(spark, empty, tokenizer):
    rows = [(None, None, None, None, None)] * 50 + [(7, "a b", None, None, None)] * 50
    found = packing.pack(spark.createDataFrame(rows, DOCS), tokenizer, 2, word_level=True).collect()
    assert sum(r.length for r in found) == 50 + 150
    assert len({(r.sequence_id, r.offset) for r in found}) == len(found)
    assert packing.pack(empty, tokenizer, 2).collect() == []


@pytest.mark.parametrize("words", [0, 10, 40])
def test_packing_of_short_rows_has_little_padding(spark, tokenizer, words):
    rows = [(i, "stone " * words, None, None, None) for i in range(20000)]
    found = packing.pack(spark.createDataFrame(rows, DOCS).repartition(2), tokenizer, 2, word_level=True).collect()
    share = check_packing(found, plain(tokenizer, rows, 2), 4096)
    assert share < 0.06, share
    ids = sum(r.length for r in found)
    assert len({r.sequence_id for r in found}) <= ids / 4096 * 1.06 + 12  # the rest's powers of two
