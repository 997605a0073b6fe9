"""Token ids of texts by the ``tokenizers`` library, in flat little-endian integers."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: a Python worker remembers the ids of at most twice as many words (about 140 bytes each)
CACHE_WORDS = 150_000
#: bytes of the longest word that is remembered
LONGEST_CACHED = 64
#: Letters before this one are their own composed form.
LATIN_END = "\u0250"


def byte_alphabet() -> dict[int, str]:
    """The character by which byte-level tokenizers write each byte: printable ones stand for
    themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


ALPHABET = byte_alphabet()
#: ASCII punctuation between a digit or small letter and white space: a piece of its own
MARKS_AFTER = "([0-9a-zß-öø-įı-ɏ])([!-/:-@\\[-`{-~]+)([ \t\n\x0b\f\r]|$)"


def letters(text: str) -> str | None:
    """A word of Latin letters only as the model sees it: lower-cased, in the byte alphabet; else None."""
    if text.isascii():
        return text if text.isalpha() else None
    if not text.isalpha() or max(text) >= LATIN_END:
        return None
    text = text.lower()
    return text.encode().decode("latin-1").translate(ALPHABET) if text.isalpha() else None


class _WordIds(dict):
    """Ids, as bytes, of a run of non-space bytes; filled on first use. When full, the words
    become the older half, from which those still in use come back without being encoded again.

    A word of letters only is left alone by the pre-tokenizer, so the model can be asked directly."""

    def __init__(self, tokenizer: Tokenizer, dtype: np.dtype):
        super().__init__()
        self.tokenizer, self.model, self.dtype = tokenizer, tokenizer.model, dtype
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            text = word.decode()
            plain = letters(text)
            found = self.tokenizer.encode(text, add_special_tokens=False).ids if plain is None else [t.id for t in self.model.tokenize(plain)]
            ids = struct.pack(f"<{len(found)}{self.dtype.char}", *found)
        if len(word) > LONGEST_CACHED:
            return ids
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Whole texts to ids. ``word_level`` says that the tokenizer lower-cases, drops white
    space, joins nothing across it and separates letters from punctuation, as
    ``word_bpe_49k.json`` does: then the words of many texts are looked up once each."""

    def __init__(self, path: str, word_level: bool):
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.words = _WordIds(self.tokenizer, self.dtype) if word_level else None

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts (null: empty), each followed by ``end_id``, one after another,
        and the offsets of the texts in them (one more than texts)."""
        texts = pc.fill_null(texts, "")
        if self.words is None:
            found = [self._plain(t.as_py()) for t in texts]
        else:
            # a special token may lie across or inside words
            special = pc.match_substring(texts, "<|")
            ids, offsets = self._words(pc.if_else(special, "", texts), end_id)
            if not pc.any(special).as_py():
                return ids, offsets
            found = [
                self._plain(t.as_py()) if s else ids[a : b - 1]
                for t, s, a, b in zip(texts, special.to_pylist(), offsets[:-1], offsets[1:])
            ]
        end = np.array([end_id], self.dtype)
        offsets = np.cumsum([0, *(len(f) + 1 for f in found)], dtype=np.int64)
        return np.concatenate([x for f in found for x in (f, end)] or [end[:0]]), offsets

    def _words(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.replace_substring_regex(pc.ascii_lower(texts), MARKS_AFTER, r"\1 \2\3")
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().cast(pa.binary()).dictionary_encode()
        known = list(map(self.words.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)))
        each = np.array([len(k) for k in known], np.int64) // self.dtype.itemsize
        starts = np.cumsum(each) - each
        code = words.indices.to_numpy()
        n = each[code]
        sums = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(starts[code] - sums[:-1], n) + np.arange(sums[-1])
        ids = np.frombuffer(b"".join(known), self.dtype)[at]
        ends = sums[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))


@lru_cache(maxsize=1)
def encoder(path: str, word_level: bool) -> Encoder:
    """The worker's encoder; it outlives a task, and so do the words it knows."""
    return Encoder(path, word_level)
