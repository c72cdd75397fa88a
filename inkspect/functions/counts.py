"""Counts inside one text by Arrow batches, where expressions would sort all its words or characters.

Texts come as bytes; what is no UTF-8 keeps its bytes. ``str.split`` parts words at the same
characters as ``text.tokens``. Like the repairs, the functions are marked non-deterministic, so that Catalyst
doesn't copy them.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMO_WORDS = 300_000
INTEGERS = T.ArrayType(T.IntegerType())


class _Hashes(dict):
    """First 32 bits of a word's md5, found once per worker."""

    def __missing__(self, word: str) -> int:
        value = int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogateescape")).digest()[:4], "big")
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = value
        return value


_hashes = _Hashes()


def _words(text: bytes) -> list[str]:
    return text.decode("utf-8", "surrogateescape").split()


def _lists(values: list, known: list[bool]) -> pa.Array:
    """Integer arrays as a list array, null where not known."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int32)
    mask = pa.array([not k for k in known], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)), mask=mask)


def entropy_of(text: bytes) -> float:
    """Bits per character, 0 without characters."""
    chars = text.decode("utf-8", "surrogateescape")
    if not chars:
        return 0.0
    if chars.isascii():
        n = np.bincount(np.frombuffer(text, np.uint8))
        n = n[n > 0]
    else:
        n = np.unique(np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)[1]
    return float(np.log2(float(len(chars))) - (n * np.log2(n)).sum() / len(chars))


@F.arrow_udf(T.DoubleType())
def char_entropy(texts: pa.Array) -> pa.Array:
    return pa.array([entropy_of(t or b"") for t in texts.to_pylist()], pa.float64())


@F.arrow_udf(INTEGERS)
def word_frequencies(texts: pa.Array) -> pa.Array:
    """How often each distinct word of a text occurs, in no order."""
    found = texts.to_pylist()
    rows = [np.fromiter(Counter(_words(t)).values(), np.int32) if t else np.zeros(0, np.int32) for t in found]
    return _lists(rows, [t is not None for t in found])


def bucket_counts(dims: int):
    """Words of a text per md5 bucket, as a dense array."""

    @F.arrow_udf(INTEGERS)
    def counts(texts: pa.Array) -> pa.Array:
        found = texts.to_pylist()
        rows = []
        for t in found:
            words = _words(t) if t else []
            at = np.fromiter(map(_hashes.__getitem__, words), np.int64, len(words)) % dims
            rows.append(np.bincount(at, minlength=dims).astype(np.int32))
        return _lists(rows, [t is not None for t in found])

    return counts.asNondeterministic()


char_entropy = char_entropy.asNondeterministic()
word_frequencies = word_frequencies.asNondeterministic()
