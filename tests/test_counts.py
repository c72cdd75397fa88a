import collections
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from inkspect.functions import counts
from inkspect.operators import blocks, profile


def test_counts_of_a_text_are_those_of_its_sorted_words(texts):
    """Words part at all white space, in any script; what is no word or no text counts as before."""
    spaced = "a B b\x1cb   café \U0001f600 b"
    df = texts(spaced, "", " \t", None, "x" * 3 + " x")
    rows = df.select("doc_id", counts.word_frequencies(F.col("text").cast("binary")).alias("n"))
    assert {r.doc_id: r.n and sorted(r.n) for r in rows.collect()} == {0: [1, 1, 1, 1, 3], 1: [], 2: [], 3: None, 4: [1, 1]}
    found = {r.doc_id: r.tf for r in blocks.term_frequencies(df).collect()}
    assert found[3] is None and sum(found[0]) == 7 and sum(found[4]) == 2
    assert found[0][int(hashlib.md5(b"b").hexdigest()[:8], 16) % 384] >= 4  # B in lower case as well
    n = collections.Counter(spaced).values()
    bits = -sum(c / len(spaced) * math.log2(c / len(spaced)) for c in n)
    got = {r.doc_id: r.char_entropy for r in profile.add_char_entropy(df).collect()}
    assert got[0] == pytest.approx(bits) and got[1] == got[3] == 0 and got[4] == pytest.approx(0.7219280948873623)
