"""Byte-level subword ids from a public vocabulary file, loaded once per Python worker.

The vocabulary of ``byte_bpe_50k`` comes in two files with the same ids; the ranks
file is read with the faster library. ``encoder`` takes a mark such as an end-of-text string
inside a document as ordinary text; ``marking_encoder`` gives it its own id, as the
library of the JSON file does.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

VOCABULARY = "byte_bpe_50k.tiktoken"
MARKED_VOCABULARY = "byte_bpe_50k.json"


@lru_cache(maxsize=4)
def encoder(path: str | None = None):
    """Function from a text to its ids. ``path`` names a ranks file, by default the public one."""
    import public_tokenizers
    import tiktoken

    ranks = {}
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    made = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return made.encode_ordinary


@lru_cache(maxsize=4)
def marking_encoder(path: str | None = None):
    """Function from a text to its ids, where the vocabulary's added tokens stand for themselves.

    ``path`` names a ranks file; the added tokens are those of the JSON file of the same vocabulary.
    """
    import public_tokenizers

    plain = encoder(path)
    with open(public_tokenizers.path(MARKED_VOCABULARY), encoding="utf-8") as file:
        marks = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    if not marks:
        return plain
    # Longest first, so that no mark hides a longer one.
    found = re.compile("(" + "|".join(map(re.escape, sorted(marks, key=len, reverse=True))) + ")")

    def encode(text: str) -> list[int]:
        if not any(m in text for m in marks):
            return plain(text)
        ids: list[int] = []
        for part in found.split(text):
            ids += [marks[part]] if part in marks else plain(part)
        return ids

    return encode
