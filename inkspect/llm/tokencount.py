"""Token counts of a unigram vocabulary, by dynamic programming over a trie of words.

Distinct pre-tokens (words between white space, with the piece mark in front) are inserted in
a trie. Each node holds the best score of its prefix and how many pieces that takes, so a
prefix that words share is computed once; the node where a word ends holds its count.
Pieces of a public vocabulary are scored by rank, -ln(rank + 2); characters outside it
fall back to their UTF-8 bytes. Ties go to fewer pieces.

Every Python worker keeps a trie of bounded size; nothing is shuffled.

Defined cases: a null or empty text has no tokens; repeated rows and null ids give a row each.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from inkspect.llm.common import id_text, map_chunks

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
# Nodes of a worker's trie, and words with known counts, before it starts anew; longer words don't enter it.
MOST_NODES = 400_000
MOST_WORDS = 400_000
LONGEST = 128
# Pieces are looked up by their last characters, which tell the lengths that can end there.
TAIL = 3


@lru_cache(maxsize=4)
def pieces(path: str | None = None) -> tuple[dict[str, float], float]:
    """Scores of the pieces, and the score of a byte that stands for part of an unknown character."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = {model.id_to_piece(i): -math.log(rank + 2) for rank, i in enumerate(plain)}
    return scores, -math.log(len(plain) + 2) - 1.0


class Trie(dict):
    """Token count by word; a word that is not there yet is inserted and computed."""

    def __init__(self, scores: dict[str, float], byte: float):
        super().__init__()
        self.scores, self.byte = scores, byte
        lengths: dict[str, set[int]] = {}
        for piece in scores:
            if len(piece) > TAIL:
                lengths.setdefault(piece[-TAIL:], set()).add(len(piece))
        self.lengths = {tail: tuple(sorted(found)) for tail, found in lengths.items()}
        self.start()

    def start(self) -> None:
        """Forget the nodes; the counts of words stay while they are few."""
        if len(self) > MOST_WORDS:
            self.clear()
        self.child: dict[tuple[int, str], int] = {}
        self.best = [(0.0, 0)]

    def _step(self, word: str, d: int, before: list[tuple[float, int]]) -> tuple[float, int]:
        """Best (score, -pieces) of the first ``d`` characters, given those of shorter prefixes."""
        get, best = self.scores.get, None
        longer = self.lengths.get(word[d - TAIL : d], ()) if d > TAIL else ()
        for k in (*range(1, min(TAIL, d) + 1), *longer):
            s = get(word[d - k : d]) if k <= d else None
            if s is not None:
                score, n = before[d - k]
                found = (score + s, n - 1)
                if best is None or found > best:
                    best = found
        if best is None or get(word[d - 1]) is None:
            n = len(word[d - 1].encode("utf-8", "replace"))
            found = (before[d - 1][0] + n * self.byte, before[d - 1][1] - n)
            best = found if best is None or found > best else best
        return best

    def __missing__(self, word: str) -> int:
        marked = MARK + word
        forward = [self.best[0]]
        if len(marked) > LONGEST:
            for d in range(1, len(marked) + 1):
                forward.append(self._step(marked, d, forward))
            return -forward[-1][1]
        node = 0
        for d, c in enumerate(marked, 1):
            after = self.child.get((node, c))
            if after is None:
                after = self.child[node, c] = len(self.best)
                self.best.append(self._step(marked, d, forward))
            node = after
            forward.append(self.best[node])
        self[word] = -self.best[node][1]
        return self[word]


@lru_cache(maxsize=4)
def _trie(path: str | None) -> Trie:
    return Trie(*pieces(path))


def count(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_tokens)."""

    def run(part: pa.RecordBatch) -> dict:
        trie = _trie(path)
        if len(trie.best) > MOST_NODES or len(trie) > MOST_WORDS:
            trie.start()
        words = [(t or "").split() for t in part.column("text").to_pylist()]
        return {"doc_id": part.column("id"), "n_words": [len(w) for w in words], "n_tokens": [sum(map(trie.__getitem__, w)) for w in words]}

    return map_chunks(id_text(docs, id_col, text_col), run, {"doc_id": "bigint", "n_words": "bigint", "n_tokens": "bigint"})
