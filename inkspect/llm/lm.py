"""Language-model scores: a unigram base and a causal self-attention model on subword ids.

Both learn from the documents whose crc32 of the id is not ``HELD_OUT`` modulo ``FOLDS``.

Texts are split into words and ids once; ids (2 bytes) and word hashes (8 bytes) are stored in
the shared folder, and counting, training and scoring read these.

Base: word counts over all training documents. Counting is pre-aggregated in each task
and keyed by 64-bit word hashes. The commonest words (at most ``COMMON``) are broadcast; the
rarer words of a text, known or not, are looked up by a join, so no count is left out.

Attention model (numpy): each word's subword ids follow each other, as the closing id
does. Every id of the training documents has its own embedding and its own output weights.
The next id is predicted as p(class | h) p(id | class, h): the commonest ids are classes of
their own, the rest lie in groups of like frequency whose number grows with the square
root of the ids, and both factors are softmaxes over the hidden state h whose priors are the id
counts of all training documents. Ids that no training document holds share one embedding
and one class. The network (embeddings, positions, one masked attention layer and one hidden layer
with residuals) sees every id of the training documents: in each round every
partition streams its share of the rows through mini-batches, and Spark averages the
partitions' weights row by row. Windows of ``WINDOW`` ids advance by ``STRIDE`` and each id
is scored once, with at least ``WINDOW - STRIDE`` ids before it where the text has them.

Defined cases: a null or empty text is the closing token alone; repeated rows and null
ids give a row each (a null id counts as training, its crc32 being null); without
training documents all counts are 0, the base score of a token is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspect.llm.common import crc_mod, id_text, joined_small, text_chunks
from inkspect.llm.subwords import encoder
from inkspect.session import discard, staged

FOLDS = 7
HELD_OUT = 2
COMMON = 500_000
IDS = 50_257
END = 50_256
# The commonest ids, each a class of its own.
ALONE = 16
DIM = 16
HIDDEN = 32
WINDOW = 32
STRIDE = 24
BATCH = 64
# Windows scored at a time: their arrays stay in the processor's cache.
SCORED = 48
# Batches of windows whose positions are settled together.
SETTLES = 32
ROUNDS = 3
# Training windows that a partition holds and shuffles at a time.
HELD = 16_384
RATE = 0.01
TABLE_RATE = 0.1
# Steps after which the rate has fallen by a factor of the square root of two.
SETTLED = 300
MEMO = 300_000
LOG10 = float(np.log10(np.e))


class Words:
    """Words seen by a Python worker: number, hash and subword ids of each."""

    def __init__(self, path: str | None):
        self.encode = encoder(path)
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.hash = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.begin = np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        """Word numbers of each text; new words get their hash and ids."""
        if len(self.number) > MEMO:
            self.clear()
        new: list[bytes] = []
        known = self.number
        out = []
        for text in texts:
            words = (text or "").encode("utf-8", "replace").lower().split()
            row = []
            for w in words:
                k = known.get(w)
                if k is None:
                    k = known[w] = len(known)
                    new.append(w)
                row.append(k)
            out.append(np.array(row, dtype=np.int64))
        if new:
            ids = [self.encode(" " + w.decode("utf-8", "replace")) for w in new]
            size = np.array([len(i) for i in ids], dtype=np.int64)
            self.hash = np.concatenate([self.hash, np.array([xxhash.xxh3_64_intdigest(w) >> 1 for w in new], dtype=np.int64)])
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, np.array([t for i in ids for t in i], dtype=np.int32)])
        return out

    def ids(self, row: np.ndarray) -> np.ndarray:
        """Subword ids of a text, with the closing id."""
        size = self.size[row]
        total = int(size.sum())
        at = np.repeat(self.begin[row] - (np.cumsum(size) - size), size) + np.arange(total)
        return np.append(self.flat[at], np.int32(END))


def prepared(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (uid, id, held_out, ids, words) of an (id, text) table, stored: subword ids in 2 bytes each, word hashes in 8."""
    schema = pa.schema([("uid", pa.int64()), ("id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("words", pa.binary())])

    def run(batches):
        lexicon, uid = Words(path), TaskContext.get().partitionId() << 33
        for chunk in text_chunks(batches):
            numbers = lexicon.numbers(chunk.column("text").to_pylist())
            ids = [lexicon.ids(row).astype("<u2").tobytes() for row in numbers]
            words = [lexicon.hash[row].astype("<i8").tobytes() for row in numbers]
            uids = pa.array(np.arange(uid, uid + chunk.num_rows))
            uid += chunk.num_rows
            columns = [uids, chunk.column("id"), chunk.column("held_out"), pa.array(ids, pa.binary()), pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    held = F.coalesce(crc_mod(F.col("id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    ddl = "uid bigint, id bigint, held_out boolean, ids binary, words binary"
    return staged(docs.select("id", "text", held).mapInArrow(run, ddl), "lm-ids")


def _hashes(chunk: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(w, "<i8") for w in chunk.column("words").to_pylist()]


def _ids(chunk: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(i, "<u2").astype(np.int64) for i in chunk.column("ids").to_pylist()]


def counts(rows: DataFrame) -> DataFrame:
    """Rows (kind, key, n) over the training rows of a prepared table: 0 words by hash, 1 subword ids, 2 documents."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def tally(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], schema=schema)

    def run(batches):
        documents, ids = 0, np.zeros(IDS, np.int64)
        for chunk in text_chunks(batches, "words"):
            documents += chunk.num_rows
            yield tally(0, *np.unique(np.concatenate(_hashes(chunk)), return_counts=True))
            for row in _ids(chunk):
                ids += np.bincount(row, minlength=IDS)
        seen = np.flatnonzero(ids)
        yield tally(1, seen.astype(np.int64), ids[seen])
        yield tally(2, np.zeros(1, np.int64), np.array([documents], np.int64))

    found = rows.filter("not held_out").select("ids", "words").mapInArrow(run, "kind int, key bigint, n bigint")
    return staged(found.groupBy("kind", "key").agg(F.sum("n").alias("n")), "word-counts")


class Vocabulary(NamedTuple):
    """Ids by rank of frequency: ``alone`` classes of one id, ``groups`` of ``size`` ids, one class of the ids never seen."""

    rank: np.ndarray  # of each id; all ids never seen share the rank ``seen``
    seen: int
    alone: int
    groups: int
    size: int
    class_prior: np.ndarray
    leaf_prior: np.ndarray  # log p(id | group), by group and place
    unseen: float  # log p(id | never seen)

    def class_of(self, rank: np.ndarray) -> np.ndarray:
        inside = self.alone + (rank - self.alone) // max(self.size, 1)
        return np.where(rank < self.alone, rank, np.where(rank < self.seen, inside, self.alone + self.groups))


def vocabulary(id_counts: np.ndarray) -> Vocabulary:
    """Classes and priors from the id counts of all training documents.

    There are about as many groups as a group has ids. The ids never seen together have the
    probability of an id seen once (Good and Turing) and are alike among themselves.
    """
    seen = int((id_counts > 0).sum())
    order = np.argsort(-id_counts, kind="stable")
    rank = np.full(IDS, seen, np.int64)
    rank[order[:seen]] = np.arange(seen)
    alone = min(ALONE, seen)
    size = math.ceil(math.sqrt(seen - alone))
    groups = -(-(seen - alone) // size) if size else 0
    n = id_counts[order[:seen]].astype(float)
    mass = np.zeros((groups, size))
    mass.ravel()[: seen - alone] = n[alone:]
    total = mass.sum(axis=1)
    leaf = np.log(np.maximum(mass, 1e-300) / total[:, None]) if groups else mass
    by_class = np.concatenate([n[:alone], total, [max((n == 1).sum(), 1)]])
    return Vocabulary(
        rank, seen, alone, groups, size, np.log(by_class / by_class.sum()).astype(np.float32),
        np.maximum(leaf, -1e9).astype(np.float32), -math.log(max(IDS - seen, 1)),
    )


_MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
DENSE = ("place", "query", "key", "value", "mix", "up", "down", "top")
TABLES = ("embed", "leaf")


def fresh(v: Vocabulary, seed: int = 11) -> dict[str, np.ndarray]:
    """The network before training, which predicts by the priors. Every weight lies in a row of DIM."""
    rng = np.random.default_rng(seed)
    net = {k: rng.normal(0, DIM**-0.5, (DIM, DIM)) for k in ("query", "key", "value")}
    net |= {"embed": rng.normal(0, 0.3, (v.seen + 2, DIM)), "place": rng.normal(0, 0.1, (WINDOW, DIM)), "up": rng.normal(0, DIM**-0.5, (HIDDEN, DIM))}
    net |= {"mix": rng.normal(0, DIM**-0.5, (DIM, DIM)), "down": np.zeros((HIDDEN, DIM))}
    net |= {"top": np.zeros((len(v.class_prior), DIM)), "leaf": np.zeros((v.groups * v.size, DIM))}
    return {k: w.astype(np.float32) for k, w in net.items()}


def _times(t: np.ndarray, w: np.ndarray) -> np.ndarray:
    """All positions of all windows in one product."""
    return (t.reshape(-1, t.shape[-1]) @ w).reshape(*t.shape[:-1], w.shape[1])


def _attend(net: dict, c: np.ndarray, begin: int = 0) -> tuple:
    """Hidden states, from position ``begin``, of windows of ranks (windows, WINDOW) by masked self-attention and one hidden layer."""
    x = net["embed"][c] + net["place"]
    q, k, v = (_times(x, net[name]) for name in ("query", "key", "value"))
    q = q[:, begin:]
    s = q @ k.transpose(0, 2, 1)
    s *= np.asarray(DIM**-0.5, s.dtype)
    s += _MASK[begin:]
    s -= s.max(axis=2, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(axis=2, keepdims=True)
    m = s @ v
    y = x[:, begin:] + _times(m, net["mix"])
    u = _times(y, net["up"].T)
    np.maximum(u, 0, out=u)
    return x, q, k, v, s, m, y, u, y + _times(u, net["down"])


def _softmax(z: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Log probability of one column of each row; ``z`` becomes the probabilities."""
    rows = np.arange(len(z))
    z -= z.max(axis=1, keepdims=True)
    at = z[rows, hit].copy()
    np.exp(z, out=z)
    total = z.sum(axis=1, keepdims=True)
    z /= total
    return at - np.log(total[:, 0])


def _leaves(net: dict, v: Vocabulary, h: np.ndarray, target: np.ndarray) -> Iterator[tuple]:
    """(group, rows of h, weights of the group, places, probabilities, log p of the target) for each group that is met."""
    inside = np.flatnonzero((target >= v.alone) & (target < v.seen))
    group, place = np.divmod(target[inside] - v.alone, max(v.size, 1))
    order = np.argsort(group, kind="stable")
    edges = np.flatnonzero(np.diff(group[order])) + 1
    for part in np.split(order, edges) if len(order) else ():
        g, rows = int(group[part[0]]), inside[part]
        w = net["leaf"][g * v.size : (g + 1) * v.size]
        p = h[rows] @ w.T + v.leaf_prior[g]
        logp = _softmax(p, place[part])
        yield g, rows, w, place[part], p, logp


def gradients(net: dict, v: Vocabulary, c: np.ndarray, target: np.ndarray, known: np.ndarray) -> tuple[float, dict, dict]:
    """Mean loss over known positions of windows of ranks, gradients of whole matrices, of (rows, their gradients) of tables."""
    x, q, k, value, a, m, y, u, h = _attend(net, c)
    flat = lambda t: t.reshape(-1, t.shape[-1])
    use = np.flatnonzero(known.ravel())
    n = np.float32(max(len(use), 1))
    hidden, t = flat(h)[use], target.ravel()[use]
    p = hidden @ net["top"].T + v.class_prior
    of = v.class_of(t)
    loss = float(_softmax(p, of).sum())
    p[np.arange(len(of)), of] -= 1
    p /= n
    g = {"top": p.T @ hidden}
    back = p @ net["top"]
    groups, leaf = [], []
    for group, rows, w, place, prob, logp in _leaves(net, v, hidden, t):
        loss += float(logp.sum())
        prob[np.arange(len(rows)), place] -= 1
        prob /= n
        back[rows] += prob @ w
        groups.append(group)
        leaf.append(prob.T @ hidden[rows])
    dh = np.zeros_like(h)
    flat(dh)[use] = back
    du = _times(dh, net["down"].T) * (u > 0)
    g["down"], g["up"] = flat(u).T @ flat(dh), flat(du).T @ flat(y)
    dy = dh + _times(du, net["up"])
    g["mix"] = flat(m).T @ flat(dy)
    dm = _times(dy, net["mix"].T)
    da, dv = dm @ value.transpose(0, 2, 1), a.transpose(0, 2, 1) @ dm
    ds = a * (da - (da * a).sum(axis=2, keepdims=True)) * np.float32(DIM**-0.5)
    dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
    dx = dy + _times(dq, net["query"].T) + _times(dk, net["key"].T) + _times(dv, net["value"].T)
    g["query"], g["key"], g["value"] = flat(x).T @ flat(dq), flat(x).T @ flat(dk), flat(x).T @ flat(dv)
    g["place"] = dx.sum(axis=0)
    order = np.argsort(c, axis=None, kind="stable")
    ids = c.ravel()[order]
    first = np.flatnonzero(np.diff(ids, prepend=-1))
    tables = {"embed": (ids[first], np.add.reduceat(flat(dx)[order], first, axis=0))}
    if groups:
        rows = (np.array(groups)[:, None] * v.size + np.arange(v.size)).ravel()
        tables["leaf"] = rows, np.concatenate(leaf)
    return -loss / float(n), g, tables


class Trainer:
    """Adam for matrices, AdaGrad for the rows of tables, over windows of WINDOW + 1 ranks (-1 where there is none), as they come."""

    def __init__(self, net: dict, v: Vocabulary):
        self.net, self.v = {k: w.copy() for k, w in net.items()}, v
        self.first, self.second, self.steps = {k: 0.0 for k in DENSE}, {k: 0.0 for k in DENSE}, 0
        self.squares = {k: np.full_like(net[k], 1e-8) for k in TABLES}
        # In how many steps a row was learnt: its weight in the mean over partitions.
        self.uses = {k: np.zeros(len(net[k]), np.int64) for k in TABLES}

    def learn(self, windows: np.ndarray) -> None:
        at = 0
        while at < len(windows):
            # Short steps first, so that a small partition takes several.
            w = windows[at : at + min(BATCH, 8 + self.steps)]
            at += len(w)
            known = w[:, 1:] >= 0
            _, g, tables = gradients(self.net, self.v, np.maximum(w[:, :-1], 0), np.maximum(w[:, 1:], 0), known)
            self.steps += 1
            rate = RATE / (1 + self.steps / SETTLED) ** 0.5
            for k in DENSE:
                self.first[k] = 0.9 * self.first[k] + 0.1 * g[k]
                self.second[k] = 0.99 * self.second[k] + 0.01 * g[k] ** 2
                first, second = self.first[k] / (1 - 0.9**self.steps), self.second[k] / (1 - 0.99**self.steps)
                self.net[k] -= (rate * first / (np.sqrt(second) + 1e-8)).astype(np.float32)
            for k, (rows, d) in tables.items():
                squares = self.squares[k][rows] + d * d
                self.squares[k][rows] = squares
                self.net[k][rows] -= np.float32(TABLE_RATE) * d / np.sqrt(squares)
                self.uses[k][rows] += 1


def _cut(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of WINDOW + 1 ranks of a text that starts with the start rank; from which position each scores."""
    n = len(sequence) - 1
    starts = np.arange(0, max(n - (WINDOW - STRIDE), 1), STRIDE)
    padded = np.append(sequence, np.full(WINDOW + 1, -1, sequence.dtype))
    return padded[starts[:, None] + np.arange(WINDOW + 1)], np.where(starts == 0, 0, WINDOW - STRIDE)


def _targets(sequence: np.ndarray) -> np.ndarray:
    """Windows of WINDOW + 1 ranks of a text that starts with the start rank; each rank is to be predicted in one of them."""
    starts = np.arange(0, len(sequence) - 1, WINDOW)
    padded = np.append(sequence, np.full(WINDOW + 1, -1, sequence.dtype))
    return padded[starts[:, None] + np.arange(WINDOW + 1)]


def fit(rows: DataFrame, v: Vocabulary) -> dict:
    """Rounds of training on all training rows in every partition of a prepared table.

    Weights are averaged row by row by how much each partition learnt of a row.
    """
    spark = rows.sparkSession
    net = fresh(v)
    names = [*DENSE, *TABLES]
    schema = pa.schema([("name", pa.int32()), ("row", pa.int64()), ("used", pa.float64()), *((f"w{i}", pa.float32()) for i in range(DIM))])
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((net, v))

        def run(batches):
            start, v = shared.value
            trainer, rng = Trainer(start, v), np.random.default_rng(turn)
            windows, held, used = [], 0, 0

            def learn():
                together = np.concatenate(windows)
                trainer.learn(together[rng.permutation(len(together))])

            for chunk in text_chunks(batches, "ids"):
                for ids in _ids(chunk):
                    made = _targets(np.append(v.seen + 1, v.rank[ids]))
                    used += len(ids)
                    # A text of any length goes in slices, so a partition never holds more than HELD windows and a text.
                    for b in range(0, len(made), HELD):
                        windows.append(made[b : b + HELD])
                        held += len(windows[-1])
                        if held >= HELD:
                            learn()
                            windows, held = [], 0
            if held:
                learn()
            for i, name in enumerate(names if used else ()):
                w = trainer.net[name]
                uses = trainer.uses[name] if name in TABLES else np.full(len(w), used)
                rows = np.flatnonzero(uses)
                columns = [pa.array(np.full(len(rows), i, np.int32)), pa.array(rows), pa.array(uses[rows].astype(float))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(w[rows, j]) for j in range(DIM)], schema=schema)

        part = rows.filter("not held_out").filter(F.pmod(F.xxhash64("uid"), F.lit(ROUNDS)) == turn)
        ddl = "name int, row bigint, used double, " + ", ".join(f"w{i} float" for i in range(DIM))
        mean = (F.sum(F.col("used") * F.col(f"w{i}")) / F.sum("used") for i in range(DIM))
        made = part.select("ids").mapInArrow(run, ddl).groupBy("name", "row").agg(*(m.cast("float").alias(f"w{i}") for i, m in enumerate(mean)))
        # As many rows as the network has: at most two for each of the IDS ids, and some hundreds.
        found = made.toPandas()
        for i, name in enumerate(names):
            learnt = found[found["name"] == i]
            net[name][learnt["row"].to_numpy()] = learnt[[f"w{j}" for j in range(DIM)]].to_numpy(dtype=np.float32)
    return net


def text_scores(net: dict, v: Vocabulary, sequences: list[np.ndarray]) -> np.ndarray:
    """Log probability of each sequence of ranks, every id scored once."""
    cut = [_cut(np.append(v.seen + 1, s)) for s in sequences]
    windows = np.concatenate([c[0] for c in cut])
    begin = np.concatenate([c[1] for c in cut])
    owner = np.repeat(np.arange(len(cut)), [len(c[0]) for c in cut])
    out = np.zeros(len(sequences))
    held: list[tuple] = []

    def settle():
        h, t, of = (np.concatenate(part) for part in zip(*held, strict=True))
        logp = np.where(t == v.seen, v.unseen, 0.0)
        for _, rows, _, _, _, inside in _leaves(net, v, h, t):
            logp[rows] += inside
        out[:] += np.bincount(of, weights=logp, minlength=len(out))
        held.clear()

    for first in (True, False):
        rows = np.flatnonzero((begin == 0) == first)
        at = 0 if first else WINDOW - STRIDE
        for b in range(0, len(rows), SCORED):
            r = rows[b : b + SCORED]
            w = windows[r]
            h = _attend(net, np.maximum(w[:, :-1], 0), at)[-1]
            target = w[:, 1 + at :]
            known = target >= 0
            h, t, of = h[known], target[known], np.repeat(owner[r], known.sum(axis=1))
            z = h @ net["top"].T + v.class_prior
            out += np.bincount(of, weights=_softmax(z, v.class_of(t)), minlength=len(out))
            held.append((h, t, of))
            # Groups of ids are met by many positions at a time.
            if len(held) >= SETTLES:
                settle()
    if held:
        settle()
    return out


def score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's digest of a (doc_id, text) table."""
    spark = docs.sparkSession
    made = prepared(id_text(docs), path)
    table = counts(made)
    trained = table.filter("kind = 2").agg(F.sum("n")).first()[0] or 0
    words = table.filter("kind = 0").agg(F.sum("n"), F.count(F.lit(1))).first()
    total, distinct = (words[0] or 0) + trained, words[1] + (trained > 0)
    # At most IDS rows, and at most COMMON words.
    found = table.filter("kind = 1").select("key", "n").toPandas()
    id_counts = np.zeros(IDS)
    id_counts[found["key"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.float64)
    levels = table.filter("kind = 0").groupBy(F.floor(F.log2("n")).alias("level")).count().collect()
    least, size = 1, 0
    for level, n in sorted(((r[0], r[1]) for r in levels), reverse=True):
        if size + n > COMMON:
            least = 2 ** (level + 1)
            break
        size += n
    common = table.filter((F.col("kind") == 0) & (F.col("n") >= least)).select("key", "n").toPandas().sort_values("key")
    v = vocabulary(id_counts)
    net = fit(made, v)
    shared = spark.sparkContext.broadcast((net, v, common["key"].to_numpy(dtype=np.int64), common["n"].to_numpy(dtype=np.int64), trained))
    schema = pa.schema([
        ("uid", pa.int64()), ("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()),
        ("score", pa.float64()), ("rare", pa.list_(pa.int64())),
    ])

    def run(batches):
        net, v, keys, ns, trained = shared.value
        for chunk in text_chunks(batches, "words"):
            scores = text_scores(net, v, [v.rank[i] for i in _ids(chunk)])
            hashes = _hashes(chunk)
            known, where = np.unique(np.concatenate(hashes), return_inverse=True)
            at = np.minimum(np.searchsorted(keys, known), max(len(keys) - 1, 0))
            n = np.where(keys[at] == known, ns[at], -1) if len(keys) else np.full(len(known), -1)
            each = np.split(n[where], np.cumsum([len(h) for h in hashes])[:-1])
            logs = [float(np.log10(c[c >= 0] + 1.0).sum()) + float(np.log10(trained + 1.0)) for c in each]
            columns = [
                [len(c) + 1 for c in each], [int((c >= 0).sum()) + int(trained > 0) for c in each], logs, (scores * LOG10).tolist(),
                [h[c < 0] for h, c in zip(hashes, each, strict=True)],
            ]
            first = [chunk.column(c) for c in ("uid", "id", "held_out")]
            yield pa.RecordBatch.from_arrays(first + [pa.array(c, t) for c, t in zip(columns, schema.types[3:], strict=True)], schema=schema)

    ddl = "uid bigint, id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double, rare array<bigint>"
    rows = staged(made.mapInArrow(run, ddl), "scored")
    discard(made)
    rare = rows.select("uid", F.explode("rare").alias("key")).groupBy("uid", "key").agg(F.count(F.lit(1)).alias("times"))
    known = table.filter((F.col("kind") == 0) & (F.col("n") < least)).select("key", F.col("n").alias("c"))
    rare = rare.join(known, "key").groupBy("uid").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more_logs")
    )
    rare = staged(rare, "rare-words")
    rows = joined_small(rows.drop("rare"), rare, "uid", "left", rare.count())
    log_all = float(np.log10(total + distinct + 1))
    return rows.select(
        F.col("id").alias("doc_id"), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), "score",
    )
