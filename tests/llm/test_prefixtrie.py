import hashlib
import random
import zlib

import pytest

from inkspect.llm import prefixtrie as pt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SHAPE = "conv_id long, turn int, role string, text string, depth string, key int"


def brute(rows):
    """All nodes by plain dictionaries of prefixes."""
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))

    def order(t):
        digest = hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()
        return (t[0] is not None, t[0] or 0, digest)

    plain = {c: [t[1:] for t in sorted(ts, key=order)] for c, ts in own.items()}
    full = {}
    for c, ts in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = c - int(abs(c) % 100) * (1 if c >= 0 else -1)
        full[c] = plain.get(head, [])[:h] + ts[h:]
    members, ends = {}, {}
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
        ends.setdefault(tuple(ts), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, convs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * (len(q[-1][1]) if q else 0) for q in under)
        leaves = sum(q not in kids for q in under)
        hashed = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        parent = min(members[p[:-1]]) if p else None
        out.append((min(convs), len(p), parent, len(convs), len(kids.get(p, [])), leaves, saved, hashed))
    return sorted(out, key=str)


def found(spark, rows, most_keys=pt.BLOCK_KEYS):
    df = spark.createDataFrame(rows, SHAPE)
    return sorted((tuple(r[c] for c in COLUMNS) for r in pt.trie(df, most_keys).collect()), key=str)


def conversations(rng, n):
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randrange(-250, 400), 100 * rng.randrange(-2, 4)])
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["u", "a", None]), rng.choice(["x", "yé", "", None, "long text"]), "clash", 1))
    return rows


@pytest.mark.parametrize("most_keys", [1, 3, 50, pt.BLOCK_KEYS])
def test_nodes_equal_brute_force(spark, most_keys):
    rows = conversations(random.Random(most_keys), 160)
    assert found(spark, rows, most_keys) == brute(rows)


def test_many_copies_cross_blocks(spark):
    """More ends of one node than a chunk holds, over several blocks and partitions."""
    same = [(c, t, "u", f"turn {t}", "", 0) for c in range(1, 800) for t in range(3)]
    other = [(c, t, "u", f"{c} {t}", "", 0) for c in range(2000, 2040) for t in range(7)]
    assert found(spark, same + other, 100) == brute(same + other)


def test_empty_null_and_turnless(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "u", "x", "", 0)]) == []
    # One turn, taken from an absent head conversation: no turn is left, and the root is the leaf.
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(c, 0, "u", "gone", "", 0)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows)[0][:7] == (c, 0, None, 1, 0, 1, 0)


def test_very_long_conversation(spark):
    rows = [(200, t, "u", "s" * (t % 5), "", 0) for t in range(3000)] + [(207, t, "u", "s" * (t % 5), "", 0) for t in range(2990)]
    got = found(spark, rows, 1)
    assert len(got) == len({r[1] for r in got}) + sum(1 for r in got if r[1] > 2990 and r[0] == 207)
    assert max(r[1] for r in got) == 3000 and {r[3] for r in got if 0 < r[1] < 2900} <= {1, 2}


def test_union_find_over_sorted_keys():
    rng = random.Random(5)
    for _ in range(200):
        keys = sorted(b"".join(bytes([rng.randrange(2)]) * pt.WIDTH for _ in range(rng.randrange(5))) for _ in range(rng.randrange(1, 12)))
        forest = pt.Forest(keys)
        nodes = {(forest.depth[v], forest.low[v], forest.high[v]) for v in set(forest.node_of) | set(forest.up) | {forest.root} if v >= 0}
        want = set()
        for i in range(len(keys)):
            for d in {len(keys[i]), 0, *(16 * pt.common_turns(keys[i], k) for k in keys if k != keys[i])}:
                inside = [j for j, k in enumerate(keys) if k[:d] == keys[i][:d]]
                want.add((d // 16, inside[0], inside[-1]))
        assert nodes == want
