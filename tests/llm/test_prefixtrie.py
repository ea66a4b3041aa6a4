import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from starledger.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, conv int"


def brute(rows):
    """All nodes by rebuilding every conversation and walking every prefix."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, key), (role, text)))
    turns = {c: [x for _, x in sorted(t)] for c, t in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    out = []
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in below)]
        saved = sum((len(members[n]) - 1) * (len(n[-1][1].encode()) if n else 0) for n in below)
        ends = sorted(c for c in cs if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(cs), len(node), parent, len(cs), len(children), len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in prefixtrie.prefix_trie(table).collect()), key=str)


def branching(seed, conversations=40, turns=12):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "bot"]), rng.choice(["a", "b", "\u00e4\u00df"])) for c in range(conversations) for t in range(rng.randrange(turns))]


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = branching(seed)
    assert found(spark, rows) == brute(rows)


def test_small_cells_and_queues(spark, monkeypatch):
    """Cells of two ids and two depths: nearly all edges lie between cells, paths cross many of them."""
    monkeypatch.setattr(prefixtrie, "CELL_ID_BITS", 1)
    monkeypatch.setattr(prefixtrie, "CELL_DEPTH_BITS", 1)
    monkeypatch.setattr(prefixtrie, "BLOCK_BITS", 1)
    monkeypatch.setattr(prefixtrie, "IDS_IN_ROW", 2)
    rows = branching(3, 30, 24) + [(c, t, "user", "x") for c in range(100, 130) for t in range(20)]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (0, None, "user", "first"), (0, 3, None, None), (0, 3, None, None), (0, 1, "user", ""), (0, 2, "", "x" * 100_000), (1, 1, "user", "own"),
        (None, 0, "user", "lost"), (7, 0, "user", "no base"), (7, 0, "user", "no base"), (2, 5, "a", "b"), (2, 5, "ab", ""), (3, 0, None, "t"),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "a", "b")]) == []


def test_hot_conversation_and_copies(spark):
    """One conversation with most turns, and as many copies of one conversation."""
    rows = [(5, t, "user", str(t)) for t in range(700)] + [(c, t, "bot", "same") for c in range(1000, 1300) for t in range(2)]
    nodes = found(spark, rows)
    assert len([n for n in nodes if n[0] == 5]) >= 700
    root = next(n for n in nodes if n[1] == 0)
    assert root[3] == 301
    # Against the plain trie, without its square of prefixes.
    turns = defaultdict(list)
    for c, _, role, text in rows:
        turns[c].append((role, text))
    members = defaultdict(int)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        t = turns.get(c - c % 5, [])[:h] + turns[c][h:]
        for d in range(len(t) + 1):
            members[hash(tuple(t[:d])), d] += 1
    assert sorted((n[1], n[3]) for n in nodes) == sorted((d, n) for (_, d), n in members.items())


def test_queue_spills():
    queue = prefixtrie.SpillingQueue(rows=5)
    rng = random.Random(4)
    sent = [((rng.randrange(8),), (rng.randrange(100),)) for _ in range(200)]
    for key, totals in sent:
        queue.push(key, totals)
    assert queue.spills > 10
    for k in range(8):
        assert sorted(queue.pop_all((k,))) == sorted(t for key, t in sent if key == (k,))
    # Totals don't depend on what the queue holds.
    rows = [(c, d, 0 if d else None, 0, 1, d) for d in range(6, -1, -1) for c in range(50, -1, -1) if d or c == 0]
    assert prefixtrie.forward(rows, 3) == prefixtrie.forward(rows, 10_000)
