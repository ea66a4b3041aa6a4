import numpy as np
import pytest
from pyspark.sql import functions as F

from starledger.llm import embedding


def brute(rows, threshold=0.98):
    """vec_id -> (links, component) by comparing all with all of the same label."""
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            good.setdefault((label, len(v)), {})[i] = x / np.linalg.norm(x)
    links = {i: set() for i, *_ in rows if i is not None}
    for group in good.values():
        ids = list(group)
        x = np.array([group[i] for i in ids])
        for a, b in zip(*np.nonzero(x @ x.T >= threshold), strict=True):
            if a != b:
                links[ids[a]].add(ids[b])
    out = {}
    for i in sorted(links):
        if i not in out:
            todo, seen = [i], {i}
            while todo:
                new = links[todo.pop()] - seen
                seen |= new
                todo += new
            out |= {j: i for j in seen}
    return {i: (len(links[i]), out[i]) for i in links}


def given(seed, n, dims):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.standard_normal(dims), int(rng.integers(3))) for i in range(n)]
    base = rng.standard_normal(dims)
    for k in range(n // 3):  # a dense group
        rows.append((n + k, base + 0.1 * rng.standard_normal(dims), 1))
    for k in range(60):  # pairs near the threshold, copies and multiples
        i, v, label = rows[int(rng.integers(n))]
        rows.append((2 * n + k, [v, 2 * v, v + 0.15 * rng.standard_normal(dims)][k % 3], label))
    return [(i, np.asarray(v, np.float32).tolist(), label) for i, v, label in rows]


@pytest.mark.parametrize(("seed", "n", "dims"), [(1, 900, 64), (2, 300, 8)])
def test_equals_brute_force(spark, seed, n, dims):
    rows = given(seed, n, dims)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(6)
    out = embedding.near_duplicates(table).collect()
    want = brute(rows)
    assert len(out) == len(rows)
    same = sum(want[r["vec_id"]] == (r["n_links"], r["component_id"]) for r in out)
    assert same >= 0.99 * len(rows)
    assert all(r["n_links"] <= want[r["vec_id"]][0] and r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


def test_audit_counts_missing_pairs(spark):
    rows = given(3, 120, 16)
    classes = embedding.classes_of(embedding.vectors_of(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))).cache()
    none = spark.createDataFrame([], "node long, component long")
    found, pairs = embedding.audit(classes, none, 0.98, rows=400)
    assert found == 0 and pairs > 1000


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0, 0.0, -0.0], 1), (7, [1.0, None, 3.0], 1), (8, [1.0, float("nan"), 3.0], 1), (9, [float("inf"), 2.0, 3.0], 1), (None, v, 1), (10, [], 1), (11, [1.0, 2.0], 1), (12, [1e30, 2e30, 3e30], 1), (13, [-1.0, -2.0, -3.0], 1)]
    table = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "vec_id long, embedding array<float>, label int, rep string, n_links double")
    out = embedding.near_duplicates(table).collect()
    assert len(out) == len(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out if r["vec_id"] is not None}
    assert got == brute(rows)
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in out if r["vec_id"] is None] == [(0, None, True)]
    kept = embedding.keep_first(table)
    assert kept.columns == table.columns and {r["vec_id"] for r in kept.collect()} == {1, 3, 4, 5, 6, 7, 8, 9, None, 10, 11, 13}
    assert embedding.near_duplicates(table.limit(0)).count() == 0


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding.near_duplicates(table).collect()}
    want = brute(rows)
    assert sum(got[i] == want[i] for i in want) >= 0.999 * len(want)


def test_saturated_lists_of_two_tight_groups(spark):
    """All pairs across are links, but every vector has more than k nearer ones in its own group."""
    rng = np.random.default_rng(5)
    a = rng.standard_normal(64)
    a /= np.linalg.norm(a)
    side = rng.standard_normal(64)
    side -= side @ a * a
    b = np.cos(0.16) * a + np.sin(0.16) * side / np.linalg.norm(side)
    rows = [(i, (c + 0.002 * rng.standard_normal(64)).astype(np.float32).tolist(), 1) for i, c in enumerate([a] * 20 + [b] * 20)]
    far = rng.standard_normal((20, 64))
    rows += [(100 + i, (far[0] + 0.002 * x).astype(np.float32).tolist(), 1) for i, x in enumerate(far)]
    x = np.array([r[1] for r in rows[:40]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert (x[:20] @ x[20:].T).min() >= 0.98 and (x[:20] @ x[20:].T).max() < (x[:20] @ x[:20].T).min()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding.near_duplicates(table).collect()}
    assert got == brute(rows) and got[0] == (39, 0) and got[39] == (39, 0) and got[100][1] == 100


def test_audit_by_vector_sees_pairs_beside_a_dense_group(spark):
    """A dense group that is found doesn't hide pairs that aren't."""
    rng = np.random.default_rng(7)
    base = rng.standard_normal(32)
    rows = [(i, (base + 0.05 * rng.standard_normal(32)).astype(np.float32).tolist(), 1) for i in range(200)]
    for i in range(30):
        v = rng.standard_normal(32)
        rows += [(1000 + 2 * i + j, (v + 0.01 * j * rng.standard_normal(32)).astype(np.float32).tolist(), 1) for j in range(2)]
    classes = embedding.classes_of(embedding.vectors_of(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))).cache()
    groups = spark.createDataFrame([(i, 0) for i in range(200)], "node long, component long")
    lists = spark.createDataFrame([(i, [(-1.0, (i + j) % 200) for j in range(1, 9)]) for i in range(200)], "u long, near array<struct<far double, v long>>")
    (whole, dense), (found, others) = embedding.audit_vectors(classes, lists, groups, 0.98, 8)
    assert whole == dense > 60 and found == 0 and others == 60


def test_the_exact_way_where_the_graph_misses_links(spark, monkeypatch):
    """A graph that finds nothing: blocks are compared, and all links and groups are there."""
    rows = given(3, 240, 16)
    monkeypatch.setattr(embedding, "graph_groups", lambda classes, *_: classes.select(F.col("rep").alias("node"), F.col("rep").alias("component")).limit(0))
    monkeypatch.setattr(embedding, "RESTARTS", 1)
    monkeypatch.setattr(embedding, "BLOCK", 24)
    monkeypatch.setattr(embedding, "TILE", 2)
    out = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == brute(rows)


def test_spanning_edges_connect_what_links_do():
    rng = np.random.default_rng(8)
    for density in (0.02, 0.1, 0.5):
        near = rng.random((30, 40)) < density
        r, s = rng.permutation(1000)[:30], 1000 + rng.permutation(1000)[:40]
        nodes, labels = embedding._spanning(near, r, s)

        def groups(edges):
            group = {int(x): {int(x)} for x in (*r, *s)}
            for a, b in edges:
                whole = group[int(a)] | group[int(b)]
                for x in whole:
                    group[x] = whole
            return {frozenset(g) for g in group.values()}

        i, j = np.nonzero(near)
        assert groups(zip(nodes, labels, strict=True)) == groups(zip(r[i], s[j], strict=True)) and len(nodes) <= 70


def test_a_component_with_a_third_of_all_rows_is_cut_into_small_blocks(spark, monkeypatch):
    """A long chain of vectors: blocks are bounded, and blocks that are far apart are not compared."""
    monkeypatch.setattr(embedding, "BLOCK", 32)
    n = 1500
    angle = np.arange(n) * 0.004
    chain = np.stack([np.cos(angle), np.sin(angle), np.full(n, 0.01), np.zeros(n)], 1)
    rows = [(i, v.astype(float).tolist()) for i, v in enumerate(chain)]
    members = spark.createDataFrame([(0, i, 1, v) for i, v in rows] + [(9, 5000, 1, [0.0, 0.0, 0.0, 1.0])], "component long, rep long, copies long, v array<double>")
    blocks = embedding._blocks(members).cache()
    sizes = [len(r["members"]) for r in blocks.collect()]
    assert sum(sizes) == n + 1 and max(sizes) <= 3 * 32
    pairs = embedding._near_pairs(blocks, 0.98)
    assert pairs.count() < 0.5 * len(sizes) * (len(sizes) + 1) / 2 and pairs.distinct().count() == pairs.count()
    classes = members.select(F.lit("s").alias("space"), "rep", "copies", "v")
    groups = spark.createDataFrame([(i, 0) for i in range(n)], "node long, component long")
    got = {r["rep"]: r["links"] for r in embedding._group_links(classes, groups, 0.98).collect()}
    x = chain / np.linalg.norm(chain, axis=1)[:, None]
    assert got == {i: int(c) - 1 for i, c in enumerate((x @ x.T >= 0.98).sum(axis=1))}
