"""Near-duplicate vectors by NN-descent on a neighbour graph.

1. Equal vectors of a label are one class; the graph is over classes.
2. The graph starts from random-projection leaves: vectors that agree in the signs of some random
   projections are compared, and each keeps its ``k`` nearest. A leaf with too many is dealt at random.
3. Each round, a vector's neighbours (those in its list, and as many that list it) are compared with
   each other, and improve each other's lists. Rounds end when no new pair reaches the threshold but
   in saturated lists, whose groups are compared as a whole.
4. Lists that are full of pairs above the threshold are saturated: they are enlarged to the whole
   connected group, and groups that hold one are compared with all others of their kind near them
   and joined where a pair reaches the threshold. The members of a group are compared in blocks, so
   no list length limits what is counted.
5. An audit compares some vectors of saturated groups and some others, more in a larger table, with
   all vectors. While too few of either kind have all their pairs in the graph, rounds go on from
   new leaves; if the last ones miss too, blocks of all vectors are compared, but for those that
   bounds on their centres and radii keep apart: slower, and complete.

Vectors travel as they are; cosines are computed in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.llm.common import bounded_broadcast, staged
from starledger.llm.components import components

THRESHOLD = 0.98
NEIGHBOURS = 8
#: Projection tables that a graph starts from, and vectors in one of their leaves (about).
TABLES, LEAF = 6, 64
#: Random projections of a table at most.
BITS = 40
RESTARTS = 3
#: Vectors of a kind that the audit compares with all others: so many, and so many times the root of
#: the table's rows; and the share of those with pairs whose pairs it wants found.
AUDIT_ROWS, AUDIT_ROOT, RECALL = 64, 2, 0.98
#: Vectors in one block of a group that is compared as a whole.
BLOCK = 256
#: Blocks in one tile, when the blocks' centres are compared.
TILE = 512


def _unit(flat: np.ndarray, rows: int) -> np.ndarray:
    x = np.asarray(flat, np.float64).reshape(rows, -1)
    # Scaled first: squares of very large or small components would leave the range.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def vectors_of(table: DataFrame) -> DataFrame:
    """The vectors that can be linked: vec_id, space (label and dimensions), v, key.

    Left out: null ids, labels and vectors, zero or empty vectors, null or non-finite components.
    Only vectors of one space are compared.
    """
    element = table.schema["embedding"].dataType.elementType.simpleString()
    kind = "array<float>" if element == "float" else "array<double>"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(kind).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where("vec_id is not null and label is not null and v is not null").where(~bad & F.exists("v", lambda x: x != 0))
    plain = F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast(element if element in ("float", "double") else "double")).otherwise(x))  # -0.0 is 0.0
    return rows.select("vec_id", F.concat_ws(":", F.size("v"), "label").alias("space"), plain.alias("v")).withColumn("key", F.sha2(F.to_json(F.struct("space", "v")), 256))


def classes_of(vectors: DataFrame) -> DataFrame:
    """(rep, copies, space, v): equal vectors of a space, by their smallest vec_id."""
    members = vectors.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"))
    one = vectors.join(members, (vectors["key"] == members["key"]) & (vectors["vec_id"] == members["rep"]), "left_semi").dropDuplicates(["key"])
    return one.join(members, "key").select("rep", "copies", "space", "v")


def _leaves(classes: DataFrame, start: int) -> DataFrame:
    """(table, space, code, salt, rep, v): each class in one leaf of each of TABLES tables."""

    def codes(batches):
        for batch in batches:
            spaces, v = batch.column(1).to_pylist(), batch.column(2)
            out = np.zeros((len(spaces), TABLES), np.int64)
            offsets, flat = np.asarray(v.offsets), np.asarray(v.values, np.float64)
            sizes = np.diff(offsets)
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                x = _unit(np.concatenate([flat[offsets[r] : offsets[r + 1]] for r in rows]), len(rows))
                for t in range(TABLES):
                    planes = np.random.default_rng((start, t, int(d))).standard_normal((int(d), BITS))
                    out[rows, t] = (x @ planes > 0) @ (1 << np.arange(BITS, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.int64()))], names=["rep", "codes"])

    coded = classes.select("rep", "space", "v").mapInArrow(codes, "rep long, codes array<long>")
    sizes = classes.groupBy("space").agg(F.count("*").alias("n"))
    bits = F.least(F.lit(BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LEAF)))).cast("int")
    placed = classes.select("rep", "space").join(coded, "rep").join(sizes.select("space", bits.alias("bits")), "space")
    placed = placed.select("rep", "space", "bits", F.posexplode("codes").alias("table", "code"))
    placed = staged(placed.select("rep", "space", "table", F.col("code").bitwiseAND(F.expr("shiftleft(1L, bits) - 1")).alias("code")), "leaves")
    full = placed.groupBy("space", "table", "code").agg(F.count("*").alias("n"))
    salted = placed.join(full, ["space", "table", "code"])
    salt = F.pmod(F.xxhash64("rep", "table", F.lit(start)), F.ceil(F.col("n") / LEAF))
    return salted.select("space", "table", "code", salt.alias("salt"), "rep").join(classes.select("rep", "v"), "rep")


def _compare(groups: DataFrame, k: int) -> DataFrame:
    """(u, v, sim) from rows of ``members`` (rep, worst, v): pairs within a row that are better than
    the worst neighbour of u, the k best of each u."""

    def run(batches):
        for batch in batches:
            members = batch.column(0)
            offsets = np.asarray(members.offsets)
            reps, worst, vectors = (members.values.field(i) for i in range(3))
            reps, worst, flat, at = np.asarray(reps), np.asarray(worst), np.asarray(vectors.values), np.asarray(vectors.offsets)
            us, vs, sims = [], [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                if b - a < 2:
                    continue
                x = _unit(flat[at[a] : at[b]], b - a)
                gram = x @ x.T
                np.fill_diagonal(gram, -2)
                gram[reps[a:b][:, None] == reps[a:b][None, :]] = -2
                gram[gram <= worst[a:b][:, None]] = -2
                n = min(k, b - a - 1)
                best = np.argpartition(-gram, n - 1, axis=1)[:, :n]
                rows, cols = np.repeat(np.arange(b - a), n), best.ravel()
                good = gram[rows, cols] > -2
                us.append(reps[a:b][rows[good]])
                vs.append(reps[a:b][cols[good]])
                sims.append(gram[rows[good], cols[good]])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, sims)], names=["u", "v", "sim"])

    return groups.select("members").mapInArrow(run, "u long, v long, sim double")


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """(u, near): each vector's k best edges, as (-sim, v)."""
    # One entry for each v: a pair compared in two places can differ in the last bit.
    single = edges.repartition("u").groupBy("u", "v").agg(F.max("sim").alias("sim"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), "v"))), 1, k)
    return single.groupBy("u").agg(best.alias("near"))


def _edges(lists: DataFrame) -> DataFrame:
    return lists.select("u", F.explode("near").alias("e")).select("u", F.col("e.v").alias("v"), (-F.col("e.far")).alias("sim"))


def _round(lists: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """One step of NN-descent: lists improved by the neighbours of neighbours."""
    edges = _edges(lists)
    # Of those that list v, about k: a vector that very many list isn't compared with all of them.
    known = edges.groupBy("v").agg(F.count("*").alias("listed"))
    back = edges.join(known, "v").where(F.pmod(F.xxhash64("u", "v"), F.col("listed")) < k).select(F.col("v").alias("u"), F.col("u").alias("v"))
    beside = edges.select("u", "v").union(back).union(lists.select("u", F.col("u").alias("v"))).distinct()
    full = F.when(F.size("near") >= k, -F.element_at("near", -1)["far"]).otherwise(-1.5)
    known = classes.select(F.col("rep").alias("v"), F.col("v").alias("x")).join(lists.select(F.col("u").alias("v"), full.alias("worst")), "v")
    groups = beside.join(known, "v").groupBy("u").agg(F.collect_list(F.struct(F.col("v").alias("rep"), "worst", F.col("x").alias("v"))).alias("members"))
    return _lists(edges.union(_compare(groups, k)), k)


def _new_pairs(lists: DataFrame, before: DataFrame, threshold: float) -> bool:
    """Whether a list has more pairs at the threshold than ``before``: one that was saturated has not."""
    reaching = F.size(F.filter("near", lambda e: -e["far"] >= threshold))
    more = lists.select("u", reaching.alias("n")).join(before.select("u", reaching.alias("m")), "u", "left")
    return not more.where(F.col("n") > F.coalesce("m", F.lit(0))).isEmpty()


def neighbour_graph(classes: DataFrame, start: int, k: int, threshold: float, known: DataFrame | None = None) -> DataFrame:
    """(u, near): lists of the k nearest found from the leaves of ``start`` and rounds of NN-descent."""
    member = F.struct("rep", F.lit(-1.5).alias("worst"), "v")
    groups = _leaves(classes, start).groupBy("space", "table", "code", "salt").agg(F.collect_list(member).alias("members"))
    edges = _compare(groups, k)
    lists = staged(_lists(edges if known is None else edges.union(_edges(known)), k), "lists")
    while True:
        before, lists = lists, staged(_round(lists, classes, k), "lists")
        if not _new_pairs(lists, before, threshold):
            return lists


def _audited(classes: DataFrame, groups: DataFrame, threshold: float, sample: list) -> DataFrame:
    """(q, pairs, found): for each class of ``sample`` (rep, space, v) with pairs at the threshold among
    all others, how many there are and how many of them are in its group."""
    queries: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for space in {r["space"] for r in sample}:
        mine = [r for r in sample if r["space"] == space]
        queries[space] = (np.array([r["rep"] for r in mine]), _unit(np.concatenate([r["v"] for r in mine]), len(mine)))

    def run(batches):
        for batch in batches:
            pairs = [np.zeros((2, 0), np.int64)]
            reps, spaces, v = np.asarray(batch.column(0)), np.asarray(batch.column(1).to_pylist(), object), batch.column(2)
            offsets, flat = np.asarray(v.offsets), np.asarray(v.values)
            for space, (asked, x) in queries.items():
                rows = np.flatnonzero(spaces == space)
                for some in np.array_split(rows, -(-len(rows) // 1024)) if len(rows) else ():
                    y = _unit(np.concatenate([flat[offsets[r] : offsets[r + 1]] for r in some]), len(some))
                    i, j = np.nonzero(x @ y.T >= threshold)
                    found = np.stack([asked[i], reps[some][j]])
                    pairs.append(found[:, found[0] != found[1]])
            q, rep = np.concatenate(pairs, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(rep, pa.int64())], names=["q", "rep"])

    pairs = classes.select("rep", "space", "v").mapInArrow(run, "q long, rep long")
    named = groups.select("node", "component")
    both = pairs.join(named.toDF("q", "q_group"), "q", "left").join(named.toDF("rep", "group"), "rep", "left")
    return both.groupBy("q").agg(F.count("*").alias("pairs"), F.count_if(F.col("q_group") == F.col("group")).alias("found"))


def _sampled(classes: DataFrame, rows: int) -> list:
    return classes.select("rep", "space", "v", F.xxhash64("rep").alias("h")).orderBy("h").limit(rows).collect()


def audit(classes: DataFrame, groups: DataFrame, threshold: float, rows: int = AUDIT_ROWS) -> tuple[int, int]:
    """Of a few vectors' pairs at the threshold with all others: how many are in one group, how many there are."""
    r = _audited(classes, groups, threshold, _sampled(classes, rows)).agg(F.sum("pairs").alias("pairs"), F.sum("found").alias("found")).first()
    return r["found"] or 0, r["pairs"] or 0


def audit_vectors(classes: DataFrame, lists: DataFrame, groups: DataFrame, threshold: float, k: int) -> list[tuple[int, int]]:
    """For vectors of groups with a saturated list, and for others: of those sampled that have a pair
    at the threshold, how many have all of them in their group, and how many there are."""
    rows = AUDIT_ROWS + math.ceil(AUDIT_ROOT * math.sqrt(classes.count()))
    named = groups.select("node", "component")
    full = bounded_broadcast(staged(_saturated(lists, threshold, k).join(named, F.col("u") == F.col("node")).select("component").distinct(), "full"))
    dense = staged(named.join(full, "component").select(F.col("node").alias("rep")), "dense")
    out = []
    for kind in ("left_semi", "left_anti"):
        audited = _audited(classes, groups, threshold, _sampled(classes.join(dense, "rep", kind), rows))
        r = audited.agg(F.count_if(F.col("found") == F.col("pairs")).alias("whole"), F.count("*").alias("n")).first()
        out.append((r["whole"], r["n"]))
    return out


def _saturated(lists: DataFrame, threshold: float, k: int) -> DataFrame:
    """(u) of the lists that are full of pairs at the threshold."""
    return lists.where((F.size("near") >= k) & (-F.element_at("near", -1)["far"] >= threshold)).select("u")


def _bridges(classes: DataFrame, lists: DataFrame, groups: DataFrame, threshold: float, k: int) -> DataFrame:
    """(a, b): pairs of groups with a saturated list each and a pair of vectors at the threshold.

    Their members are compared in blocks. Two blocks can only hold such a pair if the angle between
    their centres is at most the sum of their radii and the threshold's angle; others are left out.
    """
    named = groups.select("node", "component")
    full = bounded_broadcast(staged(_saturated(lists, threshold, k).join(named, F.col("u") == F.col("node")).select("component").distinct(), "full"))
    members = staged(classes.join(named.join(full, "component"), F.col("rep") == F.col("node")).select("space", "component", "rep", "v"), "saturated")
    # Only groups of more than a block are joined, by broadcast: by component, a large one would be in one task.
    large = staged(members.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "large")
    parts = F.ceil(F.coalesce("n", F.lit(1)) / BLOCK)
    dealt = members.join(bounded_broadcast(large), "component", "left").withColumn("block", F.pmod(F.xxhash64("rep"), parts))
    blocks = staged(dealt.groupBy("space", "component", "block").agg(F.collect_list("v").alias("vectors")), "saturated-blocks")

    def middles(batches):
        for batch in batches:
            centres, radii = [], []
            for n in range(batch.num_rows):
                vectors = batch.column(3)
                a, b = vectors.offsets[n].as_py(), vectors.offsets[n + 1].as_py()
                x = _unit(np.asarray(vectors.values.slice(a, b - a).flatten()), b - a)
                mean = x.sum(axis=0)
                length = np.sqrt(mean @ mean)
                centre = mean / length if length > 1e-6 else x[0]
                centres.append(centre)
                radii.append(float(np.arccos(np.clip(x @ centre, -1, 1)).max()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(centres, pa.list_(pa.float64())), pa.array(radii, pa.float64())], names=["space", "component", "block", "centre", "radius"])

    middle = staged(blocks.mapInArrow(middles, "space string, component long, block long, centre array<double>, radius double"), "middles")
    tiles = middle.groupBy("space").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    placed = middle.join(F.broadcast(tiles), "space").withColumn("tile", F.pmod(F.xxhash64("component", "block"), "tiles"))
    part = F.collect_list(F.struct("component", "block", "centre", "radius"))
    tile = staged(placed.groupBy("space", "tiles", "tile").agg(part.alias("x")), "tiles")
    # Each tile goes to all pairs that it is part of: a join by space alone would have few keys.
    left = tile.select("space", F.col("tile").alias("i"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("j"), "x")
    right = tile.select("space", F.explode(F.sequence(F.lit(0).cast("long"), "tile")).alias("i"), F.col("tile").alias("j"), F.col("x").alias("y"))
    reach = float(np.arccos(threshold)) + 1e-6

    def near_blocks(batches):
        def side(column, n):
            a, b = column.offsets[n].as_py(), column.offsets[n + 1].as_py()
            ids, block, centre, radius = (column.values.slice(a, b - a).field(i) for i in range(4))
            return np.asarray(ids), np.asarray(block), np.asarray(centre.flatten()).reshape(b - a, -1), np.asarray(radius)

        for batch in batches:
            out = []
            for n in range(batch.num_rows):
                (c, bc, x, rx), (d, bd, y, ry) = side(batch.column(0), n), side(batch.column(1), n)
                # Of a tile with itself and of two tiles, each pair of groups in one direction at least.
                close = np.arccos(np.clip(x @ y.T, -1, 1)) <= rx[:, None] + ry[None, :] + reach
                close &= c[:, None] < d[None, :] if batch.column(2)[n].as_py() else c[:, None] != d[None, :]
                i, j = np.nonzero(close)
                out.append((c[i], bc[i], d[j], bd[j]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]).astype(np.int64)) for i in range(4)], names=["a", "i", "b", "j"])

    close = left.join(right, ["space", "i", "j"]).select("x", "y", (F.col("i") == F.col("j")).alias("same")).mapInArrow(near_blocks, "a long, i long, b long, j long")
    close = staged(close, "near-blocks")
    x = blocks.select(F.col("component").alias("a"), F.col("block").alias("i"), F.col("vectors").alias("x"))
    y = blocks.select(F.col("component").alias("b"), F.col("block").alias("j"), F.col("vectors").alias("y"))

    def linked(batches):
        for batch in batches:
            hit = []
            for n in range(batch.num_rows):
                sides = []
                for vectors in (batch.column(2), batch.column(3)):
                    a, b = vectors.offsets[n].as_py(), vectors.offsets[n + 1].as_py()
                    sides.append(_unit(np.asarray(vectors.values.slice(a, b - a).flatten()), b - a))
                hit.append(bool((sides[0] @ sides[1].T >= threshold).any()))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(hit, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    return close.join(x, ["a", "i"]).join(y, ["b", "j"]).select("a", "b", "x", "y").mapInArrow(linked, "a long, b long").distinct()


def graph_groups(classes: DataFrame, lists: DataFrame, threshold: float, k: int) -> DataFrame:
    """(node, component): the groups of the graph's pairs at the threshold, saturated lists enlarged."""
    pairs = _edges(lists).where(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))
    groups = components(pairs)
    if _saturated(lists, threshold, k).isEmpty():
        return groups
    bridges = staged(_bridges(classes, lists, groups, threshold, k), "bridges")
    if bridges.isEmpty():
        return groups
    return components(bridges.union(groups.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def _codes(rows: DataFrame) -> DataFrame:
    """``rows`` (with rep, v) and ``signs``: on which sides of BITS random planes a vector lies, a bit each."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    place = rows.columns.index("v")

    def run(batches):
        for batch in batches:
            v = batch.column(place)
            offsets, flat = np.asarray(v.offsets), np.asarray(v.values, np.float64)
            sizes, signs = np.diff(offsets), np.zeros(batch.num_rows, np.int64)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = _unit(np.concatenate([flat[offsets[r] : offsets[r + 1]] for r in at]), len(at))
                planes = np.random.default_rng((97, int(d))).standard_normal((int(d), BITS))
                signs[at] = (x @ planes > 0) @ (1 << np.arange(BITS, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signs)], names=[*batch.schema.names, "signs"])

    return rows.mapInArrow(run, f"{kinds}, signs long")


def _blocks(members: DataFrame) -> DataFrame:
    """(component, block, members): ``members`` (component, rep, copies, v) in blocks of about BLOCK vectors.

    Vectors that lie on the same sides of some planes are put together, so that blocks are small in
    radius where the component is wide; those that no plane parts are dealt by hash.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    bits = F.greatest(F.lit(0), F.least(F.lit(BITS), F.ceil(F.log2(F.col("n") / BLOCK)))).cast("int")
    large = staged(sizes.where(F.col("n") > BLOCK).select("component", bits.alias("bits")), "large")
    coded = _codes(members.join(bounded_broadcast(large), "component"))
    coded = staged(coded.withColumn("cell", F.col("signs").bitwiseAND(F.expr("shiftleft(1L, bits) - 1"))).drop("signs", "bits"), "coded")
    cells = coded.groupBy("component", "cell").agg(F.count("*").alias("in_cell"))
    salt = F.pmod(F.xxhash64("rep"), F.ceil(F.col("in_cell") / BLOCK))
    dealt = coded.join(cells, ["component", "cell"]).withColumn("block", F.xxhash64("cell", salt)).select("component", "block", "rep", "copies", "v")
    small = members.join(bounded_broadcast(large), "component", "left_anti").select("component", F.lit(0).cast("long").alias("block"), "rep", "copies", "v")
    # Dealt by block: by component alone, a large one would be in one task.
    rows = dealt.unionByName(small).repartition("component", "block")
    return staged(rows.groupBy("component", "block").agg(F.collect_list(F.struct("rep", "copies", "v")).alias("members")), "blocks")


def _near_pairs(blocks: DataFrame, threshold: float) -> DataFrame:
    """(component, i, j): the pairs of a component's blocks that can hold a pair at the threshold, each
    once, and each block with itself. Only centres and radii are compared, in tiles."""

    def middles(batches):
        for batch in batches:
            centres, radii = [], []
            for n in range(batch.num_rows):
                column = batch.column(2)
                a, b = column.offsets[n].as_py(), column.offsets[n + 1].as_py()
                x = _unit(np.asarray(column.values.slice(a, b - a).field(2).flatten()), b - a)
                mean = x.sum(axis=0)
                length = np.sqrt(mean @ mean)
                centre = mean / length if length > 1e-6 else x[0]
                centres.append(centre)
                radii.append(float(np.arccos(np.clip(x @ centre, -1, 1)).max()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(centres, pa.list_(pa.float64())), pa.array(radii, pa.float64())], names=["component", "block", "centre", "radius"])

    counts = blocks.groupBy("component").agg(F.count("*").alias("n"))
    several = bounded_broadcast(staged(counts.where("n > 1").select("component", F.ceil(F.col("n") / TILE).alias("tiles")), "several"))
    middle = blocks.join(several.drop("tiles"), "component").select("component", "block", "members").mapInArrow(middles, "component long, block long, centre array<double>, radius double")
    placed = staged(middle, "middles").join(several, "component").withColumn("tile", F.pmod(F.xxhash64("component", "block"), "tiles"))
    tile = staged(placed.groupBy("component", "tiles", "tile").agg(F.collect_list(F.struct("block", "centre", "radius")).alias("x")), "tiles")
    left = tile.select("component", F.col("tile").alias("i"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("j"), "x")
    right = tile.select("component", F.explode(F.sequence(F.lit(0).cast("long"), "tile")).alias("i"), F.col("tile").alias("j"), F.col("x").alias("y"))
    reach = float(np.arccos(threshold)) + 1e-6

    def near(batches):
        def side(column, n):
            a, b = column.offsets[n].as_py(), column.offsets[n + 1].as_py()
            block, centre, radius = (column.values.slice(a, b - a).field(i) for i in range(3))
            return np.asarray(block), np.asarray(centre.flatten()).reshape(b - a, -1), np.asarray(radius)

        for batch in batches:
            for n in range(batch.num_rows):
                (bx, x, rx), (by, y, ry) = side(batch.column(1), n), side(batch.column(2), n)
                close = np.arccos(np.clip(x @ y.T, -1, 1)) <= rx[:, None] + ry[None, :] + reach
                if batch.column(3)[n].as_py():  # a tile with itself
                    close &= bx[:, None] < by[None, :]
                i, j = np.nonzero(close)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), batch.column(0)[n].as_py(), np.int64)), pa.array(bx[i]), pa.array(by[j])], names=["component", "i", "j"])

    pairs = left.join(right, ["component", "i", "j"]).select("component", "x", "y", (F.col("i") == F.col("j")).alias("same")).mapInArrow(near, "component long, i long, j long")
    return staged(pairs.union(blocks.select("component", F.col("block").alias("i"), F.col("block").alias("j"))), "near-pairs")


def _paired(blocks: DataFrame, threshold: float) -> DataFrame:
    """(x, y, same): the members of the near pairs of blocks."""
    left = blocks.select("component", F.col("block").alias("i"), F.col("members").alias("x"))
    right = blocks.select("component", F.col("block").alias("j"), F.col("members").alias("y"))
    pairs = _near_pairs(blocks, threshold).join(left, ["component", "i"]).join(right, ["component", "j"])
    return pairs.select("x", "y", (F.col("i") == F.col("j")).alias("same"))


def _side(column, n):
    """(reps, copies, unit vectors) of row ``n``'s members."""
    a, b = column.offsets[n].as_py(), column.offsets[n + 1].as_py()
    part = column.values.slice(a, b - a)
    reps, copies, v = (part.field(i) for i in range(3))
    return np.asarray(reps), np.asarray(copies), _unit(np.asarray(v.flatten()), b - a)


def _group_links(classes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(rep, links): for each class in a group, the vectors of other classes linked with it, by comparing
    the blocks of its group that are near each other."""
    blocks = _blocks(staged(classes.join(groups, classes["rep"] == groups["node"]).select("component", "rep", "copies", "v"), "members"))

    def run(batches):
        for batch in batches:
            out = []
            for n in range(batch.num_rows):
                (r, cr, x), (s, cs, y) = _side(batch.column(0), n), _side(batch.column(1), n)
                near = x @ y.T >= threshold
                near &= r[:, None] != s[None, :]
                for ids, links in ((r, near @ cs), (s, near.T @ cr)):
                    out.append((ids[links > 0], links[links > 0]))
                    if batch.column(2)[n].as_py():
                        break  # a block with itself: both sides are one
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]).astype(np.int64)) for i in range(2)], names=["rep", "links"])

    return _paired(blocks, threshold).mapInArrow(run, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def _spanning(near: np.ndarray, r: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, label) that connect what the links of two blocks connect, at most one for each node."""
    far = np.iinfo(np.int64).max
    rows, cols = np.where(near.any(axis=1), r, far), np.where(near.any(axis=0), s, far)
    while True:
        to_cols = np.minimum(cols, np.where(near, rows[:, None], far).min(axis=0))
        to_rows = np.minimum(rows, np.where(near, to_cols[None, :], far).min(axis=1))
        if (to_cols == cols).all() and (to_rows == rows).all():
            break
        rows, cols = to_rows, to_cols
    return np.concatenate([r[rows < far], s[cols < far]]), np.concatenate([rows[rows < far], cols[cols < far]])


def exact_groups(classes: DataFrame, threshold: float) -> DataFrame:
    """(node, component) of all links: every space is cut into blocks, and blocks that bounds on their
    centres and radii don't part are compared. The way out where the graph's rounds miss links."""
    blocks = _blocks(classes.select(F.xxhash64("space").alias("component"), "rep", "copies", "v"))

    def run(batches):
        for batch in batches:
            out = [(np.zeros(0, np.int64),) * 2]
            for n in range(batch.num_rows):
                (r, _, x), (s, _, y) = _side(batch.column(0), n), _side(batch.column(1), n)
                if x.shape[1] == y.shape[1]:
                    out.append(_spanning((x @ y.T >= threshold) & (r[:, None] != s[None, :]), r, s))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(2)], names=["a", "b"])

    return components(staged(_paired(blocks, threshold).mapInArrow(run, "a long, b long").distinct(), "exact-links"))


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS) -> DataFrame:
    """A row for each row of ``table`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of one label with cosine >= threshold are linked; n_links counts a vector's links and
    component_id is the smallest vec_id reachable. Vectors that can't be linked (see ``vectors_of``)
    have no links and are their own component. Rows that repeat a vec_id are one vector. A null
    vec_id has a null component and is kept. Equal vectors, however many, are one class of the graph;
    labels are compared as texts of any length. An empty table gives an empty result. Other columns
    are ignored.
    """
    vectors = staged(vectors_of(table), "vectors")
    classes = staged(classes_of(vectors), "classes")
    lists, groups = None, None
    for start in range(RESTARTS):
        lists = neighbour_graph(classes, start, k, threshold, lists)
        groups = graph_groups(classes, lists, threshold, k)
        audited = audit_vectors(classes, lists, groups, threshold, k)
        if all(whole >= RECALL * n for whole, n in audited):
            break
    else:
        groups = exact_groups(classes, threshold)
    links = staged(_group_links(classes, groups, threshold), "links")
    per_class = classes.select("rep", "copies").join(links.select("rep", "links"), "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
    per_class = per_class.select("rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    member = vectors.join(vectors.groupBy("key").agg(F.min("vec_id").alias("rep")), "key").select("vec_id", "rep").distinct()
    known = member.join(per_class, "rep").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id")).join(known, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def keep_first(table: DataFrame) -> DataFrame:
    """The rows of ``table`` whose vector is the smallest vec_id of its component."""
    gone = staged(near_duplicates(table).where("not kept").select("vec_id").distinct(), "gone")
    return table.join(gone, "vec_id", "left_anti").select(table.columns)
