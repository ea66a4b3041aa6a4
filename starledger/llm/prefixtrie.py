"""Prefix trie of conversations, its subtree totals by time-forward processing.

1. Turns get their place by a range sort over (conversation, turn) and prefix sums over the sorted
   tasks, so a conversation with most of the rows is spread over many tasks.
2. A prefix of d turns is identified by d and the sum of a 128-bit hash of (place, turn) over its turns;
   sums run in blocks of turns. Members of a prefix are counted by one aggregation.
3. A node is named by its smallest member and its depth, which are unique: the nodes of one name are a
   chain. Nodes are dealt to cells of a bounded range of members and depths.
4. Within a cell nodes come in reverse level order (sorted by Spark), and each sends its subtree's totals
   forward to its parent, through a priority queue that spills to sorted runs; a node whose parent is
   in another cell is the root of its part and sends nothing.
5. Across cells, roots' totals go to the roots above them by doubling jumps, a few joins however many
   cells lie on a path. A second pass within the cells takes in what then reaches each node.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starledger.llm.common import exact_columns, prefix_sums, staged

#: Low bits of conversation ids and of depths that a cell spans: at most 2 ** their sum of nodes.
CELL_ID_BITS, CELL_DEPTH_BITS = 10, 8
#: Low bits of a turn's place that a block spans, whose hashes are summed by one window.
BLOCK_BITS = 8
#: Messages that a queue holds in memory.
QUEUE_ROWS = 100_000
#: Conversation ids that one row carries when a node's ids are hashed.
IDS_IN_ROW = 4096
#: 32-bit parts of a turn's hash that are summed.
PARTS = ("p0", "p1", "p2", "p3")


class SpillingQueue:
    """A priority queue of (key, totals) that keeps at most ``rows`` in memory: more go to sorted runs in
    unnamed temporary files of the task, which end with it."""

    def __init__(self, rows: int = QUEUE_ROWS):
        self.rows, self.heap, self.runs, self.spills = rows, [], [], 0

    def push(self, key: tuple, totals: tuple) -> None:
        heapq.heappush(self.heap, (key, totals))
        if len(self.heap) > self.rows:
            run = tempfile.TemporaryFile()  # noqa: SIM115
            self.heap.sort()
            for x in self.heap:
                pickle.dump(x, run, pickle.HIGHEST_PROTOCOL)
            run.seek(0)
            self.heap.clear()
            self.spills += 1
            self._next(run)

    def _next(self, run) -> None:
        try:
            heapq.heappush(self.runs, (pickle.load(run), id(run), run))
        except EOFError:
            run.close()

    def pop_all(self, key: tuple):
        """The totals sent to ``key``; all smaller keys must have been taken."""
        while self.heap and self.heap[0][0] == key:
            yield heapq.heappop(self.heap)[1]
        while self.runs and self.runs[0][0][0] == key:
            (_, totals), _, run = heapq.heappop(self.runs)
            self._next(run)
            yield totals


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, place, hash, bytes) of all rebuilt turns, (conv, turns) of all conversations, turnless too).

    Conversation c is the first h turns of c - c % 5 and its own turns after its first h, with h the CRC-32
    of c in decimal, modulo 9.
    """
    raw = exact_columns(conversations, [("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string")]).where("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashed = raw.select(F.col("conv_id").alias("conv"), "turn", F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("hash"), F.octet_length(text).cast("long").alias("bytes"))
    # Rows that are repeated are counted before they are sorted: they can't be split by their values.
    counted = hashed.groupBy("conv", "turn", "hash", "bytes").agg(F.count("*").alias("n"))
    copies = counted.select("conv", "turn", "hash", "bytes", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("hash"), F.col("copy")]
    ranged = copies.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = staged(ranged.select("conv", "hash", "bytes", F.monotonically_increasing_id().alias("id")).withColumn("chunk", F.shiftright("id", 33)), "turns")
    counts = staged(ranged.groupBy("conv", "chunk").agg(F.min("id").alias("first"), F.count("*").alias("n")), "turn-counts")
    before = prefix_sums(counts, ["conv"], "chunk", "n", "before").drop("n")
    turns = ranged.join(before, ["conv", "chunk"]).select("conv", (F.col("before") + F.col("id") - F.col("first") + 1).alias("place"), "hash", "bytes")
    turns = staged(turns, "placed-turns")

    own = counts.groupBy("conv").agg(F.sum("n").alias("own"))
    heads = (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).alias("head")
    convs = own.select("conv", "own", heads, (F.col("conv") - F.col("conv") % 5).alias("base"))
    base = own.select(F.col("conv").alias("base"), F.col("own").alias("base_turns"))
    convs = convs.join(base, "base", "left").withColumn("taken", F.least("head", F.coalesce("base_turns", F.lit(0))))
    convs = staged(convs.select("conv", "base", "head", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("turns")), "conversations")

    # At most five conversations begin with one, each with at most eight of its turns.
    first = turns.where("place <= 8").withColumnRenamed("conv", "base")
    heads = first.join(convs.select("conv", "base", "taken"), "base").where("place <= taken").select("conv", "place", "hash", "bytes")
    tails = turns.join(convs.select("conv", "head", "taken"), "conv").where("place > head").select("conv", (F.col("taken") + F.col("place") - F.col("head")).alias("place"), "hash", "bytes")
    return heads.unionByName(tails), convs.select("conv", "turns")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, key parts, keys of the prefix one turn shorter, bytes, last) for each rebuilt turn."""
    salted = F.sha2(F.concat(F.col("place").cast("string"), F.lit(":"), F.col("hash")), 256)
    parts = [F.conv(F.substring(salted, 8 * i + 1, 8), 16, 10).cast("long").alias(p) for i, p in enumerate(PARTS)]
    hashed = staged(turns.select("conv", "place", "bytes", F.shiftright(F.col("place") - 1, BLOCK_BITS).alias("block"), *parts), "rebuilt-turns")
    sums = hashed.groupBy("conv", "block").agg(*(F.sum(p).alias(p) for p in PARTS))
    over = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("conv", "block", *(F.sum(p).over(over).alias(f"{p}_before") for p in PARTS)).where("block > 0")
    inside = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    summed = hashed.select("conv", "place", "block", "bytes", *PARTS, *(F.sum(p).over(inside).alias(f"{p}_in") for p in PARTS))
    summed = summed.join(before, ["conv", "block"], "left").join(convs, "conv")
    key = [(F.col(f"{p}_in") + F.coalesce(f"{p}_before", F.lit(0))).alias(f"key_{p}") for p in PARTS]
    above = [(F.col(f"{p}_in") + F.coalesce(f"{p}_before", F.lit(0)) - F.col(p)).alias(f"above_{p}") for p in PARTS]
    return summed.select("conv", F.col("place").alias("depth"), *key, *above, "bytes", (F.col("place") == F.col("turns")).alias("last"))


KEYS, ABOVE = [f"key_{p}" for p in PARTS], [f"above_{p}" for p in PARTS]


def trie_nodes(members: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, parent, n_convs, n_ends, bytes, key parts): the nodes; ``parent`` is null at the root."""
    own = [F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.count_if("last").alias("n_ends"), F.first("bytes").alias("bytes")]
    inner = staged(members.groupBy("depth", *KEYS).agg(*own, *(F.first(a).alias(a) for a in ABOVE)), "trie-inner")
    zero = [F.lit(0).cast("long").alias(k) for k in KEYS]
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.count_if(F.col("turns") == 0).alias("n_ends")).where("n_convs > 0")
    root = staged(root.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "n_convs", "n_ends", F.lit(0).cast("long").alias("bytes"), *zero), "trie-root")
    columns = ["conv", "depth", "parent", "n_convs", "n_ends", "bytes", *KEYS]
    # All nodes of depth 1 have the root as parent: no join, which would have one key.
    top = inner.where("depth = 1").withColumn("parent", root.select("conv").scalar()).select(columns)
    parents = inner.select(F.col("conv").alias("parent"), (F.col("depth") + 1).alias("depth"), *(F.col(k).alias(a) for k, a in zip(KEYS, ABOVE, strict=True)))
    lower = inner.where("depth > 1").join(parents, ["depth", *ABOVE]).select(columns)
    return staged(root.unionByName(top).unionByName(lower), "trie-nodes")


def end_digests(members: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, key parts, ends_sha256) of the nodes at which conversations end.

    Ids are sorted over all tasks and joined to rows of up to IDS_IN_ROW; those of a node then meet in
    order in one task, which hashes them as they come, as SHA-256 is sequential.
    """
    node = ["depth", *KEYS]
    zero = [F.lit(0).cast("long").alias(k) for k in node]
    ends = members.where("last").select(*node, "conv").unionByName(convs.where("turns = 0").select(*zero, "conv"))
    ranged = ends.repartitionByRange(*node, "conv").sortWithinPartitions(*node, "conv")
    names = [*node, "first", "ids"]

    def joined(batches):
        key, ids = None, []

        def row():
            return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=names)

        for batch in batches:
            out = []
            *keys, conv = (c.to_pylist() for c in batch.columns)
            for *k, c in zip(*keys, conv, strict=True):
                if k != key or len(ids) >= IDS_IN_ROW:
                    if ids:
                        out.append(row())
                    key, ids = k, []
                ids.append(c)
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if ids:
            yield row()

    kinds = ", ".join(f"{k} long" for k in node)
    rows = ranged.mapInArrow(joined, f"{kinds}, first long, ids string")

    def hashed(batches):
        key, state = None, None
        for batch in batches:
            out = []
            *keys, _, ids = (c.to_pylist() for c in batch.columns)
            for *k, text in zip(*keys, ids, strict=True):
                if k == key:
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(text.encode())
            if out:
                yield _batch(out, [*node, "ends_sha256"])
        if key is not None:
            yield _batch([(*key, state.hexdigest())], [*node, "ends_sha256"])

    return rows.repartition(*node).sortWithinPartitions(*node, "first").mapInArrow(hashed, f"{kinds}, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)


def _cells(nodes: DataFrame) -> DataFrame:
    """Nodes dealt by cell, the cells of a task one after the other, each in reverse level order."""
    cell = {"cell_ids": F.shiftright("conv", CELL_ID_BITS), "cell_depths": F.shiftright("depth", CELL_DEPTH_BITS)}
    dealt = nodes.withColumns(cell).repartition("cell_ids", "cell_depths")
    return dealt.sortWithinPartitions("cell_ids", "cell_depths", F.desc("depth"), F.desc("conv"))


def _same_cell(a: tuple, b: tuple) -> bool:
    return a[0] >> CELL_ID_BITS == b[0] >> CELL_ID_BITS and a[1] >> CELL_DEPTH_BITS == b[1] >> CELL_DEPTH_BITS


def _cell_runs(batches):
    """(rows of one cell) after the other, as lists of at most a cell's bound: (conv, depth, parent, children, leaves, saved)."""
    cell, rows = None, []
    for batch in batches:
        for *c, conv, depth, parent, children, leaves, saved in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != cell:
                if rows:
                    yield rows
                cell, rows = c, []
            rows.append((conv, depth, parent, children, leaves, saved))
    if rows:
        yield rows


def forward(rows: list[tuple], queue_rows: int = QUEUE_ROWS) -> list[tuple]:
    """(conv, depth, parent, children, leaves, saved) of one cell's nodes, in reverse level order, with the
    totals of what lies below them in the cell added."""
    queue, out = SpillingQueue(queue_rows), []
    for conv, depth, parent, children, leaves, saved in rows:
        for c, le, s in queue.pop_all((-depth, -conv)):
            children, leaves, saved = children + c, leaves + le, saved + s
        out.append((conv, depth, parent, children, leaves, saved))
        if parent is not None and _same_cell((conv, depth), (parent, depth - 1)):
            queue.push((1 - depth, -parent), (1, leaves, saved))
    return out


_IN = ["cell_ids", "cell_depths", "conv", "depth", "parent", "children", "leaves", "saved"]


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """(conv, depth, n_children, n_leaves, saved_tokens) of each node (conv, depth, parent, n_convs, n_ends, bytes)."""
    # Where all members end there is no child.
    own = nodes.select("conv", "depth", "parent", F.lit(0).cast("long").alias("children"), (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))

    def rooted(batches):
        for rows in _cell_runs(batches):
            totals = forward(rows)
            roots: dict[tuple[int, int], tuple[int, int]] = {}  # of each node of the cell, from above
            out = []
            for conv, depth, parent, _, leaves, saved in reversed(totals):
                root = roots.get((parent, depth - 1), (conv, depth)) if parent is not None else (conv, depth)
                roots[conv, depth] = root
                out.append((conv, depth, parent, *root, leaves, saved))
            arrays = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv", "depth", "parent", "root_conv", "root_depth", "leaves", "saved"])

    first = _cells(own).select(_IN).mapInArrow(rooted, "conv long, depth long, parent long, root_conv long, root_depth long, leaves long, saved long")
    first = staged(first, "trie-parts")
    arriving = _arriving(first)

    def finished(batches):
        for rows in _cell_runs(batches):
            out = [(conv, depth, children, leaves, saved) for conv, depth, _, children, leaves, saved in forward(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["conv", "depth", "n_children", "n_leaves", "saved_tokens"])

    with_more = own.join(arriving, ["conv", "depth"], "left")
    more = with_more.select("conv", "depth", "parent", F.coalesce("more_children", F.lit(0)).alias("children"), *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")))
    return _cells(more).select(_IN).mapInArrow(finished, "conv long, depth long, n_children long, n_leaves long, saved_tokens long")


def _arriving(parts: DataFrame) -> DataFrame:
    """(conv, depth, more_children, more_leaves, more_saved): what roots of other cells send to a node, with
    all that lies below them. ``parts``: each node with the root of its part; totals of a root's part."""
    is_root = (F.col("conv") == F.col("root_conv")) & (F.col("depth") == F.col("root_depth"))
    roots = parts.where(is_root).select("conv", "depth", "parent", "leaves", "saved")
    above = parts.select(F.col("conv").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("root_conv").alias("up_conv"), F.col("root_depth").alias("up_depth"))
    # The trie's root is its own part's root: what hangs on it needs no join, which would have one key.
    direct = roots.where("depth <= 1").select("conv", "depth", "parent", F.col("parent").alias("up_conv"), F.when(F.col("parent").isNotNull(), F.lit(0).cast("long")).alias("up_depth"), "leaves", "saved")
    found = roots.where("depth > 1").join(above, ["parent", "depth"]).select(direct.columns)
    state = staged(direct.unionByName(found), "trie-jumps")
    while not state.where("up_depth is not null").isEmpty():
        sent = state.where("up_depth is not null").groupBy(F.col("up_conv").alias("conv"), F.col("up_depth").alias("depth")).agg(F.sum("leaves").alias("leaves_sent"), F.sum("saved").alias("saved_sent"))
        total = state.join(sent, ["conv", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"{c}_sent", F.lit(0)) for c in ("leaves", "saved")})
        jumps = state.select(F.col("conv").alias("up_conv"), F.col("depth").alias("up_depth"), F.col("up_conv").alias("next_conv"), F.col("up_depth").alias("next_depth"))
        ended = (F.col("up_depth").isNull()) | (F.col("up_depth") == 0)
        last = total.where(ended).withColumns({"up_conv": F.lit(None).cast("long"), "up_depth": F.lit(None).cast("long")}).select(state.columns)
        on = total.where(~ended).join(jumps, ["up_conv", "up_depth"]).withColumns({"up_conv": F.col("next_conv"), "up_depth": F.col("next_depth")}).select(state.columns)
        state = staged(last.unionByName(on), "trie-jumps")
    sent = state.where("parent is not null")
    return staged(sent.groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("more_children"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")), "trie-arriving")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the prefix trie of the rebuilt ``conversations`` (conv_id, turn, role, text):
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first; equal turn numbers by a hash of role and text. A row that
    is repeated is a turn as often. Null roles and texts are empty; rows without a conv_id belong to no
    conversation. Texts only enter by their hash and length, however long. An empty table has no
    node; other columns are ignored.
    """
    turns, convs = rebuilt_turns(conversations)
    members = staged(prefixes(turns, convs), "prefixes")
    nodes = trie_nodes(members, convs)
    totals = subtree_totals(nodes)
    ends = end_digests(members, convs)
    rows = nodes.join(totals, ["conv", "depth"]).join(ends, ["depth", *KEYS], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
