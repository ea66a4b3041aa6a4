"""K-d tree sharding: split at weighted medians along the widest metadata dimension.

The tree has as many leaves as there are shards. A node of k leaves is cut so that floor(k / 2) / k
of its bytes fall to the left; recursion ends when each leaf holds its share, total / shards.

Rows are ordered by (dimension, text hash, row number): copies of a text, equal in every dimension,
stay together. A cut that falls among them moves to the nearer end of their run, unless the run is
more than ``WHOLE_RUN`` of a shard: then the shards' sizes come first and it is split. A cut is found
without sorting: each pass counts bytes in ``BUCKETS`` equal steps of the interval that holds the
cut, for all nodes of a level at once, until what remains in doubt is below ``TOLERANCE`` of a
shard. What reaches the driver is nodes x buckets rows at most, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starledger.llm.common import crc32_text, exact_columns, prefix_sums, staged, utf8_bytes

BUCKETS = 1024
#: Bytes that a cut may be off by, as a share of a shard's bytes.
TOLERANCE = 0.001
#: Copies of a text of at most this share of a shard's bytes are never split.
WHOLE_RUN = 0.25
#: Bytes of a document besides its text.
ROW_BYTES = 8


@dataclass
class _Cut:
    """The search for one node's cut: rows below it in (dimension, tie, row) order go left."""

    node: int
    column: str
    target: float
    below: float = 0.0
    key: list[str] = field(default_factory=list)  # columns ordered by, the last is being searched
    fixed: list[int] = field(default_factory=list)  # values of those before it
    low: int = 0
    high: int = 0  # the interval in search, both ends in it
    done: bool = False

    def tied(self) -> Column:
        same = F.col("node") == self.node
        for c, v in zip(self.key, self.fixed, strict=False):
            same = same & (F.col(c) == v)
        return same

    def width(self) -> int:
        return max(1, -(-(self.high - self.low + 1) // BUCKETS))

    def left(self) -> Column:
        """Whether a row of the node goes left: its key is below (fixed..., low)."""
        out = F.col(self.key[-1]) < F.lit(min(self.low, (1 << 63) - 1))
        for c, v in reversed(list(zip(self.key, self.fixed, strict=False))):
            out = (F.col(c) < v) | ((F.col(c) == v) & out)
        return out


def _narrow(cuts: list[_Cut], rows: DataFrame, tolerance: float, run: float) -> None:
    """One pass over ``rows``: each open cut moves to the bucket that holds it."""
    at = [c for c in cuts if not c.done]
    node, bucket = F.lit(None).cast("int"), F.lit(None).cast("long")
    for c in at:
        # Intervals can be as wide as 64 bits: their steps are counted in decimals.
        step = F.floor((F.col(c.key[-1]).cast("decimal(20,0)") - F.lit(c.low).cast("decimal(20,0)")) / F.lit(c.width()).cast("decimal(20,0)"))
        inside = c.tied() & F.col(c.key[-1]).between(c.low, c.high)
        node, bucket = F.when(inside, c.node).otherwise(node), F.when(inside, step.cast("long")).otherwise(bucket)
    sums = rows.select(node.alias("at"), bucket.alias("bucket"), "size").where("at is not null").groupBy("at", "bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for r in sums.collect():  # at most open cuts x BUCKETS rows
        found.setdefault(r["at"], {})[r["bucket"]] = (r["bytes"], r["rows"])
    for c in at:
        steps, width = found.get(c.node, {}), c.width()
        inside = None
        for b in sorted(steps):
            if c.below + steps[b][0] > c.target:
                inside = b
                break
            c.below += steps[b][0]
        if inside is None:  # everything in the interval goes left
            c.low, c.done = c.high + 1, True
            continue
        c.low, c.high = c.low + inside * width, min(c.high, c.low + (inside + 1) * width - 1)
        size, n = steps[inside]
        copies = c.key[-1] == "tie" and c.low == c.high
        if size <= tolerance or n == 1 or copies and size <= run:  # the rest goes to the side that it fits better
            if c.target - c.below > size / 2:
                c.low = c.high + 1
            c.done = True
        elif c.low == c.high:
            c.fixed.append(c.low)
            c.key.append({c.column: "tie", "tie": "row"}[c.key[-1]])
            c.low, c.high = -(1 << 63), (1 << 63) - 1


def kd_split(rows: DataFrame, dims: list[str], shards: int, total: int) -> DataFrame:
    """``rows`` (dims as long, tie, row, size; staged) with ``shard``, the leaf's number from the left.

    ``total``: the bytes of all rows, more than 0. A level takes one pass for its nodes' ranges and a
    few that narrow its cuts; rows are written with their node, but never shuffled or sorted.
    """
    leaves, first = {1: shards}, {1: 0}  # node -> shards below it, the first of them; node n has children 2n and 2n + 1
    level, extent = rows.withColumn("node", F.lit(1)), None
    while any(k > 1 for k in leaves.values()):
        ends = [f(d).alias(f"{name}_{d}") for d in dims for name, f in (("low", F.min), ("high", F.max))]
        nodes = {r["node"]: r for r in level.groupBy("node").agg(F.sum("size").alias("bytes"), *ends).collect()}  # a row for each node
        extent = extent or {d: max(1, nodes[1][f"high_{d}"] - nodes[1][f"low_{d}"]) for d in dims}
        cuts = []
        for n, k in leaves.items():
            if k > 1 and (r := nodes.get(n)):
                widest = max(dims, key=lambda d: (r[f"high_{d}"] - r[f"low_{d}"]) / extent[d])  # ties: the first one named
                cuts.append(_Cut(n, widest, r["bytes"] * (k // 2) / k, key=[widest], low=r[f"low_{widest}"], high=r[f"high_{widest}"]))
        while any(not c.done for c in cuts):
            _narrow(cuts, level, TOLERANCE * total / shards, WHOLE_RUN * total / shards)
        child = F.col("node")
        for c in cuts:
            child = F.when(F.col("node") == c.node, F.when(c.left(), 2 * c.node).otherwise(2 * c.node + 1)).otherwise(child)
        # Written, so that the next level's expressions don't nest this one's.
        level = staged(level.withColumn("node", child), "level")
        below: dict[int, int] = {}
        for n, k in leaves.items():
            if k == 1 or n not in nodes:
                below[n] = 1
            else:
                below |= {2 * n: k // 2, 2 * n + 1: k - k // 2}
                first |= {2 * n: first[n], 2 * n + 1: first[n] + k // 2}
        leaves = below
    shard = F.lit(None).cast("int")
    for n in leaves:
        shard = F.when(F.col("node") == n, first[n]).otherwise(shard)
    return level.withColumn("shard", shard).drop("node")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """A row for each row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Dimensions: the text's bytes and its language (by its hash). Sizes are near equal in bytes
    (law ``bytes``): shards differ by the tolerance, by the largest document if that is more, or by the
    copies that a cut would have split.
    Null text has no bytes, null lang counts as a language; repeated rows are placed each for
    itself; an empty table gives an empty result. Other columns are ignored.
    """
    text = F.col("text")
    rows = exact_columns(docs, [("doc_id", "long"), ("text", "string"), ("lang", "string")])
    rows = rows.select("doc_id", (utf8_bytes(text) + ROW_BYTES).alias("size"), crc32_text(text).alias("text_crc32"), F.xxhash64("text").alias("tie"), F.xxhash64("lang").alias("lang"), F.monotonically_increasing_id().alias("row"))
    rows = staged(rows, "rows")
    total = rows.agg(F.sum("size")).first()[0]
    # Sixteen steps for each doubling of the bytes, and the hash's upper half, make even coordinates.
    metadata = rows.withColumn("bytes", F.floor(F.log2("size") * 16).cast("long")).withColumn("lang", F.shiftright("lang", 32))
    placed = kd_split(metadata, ["bytes", "lang"], shards, total) if total else rows.withColumn("shard", F.lit(0))
    placed = placed.withColumn("chunk", F.shiftright("row", 33))  # the task that numbered the row
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    bases = prefix_sums(counts, ["shard"], "chunk", "n", "base").drop("n")
    nth = F.row_number().over(Window.partitionBy("chunk", "shard").orderBy("row")) - 1
    out = placed.withColumn("nth", nth).join(bases, ["shard", "chunk"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
