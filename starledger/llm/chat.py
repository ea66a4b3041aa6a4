"""Chat formatting: cumulative snapshots of a conversation collapse to the longest, which is rendered.

Logs often hold a conversation again after each turn. Every turn gets a rolling hash of the
conversation up to it. A conversation whose last hash is the hash of a longer one's earlier turn is
a prefix of it and goes by an anti-join; of equal conversations the smallest conv_id stays.

Rolling hashes are exclusive ors of the turns' hashes (a turn's number is part of its hash), so
they are computed in parts of ``PART_TURNS`` turns with a prefix over the parts: a conversation
with very many turns isn't gathered in one task, neither here nor when it is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starledger.llm.common import exact_columns, staged

PART_TURNS = 256
#: Rendering of one turn.
TURN_FORMAT = "<|%s|>\n%s\n<|end|>\n"
UNKNOWN_ROLE = "unknown"


def turns_of(conversations: DataFrame) -> DataFrame:
    """Clean turns: conv_id, turn, role, text, part and 128 bits (a, b) of each turn's hash.

    Rows without conv_id belong to no conversation. A null turn comes first (-1), a null role is
    ``unknown``, a null text empty. Rows that repeat a turn exactly count once.
    """
    rows = exact_columns(conversations, [("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string")]).where("conv_id is not null")
    rows = rows.select("conv_id", F.coalesce("turn", F.lit(-1)).alias("turn"), F.coalesce("role", F.lit(UNKNOWN_ROLE)).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"a": _hash(1), "b": _hash(2), "part": F.floor(F.col("turn") / PART_TURNS)})
    return rows.dropDuplicates(["conv_id", "turn", "a", "b"])


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "turn", "role", "text")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, turns, prefix_a, prefix_b, last): the hash of each conversation up to each of
    its turns. Rows of one turn number (branches that a log put together) form one step."""
    steps = turns.groupBy("conv_id", "part", "turn").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count("*").alias("n"))
    parts = steps.groupBy("conv_id", "part").agg(F.bit_xor("a").alias("pa"), F.bit_xor("b").alias("pb"), F.sum("n").alias("pn"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "conv_id",
        "part",
        F.coalesce(F.bit_xor("pa").over(before), F.lit(0)).alias("pa"),
        F.coalesce(F.bit_xor("pb").over(before), F.lit(0)).alias("pb"),
        F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("pn"),
        (F.max("part").over(Window.partitionBy("conv_id")) == F.col("part")).alias("last_part"),
    )
    inside = Window.partitionBy("conv_id", "part").orderBy("turn")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    rolled = steps.select("conv_id", "part", "turn", F.bit_xor("a").over(so_far).alias("a"), F.bit_xor("b").over(so_far).alias("b"), F.sum("n").over(so_far).alias("n"), F.lead("turn").over(inside).isNull().alias("last_in_part"))
    joined = rolled.join(parts, ["conv_id", "part"])
    return joined.select(
        "conv_id",
        "turn",
        (F.col("n") + F.col("pn")).alias("turns"),
        F.col("a").bitwiseXOR(F.col("pa")).alias("prefix_a"),
        F.col("b").bitwiseXOR(F.col("pb")).alias("prefix_b"),
        (F.col("last_in_part") & F.col("last_part")).alias("last"),
    )


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, copies) of the conversations to keep: not a prefix of a longer one, and the
    smallest conv_id of ``copies`` equal ones."""
    prefixes = staged(prefix_hashes(turns), "prefixes")
    key = ["prefix_a", "prefix_b"]
    whole = prefixes.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"), F.first("turns").alias("turns"))
    longer = prefixes.where("not last").select(*key).distinct()
    return whole.join(longer, key, "left_anti").select("conv_id", "turns", "copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, part, turns, copies, text): the kept conversations as chat text, in parts of at most
    PART_TURNS turn numbers (part 0 alone for most). Turns of one number are ordered by role, then text."""
    mine = turns.join(kept.select("conv_id", "copies"), "conv_id")
    line = F.format_string(TURN_FORMAT, "role", "text")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line"))))
    parts = mine.groupBy("conv_id", "part").agg(ordered.alias("t"), F.first("copies").alias("copies"))
    first = Window.partitionBy("conv_id").orderBy("part")
    return parts.select("conv_id", (F.row_number().over(first) - 1).alias("part"), F.size("t").cast("long").alias("turns"), "copies", F.array_join("t.line", "").alias("text"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Collapse and render ``conversations`` (conv_id, turn, role, text); other columns are ignored and
    an empty table gives an empty result. Texts are rendered whole, however long; a conversation of very
    many turns comes in parts, each a row."""
    turns = staged(turns_of(conversations), "turns")
    return render(turns, staged(maximal(turns), "kept"))
