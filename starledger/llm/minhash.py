"""Near-duplicates by bottom-k sketches from one hash function.

A document's sketch holds the k smallest hashes of its shingles. Texts with the same words are one
class from the start, so a group of copies costs one sketch. Then:

1. *Inverted lists.* Two sets with similarity t or more share at least ``overlap_floor`` values of
   their sketches, so they share one among the rarest ``size - floor + 1`` of each (rarity is how
   many sketches hold a value). Only those values get a list: a passage that many documents share
   is common, and gets a list only for documents that hold little else.
2. *Stars.* Each class is compared with one leader: of the classes that hold the most common values
   in its lists, the one it shares most lists with. A candidate is first estimated on the union of
   the two sketches. That joins groups of near copies at a cost in proportion to their size.
3. *The rest.* Classes whose lists still reach other components get lists over their full sets,
   with each value's place in the order of rarity. Two sets are paired only if they are in different
   components and their sizes allow the overlap they need from a first common value at those places
   on. Within one component no pairs are made, and between components none is left out.

Every pair is confirmed on full sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.llm.common import bounded_broadcast, exact_columns, remember_alone, short_batches, staged
from starledger.llm.components import components
from starledger.llm.shingles import sequence_keys, shingle_sets

WORDS = 5
PERCENT = 75
#: Values in a sketch.
SKETCH = 64
#: Standard deviations that estimates may fall short by.
SIGMAS = 5.0


def slack(k: int, percent: int) -> float:
    t = percent / 100
    return SIGMAS * math.sqrt(t * (1 - t) / k)


def overlap_floor(k: int, percent: int) -> int:
    """Values that the k-value sketches of two sets of at least this similarity share (to SIGMAS)."""
    return max(1, math.floor(k * (percent / 100 - slack(k, percent))))


def sketches(docs: DataFrame, words: int, k: int) -> DataFrame:
    """A row for each document with a doc_id: n_shingles, its word sequence's key and its sketch."""

    def run(batches):
        remember_alone()
        for batch in batches:
            texts = batch.column(1)
            a, b = sequence_keys(texts)
            sets = shingle_sets(texts, words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(a), pa.array(b), pa.array([s[:k] for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "key_a", "key_b", "sketch"],
            )

    short_batches(docs.sparkSession)
    return exact_columns(docs, [("doc_id", "long"), ("text", "string")]).mapInArrow(run, "doc_id long, n_shingles long, key_a long, key_b long, sketch array<long>")


def inverted_lists(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(value, rep, n, weight): each class under those of its rarest sketch values that other classes
    hold. ``weight`` adds up the holders of all its values: the centre of a group weighs most."""
    entries = classes.select("rep", F.explode("sketch").alias("value"))
    held = entries.groupBy("value").agg(F.count("*").alias("holders")).where("holders > 1")
    shared = entries.join(held, "value").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("holders", "value"))).alias("shared"), F.sum("holders").alias("weight"))
    size = F.least(F.col("n"), F.lit(k))
    floor = F.when(F.col("n") * 100 <= k * percent, F.ceil(F.col("n") * percent / 100)).otherwise(F.least(F.ceil(F.col("n") * percent / 100), F.lit(overlap_floor(k, percent))))
    rarest = size - floor + 1 - (size - F.size("shared"))  # values that no other class holds come first and need no list
    listed = classes.select("rep", "n").join(shared, "rep").withColumn("take", rarest.cast("int")).where("take > 0")
    return listed.select("rep", "n", "weight", F.explode(F.slice("shared", F.lit(1), F.col("take"))).alias("s")).select(F.col("s.value").alias("value"), "rep", "n", "weight")


def likely(pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose similarity, estimated on the union of their sketches, may suffice."""
    known = classes.select("rep", "sketch")
    both = pairs.join(known.toDF("a", "sketch_a"), "a").join(known.toDF("b", "sketch_b"), "b")
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    common = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), union))
    estimate = common / F.size(union)
    return both.where(estimate >= percent / 100 - slack(k, percent)).select("a", "b")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return exact_columns(docs, [("doc_id", "long"), ("text", "string")]).join(bounded_broadcast(ids), "doc_id", "left_semi").where("text is not null")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs of doc_ids (a, b) whose full sets reach the similarity."""
    pairs = staged(pairs, "pairs")
    ids = staged(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    texts = _texts(docs, ids)
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(shingle_sets(batch.column(2), words), shingle_sets(batch.column(3), words), strict=True):
                n = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(n > 0 and 100 * n >= percent * (len(x) + len(y) - n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def star_pairs(lists: DataFrame) -> DataFrame:
    """Each class with the leader it shares most lists with. Leaders are the heaviest classes of a
    list among sets of like size; ties go to the smaller class."""
    sized = lists.withColumn("size", F.floor(F.log("n") / math.log(4 / 3)))
    heaviest = F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("leader")
    leaders = sized.groupBy("value", "size").agg(heaviest).select("value", "size", (-F.col("leader.minus")).alias("a"))
    votes = sized.join(leaders, ["value", "size"]).where("rep <> a").groupBy("rep", "a").agg(F.count("*").alias("votes"))
    best = votes.groupBy("rep").agg(F.max(F.struct("votes", (-F.col("a")).alias("minus"))).alias("best"))
    return best.select((-F.col("best.minus")).alias("a"), F.col("rep").alias("b"))


def open_classes(lists: DataFrame, joined: DataFrame) -> DataFrame:
    """(doc_id, component) of the classes with a list that holds members of several components."""
    named = lists.select("value", "rep").join(joined, F.col("rep") == F.col("node"), "left")
    named = staged(named.select("value", "rep", F.coalesce("component", "rep").alias("component")), "members")
    span = named.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("value")
    return named.join(span, "value", "left_semi").select(F.col("rep").alias("doc_id"), "component").distinct()


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(rep, n, shingles) of the named documents."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "n", "shingles"])

    return _texts(docs, ids.select("doc_id")).mapInArrow(run, "rep long, n long, shingles array<long>")


def open_pairs(sets: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components whose full sets may reach the similarity.

    Values are ordered by rarity; ``place`` is a value's place in its set. Sets of x and y values
    need ``need`` in common, so their first common value lies at a place of at most size - need.
    """
    entries = sets.select("rep", F.explode("shingles").alias("value"))
    held = entries.groupBy("value").agg(F.count("*").alias("holders")).where("holders > 1")
    shared = entries.join(held, "value").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("holders", "value"))).alias("shared"))
    listed = sets.select("rep", "n").join(shared, "rep").join(component.withColumnRenamed("doc_id", "rep"), "rep")
    alone = F.col("n") - F.size("shared")  # values that no other set holds have the first places
    last = F.floor(F.col("n") - F.col("n") * percent / 100)  # the last place that any partner allows
    listed = listed.withColumn("alone", alone).withColumn("take", (last - F.col("alone") + 1).cast("int")).where("take > 0")
    member = listed.select("rep", "n", "component", "alone", F.posexplode(F.slice("shared", F.lit(1), F.col("take"))).alias("at", "s"))
    member = staged(member.select(F.col("s.value").alias("value"), "rep", "n", "component", (F.col("alone") + F.col("at")).alias("place")), "places")
    counts = member.groupBy("value", "component").agg(F.count("*").alias("members"))
    split = counts.groupBy("value").agg(F.count("*").alias("components"), F.max(F.struct("members", "component")).alias("top")).where("components > 1")
    member = member.join(split.select("value", F.col("top.component").alias("largest")), "value")
    minor = member.where("component <> largest").select("value", F.col("rep").alias("x"), F.col("n").alias("x_n"), F.col("component").alias("x_component"), F.col("place").alias("x_place"))
    need = F.ceil((F.col("n") + F.col("x_n")) * percent / (100 + percent))
    fits = (F.col("place") <= F.col("n") - need) & (F.col("x_place") <= F.col("x_n") - need)
    once = (F.col("component") == F.col("largest")) | (F.col("x") < F.col("rep"))
    on = (minor["value"] == member["value"]) & (F.col("x_component") != F.col("component")) & fits & once
    return minor.join(member, on).select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct()


def confirmed_on_sets(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets, at hand, reach the similarity."""
    known = sets.select("rep", "shingles")
    both = pairs.join(known.toDF("a", "x"), "a").join(known.toDF("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, k: int = SKETCH) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable by links (100 * intersection >= percent * union of
    the shingle sets). Texts that are null or without words link with nothing. Rows that repeat a
    doc_id are one document. A row without doc_id isn't linked: its component_id is null, it is kept.
    Whole texts count, however long; equal texts, however many, are one class and link by it. Sketches
    that tie keep the values that are smallest, in any order of the rows. Other columns are ignored; an
    empty table gives an empty result.
    """
    features = staged(sketches(docs, words, k), "sketches")
    known = features.where("doc_id is not null and n_shingles > 0")
    classes = known.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = staged(classes, "classes")
    lists = staged(inverted_lists(classes, k, percent), "lists")
    stars = staged(confirmed(likely(star_pairs(lists), classes, k, percent), docs, words, percent), "stars")
    unsettled = staged(open_classes(lists, components(stars)), "open")
    sets = staged(full_sets(docs, unsettled, words), "sets")
    if sets.count() > unsettled.count():  # rows that repeat a doc_id
        sets = staged(sets.dropDuplicates(["rep"]), "sets")
    rest = staged(confirmed_on_sets(staged(open_pairs(sets, unsettled, percent), "pairs"), sets, percent), "rest")
    copies = known.join(classes.select("key_a", "key_b", "rep"), ["key_a", "key_b"])
    repeats = copies.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    return_ids = components(stars.union(rest).union(repeats))
    out = features.select("doc_id", "n_shingles").join(return_ids, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept: of each group the document with the smallest doc_id."""
    gone = staged(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(bounded_broadcast(gone), "doc_id", "left_anti").select(docs.columns)
