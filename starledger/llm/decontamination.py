"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions.

A seed hashes the words at a mask's positions and ignores those between, so a passage with some
words replaced still shares seeds with its source. The seeds of the benchmark are joined with those
of every document; around each hit, the aligned words are compared one by one, and the best window
that holds the seed counts.

The benchmark's seeds are broadcast in blocks of a fixed size, so no document is shuffled to find hits
and a large benchmark takes more passes, not more memory. Only documents with hits are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.llm.common import bounded_broadcast, exact_columns, staged

#: Word positions that a seed reads.
MASKS = ((0, 1, 4, 5, 8), (0, 1, 2, 4, 7), (0, 2, 3, 5, 8))
SPAN = 1 + max(map(max, MASKS))
#: Words in a window that holds a hit (a shorter item: all of its words), and the share that must be equal.
WINDOW = 20
PERCENT = 75
#: Words of the shortest items that are looked for: as many as a seed reads.
LEAST = len(MASKS[0])
#: Seeds of the benchmark in one broadcast (24 bytes each), and alignments in one.
SEEDS, ALIGNMENTS = 1_000_000, 200_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def seeds_of(words: Column) -> Column:
    """For each mask in turn, the hash of the words it reads at each position where a span fits."""

    def hashed(h: Column) -> Column:
        places = F.when(F.size(h) >= SPAN, F.sequence(F.lit(0), F.size(h) - SPAN)).otherwise(F.array().cast("array<int>"))
        return _let(places, lambda p: F.concat(*(_masked(p, h, k, mask) for k, mask in enumerate(MASKS))))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), hashed)


def _masked(places: Column, h: Column, number: int, mask: tuple[int, ...]) -> Column:
    return F.transform(places, lambda i: F.xxhash64(F.lit(number), *(F.get(h, i + o) for o in mask)))


def _position(at: Column, words: Column) -> Column:
    """The word position of the seed at index ``at``: the masks' seeds follow each other."""
    return F.pmod(at, F.size(words) - (SPAN - 1))


def _whole(words: Column, length: int, at: Column) -> Column:
    """The hash of ``length`` words from ``at`` on."""
    return F.xxhash64(F.lit(-length), *(F.xxhash64(F.get(words, at + i)) for i in range(length)))


def _item_seeds(items: DataFrame) -> DataFrame:
    """(seed, item_id, q): the masks' seeds of items of a span's words and more; shorter ones as a whole."""
    long = items.where(F.size("item") >= SPAN).select("item_id", "item", F.posexplode(seeds_of(F.col("item"))).alias("at", "seed"))
    seeds = long.select("seed", "item_id", _position(F.col("at"), F.col("item")).alias("q"))
    for n in range(LEAST, SPAN):
        seeds = seeds.union(items.where(F.size("item") == n).select(_whole(F.col("item"), n, F.lit(0)), "item_id", F.lit(0)))
    return seeds


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, matched, compared): for each document and benchmark item that overlap, the
    most equal words seen in a window that holds a hit, and the window's words.

    An overlap has at least ``percent`` equal words in any ``WINDOW`` aligned ones that hold a shared
    seed; an item of LEAST to SPAN - 1 words must be there word for word. Shorter items match nothing,
    nor do null texts and rows without an id; rows that repeat an id are one document (item). Texts
    and items may be of any length. Empty tables have no overlaps; other columns are ignored.

    The first pass over the documents finds where seeds meet: only (seed, item, place) is broadcast. The
    second reads the words of the documents and items that met, and compares them.
    """
    items = exact_columns(benchmark, [("item_id", "long"), ("text", "string")]).where("item_id is not null")
    items = staged(items.select("item_id", words_of(F.col("text")).alias("item")).where(F.size("item") >= LEAST), "items")
    seeds = staged(_item_seeds(items).distinct(), "seeds")
    blocks = max(1, math.ceil(seeds.count() / SEEDS))
    short = [r["n"] for r in items.where(F.size("item") < SPAN).select(F.size("item").alias("n")).distinct().collect()]  # SPAN - LEAST rows at most
    raw = exact_columns(docs, [("doc_id", "long"), ("text", "string")]).where("doc_id is not null and text is not null")
    texts = raw.select("doc_id", words_of(F.col("text")).alias("words"))
    # The outer form: else a filter on the seeds' number is inferred and computes them twice. Seeds are
    # exploded and joined in one generated loop, in which a document's words are passed by reference:
    # their number is taken from them after the join, or they would be split twice.
    places = texts.withColumn("seeds", seeds_of(F.col("words"))).select("doc_id", "words", F.posexplode_outer("seeds").alias("at", "seed"))
    short_places = None
    for n in short:
        starts = F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n)).otherwise(F.array().cast("array<int>"))
        whole = _let(starts, lambda at: F.transform(at, lambda i: _whole(F.col("words"), n, i)))  # noqa: B023
        found = texts.select("doc_id", F.posexplode(whole).alias("p", "seed"))
        short_places = found if short_places is None else short_places.unionAll(found)
    met = None
    for block in range(blocks):
        part = F.broadcast(seeds.where(F.pmod("seed", F.lit(blocks)) == block) if blocks > 1 else seeds)
        hits = places.join(part, "seed").select("doc_id", "item_id", (_position(F.col("at"), F.col("words")) - F.col("q")).alias("shift"), "q")
        met = hits if met is None else met.union(hits)
        if short_places is not None:
            met = met.union(short_places.join(part, "seed").select("doc_id", "item_id", (F.col("p") - F.col("q")).alias("shift"), "q"))
    met = staged(met.groupBy("doc_id", "item_id", "shift").agg(F.collect_set("q").alias("qs")), "met")
    best = _compared(met, raw, items).groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "compared")).alias("m"))
    return best.select("doc_id", "item_id", "m.*").where(F.col("matched") * 100 >= F.col("compared") * percent)


def _compared(met: DataFrame, raw: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, compared) of each alignment: the equal words in the best window that
    holds one of its seeds (``qs``, their places in the item)."""
    few = raw.join(bounded_broadcast(staged(met.select("doc_id").distinct(), "met-docs")), "doc_id", "left_semi")
    docs = few.select("doc_id", words_of(F.col("text")).alias("words"))  # only these are split again
    both = docs.join(bounded_broadcast(met, ALIGNMENTS), "doc_id").join(items, "item_id")
    room = WINDOW - SPAN

    def matched(q: Column) -> Column:
        # Bit i: the item's word at q - room + i is equal. Windows that begin before the item or end after
        # it hold no more equal words than the one moved inside, which is among those tried.
        same = lambda i: F.get("item", q - room + i) == F.get("words", q - room + i + F.col("shift"))
        bits = F.aggregate(F.sequence(F.lit(0), F.lit(WINDOW + room - 1)), F.lit(0).cast("long"), lambda b, i: F.when(same(i), b.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(b))
        whole = F.lit((1 << WINDOW) - 1).cast("long")
        return _let(bits, lambda b: F.greatest(*(F.bit_count(F.shiftright(b, k).bitwiseAND(whole)) for k in range(room + 1))))

    # A short item has one hit, which is checked as a whole: all its words are equal if its hash is right.
    return both.select("doc_id", "item_id", F.array_max(F.transform("qs", matched)).alias("matched"), F.least(F.lit(WINDOW), F.size("item")).alias("compared")).where((F.col("compared") >= SPAN) | (F.col("matched") == F.col("compared")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row for each row of ``docs``: doc_id, contaminated, item_ids (of the items it overlaps), kept.

    A document without an id or a text is kept; rows that repeat an id are judged alike, by all of them.
    What overlaps is said in ``leaks``; an empty benchmark keeps all, no documents give no rows, and
    other columns, whatever their names, are ignored.
    """
    found = staged(leaks(docs, benchmark, percent).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")), "leaks")
    rows = exact_columns(docs, [("doc_id", "long")]).join(found, "doc_id", "left")
    hit = F.col("item_ids").isNotNull()
    return rows.select("doc_id", hit.alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), (~hit).alias("kept"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, all columns as they are."""
    found = staged(leaks(docs, benchmark).select("doc_id").distinct(), "leaks")
    return docs.join(bounded_broadcast(found), "doc_id", "left_anti").select(docs.columns)
