"""Best-fit packing of documents into token sequences by large-item matching.

Where a piece goes depends only on how many pieces there are of each length, and lengths are at
most the capacity. So the packing is planned on the driver over that histogram (a row for each
length, whatever the corpus), as ranges of equal bins, and each piece finds its own place from its
length and its rank among the pieces of that length:

* pieces above one third of the capacity are matched, at most two to a bin: the longest unmatched
  with the longest that still fits beside it;
* shorter pieces, longest first, go to the smallest gap that holds them.

Ranks are distributed: tasks count the lengths they write, prefix sums over those counts give each
task its first rank of each length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.llm.common import exact_columns, prefix_sums, short_batches, staged
from starledger.llm.encode import encoder, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, nth long"
Move = tuple[int, int, int, int]  # length, first rank, first bin, offset


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[Move], int]:
    """Moves that place ``counts[length]`` pieces of each length, and the number of bins.

    A move (length, rank, bin, offset) holds for the ranks from ``rank`` up to the length's next
    move: rank + i goes to bin + i at ``offset``. Work and memory depend on the capacity alone.
    """
    left, used = {k: n for k, n in counts.items() if n > 0}, defaultdict(int)
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("lengths must be from 1 to the capacity")
    moves: list[Move] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> ranges (first bin, bins)
    open_gaps: list[int] = []
    bins = 0

    def place(length: int, n: int, first_bin: int, offset: int) -> None:
        moves.append((length, used[length], first_bin, offset))
        used[length] += n
        left[length] -= n

    def leave(gap: int, first_bin: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                insort(open_gaps, gap)
            gaps[gap].append((first_bin, n))

    large = sorted(k for k in left if 3 * k > capacity)
    for length in reversed(large):
        at = len(large) - 1
        while left[length]:
            at = min(at, bisect_left(large, capacity - length + 1) - 1)
            while at >= 0 and (large[at] > length or left[large[at]] < (2 if large[at] == length else 1)):
                at -= 1
            mate = large[at] if at >= 0 else None
            n = left[length] if mate is None else left[length] // 2 if mate == length else min(left[length], left[mate])
            place(length, n, bins, 0)
            if mate is not None:
                place(mate, n, bins, length)
            leave(capacity - length - (mate or 0), bins, n)
            bins += n
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(open_gaps, length)
            if at == len(open_gaps):  # no gap holds it: new bins, each filled with as many as it takes
                per_bin = capacity // length
                n = max(1, left[length] // per_bin)
                held = min(per_bin, left[length])
                for i in range(held):
                    place(length, n, bins, i * length)
                leave(capacity - held * length, bins, n)
                bins += n
                continue
            gap = open_gaps[at]
            first_bin, n = gaps[gap].pop()
            take = min(n, left[length])
            if take < n:
                gaps[gap].append((first_bin + take, n - take))
            if not gaps[gap]:
                open_gaps.pop(at)
            place(length, take, first_bin, capacity - gap)
            leave(gap - length, first_bin, take)
    return sorted(moves), bins


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keeps_space: bool, keep_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: its ids plus ``end_id``, cut at ``capacity``.

    Null text counts as empty and gives the end id alone. ``chunk`` is the task that wrote the
    piece, ``nth`` its rank among the task's pieces of that length. ``keep_ids`` adds the ids.
    """
    end = np.array([end_id], "<u4").tobytes()
    schema = PIECES + (", ids array<int>" if keep_ids else "")

    def run(batches):
        chunk, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        enc = encoder(tokenizer, keeps_space)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, run_ in slices(texts):
                rows: list[tuple] = []
                kept: list[np.ndarray] = []
                for i, ids in enumerate(enc.encode(run_)):
                    ids += end
                    for p in range(0, len(ids) // 4, capacity):
                        part = ids[4 * p : 4 * (p + capacity)]
                        n = len(part) // 4
                        rows.append((doc_ids[first + i], p // capacity, p, n, zlib.crc32(part), chunk, int(seen[n])))
                        seen[n] += 1
                        if keep_ids:
                            kept.append(np.frombuffer(part, "<i4"))
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
                if keep_ids:
                    arrays.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

    short_batches(docs.sparkSession)
    return exact_columns(docs, [("doc_id", "long"), ("text", "string")]).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (of ``cut_documents``, staged) with ``sequence_id`` and ``offset``; all are placed.

    An empty table stays empty; equal documents are placed each for itself.
    """
    counts = pieces.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    totals = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most a row for each length
    moves, _ = plan_bins(totals, capacity)
    table = np.array(moves, np.int64).reshape(-1, 4)
    keys = (table[:, 0] << 44) + table[:, 1]  # ranks stay below 2 ** 44

    def place(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length.astype(np.int64) << 44) + rank, "right") - 1
            move = table[at]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(move[:, 2] + rank - move[:, 1]), pa.array(move[:, 3])], names=[*kept, "sequence_id", "offset"])

    kept = [c for c in pieces.columns if c not in ("chunk", "nth")]
    bases = prefix_sums(counts, ["length"], "chunk", "n", "base").drop("n")
    ranked = pieces.join(bases, ["chunk", "length"]).select(*kept, (F.col("base") + F.col("nth")).alias("rank"))
    kinds = ", ".join(f"{c} {t}" for c, t in pieces.select(*kept).dtypes)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences of pieces packed with their ids: (sequence_id, doc_ids, ids); a sequence
    holds at most the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.col("parts.doc_id").alias("doc_ids"), F.flatten("parts.ids").alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, keeps_space: bool = False, keep_ids: bool = False) -> DataFrame:
    """Cut and pack ``docs`` (doc_id, text); a row for each piece with its place.

    Nulls: a null text is empty, a null doc_id is carried. Other columns are ignored.
    """
    return pack(staged(cut_documents(docs, tokenizer, end_id, capacity, keeps_space, keep_ids), "pieces"), capacity)
