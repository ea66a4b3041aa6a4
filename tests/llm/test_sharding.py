import zlib

import pytest

from starledger.llm import sharding

SMALL = "/root/testdata/sf0.01"


def check(out, rows, shards=24):
    assert len(out) == len(rows)
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted(map(tuple, out.fillna({"doc_id": -1})[["doc_id", "size", "text_crc32"]].astype(int).values.tolist())) == want
    assert set(out.law) == {"bytes"} and out.grown_shard.isna().all() and out.shard.between(0, shards - 1).all()
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sizes = out.groupby("shard")["size"].sum().reindex(range(shards), fill_value=0)
    share = sizes.sum() / shards
    assert (sizes - share).abs().max() <= max(4 * out["size"].max(), 0.02 * share)


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    check(sharding.shard_documents(docs).toPandas(), rows)


def test_copies_stay_together_unless_a_cut_falls_among_them(spark):
    """A third of all rows are copies of one text: they fill a run of shards, other copies share one."""
    rows = [(i, "the same text " * 10, "en") for i in range(1000)] + [(1000 + i, f"text {i // 2} " * (10 + i % 7 // 6), ("en", "de")[i // 2 % 2]) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    out = sharding.shard_documents(docs).toPandas()
    check(out, rows)
    text = {i: t for i, t, _ in rows}
    spread = out.assign(text=out.doc_id.map(text)).groupby("text").shard.nunique()
    assert list(spread[spread > 1].index) == [text[0]]
    hot = sorted(out[out.doc_id < 1000].shard.unique())
    assert hot == list(range(hot[0], hot[-1] + 1))


@pytest.mark.parametrize(
    "rows",
    [
        [(1, None, None), (1, None, None), (None, "", "x"), (2, "y" * 200_000, None), (3, "a", "en")],
        [(1, "one", "en")],
        [(i, "x", "en") for i in range(100)],
    ],
)
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, lang string, shard int, size string")
    check(sharding.shard_documents(docs).toPandas(), rows)


def test_no_rows(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def plain_tree(rows, dims, shards, run):
    """{row: shard} by recursion over sorted lists: (dims..., tie, row, size) rows."""
    extent = [max(1, max(r[d] for r in rows) - min(r[d] for r in rows)) for d in range(dims)]
    out = {}

    def split(part, k, first):
        if k == 1 or not part:
            out.update((r[-2], first) for r in part)
            return
        widths = [(max(r[d] for r in part) - min(r[d] for r in part)) / extent[d] for d in range(dims)]
        axis = widths.index(max(widths))
        part = sorted(part, key=lambda r: (r[axis], r[-3], r[-2]))
        runs = {}
        for r in part:
            runs.setdefault((r[axis], r[-3]), []).append(r)
        units = []
        for group in runs.values():
            units += [group] if sum(r[-1] for r in group) <= run else [[r] for r in group]
        target, left = sum(r[-1] for r in part) * (k // 2) / k, []
        for unit in units:
            size, below = sum(r[-1] for r in unit), sum(r[-1] for r in left)
            if below + size > target:
                if target - below > size / 2:
                    left += unit
                break
            left += unit
        split(left, k // 2, first)
        split(part[len(left) :], k - k // 2, first + k // 2)

    split(rows, shards, 0)
    return out


@pytest.mark.parametrize(("seed", "shards"), [(1, 7), (2, 24)])
def test_plain_tree(spark, monkeypatch, seed, shards):
    """Exact cuts (no tolerance) are those of a k-d tree built by sorting, copies whole or split."""
    import random

    rng = random.Random(seed)
    monkeypatch.setattr(sharding, "TOLERANCE", 0.0)
    rows = []
    for i in range(150):
        shape = (rng.randrange(40), rng.randrange(-5, 5), rng.randrange(-(2**62), 2**62), rng.randrange(8, 300))
        rows += [(*shape[:3], len(rows) + j, shape[3]) for j in range(rng.choice([1, 1, 1, 2, 5, 30]))]
    total = sum(r[-1] for r in rows)
    table = spark.createDataFrame(rows, "a long, b long, tie long, row long, size long").repartition(4)
    got = {r["row"]: r["shard"] for r in sharding.kd_split(table, ["a", "b"], shards, total).collect()}
    assert got == plain_tree(rows, 2, shards, sharding.WHOLE_RUN * total / shards)


def test_no_group_of_the_given_copies_is_split(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = sharding.shard_documents(docs).toPandas()
    spread = out[out["size"] > 8].groupby(["text_crc32", "size"]).shard.nunique()
    assert (spread == 1).all()
    sizes = out.groupby("shard")["size"].sum()
    assert sizes.max() <= 1.15 * sizes.mean() and sizes.min() >= 0.85 * sizes.mean()
