import random
import zlib

import pytest
from pyspark.sql import functions as F

from starledger.llm import toxicity

SMALL = "/root/testdata/sf0.1"


def brute_segments(scores, others, length):
    """The best segment, then the best ones left and right of it, and so on (shortest and first on ties)."""
    values = [others] * length
    for i, s in scores:
        values[i] = s

    def best(a, b):
        out = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += values[j]
                if total > 1e-9 and (out is None or total > out[0] + 1e-9):
                    out = (total, i, j + 1)
        if out is None:
            return []
        return best(a, out[1]) + [out] + best(out[2], b)

    return best(0, length)


@pytest.mark.parametrize("seed", range(30))
def test_segments(seed):
    rng = random.Random(seed)
    length = rng.randrange(1, 40)
    # Odd multiples of powers of two: sums of different segments are equal only by design.
    scores = [(i, rng.choice([-3.0, -1.3, 0.7, 1.1, 2.9]) + rng.random() / 64) for i in range(length) if rng.random() < 0.5]
    found = toxicity.maximal_segments(scores, -0.45, length)
    expected = brute_segments(scores, -0.45, length)
    assert [(f, e) for _, f, e in found] == [(f, e) for _, f, e in expected]
    assert [s for s, _, _ in found] == pytest.approx([s for s, _, _ in expected])


def test_long_scan_is_linear():
    rising = [(i, 1.0 + i * 1e-9) for i in range(0, 400_000, 2)]
    falling = [(i, 3.0 if i % 4 else -5.0) for i in range(0, 400_000, 2)]
    assert toxicity.maximal_segments(rising, -2.0, 400_000) and toxicity.maximal_segments(falling, -0.1, 400_000)


def test_rate_solves_its_equation():
    shares = [(0.01, 2.0), (0.002, 4.0), (0.03, -1.0)]
    rate = toxicity._rate(shares, -0.2)
    total = sum(p * 2.718281828459045 ** (rate * s) for p, s in shares) + (1 - 0.042) * 2.718281828459045 ** (rate * -0.2)
    assert total == pytest.approx(1) and rate > 0


def corpus(spark, n=600):
    rng = random.Random(6)
    plain = ["".join(rng.choice("abcdeiou") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        toxic = i % 5 == 0
        if toxic:
            for k in range(4 + len(words) // 20):
                words.insert(rng.randrange(len(words)), "zorgh" + rng.choice(["", "en", "est", "ly"]) if k % 2 else "vlim")
        rows.append((i, " ".join(words), "clash", 0.5))
        labels.append((i, int(toxic), 1, "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, label string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int, text string")


def test_learns_and_finds_passages(spark):
    docs, labels = corpus(spark)
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(out) == 600
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    wrong = [i for i, r in out.items() if r["predicted"] != int(i % 5 == 0)]
    assert len(wrong) <= 6
    texts = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    for i in (0, 5, 10, 15):
        assert all(any(w.startswith(("zorgh", "vlim")) for w in texts[i][p["first"] : p["first"] + p["n_tokens"]]) for p in out[i]["passages"])
        assert out[i]["passages"] and all(p["expected"] < 1 for p in out[i]["passages"])


def test_odd_rows(spark):
    docs, labels = corpus(spark, 300)
    odd = [(None, "vlim vlim"), (1000, None), (1001, ""), (1002, "123 !!"), (1003, "vlim " * 5), (1003, "vlim " * 5), (1004, "aboe " * 200_000 + "vlim zorgh vlim zorghen vlim " * 3), (1005, "a" * 1_000_000)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    more = labels.union(spark.createDataFrame([(None, 1, 0, ""), (1000, 1, 0, ""), (1001, None, 0, ""), (1, 0, 0, ""), (1003, 7, 0, "")], labels.schema))
    out = toxicity.toxicity(table, more).collect()
    assert len(out) == 308
    by = {r["doc_id"]: r for r in out}
    assert by[None]["held_out"] is False and by[1000]["score"] == by[1001]["score"] == by[1002]["score"] < 0.1
    assert by[1003]["predicted"] == 1 and len({r["score"] for r in out if r["doc_id"] == 1003}) == 1
    assert by[1004]["n_tokens"] == 200_015 and any(p["first"] >= 199_900 for p in by[1004]["passages"])
    assert all(0 <= r["score"] <= 1 for r in out)


def test_labels_of_one_kind_or_none(spark):
    docs, labels = corpus(spark, 60)
    clean = toxicity.toxicity(docs, labels.withColumn("toxic", F.lit(0))).collect()
    assert {r["predicted"] for r in clean} == {0}
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_held_out_documents(spark):
    """Documents kept from training: nearly all clean ones stay clean, most toxic ones are found."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id")
    n = {(r["toxic"], r["predicted"]): r["n"] for r in out.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    assert n.get((0, 1), 0) <= 0.01 * (n[0, 0] + n.get((0, 1), 0))
    assert n[1, 1] >= 0.8 * (n[1, 1] + n.get((1, 0), 0))
