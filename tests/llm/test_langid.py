import itertools

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from starledger.llm import langid

PATH = public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.01"


def brute(word, pieces, p, floor):
    """Sum over all ways to cut "▁" + word; a character that isn't a piece has the floor."""
    s, total = "▁" + word, np.zeros(p.shape[1])
    for cuts in itertools.product((0, 1), repeat=len(s) - 1):
        parts, last = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(s[last:i])
                last = i
        product = np.ones(p.shape[1])
        for part in parts:
            product = product * (p[pieces.index(part)] if part in pieces else floor if len(part) == 1 else 0)
        total += product
    return total


def test_forward_sums_all_segmentations():
    pieces = ["", "▁", "a", "b", "ab", "▁a", "ba", "abab", "▁abc"]
    p = np.random.default_rng(0).random((len(pieces), 3))
    p[0] = p[1:].min()
    scorer = langid.Scorer(pieces, p)
    words = ["a", "ab", "abab", "babab", "abc", "cab", "zz"]
    got = scorer.forward(words)
    for w, row in zip(words, got, strict=True):
        assert np.allclose(row, np.log(brute(w, pieces, p, p.min())))


def test_long_words_stay_in_range():
    pieces = ["", "▁", "a", "aa"]
    p = np.full((4, 2), 1e-6)
    scores = langid.Scorer(pieces, p).forward(["a" * 5000, "a"])
    assert np.isfinite(scores).all() and scores[0, 0] < -20000


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = langid.identify(docs, langid.fit(docs, PATH)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(out) == docs.count()
    fresh = out[out.held_out]
    assert len(fresh) > 150 and (fresh.lang_pred == fresh.lang).mean() > 0.97
    assert out.score.between(0, 1).all()


def test_labels_of_held_out_rows_and_other_columns_have_no_influence(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(300)
    changed = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    a, b = (langid.identify(x, langid.fit(x, PATH)).orderBy("doc_id").toPandas() for x in (docs, changed))
    assert a.equals(b)


def test_odd_rows(spark):
    texts = [(1, "the cat and the dog", "en"), (2, "el perro y el gato", "es"), (3, "123 !!", "en"), (4, None, "en"), (5, "", None), (None, "the dog", None), (1, "the cat and the dog", "en"), (9, "the " * 50000 + "x" * 9000, None)]
    docs = spark.createDataFrame([(*t, 1.0, "n") for t in texts], "doc_id long, text string, lang string, score double, held_out string")
    train = docs.union(spark.createDataFrame([(i, t, c, 1.0, "n") for i in range(20, 60) for t, c in (("the cat is in the house", "en"), ("el gato está en la casa", "es"))], docs.schema))
    model = langid.fit(train, PATH)
    out = langid.identify(docs, model).collect()
    by = {r["doc_id"]: r for r in out}
    assert by[3]["lang_pred"] == by[4]["lang_pred"] == by[5]["lang_pred"] == "und" and by[3]["score"] == 0
    assert by[None]["lang_pred"] == "en" and not by[None]["held_out"] and by[2]["lang_pred"] == "es" and by[9]["lang_pred"] == "en"
    kept = langid.keep_known(train, PATH)
    assert kept.columns == train.columns and sorted(r["doc_id"] or 0 for r in kept.where("doc_id < 20 or doc_id is null").collect()) == [0, 1, 1, 2, 9]


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs, langid.fit(docs, PATH)).collect()[0]["lang_pred"] == "und"
    none = docs.limit(0)
    assert langid.identify(none, langid.fit(none, PATH)).count() == 0


@pytest.mark.parametrize("doc_id", [0, 7, 123456])
def test_fold_is_crc32_of_the_id(spark, doc_id):
    import zlib

    got = spark.range(1).select(langid.held_out(F.lit(doc_id))).first()[0]
    assert got == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
