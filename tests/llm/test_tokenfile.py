import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from starledger.llm import tokenfile
from starledger.llm.common import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows, end_id=2):
    library, out, start = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip_in_doc_id_order(spark):
    texts = ["", None, "a\tb  c\n\n", "word " * 30000, "é ü", "x" * 3000, "a <|endoftext|> b"] + [f"Text {i}, and more.\nLine" for i in range(500)]
    rows = [(7 * i + 1, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(a, b, "z", 9) for a, b in rows[::-1]], "doc_id long, text string, chunk string, start int").repartition(6)
    path = scratch(spark, "orc-test")
    got = tokenfile.store_tokens(docs, PATH, 2, path).collect()
    assert sorted(tuple(r)[:4] for r in got) == expected(rows)
    one = tokenfile.read_documents(spark, path, [rows[3][0], 2])
    assert [r["doc_id"] for r in one.collect()] == [rows[3][0]]
    assert "PushedFilters: [In(doc_id" in one._jdf.queryExecution().toString() or "In(doc_id" in one._jdf.queryExecution().executedPlan().toString()


def test_files_hold_ordered_ranges(spark):
    docs = spark.range(2000).selectExpr("id * 3 as doc_id", "repeat('abc def ', 20) as text").repartition(7)
    path = scratch(spark, "orc-test")
    tokenfile.write_tokens(docs, path, PATH, 2)
    rows = tokenfile.read_tokens(spark, path).groupBy("chunk").agg({"doc_id": "min"}).toPandas()
    top = tokenfile.read_tokens(spark, path).groupBy("chunk").agg({"doc_id": "max"}).toPandas()
    both = rows.merge(top, on="chunk").sort_values("chunk")
    assert (both["min(doc_id)"].values[1:] > both["max(doc_id)"].values[:-1]).all()


def test_null_and_repeated_ids_and_no_rows(spark):
    rows = [(None, "b"), (5, "same"), (5, "same"), (None, None), (1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in tokenfile.store_tokens(docs, PATH).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 1, 5, 5]
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    assert tokenfile.store_tokens(docs.limit(0), PATH).count() == 0
