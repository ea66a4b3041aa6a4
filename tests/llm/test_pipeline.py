import subprocess
import sys

import pytest

import __spark_entry__
import corpus_pipeline
from starledger.llm import catalog
from tests.llm import test_decontamination, test_minhash

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage returned, written and reread as the driver does."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("pipeline") / str(k))
        stage(spark, docs, SMALL).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_keep_the_columns_of_documents(steps):
    for before, after in steps[:-1]:
        assert after.dtypes == before.dtypes


def test_language_stage_keeps_all_with_letters(steps):
    before, after = steps[0]
    assert {i for i, _ in rows(after)} == {i for i, t in rows(before) if t and any(c.isalpha() for c in t)}


def test_one_of_each_group_stays(steps):
    before, after = steps[1]
    assert sorted(i for i, _ in rows(after)) == sorted({*test_minhash.brute(rows(before)).values()})


def test_leaks_go_and_nothing_else(spark, steps):
    before, after = steps[2]
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    leaks = {i for i, _ in test_decontamination.brute(rows(before), [(r["item_id"], r["text"]) for r in items])}
    assert leaks and {i for i, _ in rows(after)} == {i for i, _ in rows(before)} - leaks


def test_all_that_is_left_is_packed(steps):
    before, after = steps[3]
    out = after.toPandas()
    assert set(out.doc_id) == {i for i, _ in rows(before)} and out.groupby("sequence_id").length.sum().max() <= 2048


def test_run_gives_the_last_stage(spark, steps):
    got, want = (sorted(map(tuple, x.select("doc_id", "piece", "start", "length", "ids_crc32").collect())) for x in (corpus_pipeline.run(spark, SMALL), steps[-1][1]))
    assert got == want


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(sum(x.startswith(f"op{n}_") for x in names) == 1 for n in range(1, 11)) and "pipeline" in names
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and set(catalog.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


def test_entry_without_the_subpackage():
    code = "import sys; sys.modules['starledger.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith('op') or x == 'pipeline' for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0], timeout=120)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    want, got = con.execute(catalog.ORACLE_SQL[name]).df(), catalog.QUERIES[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True).astype(str) for x in (want, got))
    assert a.equals(b)


ODD = "doc_id long, text string, lang string, source string, n_chars long, words string, seeds int, component_id long, piece string"


def through(spark, docs, tmp_path):
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        out.append(docs)
    return out


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts, columns with the operators' own names."""
    plain = [(i, f"the {i} quick brown foxes number {i * 7} jump over {i * 11} lazy dogs of {i} in the field", "en") for i in range(40)]
    texts = [(None, "a document without any id stays in the corpus", "en"), (100, None, "en"), (101, "", None), (102, "12 34 !!", "en"), (103, "long text of the field " * 40_000, "en"), (104, "the very same text twice over here", "en"), (104, "the very same text twice over here", "en"), (105, "the very same text twice over here", "en")]
    docs = spark.createDataFrame([(i, t, x, "s", len(t or ""), "w", 1, 7, "p") for i, t, x in plain + texts], ODD).repartition(5)
    language, near, leaks, packed = through(spark, docs, tmp_path)
    assert all(step.columns == docs.columns for step in (language, near, leaks))
    assert {r["doc_id"] for r in language.collect()} == {None, *range(40), 103, 104, 105}
    assert {r["doc_id"] for r in near.collect()} == {None, *range(40), 103, 104}
    assert {r["doc_id"] for r in leaks.collect()} == {None, *range(40), 103, 104}
    assert {r["doc_id"] for r in packed.collect()} == {None, *range(40), 103, 104}


def test_no_rows_and_no_labels_through_all_stages(spark, tmp_path):
    docs = spark.createDataFrame([(1, "no language is known here", None, "s", 1, "w", 1, 7, "p")], ODD)
    for part, name in ((docs.limit(0), "none"), (docs, "unlabelled")):
        (tmp_path / name).mkdir()
        assert [step.count() for step in through(spark, part, tmp_path / name)] == [0, 0, 0, 0]
