import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starledger.llm import minhash
from starledger.llm.components import components
from starledger.llm.shingles import sequence_keys, shingle_sets


def shingles(text, width=5):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def brute(rows, percent=75):
    sets = {}
    for i, text in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(text))
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if any(len(x & y) and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])]
    return union_find(ids, links)


alphabet = st.sampled_from(list("aAbé \t\n\x0b\x1c "))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.text(alphabet, max_size=40), max_size=8), st.integers(0, 2))
def test_sets_and_keys_follow_the_words(texts, cut):
    column = pa.array(["cut"] * cut + texts, pa.string()).slice(cut)
    want = [shingles(t) for t in texts]
    got = shingle_sets(column, 5)
    assert [len(s) for s in got] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(set(got[i].tolist()) & set(got[j].tolist())) == len(want[i] & want[j])
    words = [tuple(x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if x) for t in texts]
    a, b = sequence_keys(column)
    keys = list(zip(a.tolist(), b.tolist(), strict=True))
    assert all((keys[i] == keys[j]) == (words[i] == words[j]) for i in range(len(texts)) for j in range(i))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == union_find(nodes, [e for e in edges if e[0] != e[1]])


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 3000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(path + hub, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(3000))


def corpus(seed):
    """Prose with groups of copies and near copies, one of them large, and a passage that a third share."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(int(rng.expovariate(0.01)))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(400):
        w = [word() for _ in range(rng.choice([0, 3, 5, 30, 80, 200, 600]))]
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage
        rows.append(w)
    base = [word() for _ in range(150)]
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = word()
        rows.append(copy)
    for _ in range(60):
        copy = list(rows[rng.randrange(400)])
        for _ in range(rng.randint(0, 6)):
            if copy:
                copy[rng.randrange(len(copy))] = word()
        rows.append(copy)
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = minhash.near_duplicates(docs).collect()
    want = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    text = dict(rows)
    assert all(r["n_shingles"] == len(shingles(text[r["doc_id"]])) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    assert len(set(want.values())) < 420


def test_pairs_within_a_large_group_are_not_made(spark):
    """Many near copies of one text: pairs to verify stay in proportion to the documents."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = minhash.sketches(docs, 5, minhash.SKETCH).selectExpr("doc_id as rep", "n_shingles as n", "sketch").cache()
    lists = minhash.inverted_lists(classes, minhash.SKETCH, 75).cache()
    stars = minhash.star_pairs(lists)
    assert stars.count() <= 600
    joined = components(minhash.confirmed(stars, docs, 5, 75))
    unsettled = minhash.open_classes(lists, joined).cache()
    assert minhash.open_pairs(minhash.full_sets(docs, unsettled, 5), unsettled, 75).count() <= 2 * 600
    assert {r["component_id"] for r in minhash.near_duplicates(docs).collect()} == {0}


def test_a_cloud_of_texts_below_the_similarity_gives_few_pairs(spark):
    """Copies with too many changes share much with each other and are linked with nothing."""
    rng = random.Random(6)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(300):
        copy = list(base)
        for at in rng.sample(range(150), 7):
            copy[at] = f"x{i}_{at}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = docs.selectExpr("doc_id", "doc_id as component")
    sets = minhash.full_sets(docs, ids, 5).cache()
    assert minhash.open_pairs(sets, ids, 75).count() < 300
    assert all(r["kept"] for r in minhash.near_duplicates(docs).collect())


def test_odd_rows(spark):
    long_text = " ".join(f"t{i}" for i in range(40000))
    rows = [(5, "one two three"), (3, "ONE  two\tthree"), (4, "one two three four"), (1, None), (2, ""), (7, " \n "), (None, "one two three"), (9, long_text), (8, long_text + " end"), (3, "ONE  two\tthree"), (11, "a b c d e"), (12, "a b c d e")]
    docs = spark.createDataFrame([(*r, 0, "k") for r in rows], "doc_id long, text string, rep long, sketch string")
    out = minhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out}
    assert found == {5: (1, 3, False), 3: (1, 3, True), 4: (1, 4, True), 1: (0, 1, True), 2: (0, 2, True), 7: (0, 7, True), None: (1, None, True), 9: (39996, 8, False), 8: (39997, 8, True), 11: (1, 11, True), 12: (1, 11, False)}
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 3, 4, 7, 8, 11]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_words_and_orders_that_cancel_in_simple_hashes():
    """Thue-Morse words collide for every polynomial modulo a power of two, a b b a with b a a b for
    multiples of one number."""
    import pyarrow as pa

    from starledger.llm.shingles import sequence_keys, shingle_sets

    for power in range(1, 12):
        word = "a"
        for _ in range(power):
            word += word.translate(str.maketrans("ab", "ba"))
        other = word.translate(str.maketrans("ab", "ba"))
        texts = pa.array([f"{w} x y z u v" for w in (word, other)])
        one, two = shingle_sets(texts, 5)
        assert len(set(one.tolist()) & set(two.tolist())) == 1  # x y z u v
        keys = list(zip(*sequence_keys(texts), strict=True))
        assert keys[0] != keys[1]
    orders = pa.array(["a b b a x", "b a a b x", "a b b a", "b a a b", "x a b b a", "x b a a b"])
    assert len({tuple(s.tolist()) for s in shingle_sets(orders, 5)}) == 6
