import random
import re

import pytest

from starledger.llm import decontamination as d

SMALL = "/root/testdata/sf0.01"


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items):
    """Documents with a window of 20 aligned words (or a whole shorter item), 75 % of them equal."""
    out = set()
    for doc_id, text in docs:
        w = words(text)
        places = {}
        for i, x in enumerate(w):
            places.setdefault(x, []).append(i)
        for item_id, item_text in items:
            q = words(item_text)
            if len(q) < d.SPAN:
                if len(q) >= d.LEAST and any(w[i : i + len(q)] == q for i in range(len(w))):
                    out.add((doc_id, item_id))
                continue
            n = min(d.WINDOW, len(q))
            shifts = {}
            for j, x in enumerate(q):
                for i in places.get(x, ()):
                    shifts.setdefault(i - j, []).append(j)
            for at in shifts.values():
                at.sort()
                if any(100 * sum(s <= j < s + n for j in at) >= 75 * n for s in range(len(q) - n + 1)):
                    out.add((doc_id, item_id))
                    break
    return out


def test_given_documents(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in d.leaks(docs, items).collect()}
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert got == want and len(got) > 20
    flags = d.decontaminate(docs, items).collect()
    assert {r["doc_id"] for r in flags if not r["kept"]} == {a for a, _ in want} and len(flags) == docs.count()
    assert all(r["contaminated"] != r["kept"] and bool(r["item_ids"]) == r["contaminated"] for r in flags)


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15])
def test_replaced_words(spark, share):
    """Passages with some words replaced, inserted in random prose, are found; the prose alone isn't."""
    rng = random.Random(share)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, prose(rng.randint(20, 60))) for i in range(40)]
    docs = [(i, prose(300)) for i in range(60)]
    for i, item in items:
        new = ["other" if rng.random() < share else w for w in item]
        docs.append((1000 + i, prose(rng.randint(0, 200)) + new + prose(50)))
    frame = lambda rows, c: spark.createDataFrame([(i, " ".join(w).upper() + "!") for i, w in rows], f"{c} long, text string")
    got = {r["doc_id"] for r in d.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    want = {x for x, _ in brute([(i, " ".join(w)) for i, w in docs], [(i, " ".join(w)) for i, w in items])}
    assert not {x for x in got if x < 1000} and got <= want and len(got) >= 0.97 * len(want)


def windows_with_seeds(doc, item):
    """Whether a window of aligned words that holds a shared seed has 75 % of its words equal."""
    n = min(d.WINDOW, len(item))
    for shift in range(-len(item), len(doc)):
        same = [0 <= i + shift < len(doc) and doc[i + shift] == x for i, x in enumerate(item)]
        for s in range(len(item) - n + 1) if sum(same) * 100 >= 75 * n else ():
            if 100 * sum(same[s : s + n]) >= 75 * n and any(all(same[q + o] for o in mask) for mask in d.MASKS for q in range(s, s + n - d.SPAN + 1)):
                return True
    return False


@pytest.mark.parametrize(("share", "words_each"), [(0.2, 30), (0.25, 30), (0.25, 45), (0.2, 14)])
def test_every_overlap_with_a_seed_is_found(spark, share, words_each):
    """Only what shares no seed is missed, wherever the seed lies in the window."""
    rng = random.Random(share + words_each)
    items = [(i, [f"w{i}x{j}" for j in range(words_each)]) for i in range(900)]
    docs = []
    for i, item in items:
        new = ["other" if rng.random() < share else w for w in item]
        docs.append((i, ["before"] * rng.randint(0, 15) + new + ["after"] * rng.randint(0, 15)))
    frame = lambda rows, c: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{c} long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    want = {(i, i) for (i, doc), (_, item) in zip(docs, items, strict=True) if windows_with_seeds(doc, item)}
    whole = brute([(i, " ".join(w)) for i, w in docs], [(i, " ".join(w)) for i, w in items])
    assert got == want and want <= whole and len(want) >= 0.99 * len(whole)


def test_blocks_of_seeds_give_the_same(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {tuple(r) for r in d.leaks(docs, items).collect()}
    monkeypatch.setattr(d, "SEEDS", 900)
    assert {tuple(r) for r in d.leaks(docs, items).collect()} == whole


def test_plan_is_native_and_shuffles_no_text(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = d.leaks(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_odd_rows(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, passage), (1, passage), (2, None), (3, ""), (None, passage), (4, "alpha beta gamma"), (5, "x " * 60000 + passage + " y" * 60000), (6, "?? " + passage.replace("zeta", "other").title().replace(" ", ", "))]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, words string, seeds int")
    items = spark.createDataFrame([(1, passage, 0), (2, None, 0), (3, "too short", 0), (None, passage, 0), (1, passage, 0)], "item_id long, text string, words int")
    out = d.decontaminate(docs, items).collect()
    assert len(out) == len(rows)
    assert {r["doc_id"] for r in out if r["contaminated"]} == {1, 5, 6}
    kept = d.drop_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3, 4]
    assert d.decontaminate(docs.limit(0), items).count() == 0
    assert all(r["kept"] for r in d.decontaminate(docs, items.limit(0)).collect())


def test_short_items_match_as_a_whole(spark):
    """Items of five to eight words, which no mask spans; shorter ones would match by chance."""
    items = [(n, " ".join(f"k{n}w{j}" for j in range(n))) for n in range(1, 11)]
    texts = {n: f"before it {text} and after" for n, text in items}
    docs = [*texts.items(), *((100 + n, text.replace("w2", "other")) for n, text in texts.items()), (200, items[7][1]), (201, " ".join(items[7][1].split()[:7]))]
    frame = lambda rows, c: spark.createDataFrame(rows, f"{c} long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == brute(docs, items)
    assert {(n, n) for n in range(5, 11)} | {(200, 8)} <= got and not any(n < 5 for _, n in got)


def test_long_items_are_not_broadcast(spark):
    """What is broadcast of an item is a few numbers a seed; a long item's words are read for hits alone."""
    long = [f"l{i}" for i in range(2002)]
    items = spark.createDataFrame([(1, " ".join(long))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(["x"] * 50 + long[700:730] + ["y"] * 50)), (2, "nothing of it")], "doc_id long, text string")
    found = d.leaks(docs, items)
    assert [tuple(r) for r in found.collect()] == [(1, 1, 20, 20)]
    kinds = dict(d._item_seeds(items.select("item_id", d.words_of("text").alias("item"))).dtypes)
    assert set(kinds) == {"seed", "item_id", "q"} and all(k in ("bigint", "int") for k in kinds.values())
