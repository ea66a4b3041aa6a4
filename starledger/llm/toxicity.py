"""Toxic passages by maximum-scoring segments of token log-odds.

1. Tokens are a text's words (runs of letters, lower-cased). A word's log-odds between toxic and
   clean documents comes from a chain of Dirichlet priors: the split of each beginning of the word
   between the classes is the prior of the next longer one, the word itself comes last. Only odds
   that stand clear of their own error count; all other words share one small negative score.
2. One linear scan finds all maximal-scoring segments of a text (Ruzzo and Tompa): the passages.
3. Scores of passages are calibrated by extreme-value statistics (Karlin and Altschul): lambda solves
   sum p exp(lambda s) = 1 over clean text, K fits the best scores of clean training documents. A
   passage is significant if less than one as good is to be expected in a clean text of that length.
4. The significant passages of a text are joined by the statistics of their sum; a logistic curve,
   fitted on training documents that the scores they got weren't learnt from, makes it a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.llm.common import exact_columns, remember_alone, short_batches, staged
from starledger.llm.shingles import shingle_sets

#: Labelled documents that the model is fitted on, at most (by a hash of doc_id).
TRAIN_ROWS = 20_000
FOLDS = 4
#: Lengths of a word's beginnings that have odds of their own; a word of at most WORD_CHARS letters has too.
BEGINNINGS, WORD_CHARS = range(3, 9), 24
#: Occurrences in one document that count, and documents that must hold a beginning.
MOST_IN_ONE, LEAST_DOCS = 4, 5
#: Weight of the prior, in occurrences; errors of the log-odds that are taken off; log-odds that count.
PRIOR, ERRORS, LEAST_ODDS = 4.0, 2.0, 1.0
#: The share of a class in a prior isn't below this, however many beginnings agree.
LEAST_SHARE = 0.001
#: Beginnings with odds that a model holds at most, by the strength of their evidence.
MODEL_ROWS = 200_000
#: The significance in nats is cut here; widths of its bins when the curve is fitted.
STRONGEST, BIN = 60.0, 0.25
MEMO_WORDS, MEMO_CHARS = 300_000, 64
SLICE_CHARS = 4_000_000

_WORD = re.compile(r"[^\W\d_]+")


def beginnings(word: str) -> list[str]:
    """What of a word has odds, shorter first; the word itself ends in a blank."""
    out = [word[:n] for n in BEGINNINGS if n <= len(word)]
    return [*out, word + " "] if len(word) <= WORD_CHARS else out


def maximal_segments(scores: list[tuple[int, float]], others: float, length: int) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first, end) of ``length`` tokens, in order, in linear time.

    ``scores`` (place, score) are those that aren't ``others``, the negative score of the rest.
    """
    out: list[tuple[float, int, int]] = []
    open_: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, end, nearest with a smaller sum before
    total, at = 0.0, 0
    for place, score in scores:
        total += others * (place - at)
        at = place + 1
        before, total = total, total + score
        if score <= 0:
            continue
        first, end = place, place + 1
        while True:
            k = len(open_) - 1
            while k >= 0 and open_[k][0] >= before:
                k = open_[k][4]
            if k < 0:  # nothing before can grow any more
                out += [(b - a, f, e) for a, b, f, e, _ in open_]
                open_ = [(before, total, first, end, -1)]
                break
            if open_[k][1] >= total:
                open_.append((before, total, first, end, k))
                break
            before, first = open_[k][0], open_[k][2]
            del open_[k:]
    return out + [(b - a, f, e) for a, b, f, e, _ in open_]


@dataclass
class Odds:
    """Scores of beginnings, the score of all other words, and the calibration of passages."""

    scores: dict[str, float]
    others: float
    rate: float = 1.0  # lambda
    k: float = 1.0

    def score(self, word: str) -> float | None:
        """The score of the longest beginning that has one."""
        for b in reversed(beginnings(word)):
            if b in self.scores:
                return self.scores[b]
        return None

    def expected(self, score: float, length: int) -> float:
        """Passages as good that are to be expected in a clean text of so many tokens."""
        return self.k * max(length, 1) * math.exp(-self.rate * score)


def significance(segments: list[tuple[float, int, int]], length: int, odds: Odds) -> float:
    """-ln p of a text's passages: of the best one, or of the sum of the best r significant ones,
    whichever is the least likely; at most STRONGEST."""
    if not segments:
        return 0.0
    space = math.log(odds.k * max(length, 1))
    normal = sorted((odds.rate * s - space for s, _, _ in segments), reverse=True)
    best = -math.log(-math.expm1(-math.exp(-normal[0]))) if normal[0] < 30 else normal[0]
    total = 0.0
    for r, x in enumerate(normal, 1):
        total += x
        if x <= 0 or total > 10 * STRONGEST:
            break
        if r > 1:
            best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
    return min(max(best, 0.0), STRONGEST)


class _Scorer:
    """Scores texts with one model; known words are kept between texts."""

    def __init__(self, odds: Odds):
        self.odds, self._memo = odds, {}

    def forget(self) -> None:
        self._memo.clear()

    def hits(self, text: str) -> tuple[list[tuple[int, float]], int, list[str]]:
        """(place, score) of the words with odds, the number of words, and the words."""
        words = _WORD.findall(text.lower())
        memo = self._memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        new = [w for w in set(words) if w not in memo]
        for w in new:
            memo[w] = self.odds.score(w)
        found = [(i, s) for i, s in enumerate(map(memo.get, words)) if s is not None]
        for w in new:
            if len(w) > MEMO_CHARS:
                del memo[w]
        return found, len(words), words

    def segments(self, text: str) -> tuple[list[tuple[float, int, int]], int]:
        found, n, _ = self.hits(text)
        return maximal_segments(found, self.odds.others, n), n


def _log_odds(counts: dict[str, tuple[float, float, int]], n1: float, n0: float) -> dict[str, tuple[float, float]]:
    """(score, strength) of the beginnings whose log-odds stand clear of their error. ``counts``: capped
    occurrences in toxic and clean documents, and documents; ``n1`` and ``n0``: words of the classes."""
    out: dict[str, tuple[float, float]] = {}
    share: dict[str, float] = {"": 0.5}
    for b in sorted(counts, key=lambda x: (len(x.rstrip(" ")), x.endswith(" "))):
        stem, word = b.rstrip(" "), b.endswith(" ")
        parent = next((stem[:n] for n in reversed(BEGINNINGS) if (n < len(stem) or word and n == len(stem)) and stem[:n] in share), "")
        a1, a0 = counts[b][0], counts[b][1] * n1 / n0  # as many words of either class
        prior = min(max(share[parent], LEAST_SHARE), 1 - LEAST_SHARE)
        share[b] = (a1 + PRIOR * prior) / (a1 + a0 + PRIOR)
        s = math.log((a1 + PRIOR * prior) / (a0 + PRIOR * (1 - prior)))
        # The rarer class carries the error: its own count, not the scaled one.
        error = math.sqrt(1 / (a1 + PRIOR * prior) + 1 / (counts[b][1] + PRIOR * (1 - prior)))
        clear = math.copysign(max(0.0, abs(s) - ERRORS * error), s)
        if counts[b][2] >= LEAST_DOCS:
            above = out.get(parent, (0.0, 0.0))[0] if parent else 0.0
            if abs(clear) >= LEAST_ODDS:
                out[b] = (clear, abs(s) / error)
            elif abs(above) >= LEAST_ODDS and abs(s - above) > ERRORS * error:
                out[b] = (0.0, abs(s - above) / error)  # unlike its beginning
    return out


def _odds(rows: list, n1: float, n0: float) -> Odds:
    """Odds from (beginning, toxic, clean, documents); ``others`` is the log-odds of words without any."""
    if not n1 or not n0:
        return Odds({}, -1.0)
    kept = _log_odds({r[0]: (r[1], r[2], r[3]) for r in rows}, n1, n0)
    strongest = sorted(kept, key=lambda b: (-kept[b][1], b))[:MODEL_ROWS]
    scores = {b: kept[b][0] for b in strongest}
    # Each word counts once, at its longest beginning with odds.
    own: dict[str, list[float]] = {b: [0.0, 0.0] for b in scores}
    by = {r[0]: (r[1], r[2]) for r in rows}
    for b in scores:
        stem, word = b.rstrip(" "), b.endswith(" ")
        above = next((stem[:n] for n in reversed(BEGINNINGS) if (n < len(stem) or word and n == len(stem)) and stem[:n] in scores), None)
        for i in (0, 1):
            own[b][i] += by[b][i]
            if above is not None:
                own[above][i] -= by[b][i]
    used1, used0 = (min(0.9 * n, sum(max(0.0, o[i]) for o in own.values())) for i, n in ((0, n1), (1, n0)))
    others = min(math.log((1 - used1 / n1) / (1 - used0 / n0)), -0.001)
    shares = [(max(own[b][1], 0.5) / n0, s) for b, s in scores.items()]
    return Odds(scores, others, _rate(shares, others))


def _rate(shares: list[tuple[float, float]], others: float) -> float:
    """The positive root of sum p exp(rate s) = 1; words without odds take the rest of the probability."""
    rest = max(0.0, 1 - sum(p for p, _ in shares))

    def excess(rate: float) -> float:
        return sum(p * math.exp(min(rate * s, 500)) for p, s in shares) + rest * math.exp(rate * others) - 1

    high = 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    low = high
    while excess(low) > 0 and low > 2**-20:
        low /= 2
    if excess(low) > 0:  # clean text scores above 0 on average: nothing is significant
        return 2**-20
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return (low + high) / 2


def logistic(bins: list[tuple[float, float, float]]) -> tuple[float, float]:
    """(slope, offset) of the curve through (x, documents, toxic ones), slope at least 0, by Newton steps."""
    x, n, y = (np.array([b[i] for b in bins], float) for i in range(3))
    if not len(x) or not n.sum():
        return 0.0, -30.0
    scale = 10.0
    a = np.array([0.0, math.log((y.sum() + 0.5) / (n.sum() - y.sum() + 0.5))])
    design, ridge = np.stack([x / scale, np.ones_like(x)], 1), np.diag([0.1, 0.01])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + ridge, design.T @ (y - n * p) - ridge @ a)
        a = a + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(a[0]) / scale, float(a[1])) if a[0] > 0 else (0.0, math.log((y.sum() + 0.5) / (n.sum() - y.sum() + 0.5)))


@dataclass
class Model:
    """A fitted model: odds of words, and the curve from significance to probability."""

    odds: Odds
    slope: float
    offset: float

    def probability(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * x + self.offset))))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, label, fold) of at most about ``rows`` labelled documents, one of near copies.

    A document with several labels is toxic if one says so; without a text it doesn't train.
    """
    one = exact_columns(labels, [("doc_id", "long"), ("toxic", "int")]).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    one = staged(one, "toxic-labels")
    total = one.count()
    chosen = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < min(1.0, rows / max(total, 1)) * (1 << 20))
    texts = exact_columns(docs, [("doc_id", "long"), ("text", "string")]).where("text is not null").join(chosen, "doc_id")

    def keyed(batches):
        for batch in batches:
            least = [int(s[0]) if len(s) else None for s in shingle_sets(batch.column(0), 5)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["text", "label", "key"])

    # Near copies share their smallest shingle; many copies of one text would pass for evidence.
    with_key = texts.select("text", "label").mapInArrow(keyed, "text string, label int, key long").where("key is not null")
    least = with_key.groupBy("key", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    return staged(least.select("x.text", "label", F.pmod("key", F.lit(FOLDS)).cast("int").alias("fold")), "toxic-train")


def _counts(train: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """(beginning, label, fold, n, docs) and the number of words of each label and fold."""

    def run(batches):
        for batch in batches:
            seen: dict[tuple[int, int], Counter] = defaultdict(Counter)
            docs: dict[tuple[int, int], Counter] = defaultdict(Counter)
            for text, label, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = Counter(_WORD.findall(text.lower()))
                own: Counter = Counter()
                for w, n in words.items():
                    for b in beginnings(w):
                        own[b] += n
                for b, n in own.items():
                    seen[label, fold][b] += min(n, MOST_IN_ONE)
                docs[label, fold].update(own.keys())
                seen[label, fold][""] += sum(words.values())
            rows = [(b, k[0], k[1], n, docs[k][b]) for k, c in seen.items() for b, n in c.items()]
            if rows:
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["b", "label", "fold", "n", "docs"])

    counted = train.select("text", "label", "fold").mapInArrow(run, "b string, label int, fold int, n long, docs long")
    counted = staged(counted.groupBy("b", "label", "fold").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "toxic-counts")
    return counted, {(r["label"], r["fold"]): r["n"] for r in counted.where("b = ''").collect()}  # two labels, FOLDS folds


def _candidates(counted: DataFrame, words: dict, without: int | None) -> list:
    """(b, toxic, clean, docs) of the beginnings that can have odds, leaving out one fold.

    A beginning is needed if its rate differs by the least odds that count, or if it is the prior of one
    that does; only those in enough documents come to the driver, the strongest first.
    """
    n1, n0 = (sum(n for (label, fold), n in words.items() if label == x and fold != without) for x in (1, 0))
    if not n1 or not n0:
        return []
    part = counted.where("b <> ''") if without is None else counted.where((F.col("b") != "") & (F.col("fold") != without))
    both = part.groupBy("b").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a1"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("a0"), F.sum("docs").alias("d"))
    odds = F.log((F.col("a1") + 0.5) / (F.col("a0") + 0.5) * F.lit(n0 / n1))
    wanted = both.where((F.col("d") >= LEAST_DOCS) & (F.abs(odds) >= LEAST_ODDS / 2)).withColumn("z", F.abs(odds) / F.sqrt(1 / (F.col("a1") + 0.5) + 1 / (F.col("a0") + 0.5)))
    return [tuple(r) for r in wanted.orderBy(F.desc("z"), "b").limit(2 * MODEL_ROWS).select("b", "a1", "a0", "d").collect()]


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1).

    Labels of one kind only, or none, give a model without odds that says the share of toxic ones (0).
    """
    short_batches(docs.sparkSession)
    train = training_rows(docs, labels, rows)
    counted, words = _counts(train)
    models: list[Odds] = []
    for without in [*range(FOLDS), None]:
        n1, n0 = (sum(n for (label, fold), n in words.items() if label == x and fold != without) for x in (1, 0))
        models.append(_odds(_candidates(counted, words, without), n1, n0))
    folds, final = models[:-1], models[-1]

    def scored(batches):
        scorers = [_Scorer(m) for m in folds]
        for batch in batches:
            best, length, label, fold, each = [], [], batch.column(1), batch.column(2), []
            for text, f in zip(batch.column(0).to_pylist(), fold.to_pylist(), strict=True):
                segments, n = scorers[f].segments(text)
                best.append(max((s for s, _, _ in segments), default=0.0))
                length.append(n)
                each.append([s for s, _, _ in sorted(segments, reverse=True)])
            yield pa.RecordBatch.from_arrays([label, fold, pa.array(best, pa.float64()), pa.array(length, pa.int64()), pa.array(each, pa.list_(pa.float64()))], names=["label", "fold", "best", "length", "segments"])

    tried = staged(train.mapInArrow(scored, "label int, fold int, best double, length long, segments array<double>"), "toxic-tried")
    # K: as many best passages of clean documents as expected are as good as they are.
    clean = tried.where("label = 0").withColumn("rate", F.element_at(F.array(*(F.lit(m.rate) for m in folds)), F.col("fold") + 1))
    r = clean.agg(F.count("*").alias("n"), F.sum(F.greatest("length", F.lit(1)) * F.exp(-F.col("rate") * F.col("best"))).alias("t")).first()
    for m in models:
        m.k = max(r["n"], 1) / max(r["t"] or 1.0, 1e-9)

    def placed(batches):
        for batch in batches:
            x = [significance([(s, 0, 0) for s in ss], n, folds[f]) for ss, n, f in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(np.array(x, float) / BIN).astype(np.int64))], names=["label", "bin"])

    bins = tried.select("label", "fold", "segments", "length").mapInArrow(placed, "label int, bin long").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("y"))
    slope, offset = logistic([(b["bin"] * BIN, b["n"], b["y"]) for b in bins.orderBy("bin").collect()])  # at most STRONGEST / BIN rows
    return Model(final, slope, offset)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, score, n_tokens, passages.

    ``score`` is the probability that the text is toxic; ``passages`` are its significant passages as
    (first, n_tokens, score, expected): place of the first word, words, log-odds, and how many as good
    are to be expected in a clean text of that length. A null or empty text, or one without a letter,
    has no passage and the score of no evidence. Whole texts are read, however long; repeated rows
    are scored alike; a null doc_id is carried; an empty table gives an empty result; other columns
    are ignored.
    """
    passage = pa.list_(pa.struct([("first", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches):
        scorer, odds = _Scorer(model.odds), model.odds
        remember_alone(scorer)
        for batch in batches:
            out, lengths, passages = [], [], []
            for text in batch.column(1).to_pylist():
                segments, n = scorer.segments(text or "")
                out.append(model.probability(significance(segments, n, odds)))
                lengths.append(n)
                found = [{"first": f, "n_tokens": e - f, "score": s, "expected": odds.expected(s, n)} for s, f, e in segments]
                passages.append([p for p in found if p["expected"] < 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array(lengths, pa.int64()), pa.array(passages, passage)], names=["doc_id", "score", "n_tokens", "passages"])

    short_batches(docs.sparkSession)
    kind = "doc_id long, score double, n_tokens long, passages array<struct<first: long, n_tokens: long, score: double, expected: double>>"
    return exact_columns(docs, [("doc_id", "long"), ("text", "string")]).mapInArrow(run, kind)


def held_out(doc_id, folds: int = 3, fold: int = 1):
    """Whether a document is kept from training: crc32 of doc_id as text, modulo ``folds``; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``score_documents`` with held_out and predicted; learns from the labels of documents not held out."""
    known = exact_columns(labels, [("doc_id", "long"), ("toxic", "int")]).where(~held_out("doc_id"))
    scored = score_documents(docs, fit(docs, known))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_tokens", "passages")
