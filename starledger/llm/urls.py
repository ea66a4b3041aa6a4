"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the rest.

Everything is DataFrame functions and Spark's own tree learner: no Python runs on executors.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.llm.common import exact_columns, staged

Rule = tuple[str, str, str]  # verdict, host, path

#: Labelled URLs that the trees are fitted on, at most (by a hash of the URL). Suffix statistics use all.
TRAIN_ROWS = 50_000
TREES, DEPTH = 10, 3
#: Rows that a suffix's block rate is mixed with at the overall rate.
PRIOR_ROWS = 10
SUFFIXES = (1, 2, 3)
#: Parts that hosts are dealt to; the statistics of a URL's suffixes are those of the other parts' hosts.
HOST_FOLDS = 5
#: Host words that mark the URLs labelled "block" where no labelled table is at hand (fixed values): gambling,
#: adverts and tracking, pharmacy, adult, fraud and malware. A plural counts as its singular.
BLOCK_WORDS = (
    "bet", "betting", "bingo", "casino", "gambling", "jackpot", "lottery", "poker", "roulette", "slot",
    "ad", "adserver", "advert", "banner", "doubleclick", "pixel", "popunder", "popup", "track", "tracker", "tracking",
    "drug", "med", "pharma", "pharmacy", "pill", "steroid", "viagra",
    "adult", "escort", "porn", "sex", "xxx",
    "crack", "keygen", "malware", "phishing", "scam", "spam", "virus", "warez",
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if the URL is null or has none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as host + path, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def seed_label(host: Column) -> Column:
    """1 if a word of the host's labels, or its singular, is one of BLOCK_WORDS, else 0."""
    words = F.split(host, r"[^\p{L}\p{N}]+")
    return F.arrays_overlap(F.concat(words, F.transform(words, lambda w: F.regexp_replace(w, "s$", ""))), F.array(*map(F.lit, BLOCK_WORDS))).cast("double")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _entropy(text: Column) -> Column:
    """Bits a character of the text's own character distribution; 0 if it is empty."""
    n = F.length(text)
    each = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.length(text) - F.length(F.replace(text, c, F.lit(""))))
    bits = F.aggregate(F.filter(each, lambda k: k > 0), F.lit(0.0), lambda s, k: s - k / n * F.log2(k / n))
    return F.when(n > 0, bits).otherwise(0.0)


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    whole = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(whole, r"\?([^#]*)", 1)
    n = F.length(whole).cast("double")
    # Of features that part the training rows alike a tree takes the first: counts come before measures,
    # whose cut may lie close beside a value that was seen.
    return {
        "parameters": _count(query, "[^&]+"),
        "hyphens": _count(host, "-"),
        "depth": _count(path, "[^/]+"),
        "labels": _count(host, "[^.]+"),
        "host_length": F.length(host).cast("double"),
        "length": n,
        "digit_ratio": F.when(n > 0, _count(whole, "[0-9]") / n).otherwise(0.0),
        "entropy": _entropy(whole),
    }


def _suffix(host: Column, labels: int) -> Column:
    """The host's last labels (all of them if there are fewer)."""
    return F.substring_index(host, ".", -labels)


def _fold(host: Column) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(HOST_FOLDS)).cast("int")


def suffix_statistics(labelled: DataFrame, overall: float) -> list[DataFrame]:
    """For each suffix length: suffix, fold, and of the hosts of all other folds the block rate mixed with
    the overall one, and the log of their rows. No URL's own label, nor its host's, is in what it is given."""
    out = []
    for k in SUFFIXES:
        own = labelled.groupBy(_suffix(F.col("host"), k).alias(f"suffix_{k}"), _fold(F.col("host")).alias("own")).agg(F.sum("label").alias("s"), F.count("*").alias("n"))
        # A row for each fold that the counts are seen from: all but their own.
        seen = own.withColumn("fold", F.explode(F.array(*map(F.lit, range(HOST_FOLDS))))).where("fold <> own")
        counts = seen.groupBy(f"suffix_{k}", "fold").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        mixed = (F.col("s") + F.lit(overall * PRIOR_ROWS)) / (F.col("n") + PRIOR_ROWS)
        out.append(counts.select(f"suffix_{k}", "fold", mixed.alias(f"rate_{k}"), F.log1p(F.col("n").cast("double")).alias(f"rows_{k}")))
    return out


def _featured(urls: DataFrame, statistics: list[DataFrame], overall: float) -> DataFrame:
    """``urls`` (url, host, path) with the features' vector. Suffixes that no other fold's host has, in
    training as later, have the overall rate and no rows."""
    features = lexical_features(F.col("url"), F.col("host"), F.col("path"))
    urls = urls.withColumns(features | {f"suffix_{k}": _suffix(F.col("host"), k) for k in SUFFIXES} | {"fold": _fold(F.col("host"))})
    for k, table in zip(SUFFIXES, statistics, strict=True):
        urls = urls.join(table, [f"suffix_{k}", "fold"], "left").fillna({f"rate_{k}": overall, f"rows_{k}": 0.0})
    columns = [*features, *(f"{x}_{k}" for x in ("rate", "rows") for k in SUFFIXES)]
    return VectorAssembler(inputCols=columns, outputCol="features").transform(urls).drop("fold", *columns, *(f"suffix_{k}" for k in SUFFIXES))


def block_probability(urls: DataFrame, labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``urls`` (url, host, path and others) with ``probability`` that a URL is to be blocked.

    ``labelled``: url, host, path, label (1: block, 0: allow). With labels of one kind, that kind is
    certain; without labels nothing is blocked.
    """
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(counts) < 2:
        return urls.withColumn("probability", F.lit(float(max(counts, default=0))))
    total = sum(counts.values())
    overall = counts[1.0] / total
    statistics = [staged(t, "suffixes") for t in suffix_statistics(labelled, overall)]
    chosen = labelled.where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < min(1.0, train_rows / total) * (1 << 20))
    train = staged(_featured(chosen.select("url", "host", "path", "label"), statistics, overall).select("features", "label"), "train")
    if train.select("label").distinct().count() < 2:
        return urls.withColumn("probability", F.lit(overall))
    model = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=1).fit(train)
    scored = model.transform(_featured(urls, statistics, overall))
    return scored.withColumn("probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction")


def held_out_figures(labelled: DataFrame) -> DataFrame:
    """(host, label, urls, blocked): verdicts on ``labelled`` (url, label) by models that saw no URL of the
    same host, a model for each fold of hosts."""
    rows = staged(_parsed(exact_columns(labelled, [("url", "string"), ("label", "double")]).where("url is not null and label is not null")), "labelled")
    out = None
    for fold in range(HOST_FOLDS):
        mine = _fold(F.col("host")) == fold
        scored = block_probability(rows.where(mine), rows.where(~mine)).select("host", "label", "probability")
        out = scored if out is None else out.unionAll(scored)
    return out.groupBy("host", "label").agg(F.count("*").alias("urls"), F.count_if(F.col("probability") >= 0.5).alias("blocked"))


def _parsed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})


def judge_urls(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None) -> DataFrame:
    """A row for each row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, probability.

    The longest fitting rule decides; else the trees: block from a probability of one half.
    ``labelled`` (url, label 1 or 0) trains them; by default the pages' own URLs, labelled by the
    words of their hosts (``seed_label``). A URL that is null or lacks ``://`` has an empty host and path and is
    judged by its features like any other. Repeated rows are judged alike; an empty table gives an
    empty result; other columns are ignored.
    """
    urls = _parsed(exact_columns(pages, [("page_id", "long"), ("url", "string")]))
    if labelled is None:
        known = urls.where("url is not null").select("url", "host", "path", seed_label(F.col("host")).alias("label"))
    else:
        known = _parsed(exact_columns(labelled, [("url", "string"), ("label", "double")]).where("url is not null and label is not null"))
    scored = block_probability(urls, known)
    rule, by_rule = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = F.coalesce(by_rule, F.when(F.col("probability") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), judged.alias("verdict"), "probability")
