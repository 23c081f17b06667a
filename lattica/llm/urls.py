"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule judges."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import shared_table

# Fixed values: (verdict, host, path) of the rules that the query applies.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labelled URLs that the trees are trained on.
TRAIN_ROWS = 20_000
#: The suffix statistics of a training URL come from the other parts of this many.
FOLDS = 5
FEATURES = [
    "f_length", "f_host_length", "f_depth", "f_labels", "f_digits", "f_entropy", "f_parameters", "f_hyphens",
    "f_suffix_rate_1", "f_suffix_count_1", "f_suffix_rate_2", "f_suffix_count_2",
]
#: Labels of the host's suffixes that have statistics: ``com`` and ``example.com``.
SUFFIX_LABELS = (1, 2)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the columns ``host`` and ``path``: the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):  # the longest is asked first
        own = (F.col("host") == name) | F.endswith(F.col("host"), F.lit("." + name))
        fits = own & F.startswith(F.col("path"), F.lit(start))
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def suffix(name: Column, labels: int) -> Column:
    return F.substring_index(name, ".", -labels)


def lexical(urls: DataFrame) -> DataFrame:
    """Add the lexical features of ``url`` to rows with url, host and path. Null counts as empty."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    # The letters in order, so each makes one run: one pass over them, however long the URL
    letters = F.array_sort(F.filter(F.split(url, ""), lambda c: c != ""))

    def share_term(run: Column) -> Column:
        part = run / size
        return F.when(run > 0, -part * F.log2(part)).otherwise(F.lit(0.0))

    def read(state: Column, letter: Column) -> Column:
        more = F.struct(letter.alias("letter"), (state["run"] + 1).alias("run"), state["sum"].alias("sum"))
        other = F.struct(letter.alias("letter"), F.lit(1).alias("run"), (state["sum"] + share_term(state["run"])).alias("sum"))
        return F.when(state["letter"] == letter, more).otherwise(other)

    start = F.struct(F.lit("").alias("letter"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))
    entropy = F.aggregate(letters, start, read, lambda state: state["sum"] + share_term(state["run"]))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    parameters = F.when(query == "", 0).otherwise(F.size(F.split(query, "&")))
    return urls.withColumns(
        {
            "f_length": F.length(url).cast("double"),
            "f_host_length": F.length("host").cast("double"),
            "f_depth": F.size(F.filter(F.split("path", "/"), lambda part: part != "")).cast("double"),
            "f_labels": F.size(F.split("host", r"\.")).cast("double"),
            "f_digits": F.regexp_count(url, F.lit("[0-9]")) / size,
            "f_entropy": entropy,
            "f_parameters": parameters.cast("double"),
            "f_hyphens": F.regexp_count(url, F.lit("[-_]")).cast("double"),
            **{f"suffix_{k}": suffix(F.col("host"), k) for k in SUFFIX_LABELS},
        }
    )


def _assembled(urls: DataFrame) -> DataFrame:
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(urls)
    return vectors.drop(*FEATURES, *[f"suffix_{k}" for k in SUFFIX_LABELS])


class UrlModel:
    """Trees, suffix statistics of the training URLs, and the rate of blocked ones among them."""

    def __init__(self, trees: GBTClassificationModel | None, suffixes: list[DataFrame], rate: float) -> None:
        self.trees, self.suffixes, self.rate = trees, suffixes, rate

    def _features(self, urls: DataFrame) -> DataFrame:
        """The suffixes, at most one per training URL, are broadcast."""
        joined = lexical(urls)
        for k, known in zip(SUFFIX_LABELS, self.suffixes, strict=True):
            joined = joined.join(F.broadcast(known), f"suffix_{k}", "left")
            rate, count = F.coalesce("rate", F.lit(self.rate)), F.coalesce("seen", F.lit(0.0))
            joined = joined.withColumns({f"f_suffix_rate_{k}": rate, f"f_suffix_count_{k}": count}).drop("rate", "seen")
        return _assembled(joined)

    def score(self, urls: DataFrame) -> DataFrame:
        """Add ``blocked``, the probability that a URL (url, host, path) is to be blocked."""
        if self.trees is None:
            return urls.withColumn("blocked", F.lit(self.rate))
        scored = self.trees.transform(self._features(urls))
        scored = scored.withColumn("blocked", vector_to_array("probability")[1])
        return scored.drop("features", "rawPrediction", "probability", "prediction")


def _training_features(rows: DataFrame, rate: float) -> DataFrame:
    """The features of labelled ``rows``; the suffix statistics of each come from the other folds alone.

    So a URL's own label, and those of its copies, are no part of its features.
    """
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).alias("fold")
    joined = lexical(rows.withColumn("fold", fold))
    for k in SUFFIX_LABELS:
        key = suffix(F.col("host"), k).alias(f"suffix_{k}")
        parts = rows.groupBy(key, fold).agg(F.sum("label").alias("bad"), F.count("*").alias("n"))
        whole = parts.groupBy(f"suffix_{k}").agg(F.sum("bad").alias("all_bad"), F.sum("n").alias("all_n"))
        bad, n = F.col("all_bad") - F.col("bad"), F.col("all_n") - F.col("n")
        others = parts.join(whole, f"suffix_{k}").select(
            f"suffix_{k}", "fold", ((bad + rate) / (n + 1)).alias(f"f_suffix_rate_{k}"),
            (n * (FOLDS / (FOLDS - 1))).alias(f"f_suffix_count_{k}"),
        )
        joined = joined.join(F.broadcast(others), [f"suffix_{k}", "fold"])
    return _assembled(joined.drop("fold"))


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS, rounds: int = 12, depth: int = 4) -> UrlModel:
    """Fit trees to ``labelled`` (url, host, path, label 0 or 1, 1 for URLs to block).

    At most ``train_rows`` URLs are used, those with the smallest hashes. With no labelled URLs, or labels of one
    kind, the model says the rate of the labels (0 without any).
    """
    rows = labelled.select("url", "host", "path", F.col("label").cast("double").alias("label"))
    rows = rows.orderBy(F.xxhash64("url"), "url").limit(train_rows)
    rows = shared_table(rows, "url-train")
    seen = rows.agg(F.count("*").alias("n"), F.sum("label").alias("blocked")).first()
    rate = (seen["blocked"] or 0.0) / max(1, seen["n"])
    smoothed = (F.sum("label") + rate) / (F.count("*") + 1)
    suffixes = []
    for k in SUFFIX_LABELS:
        known = rows.groupBy(suffix(F.col("host"), k).alias(f"suffix_{k}"))
        known = known.agg(smoothed.alias("rate"), F.count("*").cast("double").alias("seen"))
        suffixes.append(shared_table(known, "url-suffixes"))
    model = UrlModel(None, suffixes, rate)
    if 0 < rate < 1:
        features = shared_table(_training_features(rows, rate), "url-features")
        trees = GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=depth, maxBins=32, seed=5)
        model.trees = trees.fit(features)
    return model


def judged(pages: DataFrame, rules=RULES, train_rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, blocked.

    URLs that a rule judges have its verdict and are the labelled ones; for the others the trees trained on those
    decide: block if ``blocked`` is over ``threshold``.

    Null URLs and those without ``://`` have empty host and path; long ones are read to their end. Repeated rows each
    get a row. An empty table gives
    no rows. Other columns are ignored, whatever their names.
    """
    parts = pages.select("page_id", "url").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rule, verdict = rule_columns(rules)
    parts = parts.withColumns({"rule": rule, "verdict": verdict})
    labelled = parts.filter("rule IS NOT NULL").withColumn("label", (F.col("verdict") == "block").cast("double"))
    scored = train(labelled, train_rows).score(parts)
    guess = F.when(F.col("blocked") > threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", guess).alias("verdict"), "blocked")
