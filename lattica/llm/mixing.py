"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Every document has a 60-bit hash of its id, its text and its number among equal rows. A source whose target is ``r``
times its size gives ``floor(r)`` whole copies of every document, and the rest of its budget as one more copy of the
documents whose hash is below a threshold, so a smaller budget always takes a subset of a larger one. The threshold is
found without sorting: words are summed by source and hash bucket, the bucket that the budget ends in is the only one
that is split further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.shared import is_empty, shared_table

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
#: Bits of the hash that each histogram adds; what shares all of them is told apart by the whole hash.
LEVEL_BITS = 12
LEVELS = 3


def word_count(text: Column) -> Column:
    """Number of words that white space separates; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _digits(text: Column) -> Column:
    """The first 60 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def text_hash(text: Column) -> Column:
    return _digits(F.coalesce(text, F.lit("")))


def row_hash(doc_id: Column, text: Column, number: Column) -> Column:
    """The hash of the ``number``-th row (from 0) with an id and a text, given by its hash; a null id is empty."""
    parts = [F.coalesce(doc_id.cast("string"), F.lit("")), text.cast("string"), number.cast("string")]
    return _digits(F.concat_ws("|", *parts))


def target_sizes(sources: DataFrame, max_repeats: int = 3) -> DataFrame:
    """Targets of ``sources`` (source, source_size): shares of the total by weight, none above its cap.

    Weights are 1, 2, 3, repeating, in code-point order with null last. A source's cap is ``max_repeats`` times its
    size. What exceeds a cap is shared again by weight among the sources below theirs, until none is above: each
    target is min(cap, level * weight), and the level comes from running sums in the order of cap per weight.
    One row per source: the two windows without keys see only those.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    weighed = weighed.withColumn("cap", F.col("source_size").cast("double") * max_repeats)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    lighter = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything) - capped) / (F.sum("weight").over(everything) - lighter)
    filled = weighed.withColumn("level", level).withColumn("place", F.row_number().over(by_fill))
    open_level = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))
    filled = filled.withColumn("open_level", F.min(open_level).over(everything)["level"])
    target = F.when(F.col("open_level").isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("open_level") * F.col("weight"))
    )
    return filled.select("source", "source_size", target.alias("target"))


def _level(sized: DataFrame, cuts: DataFrame, level: int) -> DataFrame:
    """Narrow each source's cut to one bucket of the next histogram."""
    shift = HASH_BITS - LEVEL_BITS * level
    bucket = F.shiftright("hash", shift) if shift else F.col("hash")
    outer = F.shiftright("hash", HASH_BITS - LEVEL_BITS * (level - 1))
    rows = sized.select("source_key", outer.alias("bucket"), bucket.alias("next_bucket"), "size")
    histogram = rows.join(cuts, ["source_key", "bucket"]) if level > 1 else rows.drop("bucket").join(cuts, "source_key")
    return _crossing(histogram, "next_bucket").select(
        "source_key", F.col("crossing.bucket").alias("bucket"), "budget", F.col("crossing.used").alias("used")
    )


def _crossing(rows: DataFrame, bucket: str) -> DataFrame:
    """The bucket of each source in which its running sum reaches the budget, and the sum before it."""
    histogram = rows.groupBy("source_key", "budget", "used", F.col(bucket).alias("bucket")).agg(
        F.sum("size").alias("size")
    )
    running = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    histogram = histogram.withColumn("upto", F.col("used") + F.sum("size").over(running))
    reached = histogram.filter(F.col("upto") >= F.col("budget"))
    first = F.min(F.struct("bucket", (F.col("upto") - F.col("size")).alias("used"), "size"))
    return reached.groupBy("source_key", "budget").agg(first.alias("crossing"))


def _source_key(source: Column) -> Column:
    """A key without nulls, so that null joins like any other source."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def mix_plan(sized: DataFrame, max_repeats: int = 3) -> DataFrame:
    """One row per source: source_key, source_size, target, whole, threshold (null: none beyond the whole copies)."""
    sources = sized.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"))
    targets = target_sizes(sources.select("source", "source_size"), max_repeats)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.least(F.floor(ratio), F.lit(max_repeats)).cast("long")
    budget = F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))
    plan = targets.select(
        _source_key(F.col("source")).alias("source_key"), "source_size", "target", whole.alias("whole")
    )
    plan = shared_table(plan.withColumn("budget", budget), "mix-plan")

    cuts = plan.filter("budget > 0").select("source_key", "budget", F.lit(0.0).alias("used"))
    for level in range(1, LEVELS + 1):
        cuts = shared_table(_level(sized, cuts, level), f"mix-cuts-{level}")
    last = sized.withColumn("bucket", F.shiftright("hash", HASH_BITS - LEVEL_BITS * LEVELS))
    ends = _crossing(last.join(cuts, ["source_key", "bucket"]), "hash").select("source_key", "budget", "crossing.*")
    fits = F.col("used") + F.col("size") / 2 <= F.col("budget")
    threshold = F.when(fits, F.col("bucket") + 1).otherwise(F.col("bucket"))
    return shared_table(
        plan.drop("budget").join(ends.select("source_key", threshold.alias("threshold")), "source_key", "left"),
        "mix-thresholds",
    )


#: Equal rows that one task numbers.
NUMBERED_ROWS = 100_000
ROW = ["source_key", "doc_id", "text_hash"]


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        _source_key(F.col(source_col)).alias("source_key"),
        text_hash(F.col(text_col)).alias("text_hash"),
        word_count(F.col(text_col)).alias("size"),
    )


def _sized(keyed: DataFrame) -> DataFrame:
    """The rows of ``keyed`` with their hashes. Equal rows are counted, and numbered from their count."""
    alike = keyed.groupBy(*ROW).agg(F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("n"))
    alike = shared_table(alike, "mix-alike")
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", F.lit(NUMBERED_ROWS)) - 1))
    rows = alike.withColumn("number", numbers)
    many = alike.filter(F.col("n") > NUMBERED_ROWS)
    if not is_empty(many):  # numbered in blocks that are spread over tasks
        starts = F.explode(F.sequence(F.lit(NUMBERED_ROWS).cast("long"), F.col("n") - 1, F.lit(NUMBERED_ROWS).cast("long")))
        blocks = many.withColumn("start", starts).repartition(*ROW, "start")
        last = F.least(F.col("start") + NUMBERED_ROWS, F.col("n")) - 1
        more = blocks.withColumn("number", F.explode(F.sequence("start", last))).drop("start")
        rows = rows.unionByName(more)
    hashed = row_hash(F.col("doc_id"), F.col("text_hash"), F.col("number")).alias("hash")
    return rows.select("doc_id", "source", "source_key", "size", hashed)


def _copies() -> Column:
    extra = F.col("hash") < F.coalesce("threshold", F.lit(0))
    return (F.col("whole") + extra.cast("long")).alias("copies")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_repeats: int = 3,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    ``size`` is the number of words, ``copies`` how often the mix takes the document (0 to ``max_repeats``), and
    ``taken`` the words that it takes of it. The document in which a budget ends is taken if at least half of it
    fits, so a source misses its target by at most half a document, its longest at worst. The result depends on ids,
    texts and sources alone, so reruns agree.

    Null text has no words and counts as empty, null source is a source of its own, and a null id is an id like any
    other. Rows that repeat an id, a text and a source are numbered, and each number has a hash of its own. A text of
    any length is one document of its size. Sources without words have target 0. An empty table gives no rows. Other
    columns of ``docs`` are ignored, whatever their names. The targets are computed in one task, from a row per source.
    """
    sized = shared_table(_sized(_keyed(docs, id_col, text_col, source_col)), "mix-sizes")
    mixed = sized.join(mix_plan(sized, max_repeats), "source_key")
    mixed = mixed.select("doc_id", "source", "size", "source_size", "target", _copies())
    return mixed.withColumn("taken", F.col("size") * F.col("copies"))


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_repeats: int = 3,
) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` takes it; the columns stay as they are.

    A row's copies follow from its hash and its source's threshold, so only the plan, of a row per source, is joined
    and the texts don't shuffle. Only rows that repeat an id, a text and a source are written and numbered first;
    which of them has which number is not defined, as they differ in other columns at most. Nulls, repeated rows, long
    texts and empty tables are treated as in :func:`mix`.
    """
    keyed = _keyed(docs, id_col, text_col, source_col)
    sized = shared_table(_sized(keyed), "mix-sizes")
    plan = mix_plan(sized, max_repeats)
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).alias("doc_id"),
        _source_key(F.col(source_col)).alias("source_key"),
        text_hash(F.col(text_col)).alias("text_hash"),
    )
    twice = shared_table(keyed.groupBy(*ROW).count().filter("count > 1").select(*ROW), "mix-repeated")
    numbered = rows.withColumn("number", F.lit(0).cast("long"))
    if not is_empty(twice):
        same = [rows[c].eqNullSafe(twice[c]) for c in ROW]
        again = rows.join(twice, same, "left_semi").withColumn("seq", F.monotonically_increasing_id())
        again = shared_table(again, "mix-repeats").withColumn("task", F.shiftright("seq", 33))
        counted = again.groupBy(*ROW, "task").agg(F.count("*").alias("n"))
        before = Window.partitionBy(*ROW).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
        starts = counted.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))  # a row per task
        inside = Window.partitionBy(*ROW, "task").orderBy("seq")  # the rows of one task at most
        placed = again.withColumn("place", F.row_number().over(inside) - 1)
        joined = placed.join(starts, [placed[c].eqNullSafe(starts[c]) for c in [*ROW, "task"]])
        number = (starts["start"] + placed["place"]).alias("number")
        again = joined.select(*[placed[c] for c in rows.columns], number)
        numbered = numbered.join(twice, same, "left_anti").unionByName(again)
    hashed = row_hash(F.col("doc_id"), F.col("text_hash"), F.col("number")).alias("hash")
    taken = numbered.select("row", "source_key", hashed).join(plan, "source_key")
    taken = taken.select("row", _copies()).filter("copies > 0")
    repeated = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select("row.*")
