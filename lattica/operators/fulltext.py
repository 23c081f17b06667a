"""Full-text search over node contents: an inverted index of terms with positions, and search weighted by perspectives.

Terms are lower-case words without stop words, reduced by Porter's algorithm (1980, as its author later revised it). All
of it is Spark expressions. Ranks are those of the usual cover-free ranking of a text-search database: the sum of
1 / k² over a single term's occurrences, and for several terms how near each pair of them comes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.navigate import clamped

# Words that are no terms.
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but",
    "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on",
    "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same",
    "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
)
# Porter's endings of steps 2 and 3 with what stands in their place, and those that step 4 cuts.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)
# The weight of a word, the sum of 1 / k², the farthest distance and place that count, and occurrences a term keeps.
WORD_WEIGHT, SQUARES, FARTHEST, LAST_PLACE, KEPT = 0.1, 1.64493406685, 100, 16383, 255

# A consonant and a vowel, and runs of each; a y after a consonant is a vowel, and one that begins a word is written Y.
_CONSONANTS, _VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_ANY = f"^({_CONSONANTS})?{_VOWELS}{_CONSONANTS}"  # measure above 0
_ONE = f"^({_CONSONANTS})?{_VOWELS}{_CONSONANTS}({_VOWELS})?$"
_TWO = f"^({_CONSONANTS})?{_VOWELS}{_CONSONANTS}{_VOWELS}{_CONSONANTS}"  # above 1
_HAS_VOWEL = f"^({_CONSONANTS})?[aeiouy]"
_SHORT = f"^{_CONSONANTS}[aeiouy][^aeiouwxy]$"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _has(word: Column, pattern: str) -> Column:
    return F.rlike(word, F.lit(pattern))


def _cut(word: Column, endings: str) -> tuple[Column, Column]:
    """What is before the longest of ``endings``, and that ending; both empty without one."""
    pattern = f"^(.+?)({endings})$"
    return F.regexp_extract(word, pattern, 1), F.regexp_extract(word, pattern, 2)


def _step_1a(w: Column) -> Column:
    plural = F.regexp_replace(w, F.lit("^(.+?)(ss|i)es$"), F.lit("$1$2"))
    return F.when(_has(w, "^.+?(ss|i)es$"), plural).otherwise(F.regexp_replace(w, F.lit("^(.+?)([^s])s$"), F.lit("$1$2")))


def _step_1b(w: Column) -> Column:
    eed, _ = _cut(w, "eed")
    stem, _ = _cut(w, "ed|ing")
    mended = (
        F.when(_has(stem, "(at|bl|iz)$"), F.concat(stem, F.lit("e")))
        .when(_has(stem, r"([^aeiouylsz])\1$"), F.left(stem, F.length(stem) - 1))
        .when(_has(stem, _SHORT), F.concat(stem, F.lit("e")))
        .otherwise(stem)
    )
    return F.when(eed != "", F.when(_has(eed, _ANY), F.left(w, F.length(w) - 1)).otherwise(w)).otherwise(
        F.when((stem != "") & _has(stem, _HAS_VOWEL), mended).otherwise(w)
    )


def _step_1c(w: Column) -> Column:
    stem, _ = _cut(w, "y")
    return F.when((stem != "") & _has(stem, _HAS_VOWEL), F.concat(stem, F.lit("i"))).otherwise(w)


def _replaced(endings: dict[str, str]) -> Callable[[Column], Column]:
    table = F.create_map(*[F.lit(v) for pair in endings.items() for v in pair])

    def step(w: Column) -> Column:
        stem, ending = _cut(w, "|".join(endings))
        return F.when((ending != "") & _has(stem, _ANY), F.concat(stem, table[ending])).otherwise(w)

    return step


def _step_4(w: Column) -> Column:
    stem, ending = _cut(w, "|".join(STEP_4))
    ion, _ = _cut(w, "ion")
    return F.when(ending != "", F.when(_has(stem, _TWO), stem).otherwise(w)).otherwise(
        F.when(_has(ion, "[st]$") & _has(ion, _TWO), ion).otherwise(w)
    )


def _step_5(w: Column) -> Column:
    stem, _ = _cut(w, "e")
    silent = _has(stem, _TWO) | (_has(stem, _ONE) & ~_has(stem, _SHORT))
    return _let(
        F.when((stem != "") & silent, stem).otherwise(w),
        lambda v: F.when(_has(v, "ll$") & _has(v, _TWO), F.left(v, F.length(v) - 1)).otherwise(v),
    )


def stem(word: Column) -> Column:
    """The stem of a lower-case word; words of one or two letters stay."""
    first = F.regexp_replace(word, F.lit("^y"), F.lit("Y"))
    steps = (_step_1a, _step_1b, _step_1c, _replaced(STEP_2), _replaced(STEP_3), _step_4, _step_5)
    return F.when(F.length(word) < 3, word).otherwise(F.lower(reduce(_let, steps, first)))


def places(text: Column) -> Column:
    """An array of (word, place) of a text's words that are no stop words; places count all words from 1."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    placed = F.transform(words, lambda w, k: F.struct(w.alias("word"), F.least(k + 1, F.lit(LAST_PLACE)).alias("place")))
    return F.filter(placed, lambda p: ~p["word"].isin(*STOP_WORDS))


def _postings(rows: DataFrame) -> DataFrame:
    """(term, id, tf, places) of (term, id, place): how often and where; the first KEPT places are kept."""
    held = F.slice(F.sort_array(F.collect_list("place")), 1, KEPT)
    return rows.groupBy("term", "id").agg(F.count("*").alias("tf"), held.alias("places"))


def inverted_index(nodes: DataFrame) -> DataFrame:
    """(term, id, tf, places). Each different word is reduced once and its stem joined to where it stands."""
    words = nodes.select("id", F.explode(places(F.col("content"))).alias("p")).select("id", "p.word", "p.place")
    stems = words.select("word").distinct().withColumn("term", stem(F.col("word")))
    return _postings(words.join(stems, "word").select("term", "id", "place"))


#: Buckets that a written index is dealt into by term.
INDEX_BUCKETS = 256


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(INDEX_BUCKETS)).cast("int")


def write_index(nodes: DataFrame, folder: str) -> None:
    """Write the inverted index in folders of buckets of terms, sorted by term within."""
    index = inverted_index(nodes).withColumn("bucket", _bucket(F.col("term")))
    index.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(folder)


def read_index(spark: SparkSession, folder: str, terms: list[str]) -> DataFrame:
    """The postings of some terms: only their buckets are read, and of these the row groups that can hold them."""
    buckets = spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term")).alias("b")).distinct()
    wanted = [row["b"] for row in buckets.collect()]  # one a term at most
    index = spark.read.parquet(folder)
    chosen = F.col("bucket").isin(*wanted) & F.col("term").isin(*terms) if terms else F.lit(False)
    return index.filter(chosen).drop("bucket")


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """The different terms of a query."""
    asked = spark.range(1).select(F.explode(places(F.lit(query))).alias("p")).select(stem(F.col("p.word")).alias("term"))
    return sorted({row["term"] for row in asked.collect()})


def _found(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """The postings of ``terms`` without an index. A word begins like its stem, the last two letters aside."""
    begins = lambda w: reduce(Column.__or__, [w.startswith(t[: max(1, len(t) - 2)]) for t in terms])
    near = F.filter(places(F.col("content")), lambda p: begins(p["word"]))
    rows = nodes.select("id", F.explode(near).alias("p")).select("id", stem(F.col("p.word")).alias("term"), "p.place")
    return _postings(rows.filter(F.col("term").isin(*terms)))


def _rank(columns: list[Column]) -> Column:
    """The rank of a text from the places of each term of the query."""
    if len(columns) == 1:
        places = columns[0]
        return WORD_WEIGHT / SQUARES * F.aggregate(F.sequence(F.lit(1), F.size(places)), F.lit(0.0), lambda a, k: a + 1.0 / (k * k))

    def missed(a: Column, b: Column) -> Column:
        """The logarithm of the product of one less the nearness of each pair of places."""

        def pair(p: Column, q: Column) -> Column:
            far = F.abs(p - q)
            near = 1 / (1.005 + 0.05 * F.exp(far / 1.5 - 2))
            return F.log(1 - WORD_WEIGHT * F.sqrt(F.when((far > 0) & (far <= FARTHEST), near).otherwise(1e-30)))

        return F.aggregate(a, F.lit(0.0), lambda s, p: s + F.aggregate(b, F.lit(0.0), lambda t, q: t + pair(p, q)))

    return 1 - F.exp(reduce(Column.__add__, [missed(columns[i], columns[k]) for i in range(len(columns)) for k in range(i)]))


def matches(nodes: DataFrame, query: str, index: DataFrame | None = None) -> DataFrame:
    """(id, rank): nodes that hold every term of ``query``. Only the postings of its terms are read, or made.

    ``rank`` is a sum over the occurrences of a single term; for several terms it says how near they come, pair by pair.
    It has 6 digits, so that its order doesn't hang on how it was added. A query without terms finds nothing.
    """
    terms = query_terms(nodes.sparkSession, query)
    if not terms:
        return nodes.select("id", F.lit(0.0).alias("rank")).limit(0)
    postings = _found(nodes, terms) if index is None else index.filter(F.col("term").isin(*terms))
    columns = [F.max(F.when(F.col("term") == t, F.col("places"))).alias(f"p{k}") for k, t in enumerate(terms)]
    held = postings.groupBy("id").agg(F.count("*").alias("n"), *columns).filter(F.col("n") == len(terms))
    return held.select("id", F.round(_rank([F.col(f"p{k}") for k in range(len(terms))]), 6).alias("rank"))


def search(nodes: DataFrame, query: str, kind: str | None = None, limit: int | None = None) -> DataFrame:
    chosen = nodes if kind is None else nodes.filter(F.col("kind") == kind)
    found = matches(chosen, query).join(chosen.select("id", "kind", "path"), "id")
    return found.select("id", "kind", "path", "rank").orderBy(F.desc("rank"), "id").limit(clamped(limit))


def context_search(
    nodes: DataFrame, perspectives: DataFrame, query: str, agents: list[str] | None = None, limit: int | None = None
) -> DataFrame:
    """Search ranked by rank x (1 + mean weight that the named agents, or all, give the node)."""
    chosen = perspectives if agents is None else perspectives.filter(F.col("agent_id").isin(*agents))
    boost = chosen.groupBy(F.col("node_id").alias("id")).agg(F.avg("weight").alias("boost"), F.count_distinct("agent_id").alias("agents"))
    found = matches(nodes, query).join(boost, "id", "left")
    combined = F.round(F.col("rank") * (1 + F.coalesce("boost", F.lit(0.0))), 9)
    rows = found.select("id", "rank", combined.alias("combined"), F.coalesce("agents", F.lit(0)).cast("long").alias("agents"))
    return rows.orderBy(F.desc("combined"), "id").limit(clamped(limit))
