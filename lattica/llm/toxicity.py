"""Toxicity by a weighted grammar of finite-state transducers.

A lexical transducer reads words letter by letter and writes classes: insult, likely insult, threat, target, negation,
report or other. Its insults are a fixed list and stems learned from labels; a likely insult, whose stem harmless
words have too, counts from its second occurrence in a document. Transducers for negation, reported speech, targets
and threats read classes and rewrite them in context; composed into one, they turn a clause into the matches that
count: plain and targeted insults, threats at a target, and insults and threats that are negated or reported. One more
transducer reads the clause backwards, for targets that stand after an insult. A document's score is the logistic
function of the weighted matches of its clauses; the weights are fitted on labelled documents within bounds: those of
negated and reported matches never raise a score, and one targeted insult or one threat is enough.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import shared_table, slices

# The words that the grammar knows without labels.
INSULTS = (
    "clown", "disgusting", "dumb", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash",
    "worthless",
)
THREATS = ("beat", "crush", "destroy", "hurt", "kill", "murder", "punch", "shoot", "smash", "stab", "strangle")
TARGETS = (
    "you", "your", "yours", "yourself", "u", "he", "him", "she", "her", "they", "them", "dich", "dir", "euch", "toi",
    "vous", "te", "ti", "usted",
)
NEGATIONS = (
    "not", "no", "never", "nobody", "isn't", "aren't", "wasn't", "don't", "didn't", "won't", "nicht", "kein", "keine",
    "nie", "pas", "jamais", "nunca",
)
REPORTS = (
    "said", "says", "say", "told", "claimed", "wrote", "quoted", "called", "sagte", "schrieb", "dit", "disait", "dijo",
)
#: Marks that stand for an apostrophe.
APOSTROPHES = str.maketrans({mark: "'" for mark in "\u2018\u2019\u02bc\uff07"})

#: Labelled documents that stems and weights are learned from.
TRAIN_ROWS = 12_000
STEM_LETTERS = range(3, 9)
MIN_SUPPORT = 3
MIN_PRECISION = 0.85
#: Marks of learned patterns: a whole word, and a stem that must occur twice in a document.
WHOLE, TWICE = "=", "2"
#: Words after a negation, and after a threat, that it reaches.
REACH = 3
MATCHES = ("plain", "targeted", "negated", "reported", "threat")
#: Weights that the fit starts from and is drawn to: the bias, then one for each of MATCHES.
PRIOR = (-2.5, 3.0, 3.5, -0.5, -0.5, 3.0)
#: The weights of negated and reported matches are at most 0.
NEVER_RAISE = (3, 4)
THRESHOLD = 0.7
#: The logit that a document with one targeted insult, or one threat, has at least: a score a little above THRESHOLD.
ALONE_LOGIT = 1.0

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]+")


def plain(text: str) -> str:
    return text.lower().translate(APOSTROPHES)


def words(text: str) -> list[str]:
    return _WORD.findall(plain(text))


class Transducer:
    """Deterministic: ``arcs[state, symbol]`` is (next state, symbol written); other symbols pass as ``default`` says."""

    def __init__(self, start, arcs: dict, default) -> None:
        self.start, self.arcs, self.default = start, arcs, default

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or (self.default(state), symbol)

    def run(self, symbols) -> list:
        state, out = self.start, []
        for symbol in symbols:
            state, written = self.step(state, symbol)
            out.append(written)
        return out


def compose(first: Transducer, second: Transducer, alphabet) -> Transducer:
    """What ``second`` makes of what ``first`` writes, as one table over all states that can be reached."""
    start = (first.start, second.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in alphabet:
            one, written = first.step(state[0], symbol)
            two, out = second.step(state[1], written)
            arcs[state, symbol] = ((one, two), out)
            if (one, two) not in seen:
                seen.add((one, two))
                todo.append((one, two))
    return Transducer(start, arcs, lambda state: state)


def negation() -> Transducer:
    """An insult or a threat up to REACH words after a negation is negated."""
    arcs = {(k, "N"): (REACH, "N") for k in range(REACH + 1)}
    arcs |= {(k, name): (k - 1, "negated") for k in range(1, REACH + 1) for name in "IT"}
    return Transducer(0, arcs, lambda k: max(0, k - 1))


def reported() -> Transducer:
    """An insult or a threat after a verb of reporting in the same clause is reported."""
    return Transducer(0, {(0, "R"): (1, "R"), (1, "I"): (1, "reported"), (1, "T"): (1, "reported")}, lambda k: k)


def targeted() -> Transducer:
    """An insult in a clause that has named a target before is targeted."""
    return Transducer(0, {(0, "Y"): (1, "Y"), (1, "I"): (1, "targeted"), (0, "I"): (0, "plain")}, lambda k: k)


def threatening() -> Transducer:
    """A target up to REACH words after a verb of violence makes a threat."""
    arcs = {(k, "T"): (REACH, "T") for k in range(REACH + 1)}
    arcs |= {(k, "Y"): (0, "threat") for k in range(1, REACH + 1)}
    return Transducer(0, arcs, lambda k: max(0, k - 1))


def targeted_backwards() -> Transducer:
    """Reads a clause from its end: an insult before a target, or before what made a threat, is targeted."""
    return Transducer(0, {(0, "Y"): (1, "Y"), (0, "threat"): (1, "threat"), (1, "plain"): (1, "targeted")}, lambda k: k)


def corroboration() -> Transducer:
    """Of likely insults the first in a document is let pass and the others are insults."""
    return Transducer(0, {(0, "V"): (1, "W"), (1, "V"): (1, "I")}, lambda k: k)


def clause_grammar() -> Transducer:
    classes = ("I", "T", "Y", "N", "R", "W")
    grammar = compose(negation(), reported(), classes)
    grammar = compose(grammar, targeted(), classes)
    return compose(grammar, threatening(), classes)


@dataclass
class Lexicon:
    """A transducer of letters: a trie whose nodes say the class of words that end there, or that begin so."""

    stems: tuple[str, ...] = ()
    nodes: list[dict] = field(default_factory=lambda: [{}])

    def __post_init__(self) -> None:
        for name, known in (("T", THREATS), ("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("I", INSULTS)):
            for word in known:
                self._add(word, "whole", name)
        for stem in sorted(self.stems, key=lambda s: not s.startswith(TWICE)):  # a sure stem overrides a likely one
            kind = "whole" if stem.startswith(WHOLE) else "begin"
            self._add(stem.lstrip(WHOLE + TWICE), kind, "V" if stem.startswith(TWICE) else "I")
        strong = {*INSULTS, *THREATS, *(s.lstrip(WHOLE + TWICE) for s in self.stems)}
        ordered = "|".join(re.escape(w) for w in sorted(strong, key=lambda w: (-len(w), w)))
        self.trigger = re.compile(rf"(?<![^\W\d_])(?:{ordered})")

    def _add(self, word: str, kind: str, name: str) -> None:
        at = 0
        for letter in word:
            if letter not in self.nodes[at]:
                self.nodes.append({})
                self.nodes[at][letter] = len(self.nodes) - 1
            at = self.nodes[at][letter]
        self.nodes[at][kind] = name

    def read(self, word: str) -> str:
        at, begins = 0, None
        for letter in word:
            node = self.nodes[at].get(letter)
            if node is None:
                return begins or "W"
            at = node
            begins = self.nodes[at].get("begin", begins)
        return self.nodes[at].get("whole") or begins or "W"


class Grammar:
    """Counts the matches of a text, clause by clause."""

    def __init__(self, stems: tuple[str, ...] = ()) -> None:
        self.lexicon = Lexicon(stems)
        self.clauses = clause_grammar()
        self.backwards = targeted_backwards()
        self.likely = corroboration()

    def matches(self, text: str | None) -> tuple[int, ...]:
        """How often each of MATCHES occurs. Only clauses with a word that can match are read closely."""
        lowered = plain(text or "")
        found: Counter = Counter()
        if self.lexicon.trigger.search(lowered):
            state = self.likely.start
            for clause in _CLAUSE.split(lowered):
                if self.lexicon.trigger.search(clause):
                    classes = []
                    for word in _WORD.findall(clause):
                        state, name = self.likely.step(state, self.lexicon.read(word))
                        classes.append(name)
                    found.update(self.backwards.run(reversed(self.clauses.run(classes))))
        return tuple(found[name] for name in MATCHES)


@dataclass
class ToxicityModel:
    stems: tuple[str, ...] = ()
    weights: tuple[float, ...] = PRIOR

    def score(self, matches: np.ndarray) -> np.ndarray:
        """The logistic function of the bias and the weights times log(1 + matches)."""
        logit = self.weights[0] + np.log1p(matches) @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def score_texts(self, texts: list[str | None], grammar: Grammar) -> np.ndarray:
        return self.score(np.array([grammar.matches(t) for t in texts], dtype=np.float64).reshape(-1, len(MATCHES)))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is never learned from; null ids are held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(True))


def patterns(text: str) -> set[str]:
    """The whole words of a text, the stems of its words, and the stems that occur at least twice; marked."""
    found, stems = set(), Counter()
    for word, count in Counter(words(text)).items():
        found.add(WHOLE + word)
        for k in STEM_LETTERS:
            if k <= len(word):
                stems[word[:k]] += count
    found.update(stems)
    found.update(TWICE + stem for stem, count in stems.items() if count > 1)
    return found


def _sample(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """(row, text, label) of at most ``train_rows`` labelled documents, those whose ids have the smallest hashes.

    A labelled id is one row, whatever the documents that repeat it: that with the smallest text. ``row`` is a hash of
    the id.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(known), "doc_id")  # train_rows rows at most are broadcast
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select(F.xxhash64("doc_id").alias("row"), "text", "label")


#: Patterns whose counts a task holds at a time.
HELD_PATTERNS = 100_000
COUNTED = pa.schema([("pattern", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64()), ("documents", pa.int64())])


def _candidates(sample: DataFrame) -> list[tuple[str, int, int]]:
    """(pattern, toxic documents, clean documents) of the precise patterns of ``sample``.

    Of patterns that occur in the same toxic documents, which no cover can tell apart, the one with the fewest clean
    ones is kept, the longest of these; so copies of a document, or a rare phrase, make one candidate. Documents are
    told apart by their hashes, a set of them by the exclusive or of its hashes.
    """

    def counted_batch(toxic: Counter, clean: Counter, documents: Counter) -> Iterator[pa.RecordBatch]:
        none = Counter()
        for names, parts in ((toxic, (toxic, none, documents)), (clean, (none, clean, none))):
            columns = [pa.array(list(names), pa.string()), *(pa.array([p[n] for n in names], pa.int64()) for p in parts)]
            yield pa.RecordBatch.from_arrays(columns, schema=COUNTED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean, documents = Counter(), Counter(), Counter()
        for batch in slices(batches):
            for row, text, label in zip(*(batch.column(c) for c in ("row", "text", "label")), strict=True):
                found = patterns(text.as_py())
                if label.as_py():
                    toxic.update(found)
                    for name in found:
                        documents[name] ^= row.as_py()
                else:
                    clean.update(found)
                if len(toxic) + len(clean) > HELD_PATTERNS:  # counts of parts, which Spark adds up
                    yield from counted_batch(toxic, clean, documents)
                    for counter in (toxic, clean, documents):
                        counter.clear()
        yield from counted_batch(toxic, clean, documents)

    counted = sample.mapInArrow(count, "pattern string, toxic long, clean long, documents long").groupBy("pattern")
    counted = counted.agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_xor("documents").alias("documents")
    )
    precise = F.col("toxic") >= MIN_PRECISION * (F.col("toxic") + F.col("clean"))
    counted = counted.filter((F.col("toxic") >= MIN_SUPPORT) & precise)
    best = F.struct("clean", (-F.length("pattern")).alias("length"), "pattern")
    found = counted.groupBy("toxic", "documents").agg(F.min(best).alias("best")).select("toxic", "best.*")
    return sorted((row["pattern"], row["toxic"], row["clean"]) for row in found.collect())


def learn_stems(sample: DataFrame) -> tuple[str, ...]:
    """Stems that together explain the toxic documents of ``sample`` (text, label).

    Greedy cover: each stem taken must explain MIN_SUPPORT documents that no earlier one does, so words that merely
    occur beside an insult, or in copies of one document, add nothing. Among equals the longest stem is taken.
    """
    candidates = _candidates(sample)
    if not candidates:
        return ()
    place = {pattern: k for k, (pattern, _, _) in enumerate(candidates)}
    known = Grammar()

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column("text"):
                if not any(known.matches(text.as_py())):
                    rows.append(sorted(place[p] for p in patterns(text.as_py()) if p in place))
            yield pa.RecordBatch.from_pydict({"found": rows}, pa.schema([("found", pa.list_(pa.int64()))]))

    found = sample.filter("label = 1").mapInArrow(incidence, "found array<long>")
    documents = [set(row[0]) for row in found.collect()]  # toxic documents of the sample without a known match
    holders: dict[int, set[int]] = {}
    for k, document in enumerate(documents):
        for candidate in document:
            holders.setdefault(candidate, set()).add(k)
    stems: list[str] = []
    left = set(range(len(documents)))

    def worth(candidate: int) -> tuple[int, int, str]:
        pattern, _, clean = candidates[candidate]
        return len(holders[candidate] & left) - clean, len(pattern), pattern

    while holders:
        best = max(holders, key=worth)
        if worth(best)[0] < MIN_SUPPORT:
            break
        stems.append(candidates[best][0])
        left -= holders.pop(best)
    return tuple(stems)


def _clamped(w: np.ndarray) -> np.ndarray:
    """``w`` within the bounds of :func:`fit_weights`."""
    out = w.copy()
    out[list(NEVER_RAISE)] = np.minimum(out[list(NEVER_RAISE)], 0)
    plain, targeted, threat = (1 + MATCHES.index(name) for name in ("plain", "targeted", "threat"))
    out[targeted] = max(out[targeted], out[plain])
    # log(1 + 1) times the weight of one match, and the bias, give this much at least
    least = (ALONE_LOGIT - out[0]) / np.log(2)
    out[[targeted, threat]] = np.maximum(out[[targeted, threat]], least)
    return out


def fit_weights(matches: np.ndarray, labels: np.ndarray, prior=PRIOR, ridge: float = 0.5) -> tuple[float, ...]:
    """Logistic regression of labels on log(1 + matches), drawn to ``prior``, by projected gradient steps.

    Bounds: the weights NEVER_RAISE are at most 0, a targeted insult weighs no less than a plain one, and one targeted
    insult, or one threat, reaches THRESHOLD by itself, as labels without them can't say what they are worth.
    """
    x = np.hstack([np.ones((len(matches), 1)), np.log1p(matches)])
    start = np.array(prior)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - labels @ z + ridge / 2 * ((w - start) ** 2).sum())

    w, rate = _clamped(start), 1.0
    now = loss(w)
    for _ in range(5000):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + ridge * (w - start)
        scale = ((x * x).T @ np.maximum(p * (1 - p), 1e-3)) + ridge  # each weight by its own curvature
        while rate > 1e-12:
            ahead = _clamped(w - rate * gradient / scale)
            after = loss(ahead)
            if after <= now:
                break
            rate /= 2
        else:
            break
        moved, w, gained, now = np.abs(ahead - w).max(), ahead, now - after, after
        if moved < 1e-7 or gained < 1e-10 * max(1.0, now):
            break
        rate = min(1.0, rate * 1.5)
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learn stems and weights from labelled documents that aren't held out, at most ``train_rows`` of them."""
    sample = shared_table(_sample(docs, labels, train_rows), "toxicity-sample")
    stems = learn_stems(sample)
    grammar = Grammar(stems)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [list(grammar.matches(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64())), batch.column("label")], ["m", "label"])

    rows = sample.mapInArrow(count, "m array<long>, label int").collect()
    if not rows:
        return ToxicityModel(stems)
    matches = np.array([row["m"] for row in rows], dtype=np.float64)
    return ToxicityModel(stems, fit_weights(matches, np.array([row["label"] for row in rows], dtype=np.float64)))


def scored(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from a score of THRESHOLD).

    Null and empty texts have no matches and the score of the bias; long texts are read to their end. Rows with null id
    are scored and count as held out; repeated rows each get a row. Without labels the fixed words and weights decide. An empty table gives no
    rows. Other columns are ignored, whatever their names.
    """
    model = train(docs, labels, train_rows)
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.stems)
        for batch in slices(batches):
            values = model.score_texts(batch.column("text").to_pylist(), grammar)
            predicted = (values >= THRESHOLD).astype(np.int32)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(values), pa.array(predicted)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` without those that score THRESHOLD or more. The columns stay as they are."""
    model = train(docs, labels, train_rows)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.stems)
        for batch in slices(batches):
            values = model.score_texts(batch.column("text").to_pylist(), grammar)
            yield batch.filter(pa.array(values < THRESHOLD, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
