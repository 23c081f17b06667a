"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A token's class is CLASSES-fold by its last bytes, and its subclass CLASSES-fold by its hash. The model gives

    P(token | before) = P(class | before) P(subclass | class, before) (c + 1) / T(subclass)

where c counts the token in the training texts and T is the sum of c + 1 over the known tokens of the subclass, plus 1
for its unknown ones. So the probabilities of all known tokens, and of an unknown one per subclass, add up to 1 after
any context. Both softmaxes add weights of hashed features of the context: the last token, the last two, and the
last but one alone (skip); the table of weights grows with the training tokens up to MOST_BITS. It is trained by
gradient steps on minibatches of every training text, in the tasks that hold them, and the tasks' weights are averaged
by how often each feature occurred in them. Contexts, gradients and scores are sparse batches of numpy arrays.

Counts are kept as a table. Tokens that hold more than a COMMON-th of all are at most COMMON, so these go to every task;
the other tokens of a text are joined to the table, and as each of them is rare, no key of that join is hot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import shared_table, slices

CLASSES = 32
#: Bytes at the end of a token that its class goes by.
ENDING = 2
#: Rows of the weight table: a power of two near the training tokens divided by TOKENS_PER_ROW, within these bits.
LEAST_BITS, MOST_BITS, TOKENS_PER_ROW = 12, 16, 64
STEP_TOKENS = 32_768
RATE = 0.5
MOST_LOGIT = 80.0
#: The most common tokens: those with more than this part of all.
COMMON = 65_536
#: Text that a task holds as tokens at a time.
PIECE_BYTES = 2 << 20
#: Blocks of the weight table that the tasks' weights are added by.
BLOCKS = 32

#: Lower-cases A-Z and makes every white space a blank, so the end of a text, a line feed, is no word.
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + bytes(range(9, 14)), bytes(range(97, 123)) + b" " * 5)
END = b"\n"


def held_out(doc_id: Column) -> Column:
    """Whether a text isn't learned from; null ids aren't."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(7)) == 2, F.lit(True))


@dataclass
class Piece:
    """Tokens of some texts: the text's place in the batch, the token's number in ``words``, and the distinct words."""

    row: np.ndarray
    code: np.ndarray
    words: list[bytes]


def _piece(rows: list[int], segments: list[bytes]) -> Piece:
    split = pc.split_pattern(pa.array(segments, pa.binary()), b" ")
    words, parents = split.flatten(), pc.list_parent_indices(split)
    found = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(found).dictionary_encode()
    row = np.array(rows, dtype=np.int64)[parents.filter(found).to_numpy()]
    return Piece(row, coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist())


def pieces(texts: pa.Array) -> Iterator[Piece]:
    """The tokens of texts in order, in pieces of about PIECE_BYTES; a long text is in several, cut between words."""
    rows, segments, held = [], [], 0
    for row, text in enumerate(texts.cast(pa.binary())):
        data = (text.as_py() or b"").translate(_PLAIN) + b" " + END
        at = 0
        while at < len(data):
            end = len(data)
            if end - at > PIECE_BYTES:
                found = data.find(b" ", at + PIECE_BYTES)
                end = len(data) if found < 0 else found
            rows.append(row)
            segments.append(data[at:end])
            held += end - at
            at = end
            if held >= PIECE_BYTES:
                yield _piece(rows, segments)
                rows, segments, held = [], [], 0
    if segments:
        yield _piece(rows, segments)


def _counts(docs: DataFrame) -> DataFrame:
    """(word, c, n): how often each token occurs in the training texts, and in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            learned = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            for piece in pieces(batch.column("text")):
                n = np.bincount(piece.code, minlength=len(piece.words))
                c = np.bincount(piece.code, weights=learned[piece.row], minlength=len(piece.words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(piece.words, pa.string()), pa.array(c), pa.array(n)], ["word", "c", "n"])

    counted = docs.select("text", "held_out").mapInArrow(count, "word string, c long, n long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words), np.uint64, len(words))


def subclasses(words: list[bytes]) -> np.ndarray:
    """The number of each token's subclass: its class times CLASSES, plus its place in the class."""
    ending = np.fromiter((zlib.crc32(w[-ENDING:]) for w in words), np.uint64, len(words))
    return (ending * np.uint64(2654435761) >> np.uint64(11)).astype(np.int64) % CLASSES * CLASSES + (
        hashes(words) * np.uint64(40503) >> np.uint64(7)
    ).astype(np.int64) % CLASSES


def _subclass_sums(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens, and known distinct tokens, of each subclass."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = subclasses(batch.column("word").cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
            known = pd.DataFrame({"leaf": leaf, "c": batch.column("c").to_numpy(), "v": 1}).groupby("leaf", as_index=False).sum()
            yield pa.RecordBatch.from_pandas(known, preserve_index=False)

    sums = counts.filter("c > 0").select("word", "c").mapInArrow(add, "leaf long, c long, v long")
    tokens, types = np.zeros(CLASSES * CLASSES), np.zeros(CLASSES * CLASSES)
    for row in sums.groupBy("leaf").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect():  # CLASSES ** 2 rows
        tokens[row["leaf"]], types[row["leaf"]] = row["c"], row["v"]
    return tokens, types


def _mixed(tag: int, *parts: np.ndarray) -> np.ndarray:
    out = np.full(len(parts[0]), tag, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for part in parts:
        out = (out ^ part.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(31)
    return out * np.uint64(0x94D049BB133111EB)


@dataclass
class Contexts:
    """Tokens as the model sees them: class and place in it, and the rows of the weight table that the softmaxes add.

    Rows lie feature by feature.
    """

    first: np.ndarray
    second: np.ndarray
    first_rows: np.ndarray
    second_rows: np.ndarray


class Reader:
    """Turns the pieces of a batch into contexts; it remembers the end of a piece for a text that goes on in the next."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.last_row, self.last = -1, np.zeros(2, dtype=np.uint64)

    def contexts(self, piece: Piece) -> Contexts:
        token, row = hashes(piece.words)[piece.code] + np.uint64(1), piece.row
        before = self.last if len(row) and row[0] == self.last_row else np.zeros(2, dtype=np.uint64)
        all_rows = np.concatenate([np.full(2, row[0] if len(row) else -1), row])
        everything = np.concatenate([before, token])
        one = np.where(all_rows[1:-1] == row, everything[1:-1], 0)
        two = np.where(all_rows[:-2] == row, everything[:-2], 0)
        self.last_row, self.last = all_rows[-1], everything[-2:] * (all_rows[-2:] == all_rows[-1])
        leaf = subclasses(piece.words)[piece.code]
        first, second = leaf // CLASSES, leaf % CLASSES
        cut = np.uint64(64 - self.bits)
        rows = [_mixed(1, one), _mixed(2, one, two), _mixed(3, two)]
        under = [_mixed(4, one, first), _mixed(5, one, two, first), _mixed(6, two, first)]
        return Contexts(first, second, *(np.stack([(r >> cut).astype(np.uint16) for r in f]) for f in (rows, under)))


@dataclass
class Model:
    """Weights of hashed features by class or place, biases, and what the counts give."""

    bits: int
    weights: np.ndarray
    first_bias: np.ndarray
    second_bias: np.ndarray
    totals: np.ndarray

    def exponentials(self, rows: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of the logits of each token, and their sums. Logits above MOST_LOGIT count as that, so none overflows."""
        z = np.take(self.weights, rows[0], axis=0)
        for feature in rows[1:]:
            z += np.take(self.weights, feature, axis=0)
        z += bias
        np.exp(np.minimum(z, MOST_LOGIT, out=z), out=z)
        return z, z @ np.ones(CLASSES, dtype=np.float32)

    def log10_subclass(self, c: Contexts) -> np.ndarray:
        """log10 P(subclass | before) - log10 T(subclass) of each token."""
        out = np.empty(len(c.first))
        for at in range(0, len(out), STEP_TOKENS):
            cut = slice(at, at + STEP_TOKENS)
            first, second = c.first[cut], c.second[cut]
            each = np.arange(len(first))
            z, total = self.exponentials(c.first_rows[:, cut], self.first_bias)
            y, part = self.exponentials(c.second_rows[:, cut], self.second_bias[first])
            share = (z[each, first] / total).astype(np.float64) * (y[each, second] / part)
            out[cut] = np.log10(np.maximum(share, 1e-300) / self.totals[first * CLASSES + second])
        return out


class Trainer:
    """Gradient steps on minibatches, with a step size per row of the table that falls with its gradients."""

    def __init__(self, model: Model) -> None:
        self.model = Model(model.bits, model.weights.copy(), model.first_bias, model.second_bias, model.totals)
        self.start = model.weights
        self.gradients = np.full(len(model.weights), 1e-2, dtype=np.float32)
        self.seen = np.zeros(len(model.weights))

    def _step(self, rows: np.ndarray, bias: np.ndarray, target: np.ndarray) -> None:
        z, total = self.model.exponentials(rows, bias)
        z /= total[:, None]
        z[np.arange(len(z)), target] -= 1
        flat = rows.ravel()
        gradient = np.empty_like(self.model.weights)
        for k, column in enumerate(np.ascontiguousarray(z.T, dtype=np.float64)):
            gradient[:, k] = np.bincount(flat, weights=np.tile(column, len(rows)), minlength=len(gradient))
        self.gradients += np.einsum("ij,ij->i", gradient, gradient)
        gradient *= (RATE / np.sqrt(self.gradients))[:, None]
        self.model.weights -= gradient
        self.seen += np.bincount(flat, minlength=len(gradient))

    def learn(self, c: Contexts) -> None:
        for at in range(0, len(c.first), STEP_TOKENS):
            cut = slice(at, at + STEP_TOKENS)
            self._step(c.first_rows[:, cut], self.model.first_bias, c.first[cut])
            self._step(c.second_rows[:, cut], self.model.second_bias[c.first[cut]], c.second[cut])


def _trained(docs: DataFrame, model: Model) -> np.ndarray:
    """The weights after every training text has made its gradient steps in the task that holds it."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(model)
        for batch in slices(batches):
            reader = Reader(model.bits)
            for piece in pieces(batch.column("text")):
                trainer.learn(reader.contexts(piece))
        moved = (trainer.model.weights - model.weights) * trainer.seen[:, None]
        for block, (part, seen) in enumerate(zip(np.split(moved, BLOCKS), np.split(trainer.seen, BLOCKS), strict=True)):
            if seen.any():
                columns = [pa.array([block]), pa.array([part.astype(np.float32).tobytes()]), pa.array([seen.astype(np.float32).tobytes()])]
                yield pa.RecordBatch.from_arrays(columns, ["block", "moved", "seen"])

    def average(rows: pd.DataFrame) -> pd.DataFrame:
        moved = sum(np.frombuffer(m, np.float32).astype(np.float64) for m in rows["moved"]).reshape(-1, CLASSES)
        seen = sum(np.frombuffer(s, np.float32).astype(np.float64) for s in rows["seen"])
        mean = moved / np.maximum(seen, 1)[:, None]
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "moved": [mean.astype(np.float32).tobytes()]})

    # few tasks, as each gives a table of weights: that many tables are added up, whatever the input
    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism
    learned = docs.filter("NOT held_out").select("text").coalesce(tasks)
    learned = learned.mapInArrow(learn, "block long, moved binary, seen binary")
    weights = model.weights.copy()
    size = len(weights) // BLOCKS
    for row in learned.groupBy("block").applyInPandas(average, "block long, moved binary").collect():  # BLOCKS rows
        weights[row["block"] * size :][:size] += np.frombuffer(row["moved"], np.float32).reshape(-1, CLASSES)
    return weights


def untrained(tokens: np.ndarray, types: np.ndarray) -> Model:
    """The model whose softmaxes know only how many training tokens each subclass has."""
    n = max(1.0, tokens.sum())
    bits = int(np.clip(np.ceil(np.log2(n / TOKENS_PER_ROW)), LEAST_BITS, MOST_BITS))
    mass = (tokens + 1).reshape(CLASSES, CLASSES)
    return Model(
        bits, np.zeros((1 << bits, CLASSES), dtype=np.float32), np.log(mass.sum(axis=1) / mass.sum()).astype(np.float32),
        np.log(mass / mass.sum(axis=1, keepdims=True)).astype(np.float32), tokens + types + 1,
    )


def train(docs: DataFrame, counts: DataFrame) -> Model:
    """A model of the training rows of ``docs`` (text, held_out), whose tokens ``counts`` has."""
    model = untrained(*_subclass_sums(counts))
    model.weights = _trained(docs, model)
    return model


PARTIAL = "seq long, doc_id {id}, held_out boolean, n_tokens long, n_known long, log_counts double, log_model double, rare array<string>"


def _partial(docs: DataFrame, model: Model, common: dict[bytes, int]) -> DataFrame:
    """PARTIAL rows, one per text and piece: sums over its tokens, of counts over the common ones; the others are listed."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            reader = Reader(model.bits)
            for piece in pieces(batch.column("text")):
                counts = np.fromiter((common.get(w, -1) for w in piece.words), np.int64, len(piece.words))
                c, logs = counts[piece.code], np.log10(np.maximum(counts, 0) + 1)[piece.code]
                first = int(piece.row[0])
                row, n = piece.row - first, int(piece.row[-1]) - first + 1
                summed = lambda w, row=row, n=n: np.bincount(row, weights=w, minlength=n)
                scores = summed(model.log10_subclass(reader.contexts(piece)))
                rare = c < 0
                words = pa.array(piece.words, pa.string()).take(pa.array(piece.code[rare]))
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[rare], minlength=n))])
                columns = [
                    *(batch.column(name).slice(first, n) for name in ("seq", "doc_id", "held_out")), pa.array(np.bincount(row, minlength=n)), pa.array(summed(c > 0).astype(np.int64)),
                    pa.array(summed(logs)), pa.array(scores), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PARTIAL.split(", ")])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("seq"), "doc_id", "held_out", "text")
    return numbered.mapInArrow(score, PARTIAL.format(id=id_type))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words between white space, A-Z lower-cased, and one end. ``base_score`` is the log10 probability of
    the text by counts alone, with 1 added to each; ``score`` that of the model. Null text is empty: one end. Rows of
    null id are scored and not learned from; repeated rows each get a row. Texts of any length are read to their end in
    pieces. Without training rows every count is 0. An empty table gives no rows. Other columns are ignored, whatever
    their names.
    """
    id_column = F.col(f"`{id_col}`")
    rows = docs.select(id_column.alias("doc_id"), F.col(f"`{text_col}`").alias("text"), held_out(id_column).alias("held_out"))
    counts = shared_table(_counts(rows), "lm-counts")
    sums = counts.agg(F.sum("c"), F.sum("n"), F.count_if(F.col("c") > 0)).first()
    n, everything, types = (int(s or 0) for s in sums)
    model = train(rows, counts)
    often = counts.filter(F.col("n") > F.lit(everything) / COMMON).collect()  # COMMON rows at most
    common = {row["word"].encode(): row["c"] for row in often}
    partial = shared_table(_partial(rows, model, common), "lm-partial")  # numbers the rows, for good

    listed = partial.filter(F.size("rare") > 0).select("seq", F.explode("rare").alias("word"))
    known = listed.join(counts.select("word", "c"), "word").groupBy("seq").agg(
        F.lit(0).cast("long").alias("n_tokens"), F.count_if(F.col("c") > 0).alias("n_known"),
        F.sum(F.log10(F.col("c") + 1)).alias("log_counts"), F.lit(0.0).alias("log_model"),
    )
    named = {"doc_id": F.lit(None).cast(partial.schema["doc_id"].dataType), "held_out": F.lit(None).cast("boolean")}
    both = partial.drop("rare").unionByName(known.withColumns(named)).groupBy("seq").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"), F.first("held_out", ignorenulls=True).alias("held_out"),
        *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "log_counts", "log_model")],
    )
    return both.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.lit(float(np.log10(n + types + 1)))).alias("base_score"),
        (F.col("log_counts") + F.col("log_model")).alias("score"),
    )
