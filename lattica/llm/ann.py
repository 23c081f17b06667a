"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut into two halves and each half is quantised with its own codebook, so K centroids per half give K x K
cells. A query visits the cells in the order of the summed distance of its halves to the two centroids, which a heap
yields one by one, until the visited cells hold enough entries; those entries are reranked by their exact distance.

How many entries are enough is fitted with the codebooks on a bounded sample: the smallest share of it that finds
``target_recall`` of the true neighbours. The codebooks grow with the root of the table, up to a centroid per
SAMPLE_PER_CENTROID rows of the sample. Every vector is indexed and no cell is capped.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.shared import shared_table

#: Vectors that codebooks and share are fitted on, and queries among them that measure recall.
SAMPLE_ROWS = 20_000
SAMPLE_QUERIES = 200
SAMPLE_PER_CENTROID = 40
TARGET_RECALL = 0.94
#: Fewest and most entries in a block, the unit that is reranked at a time.
BLOCK_ROWS = (2048, 16384)
#: Queries that meet a block in one task, and of which distances are held at a time.
QUERY_ROWS, QUERY_SLICE = 2048, 256


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def fit_centroids(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's k-means of a sample; an emptied cluster restarts at the row farthest from its centroid."""
    rng = np.random.default_rng(seed)
    centroids = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        far = squared_distances(rows, centroids)
        nearest = far.argmin(1)
        counts = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        for column in range(rows.shape[1]):
            sums[:, column] = np.bincount(nearest, rows[:, column], len(centroids))
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
        if not full.all():
            centroids[~full] = rows[np.argsort(-far.min(1))[: (~full).sum()]]
    return centroids


def cells_by_distance(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of centroids in the order of ``first[i] + second[j]``, from a heap of the pairs next in line."""
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap = [(first[one[0]] + second[two[0]], 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(one[i]), int(two[j])
        if j + 1 < len(two):
            heapq.heappush(heap, (first[one[i]] + second[two[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(one):
            heapq.heappush(heap, (first[one[i + 1]] + second[two[0]], i + 1, 0))


@dataclass
class MultiIndex:
    """The codebooks of the halves, and the share of all entries that a query visits."""

    first: np.ndarray
    second: np.ndarray
    share: float = 1.0

    @property
    def half(self) -> int:
        return self.first.shape[1]

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def cell(self, rows: np.ndarray) -> np.ndarray:
        one = squared_distances(rows[:, : self.half], self.first).argmin(1)
        two = squared_distances(rows[:, self.half :], self.second).argmin(1)
        return one * len(self.second) + two

    def sums(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves of ``rows`` to the centroids; a cell's is the sum of two."""
        return squared_distances(rows[:, : self.half], self.first), squared_distances(rows[:, self.half :], self.second)

    def radius(self, first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: float) -> float:
        """The summed distance up to which the cells, nearest first, together hold ``enough`` entries."""
        held, last = 0, 0.0
        for i, j in cells_by_distance(first, second):
            if count := counts[i * len(self.second) + j]:
                held += count
                last = float(first[i] + second[j])
                if held >= enough:
                    break
        return last


def within(sums: np.ndarray, radius) -> np.ndarray:
    """Whether cells lie within a radius; the margin is for sums that were computed in other batches."""
    return sums <= radius * (1 + 1e-9) + 1e-12


def fit(sample: np.ndarray, total: int, k: int, target_recall: float = TARGET_RECALL) -> MultiIndex:
    """Codebooks and share for a table of ``total`` vectors, from a sample of it.

    A larger table is searched with the share that its sample needs; with more vectors neighbours are nearer, so that
    share finds no fewer of them.
    """
    half = sample.shape[1] // 2
    size = max(2, min(len(sample) // SAMPLE_PER_CENTROID, round(math.sqrt(total) / 2)))
    index = MultiIndex(fit_centroids(sample[:, :half], size), fit_centroids(sample[:, half:], size))
    cell = index.cell(sample)
    rng = np.random.default_rng(11)
    needed = []
    for row in rng.choice(len(sample), min(SAMPLE_QUERIES, len(sample)), replace=False):
        far = ((sample - sample[row]) ** 2).sum(1)
        far[row] = np.inf
        near = np.argpartition(far, min(k, len(sample) - 1) - 1)[: min(k, len(sample) - 1)]
        first, second = index.sums(sample[row : row + 1])
        sums = (first[0][:, None] + second[0][None, :]).ravel()[cell]
        needed.extend(np.searchsorted(np.sort(sums), sums[near], side="right"))  # entries up to the neighbour's cell
    if needed:
        index.share = min(1.0, float(np.quantile(needed, target_recall)) / len(sample))
    return index


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector of doubles) of the rows that take part.

    Rows whose id or vector is null, or whose vector is zero, has null or non-finite components or not the most
    frequent length, take no part. A row that is repeated counts once; an id with several vectors is as many rows, and
    none of them is a neighbour of another.
    """
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    # -0.0 and 0.0 are one number: their sum with 0.0 makes equal vectors equal keys
    rows = rows.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("vector"))
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").limit(1)
    found = lengths.first()
    return rows.filter(F.size("vector") == (found["length"] if found else 0))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(-1, width)


def nearest(
    table: DataFrame,
    k: int = 10,
    query_filter: str = "vec_id % 100 = 0",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = SAMPLE_ROWS,
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank, vec_id, score (Euclidean distance), nearest first.

    Queries are the rows that ``query_filter`` keeps, candidates all rows but the query's own. Ties go to the smaller
    vec_id. Which rows take part says :func:`vectors`; a query among the others gets no rows, nor does an empty table.

    Equal vectors are one entry with its k + 1 smallest ids, as no further copy can be among the k nearest; equal
    queries are searched once. So a vector that a third of the table repeats costs no more than any other. Vectors may
    be of any length.

    Entries lie in blocks of neighbouring cells; a query goes to the blocks that hold cells it visits, and a block is
    copied once per QUERY_ROWS queries that visit it. So the work grows with the pairs of queries and entries visited.
    """
    rows = shared_table(vectors(table, id_col, vector_col), "ann-vectors")
    copies = Window.partitionBy("vector").orderBy("vec_id")
    entries = rows.distinct().withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1)
    entries = shared_table(entries.select("vec_id", "vector"), "ann-entries")
    sample = entries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vector").toPandas()
    total = entries.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if total < 2:
        return table.sparkSession.createDataFrame([], schema)
    width = len(sample["vector"].iloc[0])
    pad = width == 1  # two halves need two components
    points = _matrix(sample["vector"], width)
    index = fit(np.hstack([points, np.zeros((len(points), 1))]) if pad else points, total, k, target_recall)

    def wide(values: pd.Series) -> np.ndarray:
        rows = _matrix(values, width)
        return np.hstack([rows, np.zeros((len(rows), 1))]) if pad else rows

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=index.cell(wide(batch["vector"])))

    placed = entries.mapInPandas(place, "vec_id long, vector array<double>, cell long")
    placed = shared_table(placed, "ann-cells")
    counts = np.zeros(index.cells, dtype=np.int64)
    for cell, count in placed.groupBy("cell").count().collect():  # a row per cell
        counts[cell] = count

    # Cells in blocks of about block_rows: small cells share one, a large one has several
    block_rows = min(BLOCK_ROWS[1], max(BLOCK_ROWS[0], total // 64))
    parts = np.maximum(1, -(-counts // block_rows))
    start, filled, first_block = 0, 0, np.zeros(index.cells, dtype=np.int64)
    for cell in range(index.cells):
        if parts[cell] > 1 or filled + counts[cell] > block_rows:
            start, filled = start + bool(filled), 0
        first_block[cell] = start
        filled += int(counts[cell])
        if parts[cell] > 1:
            start, filled = start + int(parts[cell]), 0

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = batch["cell"].to_numpy()
            spread = (batch["vec_id"].to_numpy() * 2654435761 >> 7) % parts[cell]
            yield batch.assign(block=first_block[cell] + spread)

    enough = max(2 * k, math.ceil(index.share * total))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for query, vector in zip(batch["query_id"], batch["vector"], strict=True):
                first, second = (half[0] for half in index.sums(wide(pd.Series([vector]))))
                radius = index.radius(first, second, counts, enough)
                cells = np.flatnonzero(within((first[:, None] + second[None, :]).ravel(), radius) & (counts > 0))
                single, several = cells[parts[cells] == 1], cells[parts[cells] > 1]
                blocks = [np.unique(first_block[single])]
                blocks += [np.arange(first_block[c], first_block[c] + parts[c]) for c in several]
                out.extend((query, vector, radius, b) for b in np.concatenate(blocks).tolist())
            yield pd.DataFrame(out, columns=["query_id", "vector", "radius", "block"])

    asked = rows.filter(query_filter).distinct()
    distinct_queries = asked.groupBy("vector").agg(F.min("vec_id").alias("query_id"))
    distinct_queries = shared_table(distinct_queries.select("query_id", "vector"), "ann-queries")
    spread_out = distinct_queries.repartition(table.sparkSession.sparkContext.defaultParallelism, "query_id")
    routed = spread_out.mapInPandas(route, "query_id long, vector array<double>, radius double, block long")
    routed = shared_table(routed, "ann-routed")
    chunks = routed.groupBy("block").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("long").alias("chunks"))
    chunks = shared_table(chunks, "ann-chunks")  # a row per block
    routed = routed.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks"))).drop("chunks")
    blocks = placed.mapInPandas(block, "vec_id long, vector array<double>, cell long, block long").join(chunks, "block")
    blocks = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")

    def rerank(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        """The k + 1 nearest visited entries of a block for each query, by exact distances."""
        if not len(queries) or not len(held):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        points, ids = wide(held["vector"]), held["vec_id"].to_numpy()
        one, two = np.divmod(held["cell"].to_numpy(), len(index.second))
        most = float((points * points).sum(1).max())
        out = []
        for begin in range(0, len(queries), QUERY_SLICE):
            part = queries.iloc[begin : begin + QUERY_SLICE]
            asking, names = wide(part["vector"]), part["query_id"].to_numpy()
            first, second = index.sums(asking)
            seen = within(first[:, one] + second[:, two], part["radius"].to_numpy()[:, None])
            rough = np.where(seen, squared_distances(asking, points), np.inf)
            last = np.partition(rough, min(k, len(ids) - 1), axis=1)[:, min(k, len(ids) - 1)]
            margin = 1e-9 * ((asking * asking).sum(1) + most)  # far above the error of the rough distances
            query, entry = np.nonzero((rough <= (last + margin)[:, None]) & seen)
            score = np.sqrt(((points[entry] - asking[query]) ** 2).sum(1))
            order = np.lexsort((ids[entry], score, query))
            query, entry, score = query[order], entry[order], score[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            top = place <= k
            out.append(pd.DataFrame({"query_id": names[query[top]], "vec_id": ids[entry[top]], "score": score[top]}))
        return pd.concat(out)

    near = routed.groupBy("block", "chunk").cogroup(blocks.groupBy("block", "chunk"))
    near = near.applyInPandas(rerank, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    near = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k + 1)
    near = near.select(F.col("query_id").alias("searched"), "vec_id", "score")

    # Back to all queries: those with equal vectors get the same neighbours, each without itself
    ids = asked.join(distinct_queries.withColumnRenamed("query_id", "searched"), "vector")
    ids = ids.select(F.col("vec_id").alias("query_id"), "searched").distinct()
    answers = ids.join(shared_table(near, "ann-near"), "searched").filter("vec_id != query_id")
    ranked = answers.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
