"""Approximate nearest neighbours by largest inner product: an inverted multi-index.

The two halves of the vectors are quantised apart; a cell is a pair of centroids. A query walks the cells by the sum of
its two halves' inner products, best first, with a heap over the sorted centroids of either half, until the cells hold
enough vectors; these are ranked by their exact inner products. The vectors are first turned to the principal axes of a sample,
dealt out to both halves in turn: that keeps all inner products, and either half carries as much of the variance.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabsmith.llm.common import in_batches, ship, stored

#: Vectors that the codebooks are fitted on at most, and queries that the number of visited vectors is fitted on.
SAMPLE_VECTORS, SAMPLE_QUERIES = 8192, 256
#: Share of the true neighbours of those queries, among all vectors, that must lie in the visited cells.
RECALL = 0.94
#: Vectors of a cell on average, and centroids of a half at most. With fewer vectors a cell, many cells are empty and the walk over
#: them costs far more than ranking the vectors in them.
CELL_VECTORS, MOST_CENTROIDS = 4, 256
#: Vectors and queries that meet in one group.
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 1024
LEAST_VISITED = 400


@dataclass
class MultiIndex:
    """Centroids of both halves (k x half), the share of all vectors that a query visits, and the axes (dim x dim, none: as they are)."""

    first: np.ndarray
    second: np.ndarray
    share: float = 1.0
    axes: np.ndarray | None = None

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def turned(self, x: np.ndarray) -> np.ndarray:
        return x if self.axes is None else x @ self.axes

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.turned(x)
        return nearest(x[:, : self.half], self.first), nearest(x[:, self.half :], self.second)

    def walk(self, query: np.ndarray):
        """Pairs of centroids, the largest sum of inner products first."""
        query = self.turned(query)
        a, b = self.first @ query[: self.half], self.second @ query[self.half :]
        rows, columns = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
        high, wide = (-a[rows]).tolist(), (-b[columns]).tolist()
        # One entry for each row that is begun: its best pair that is left. A row begins when the first pair of the row before is taken.
        heap, last = [(high[0] + wide[0], 0, 0)], len(columns) - 1
        while heap:
            _, i, j = heap[0]
            yield rows[i], columns[j]
            if j < last:
                heapq.heapreplace(heap, (high[i] + wide[j + 1], i, j + 1))
            else:
                heapq.heappop(heap)
            if not j and i + 1 < len(rows):
                heapq.heappush(heap, (high[i + 1] + wide[0], i + 1, 0))

    def visited(self, query: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
        """Which cells a query visits (k x k), until they hold `least` vectors."""
        held, size, opened, width = 0, counts.ravel().tolist(), [], counts.shape[1]
        for i, j in self.walk(query):
            cell = i * width + j
            opened.append(cell)
            held += size[cell]
            if held >= least:
                break
        open_ = np.zeros(counts.size, bool)
        open_[opened] = True
        return open_.reshape(counts.shape)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of the closest centroid of each row."""
    return (x @ centroids.T - (centroids**2).sum(1) / 2).argmax(1)


def codebook(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """At most k centroids of a small sample by Lloyd's method, from well spread rows."""
    rng = np.random.default_rng(0)
    chosen = [x[0]]
    far = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < k and far.max() > 1e-12:
        chosen.append(x[rng.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, ((x - chosen[-1]) ** 2).sum(1))
    centroids = np.array(chosen)
    for _ in range(rounds):
        own = nearest(x, centroids)
        size = np.bincount(own, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        centroids = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centroids)
    return centroids


def principal_axes(x: np.ndarray) -> np.ndarray:
    """The principal axes of the rows as columns, those of even rank before those of odd rank."""
    _, axes = np.linalg.eigh(np.cov(x, rowvar=False, bias=True).reshape(x.shape[1], -1))
    falling = axes[:, ::-1]
    return np.ascontiguousarray(np.hstack([falling[:, 0::2][:, : x.shape[1] // 2], falling[:, 1::2], falling[:, 0::2][:, x.shape[1] // 2 :]]))


def fit(sample: np.ndarray, k: int) -> MultiIndex:
    """An index of at most k centroids a half, from a bounded sample."""
    axes = principal_axes(sample)
    turned = sample @ axes
    half = sample.shape[1] // 2
    return MultiIndex(codebook(turned[:, :half], k), codebook(turned[:, half:], k), 1.0, axes)


def share_needed(index: MultiIndex, counts: np.ndarray, queries: np.ndarray, neighbours: list[list[tuple[int, int]]], recall: float) -> float:
    """The smallest share of all vectors that the visited cells must hold, so that `recall` of the queries' true neighbours (their cells) lie in them."""
    needed = []
    for query, cells in zip(queries, neighbours, strict=True):
        left, held = set(cells), 0
        at = {}
        for cell in index.walk(query):
            if not left:
                break
            held += counts[cell]
            if cell in left:
                left.remove(cell)
                at[cell] = held
        needed.extend(at[c] for c in cells)
    return float(np.quantile(needed, recall, method="higher")) / counts.sum() if needed else 1.0


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows that take part: an id, and finite numbers that are not all zero."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def best_of(queries: np.ndarray, query_ids: np.ndarray, open_: np.ndarray, vectors: np.ndarray, ids: np.ndarray, cells: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k best vectors of each query in its open cells: largest exact product first, ties to the smaller id."""
    products = queries @ vectors.T
    products[~open_[:, cells]] = -np.inf
    products[query_ids[:, None] == ids[None, :]] = -np.inf
    owner, found, score = [], [], []
    # Products of a matrix may differ in the last digits from place to place; close ones are summed anew in one fixed order.
    slack = 1e-9 * np.abs(queries).max(1) * np.abs(vectors).max() * vectors.shape[1]
    for q in range(len(queries)):
        line = products[q]
        if len(line) > k:
            least = np.partition(line, len(line) - k)[len(line) - k] - slack[q]
            near = np.flatnonzero((line >= least) & (line > -np.inf))
        else:
            near = np.flatnonzero(line > -np.inf)
        exact = (vectors[near] * queries[q]).sum(1)
        order = np.lexsort((ids[near], -exact))[:k]
        owner.extend([query_ids[q]] * len(order))
        found.extend(ids[near][order])
        score.extend(exact[order])
    return owner, found, score


def nearest_cells(indexed: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """The cells of the true k nearest among all vectors, for a few queries: k rows a query leave a task, k a query reach the driver."""
    sent = indexed.sparkSession.sparkContext.broadcast((queries, ids))

    def best(batches):
        few, few_ids = sent.value
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            products = few @ _matrix(batch.column("v")).T
            own = np.array(batch.column("id"))
            products[few_ids[:, None] == own[None, :]] = -np.inf
            cells = np.stack([np.array(batch.column("i")), np.array(batch.column("j"))], 1)
            found = (products, np.broadcast_to(cells, (len(few), *cells.shape)))
            if kept is not None:
                found = tuple(np.concatenate(pair, 1) for pair in zip(kept, found, strict=True))
            top = np.argsort(-found[0], axis=1, kind="stable")[:, :k]
            kept = np.take_along_axis(found[0], top, 1), np.take_along_axis(found[1], top[:, :, None], 1)
        if kept is not None:
            q = np.repeat(np.arange(len(few), dtype=np.int32), kept[0].shape[1])
            at = kept[1].reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(kept[0].ravel())], names=["q", "i", "j", "score"])

    rows = in_batches(indexed, best, "q int, i int, j int, score double").where(F.col("score") > float("-inf"))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "i", "j"))).where(F.col("rank") <= k)
    out = [[] for _ in queries]
    for r in rows.select("q", "i", "j").collect():
        out[r["q"]].append((r["i"], r["j"]))
    return out


def build(rows: DataFrame, dim: int, total: int, k: int, recall: float) -> tuple[MultiIndex, DataFrame, np.ndarray]:
    """The index, every row with its cell (id, v, i, j), and the number of rows in each cell."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_VECTORS).toArrow()
    ids, sample = sample.column("id").to_numpy(), _matrix(sample.column("v"))
    index = fit(sample, int(np.clip(round((total / CELL_VECTORS) ** 0.5), 1, MOST_CENTROIDS)))
    sent = rows.sparkSession.sparkContext.broadcast(index)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                i, j = sent.value.cells(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), batch.column("v"), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))], names=["id", "v", "i", "j"])

    indexed = stored(in_batches(rows, assign, "id long, v array<double>, i int, j int"))
    counts = np.zeros((len(index.first), len(index.second)), np.int64)
    for r in indexed.groupBy("i", "j").count().collect():  # at most MOST_CENTROIDS ** 2 rows
        counts[r["i"], r["j"]] = r["count"]
    queries = sample[:SAMPLE_QUERIES]
    index.share = share_needed(index, counts, queries, nearest_cells(indexed, queries, ids[:SAMPLE_QUERIES], k), recall)
    return index, indexed, counts


def bands(held: np.ndarray, most: int) -> np.ndarray:
    """Where runs of first-half centroids begin that hold at most `most` vectors together (or are one centroid); the number of centroids at the end."""
    starts, size = [0], 0
    for i, n in enumerate(held.tolist()):
        if size and size + n > most:
            starts.append(i)
            size = 0
        size += n
    return np.array([*starts, len(held)])


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    recall: float = RECALL,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `vectors` that is a query, its k nearest others by inner product.

    `is_query` is a condition on the id, named `id`.

    Vectors that are NULL, all zero, or hold NULL or non-finite numbers take no part, nor do NULL ids and vectors of another length
    than the most frequent (of those, the smallest). Rows with one id are candidates each, but not for queries of that id.
    Ties go to the smaller id. An empty table gives no rows; other columns are not read.

    Codebooks come from a bounded sample by a hash of the ids; every vector is indexed. The number of centroids of a half grows with
    the square root of the vectors, up to MOST_CENTROIDS. How many vectors a query visits is fitted on a few queries whose true neighbours
    among all vectors are found by one pass over them. Runs of cells meet the queries that open one of them; hot ones are dealt out in blocks of
    vectors and of queries.
    """
    rows = valid_vectors(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    schema = "query_id long, vec_id long, score double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = sizes[0]
    rows = rows.where(F.size("v") == dim)
    index, indexed, counts = build(rows, dim, total, k, recall)
    spark = vectors.sparkSession
    least = max(index.share * total, LEAST_VISITED)
    starts = bands(counts.sum(1), BLOCK_VECTORS)
    sent = spark.sparkContext.broadcast((index, counts, starts))

    def probe(batches):
        index, counts, starts = sent.value
        for batch in batches:
            owner, band, cells = [], [], []
            for n, query in enumerate(_matrix(batch.column("v")) if batch.num_rows else []):
                open_ = index.visited(query, counts, least) & (counts > 0)
                for b in np.flatnonzero(np.add.reduceat(open_.any(1), starts[:-1])):
                    owner.append(n)
                    band.append(b)
                    cells.append(np.packbits(open_[starts[b] : starts[b + 1]]).tobytes())
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("v").take(take), pa.array(band, pa.int32()), pa.array(cells, pa.binary())], names=["id", "v", "band", "cells"])

    probes = stored(in_batches(indexed.where(is_query).select("id", "v"), probe, "id long, v array<double>, band int, cells binary"))
    # How many blocks of vectors and of queries meet in each band: at most MOST_CENTROIDS rows.
    band_of = F.element_at(F.array(*[F.lit(int(b)) for b in np.repeat(np.arange(len(starts) - 1), np.diff(starts))]), F.col("i") + 1)
    placed = indexed.withColumn("band", band_of)
    blocks = probes.groupBy("band").count().select("band", F.ceil(F.col("count") / BLOCK_QUERIES).cast("int").alias("query_blocks"))
    blocks = blocks.join(placed.groupBy("band").count().select("band", F.ceil(F.col("count") / BLOCK_VECTORS).cast("int").alias("vector_blocks")), "band")
    blocks = F.broadcast(stored(blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = probes.join(blocks, "band").withColumn("qb", F.pmod(F.xxhash64("id"), "query_blocks").cast("int")).select("id", "v", "band", "cells", "qb", every("vector_blocks").alias("vb"))
    right = placed.join(blocks, "band").withColumn("vb", F.pmod(F.xxhash64("id", F.lit(1)), "vector_blocks").cast("int")).select("id", "v", "i", "j", "band", "vb", every("query_blocks").alias("qb"))

    def meet(key, queries, found):
        _, counts, starts = sent.value
        columns = [[], [], []]
        if len(queries) and len(found):
            low, width = starts[key[0].as_py()], counts.shape[1]
            cells = (found.column("i").to_numpy() - low) * width + found.column("j").to_numpy()
            open_ = np.stack([np.unpackbits(np.frombuffer(c, np.uint8)) for c in queries.column("cells").to_pylist()]).astype(bool)
            columns = best_of(_matrix(queries.column("v")), queries.column("id").to_numpy(), open_, _matrix(found.column("v")), found.column("id").to_numpy(), cells, k)
        return pa.Table.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    ship(vectors.sparkSession)
    near = left.groupBy("band", "qb", "vb").cogroup(right.groupBy("band", "qb", "vb")).applyInArrow(meet, schema)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

