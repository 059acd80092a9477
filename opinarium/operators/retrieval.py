"""Similarity search: exact top-K, exact top-K with pruned cells, and approximate
top-K with calibrated probes.

A block of query vectors meets a block of product vectors as one matrix product
inside a task, and only the K best of each query leave it. Pairs are never rows, and block
sizes bound the matrices, not what is exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinarium.functions.vectors import dot
from opinarium.session import materialize

# Similarities equal to this many decimals are ties and go by product id.
TIE_DECIMALS = 12

MAX_QUERIES = 4096
QUERY_BLOCK = 4096
PRODUCT_BLOCK = 32_768
_CELLS_PER_PRODUCT = 4_000_000  # entries of one similarity matrix in memory
# Rows of one task: a part of the queries and its lists are held, products stream past them.
_LEAST_QUERIES, _MOST_QUERIES = 256, 32_768
_LEAST_PRODUCTS, _MOST_PRODUCTS = 4096, 1 << 21
# Slack of a bound: rounding of a similarity, and the ties that go by id.
_BOUND_SLACK = 1e-9


def _best(query: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int):
    """The k best of each query among scored (query, id, similarity) triples."""
    order = np.lexsort((ids, -np.round(sims, TIE_DECIMALS), query))
    query, ids, sims = query[order], ids[order], sims[order]
    place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
    keep = place < k
    return query[keep], ids[keep], sims[keep]


def _match(queries: np.ndarray, ids: np.ndarray, products: np.ndarray, k: int):
    """The k best products of a block for each query of a block."""
    step = max(1, _CELLS_PER_PRODUCT // max(1, len(ids)))
    found = []
    for start in range(0, len(queries), step):
        sims = queries[start : start + step] @ products.T
        if len(ids) > k:
            ranked = np.round(sims, TIE_DECIMALS)
            floor = np.partition(ranked, len(ids) - k, axis=1)[:, len(ids) - k]
            row, col = np.nonzero(ranked >= floor[:, None])
        else:
            row, col = (a.ravel() for a in np.indices(sims.shape))
        found.append(_best(row + start, ids[col], sims[row, col], k))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of a list column as one double matrix; all have the same length."""
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    return flat.reshape(len(vectors), -1)


def _ids(values: pa.Array) -> np.ndarray:
    array = values.to_numpy(zero_copy_only=False)
    return array.astype("U") if array.dtype == object else array


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _top(scored: DataFrame, k: int, query_id: str, product_id: str) -> DataFrame:
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("similarity", TIE_DECIMALS)), F.asc(product_id))
    return scored.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k).drop("_place")


def _with_small_queries(queries: pa.Table, corpus: DataFrame, schema: T.StructType, k: int) -> DataFrame:
    """Few queries: their matrix goes to every task and the corpus stays put."""
    names = _whole(queries.column(0))
    matrix = _matrix(_whole(queries.column(1)))
    out = [f.name for f in schema.fields]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(0).type
            found = _match(matrix, _ids(batch.column(0)), _matrix(batch.column(1)), k)
            if best is not None:
                found = _best(*(np.concatenate(pair) for pair in zip(best, found)), k)
            best = found
        if best is not None:
            query, ids, sims = best
            yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), pa.array(ids, kind), pa.array(sims)], out)

    return corpus.mapInArrow(search, schema)


class _Lists:
    """The k best products of each query of a block while products stream by.

    A similarity below the K-th one known of its query is dropped at once; the others
    wait and are sorted in when they are as many as the lists hold.
    """

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries, self.k = queries, k
        self.floor = np.full(len(queries), -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def meet(self, ids: np.ndarray, products: np.ndarray) -> None:
        step = max(1, _CELLS_PER_PRODUCT // max(1, len(ids)))
        for start in range(0, len(self.queries), step):
            sims = self.queries[start : start + step] @ products.T
            floor = self.floor[start : start + step]
            if len(ids) > self.k and np.isneginf(floor).any():
                ranked = np.round(sims, TIE_DECIMALS)
                floor = np.maximum(floor, np.partition(ranked, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
            row, col = np.nonzero(~(sims < floor[:, None] - _BOUND_SLACK))
            found = sims[row, col]
            near = ~(np.round(found, TIE_DECIMALS) < floor[row])
            part = row[near] + start, ids[col[near]], found[near]
            if len(part[0]) > 2 * self.k * len(sims):
                part = _best(*part, self.k)
            self.parts.append(part)
            self.waiting += len(part[0])
        if self.waiting >= len(self.queries) * self.k:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...] | None:
        """Sorts the waiting ones in; the lists so far."""
        if not self.parts:
            return None
        query, ids, sims = _best(*(np.concatenate(parts) for parts in zip(*self.parts)), self.k)
        self.parts, self.waiting = [(query, ids, sims)], 0
        held = np.bincount(query, minlength=len(self.queries))
        full = held >= self.k
        self.floor[full] = np.round(sims[np.cumsum(held)[full] - 1], TIE_DECIMALS)
        return self.parts[0]


def _tasks(asked: dict[int, int], found: dict[int, int], parallel: int) -> list[tuple[int, int, int, int]]:
    """(cell, first task, parts of the queries, parts of the products) of the cells.

    Work is spread over about ``2 * parallel`` tasks by the size of the cells. Queries are
    cut first, as every product then travels once per part of the queries; products are cut
    where the queries are too few for that.
    """
    cells = sorted(asked.keys() & found.keys())
    work = sum(asked[c] * found[c] for c in cells)
    out, first = [], 0
    for cell in cells:
        share = -(-2 * parallel * asked[cell] * found[cell] // work)
        queries = max(-(-asked[cell] // _MOST_QUERIES), min(share, -(-asked[cell] // _LEAST_QUERIES)))
        products = max(-(-found[cell] // _MOST_PRODUCTS), min(-(-share // queries), -(-found[cell] // _LEAST_PRODUCTS)))
        out.append((cell, first, queries, products))
        first += queries * products
    return out


def _in_blocks(queries: DataFrame, corpus: DataFrame, schema: T.StructType, k: int, query_block: int, product_block: int) -> DataFrame:
    """Both sides large: every task holds a part of the queries of a cell, and a part of the
    cell's products, mostly all of them, streams past it.

    Blocks of both are met as matrices inside the task, so their sizes do not change what
    travels: each query once per part of the products, each product once per part of the
    queries, and lists of K. Parts follow the measured size of the cell, so a cell holding a
    third of all products is many tasks.
    """
    spark = queries.sparkSession
    sizes = [dict(side.groupBy("_cell").agg(F.count(F.lit(1))).collect()) for side in (queries, corpus)]
    plan = _tasks(*sizes, spark.sparkContext.defaultParallelism)
    if not plan:
        return spark.createDataFrame([], schema)
    tasks = plan[-1][1] + plan[-1][2] * plan[-1][3]
    # One row of four integers per cell, and cells are no more than centroids.
    places = F.broadcast(spark.createDataFrame(plan, "_cell int, _first int, _nq int, _np int"))

    def spread(side: DataFrame, number: int, own: str, other: str, task) -> DataFrame:
        key, vector = side.columns[:2]
        part = F.pmod(F.xxhash64(key), F.col(own)).cast("int")
        ids = [F.col(key) if i == number else F.lit(None).cast(schema.fields[i].dataType) for i in (0, 1)]
        return side.join(places, "_cell").select(
            F.explode(F.transform(F.sequence(F.lit(0), F.col(other) - 1), lambda i: F.col("_first") + task(part, i))).alias("_task"),
            F.lit(number).alias("_side"),
            ids[0].alias("_query"),
            ids[1].alias("_product"),
            F.col(vector).alias("_vector"),
        )

    left = spread(queries, 0, "_nq", "_np", lambda own, other: own * F.col("_np") + other)
    right = spread(corpus, 1, "_np", "_nq", lambda own, other: other * F.col("_np") + own)
    names = [f.name for f in schema.fields]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, matrices, blocks, kind = [], [], [], None
        for batch in batches:
            _, side, query, product, vector = batch.columns
            own = int(np.count_nonzero(side.to_numpy() == 0))
            if own:
                asked.append(query.slice(0, own))
                matrices.append(_matrix(vector.slice(0, own)))
            if own == len(side) or not asked:
                continue
            if not blocks:
                matrix = np.concatenate(matrices)
                blocks = [_Lists(matrix[at : at + query_block], k) for at in range(0, len(matrix), query_block)]
            product, kind = product.slice(own), product.type
            ids, products = _ids(product), _matrix(vector.slice(own))
            for at in range(0, len(ids), product_block):
                for block in blocks:
                    block.meet(ids[at : at + product_block], products[at : at + product_block])
        for number, block in enumerate(blocks):
            query, ids, sims = block.settle()
            rows = pa.concat_arrays(asked).take(pa.array(query + number * query_block))
            yield pa.RecordBatch.from_arrays([rows, pa.array(ids, kind), pa.array(sims)], names)

    # Queries come first in a task and stay; products follow batch by batch.
    met = left.unionByName(right).repartitionById(tasks, F.col("_task")).sortWithinPartitions("_side")
    return met.mapInArrow(meet, schema)


def _schema(queries: DataFrame, corpus: DataFrame, query_id: str, product_id: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField(query_id, queries.schema[query_id].dataType),
            T.StructField(product_id, corpus.schema[product_id].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )


def eligible(corpus: DataFrame, min_reviews: int) -> DataFrame:
    """Products that may be recommended; applied before K is taken."""
    return corpus.filter(F.col("num_reviews") >= min_reviews) if min_reviews > 1 else corpus


def topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 50,
    min_reviews: int = 1,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    product_id: str = "product_id",
    vector: str = "embedding",
    query_block: int = QUERY_BLOCK,
    product_block: int = PRODUCT_BLOCK,
) -> DataFrame:
    """The exact K nearest eligible products of every query vector.

    ``(query_id, product_id, similarity)``; both ids are unique on their side.
    Both sides are written once and meet as matrices of ``query_block`` x ``product_block``.
    """
    schema, queries, corpus = _search_sides(queries, corpus, min_reviews, query_id, query_vector, product_id, vector)
    cell = F.lit(0).alias("_cell")
    queries, corpus = materialize(queries, "search-queries"), materialize(corpus, "search-corpus")
    scored = _in_blocks(queries.select("*", cell), corpus.select("*", cell), schema, k, query_block, product_block)
    return _top(scored, k, query_id, product_id)


def topk_few(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 50,
    min_reviews: int = 1,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    product_id: str = "product_id",
    vector: str = "embedding",
) -> DataFrame:
    """:func:`topk` for a set of at most ``MAX_QUERIES`` queries that the caller
    knows to be small: they travel to the corpus. More are an error."""
    schema, queries, corpus = _search_sides(queries, corpus, min_reviews, query_id, query_vector, product_id, vector)
    head = queries.limit(MAX_QUERIES + 1).toArrow()
    if head.num_rows > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries: use topk")
    if not head.num_rows:
        return queries.sparkSession.createDataFrame([], schema)
    return _top(_with_small_queries(head, corpus, schema, k), k, query_id, product_id)


def _search_sides(queries, corpus, min_reviews, query_id, query_vector, product_id, vector):
    schema = _schema(queries, corpus, query_id, product_id)
    queries = queries.filter(F.col(query_vector).isNotNull()).select(query_id, query_vector)
    return schema, queries, eligible(corpus, min_reviews).filter(F.col(vector).isNotNull()).select(product_id, vector)


# The centroids of an index, one unit row per cell; all that the driver holds.
Cells = np.ndarray


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(length == 0.0, 1.0, length)


def train_cells(corpus: DataFrame, n_cells: int, vector: str = "embedding", seed: int = 42, max_iter: int = 20) -> Cells:
    """Centroids of ``n_cells`` cells by k-means over all vectors."""
    points = corpus.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter).fit(points)
    return _unit_rows(np.asarray(model.clusterCenters()))


def sample_cells(corpus: DataFrame, n_cells: int, product_id: str = "product_id", vector: str = "embedding") -> Cells:
    """Centroids in one cheap job: the different vectors among the ``4 * n_cells``
    products of least id digest, at most ``n_cells`` of them. Does not depend on
    partitioning."""
    least = corpus.filter(F.col(vector).isNotNull()).select(F.col(vector), F.md5(F.col(product_id).cast("string")).alias("_draw"), product_id)
    rows = least.orderBy("_draw", product_id).limit(4 * n_cells).collect()
    vectors = list(dict.fromkeys(tuple(row[0]) for row in rows))[:n_cells]
    return _unit_rows(np.array(vectors, dtype=np.float64)) if vectors else np.zeros((0, 1))


def nearest_cells(vector: Column, centroids: np.ndarray, n: int = 1) -> Column:
    """The ``n`` cells whose centroids are most similar to the vector."""
    n = min(n, len(centroids))

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        sims = np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) @ centroids.T
        return pd.Series(list(np.argsort(-sims, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return cells(vector)


def approximate_topk(
    queries: DataFrame,
    corpus: DataFrame,
    centroids: np.ndarray,
    k: int = 50,
    probes: int = 4,
    min_reviews: int = 1,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    product_id: str = "product_id",
    vector: str = "embedding",
    query_block: int = QUERY_BLOCK,
    product_block: int = PRODUCT_BLOCK,
) -> DataFrame:
    """Top-K among the products of the ``probes`` cells nearest to each query;
    similarities are exact, and so is the list when every cell is probed.

    Cells are assigned once and written, as they are read to size the tasks and
    to fill them.
    """
    schema = _schema(queries, corpus, query_id, product_id)
    queries = queries.filter(F.col(query_vector).isNotNull()).select(
        query_id, query_vector, F.explode(nearest_cells(F.col(query_vector), centroids, probes)).alias("_cell")
    )
    corpus = (
        eligible(corpus, min_reviews)
        .filter(F.col(vector).isNotNull())
        .select(product_id, vector, nearest_cells(F.col(vector), centroids).getItem(0).alias("_cell"))
    )
    queries, corpus = materialize(queries, "probes"), materialize(corpus, "cells")
    return _top(_in_blocks(queries, corpus, schema, k, query_block, product_block), k, query_id, product_id)


def calibrate_probes(
    queries: DataFrame,
    corpus: DataFrame,
    centroids: Cells,
    k: int = 50,
    target: float = 0.95,
    sample: int = 256,
    min_reviews: int = 1,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    product_id: str = "product_id",
    vector: str = "embedding",
) -> int:
    """The least number of probes with which the ``sample`` queries of least id
    digest (at most ``MAX_QUERIES``) find a share of ``target`` of their exact lists.

    Only the calibration is on a sample: the exact lists it is measured against
    are over the whole corpus. No queries or no products give one probe.
    """
    asked = queries.filter(F.col(query_vector).isNotNull()).select(query_id, query_vector)
    asked = asked.orderBy(F.md5(F.col(query_id).cast("string")), query_id).limit(sample)
    asked = materialize(asked, "calibration")
    exact = topk_few(asked, corpus, k, min_reviews, query_id, query_vector, product_id, vector)
    order = asked.select(query_id, nearest_cells(F.col(query_vector), centroids, len(centroids)).alias("_order"))
    placed = exact.join(order, query_id).join(corpus.select(product_id, F.col(vector).alias("_vector")), product_id)
    own = nearest_cells(F.col("_vector"), centroids).getItem(0)
    place = placed.select("_order", own.alias("_cell")).select(F.array_position("_order", F.col("_cell")).alias("place"))
    sizes = {row["place"]: row["count"] for row in place.groupBy("place").count().collect()}
    wanted, found = target * sum(sizes.values()), 0
    for probes in range(1, len(centroids) + 1):
        found += sizes.get(probes, 0)
        if found >= wanted:
            return probes
    return max(1, len(centroids))


def _cell_bounds(vectors: np.ndarray, centroids: Cells, stats: np.ndarray) -> np.ndarray:
    """Upper bounds (query, cell) of the similarity to any product of the cell.

    ``stats`` has the largest angle to the centroid, the least and the largest
    length of each cell. By the triangle inequality of angles no product is
    nearer to the query than the angle to the centroid less that largest angle.
    """
    widest, shortest, longest = stats.T
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    cosine = np.clip(vectors @ centroids.T / np.where(length == 0.0, 1.0, length), -1.0, 1.0)
    best = np.cos(np.maximum(np.arccos(cosine) - widest, 0.0))
    return length * np.where(best >= 0, longest, shortest) * best


def _stats(corpus: DataFrame, centroids: Cells, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """(counts, bounds data) of the cells, gathered by partial aggregates."""

    @F.arrow_udf("struct<angle double, length double>")
    def measure(vectors: pa.Array, cells: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.struct([("angle", pa.float64()), ("length", pa.float64())]))
        matrix, own = _matrix(vectors), centroids[cells.to_numpy(zero_copy_only=False)]
        length = np.linalg.norm(matrix, axis=1)
        cosine = np.einsum("ij,ij->i", matrix, own) / np.where(length == 0.0, 1.0, length)
        angle = np.arccos(np.clip(cosine, -1.0, 1.0))
        return pa.StructArray.from_arrays([pa.array(angle), pa.array(length)], ["angle", "length"])

    measured = corpus.select("_cell", measure(F.col(vector), F.col("_cell")).alias("m"))
    rows = measured.groupBy("_cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("m.angle").alias("angle"), F.min("m.length").alias("least"), F.max("m.length").alias("most")
    )
    counts, stats = np.zeros(len(centroids), dtype=np.int64), np.zeros((len(centroids), 3))
    for row in rows.collect():
        counts[row["_cell"]], stats[row["_cell"]] = row["n"], (row["angle"] + _BOUND_SLACK, row["least"], row["most"])
    return counts, stats


def pruned_topk(
    queries: DataFrame,
    corpus: DataFrame,
    centroids: Cells,
    k: int = 50,
    min_reviews: int = 1,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    product_id: str = "product_id",
    vector: str = "embedding",
    query_block: int = QUERY_BLOCK,
    product_block: int = PRODUCT_BLOCK,
    effort: list | None = None,
) -> DataFrame:
    """The exact list of :func:`topk` without the cells that cannot add to it.

    First every query visits the cells of highest bound until they hold ``k``
    products. Its K-th similarity then closes all cells with a lower bound, and
    only open ones are visited. Ties are kept, as a bound equal to the K-th
    similarity leaves a cell open. Vectors may have any length; null ones are
    left out. ``effort``, if given, gets the number of (query, cell) pairs
    visited and the number of all pairs with a product in the cell.
    """
    schema, queries, corpus = _search_sides(queries, corpus, min_reviews, query_id, query_vector, product_id, vector)
    if not len(centroids):
        return queries.sparkSession.createDataFrame([], schema)
    own = nearest_cells(F.col(vector), centroids).getItem(0).alias("_cell")
    corpus = materialize(corpus.select(product_id, vector, own), "cells")
    counts, stats = _stats(corpus, centroids, vector)
    filled = counts > 0

    @F.arrow_udf("array<int>")
    def first_cells(vectors: pa.Array) -> pa.Array:
        if not len(vectors) or not filled.any():
            return pa.array([[]] * len(vectors), pa.list_(pa.int32()))
        bounds = np.where(filled, _cell_bounds(_matrix(vectors), centroids, stats), -np.inf)
        order = np.argsort(-bounds, axis=1, kind="stable")
        before = np.cumsum(counts[order], axis=1) - counts[order]
        return pa.array([list(cells[(held < k) & filled[cells]]) for cells, held in zip(order, before)], pa.list_(pa.int32()))

    @F.arrow_udf("array<int>")
    def open_cells(vectors: pa.Array, floors: pa.Array, seen: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.list_(pa.int32()))
        floor = floors.to_numpy(zero_copy_only=False)[:, None]
        still = filled & (_cell_bounds(_matrix(vectors), centroids, stats) >= floor - _BOUND_SLACK)
        for row, cells in enumerate(seen.to_pylist()):
            still[row, cells] = False
        return pa.array([np.flatnonzero(row).astype(np.int32) for row in still], pa.list_(pa.int32()))

    asked = materialize(queries.withColumn("_first", first_cells(F.col(query_vector))), "search-queries")
    near = asked.select(query_id, query_vector, F.explode("_first").alias("_cell"))
    found = _top(_in_blocks(near, corpus, schema, k, query_block, product_block), k, query_id, product_id)
    found = materialize(found, "first-cells")
    # A list that is not full yet has visited every cell with a product.
    floors = found.groupBy(query_id).agg(F.min("similarity").alias("_floor"))
    left = asked.join(floors, query_id).select(query_id, query_vector, open_cells(F.col(query_vector), "_floor", "_first").alias("_open"))
    rest = materialize(left.select(query_id, query_vector, F.explode("_open").alias("_cell")), "open-cells")
    if effort is not None:
        pairs = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("_first")), F.lit(0))).first()
        effort += [pairs[1] + rest.count(), pairs[0] * int(filled.sum())]
    more = _in_blocks(rest, corpus, schema, k, query_block, product_block)
    return _top(found.unionByName(more), k, query_id, product_id)


def rescore(
    hits: DataFrame,
    queries: DataFrame,
    corpus: DataFrame,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    product_id: str = "product_id",
    vector: str = "embedding",
) -> DataFrame:
    """Hits of any index with the exact cosine of the stored unit vectors, so that
    scores do not depend on how they were found. Unknown ids drop out."""
    return (
        hits.select(query_id, product_id)
        .join(queries.select(query_id, query_vector), query_id)
        .join(corpus.select(product_id, vector), product_id)
        .select(query_id, product_id, dot(F.col(query_vector), F.col(vector)).alias("similarity"))
    )


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id", product_id: str = "product_id") -> DataFrame:
    """Share of the exact list that was found, per query."""
    hits = found.select(query_id, product_id, F.lit(1).alias("_hit"))
    return (
        exact.join(hits, [query_id, product_id], "left")
        .groupBy(query_id)
        .agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))
    )
