"""Exact top-k inner products by ball trees, one per shard.

Rows that repeat id and vector are counted first, as only k of them can matter. The others are
dealt to cells around centres from a bounded sample, so that a cell is a ball, and a cell
with many rows is cut into slices by id and vector: a shard is a slice of a cell. In a shard a ball
tree (centres and radii) gives every node an upper bound of a query's inner products: query times
centre plus query's length times radius. Nodes whose bound is below the query's current k-th
score are cut off; the leaves that remain are visited from the highest bound down,
raising the k-th score, until no bound reaches it. Every query first searches the
shard it lies in; the k-th score found there is shared with all others, and the query
goes only to the cells whose own ball reaches it.

Queries meet a shard in blocks of about ``QUERY_BLOCK``, as many as it is asked. Of equal
vectors in a shard at most k rows of an id and 2 k rows in all can matter (k of them may be
the query's own), so a vector with many copies costs little. Centres decide what is left out, never the
result.

Components are floor(scale * x) as whole numbers, and products are exact.

Defined cases: vectors that are null or hold a null or non-finite component take no
part, nor do rows without an id; vectors of another length than the query's are not
its candidates; rows that repeat a query's id and vector are one query, and
candidates that repeat an id are returned each; ties go to the smaller id; a query
with fewer candidates than k returns all. Numbers beyond 64 bits wrap. An empty
table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewloom.session import stored

SHARD, QUERY_BLOCK, LEAF = 32_768, 8_192, 64
#: Cells at most, sampled vectors per cell, and components of the sample at most.
CELLS, SAMPLE, SAMPLE_SIZE = 16_384, 16, 8 << 20
#: Below this a product of whole numbers is exact in doubles.
_EXACT = 1 << 20
_HIT = "query_id long, query_key long, vec_id long, score long"


class BallTree:
    """Nodes in breadth-first order; leaf l holds the points from ``first[l]`` up to ``last[l]``."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        centres, radii, self.children, self.first, self.last = [], [], [], [], []
        todo = [(0, len(points))]
        at = 0
        while at < len(todo):
            begin, end = todo[at]
            own = points[self.order[begin:end]]
            centre = own.mean(axis=0)
            apart = np.sqrt(((own - centre) ** 2).sum(axis=1))
            centres.append(centre)
            radii.append(apart.max())
            self.first.append(begin)
            self.last.append(end)
            if end - begin > LEAF:
                one = own[apart.argmax()]
                other = own[((own - one) ** 2).sum(axis=1).argmax()]
                middle = (begin + end) // 2
                side = np.argpartition(own @ (one - other), middle - begin)
                self.order[begin:end] = self.order[begin:end][side]
                self.children.append((len(todo), len(todo) + 1))
                todo += [(begin, middle), (middle, end)]
            else:
                self.children.append(None)
            at += 1
        self.centres, self.radii = np.array(centres), np.array(radii)

    def bounds(self, queries: np.ndarray, lengths: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Upper bounds of each (query, node), with room for rounding."""
        reach = lengths * self.radii[nodes]
        return np.einsum("nd,nd->n", queries, self.centres[nodes]) + reach + 1e-9 * (reach + 1) + 1e-3 \
            + 1e-9 * lengths * np.sqrt((self.centres[nodes] ** 2).sum(axis=1))

    def leaves(self, queries: np.ndarray, lengths: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, leaf, bound) of all leaves whose bound, and that of every node above, reaches ``least``."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        asks, nodes = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        leaf = np.array([c is None for c in self.children])
        pairs = np.array([c or (0, 0) for c in self.children])
        while len(asks):
            high = self.bounds(queries[asks], lengths[asks], nodes)
            reaching = high >= least[asks]
            asks, nodes, high = asks[reaching], nodes[reaching], high[reaching]
            ends = leaf[nodes]
            found.append((asks[ends], nodes[ends], high[ends]))
            asks, nodes = np.repeat(asks[~ends], 2), pairs[nodes[~ends]].ravel()
        return tuple(np.concatenate(x) for x in zip(*found))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search(points: np.ndarray, ids: list[np.ndarray], queries: np.ndarray, own: np.ndarray, least: np.ndarray,
           k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Scores and ids of each query's best ``k`` that reach ``least``, in a shard.

    ``points`` are distinct; ``ids[n]`` are the ids of point n; ``own`` is the id each query leaves out.
    """
    exact = max(np.abs(points).max(initial=0), np.abs(queries).max(initial=0)) < _EXACT
    whole = (points, queries) if exact else (points.astype(np.int64), queries.astype(np.int64))
    tree = BallTree(points)
    lengths = np.sqrt((queries**2).sum(axis=1))
    least = least.copy()
    asks, nodes, high = tree.leaves(queries, lengths, least)
    order = np.lexsort((-high, asks))
    asks, nodes, high = asks[order], nodes[order], high[order]
    begin = np.searchsorted(asks, np.arange(len(queries) + 1))
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
    active, step = np.arange(len(queries)), 0
    while len(active):  # each active query visits its next leaf
        at = begin[active] + step
        more = at < begin[active + 1]
        active, at = active[more], at[more]
        reaching = high[at] >= least[active]
        active, at = active[reaching], at[reaching]
        for node in np.unique(nodes[at]):
            here = active[nodes[at] == node]
            inside = tree.order[tree.first[node]:tree.last[node]]
            products = whole[1][here] @ whole[0][inside].T
            for q, row in zip(here.tolist(), products):
                near = np.flatnonzero(row >= least[q])
                if not len(near):
                    continue
                names = [ids[inside[n]] for n in near]
                new = np.concatenate(names)
                value = np.repeat(row[near].astype(np.int64), [len(x) for x in names])
                other = new != own[q]
                best[q] = _best(np.concatenate([best[q][0], value[other]]), np.concatenate([best[q][1], new[other]]), k)
                if len(best[q][0]) == k:
                    least[q] = max(least[q], best[q][0][-1])
        step += 1
    return best


def _needed(ids: np.ndarray, k: int) -> np.ndarray:
    """Of ascending ids those that can be among the ``k`` smallest when any one id is left out."""
    if len(ids) <= k:
        return ids
    return ids[np.arange(len(ids)) - np.searchsorted(ids, ids) < k][:2 * k]


def _matrix(column: pa.ChunkedArray, scale: float) -> list[np.ndarray]:
    return [np.floor(scale * np.asarray(v.values, np.float64)) for v in column]


def _group(points: pa.Table, queries: pa.Table, k: int, scale: float) -> pa.Table:
    """One shard against one block of queries."""
    out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    rows, asked = _matrix(points["vector"], scale), _matrix(queries["vector"], scale)
    sizes = np.array([len(r) for r in rows], np.int64)
    for size in {len(a) for a in asked}:
        own_rows = np.flatnonzero(sizes == size)
        which = [n for n, a in enumerate(asked) if len(a) == size]
        if not len(own_rows):
            continue
        distinct, group = np.unique(np.array([rows[n] for n in own_rows]).reshape(len(own_rows), size), axis=0,
                                    return_inverse=True)
        names = points["vec_id"].to_numpy()[own_rows]
        order = np.lexsort((names, group.ravel()))
        cuts = np.flatnonzero(np.diff(group.ravel()[order])) + 1
        ids = [_needed(x, k) for x in np.split(names[order], cuts)]
        asks = queries.take(pa.array(which))
        least = asks["least"].to_numpy().astype(np.float64)
        found = search(distinct, ids, np.array([asked[n] for n in which]).reshape(len(which), size),
                       asks["query_id"].to_numpy(), np.where(np.isnan(least), -np.inf, least), k)
        for name, key, (scores, near) in zip(asks["query_id"].to_pylist(), asks["query_key"].to_pylist(), found):
            out.append((name, key, near, scores))
    counts = [len(near) for _, _, near, _ in out]
    return pa.table({
        "query_id": pa.array(np.repeat(np.array([x[0] for x in out], np.int64), counts)),
        "query_key": pa.array(np.repeat(np.array([x[1] for x in out], np.int64), counts)),
        "vec_id": pa.array(np.concatenate([x[2] for x in out]) if out else np.zeros(0, np.int64)),
        "score": pa.array(np.concatenate([x[3] for x in out]) if out else np.zeros(0, np.int64)),
    })


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, np.int64), *(np.argmin(half - points[at:at + 2048] @ centres.T, axis=1)
                                                    for at in range(0, len(points), 2048))])


def _centres(points: DataFrame, cells: int, scale: float) -> np.ndarray:
    """Means of the parts of a sample; all have the length of its first vector."""
    size = points.select(F.size("vector")).first()[0]
    drawn = (points.where(F.size("vector") == size).select("vector", F.xxhash64("vec_id", "vector", F.lit(1)).alias("draw"))
             .orderBy("draw").limit(min(cells * SAMPLE, max(cells, SAMPLE_SIZE // max(1, size)))))
    sample = np.array(_matrix(drawn.select("vector").toArrow()["vector"], scale)).reshape(-1, size)
    centres = sample[:cells].copy()
    for _ in range(3):
        home = _nearest(sample, centres)
        counts, sums = np.bincount(home, minlength=len(centres)), np.zeros_like(centres)
        np.add.at(sums, home, sample)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _placed(centres: np.ndarray, scale: float):
    """Each vector with its cell and its distance from the centre; cell -1 is for vectors of another length."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1), scale)
            own = np.flatnonzero([len(r) == centres.shape[1] for r in rows])
            points = np.array([rows[n] for n in own]).reshape(len(own), centres.shape[1])
            cell, apart = np.full(len(rows), -1), np.full(len(rows), np.inf)
            cell[own] = _nearest(points, centres)
            apart[own] = np.sqrt(((points - centres[cell[own]])**2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(apart)],
                                             [*batch.schema.names, "cell", "apart"])
    return place


def _reached(centres: np.ndarray, radii: np.ndarray, slices: np.ndarray, others: int, scale: float):
    """Each query once per shard, but its own, whose ball reaches the query's k-th score; ``others`` shards hold other lengths."""
    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.sqrt((centres**2).sum(axis=1))
        first = np.cumsum(slices) - slices
        shard_cell = np.repeat(np.arange(len(slices)), slices)
        shard_slice = np.arange(len(shard_cell)) - first[shard_cell]
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                queries, cell, slice_, least = _matrix(part.column("vector"), scale), *(
                    part.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "slice", "least"))
                rows, cells, places = [], [], []
                for n, query in enumerate(queries):
                    if cell[n] < 0:
                        found = np.arange(others)
                        found = found[found != slice_[n]]
                        cells.append(np.full(len(found), -1))
                        places.append(found)
                    else:
                        own = np.sqrt((query**2).sum())
                        bound = centres @ query + own * radii + 1e-9 * own * (radii + lengths) + 1e-3
                        found = np.flatnonzero(~(bound < least[n])[shard_cell])  # no score so far reaches everything
                        found = found[(shard_cell[found] != cell[n]) | (shard_slice[found] != slice_[n])]
                        cells.append(shard_cell[found])
                        places.append(shard_slice[found])
                    rows.append(np.full(len(found), n))
                chosen = pa.array(np.concatenate([np.zeros(0, np.int64), *rows]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).take(chosen) for c in ("query_id", "query_key", "vector", "least")]
                    + [pa.array(np.concatenate([np.zeros(0), *x]).astype(np.int32)) for x in (cells, places)],
                    ["query_id", "query_key", "vector", "least", "cell", "slice"])
    return reach


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_column: str = "vec_id",
          vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest inner products of each query's row with all others."""
    points = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector"),
                            is_query.alias("is_query")).where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    rows = points.count()
    if not rows:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = min(CELLS, max(1, math.ceil(rows / SHARD), min(2 * partitions, math.ceil(rows / 1024))))
    centres = _centres(points, cells, scale)
    kind = points.schema["vector"].dataType.simpleString()
    # rows of one id and vector meet as counts
    placed = stored(
        points.groupBy("vec_id", "vector").agg(F.max("is_query").alias("is_query"), F.count(F.lit(1)).alias("n"))
        .withColumn("n", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")))).drop("n")
        .mapInArrow(_placed(centres, scale), f"vec_id long, vector {kind}, is_query boolean, cell int, apart double"), "points")
    radii, slices, others = np.full(len(centres), -np.inf), np.zeros(len(centres), np.int64), 0
    for row in placed.groupBy("cell").agg(F.max("apart").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # one row per cell
        if row["cell"] < 0:
            others = math.ceil(row["n"] / SHARD)
        else:
            radii[row["cell"]], slices[row["cell"]] = row["radius"], math.ceil(row["n"] / SHARD)
    radii[slices == 0] = 0.0
    cuts = F.broadcast(vectors.sparkSession.createDataFrame(
        [(-1, max(1, others)), *((n, max(1, int(x))) for n, x in enumerate(slices))], "cell int, slices int"))
    dealt = placed.join(cuts, "cell").withColumn("slice", F.pmod(F.xxhash64("vec_id", "vector"), F.col("slices")).cast("int"))
    asked = stored(dealt.where("is_query").withColumn("query_key", F.xxhash64("vector")).dropDuplicates(["vec_id", "query_key"])
                   .select(F.col("vec_id").alias("query_id"), "query_key", "vector", "cell", "slice"), "queries")
    shard = ["cell", "slice"]

    def hits(pairs: DataFrame) -> DataFrame:
        blocks = pairs.groupBy(*shard).agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
        held = (dealt.select("vec_id", "vector", *shard).join(blocks, shard)
                .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                .select(*(F.col(c).alias(c) for c in ("vec_id", "vector", *shard, "block"))))
        asks = pairs.join(blocks, shard).withColumn(
            "block", F.pmod(F.xxhash64("query_id", "query_key"), F.col("blocks")).cast("int"))
        return held.groupBy(*shard, "block").cogroup(asks.groupBy(*shard, "block")).applyInArrow(
            lambda p, q: _group(p, q, k, scale), _HIT)

    home = stored(hits(asked.withColumn("least", F.lit(None).cast("double"))), "home-hits")
    least = home.groupBy("query_id", "query_key").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    told = asked.join(least, ["query_id", "query_key"], "left").withColumn(
        "least", F.when(F.col("n") >= k, F.col("least").cast("double"))).drop("n")
    reached = stored(told.mapInArrow(_reached(centres, radii, slices, others, scale),
                                     f"query_id long, query_key long, vector {kind}, least double, cell int, slice int"), "asks")
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return (home.unionByName(hits(reached)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
