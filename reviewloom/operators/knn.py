"""Exact nearest vectors by inner product for a batch of queries.

Queries that fit ``QUERY_BYTES`` are broadcast, and one scan scores them as matrix products;
what leaves a task is its own top k per query. More queries are scanned in blocks of that size, unless a
sample shows that bounds leave most pairs out: then the vectors are divided into cells
(``cells``): each query visits cells from the highest bound down, a few more in each round, and
stops at its k-th score. Scores are rounded before they are ranked and ties go to the lower
``vec_id``, so the result does not depend on how the vectors are spread over tasks.

A vector takes part if it is there, not empty and all its components are finite numbers, and
meets the queries of its own length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewloom.fixed_values import SEARCH_K
from reviewloom.functions.vectors import SCORE_DECIMALS, matrix
from reviewloom.operators.cells import Divided, divide, share_reached
from reviewloom.session import stored

QUERY_BYTES = 64 * 1024 * 1024
#: From so many queries on, vectors are stored in even files before they are scanned.
EVEN_QUERIES = 16_384
#: The share of pairs that cells may leave to be scored; if more are left, a scan of all is faster.
CELLS_SHARE = 1 / 8
QUERY_TILE = 512
VECTOR_TILE = 2048
ROUNDING_MARGIN = 2 * 10.0 ** -SCORE_DECIMALS
#: Components up to here are multiplied in single precision first; what products of the smallest ones lose at most.
MOST_NARROW, TINY_MARGIN = 1e12, 1e-12
#: Bytes of queries, as doubles, that one task holds against a slice of neighbouring cells, and bytes of the vectors
#: in the slice; a ``SHARE``-th of all, but ``LEAST_ROWS``, if that is less.
ASK_BYTES, PART_BYTES, SHARE, LEAST_ROWS = 64 * 1024 * 1024, 32 * 1024 * 1024, 16, 4096
#: How many times more cells each round may visit, and the rows of a batch that leaves a task.
STEP, OUT_ROWS = 16, 4096
_HITS = "query_id long, vec_id long, score double"


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False).astype("int64")


def _places(meets: np.ndarray) -> np.ndarray:
    """Where the few true values of a table lie, counted row by row; eight are looked at together."""
    flat = np.ascontiguousarray(meets).ravel()
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64))
    near = (eights[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([near[flat[near]], whole + np.flatnonzero(flat[whole:])])


def _norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("nd,nd->n", rows, rows, dtype=float))


_NONE = (np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0))


class _TopK:
    """Running top k of each query over the vectors one task has seen.

    Products are first made in single precision. What may reach the k-th score by the bound of their error is
    made again in double precision, so only speed depends on it. ``floor`` is what a query's hits must reach.
    Products of a tile are written into the same room again and again, and hits wait until there are as many as
    are kept before the two are ranked together.
    """

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.floor = np.full(len(query_ids), -np.inf) if floor is None else floor
        self.narrow = queries.astype(np.float32, copy=False) if self._fits(queries) else None
        self.lengths = _norms(queries)
        self.tiles = [slice(s, s + QUERY_TILE) for s in range(0, len(query_ids), QUERY_TILE)]
        self.kept = [_NONE for _ in self.tiles]
        self.waiting: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in self.tiles]
        self.rooms: dict[type, np.ndarray] = {}

    @staticmethod
    def _fits(rows: np.ndarray) -> bool:
        """Whether products in single precision neither overflow nor lose what is small."""
        return not rows.size or max(rows.max(), -rows.min()) < MOST_NARROW

    def add(self, vec_ids: np.ndarray, vectors: np.ndarray) -> None:
        for start in range(0, len(vec_ids), VECTOR_TILE):
            piece = slice(start, start + VECTOR_TILE)
            narrow = self._narrow(vectors[piece])
            for number, tile in enumerate(self.tiles):
                self._add_tile(number, tile, vec_ids[piece], vectors[piece], narrow)

    def _narrow(self, vectors: np.ndarray) -> tuple[np.ndarray, float] | None:
        """The vectors in single precision, and the error of a product with a query of length 1 at most."""
        if self.narrow is None or not self._fits(vectors):
            return None
        error = (vectors.shape[1] + 4) * 2.0**-23 * _norms(vectors).max(initial=0)
        return vectors.astype(np.float32, copy=False), float(error)

    def _products(self, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        kind, shape = np.result_type(queries, vectors).type, (len(queries), len(vectors))
        room = self.rooms.get(kind)
        if room is None or room.size < shape[0] * shape[1]:
            room = self.rooms[kind] = np.empty(shape[0] * shape[1], kind)
        return np.matmul(queries, vectors.T, out=room[:shape[0] * shape[1]].reshape(shape))

    def _add_tile(self, number: int, tile: slice, vec_ids: np.ndarray, vectors: np.ndarray,
                  narrow: tuple[np.ndarray, float] | None, meets: np.ndarray | None = None,
                  place: np.ndarray | None = None) -> None:
        """``meets`` tells which places of vectors each query meets, all of them if it is None."""
        if narrow is None:
            scores, margin = self._products(self.queries[tile].astype(float, copy=False), vectors.astype(float, copy=False)), ROUNDING_MARGIN
        else:
            scores = self._products(self.narrow[tile], narrow[0])
            # a k-th score and a score that is compared with it may both be wrong
            margin = ROUNDING_MARGIN + 2 * narrow[1] * self.lengths[tile] + TINY_MARGIN
        if not scores.shape[1]:
            return
        cut = self.floor[tile]
        open_ = np.isneginf(cut)
        if unknown := open_.any() and scores.shape[1] > self.k:
            first = scores[open_]
            if meets is not None:
                first[~meets[open_][:, place]] = -np.inf
            cut = cut.copy()
            cut[open_] = np.partition(first, -self.k, axis=1)[:, -self.k]
        # the margin keeps every score that rounds up to the cut; only those kept are rounded
        low = cut - margin
        if narrow is not None:
            low = np.nextafter(low.astype(np.float32), np.float32(-np.inf))
        # a query's best product tells whether any other has to be looked at
        near = np.flatnonzero(scores.max(axis=1) >= low)
        if not len(near):
            return
        row, col = np.divmod(_places(scores[near] >= low[near, None]), scores.shape[1])
        row = near[row]
        if meets is not None:
            allowed = meets[row, place[col]]
            row, col = row[allowed], col[allowed]
        score = scores[row, col] if narrow is None else np.concatenate([np.empty(0), *(
            np.einsum("nd,nd->n", self.queries[tile][row[at:at + VECTOR_TILE]].astype(float, copy=False),
                      vectors[col[at:at + VECTOR_TILE]].astype(float, copy=False))
            for at in range(0, len(row), VECTOR_TILE))])
        score = np.round(score, SCORE_DECIMALS) + 0.0
        reach = score >= self.floor[tile][row]
        if reach.any():
            self.waiting[number].append((row[reach], vec_ids[col[reach]], score[reach]))
            if unknown or sum(len(w[0]) for w in self.waiting[number]) >= self.k * len(cut):
                self._rank(number)

    def _rank(self, number: int) -> None:
        row, ids, score = (np.concatenate(c) for c in zip(self.kept[number], *self.waiting[number]))
        self.waiting[number] = []
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        self.kept[number] = (row[keep], ids[keep], score[keep])
        full, start = rank == self.k - 1, self.tiles[number].start
        self.floor[start + row[full]] = np.maximum(self.floor[start + row[full]], score[full])

    def hits(self) -> pa.Table:
        for number in range(len(self.tiles)):
            self._rank(number)
        parts = [(self.query_ids[tile][row], ids, score) for tile, (row, ids, score) in zip(self.tiles, self.kept)]
        query, ids, score = (np.concatenate(p) for p in zip(*(parts or [_NONE])))
        return pa.table({"query_id": query, "vec_id": ids, "score": score})


def _components(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equally long vectors as a matrix; those of single precision keep it and are not copied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) and column.type.value_type == pa.float32():
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return matrix(column)


def _by_length(ids: pa.Array | pa.ChunkedArray, vectors: pa.Array | pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors of each length."""
    lengths = pc.list_value_length(vectors)
    kinds = pc.unique(lengths).to_pylist()
    if len(kinds) == 1:
        return {kinds[0]: (_ids(ids), _components(vectors))}
    return {n: (_ids(ids.filter(pc.equal(lengths, n))), _components(vectors.filter(pc.equal(lengths, n)))) for n in kinds}


def _even(vectors: DataFrame) -> DataFrame:
    """The vectors stored in as many files of one size as there are cores, so that tasks of a scan end together."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    return stored(vectors.select("vec_id", "embedding").repartition(cores), "vectors")


def _scan_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, Broadcast]:
    """Top k per query of each task, by one scan of all vectors, and the broadcast that it reads."""
    rows = queries.select("query_id", "embedding").toArrow()
    shared = vectors.sparkSession.sparkContext.broadcast(_by_length(rows["query_id"], rows["embedding"]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: _TopK(*queries, k) for n, queries in shared.value.items()}
        for batch in batches:
            for n, rows in _by_length(batch["vec_id"], batch["embedding"]).items():
                if n in best:
                    best[n].add(*rows)
        for found in best.values():
            yield from found.hits().to_batches()

    return vectors.select("vec_id", "embedding").mapInArrow(search, _HITS), shared


def _scan_blocks(vectors: DataFrame, queries: DataFrame, k: int, blocks: int) -> DataFrame:
    """Top k per query, by a scan of all vectors for each block of queries; what a block finds is ranked and stored."""
    asked = stored(queries.select("query_id", "embedding").repartition(blocks).withColumn("block", F.spark_partition_id()), "asked")
    found = None
    for block in range(blocks):
        hits, shared = _scan_top_k(vectors, asked.filter(F.col("block") == block), k)
        hits = stored(_ranked(hits, k).drop("rank"), "hits")
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    return found


class Found(NamedTuple):
    """Hits ranked per query, and how many pairs of query and vector were scored, of how many there are."""
    hits: DataFrame
    scored: int
    possible: int


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class _Parts(NamedTuple):
    """Cells side by side in parts of neighbours: ``order`` lists the cells by part, ``first`` tells where each
    part begins in it."""
    order: np.ndarray
    first: np.ndarray

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each cell its part and its place in the part."""
        ends = np.append(self.first[1:], len(self.order))
        part, place = np.empty(len(self.order), np.int64), np.empty(len(self.order), np.int64)
        part[self.order] = np.repeat(np.arange(len(self.first)), ends - self.first)
        place[self.order] = np.arange(len(self.order)) - np.repeat(self.first, ends - self.first)
        return part, place


def _parts(divided: Divided, part_rows: int) -> _Parts:
    """Parts of at most ``part_rows`` rows, or of a single cell; neighbours along the widest spread of the centres."""
    apart = divided.centres - divided.centres.mean(axis=0)
    widest = np.linalg.eigh(apart.T @ apart)[1][:, -1]
    order = np.argsort(apart @ widest, kind="stable")
    first, held = [0], 0
    for at, cell in enumerate(order):
        if at > first[-1] and held + divided.rows[cell] > part_rows:
            first.append(at)
            held = 0
        held += divided.rows[cell]
    return _Parts(order, np.array(first))


def _bounded(bytes_: int, length: int, rows: int) -> int:
    """Rows of vectors in so many bytes, but only a share of all."""
    return max(1, min(bytes_ // (8 * max(length, 1)), max(LEAST_ROWS, -(-rows // SHARE))))


def search_cells(divided: Divided, queries: DataFrame, k: int, ask_rows: int | None = None) -> Found:
    """The ``k`` best vectors of each query, cell by cell; all queries have the length of the vectors.

    In each round a query meets the next cells in order of its bounds, as long as they reach its k-th
    score so far; no query is left when a round asks for no cell. A query travels once a round to each part of
    neighbouring cells, with a bit for every cell in it that it meets. A part's rows are cut into slices and its
    queries into blocks of bounded size.
    """
    spark = queries.sparkSession
    asked = stored(queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding"), "asked")
    kind = asked.schema["embedding"].dataType.simpleString()
    total, filled = asked.count(), int((divided.rows > 0).sum())
    best, scored, first, last = spark.createDataFrame([], _HITS + ", rank int"), 0, 0, 1
    if not filled:
        return Found(best, 0, 0)
    length = divided.centres.shape[1]
    part_rows = _bounded(PART_BYTES, length, int(divided.rows.sum()))
    ask_rows = ask_rows or _bounded(ASK_BYTES, length, total)
    parts = _parts(divided, part_rows)
    part_of, place_of = parts.places()
    held = np.bincount(part_of, divided.rows, len(parts.first))
    shared = spark.sparkContext.broadcast((divided.centres, divided.radii, divided.rows, parts))

    def next_cells(first: int, last: int):
        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            *cells, parts = shared.value
            cells = Divided(None, *cells)
            ends = np.append(parts.first[1:], len(parts.order))
            for batch in batches:
                for at in range(0, len(batch), QUERY_TILE):
                    tile = batch.slice(at, QUERY_TILE)
                    bound = cells.bounds(matrix(tile.column(1)))
                    order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                    floor = tile.column(2).to_numpy(zero_copy_only=False)
                    reach = np.take_along_axis(bound, order, axis=1) >= np.nan_to_num(floor, nan=-np.inf)[:, None] - ROUNDING_MARGIN
                    meets = np.zeros(bound.shape, bool)
                    np.put_along_axis(meets, order, reach & (cells.rows[order] > 0), axis=1)
                    meets = meets[:, parts.order]
                    row, part = np.nonzero(np.logical_or.reduceat(meets, parts.first, axis=1))
                    rows = np.add.reduceat(meets * cells.rows[parts.order], parts.first, axis=1)[row, part]
                    bits = [np.packbits(meets[:, a:b], axis=1) for a, b in zip(parts.first, ends)]
                    for begin in range(0, len(row), OUT_ROWS):  # whole vectors go out, so a few at a time
                        here = slice(begin, begin + OUT_ROWS)
                        chosen = pa.array(row[here])
                        yield pa.record_batch(
                            [tile.column(0).take(chosen), tile.column(1).take(chosen), tile.column(2).take(chosen), pa.array(part[here].astype(np.int32)),
                             pa.array([bits[p][r].tobytes() for r, p in zip(row[here], part[here])], pa.binary()), pa.array(rows[here])],
                            names=["query_id", "embedding", "floor", "part", "cells", "rows"])
        return choose

    def score(points: pa.Table, asks: pa.Table) -> pa.Table:
        if not len(points) or not len(asks):
            return _TopK(np.empty(0, "int64"), np.empty((0, 1)), k).hits()
        bits = np.frombuffer(b"".join(asks["cells"].to_pylist()), np.uint8).reshape(len(asks), -1)
        alike = np.lexsort(bits.T[::-1])  # queries that meet the same cells side by side
        bits = bits[alike]
        floor = np.nan_to_num(asks["floor"].to_numpy().astype(float), nan=-np.inf, neginf=-np.inf)[alike]
        best = _TopK(_ids(asks["query_id"])[alike], _components(asks["embedding"])[alike], k, floor)
        place, vec_ids, vectors = _ids(points["place"]), _ids(points["vec_id"]), _components(points["embedding"])
        for number, tile in enumerate(best.tiles):
            meets = np.unpackbits(bits[tile], axis=1).view(bool)
            some = meets.any(axis=0)
            every = meets[:, some].all()
            chosen = np.flatnonzero(some[place])
            for start in range(0, len(chosen), VECTOR_TILE):
                piece = chosen[start:start + VECTOR_TILE]
                rows = vectors[piece]
                best._add_tile(number, tile, vec_ids[piece], rows, best._narrow(rows), None if every else meets, place[piece])
        return best.hits()

    while first < filled:
        floors = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        pairs = stored(asked.join(floors, "query_id", "left").select("query_id", "embedding", "floor").mapInArrow(
            next_cells(first, last), f"query_id long, embedding {kind}, floor double, part int, cells binary, rows long"), "asks")
        asks = pairs.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")).collect()  # one row per part at most
        if not asks:
            break
        cut = {r["part"]: (int(-(-held[r["part"]] // part_rows)), -(-r["n"] // ask_rows)) for r in asks}
        cuts = F.broadcast(spark.createDataFrame(
            [(int(c), int(p), int(at), *cut[p]) for c, (p, at) in enumerate(zip(part_of, place_of)) if p in cut],
            "cell int, part int, place int, slices int, blocks int"))
        part_cuts = F.broadcast(spark.createDataFrame([(p, *c) for p, c in cut.items()], "part int, slices int, blocks int"))
        points = divided.points.join(cuts, "cell").select(
            "vec_id", "embedding", "part", "place", F.pmod(F.xxhash64("vec_id"), "slices").cast("int").alias("slice"),
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        blocks = pairs.join(part_cuts, "part").select(
            "query_id", "embedding", "floor", "cells", "part", F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"),
            F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        key = ["part", "slice", "block"]
        hits = points.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInArrow(score, _HITS)
        best = stored(_ranked(best.drop("rank").unionByName(hits), k), "best")
        scored += sum(r["rows"] for r in asks)
        first, last = last, last * STEP
    return Found(best, scored, total * int(divided.rows.sum()))


def _is_usable() -> Column:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & (F.size("embedding") > 0), F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """The rows whose vector is there, whole and finite."""
    return vectors.filter(_is_usable())


def unusable(vectors: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """How many rows have no usable vector or, with ``queries``, none of the length of any query."""
    if queries is None:
        return vectors.agg(F.count(F.when(~_is_usable(), 1)).alias("unusable"))
    lengths = usable(queries).select(F.size("embedding").alias("length")).distinct().withColumn("asked", F.lit(True))
    sized = vectors.select(F.when(_is_usable(), F.size("embedding")).alias("length"))
    return sized.join(lengths, "length", "left").agg(F.count(F.when(F.col("asked").isNull(), 1)).alias("unusable"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = SEARCH_K, skip_self: bool = False,
            broadcast_bytes: int = QUERY_BYTES) -> DataFrame:
    """``query_id, vec_id, score, rank`` of the k best vectors of each query.

    ``skip_self`` leaves out the vector whose id equals the query's. Queries above
    ``broadcast_bytes`` are searched in blocks of that size, or cell by cell; with 0 always
    cell by cell. Vectors that are not usable take no
    part, nor do those of a length that no query has; ``unusable`` counts them.
    """
    vectors, queries = usable(vectors), usable(queries)
    fetched = k + 1 if skip_self else k
    asked = {r["n"]: r["rows"] for r in queries.groupBy(F.size("embedding").alias("n")).agg(
        F.count(F.lit(1)).alias("rows")).orderBy("n").collect()}  # one length, as a rule
    if broadcast_bytes and sum(8 * n * rows for n, rows in asked.items()) <= broadcast_bytes:
        found, _ = _scan_top_k(_even(vectors) if sum(asked.values()) >= EVEN_QUERIES else vectors, queries, fetched)
    else:
        found = vectors.sparkSession.createDataFrame([], _HITS)
        for n, rows in asked.items():
            own = F.size("embedding") == n
            found = found.unionByName(_search_many(vectors.filter(own), queries.filter(own), n, rows, fetched, broadcast_bytes))
    return _ranked(found.filter(F.col("query_id") != F.col("vec_id")) if skip_self else found, k)


def _search_many(vectors: DataFrame, queries: DataFrame, length: int, rows: int, k: int, broadcast_bytes: int) -> DataFrame:
    if broadcast_bytes:
        even = _even(vectors)
        if share_reached(even, queries, length, k) > CELLS_SHARE:
            return _scan_blocks(even, queries, k, -(-8 * length * rows // broadcast_bytes))
    return search_cells(divide(vectors, length), queries, k).hits.drop("rank")
