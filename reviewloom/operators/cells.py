"""Vectors divided into cells around centres, for exact search that can leave cells out.

A cell has a centre and a radius, so a query's inner product with any of its vectors is at most
that with the centre plus the query's length times the radius. A query visits the cells
from the highest bound down and stops at the first one whose bound is below its k-th score.
Centres come from a bounded sample and decide only how much is left out, never
the result. There are at most ``MOST_CELLS``; a cell with many rows is searched in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewloom.functions.vectors import matrix
from reviewloom.session import stored

CELL_ROWS, MOST_CELLS = 4_096, 4_096
#: Sampled vectors per centre, and bytes of the sample at most.
SAMPLE_ROWS, SAMPLE_BYTES = 16, 64 * 1024 * 1024
#: Vectors and queries that tell how much the bounds leave out.
PROBE_ROWS, PROBE_QUERIES = 16_384, 256
_ROOM = 1e-9


class Divided(NamedTuple):
    """``points`` (vec_id, embedding, cell) and, by cell, centres, radii and numbers of rows."""
    points: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    rows: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the inner products of each query with each cell, with room for rounding."""
        lengths = np.sqrt((queries**2).sum(axis=1))
        reach = self.radii + _ROOM * (self.radii + np.sqrt((self.centres**2).sum(axis=1)))
        found = queries @ self.centres.T + lengths[:, None] * reach[None, :]
        found[:, self.rows == 0] = -np.inf
        return found


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre that is nearest to each point."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - points[at:at + 4096] @ centres.T, axis=1)
                           for at in range(0, len(points), 4096)] or [np.zeros(0, np.int64)])


def _drawn(rows: DataFrame, key: str, size: int) -> np.ndarray:
    """A sample of vectors, drawn by a hash."""
    drawn = rows.select("embedding", F.xxhash64(key, F.lit(1)).alias("draw")).orderBy("draw").limit(size)
    return matrix(drawn.select("embedding").toArrow()["embedding"])


def _means(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Means of the parts of a sample."""
    centres = sample[:wanted].copy()
    for _ in range(3):
        home = _nearest(sample, centres)
        counts = np.bincount(home, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _centres(vectors: DataFrame, rows: int, length: int, cell_rows: int) -> np.ndarray:
    wanted = max(1, min(MOST_CELLS, -(-rows // cell_rows)))
    size = max(wanted, min(wanted * SAMPLE_ROWS, SAMPLE_BYTES // (8 * length)))
    return _means(_drawn(vectors, "vec_id", size), wanted)


def share_reached(vectors: DataFrame, queries: DataFrame, length: int, k: int) -> float:
    """About which share of all pairs the bounds of cells leave, by a sample of usable vectors and queries of one length."""
    rows = vectors.count()
    sample = _drawn(vectors, "vec_id", max(1, min(PROBE_ROWS, SAMPLE_BYTES // (8 * length))))
    asked = _drawn(queries, "query_id", PROBE_QUERIES)
    if not len(sample) or not len(asked):
        return 1.0
    centres = _means(sample, max(1, min(MOST_CELLS, -(-rows // CELL_ROWS), len(sample) // SAMPLE_ROWS)))
    home = _nearest(sample, centres)
    radii, held = np.zeros(len(centres)), np.bincount(home, minlength=len(centres))
    np.maximum.at(radii, home, np.sqrt(((sample - centres[home])**2).sum(axis=1)))
    rank = min(len(sample), max(1, k * len(sample) // rows))
    best = np.partition(asked @ sample.T, -rank, axis=1)[:, -rank]
    reached = Divided(vectors, centres, radii, held).bounds(asked) >= best[:, None]
    return float((reached * held).sum() / (len(sample) * len(asked)))


def divide(vectors: DataFrame, length: int, cell_rows: int = CELL_ROWS, path: str | None = None) -> Divided:
    """Divide usable vectors of one length; each cell's rows lie together in the stored table, or in ``path``."""
    spark = vectors.sparkSession
    narrow = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = narrow.count()
    if not rows:
        return Divided(narrow.withColumn("cell", F.lit(0)), *(np.zeros((0, length)), np.zeros(0), np.zeros(0, np.int64)))
    centres = _centres(narrow, rows, length, cell_rows)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column(1))
            home = _nearest(points, centres)
            apart = np.sqrt(((points - centres[home])**2).sum(axis=1))
            yield pa.record_batch([*batch.columns, pa.array(home.astype(np.int32)), pa.array(apart)],
                                  names=["vec_id", "embedding", "cell", "apart"])

    kind = narrow.schema["embedding"].dataType.simpleString()
    placed = narrow.mapInArrow(assign, f"vec_id long, embedding {kind}, cell int, apart double")
    by_cell = placed.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id")
    if path:
        by_cell.write.parquet(path)
        return load(spark, path, centres)
    return _measured(stored(by_cell, "cells"), centres)


def _measured(points: DataFrame, centres: np.ndarray) -> Divided:
    radii, rows = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for cell in points.groupBy("cell").agg(F.max("apart").alias("radius"), F.count(F.lit(1)).alias("rows")).collect():
        radii[cell.cell], rows[cell.cell] = cell.radius, cell.rows
    return Divided(points.drop("apart"), centres, radii, rows)


def write(vectors: DataFrame, length: int, path: str, cell_rows: int = CELL_ROWS) -> None:
    """Store vectors by cell, and the centres beside them."""
    divided = divide(vectors, length, cell_rows, f"{path}/points")
    spark = vectors.sparkSession
    spark.createDataFrame([(n, c.tolist()) for n, c in enumerate(divided.centres)], "cell int, centre array<double>").coalesce(1).write.parquet(
        f"{path}/centres")


def load(spark: SparkSession, path: str, centres: np.ndarray | None = None) -> Divided:
    """Vectors stored by cell; radii and counts are read from the rows, so they always fit them."""
    if centres is None:
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").toArrow()
        return _measured(spark.read.parquet(f"{path}/points"), matrix(rows["centre"]))
    return _measured(spark.read.parquet(path), centres)
