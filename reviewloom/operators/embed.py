"""Text to vectors, in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

HASH_DIM = 64


@lru_cache(maxsize=200_000)
def _slot(token: str, dim: int) -> tuple[int, int]:
    digest = hashlib.md5(token.encode("utf-8")).hexdigest()
    return int(digest[:8], 16) % dim, 1 if int(digest[8], 16) % 2 == 0 else -1


def hashed_features(texts: list[str], dim: int = HASH_DIM) -> np.ndarray:
    """Signed token counts in ``dim`` slots: the offline stand-in for an embedding model."""
    out = np.zeros((len(texts), dim), dtype="float32")
    split = [(text or "").lower().split() for text in texts]
    tokens = pa.array(chain.from_iterable(split), pa.string()).dictionary_encode()
    if not len(tokens):
        return out
    slots, signs = np.array([_slot(token, dim) for token in tokens.dictionary.to_pylist()]).T
    rows, codes = np.repeat(np.arange(len(split)), [len(s) for s in split]), tokens.indices.to_numpy()
    np.add.at(out, (rows, slots[codes]), signs[codes])
    return out


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """L2-normalised rows; a zero row stays zero."""
    wide = vectors.astype("float64")
    norms = np.sqrt((wide * wide).sum(axis=1, keepdims=True))
    return np.divide(wide, norms, out=np.zeros_like(wide), where=norms > 0).astype("float32")


def embed(df: DataFrame, text_col: str,
          make_embedder: Callable[[], Callable[[list[str]], np.ndarray]] = lambda: hashed_features,
          name: str = "embedding") -> DataFrame:
    """Add a unit-length vector for ``text_col``.

    ``make_embedder`` runs once per task, so a model is loaded once and not per
    batch; the function it returns takes a list of texts and gives a matrix.
    """
    schema = T.StructType([f for f in df.schema.fields if f.name != name]
                          + [T.StructField(name, T.ArrayType(T.FloatType()))])
    columns = [f.name for f in schema.fields if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = make_embedder()
        for batch in batches:
            if not len(batch):
                continue
            texts = [text or "" for text in batch[text_col].to_pylist()]
            vectors = unit_rows(np.asarray(embedder(texts), dtype="float32"))
            ends = np.arange(len(batch) + 1, dtype="int32") * vectors.shape[1]
            lists = pa.ListArray.from_arrays(ends, vectors.ravel())
            yield pa.RecordBatch.from_arrays([batch[c] for c in columns] + [lists], [*columns, name])

    return df.mapInArrow(run, schema)
