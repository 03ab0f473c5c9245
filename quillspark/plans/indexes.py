"""Indexes of the given tables, built once for a session and a state of their files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillspark.operators.index import Index
from quillspark.operators.nearest import VectorIndex
from quillspark.sources import tables
from quillspark.sources.store import Store

_BUILT: dict[tuple, Index | VectorIndex] = {}


def files_of(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and times of the files at ``path``, as the driver's file system tells them."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in store.listStatus(target)))


def _once(spark: SparkSession, sf_dir: str, table: str, build: Callable[[Store], Index | VectorIndex]) -> Index | VectorIndex:
    """What ``build`` makes of a table, in the shared folder. Another state of the table's
    files, or another session, has an index of its own."""
    path = f"{sf_dir}/{table}.parquet"
    key = (spark.sparkContext.applicationId, path, files_of(spark, path))
    if key not in _BUILT:
        _BUILT[key] = build(Store(spark, tables.own_folder(spark)))
    return _BUILT[key]


def line_index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of all line chunks of ``documents``."""

    def build(store: Store) -> Index:
        index = Index(store)
        index.update(tables.line_chunks(spark, sf_dir))
        return index.pinned()

    return _once(spark, sf_dir, "documents", build)


def vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The index of all vectors of ``embeddings``."""
    vectors = tables.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return _once(spark, sf_dir, "embeddings", lambda store: VectorIndex(store).build(vectors))
