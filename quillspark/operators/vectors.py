"""Embedding maintenance (J3, J8, A8, Y2, the provider interface of §2.12)."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]


@cache
def ascii_hashes() -> np.ndarray:
    """The CRC-32 of all stretches of three ASCII characters, by their 21 bits."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    code, crc = np.arange(1 << 21, dtype=np.uint32), np.full(1 << 21, 0xFFFFFFFF, np.uint32)
    for shift in (14, 7, 0):
        crc = table[(crc ^ (code >> shift & 127)) & 255] ^ crc >> 8
    return ~crc


def trigram_hashes(text: str) -> np.ndarray:
    """The CRC-32 of each stretch of three characters of a text; of all of a shorter one."""
    if len(text) < 3:
        return np.array([zlib.crc32(text.encode())], np.uint32)
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    a, b, c = c[:-2], c[1:-1], c[2:]
    wide = np.flatnonzero((a | b | c) > 127)
    out = ascii_hashes()[(a & 127) << 14 | (b & 127) << 7 | c & 127]
    if len(wide):
        out[wide] = [zlib.crc32(text[i : i + 3].encode()) for i in wide.tolist()]
    return out


def hashing_embedder(dims: int = 64) -> Embedder:
    """Signed feature hashing of character trigrams, unit length: deterministic, offline."""

    def embed(texts: list[str]) -> np.ndarray:
        found = [trigram_hashes(t) for t in texts]
        h = np.concatenate(found) if found else np.zeros(0, np.uint32)
        row = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        out = np.bincount(row * dims + h % dims, np.where(h >> 16 & 1, 1.0, -1.0), len(texts) * dims).reshape(len(texts), dims)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return embed


class ProviderError(Exception):
    """A provider's failure; ``retryable`` for limits (429), its own errors (5xx) and timeouts."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.retryable = status is None or status == 429 or status >= 500


def retrying(embedder: Embedder, waits: tuple[float, ...] = (5, 15, 30), sleep: Callable[[float], None] = time.sleep) -> Embedder:
    """``embedder`` called again after each of ``waits`` seconds while it fails in a way
    that may pass (``ProviderError``, ``TimeoutError``); other failures are the task's."""

    def embed(texts: list[str]) -> np.ndarray:
        for wait in waits:
            try:
                return embedder(texts)
            except (ProviderError, TimeoutError) as failure:
                if not getattr(failure, "retryable", True):
                    raise
                sleep(wait)
        return embedder(texts)

    return embed


def content_hash(c: str = "content"):
    return F.sha2(F.coalesce(F.col(c), F.lit("")).cast("binary"), 256)


def needing_vectors(chunks: DataFrame, vectors: DataFrame, space: tuple[str, str, int]) -> DataFrame:
    """Chunks without a current vector in the space (provider, model, generation): none,
    of another version, marked stale, or of other content (J3)."""
    provider, model, generation = space
    v = vectors.where((F.col("provider") == provider) & (F.col("model") == model) & (F.col("generation") == generation))
    v = v.select("chunk_id", F.col("document_version").alias("__v"), F.col("stale").alias("__stale"), F.col("content_hash").alias("__h"))
    fresh = (F.col("__v") == F.col("document_version")) & (F.col("__stale") == 0) & (F.col("__h") == content_hash())
    return chunks.join(v, "chunk_id", "left").where(~F.coalesce(fresh, F.lit(False))).drop("__v", "__stale", "__h")


def embedded(chunks: DataFrame, embedder: Embedder, space: tuple[str, str, int], batch: int = 16) -> DataFrame:
    """Vectors of chunks (chunk_id, document_version, content), ``batch`` (1 to 64) texts a
    call. A provider that returns another number of vectors, other lengths or numbers that
    are not finite fails the task; Spark's retries take the place of the queue's."""
    if not 1 <= batch <= 64:
        raise ValueError("batch is 1 to 64")
    provider, model, generation = space

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dims = None
        for b in batches:
            parts = []
            for a in range(0, len(b), batch):
                texts = [t or "" for t in b["content"].iloc[a : a + batch]]
                got = np.asarray(embedder(texts), float)
                dims = got.shape[1] if dims is None and got.ndim == 2 else dims
                if got.shape != (len(texts), dims) or not np.isfinite(got).all():
                    raise ValueError("the provider's vectors are not as many, as long or as finite as asked for")
                parts.append(got)
            if parts:
                yield pd.DataFrame({"chunk_id": b["chunk_id"].to_numpy(), "document_version": b["document_version"].to_numpy(), "content_hash": b["content_hash"].to_numpy(), "embedding": list(np.concatenate(parts))})

    source = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("document_version").cast("int").alias("document_version"), content_hash().alias("content_hash"), "content")
    out = source.mapInPandas(run, "chunk_id long, document_version int, content_hash string, embedding array<double>")
    return out.withColumns({"provider": F.lit(provider), "model": F.lit(model), "generation": F.lit(generation), "stale": F.lit(0)})


def replaced(vectors: DataFrame, fresh: DataFrame, chunks: DataFrame) -> DataFrame:
    """The vector table after an update: new vectors whose chunk is still of their version
    replace those of their key (chunk, provider, model, generation) (J8)."""
    key = ["chunk_id", "provider", "model", "generation"]
    current = fresh.join(chunks.select("chunk_id", "document_version"), ["chunk_id", "document_version"], "left_semi").select(*vectors.columns)
    return vectors.join(current.select(*key), key, "left_anti").unionByName(current)


def snapshot(chunks: DataFrame) -> DataFrame:
    """A digest of what a rebuild reads, to compare before it is switched to: the number
    of chunks and the sum of their hashes (order does not matter)."""
    h = F.xxhash64("chunk_id", "document_version", content_hash())
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("digest"))


def rebuilt(chunks: DataFrame, embedder: Embedder, space: tuple[str, str, int], store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A full rebuild: all vectors are made and stored, and count only if the chunks did
    not change meanwhile."""
    before = snapshot(chunks).first()
    made = store(embedded(chunks, embedder, space))
    if snapshot(chunks).first() != before:
        raise RuntimeError("the chunks changed during the rebuild")
    return made


def active_vectors(vectors: DataFrame, chunks: DataFrame, space: tuple[str, str, int]) -> DataFrame:
    """Vectors that search may use: of the space, current and not stale."""
    provider, model, generation = space
    v = vectors.where((F.col("provider") == provider) & (F.col("model") == model) & (F.col("generation") == generation) & (F.col("stale") == 0))
    return v.join(chunks.select("chunk_id", "document_version"), ["chunk_id", "document_version"], "left_semi")
