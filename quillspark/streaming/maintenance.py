"""Incremental upkeep with Structured Streaming."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quillspark.operators.vectors import Embedder, ProviderError, embedded, needing_vectors

#: Seconds after the first, second and third failure of a job until it is tried again.
WAITS = (5.0, 15.0, 30.0)
#: What ``document_jobs`` returns: a vector, or, without a chunk, how a job ended.
JOBS = "document_id long, document_version int, chunk_id long, content_hash string, embedding array<double>, attempt int, error string"


def maintain_vectors(changes: DataFrame, chunks: Callable[[], DataFrame], vectors: Callable[[], DataFrame], append: Callable[[DataFrame], None], embedder: Embedder, space: tuple[str, str, int], checkpoint: str, **trigger):
    """Keep vectors current from a stream of changed documents (document_id).

    A micro-batch takes each document once, however often it changed, and embeds only
    its chunks without a current vector, read when the batch runs; what changes while a
    batch runs is the next batch's. Replaying a batch finds nothing left to do, so the
    sink need not be transactional. A failed batch is retried by the query's restart.
    Returns the started query.
    """

    def batch(rows: DataFrame, _: int) -> None:
        touched = rows.select("document_id").dropDuplicates()
        todo = needing_vectors(chunks().join(touched, "document_id", "left_semi"), vectors(), space)
        append(embedded(todo, embedder, space))

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class DocumentJobs(StatefulProcessor):
    """The embedding job of one document: what it has to embed, how often that has failed,
    and whether the document has changed since the job began."""

    def __init__(self, embedder: Embedder, waits: tuple[float, ...] = WAITS, batch: int = 16):
        self.embedder, self.waits, self.batch = embedder, waits, batch

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "version int, failures int, again boolean")
        self.chunks = handle.getListState("chunks", "version int, chunk_id long, content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        version = int(new["document_version"].max())
        new = new[new["document_version"] == version].drop_duplicates("chunk_id", keep="last")
        job = self.job.get() if self.job.exists() else None
        if job and version < job[0]:
            return  # a late row of a version that a job for a later one is waiting with
        old = [] if not job or version > job[0] else [c for c in self.chunks.get() if c[1] not in set(new["chunk_id"])]
        held = [*[tuple(c) for c in old], *((version, int(i), c) for i, c in zip(new["chunk_id"], new["content"], strict=True))]
        self.chunks.put(held)
        if job:  # it waits for its next attempt, which takes the newest chunks; one more is remembered
            self.job.update((version, job[1], True))
            return
        yield from self.attempt(key[0], held, 0, False, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.job.exists():
            _, failures, again = self.job.get()
            yield from self.attempt(key[0], [tuple(c) for c in self.chunks.get()], failures, again, timerValues)

    def attempt(self, document: int, held: list[tuple], failures: int, again: bool, timerValues) -> Iterator[pd.DataFrame]:
        """Try the job; a failure that may pass sets a timer, another ends it. A job that
        ends without success begins anew, once, if the document changed meanwhile."""
        version, texts = held[0][0], [c or "" for _, _, c in held]
        try:
            vectors = [v for a in range(0, len(texts), self.batch) for v in np.asarray(self.embedder(texts[a : a + self.batch]), float).tolist()]
            if len(vectors) != len(texts) or len({len(v) for v in vectors}) > 1 or not np.isfinite(vectors).all():
                raise ValueError("the provider's vectors are not as many, as long or as finite as asked for")
        except Exception as failure:  # noqa: BLE001  whatever a provider raises ends this job only
            passing = getattr(failure, "retryable", isinstance(failure, (ProviderError, TimeoutError)))
            if passing and failures < len(self.waits):
                self.job.update((version, failures + 1, again))
                self.handle.registerTimer(int(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.waits[failures]))
                return
            yield pd.DataFrame([(document, version, None, None, None, failures + 1, f"{type(failure).__name__}: {failure}")], columns=[f.split()[0] for f in JOBS.split(", ")]).astype({"chunk_id": "Int64"})
            if again:
                yield from self.attempt(document, held, 0, False, timerValues)
                return
        else:
            rows = [(document, version, i, hashlib.sha256((c or "").encode()).hexdigest(), v, failures + 1, None) for (_, i, c), v in zip(held, vectors, strict=True)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in JOBS.split(", ")])
        self.job.clear()
        self.chunks.clear()

    def close(self) -> None:
        pass


def document_jobs(changes: DataFrame, embedder: Embedder, waits: tuple[float, ...] = WAITS, batch: int = 16) -> DataFrame:
    """Vectors of changed documents as a stream (Y1), one job a document.

    ``changes`` (document_id, document_version, chunk_id, content): all chunks of a version,
    in one micro-batch or several. A job embeds the newest version's chunks. It is tried
    again ``waits`` seconds after a failure that may pass, by timers, so no task sleeps;
    what arrives meanwhile joins the waiting job, and if that gives up, one more is begun
    for it. State is the job's chunks while it waits, and nothing once it has ended; it
    survives restarts. The session's state store must be RocksDB
    (``spark.sql.streaming.stateStore.providerClass``).

    Rows of ``JOBS``: a vector a chunk, or a row with ``error`` for a job that failed for
    good. Writers keep vectors of the current version only (``sinks.of_current_versions``).
    """
    return changes.select("document_id", F.col("document_version").cast("int").alias("document_version"), F.col("chunk_id").cast("long").alias("chunk_id"), "content").groupBy("document_id").transformWithStateInPandas(statefulProcessor=DocumentJobs(embedder, waits, batch), outputStructType=JOBS, outputMode="Update", timeMode="ProcessingTime")


def backfill(chunks: DataFrame, vectors: DataFrame, embedder: Embedder, space: tuple[str, str, int]) -> DataFrame:
    """Vectors of all chunks that lack a current one, as one batch job (Y2)."""
    return embedded(needing_vectors(chunks, vectors, space), embedder, space)


def daily_searches(logs: DataFrame, late: str = "1 day") -> DataFrame:
    """Searches a day over a stream of logs (ts timestamp, query); state of days older
    than the watermark is dropped (Y3)."""
    return logs.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("value")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "value")
