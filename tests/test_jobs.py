"""Embedding jobs as a stateful stream: retries by timers, and changes while a job waits."""

import time
from pathlib import Path

import numpy as np
import pytest

from quillspark.operators.vectors import ProviderError
from quillspark.streaming.maintenance import document_jobs

KIND = "document_id long, document_version int, chunk_id long, content string"


def provider(folder, failures):
    """Fails ``failures`` times for each kind of text, as it is told to."""

    def embed(texts):
        for name, kind in failures.items():
            if any(name in t for t in texts):
                calls = Path(folder) / name
                n = len(calls.read_text()) if calls.exists() else 0
                calls.write_text("x" * (n + 1))
                if n < kind[0]:
                    raise kind[1]
        return np.array([[len(t), 1.0] for t in texts])

    return embed


@pytest.fixture
def stream(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    (tmp_path / "calls").mkdir()
    started = []

    def start(failures, waits):
        changes = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
        out = document_jobs(changes, provider(str(tmp_path / "calls"), failures), waits)
        name = f"jobs_{len(started)}_{time.time_ns()}"
        q = out.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="200 milliseconds").start()
        started.append(q)
        return q, lambda: spark.table(name).collect()

    def put(*rows):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    yield start, put, tmp_path / "calls"
    for q in started:
        q.stop()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def until(query, read, enough, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if query.exception():
            raise query.exception()
        rows = read()
        if enough(rows):
            return rows
        time.sleep(0.3)
    raise AssertionError(f"not in time: {read()}")


def test_retries_and_changes(stream):
    start, put, calls = stream
    failures = {"flaky": (2, ProviderError("busy", 503)), "broken": (99, ProviderError("no", 400)), "down": (99, TimeoutError("late"))}
    q, read = start(failures, (0.5, 8.0, 0.5))
    put((1, 1, 10, "fine"), (1, 1, 11, None), (2, 1, 20, "flaky one"), (3, 1, 30, "broken"), (4, 1, 40, "down"))
    until(q, read, lambda rows: any(r.document_id == 3 for r in rows) and len([r for r in rows if r.document_id == 1]) == 2)
    until(q, read, lambda rows: (calls / "flaky").exists() and len((calls / "flaky").read_text()) >= 2)
    put((2, 2, 21, "a flaky newer version"), (2, 2, 22, "and more"))  # while the job waits for its third attempt
    rows = until(q, read, lambda rows: {r.document_id for r in rows} == {1, 2, 3, 4})
    of = lambda d: sorted((r.document_version, r.chunk_id, r.attempt, r.error) for r in rows if r.document_id == d)
    assert of(1) == [(1, 10, 1, None), (1, 11, 1, None)]
    assert of(2) == [(2, 21, 3, None), (2, 22, 3, None)]  # the third attempt embeds what is current by then
    assert of(3) == [(1, None, 1, "ProviderError: no")]
    assert of(4) == [(1, None, 4, "TimeoutError: late")] and len((calls / "down").read_text()) == 4
    assert [r.embedding for r in rows if r.chunk_id == 10] == [[4.0, 1.0]]
    put((2, 3, 21, "later still"), (2, 2, 22, "an old row"))
    rows = until(q, read, lambda rows: any(r.document_version == 3 for r in rows))
    assert [(r.chunk_id, r.attempt) for r in rows if r.document_version == 3] == [(21, 1)]


def test_a_changed_document_gets_one_more_job(stream):
    start, put, calls = stream
    q, read = start({"stuck": (4, ProviderError("busy", 429))}, (6.0, 0.2, 0.2))
    put((7, 1, 70, "stuck"))
    until(q, read, lambda rows: (calls / "stuck").exists())
    put((7, 2, 71, "stuck still"))
    rows = until(q, read, lambda rows: any(r.chunk_id == 71 for r in rows))
    assert sorted((r.document_version, r.chunk_id or 0, r.attempt) for r in rows) == [(2, 0, 4), (2, 71, 1)]
