"""Exact percentiles by narrowing histograms."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import audit


@pytest.fixture(scope="module")
def latencies(spark):
    rnd = random.Random(9)
    rows = [("long tail", 10 ** rnd.uniform(-3, 6)) for _ in range(3000)]
    rows += [("one value", 7.5)] * 500 + [("two", float(i % 2)) for i in range(100)] + [("close", 1e9 + i * 1e-6) for i in range(300)]
    rows += [("negative", -(10 ** rnd.uniform(-9, 9))) for _ in range(200)] + [("single", 3.0), ("none", None), ("not a number", float("nan"))]
    rows += [("mostly small", 1.0 + rnd.random() * 1e-9) for _ in range(5000)] + [("mostly small", 1e12)]
    return rows


@pytest.mark.parametrize(("p", "buckets"), [(0.95, 256), (0.5, 2), (0.0, 16), (1.0, 256)])
def test_selected(spark, latencies, p, buckets):
    got = {r.key: r.value for r in audit.selected(spark.createDataFrame(latencies, "key string, x double"), p, buckets).collect()}
    want = {}
    for key in {k for k, _ in latencies}:
        xs = sorted(x for k, x in latencies if k == key and x is not None and x == x)
        if xs:
            want[key] = xs[min(len(xs) - 1, int(len(xs) * p))]
    assert got == want


def test_report(spark, latencies):
    df = spark.createDataFrame(latencies, "endpoint string, ms double").withColumn("ok", F.col("ms") > 0)
    got = {r.endpoint: r for r in audit.latency_report(df, 10.0).collect()}
    assert len(got) == len({k for k, _ in latencies}) and got["none"].p95 is None and got["none"].requests == 1
    assert got["one value"].p95 == 7.5 and got["one value"].per_second == 50.0


def test_nothing(spark):
    assert audit.selected(spark.createDataFrame([], "key string, x double"), 0.5).count() == 0
