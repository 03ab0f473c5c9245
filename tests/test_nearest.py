"""The vector index against all cosines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import nearest
from quillspark.operators import retrieval as R
from quillspark.operators.nearest import VectorIndex, fitted, unit
from quillspark.sources.store import Store

KIND = "chunk_id long, embedding array<float>"


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters of which one holds a third of all, copies, and vectors that are near nothing."""
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(30, 16))
    x = middle[rng.integers(0, 30, 1500)] + 0.35 * rng.normal(size=(1500, 16))
    x[:500] = middle[3] + 0.05 * rng.normal(size=(500, 16))
    x[500:560] = x[0]
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0, None] * 8), (2004, [float("nan")] * 16), (2005, [1.0, 2.0]), (2006, [2.0, 4.0])]
    return spark.createDataFrame(rows, KIND).repartition(3)


@pytest.fixture(scope="module")
def index(vectors, spark, tmp_path_factory):
    return VectorIndex(Store(spark, f"file://{tmp_path_factory.mktemp('vectors')}/v")).build(vectors)


def asked(vectors, step=20):
    return vectors.where(f"chunk_id % {step} = 0 or chunk_id >= 2000").select(F.concat(F.lit("q"), "chunk_id").alias("query_id"), F.col("embedding").alias("vector"))


def rows(df):
    return sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))


@pytest.mark.parametrize(("part", "block"), [(8192, 4096), (100, 16)])
def test_exact(spark, vectors, tmp_path, monkeypatch, part, block):
    monkeypatch.setattr(nearest, "ROWS", part)
    monkeypatch.setattr(nearest, "QUERIES", block)
    index = VectorIndex(Store(spark, f"file://{tmp_path}/x")).build(vectors)
    for limit, least in ((40, 0.35), (5, 0.9)):
        assert rows(index.search(asked(vectors), limit, least)) == rows(R.vector_channel(vectors, asked(vectors), limit, least))
    assert index.at().table("lists").count() == 1502  # all but those without a direction


def test_chosen_hits(spark, vectors, index):
    some = vectors.where("chunk_id % 3 = 1")
    want = rows(R.vector_channel(some, asked(vectors), 10))
    assert rows(index.search(asked(vectors), 10, allowed=some)) == want
    assert rows(index.search(asked(vectors), 10, keep=lambda hits: hits.where("chunk_id % 3 = 1"))) == want


def test_recall(spark, vectors, index):
    truth = {r[:2] for r in rows(index.search(asked(vectors, 7), 10))}
    probes = index.probes_for(0.95)
    assert 1 <= probes < len(index._heads(index.at())) / 2
    found = {r[:2] for r in rows(index.search(asked(vectors, 7), 10, probes=probes))}
    assert len(truth & found) >= 0.9 * len(truth)
    plan = index.search(asked(vectors), 10, probes=probes)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nothing_indexed(spark, vectors, tmp_path):
    index = VectorIndex(Store(spark, f"file://{tmp_path}/n")).build(vectors.where("chunk_id between 2000 and 2004"))
    assert index.search(asked(vectors), 10).count() == 0 and index.probes_for() == 1
    odd = VectorIndex(Store(spark, f"file://{tmp_path}/o")).build(vectors.where("chunk_id >= 2000"))
    assert rows(odd.search(asked(vectors), 10)) == rows(R.vector_channel(vectors.where("chunk_id >= 2000"), asked(vectors), 10))


def test_fitted():
    rng = np.random.default_rng(1)
    x = unit(np.repeat(rng.normal(size=(4, 8)), 50, axis=0) + 0.01 * rng.normal(size=(200, 8)))
    c = fitted(x, 12)
    assert c.shape == (12, 8) and np.allclose(np.linalg.norm(c, axis=1), 1)
    assert (x @ c.T).max(axis=1).min() > 0.99
    assert fitted(np.ones((5, 3)) / 3**0.5, 4).shape == (1, 3)


def test_ties_past_the_limit_go(spark, tmp_path):
    """Of many equal vectors a task returns as many as are asked for, those of the least ids."""
    line, ids = np.full(5000, 0.87654), np.arange(5000)[::-1]
    line[7] = 0.9
    got = nearest.best(line, np.arange(5000), ids, 40)
    assert sorted(ids[got]) == [*range(39), 4992]
    half = np.array([0.5, 0.12345, 0.12345 - 1e-13, 0.1234, 0.1235])  # how the second is rounded is open
    assert set(nearest.best(half, np.arange(5), np.array([0, 9, 8, 7, 6]), 2)) >= {0, 4}
    copies = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(3000)], KIND)
    index = VectorIndex(Store(spark, f"file://{tmp_path}/c")).build(copies)
    assert {r[1] for r in rows(index.search(asked(copies, 500), 20))} == set(range(20))


def test_scan(spark, vectors):
    for limit, least in ((40, 0.35), (5, 0.9)):
        assert rows(nearest.scan(vectors, asked(vectors), limit, least)) == rows(R.vector_channel(vectors, asked(vectors), limit, least))
    kept = lambda hits: hits.where("chunk_id % 3 = 1")
    assert rows(nearest.scan(vectors, asked(vectors), 10, keep=kept)) == rows(R.vector_channel(vectors.where("chunk_id % 3 = 1"), asked(vectors), 10))
    assert "NestedLoop" not in nearest.scan(vectors, asked(vectors), 10)._jdf.queryExecution().executedPlan().toString()
    assert nearest.scan(vectors, asked(vectors).limit(0), 10).count() == 0


def test_queries_go_to_bins(spark, vectors, index, monkeypatch):
    """A query is sent to a bin of lists once, and a few rows at a time."""
    heads = [{"list": i, "n": n, "parts": p} for i, n, p in ((-1, 5, 1), (0, 60, 1), (1, 30, 1), (2, 200, 2), (3, 10, 1), (4, 1, 1))]
    assert nearest.bins(heads, 100) == {-1: -1, 0: 0, 1: 0, 2: 2, 3: 0, 4: 4}
    want = rows(R.vector_channel(vectors, asked(vectors), 10))
    for limit in (1, 8192):
        monkeypatch.setattr(nearest, "ROUTED", limit)
        assert rows(index.search(asked(vectors), 10)) == want
    assert len(set(nearest.bins(index._heads(index.at()), nearest.ROWS).values())) == 2  # all lists, and the rest
