"""Quality classifier: random Fourier features of document statistics, ridge scores
from partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import chunks, text_of, utf8_batch, word_table, written

# Byte classes of the statistics.
_CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "bang", "bar", "symbol", "high")
_CLASS = np.full(256, _CLASSES.index("symbol"), np.uint8)
for _name, _bytes in (
    ("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", b" \t\r\x0b\x0c"), ("newline", b"\n"),
    ("stop", b".,;:'\"-?()"), ("bang", b"!"), ("bar", b"|"), ("high", range(128, 256)),
):
    _CLASS[list(_bytes)] = _CLASSES.index(_name)
N_STATS = 24


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Statistics of each text, a float32 row of ``N_STATS``; no language, source or id.

    Shares of byte classes and of kinds of words (upper case, with symbols, with
    digits, repeated next to each other, seen before in the text), word and line
    lengths, and the size. Shares are also taken on a logarithmic scale, so that a
    short stretch of junk in a long text shows.
    """
    n, k = len(bounds) - 1, len(_CLASSES)
    kinds = _CLASS[data]
    row = np.repeat(np.arange(n), np.diff(bounds))
    count = np.bincount(row * k + kinds, minlength=n * k).reshape(n, k).astype(float)
    size = np.maximum(np.diff(bounds), 1).astype(float)
    share = count / size[:, None]
    starts, ends, of, h = word_table(data, bounds)
    words = np.bincount(of, minlength=n).astype(float)
    per = np.maximum(words, 1)
    total = lambda c: np.concatenate(([0], np.cumsum(c, dtype=np.int64)))
    upto = total(kinds == 1), total((kinds == 0) | (kinds == 9)), total((kinds >= 6) & (kinds <= 8))
    upper, lower, odd = (u[ends] - u[starts] for u in upto)
    shout = np.bincount(of, (upper > 1) & (lower == 0), n) / per
    marked = np.bincount(of, odd > 0, n) / per
    bare = np.bincount(of, odd == ends - starts, n) / per
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    if len(h):
        order = np.lexsort((h, of))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
        distinct = np.bincount(of[order], fresh, n)
    else:
        distinct = np.zeros(n)
    lengths = (ends - starts).astype(float)
    mean = np.bincount(of, lengths, n) / per
    spread = np.sqrt(np.maximum(np.bincount(of, lengths**2, n) / per - mean**2, 0))
    thin = lambda x: np.log1p(1000 * x)
    lines = count[:, 4] + 1
    out = [
        np.log1p(size), np.log1p(words), mean, spread, np.log1p(words / lines), distinct / per, np.log1p(distinct),
        share[:, 1], share[:, 2], share[:, 5], share[:, 9], shout, marked, bare,
        thin(share[:, 6]), thin(share[:, 7]), thin(share[:, 8]), thin(share[:, 1]), thin(shout), thin(marked), thin(bare),
        thin(np.bincount(of, again, n) / per), thin(share[:, 2]), thin(share[:, 4]),
    ]
    return np.stack(out, axis=1).astype(np.float32)


def statistics_of(column) -> np.ndarray:
    data, bounds = utf8_batch(column)
    parts = [statistics(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]) for a, b in chunks(bounds)]
    return np.concatenate(parts) if parts else np.zeros((0, N_STATS), np.float32)


@dataclass
class Model:
    """A fitted classifier: a few kilobytes, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def raw(self, stats: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return features(self, stats) @ (self.weights if weights is None else weights)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), *self.knots), 0.0, 1.0)


def features(model: Model, stats: np.ndarray) -> np.ndarray:
    """cos(Wx + b) approximates a Gaussian kernel; x itself and 1 are added."""
    x = np.clip((np.asarray(stats, np.float64) - model.mean) / model.scale, -6, 6)
    return np.concatenate([np.cos(x @ model.waves + model.phase) * np.sqrt(2 / len(model.phase)), x, np.ones((len(x), 1))], axis=1)


def isotonic(x: np.ndarray, total: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points sorted by x; the knots of a rising line."""
    blocks: list[list[float]] = []
    for v, n, g in zip(x, total, good, strict=True):
        blocks.append([v * n, n, g])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, waves: int = 256, ridge: float = 1.0, gamma: float = 0.02, folds: int = 4, max_rows: int = 200_000, seed: int = 0) -> Model:
    """Fit on the labelled rows of ``stats`` (doc_id, stats array<float>).

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out. ``max_rows`` bounds the
    training rows: beyond it a hash of doc_id keeps an even share. Each task sums the
    normal equations of its rows by fold; the driver adds at most 8 x ``folds`` such
    matrices. Calibration uses scores of models that did not see the row's fold
    (the sum of the other folds' equations), as counts in 2048 bins, so no row comes
    to the driver. Without both labels every score is 0.5.
    """
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("y"))
    rows = stats.where(~held).join(known, "doc_id").select("doc_id", "stats", "y")
    rows = written(rows)
    counted = rows.groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good"), *[f(F.col("stats")[i].cast("double")).alias(f"{name}{i}") for name, f in (("m", F.avg), ("s", F.stddev_pop)) for i in range(N_STATS)]).first()
    rng = np.random.default_rng(seed)
    model = Model(np.zeros(N_STATS), np.ones(N_STATS), rng.normal(0, np.sqrt(2 * gamma), (N_STATS, waves)), rng.uniform(0, 2 * np.pi, waves), np.zeros(0), (np.zeros(0), np.zeros(0)))
    if not counted["n"] or not 0 < counted["good"] < counted["n"]:
        return model
    model.mean = np.array([counted[f"m{i}"] for i in range(N_STATS)])
    model.scale = np.array([max(counted[f"s{i}"], 1e-6) for i in range(N_STATS)])
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30))
    if counted["n"] > max_rows:
        rows = rows.where(place < int((1 << 30) * (max_rows / counted["n"])))
    rows = rows.select("stats", "y", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.lit(folds)).alias("fold")).repartition(8)
    size = waves + N_STATS + 1

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = np.zeros((folds, size, size + 1))
        for batch in batches:
            if not len(batch):
                continue
            f = features(model, np.stack(batch["stats"].to_numpy()))
            y, fold = batch["y"].to_numpy(float), batch["fold"].to_numpy()
            for k in range(folds):
                g = f[fold == k]
                a[k] += g.T @ np.column_stack([g, y[fold == k]])
        yield pd.DataFrame({"fold": range(folds), "sums": [x.tobytes() for x in a]})

    sums = np.zeros((folds, size, size + 1))
    for r in rows.mapInPandas(equations, "fold int, sums binary").collect():
        sums[r["fold"]] += np.frombuffer(r["sums"]).reshape(size, size + 1)
    penalty = ridge * np.eye(size)
    penalty[-1, -1] = 1e-9
    solve = lambda s: np.linalg.solve(s[:, :-1] + penalty, s[:, -1])
    every = sums.sum(axis=0)
    model.weights = solve(every)
    others = [solve(every - s) for s in sums]

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                stats, fold, raw = np.stack(batch["stats"].to_numpy()), batch["fold"].to_numpy(), np.zeros(len(batch))
                for k in range(folds):
                    raw[fold == k] = model.raw(stats[fold == k], others[k])
                yield pd.DataFrame({"bin": np.clip((raw + 0.5) * 1024, 0, 2047).astype(int), "y": batch["y"].astype(int)})

    bins = rows.mapInPandas(binned, "bin int, y int").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good")).orderBy("bin").collect()
    x, n, g = (np.array([r[c] for r in bins], float) for c in ("bin", "n", "good"))
    model.knots = isotonic((x + 0.5) / 1024 - 0.5, n, g)
    return model


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every whole text, by a map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics_of(batch.column(1))
            flat = pa.array(stats.ravel(), pa.float32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(stats) + 1, dtype=np.int32) * N_STATS), flat)], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, stats array<float>")


def scorer(model: Model):
    """A pandas UDF from ``stats`` to a score."""

    @F.pandas_udf("double")
    def score(stats: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(stats.to_numpy())) if len(stats) else [])

    return score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Score every document: doc_id, held_out, score, predicted.

    The texts are read once; their statistics (about 100 bytes a row) are written to
    the shared folder, joined with the labels for fitting and then scored.

    Cases: a null or empty text has statistics like any other; a null doc_id is
    scored, never trained on, and not held out; labels that are null, of unknown
    documents or neither 0 nor 1 are ignored, of several labels the least holds; empty
    tables give an empty result, or 0.5 everywhere where only labels are missing;
    other columns are ignored.
    """
    stats = written(with_statistics(docs))
    model = fit(stats, labels, **options)
    score = scorer(model)
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("stats").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` that are not rejected, unchanged: the score is computed
    next to the text, so the text is not shuffled."""
    model = fit(written(with_statistics(docs)), labels, **options)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(statistics_of(pa.array(text, pa.large_string()))))

    return docs.where(score(text_of()) >= threshold)
