"""An inverted-file index of vectors (V1, J11): lists by nearest centroid, probed by key."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import retrieval as R
from quillspark.sources.store import Snapshot, Store

#: Vectors that centroids are fitted on, at most; queries that the number of probed lists
#: is chosen by, at most.
SAMPLE, TRIAL = 20_000, 200
#: Centroids, at most; rounds of fitting.
MOST, ROUNDS = 4096, 8
#: Vectors and queries of one task's matrix product, about.
ROWS, QUERIES = 8192, 4096
#: Rows that routing hands on at a time.
ROUTED = 8192
#: The list of vectors that centroids do not fit: of another length. Always searched.
REST = -1


def matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow column of arrays as values in a row and the rows' n+1 bounds."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):  # no or several chunks
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    bounds = np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), bounds


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fitted(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Unit centroids of unit vectors: spherical k-means from distinct vectors."""
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centroids = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(ROUNDS):
        home = np.concatenate([np.argmax(some @ centroids.T, axis=1) for some in np.array_split(x, max(1, len(x) // 4096))])
        total = np.zeros_like(centroids)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1)
        centroids = np.where(norm[:, None] > 0, total / np.where(norm > 0, norm, 1)[:, None], centroids)
    return centroids


def usable(name: str):
    """Whether an array has a direction: not null or empty, all its elements finite, not all zero."""
    good = F.forall(name, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.col(name).isNotNull() & (F.size(name) > 0) & F.coalesce(good, F.lit(False)) & F.exists(name, lambda v: v != 0)


def bins(heads: list, rows: int) -> dict[int, int]:
    """Lists (their number, size and parts) in bins of at most ``rows`` vectors, each named
    by its first list; lists of several parts, and that of the rest, are bins of their own."""
    out, first, room = {}, REST, 0
    for h in heads:
        if h["list"] == REST or h["parts"] > 1:
            out[h["list"]] = h["list"]
            continue
        if h["n"] > room:
            first, room = h["list"], rows
        out[h["list"]] = first
        room -= h["n"]
    return out


def best(line: np.ndarray, good: np.ndarray, ids: np.ndarray, limit: int) -> np.ndarray:
    """Of the places ``good`` of a line of cosines those that can be among its first
    ``limit`` by the cosine rounded to four digits, then by id. Where the last bits decide
    how one is rounded, both ways count; all others past the limit go, ties too."""
    if len(good) <= limit:
        return good
    x = line[good] * 1e4 + 0.5
    low, high = np.floor(x - 1e-6), np.floor(x + 1e-6)
    least = np.partition(low, len(low) - limit)[len(low) - limit]
    near = np.flatnonzero(high >= least)
    if len(near) > limit:
        last = near[np.lexsort((ids[good[near]], -low[near]))[limit - 1]]
        near = near[(high[near] > low[last]) | ((high[near] == low[last]) & (ids[good[near]] <= ids[good[last]]))]
    return good[near]


def scan(vectors: DataFrame, queries: DataFrame, limit: int, least: float = R.MIN_COSINE, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """As ``retrieval.vector_channel`` gives, by matrix products: vectors are passed over
    where they are made, blocks of 1000 queries are what tasks share, and a task returns
    the best of each query (all that are near enough if ``keep`` has yet to choose)."""
    import pyarrow as pa

    spark = vectors.sparkSession
    plain = lambda df, name: df.where(usable(name)).withColumn(name, F.transform(name, lambda x: x.cast("double")))
    v = plain(vectors.select("chunk_id", "embedding"), "embedding")
    schema = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(v.dtypes)['chunk_id']}, score double"

    def search(some: DataFrame) -> DataFrame:
        asked = some.toArrow()
        if not asked.num_rows:
            return spark.createDataFrame([], schema)
        values, bounds = matrix(asked.column("vector"))
        shared = spark.sparkContext.broadcast((asked.column("query_id").combine_chunks(), values, bounds))

        def run(batches):
            names, values, bounds = shared.value
            for batch in batches:
                x, xb = matrix(batch.column("embedding"))
                ids, who, what, score = batch.column("chunk_id").to_numpy(zero_copy_only=False), [], [], []
                for dims in np.unique(np.diff(bounds)):
                    a, b = np.flatnonzero(np.diff(xb) == dims), np.flatnonzero(np.diff(bounds) == dims)
                    if not len(a):
                        continue
                    left = unit(x[xb[a][:, None] + np.arange(dims)])
                    for part in np.array_split(b, max(1, len(b) * len(a) // 4_000_000)):
                        for i, line in zip(part.tolist(), unit(values[bounds[part][:, None] + np.arange(dims)]) @ left.T, strict=True):
                            good = np.flatnonzero(line >= least)
                            good = good if keep is not None else best(line, good, ids[a], limit)
                            who.append(np.full(len(good), i))
                            what.append(a[good])
                            score.append(line[good])
                if who:
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(who))), batch.column("chunk_id").take(pa.array(np.concatenate(what))), pa.array(np.concatenate(score))], names=["query_id", "chunk_id", "score"])

        return v.mapInArrow(run, schema)

    hits = R.in_blocks(plain(queries.select("query_id", "vector"), "vector"), 1000, search).withColumn("score", F.round("score", 4))
    return R.ranked(hits if keep is None else keep(hits), limit)


class VectorIndex:
    """Vectors (chunk_id, embedding) in lists by their nearest centroid, in a ``Store``.

    Centroids are fitted on the ``SAMPLE`` vectors of the least hashed ids; every vector
    is indexed. ``lists`` holds the vectors, in parts of some ``ROWS``; ``heads`` a row a
    list: its centroid, its number of parts and the cosine of its farthest vector.
    Vectors that are null, zero or not finite are near nothing and left out.
    """

    def __init__(self, store: Store, at: Snapshot | None = None):
        self.store, self._at = store, at

    def at(self) -> Snapshot:
        return self._at or self.store.snapshot()

    def build(self, vectors: DataFrame, lists: int | None = None) -> VectorIndex:
        """Index ``vectors`` anew; ``lists`` is the root of their number unless given."""
        import pyarrow as pa

        spark = vectors.sparkSession
        v = vectors.select("chunk_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")).where(usable("embedding"))
        sizes = v.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
        dims, n = (sizes[0]["dims"], sizes[0]["count"]) if sizes else (1, 0)
        sample = v.where(F.size("embedding") == dims).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).select("embedding").toArrow()
        values, bounds = matrix(sample.column("embedding"))
        x = values.reshape(len(bounds) - 1, dims)
        centroids = fitted(unit(x), lists or min(MOST, max(1, round(n**0.5)))) if len(x) else np.zeros((0, dims))
        shared = spark.sparkContext.broadcast(centroids)

        def run(batches):
            for batch in batches:
                values, bounds = matrix(batch.column("embedding"))
                home, near = np.full(len(bounds) - 1, REST), np.ones(len(bounds) - 1)
                fit = np.flatnonzero(np.diff(bounds) == dims) if len(shared.value) else np.zeros(0, np.int64)
                for some in np.array_split(fit, max(1, len(fit) // 1024)):
                    if len(some):
                        cos = unit(values[bounds[some][:, None] + np.arange(dims)]) @ shared.value.T
                        home[some] = np.argmax(cos, axis=1)
                        near[some] = cos[np.arange(len(some)), home[some]]
                yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), batch.column("embedding"), pa.array(home.astype(np.int32)), pa.array(near)], names=["chunk_id", "embedding", "list", "near"])

        kind = dict(v.dtypes)["chunk_id"]
        placed = v.mapInArrow(run, f"chunk_id {kind}, embedding array<double>, list int, near double")
        now = self.store.commit(self.store.snapshot(), replace={"placed": placed})
        placed = now.table("placed")
        frame = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)] + [(REST, None)], "list int, centroid array<double>")
        counts = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near"))
        heads = frame.join(counts, "list").withColumn("parts", F.ceil(F.col("n") / ROWS).cast("int"))
        part = F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")
        filed = placed.join(F.broadcast(heads.select("list", "parts")), "list").select("list", part.alias("part"), "chunk_id", "embedding")
        done = self.store.commit(now, replace={"heads": heads, "lists": filed, "placed": placed.limit(0)})
        return VectorIndex(self.store, done)

    def _heads(self, now: Snapshot) -> list:
        """The lists, ``MOST`` and one at most."""
        return now.table("heads").orderBy("list").collect()

    def search(self, queries: DataFrame, limit: int, least: float = R.MIN_COSINE, probes: int | None = None, allowed: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """As ``retrieval.vector_channel`` gives: (query_id, chunk_id, score, rank).

        A query meets the vectors of its ``probes`` nearest lists, by an equi-join on list
        and part; without ``probes`` those of all lists but those whose farthest vector's
        angle says that none can reach ``least``, which loses nothing. Lists are met in
        bins then, so that a query goes to a bin once and not to each list. A task
        multiplies a part with a block of queries and keeps the best ``limit`` of each query (all of
        them if ``keep`` has yet to choose).
        """
        import pyarrow as pa

        now, spark = self.at(), queries.sparkSession
        heads = self._heads(now)
        centroids = np.array([h["centroid"] for h in heads if h["list"] != REST])
        ids, parts = np.array([h["list"] for h in heads], int), {h["list"]: h["parts"] for h in heads}
        near = np.array([h["near"] for h in heads if h["list"] != REST])
        bin_of = bins(heads, ROWS) if probes is None else {h["list"]: h["list"] for h in heads}
        binned = np.array([bin_of[i] for i in ids[ids != REST]], int)
        shared = spark.sparkContext.broadcast((ids, parts, centroids, np.arccos(np.clip(near, -1, 1)) + 1e-6))
        q = queries.select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("vector")).where(usable("vector"))
        blocks = max(1, -(-q.count() // QUERIES))

        def route(batches):
            ids, parts, centroids, wide = shared.value
            real = ids[ids != REST]

            def rows(batch, at, to, part):
                at = pa.array(at, pa.int64())
                return pa.RecordBatch.from_arrays([batch.column("query_id").take(at), batch.column("vector").take(at), pa.array(to, pa.int32()), pa.array(part, pa.int32())], names=["query_id", "vector", "list", "part"])

            for batch in batches:
                values, bounds = matrix(batch.column("vector"))
                at, to, part = [], [], []
                for i in range(len(bounds) - 1):
                    x = values[bounds[i] : bounds[i + 1]]
                    goal = [REST] if REST in parts else []
                    if len(real) and len(x) == centroids.shape[1]:
                        cos = centroids @ (x / np.linalg.norm(x))
                        if probes is None:
                            chosen = np.unique(binned[np.cos(np.maximum(np.arccos(np.clip(cos, -1, 1)) - wide, 0)) >= least])
                        else:
                            chosen = real[np.lexsort((real, -cos))[:probes]]
                        goal += chosen.tolist()
                    for g in goal:
                        for p in range(parts[g]):
                            at.append(i)
                            to.append(g)
                            part.append(p)
                    if len(at) >= ROUTED:  # a vector is repeated for each of its bins
                        yield rows(batch, at, to, part)
                        at, to, part = [], [], []
                yield rows(batch, at, to, part)

        kinds = dict(queries.dtypes)
        routed = q.mapInArrow(route, f"query_id {kinds['query_id']}, vector array<double>, list int, part int").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        lists = now.table("lists")
        if probes is not None or blocks == 1:  # only lists that some query meets
            lists = lists.join(routed.select("list").distinct(), "list", "left_semi") if probes is not None else lists
        if allowed is not None:
            lists = lists.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
        if probes is None:
            lists = lists.join(F.broadcast(spark.createDataFrame(list(bin_of.items()), "list int, bin int")), "list").withColumn("list", F.col("bin")).drop("bin")
        lists = lists.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        schema = f"query_id {kinds['query_id']}, chunk_id {dict(lists.dtypes)['chunk_id']}, score double"

        def compare(own: pa.Table, asked: pa.Table) -> pa.Table:
            none = pa.table({"query_id": asked.column("query_id").slice(0, 0), "chunk_id": own.column("chunk_id").slice(0, 0), "score": pa.array([], pa.float64())})
            if not own.num_rows or not asked.num_rows:
                return none
            rows, found = own.column("chunk_id").combine_chunks(), []
            ids = rows.to_numpy(zero_copy_only=False)
            x, xb = matrix(own.column("embedding"))
            y, yb = matrix(asked.column("vector"))
            for dims in np.unique(np.diff(yb)):  # one, but in the list of the rest
                a, b = np.flatnonzero(np.diff(xb) == dims), np.flatnonzero(np.diff(yb) == dims)
                if not len(a):
                    continue
                left = x[xb[a][:, None] + np.arange(dims)]
                norm = np.linalg.norm(left, axis=1)
                for some in np.array_split(b, max(1, len(b) * len(a) // 4_000_000)):
                    right = y[yb[some][:, None] + np.arange(dims)]
                    cos = (right @ left.T) / (np.linalg.norm(right, axis=1)[:, None] * norm)
                    for i, line in zip(some.tolist(), cos, strict=True):
                        good = np.flatnonzero(line >= least)
                        good = good if keep is not None else best(line, good, ids[a], limit)
                        found.append((np.full(len(good), i), a[good], line[good]))
            if not found:
                return none
            who, what, score = (np.concatenate(c) for c in zip(*found, strict=True))
            return pa.table({"query_id": asked.column("query_id").take(pa.array(who)), "chunk_id": rows.take(pa.array(what)), "score": score})

        key = ["list", "part", "block"]
        hits = lists.groupBy(*key).cogroup(routed.groupBy(*key)).applyInArrow(compare, schema)
        hits = hits.withColumn("score", F.round("score", 4))
        return R.ranked(hits if keep is None else keep(hits), limit)

    def probes_for(self, recall: float = 0.95, k: int = 10, least: float = R.MIN_COSINE) -> int:
        """The fewest lists to probe that hold ``recall`` of the ``k`` nearest vectors of
        ``TRIAL`` indexed ones (those of the least hashed ids), their whole truth known by
        an exact search."""
        now = self.at()
        lists = now.table("lists")
        trial = lists.where(F.col("list") != REST).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(TRIAL).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
        truth = self.search(trial, k, least).join(lists.select("chunk_id", "list"), "chunk_id").select("query_id", "list").collect()
        heads = [h for h in self._heads(now) if h["list"] != REST]
        if not truth or not heads:
            return 1
        order = {r["query_id"]: np.argsort(np.argsort(-(np.array([h["centroid"] for h in heads]) @ np.array(r["vector"]))), kind="stable") for r in trial.collect()}
        place = {h["list"]: i for i, h in enumerate(heads)}
        ranks = np.sort([order[r["query_id"]][place[r["list"]]] for r in truth if r["list"] in place])
        return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1
