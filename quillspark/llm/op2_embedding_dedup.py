"""Embedding near-dedup: random projections decoded to E8 lattice points in several
tables, neighbouring cells probed, cosine verified."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bit_field, bits_at, components, forget, mixed_bits, partitions, smallest_reachable, written


@lru_cache(maxsize=1)
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: +-1 at two places, or eight halves with an even
    number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of an even sum."""
    z = np.rint(x)
    odd = np.flatnonzero(z.sum(axis=1) % 2)
    error = x[odd] - z[odd]
    worst = np.abs(error).argmax(axis=1)
    z[odd, worst] += np.where(error[np.arange(len(odd)), worst] >= 0, 1, -1)
    return z


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 moved by a half: the nearer of the two nearest points."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@lru_cache(maxsize=32)
def projection(dims: int, table: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, table, dims]).normal(size=(dims, 8))


@dataclass(frozen=True)
class Cells:
    """How vectors are dealt to cells: ``tables`` times, each by ``lattices`` independent
    projections to 8 dimensions over ``scale``, at home in its cell and a guest in
    ``probes`` more. Two vectors meet in a cell where one of them is at home."""

    tables: int
    scale: float
    lattices: int = 1
    probes: int = 4
    seed: int = 0

    @property
    def width(self) -> int:
        return (1 + self.probes) ** self.lattices


def meeting_share(scale: float, probes: int, threshold: float, trials: int = 4000) -> float:
    """How many pairs of vectors at the threshold meet in a cell of one lattice, by
    simulation: projections of such a pair are normal and correlated by the cosine."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(trials, 8))
    y = threshold * x + math.sqrt(1 - threshold * threshold) * rng.normal(size=(trials, 8))
    near, far = (nearest_cells(v / scale, probes) for v in (x, y))
    return float(((near[:, :1] == far).all(axis=2).any(axis=1) | (near == far[:, :1]).all(axis=2).any(axis=1)).mean())


def planned(n: int, threshold: float, recall: float = 0.9999, probes: int = 4, seed: int = 0) -> Cells:
    """The cheapest way to deal out ``n`` vectors of one label such that ``recall`` of the
    pairs at the threshold meet.

    The finer the cells (smaller ``scale``, or two lattices to a key), the fewer vectors
    that are not near meet and the more tables are needed. Of n vectors in no order, a
    vector meets at most n * (1+2*probes) * (scale^2/4pi)^4 in a lattice's cells (the
    density of the projections times the cells' volume, 1). Its cost is that and its keys.
    """
    best = None
    for scale in SCALES:
        share, met = meeting_share(scale, probes, threshold), (1 + 2 * probes) * (scale * scale / (4 * math.pi)) ** 4
        for lattices in (1, 2):
            found = min(share**lattices, 1 - 1e-9)
            if found < 0.02:
                continue
            cells = Cells(max(1, math.ceil(math.log(1 - recall) / math.log(1 - found))), scale, lattices, probes, seed)
            cost = cells.tables * (n * met**lattices + KEY_COST * cells.width)
            if best is None or cost < best[0]:
                best = cost, cells
    return best[1]


#: Scales that ``planned`` tries, and what a key costs against a cosine.
SCALES, KEY_COST = (1.6, 1.4, 1.2, 1.0, 0.85, 0.7), 50


def nearest_cells(x: np.ndarray, probes: int) -> np.ndarray:
    """The lattice points of each row's own cell and of the ``probes`` nearest to it."""
    home, step = nearest_e8(x), shortest()
    distance = -2 * (x - home) @ step.T  # all steps are of one length
    near = np.argpartition(distance, probes - 1, axis=1)[:, :probes] if probes else np.zeros((len(x), 0), int)
    return np.concatenate([home[:, None, :], home[:, None, :] + step[near]], axis=1)


def cell_keys(unit: np.ndarray, label: np.ndarray, cells: Cells) -> np.ndarray:
    """For unit vectors, tables x width keys, the first of each table's that of its home. A
    key covers the label, the number of dimensions, the table and a lattice point of each
    of its lattices."""
    n, dims = unit.shape
    keys = np.empty((n, cells.tables, cells.width), np.int64)
    for t in range(cells.tables):
        h = (mixed_bits(label.astype(np.int64).astype(np.uint64)) + np.uint64(dims * 1000003 + t))[:, None]
        for j in range(cells.lattices):
            points = nearest_cells(unit @ projection(dims, t * cells.lattices + j, cells.seed) / cells.scale, cells.probes)
            h = np.repeat(h, 1 + cells.probes, axis=1)
            part = np.tile(points, (1, h.shape[1] // (1 + cells.probes), 1))
            for c in range(8):
                h = mixed_bits(h * np.uint64(0x9E3779B97F4A7C15) + (2 * part[:, :, c]).astype(np.int64).astype(np.uint64))
        keys[:, t, :] = h.astype(np.int64)
    return keys


def unit_rows(flat: np.ndarray, n: int) -> np.ndarray:
    x = flat.reshape(n, -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def by_length(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column by number of dimensions: (rows, their vectors)."""
    lengths = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten()).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, flat[starts[rows][:, None] + np.arange(d)]


def near_pairs(unit: np.ndarray, home: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one cell between ``left`` and ``right`` (or within ``left`` where
    they are one array) that are near and of which one at least is at home there."""
    near = (unit[left] @ unit[right].T >= threshold) & (home[left][:, None] | home[right][None, :])
    if left is right:
        near = np.triu(near, 1)
    a, b = np.nonzero(near)
    return left[a], right[b]


def met_first(keys: np.ndarray, a: np.ndarray, b: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b), found in the cells ``cell``, count there: in the first
    table in which the two meet, in the lesser key if they meet in two cells of it. So
    each link counts once, and no pair leaves the task."""
    fine, left, most = np.zeros(len(a), bool), np.arange(len(a)), np.iinfo(np.int64).max
    for t in range(keys.shape[1]):
        x, y = keys[a[left], t], keys[b[left], t]
        first = np.where((x[:, :1] == y).any(axis=1), x[:, 0], most)
        second = np.where((y[:, :1] == x).any(axis=1), y[:, 0], most)
        met = np.minimum(first, second)
        fine[left] = met == cell[left]
        left = left[met == most]
        if not len(left):
            break
    return fine


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, cells: Cells | None = None, recall: float = 0.9999, block: int = 512, filter_bits: int = 26, broadcast_rows: int = 100_000) -> DataFrame:
    """Links between vectors of one label by cosine: vec_id, n_links, component_id, kept.

    A unit vector is projected to 8 dimensions, decoded to the nearest E8 point, at home
    in that cell and a guest in the nearest ones, in several tables, so two vectors meet
    where one is at home in a cell of the other. How fine the cells are and how many tables there are
    follows from the vectors of the largest label (``planned``), so that cells stay
    small and ``recall`` of the pairs at the threshold meet (tests measure it against
    brute force); pairs above it meet more often.

    Equal vectors are one, with a count. A cell of more than ``block`` vectors is cut
    into blocks by a hash, and each pair of blocks is a task's matrix product; cells
    return a count and a label per vector, never pairs. A link counts in the first cell
    in which its two vectors meet, which each task finds by itself.

    Cases: vectors that are null, empty, zero or hold null or non-finite numbers, and
    rows with a null label or id, link with nothing; vectors of different numbers of
    dimensions never link; labels of any type are compared by a 64-bit hash; rows with
    equal vectors link with each other; rows that repeat a vec_id with another vector
    are one node; an empty table gives an empty result; other columns are ignored.
    """
    spark, n = vectors.sparkSession, partitions(vectors.sparkSession)
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"  # floats move at half the size
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("label").isNotNull(), F.xxhash64("label")).alias("label"), F.col("embedding").cast(kind).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    fit = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & (length > 0) & (length < float("inf")), F.lit(False))
    groups = rows.where(fit).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"))
    groups = written(groups)
    if cells is None:
        largest = groups.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        cells = planned(largest or 1, threshold, recall)

    slim_rows = groups.select("label", "embedding", "rep", "mult")

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_length(batch.column(1)):
                keys = cell_keys(unit_rows(x, len(x)), np.asarray(batch.column(0)).astype(np.int64)[at], cells).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.arange(len(keys)) % cells.width == 0)], names=["key", "home"])

    counted = slim_rows.mapInArrow(keys_of, "key long, home boolean").groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("home").alias("home"))
    sizes = written(counted.where("size > 1 and home").drop("home"))
    # a cell of one vector, or of guests only, links nothing; a field of bits at two places of a key tells most such cells
    mask = (1 << filter_bits) - 1
    held = spark.sparkContext.broadcast(bit_field(sizes, [F.col("key").bitwiseAND(F.lit(mask)), F.shiftright("key", 32).bitwiseAND(F.lit(mask))], filter_bits))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.asarray(batch.column(0)).astype(np.int64)
            for at, x in by_length(batch.column(1)):
                keys = cell_keys(unit_rows(x, len(x)), label[at], cells).reshape(len(at), -1)
                r, c = np.nonzero(bits_at(held.value, keys & mask) & bits_at(held.value, keys >> 32 & mask))
                again = pa.array(at[r])
                yield pa.RecordBatch.from_arrays([pa.array(keys[r, c]), pa.array(c % cells.width == 0), *[batch.column(k).take(again) for k in range(4)]], names=["key", "home", "label", "embedding", "rep", "mult"])

    dealt = slim_rows.mapInArrow(deal, f"key long, home boolean, label long, embedding {kind}, rep long, mult long")
    full = sizes.where(F.col("size") > block).select("key", F.ceil(F.col("size") / block).cast("int").alias("cut"))
    if full.count() <= broadcast_rows:  # else an equi-join that shuffles the rows once more
        full = F.broadcast(full)
    cut = F.coalesce("cut", F.lit(1))
    own = F.pmod(F.xxhash64("rep"), cut).cast("int")
    placed = (
        dealt.join(full, "key", "left")
        .withColumn("cut", cut)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "home", "label", "embedding", "rep", "mult")
        .repartition(n, "key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rep", "n", "low"]
        rest: pa.Table | None = None

        def counted(unit: np.ndarray, label: np.ndarray, rep: np.ndarray, mult: np.ndarray, found: list[tuple]) -> pa.RecordBatch:
            a, b, cell = (np.concatenate(x) for x in zip(*found, strict=True))
            ids, of = np.unique(rep, return_inverse=True)  # a vector has a row in each of its cells
            some = np.unique(of[np.concatenate([a, b])])
            row = np.zeros(len(ids), np.int64)
            row[of] = np.arange(len(rep))
            keys = cell_keys(unit[row[some]], label[row[some]], cells)
            p, q = np.searchsorted(some, of[a]), np.searchsorted(some, of[b])
            fine = met_first(keys, p, q, cell)
            p, q, m = p[fine], q[fine], mult[row[some]]
            count = np.bincount(p, m[q], len(some)) + np.bincount(q, m[p], len(some))
            low = smallest_reachable(ids[some], p, q)
            met = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays([pa.array(ids[some][met]), pa.array(count[met].astype(np.int64)), pa.array(low[met])], names=names)

        def met_in(t: pa.Table):
            lists = t.column("embedding").combine_chunks()
            columns = [t.column(c).to_numpy() for c in ("key", "i", "j", "own", "home", "label", "rep", "mult")]
            for rows, flat in by_length(lists):  # cells are of one length
                key, i, j, own, home, label, rep, mult = (c[rows] for c in columns)
                unit = unit_rows(flat, len(rows))
                edge = np.flatnonzero(np.r_[True, (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0), True])
                homes = np.add.reduceat(home.astype(np.int64), edge[:-1])
                found, held = [], 0
                for k in np.flatnonzero((np.diff(edge) > 1) & (homes > 0)):
                    a, b = edge[k], edge[k + 1]
                    if i[a] == j[a]:
                        left = right = np.arange(a, b)
                    else:
                        left, right = a + np.flatnonzero(own[a:b] == i[a]), a + np.flatnonzero(own[a:b] == j[a])
                    p, q = near_pairs(unit, home, left, right, threshold)
                    if len(p):
                        found.append((p, q, np.full(len(p), key[a])))
                        held += len(p)
                    if held > 1 << 19:
                        yield counted(unit, label, rep, mult, found)
                        found, held = [], 0
                if held:
                    yield counted(unit, label, rep, mult, found)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            if not t.num_rows:
                continue
            key, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
            open_at = int(np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))[-1]) + 1 if (key[0], i[0], j[0]) != (key[-1], i[-1], j[-1]) else 0
            rest = t.slice(open_at)
            yield from met_in(t.slice(0, open_at)) if open_at else ()
        if rest is not None and rest.num_rows:
            yield from met_in(rest)

    found = written(placed.mapInArrow(link, "rep long, n long, low long"))
    forget(sizes)
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "rep")
    linked = written(counts.join(parts, "rep", "left"))
    forget(found)
    # rows that link with nothing stay out of the joins
    fitting, copies = rows.where(fit), groups.where("mult > 1")
    nodes = fitting.join(copies, ["label", "embedding"], "left").select("vec_id", F.coalesce("rep", "vec_id").alias("rep"), F.coalesce("mult", F.lit(1)).alias("mult"))
    nodes = nodes.join(linked, "rep", "left").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return nodes.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
