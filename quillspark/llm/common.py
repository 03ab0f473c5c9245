"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word pattern of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``. Where the session names
    none, a local session (one machine, as in tests) takes one in its warehouse; on a
    cluster that is an error, since a folder of one machine is not shared."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def _stored(spark: SparkSession, path: str):
    """A path of the shared folder and its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in a folder for each value of ``by``, and read it
    back: cuts the lineage and survives lost executors, since no block lives on one machine.
    What ``forget`` does not delete before is deleted when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path, partitionBy=by)
    target, store = _stored(spark, path)
    store.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What DataFrames made in here shuffle is deleted when their job ends, and does not lie
    on disk until the driver's JVM next collects garbage. For those that run once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def forget(df: DataFrame) -> None:
    """Delete what ``written`` stored for ``df``, once nothing reads it any more."""
    path = getattr(df, "_written_at", None)
    if path:
        target, store = _stored(df.sparkSession, path)
        store.delete(target, True)
        store.cancelDeleteOnExit(target)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Texts go to Python ``rows`` at a time in this session, unless it asks for fewer: a
    batch of the default 10,000 can hold 64 MB, several times over in a worker. The
    registered queries and the pipeline ask for it; operators leave the session alone."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    return spark


def text_of(name: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def utf8_batch(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column as one array, and the rows' n+1 bounds.

    Reads the Arrow buffers themselves; no Python string is made.
    """
    import pyarrow as pa

    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[bounds[0] : bounds[-1]], bounds - bounds[0]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long) as (node, component).

    ``component`` is the smallest node reachable. Each round points every node at
    the smallest label among its neighbours and then at that label's own label
    (pointer jumping), so rounds grow with the logarithm of a component's width.
    Minima combine before the shuffle, so a node of many links is no hot key
    there; the joins are plain equi-joins that adaptive execution may split. Every
    round is written to the shared folder. Nodes without links are not returned.
    """
    both = written(
        edges.where("a <> b")
        .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.a", "e.b")
        .distinct()
    )
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).withColumnRenamed("a", "node"))
    while True:
        # hooks: what each label's whole tree sees as the smallest label next to it
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").groupBy("a").agg(F.min("cb").alias("m"))
        near = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", "c", F.least("c", "m").alias("m"))
        hooks = near.groupBy("c").agg(F.min("m").alias("m"))
        # a label is itself a node: its hook is the step of the whole tree
        step = written(near.join(hooks.withColumnRenamed("m", "h"), "c").select("node", "c", F.least("m", "h").alias("m")))
        jump = step.select(F.col("node").alias("m"), F.col("m").alias("mm"))
        after = written(step.join(jump, "m", "left").select("node", F.col("c").alias("was"), F.least("m", F.coalesce("mm", "m")).alias("c")))
        changed = after.where("c <> was").limit(1).count()
        forget(step)
        forget(labels)
        if not changed:
            forget(both)
            return after.select("node", F.col("c").alias("component"))
        labels = written(after.select("node", "c"))
        forget(after)


def smallest_reachable(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row the smallest id reachable by the links a-b among these rows."""
    label = ids.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        if (new == label).all():
            return label
        label = new


# ---- words of many texts at once, on bytes -------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed_bits(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix, so that every bit depends on all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(bounds: np.ndarray, most: int = 1 << 19):
    """Row ranges [a, b) of at most ``most`` bytes, or one row that is longer."""
    n, a = len(bounds) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, side="right")) - 1)
        yield a, b
        a = b


def word_table(data: np.ndarray, bounds: np.ndarray, lower: bool = True, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts data[bounds[i]:bounds[i+1]]: starts, ends, row, 64-bit hash.

    A word is a run of bytes other than ASCII white space, or than those that
    ``between`` marks; a row's end also ends it.
    The hash is a polynomial of the bytes and the length, finalised.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    if lower:
        data = _LOWER[data]
    inside = ~between[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = bounds[:-1][(bounds[:-1] < len(data))]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    rims = bounds[1:][bounds[1:] > 0] - 1
    last[rims] = inside[rims]
    ends = np.flatnonzero(last) + 1
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    lengths = ends - starts
    power = np.ones(int(lengths.max()) + 1, np.uint64)
    power[1:] = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
    body = data[inside].astype(np.uint64) + np.uint64(1)
    at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(body)) - np.repeat(at, lengths)
    h = mixed_bits(np.add.reduceat(body * power[place], at) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1, h


def sketch(docs: DataFrame, hashes, bits: int) -> np.ndarray:
    """How often the hashes (``hashes`` of bytes and bounds: one 64-bit number each) of
    each of 2^``bits`` classes occur in all texts: an upper bound of one's frequency.
    Tasks add their texts into one array each and send it in slices, which are summed;
    the driver gets 4 bytes a class."""
    import pandas as pd
    import pyarrow as pa

    size, slices, most = 1 << bits, 64, 2**31 - 1
    schema = "at int, salt int, part binary"
    pack = lambda counts: zlib.compress(np.minimum(counts, most).astype(np.int32).tobytes(), 1)

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros(size, np.int64)
        for batch in batches:
            data, bounds = utf8_batch(batch.column(0))
            for a, b in chunks(bounds):
                h = hashes(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                total += np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size)
        parts, salt = total.reshape(slices, -1), np.full(slices, TaskContext.get().partitionId() % 128, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(slices, dtype=np.int32)), pa.array(salt), pa.array([pack(p) for p in parts], pa.binary())], names=["at", "salt", "part"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size // slices, np.int64)
        for part in group["part"]:
            total += np.frombuffer(zlib.decompress(part), np.int32)
        return pd.DataFrame({"at": [group["at"].iloc[0]], "salt": [0], "part": [pack(total)]})

    # in two steps, so that no group holds the arrays of all tasks of a large cluster
    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism
    parts = docs.select(text_of().alias("text")).coalesce(tasks).mapInArrow(run, schema)
    parts = parts.groupBy("at", "salt").applyInPandas(add, schema).groupBy("at").applyInPandas(add, schema).collect()
    out = np.zeros(size, np.int32).reshape(slices, -1)
    for r in parts:
        out[r["at"]] = np.frombuffer(zlib.decompress(r["part"]), np.int32)
    return out.ravel()


def sketch_size(docs: DataFrame) -> int:
    """Bits of a sketch of the words of all texts: some 32 words a class, within 16 and
    24 bits (16 MB at one byte a class). Past that the classes fill up evenly."""
    chars = docs.select(F.sum(F.length(text_of())).alias("n")).first()["n"] or 0
    return min(24, max(16, int(np.ceil(np.log2(max(chars / 6, 1)))) - 5))


def bit_field(df: DataFrame, places: list[Column], bits: int) -> np.ndarray:
    """2^``bits`` bits, those at the ``places`` (columns of 0 to 2^bits - 1) of any row set:
    at most 2^bits / 8 bytes, whatever the rows."""
    at = df.select(F.explode(F.array(*[p.cast("long") for p in places])).alias("at"))
    word = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(31).cast("int"))
    found = at.groupBy(F.shiftright("at", 5).alias("w")).agg(F.bit_or(word).alias("m")).toArrow()
    field = np.zeros(1 << bits >> 5, np.uint32)
    field[found["w"].to_numpy()] = found["m"].to_numpy().astype(np.uint32)
    return field


def bits_at(field: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (field[place >> 5] >> (place & 31).astype(np.uint32) & np.uint32(1)).astype(bool)


def id_filter(ids: DataFrame, bits: int = 26):
    """A function of a long column: whether an id may be among ``ids`` (one long column).

    A Bloom filter of 2^``bits`` bits with two hashes. It never misses an id; past some
    2^bits / 4 ids it lets most others pass, so use it only before an exact join.
    """
    size = 1 << bits
    places = lambda c: [F.pmod(F.xxhash64(F.lit(k), c), F.lit(size)) for k in (1, 2)]
    shared = ids.sparkSession.sparkContext.broadcast(bit_field(ids, places(F.col(ids.columns[0])), bits))

    @F.pandas_udf("boolean")
    def may_hold(a, b):
        import pandas as pd

        return pd.Series(bits_at(shared.value, a.to_numpy(np.int64)) & bits_at(shared.value, b.to_numpy(np.int64)))

    return lambda column: may_hold(*places(column))
