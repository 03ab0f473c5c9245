"""N-gram Jaccard join: prefixes of token combinations, verified by the whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import chunks, components, forget, id_filter, mixed_bits, partitions, sketch, sketch_size, smallest_reachable, text_of, utf8_batch, word_table, written

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
BASE, RARE, FREQUENT = 0, 1, 2
INDEX = "kind int, token long, d1 long, n int, most int, size_class int, doc_id long"


def shingles(data: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of every run of ``k`` words, in order, repeats included; a text
    of fewer words is one run. Words are lower-cased (A-Z)."""
    _, _, of, h = word_table(data, bounds)
    n = len(bounds) - 1
    count = np.bincount(of, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    total = np.maximum(len(h) - k + 1, 0)
    s = np.zeros(total, np.uint64)
    for j in range(k):
        s += h[j : j + total] * _ODD[j % 8] + np.uint64(j)
    inside = of[:total] == of[k - 1 : k - 1 + total]
    row, s = of[:total][inside], mixed_bits(s[inside])
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.array([sum(int(h[first[d] + j]) * int(_ODD[j % 8]) for j in range(count[d])) + 1000003 * int(count[d]) for d in short], dtype=object)
        row = np.concatenate([row, short])
        s = np.concatenate([s, mixed_bits(np.array([int(x) & (2**64 - 1) for x in extra], np.uint64))])
    return row, s


def distinct_sets(data: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` without repeats, sorted by row and hash."""
    row, s = shingles(data, bounds, k)
    order = np.lexsort((s, row))
    row, s = row[order], s[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    return row[fresh], s[fresh]


def classes(n: int, p: int, num: int, den: int) -> list[int]:
    """The numbers of classes over which a set of size ``n`` deals its frequent tokens:
    powers of two near the prefix length, one for each length that a partner can have."""
    sizes = (-(-num * n // den), n, den * n // num)
    return sorted({1 << max(0, (m - -(-num * m // den) + 1).bit_length() - 1) for m in sizes if m > 0})


def signatures(s: np.ndarray, heat: np.ndarray, frequent: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The index keys of one set: (keys, whether each is of the frequent class, the size
    of the largest partner that a key can lead to).

    Tokens are ordered by frequency (powers of two), then hash. A partner of Jaccard
    >= num/den shares at least o = ceil(num*n/den) tokens, so the first token common to
    both is among the first p = n-o+1 of each. If that token is rare, both index it
    alone. Otherwise all common tokens are frequent: with frequent tokens dealt over c
    classes by their hash, two of the first c+1 common ones are of one class, and they
    are among the first p+c of each; so those pairs of frequent tokens of one class are
    indexed there. c grows with p, which keeps the pairs of a set in proportion to it.

    A set and a partner of m tokens must share num/(num+den) of n+m, and can share no
    more than what is left from the first common token (or the c-th after it) on, so
    the later a key's token stands, the smaller its partners are.
    """
    n = len(s)
    o = -(-num * n // den)
    p = n - o + 1
    order = np.lexsort((s, heat))
    s, hot = s[order], heat[order] >= frequent
    most = lambda at: np.minimum((n - np.maximum(at, 0)) * (num + den) // num - n, n * den // num)
    at = np.flatnonzero(~hot[:p])
    keys, kinds, sizes = [s[at]], [np.zeros(len(at), bool)], [most(at)]
    for c in classes(n, p, num, den) if hot[: p + 1].any() else ():
        if c + 1 > o:  # so small a set may share fewer: its frequent tokens alone, too
            at = np.flatnonzero(hot[:p])
            keys.append(mixed_bits(s[at] + np.uint64(1)))
            sizes.append(most(at))
            kinds.append(np.ones(len(at), bool))
        at = np.flatnonzero(hot[: p + c])
        klass = (s[at] >> np.uint64(20)).astype(np.int64) % c
        at = at[np.argsort(klass, kind="stable")]
        klass, f, step = np.sort(klass), s[at], 1
        while step < len(f):
            same = np.flatnonzero(klass[step:] == klass[:-step])
            if not len(same):
                break
            a, b = f[same], f[same + step]
            keys.append(mixed_bits(np.minimum(a, b) * _ODD[0] + np.maximum(a, b) * _ODD[1] + np.uint64(c)))
            sizes.append(most(at[same + step] - c))
            kinds.append(np.ones(len(same), bool))
            step += 1
    return np.concatenate(keys), np.concatenate(kinds), np.concatenate(sizes)


def size_classes(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Sizes by powers of den/num: partners are of one class or of neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(den / num) + 1e-9).astype(np.int32)


def shared_keys(token: np.ndarray, d1: np.ndarray, n: np.ndarray, most: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of rare keys' rows in the order (token, d1, id), those that can find a partner:
    the least id of each set, where another set has the key, is not larger than the row
    allows, and allows the row's size."""
    keep = np.ones(len(token), bool)
    keep[1:] = (token[1:] != token[:-1]) | (d1[1:] != d1[:-1])
    rows = np.flatnonzero(keep)
    for _ in range(2):
        if not len(rows):
            break
        t = token[rows]
        run = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        width = np.diff(np.r_[run, len(t)])
        least, allowed = (np.repeat(f.reduceat(x[rows], run), width) for f, x in ((np.minimum, n), (np.maximum, most)))
        rows = rows[(np.repeat(width, width) > 1) & (most[rows] >= least) & (n[rows] <= allowed)]
    t = token[rows]
    alone = np.r_[True, t[1:] != t[:-1]] & np.r_[t[1:] != t[:-1], True] if len(t) else np.zeros(0, bool)
    return rows[~alone]


def index(docs: DataFrame, k: int, num: int, den: int, bits: int) -> DataFrame:
    """A row per document (kind BASE: token is the second half of the set's digest) and
    rows of keys and sets: RARE where another set can meet it there (token is then the
    leader of the key and size class, by a hash of the ids), FREQUENT all.

    One shuffle of packed arrays. Rare keys meet by the key, frequent ones by key and
    set, so neither a frequent shingle nor a group of copies meets in a task: a rare
    key's rows are at most what its sketch class counts, and a task sends a set's keys
    once however many copies it reads.
    """
    spark = docs.sparkSession
    heats = sketch(docs, lambda data, bounds: shingles(data, bounds, k)[1], bits)
    mean = max(1.0, float(heats.mean()))
    shared = spark.sparkContext.broadcast(np.floor(np.log2(np.maximum(heats, 1) / mean + 1)).astype(np.uint8))
    frequent = 3  # seven times the mean load of a class, or more
    mask, buckets, flush_at = np.uint64((1 << bits) - 1), 4 * partitions(spark), 1 << 18

    def packed(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Rows (slot, kind, token, d1, n, most, id) by bucket, each bucket's as bytes."""
        slot, *columns = (np.concatenate(x) for x in zip(*rows, strict=True))
        bucket = (mixed_bits(slot.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
        columns = [np.ascontiguousarray(c[order]) for c in columns]
        held = np.flatnonzero(np.diff(edge))
        for a in range(0, len(held), 256):
            some = held[a : a + 256]
            blobs = [b"".join(c[edge[b] : edge[b + 1]].tobytes() for c in columns) for b in some]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "rows"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, low = shared.value, {}  # of each set sent so far, the least id
        held: list[tuple] = []
        for batch in batches:
            data, bounds = utf8_batch(batch.column(1))
            ids, known = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for a, b in chunks(bounds):
                row, s = distinct_sets(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], k)
                n = np.bincount(row, minlength=b - a)
                edge = np.concatenate(([0], np.cumsum(n)))
                sums = lambda x, edge=edge: np.diff(np.concatenate(([np.uint64(0)], np.cumsum(x, dtype=np.uint64)))[edge])
                d1, d2 = sums(mixed_bits(s ^ _ODD[2])).astype(np.int64), sums(mixed_bits(s ^ _ODD[3])).astype(np.int64)
                heat = table[(s & mask).astype(np.int64)]
                keys, kinds, sizes, owner = [], [], [], []
                for d in np.flatnonzero((n > 0) & known[a:b]).tolist():
                    if ids[a + d] >= low.get(int(d1[d]), 1 << 63):
                        continue  # a copy of a set whose keys went out with a smaller id
                    low[int(d1[d])] = int(ids[a + d])
                    x, f, m = signatures(s[edge[d] : edge[d + 1]], heat[edge[d] : edge[d + 1]], frequent, num, den)
                    keys.append(x)
                    kinds.append(f)
                    sizes.append(m)
                    owner.append(np.full(len(x), d))
                x, f, m, d = (np.concatenate(v) for v in (keys, kinds, sizes, owner)) if keys else (np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, int))
                spread = np.where(f, mixed_bits(x ^ d1[d].astype(np.uint64)), x).astype(np.int64)
                own = (d1 ^ mixed_bits(ids[a:b].astype(np.uint64)).astype(np.int64))
                base = np.where(known[a:b], BASE, BASE - 1)
                both = lambda p, q, t: np.concatenate([p, q]).astype(t)
                held.append((both(own, spread, np.int64), both(base, np.where(f, FREQUENT, RARE), np.int8), both(d2, x.astype(np.int64), np.int64), both(d1, d1[d], np.int64), both(n, n[d], np.int32), both(n, m, np.int32), both(ids[a:b], ids[a:b][d], np.int64)))
                if sum(len(h[0]) for h in held) >= flush_at:
                    yield from packed(held)
                    held = []
        if held:
            yield from packed(held)

    kinds_of = (np.int8, np.int64, np.int64, np.int32, np.int32, np.int64)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            columns: list[list[np.ndarray]] = [[] for _ in kinds_of]
            for blob in blobs:
                count, at = len(blob) // 33, 0
                for c, t in zip(columns, kinds_of, strict=True):
                    c.append(np.frombuffer(blob, t, count, at))
                    at += count * np.dtype(t).itemsize
            kind, token, d1, n, most, ids = (np.concatenate(c) for c in columns)
            rare = np.flatnonzero(kind == RARE)
            rare = rare[np.lexsort((ids[rare], d1[rare], token[rare]))]
            rare = rare[shared_keys(token[rare], d1[rare], n[rare], most[rare], ids[rare])]
            # a row in its own size class and in the one below; the least hash of an id leads
            sc = size_classes(n[rare], num, den)
            at, sc = np.r_[rare, rare], np.r_[sc, sc - 1]
            if len(at):
                rank = mixed_bits(ids[at].astype(np.uint64))
                order = np.lexsort((rank, sc, token[at]))
                at, sc = at[order], sc[order]
                run = np.flatnonzero(np.r_[True, (token[at][1:] != token[at][:-1]) | (sc[1:] != sc[:-1])])
                width = np.diff(np.r_[run, len(at)])
                leader = np.repeat(ids[at][run], width)
                pick = np.repeat(width, width) > 1
                member = np.unique(np.stack([leader[pick], sc[pick], ids[at][pick], n[at][pick]]), axis=1)
                yield batch_of(np.full(member.shape[1], RARE), member[0], member[0], member[3], member[3], member[1], member[2])
            rest = np.flatnonzero(kind == FREQUENT)
            rest = rest[np.lexsort((ids[rest], d1[rest], token[rest]))]
            rest = rest[np.r_[True, (token[rest][1:] != token[rest][:-1]) | (d1[rest][1:] != d1[rest][:-1])]] if len(rest) else rest
            yield batch_of(kind[rest], token[rest], d1[rest], n[rest], most[rest], size_classes(n[rest], num, den), ids[rest])
            base = np.flatnonzero(kind <= BASE)
            yield batch_of(np.full(len(base), BASE), token[base], d1[base], n[base], most[base], np.zeros(len(base)), ids[base], kind[base] < BASE)

        def batch_of(kind, token, d1, n, most, sc, ids, gone=None) -> pa.RecordBatch:
            i32, i64 = (lambda x: pa.array(np.asarray(x).astype(np.int32))), (lambda x, m=None: pa.array(np.asarray(x).astype(np.int64), mask=m))
            return pa.RecordBatch.from_arrays([i32(kind), i64(token), i64(d1), i32(n), i32(most), i32(sc), i64(ids, gone)], names=["kind", "token", "d1", "n", "most", "size_class", "doc_id"])

        now, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now and blobs:
                    yield from rows(blobs)
                    blobs = []
                now = bucket
                blobs.append(blob.as_py())
        if blobs:
            yield from rows(blobs)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = source.mapInArrow(emit, "bucket int, rows binary").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    return written(rows.mapInArrow(meet, INDEX))


def links_within(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``left`` x ``right`` (or within ``left``, if one array) with Jaccard
    of their sets >= num/den. Tokens of one set only are left out; the others are
    multiplied out in slices, so memory does not grow with their number."""
    rows = np.union1d(left, right)
    place = np.zeros(int(rows.max()) + 1, np.int64)
    place[rows] = np.arange(len(rows))
    size = np.array([len(sets[r]) for r in rows])
    flat = np.concatenate([sets[r] for r in rows])
    owner = np.repeat(np.arange(len(rows)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    edge = np.r_[True, flat[1:] != flat[:-1]] if len(flat) else np.zeros(0, bool)
    width = np.diff(np.r_[np.flatnonzero(edge), len(flat)])
    many = np.repeat(width > 1, width)
    owner, token = owner[many], np.cumsum(edge[many]) - 1
    both = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, int(token[-1]) + 1 if len(token) else 0, 4096):
        lo, hi = np.searchsorted(token, (a, a + 4096))
        m = np.zeros((len(rows), int(token[hi - 1]) - a + 1), np.float32)
        m[owner[lo:hi], token[lo:hi] - a] = 1
        both += m[place[left]] @ m[place[right]].T
    both = both.astype(np.int64)
    near = (both > 0) & (den * both >= num * (size[place[left]][:, None] + size[place[right]][None, :] - both))
    if left is right:
        near = np.triu(near, 1)
    p, q = np.nonzero(near)
    return left[p], right[q]


def jaccard_join(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, sketch_bits: int | None = None, filter_bits: int = 26, block: int = 512, block_size: int = 1 << 19) -> DataFrame:
    """Link texts whose sets of ``k``-word shingles have Jaccard >= num/den: doc_id,
    n_shingles, component_id (the least doc_id reachable by links).

    Equal sets are one node, the least id among them. Sets that share an index key
    (``signatures``) and are of one or neighbouring size classes join the group of that
    key's leader; keys of near copies mostly have one leader, so a set is in few groups.
    All sets of a group are compared in a task by their whole texts, as a product of
    incidence matrices: no pair is emitted, only the smallest id that a row reaches in
    the group. A group of more than ``block`` texts, or ``block_size`` shingles, is cut
    into blocks by a hash and each pair of blocks is compared by itself.

    Cases: a null or empty text, or one without words, has no shingles and links with
    nothing; a null id links with nothing and has a null component_id; rows that repeat
    an id are one node, which links as each of their texts does; an empty table gives
    an empty result; other columns are ignored. Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    found = index(docs, k, num, den, sketch_size(docs) if sketch_bits is None else sketch_bits)
    base = found.where(F.col("kind") == BASE).select("doc_id", "n", "d1", F.col("token").alias("d2"))
    # what is joined is written before, here and below: a frequent key is then rows of a plain join, which can be split
    groups = written(base.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    rows = base.join(groups, ["n", "d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep"))
    # an id that stands for several sets links the groups of all of them
    several = base.where("n > 0").groupBy("doc_id").agg(F.min("d1").alias("a"), F.max("d1").alias("b")).where("a <> b").select("doc_id")
    bridges = rows.where("doc_id <> rep").join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    rank = lambda c: F.xxhash64(c)
    keyed = found.where(F.col("kind") == FREQUENT).groupBy("token", "d1", "n", "size_class").agg(F.min("doc_id").alias("id"), F.max("most").alias("most"))
    bounds = written(keyed.groupBy("token").agg(F.min("n").alias("least"), F.max("most").alias("allowed"), F.count(F.lit(1)).alias("c")).where("c > 1"))
    able = keyed.join(bounds, "token").where("most >= least and n <= allowed").select("token", "id", "n", F.explode(F.array("size_class", F.col("size_class") - 1)).alias("size_class"))
    able = written(able)
    leads = written(able.groupBy("token", "size_class").agg(F.min_by("id", F.struct(rank("id"), "id")).alias("leader"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    hot = able.join(leads, ["token", "size_class"]).select("leader", "size_class", "id", "n")
    rare = found.where(F.col("kind") == RARE).select(F.col("token").alias("leader"), "size_class", F.col("doc_id").alias("id"), "n")
    member = written(rare.unionByName(hot).distinct())
    for done in (able, leads, bounds):
        forget(done)
    size = written(member.groupBy("leader", "size_class").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("total")).where("c > 1"))
    cut = F.greatest(F.ceil(F.col("c") / block), F.ceil(F.col("total") / block_size)).cast("int")
    member = member.join(size.select("leader", "size_class", cut.alias("cut")), ["leader", "size_class"])
    ids = member.select("id").distinct()
    may = id_filter(ids, filter_bits)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text")).where(F.col("id").isNotNull())
    texts = texts.where(may(F.col("id"))).join(ids, "id", "left_semi").select("id", "text").distinct()
    own = F.pmod(F.xxhash64("id"), F.col("cut")).cast("int")
    placed = (
        member.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
        .select("leader", "size_class", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id")
        .join(texts, "id")
        .repartition(partitions(spark), "leader", "size_class", "i", "j")
        .sortWithinPartitions("leader", "size_class", "i", "j")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups_of(t: pa.Table) -> np.ndarray:
            key = [t.column(c).to_numpy() for c in ("leader", "size_class", "i", "j")]
            return np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in key], axis=0), True])

        def within(t: pa.Table) -> pa.RecordBatch:
            ids, i, j, own = (t.column(c).to_numpy() for c in ("id", "i", "j", "own"))
            data, bounds = utf8_batch(t.column("text").combine_chunks())
            parts = [distinct_sets(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], k) for a, b in chunks(bounds)]
            sets = [x for (row, s), (a, b) in zip(parts, chunks(bounds), strict=True) for x in np.split(s, np.cumsum(np.bincount(row, minlength=b - a))[:-1])]
            edge, node, low = groups_of(t), [], []
            for a, b in zip(edge, edge[1:], strict=False):
                if b - a < 2:
                    continue
                if b - a == 2:
                    both = len(np.intersect1d(sets[a], sets[a + 1], assume_unique=True))
                    near = both > 0 and den * both >= num * (len(sets[a]) + len(sets[a + 1]) - both)
                    p, q = ((np.array([a]), np.array([a + 1])) if near else (np.zeros(0, int),) * 2)
                elif i[a] == j[a]:
                    every = np.arange(a, b)
                    p, q = links_within(sets, every, every, num, den)
                else:
                    left, right = a + np.flatnonzero(own[a:b] == i[a]), a + np.flatnonzero(own[a:b] == j[a])
                    p, q = links_within(sets, left, right, num, den) if len(left) and len(right) else (np.zeros(0, int),) * 2
                if len(p):
                    label = smallest_reachable(ids[a:b], p - a, q - a)
                    met = np.unique(np.r_[p, q]) - a
                    node.append(ids[a:b][met])
                    low.append(label[met])
            x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (node, low))
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, t]) if rest is not None else t
            if rest.num_rows < 2 or rest.nbytes < 1 << 20:
                continue
            cut = int(groups_of(rest)[-2])  # the last group may go on
            if cut:
                yield within(rest.slice(0, cut))
                rest = rest.slice(cut).combine_chunks()
        if rest is not None and rest.num_rows:
            yield within(rest)

    links = written(placed.mapInArrow(compare, "a long, b long").unionByName(bridges))
    labels = components(links)
    forget(size)
    forget(links)
    final = rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    return final.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))


def one_of_each_group(docs: DataFrame, filter_bits: int = 26, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its component, unchanged. Only
    rows that the filter of dropped ids lets through are shuffled."""
    gone = written(jaccard_join(docs, filter_bits=filter_bits, **options).where("doc_id <> component_id").select("doc_id").distinct())
    may = F.coalesce(id_filter(gone, filter_bits)(F.col("doc_id").cast("long")), F.lit(False))
    return docs.where(~may).unionByName(docs.where(may).join(gone, "doc_id", "left_anti").select(*docs.columns))
