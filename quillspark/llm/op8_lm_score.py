"""LM scoring: masked pseudo-likelihood under a bidirectional window network.

The network has a dense part, which predicts each byte of a word from the bytes on both
sides of it, and a sparse one: a weight for each word in its window of two words before
and two after, seen in the corpus, which raises the probability that the dense part gives
the word there. Both are trained on every window of all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import chunks, forget, mixed_bits, partitions, sketch, sketch_size, text_of, utf8_batch, word_table, written

#: Tokens are the bytes of the UTF-8 text; one more stands beyond either end of a text.
EDGE, TOKENS, REACH = 256, 257, 2
PLACES = 2 * REACH


@dataclass
class Network:
    """Embeddings of the tokens at each place of the window, one hidden layer, softmax."""

    embed: np.ndarray  # PLACES x TOKENS x hidden
    hidden: np.ndarray  # hidden
    out: np.ndarray  # hidden x 256
    bias: np.ndarray  # 256

    @staticmethod
    def start(hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        f = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        return Network(f(PLACES, TOKENS, hidden), np.zeros(hidden, np.float32), f(hidden, 256), np.zeros(256, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.hidden, self.out, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def filled(self, flat: np.ndarray) -> Network:
        new, at = [], 0
        for p in self.parts():
            new.append(np.asarray(flat[at : at + p.size], np.float32).reshape(p.shape))
            at += p.size
        return Network(*new)

    def forward(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden values and log-probabilities of all 256 tokens, given the 4 around."""
        h = np.tanh(sum(self.embed[j][around[:, j]] for j in range(PLACES)) + self.hidden)
        z = h @ self.out + self.bias
        z -= z.max(axis=1, keepdims=True)
        return h, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def log_probs(self, around: np.ndarray, token: np.ndarray, block: int = 8192) -> np.ndarray:
        got = np.empty(len(token), np.float32)
        for a in range(0, len(token), block):
            got[a : a + block] = np.take_along_axis(self.forward(around[a : a + block])[1], token[a : a + block, None], 1)[:, 0]
        return got


def windows(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit key per byte: the two tokens before, the two after (9 bits each), itself."""
    n = len(bounds) - 1
    lengths = np.diff(bounds)
    wide = np.full(len(data) + 2 * REACH * n, EDGE, np.uint64)
    at = np.arange(len(data)) + np.repeat(np.arange(n) * 2 * REACH + REACH, lengths)
    wide[at] = data
    key = np.zeros(len(data), np.uint64)
    for j in (-2, -1, 1, 2):
        key = key << np.uint64(9) | wide[at + j]
    return key << np.uint64(8) | data.astype(np.uint64)


def unpacked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens around, and the token, of window keys."""
    keys = keys.astype(np.uint64)
    around = np.stack([(keys >> np.uint64(s) & np.uint64(511)).astype(np.int64) for s in (35, 26, 17, 8)], axis=1)
    return around, (keys & np.uint64(255)).astype(np.int64)


def count_windows(docs: DataFrame) -> DataFrame:
    """(key, n): how often each window occurs in all whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8_batch(batch.column(0))
            keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for a, b in chunks(bounds, 1 << 23):
                k, n = np.unique(windows(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]), return_counts=True)
                merged, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
                keys, counts = merged, np.bincount(at, np.concatenate([counts, n]), len(merged)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["key", "n"])

    return docs.select(text_of().alias("text")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def gradients(net: Network, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """Of the loss -sum(w * log p(y | x)), by part of the network."""
    h, logp = net.forward(x)
    d = np.exp(logp)
    d[np.arange(len(y)), y] -= 1
    d *= w[:, None]
    back = (d @ net.out.T) * (1 - h * h)
    embed = np.zeros_like(net.embed)
    for j in range(PLACES):
        order = np.argsort(x[:, j], kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(x[order, j]) > 0])
        embed[j][x[order, j][at]] = np.add.reduceat(back[order], at, axis=0)
    return [embed, back.sum(0), h.T @ d, d.sum(0)]


def local_pass(net: Network, keys: np.ndarray, counts: np.ndarray, rate: float, block: int, passes: int, seed: int) -> Network:
    """Passes of Adam over windows weighted by their counts."""
    around, token = unpacked(keys)
    weight = np.sqrt(counts / counts.mean()).astype(np.float32)  # damped: the tail of windows also teaches
    rng = np.random.default_rng(seed)
    first, second = ([np.zeros_like(p) for p in net.parts()] for _ in range(2))
    net, step = net.filled(net.flat()), 0
    for _ in range(passes):
        order = rng.permutation(len(keys))
        for a in range(0, len(order), block):
            rows, step = order[a : a + block], step + 1
            for p, g, m, v in zip(net.parts(), gradients(net, around[rows], token[rows], weight[rows] / weight[rows].sum()), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def train(counts: DataFrame, hidden: int = 24, rounds: int = 3, rate: float = 0.01, block: int = 2048, passes: int = 2, shard_windows: int = 1 << 17, seed: int = 0) -> Network | None:
    """Fit the dense part to all windows of the corpus: ``rounds`` times, each shard makes
    ``passes`` over its windows from the common weights, and the weights are averaged by
    the number of windows. A window's shard is a hash of its key and there are as many
    shards as windows ask for (``shard_windows`` each), so neither the result nor a
    task's memory depends on how the session partitions. The averages are sums over all
    shards; the driver gets one number per weight (about 31,000), whatever the corpus.
    """
    net, shards = Network.start(hidden, seed), -(-counts.count() // shard_windows)
    if not shards:
        return None
    dealt = counts.select("key", "n", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))

    def learner(now: np.ndarray, k: int):
        def learn(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("key")  # the same passes whatever order the rows came in
            after = local_pass(Network.start(hidden, seed).filled(now), group["key"].to_numpy(), group["n"].to_numpy(float), rate * 0.5**k, block, passes, k).flat()
            return pd.DataFrame({"i": np.arange(len(after)), "v": after.astype(float) * len(group), "w": float(len(group))})

        return learn

    for k in range(rounds):
        now = net.flat()
        summed = dealt.groupBy("shard").applyInPandas(learner(now, k), "i int, v double, w double").groupBy("i").agg((F.sum("v") / F.sum("w")).alias("v")).collect()
        flat = np.zeros(len(now))
        flat[[r["i"] for r in summed]] = [r["v"] for r in summed]
        net = net.filled(flat)
    return net


# ---- the sparse part: words in their windows -----------------------------------------

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)
#: Log-probabilities are told apart by 1/STEPS, down to LOWEST / STEPS.
STEPS, LOWEST = 32, 65535


def word_windows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts: starts, ends, row, and a 64-bit hash of each with the two words
    before and the two after it (or the ends of the text)."""
    starts, ends, of, h = word_table(data, bounds, lower=False)
    n, place = len(h), np.arange(len(h))
    key = h * _ODD[0]
    for j, d in enumerate((-2, -1, 1, 2), 1):
        at = np.clip(place + d, 0, max(n - 1, 0))
        inside = (at == place + d) & (of[at] == of) if n else np.zeros(0, bool)
        key += mixed_bits(np.where(inside, h[at], np.uint64(j)) * _ODD[j] + np.uint64(j))
    return starts, ends, of, mixed_bits(key)


def gains(log_prob: np.ndarray, n: np.ndarray, decay: float) -> np.ndarray:
    """By how much the trained weight of a window that occurs ``n`` times raises the
    log-probability of its word over that of the dense part.

    The weight w maximises n * log p - decay/2 * w^2 with p = sigmoid(logit(p0) + w): the
    root of n * (1 - p) = decay * w, found by halving."""
    low = np.minimum(log_prob, -1e-6)
    logit = low - np.log(-np.expm1(low))
    lower, upper = np.zeros(len(low)), np.asarray(n, float) / decay
    for _ in range(50):
        w = (lower + upper) / 2
        more = n / (1 + np.exp(np.minimum(logit + w, 700))) > decay * w
        lower, upper = np.where(more, w, lower), np.where(more, upper, w)
    return -np.logaddexp(0, -(logit + lower)) - low


class Scorer:
    """The log-probabilities of bytes by the dense part; windows once scored are kept."""

    def __init__(self, net: Network | None, most: int = 1 << 21):
        self.net, self.most = net, most
        self.seen, self.logs = np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        keys, at = np.unique(windows(data, bounds), return_inverse=True)
        place = np.searchsorted(self.seen, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.seen)
        known[inside] = self.seen[place[inside]] == keys[inside]
        got = np.empty(len(keys), np.float32)
        got[known] = self.logs[place[known]]
        if not known.all():
            got[~known] = self.net.log_probs(*unpacked(keys[~known]))
        if len(self.seen) < self.most:
            seen, logs = np.concatenate([self.seen, keys[~known]]), np.concatenate([self.logs, got[~known]])
            order = np.argsort(seen, kind="stable")
            self.seen, self.logs = seen[order], logs[order]
        return got[at.ravel()].astype(float)


def score_documents(docs: DataFrame, net: Network | None, decay: float = 0.1, hot: int = 1000, sketch_bits: int | None = None) -> DataFrame:
    """doc_id, n_tokens (words, and bytes of white space), log_prob (the sum over all of
    them) and mean_log_prob.

    Each task scores the bytes of its texts and counts every window as if it occurred
    once. Windows go to buckets by their key, in packed arrays of ten bytes a word, and
    only those that occur again send something back: what their count adds, summed by
    document. A window of a class that a sketch of all windows counts ``hot`` times, or
    eight times the mean, takes that count and stays where it is, so no key gathers an
    unbounded number of rows.
    """
    spark = docs.sparkSession
    heats = sketch(docs, lambda data, bounds: word_windows(data, bounds)[3], sketch_size(docs) if sketch_bits is None else sketch_bits)
    hot = max(hot, int(8 * heats.mean()))
    shared = spark.sparkContext.broadcast(np.where(heats >= hot, np.rint(8 * np.log2(np.maximum(heats, 1))), 0).astype(np.uint8))  # powers of 2^(1/8)
    mask, buckets, most_docs, flush_at = np.uint64(len(heats) - 1), 4 * partitions(spark), 1 << 16, 1 << 20
    kinds = (np.int64, np.int64, np.uint8, np.int64, np.float64)
    rows = "bucket int, windows binary, docs binary"

    def told(held: list[tuple], base: int) -> Iterator[pa.RecordBatch]:
        """Windows by bucket, and the documents that they are of in one bucket of their own."""
        key, q, doc, ids, known, tokens, value = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = (key >> np.uint64(48)).astype(np.int64) * buckets >> 16
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
        short = np.ascontiguousarray(key[order].view(np.uint8).reshape(-1, 8)[:, :6])  # the rest tells the bucket
        q, doc = q[order].astype(np.uint16), doc[order].astype(np.uint16)
        uid = base + np.arange(len(ids))
        blobs = [np.int64(base).tobytes() + short[a:b].tobytes() + q[a:b].tobytes() + doc[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)]
        own = int(mixed_bits(np.array([base], np.uint64))[0] % np.uint64(buckets))
        packed = b"".join(x.astype(t).tobytes() for x, t in zip((uid, ids, known, tokens, value), kinds, strict=True))
        for a in range(0, buckets, 256):
            part = [k for k in range(a, min(a + 256, buckets)) if edge[k] < edge[k + 1] or k == own]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([blobs[k] for k in part], pa.binary()), pa.array([packed if k == own else None for k in part], pa.binary())], names=["bucket", "windows", "docs"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        score, table, once = Scorer(net), shared.value, gains(-np.arange(LOWEST + 1) / STEPS, np.ones(LOWEST + 1), decay)
        base, held, docs_held, words_held = TaskContext.get().partitionId() << 40, [], 0, 0
        for batch in batches:
            data, bounds = utf8_batch(batch.column(1))
            ids, known = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for a, b in chunks(bounds, 1 << 21):
                part, at = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                if held and (docs_held + b - a > most_docs or words_held >= flush_at):
                    yield from told(held, base)
                    base, held, docs_held, words_held = base + docs_held, [], 0, 0
                n = b - a
                log = score(part, at) if len(part) else np.zeros(0)
                upto = np.r_[0.0, np.cumsum(log)]
                starts, ends, of, key = word_windows(part, at)
                q = np.minimum(np.rint((upto[starts] - upto[ends]) * STEPS), LOWEST).astype(np.int64)
                heat = table[(key & mask).astype(np.int64)]
                gain = once[q]
                warm = np.flatnonzero(heat)
                if len(warm):
                    pairs, where = np.unique(q[warm] * 256 + heat[warm], return_inverse=True)
                    gain[warm] = gains(-(pairs >> 8) / STEPS, 2.0 ** ((pairs & 255) / 8), decay)[where.ravel()]
                value = upto[at[1:]] - upto[at[:-1]] + np.bincount(of, gain, n)
                tokens = np.diff(at) - np.bincount(of, ends - starts, n).astype(np.int64) + np.bincount(of, minlength=n)
                cold = np.flatnonzero(heat == 0)
                held.append((key[cold], q[cold], docs_held + of[cold], ids[a:b], known[a:b], tokens, value))
                docs_held, words_held = docs_held + n, words_held + len(cold)
        if held:
            yield from told(held, base)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["uid", "doc_id", "n_tokens", "value"]

        def corrected(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            keys, q, uid = [], [], []
            for blob in blobs:
                n = (len(blob) - 8) // 10
                wide = np.zeros((n, 8), np.uint8)
                wide[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, 8).reshape(n, 6)
                keys.append(wide.view(np.int64).ravel())
                q.append(np.frombuffer(blob, np.uint16, n, 8 + 6 * n))
                uid.append(np.frombuffer(blob, np.int64, 1)[0] + np.frombuffer(blob, np.uint16, n, 8 + 8 * n).astype(np.int64))
            key, q, uid = np.concatenate(keys), np.concatenate(q).astype(np.int64), np.concatenate(uid)
            _, at, count = np.unique(key, return_inverse=True, return_counts=True)
            n = count[at.ravel()]
            again = np.flatnonzero(n > 1)
            if len(again):
                pairs, at = np.unique(np.stack([q[again], n[again]]), axis=1, return_inverse=True)
                low = -pairs[0] / STEPS
                more = gains(low, pairs[1].astype(float), decay) - gains(low, np.ones(len(low)), decay)
                who, of = np.unique(uid[again], return_inverse=True)
                none = np.ones(len(who), bool)
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(who, mask=none), pa.array(who, mask=none), pa.array(np.bincount(of.ravel(), more[at.ravel()], len(who)))], names=names)

        now, blobs = None, []
        for batch in batches:
            for bucket, blob, packed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if bucket != now and blobs:
                    yield from corrected(blobs)
                    blobs = []
                now = bucket
                blobs.append(blob.as_py())
                if packed.is_valid:
                    raw, n, at, columns = packed.as_py(), len(packed.as_py()) // 33, 0, []
                    for t in kinds:
                        columns.append(np.frombuffer(raw, t, n, at))
                        at += n * np.dtype(t).itemsize
                    uid, ids, known, tokens, value = columns
                    yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(ids, mask=known == 0), pa.array(tokens), pa.array(value)], names=names)
        if blobs:
            yield from corrected(blobs)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    dealt = source.mapInArrow(emit, rows).repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    summed = dealt.mapInArrow(meet, "uid long, doc_id long, n_tokens long, value double").groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("value").alias("log_prob"))
    return summed.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))


def lm_score(docs: DataFrame, decay: float = 0.1, hot: int = 1000, **options) -> DataFrame:
    """Score every document by the network trained on all of them: doc_id, n_tokens,
    log_prob, mean_log_prob.

    Pseudo-likelihood: the dense part predicts each byte from the two before and the two
    after it, which gives each word a probability; the sparse part raises it where the
    word stands in a window of two words on either side that the corpus has, the more
    the oftener it does. The logs of the words' probabilities, and of the bytes of white
    space between them, are summed. ``decay`` is the weight decay of the sparse part.

    Cases: a null or empty text has 0 tokens, log_prob 0 and a null mean; ids may be
    null or repeat (each row counts as a document); an empty table, or one of empty
    texts, needs no network; other columns are ignored.
    """
    counts = written(count_windows(docs))
    net = train(counts, **options)
    forget(counts)
    return score_documents(docs, net, decay, hot)
