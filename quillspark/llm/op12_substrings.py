"""Substring dedup: passages that recur anywhere in the corpus, found by automata of phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import bit_field, bits_at, chunks, forget, mixed_bits, text_of, utf8_batch, word_table, written

#: Consecutive words that count as a passage.
WINDOW = 35
#: Words of the phrase that stands for a window among others.
GRAM = 8
#: Characters of the documents that share an automaton: bounds a task's memory, not the result.
SHARD_CHARS = 2_000_000

_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 28) - 1)


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive word hashes, by doubling widths."""
    m = len(h) - size + 1
    out, have, piece, width = None, 0, h, 1
    while True:
        power = np.uint64(pow(_BASE, width, 1 << 64))
        if size & width:
            out = piece[:m] if out is None else out * power + piece[have : have + m]
            have += width
        if have == size:
            return mixed_bits(out)
        piece = piece[:-width] * power + piece[width:]
        width *= 2


class Windows:
    """The windows of a batch of texts, in runs.

    Every window has an anchor, its leftmost least phrase of ``gram`` words; equal
    windows have equal anchors at the same place in them. Consecutive windows with one
    anchor are a run, whose words are a passage. ``at`` is the first word of each
    window, ``hash`` its hash; run i holds windows first[i] to first[i] + count[i] and
    has the anchor's hash ``key`` and a hash ``passage`` of all its windows.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, size: int, gram: int):
        self.starts, self.ends, self.row, h = word_table(data, bounds, lower=False)
        self.words, self.size = h, size
        n = len(h)
        if n < size:
            self.at = self.first = self.count = np.zeros(0, np.int64)
            self.hash = self.key = self.passage = np.zeros(0, np.uint64)
            return
        phrase, span = grams(h, gram), size - gram + 1
        least, have = (phrase & ~_PLACE) | np.arange(len(phrase), dtype=np.uint64), 1
        while have < span:
            step = min(have, span - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        self.at = np.flatnonzero(self.row[: n - size + 1] == self.row[size - 1 :])
        self.hash = grams(h, size)[self.at]
        anchor = (least[self.at] & _PLACE).astype(np.int64)
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(self.at) > 1)
        self.first = np.flatnonzero(new)
        self.count = np.diff(np.append(self.first, len(anchor)))
        self.key = phrase[anchor[self.first]]
        total = np.append(np.uint64(0), np.cumsum(self.hash))
        self.passage = self.named(total, self.first, self.count)

    @staticmethod
    def named(total: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The hash of ``count`` windows from ``first`` on, by sums of window hashes."""
        return mixed_bits(total[first + count] - total[first] + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a key in a field of 2^bits, by different bits of it."""
    return (key >> np.uint64(64 - bits)).astype(np.int64), (key >> np.uint64(64 - 2 * bits) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _field(keys: DataFrame, bits: int):
    one = F.call_function("shiftrightunsigned", F.col("key"), F.lit(64 - bits))
    two = F.call_function("shiftrightunsigned", F.col("key"), F.lit(64 - 2 * bits)).bitwiseAND((1 << bits) - 1)
    return keys.sparkSession.sparkContext.broadcast(bit_field(keys, [one, two], bits))


def passages_of(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """A row (key, passage) for each run of windows in ``docs`` (shard, id, text)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8_batch(batch.column(0))
            for a, b in chunks(bounds):
                w = Windows(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], size, gram)
                yield pa.RecordBatch.from_arrays([pa.array(w.key.view(np.int64)), pa.array(w.passage.view(np.int64))], names=["key", "passage"])

    return docs.select("text").mapInArrow(run, "key long, passage long")


def candidates(docs: DataFrame, keys: DataFrame, size: int, gram: int) -> DataFrame:
    """What may recur, and where: rows (shard, key, part), repeats included.

    Of a run whose key occurs in one passage only the part is the passage, of other
    recurring keys every window. ``keys`` is (key, mixed). Fields of bits, of 32 MB at
    most, pass over most keys that are not among them. What they let through by chance
    is counted like the rest: a key that is let through is so wherever it occurs.
    """
    import pyarrow as pa

    bits = min(28, max(16, int(np.ceil(np.log2(8 * keys.count() + 1)))))
    known, mixed = _field(keys.select("key"), bits), _field(keys.where("mixed").select("key"), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = batch.column(0).to_numpy()
            data, bounds = utf8_batch(batch.column(1))
            for a, b in chunks(bounds):
                w = Windows(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], size, gram)
                one, two = places(w.key, bits)
                seen = bits_at(known.value, one) & bits_at(known.value, two)
                each = seen & bits_at(mixed.value, one) & bits_at(mixed.value, two)
                whole, every = np.flatnonzero(seen & ~each), np.flatnonzero(np.repeat(each, w.count))
                key = np.concatenate((w.key[whole], np.repeat(w.key[each], w.count[each])))
                part = np.concatenate((w.passage[whole], w.hash[every]))
                home = shard[a + w.row[w.at[np.concatenate((w.first[whole], every))]]] if len(key) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(part.view(np.int64))], names=["shard", "key", "part"])

    return docs.select("shard", "text").mapInArrow(run, "shard int, key long, part long")


class Confirmed:
    """The confirmed (key, part) of a shard."""

    def __init__(self, key: np.ndarray, part: np.ndarray):
        order = np.argsort(part, kind="stable")
        self.key, self.part, self.keys = key[order], part[order], np.unique(key)

    def holds(self, key: np.ndarray, part: np.ndarray) -> np.ndarray:
        if not len(self.part):
            return np.zeros(len(part), bool)
        at = np.minimum(np.searchsorted(self.part, part), len(self.part) - 1)
        return (self.part[at] == part) & (self.key[at] == key)


def phrases(w: Windows, confirmed: Confirmed) -> tuple[np.ndarray, np.ndarray]:
    """Of each confirmed passage of a shard one occurrence, as first window and number of
    windows: whole runs, and of runs in which some windows recur the first and last
    window of each stretch that does (they overlap, so both cover the stretch)."""
    whole = confirmed.holds(w.key, w.passage)
    some = np.flatnonzero(np.isin(w.key, confirmed.keys) & ~whole)
    runs = np.flatnonzero(whole)
    runs = runs[np.unique(w.passage[runs], return_index=True)[1]]
    count = w.count[some]
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(w.first[some], count) + offset
    hit = confirmed.holds(np.repeat(w.key[some], count), w.hash[at])
    before, after = np.zeros(len(hit), bool), np.zeros(len(hit), bool)
    before[1:] = hit[:-1] & (offset[1:] > 0)
    after[:-1] = hit[1:] & (offset[1:] > 0)
    rims = at[hit & ~(before & after)]
    rims = rims[np.unique(w.hash[rims], return_index=True)[1]]
    return np.concatenate((w.first[runs], rims)), np.concatenate((w.count[runs], np.ones(len(rims), np.int64)))


def covered(w: Windows, confirmed: Confirmed) -> np.ndarray:
    """Which words of a shard's documents lie in a confirmed passage.

    A word is one character of an alphabet of a million, a document a string of them.
    The automaton of the confirmed passages reads all documents of the shard; a hit
    counts if the hashes of its windows are those of the passage.
    """
    import ahocorasick

    inside = np.zeros(len(w.words) + 1, np.int64)
    first, count = phrases(w, confirmed)
    if not len(first):
        return inside[:-1].astype(bool)
    code = (w.words % np.uint64(1_000_000)).astype(np.uint32) + np.uint32(1)
    code[code >= 0xD800] += np.uint32(0x800)
    spot = np.arange(len(code)) + w.row  # a separator after each document
    line = np.full(int(spot[-1]) + 1, 0x10FFFF, np.uint32)
    line[spot] = code
    text, back = line.tobytes().decode("utf-32-le"), np.cumsum(line != 0x10FFFF) - 1
    begin = spot[w.at[first]]
    stop = spot[w.at[first] + count - 1 + w.size - 1] + 1
    automaton = ahocorasick.Automaton()
    for i, (a, b) in enumerate(zip(begin.tolist(), stop.tolist(), strict=True)):
        automaton.add_word(text[a:b], i)
    automaton.make_automaton()
    hits = np.fromiter((x for hit in automaton.iter(text) for x in hit), np.int64).reshape(-1, 2)
    phrase, last = hits[:, 1], back[hits[:, 0]]
    window = np.full(len(w.words), -1)
    window[w.at] = np.arange(len(w.at))
    begins = window[last - (count[phrase] + w.size - 2)]
    total = np.append(np.uint64(0), np.cumsum(w.hash))
    good = w.named(total, begins, count[phrase]) == w.named(total, first, count)[phrase]
    np.add.at(inside, w.at[begins[good]], 1)
    np.add.at(inside, last[good] + 1, -1)
    return np.cumsum(inside[:-1]) > 0


def _kept(data: np.ndarray, w: Windows, gone: np.ndarray, n: int):
    """The words that stay of each text, joined by one space, as an Arrow column."""
    import pyarrow as pa

    starts, lengths, row = w.starts[~gone], (w.ends - w.starts)[~gone], w.row[~gone]
    joined = np.zeros(len(row), np.int64)
    joined[1:] = row[1:] == row[:-1]
    stops = np.cumsum(lengths + joined)
    out = np.full(int(stops[-1]) if len(stops) else 0, 32, np.uint8)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(stops - lengths, lengths) + at] = data[np.repeat(starts, lengths) + at]
    bounds = np.append(0, np.cumsum(np.bincount(row, lengths + joined, n))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(bounds.tobytes()), pa.py_buffer(out.tobytes()))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_words``, ``n_removed`` and ``kept``, its
    words without those in a window of ``window`` consecutive words that also starts
    anywhere else, in another document or in the same one, joined by one space.

    Recurring passages are confirmed by counting: of every run of windows the anchor is
    counted, then, for anchors that recur, the passage, or each window where an anchor
    lies in different passages. Copies combine before the shuffle and no key gathers
    rows, so a passage that most documents share is one row a shard. Shards are
    documents of some ``shard_chars`` characters; each compiles the passages confirmed
    for it into an automaton of its own and streams its documents through it, so that
    the work is proportional to the corpus.

    Cases: a null or empty text has no words and is kept as ""; texts of fewer words than
    a window keep all; null and repeated ids are rows of their own; rows repeated in
    full remove each other's windows, none stays; an empty table has no rows; other
    columns are ignored, whatever their names.
    """
    import pyarrow as pa

    text = text_of(text_col)
    chars = docs.select(F.sum(F.length(text)).alias("n")).first()["n"] or 0
    shards = max(1, -(-chars // shard_chars))
    rows = docs.select(F.pmod(F.xxhash64(F.col(f"`{id_col}`"), text), F.lit(shards)).cast("int").alias("shard"), F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    counted = passages_of(rows, window, gram).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("passage").alias("a"), F.max("passage").alias("b"))
    keys = written(counted.where("n > 1").select("key", (F.col("a") != F.col("b")).alias("mixed")))
    found = written(candidates(rows, keys, window, gram).groupBy("shard", "key", "part").agg(F.count(F.lit(1)).alias("n")))
    forget(keys)
    twice = found.groupBy("key", "part").agg(F.sum("n").alias("n")).where("n > 1").select("key", "part")
    confirmed = found.join(twice, ["key", "part"], "left_semi").select("shard", "key", "part")
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return pa.table({"id": mine.column("id"), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
        whole = pa.chunked_array([pa.concat_arrays(mine.column("text").cast(pa.large_string()).chunks)])
        data, bounds = utf8_batch(whole.chunk(0))
        w, n = Windows(data, bounds, window, gram), mine.num_rows
        part = lambda name: theirs.column(name).to_numpy().view(np.uint64)
        gone = covered(w, Confirmed(part("key"), part("part")))
        kept = _kept(data, w, gone, n).cast(pa.string())
        return pa.table({"id": mine.column("id"), "n_words": np.bincount(w.row, minlength=n), "n_removed": np.bincount(w.row[gone], minlength=n), "kept": kept})

    out = rows.groupBy("shard").cogroup(confirmed.groupBy("shard")).applyInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """``without_repeats`` with the hash of what is kept in place of the text."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
