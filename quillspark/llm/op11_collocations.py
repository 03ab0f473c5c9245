"""Phrase collocations: counted by slots of a minimal perfect hash, length by length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import chunks, forget, mixed_bits, partitions, text_of, utf8_batch, word_table, written

#: Words of the longest phrase, and the least number of times a phrase occurs.
LONGEST = 5
LEAST = 100
#: Phrases reported of each language.
TOP = 2000
#: Frequent phrases of a length whose hash is broadcast at a time: 40 MB. More of them
#: take more passes.
BLOCK = 1 << 22
#: Occurrences that a mapper gathers, and those that are counted in one part, about.
FLUSH, PART = 1 << 20, 1 << 22

_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", *range(10, 14)]] = True
_BETWEEN = _PIECE.copy()
_BETWEEN[[32, 9]] = True


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys, with the keys by slot.

    Keys that are alone at their place in a table of bits take it; the others go on to
    the next, smaller table. A key's slot is the number of bits set before its own.
    ``slot`` gives -1 for what is not the key stored there.
    """

    def __init__(self, keys: np.ndarray):
        tables, self.spans, rest, start = [np.zeros(0, bool)], [], keys, 0
        while len(rest):
            size = -(-2 * len(rest) // 64) * 64
            at = self._at(rest, len(self.spans), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            table = np.zeros(size, bool)
            table[at[alone]] = True
            tables.append(table)
            self.spans.append((start, size))
            start, rest = start + size, rest[~alone]
        self.bits = np.packbits(np.concatenate(tables), bitorder="little").view(np.uint64)
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.bits), dtype=np.int64))
        self.keys = np.zeros(0, np.uint64)
        if len(keys):
            stored = np.empty(len(keys), np.uint64)
            stored[self._slots(keys)] = keys
            self.keys = stored

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed_bits(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(keys), -1), np.arange(len(keys))
        for level, (start, size) in enumerate(self.spans):
            at = start + self._at(keys[todo], level, size)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(below)
            todo = todo[~hit]
        return out

    def slot(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        out = self._slots(keys)
        out[self.keys[out] != keys] = -1
        return out


def packed(batches: Iterator, keys_of: Callable[..., Iterator[np.ndarray]], parts: int) -> Iterator:
    """The keys of Arrow batches as rows (part, keys, counts): distinct ones of some
    ``FLUSH`` occurrences, dealt by hash to ``parts``."""
    import pyarrow as pa

    def flushed(waiting: list[np.ndarray]):
        key, n = np.unique(np.concatenate(waiting), return_counts=True)
        part = (mixed_bits(key) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        key, n, part = key[order], n[order].astype(np.int32), part[order]
        at, first = np.unique(part, return_index=True)
        spans = list(zip(first, np.append(first[1:], len(part)), strict=True))
        cut = lambda x: pa.array([x[i:j].tobytes() for i, j in spans], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(at), cut(key), cut(n)], names=["part", "keys", "counts"])

    waiting, n = [], 0
    for batch in batches:
        for keys in keys_of(batch):
            waiting.append(keys)
            n += len(keys)
            if n >= FLUSH:
                yield flushed(waiting)
                waiting, n = [], 0
    if n:
        yield flushed(waiting)


def counted(rows: list[tuple[np.ndarray, np.ndarray]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that occur ``least`` times in a part, and how often, of its mappers' rows
    (keys, counts).

    Candidates are the keys in classes, about one for four keys, that occur that often
    together, which no frequent key can fail. They get a perfect hash; each mapper's row
    becomes an array of counts by slot, and the arrays are summed.
    """
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = 1 << max(10, sum(len(k) for k, _ in rows).bit_length() - 2)
    place = lambda key: (mixed_bits(key ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & np.uint64(size - 1)).astype(np.int64)
    upper = np.zeros(size, np.int64)
    for key, n in rows:
        np.add.at(upper, place(key), n)
    candidates = PerfectHash(np.unique(np.concatenate([key[upper[place(key)] >= least] for key, _ in rows])))
    total = np.zeros(len(candidates.keys), np.int64)
    for key, n in rows:
        slot = candidates.slot(key)
        total += np.bincount(slot[slot >= 0], n[slot >= 0], len(total)).astype(np.int64)
    return candidates.keys[total >= least], total[total >= least]


def frequent(rows: DataFrame, keys_of: Callable[..., Iterator[np.ndarray]], occurrences: float, least: int) -> DataFrame:
    """The keys (key, a) that occur ``least`` times in ``rows``, each counted in one of as
    many parts as ``PART`` occurrences each make. A key is one entry of a mapper's row,
    however often it occurs there."""
    import pyarrow as pa

    parts = max(partitions(rows.sparkSession), int(occurrences // PART) + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = []
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own.append((np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int32)))
        key, a = counted(own, least)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(a)], names=["key", "a"])

    dealt = rows.mapInArrow(lambda batches: packed(batches, keys_of, 4 * parts), "part int, keys binary, counts binary").repartition(parts, "part")
    return written(dealt.mapInArrow(count, "key long, a long"))


class Words:
    """The words of a batch of texts: where they are, whether they begin a piece, and
    their keys, which depend on the language."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lang: np.ndarray, seed: int):
        self.starts, self.ends, self.row, h = word_table(data, bounds, between=_BETWEEN)
        piece = np.cumsum(_PIECE[data])[self.starts]
        self.fresh = np.ones(len(h), bool)
        self.fresh[1:] = (piece[1:] != piece[:-1]) | (self.row[1:] != self.row[:-1])
        self.key = mixed_bits(h + lang.view(np.uint64)[self.row] * np.uint64(2 * seed + 1))


def _texts(batch, seed: int) -> Iterator[tuple[np.ndarray, int, int, Words]]:
    data, bounds = utf8_batch(batch.column("text"))
    lang = batch.column("lang_key").to_numpy()
    for a, b in chunks(bounds):
        own = data[bounds[a] : bounds[b]]
        yield own, a, b, Words(own, bounds[a : b + 1] - bounds[a], lang[a:b], seed)


def _blocks(found: DataFrame, block: int) -> Iterator[tuple[PerfectHash, np.ndarray]]:
    """The frequent keys (key, a) in blocks of about ``block``: their hash, and how often
    each occurs by slot."""
    n = max(1, -(-found.count() // block))
    for i in range(n):
        own = found.where(F.pmod(F.xxhash64("key"), F.lit(n)) == i).toArrow()
        table = PerfectHash(own["key"].to_numpy().view(np.uint64))
        counts = np.zeros(len(own), np.int64)
        counts[table.slot(own["key"].to_numpy().view(np.uint64))] = own["a"].to_numpy()
        yield table, counts


def _frame(spark, table: PerfectHash, counts: np.ndarray, base: int) -> DataFrame:
    import pyarrow as pa

    slots = np.arange(base, base + len(counts))
    return written(spark.createDataFrame(pa.table({"slot": pa.array(slots, pa.int64()), "key": pa.array(table.keys.view(np.int64)), "a": pa.array(counts, pa.int64())})))


def _line_array(column) -> tuple[np.ndarray, np.ndarray]:
    """The lines of an Arrow column of binaries as one array, and their n+1 bounds."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]].view(np.int32), (bounds - bounds[0]) // 4


def _line_column(lines: np.ndarray, bounds: np.ndarray):
    import pyarrow as pa

    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 4).astype(np.int64).tobytes()), pa.py_buffer(lines.astype(np.int32).tobytes())]).cast(pa.binary())


def _pairs(batch) -> Iterator[np.ndarray]:
    """The keys of two phrases that begin at successive words, both frequent. Every line
    begins with a gap, so lines can lie end to end."""
    s, _ = _line_array(batch.column("slots"))
    good = (s[:-1] >= 0) & (s[1:] >= 0)
    yield s[:-1][good].astype(np.uint64) << np.uint64(32) | s[1:][good].astype(np.uint64)


def strays(w: Words, lower: np.ndarray, first: np.ndarray, which: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """The words that are spelt otherwise than the first word of their key, for keys with
    a slot: none, unless two words share a hash."""
    at = np.flatnonzero(slot[which] >= 0)
    model, size = first[which[at]], w.ends - w.starts
    odd = size[at] != size[model]
    n = np.where(odd, 0, size[at])
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    differ = lower[np.repeat(w.starts[at], n) + offset] != lower[np.repeat(w.starts[model], n) + offset]
    if differ.any():
        odd[np.unique(np.repeat(np.arange(len(at)), n)[differ])] = True
    return at[odd]


def _word_lines(docs: DataFrame, least: int, seed: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The frequent words (slot, a) and, as stored, the documents as lines (lang, n_words,
    slots): a word's slot, or -1, and a gap, -1 too, before each piece; beside them rows of
    words (lang, word, slot)."""
    import pyarrow as pa

    spark = docs.sparkSession
    chars = docs.select(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    found = frequent(docs.select("lang_key", "text"), lambda batch: (w.key for _, _, _, w in _texts(batch, seed)), chars / 6, least)
    blocks = list(_blocks(found, block))
    empty = {"n_words": F.lit(None).cast("long"), "slots": F.lit(None).cast("binary"), "word": F.lit(None).cast("string"), "slot": F.lit(None).cast("long")}
    columns = ["lang", "lang_key", "text", *empty]
    lines, base, frames = docs.withColumns(empty).select(*columns), 0, []
    for i, (table, counts) in enumerate(blocks):
        frames.append(_frame(spark, table, counts, base).select("slot", "a"))
        shared, last = spark.sparkContext.broadcast(table), i == len(blocks) - 1

        def fill(batches: Iterator[pa.RecordBatch], shared=shared, base=base, last=last) -> Iterator[pa.RecordBatch]:
            row = lambda *values: pa.RecordBatch.from_arrays(list(values), names=columns)
            told = np.full(len(shared.value.keys), None, object)  # a task tells a word once
            for batch in batches:
                before = batch.column("word").is_valid().to_numpy(zero_copy_only=False)
                if before.any():
                    yield batch.filter(pa.array(before))
                batch = batch.filter(pa.array(~before))
                before = batch.column("slots")
                for data, a, b, w in _texts(batch, seed):
                    key, first, which = np.unique(w.key, return_index=True, return_inverse=True)
                    slot = shared.value.slot(key)
                    lower = data.tobytes().lower()  # bytes: A-Z only
                    at = np.append(first[slot >= 0], strays(w, np.frombuffer(lower, np.uint8), first, which, slot))
                    spelt = np.array([lower[x:y].decode() for x, y in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)], object)
                    own_slot = slot[which[at]]
                    new = told[own_slot] != spelt
                    at, spelt, own_slot = at[new], spelt[new], own_slot[new]
                    told[own_slot] = spelt
                    slot[slot >= 0] += base
                    spot = np.arange(len(which)) + np.cumsum(w.fresh)  # a gap before each piece
                    count = np.bincount(w.row, minlength=b - a)
                    bounds = np.append(0, np.cumsum(count + np.bincount(w.row[w.fresh], minlength=b - a)))
                    line = np.full(int(bounds[-1]), -1)
                    line[spot] = slot[which]
                    if before.null_count == 0:
                        line = np.maximum(line, _line_array(before.slice(a, b - a))[0])
                    own = batch.slice(a, b - a)
                    text = pa.nulls(b - a, pa.string()) if last else own.column("text")
                    yield row(own.column("lang"), own.column("lang_key"), text, pa.array(count), _line_column(line, bounds), pa.nulls(b - a, pa.string()), pa.nulls(b - a, pa.int64()))
                    yield row(own.column("lang").take(pa.array(w.row[at])), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary()), pa.array(spelt.tolist(), pa.string()), pa.array(base + own_slot))

        after = written(lines.mapInArrow(fill, "lang string, lang_key long, text string, n_words long, slots binary, word string, slot long"))
        forget(lines)
        lines, base = after, base + len(counts)
    forget(found)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out, lines


def _longer(lines: DataFrame, least: int, block: int) -> tuple[DataFrame, DataFrame]:
    """One word more: the frequent phrases (slot, pre, suf, a) of two frequent ones that
    overlap in all but a word each, and the lines of their slots (``longer``), as stored."""
    import pyarrow as pa

    spark = lines.sparkSession
    size = lines.select(F.sum(F.octet_length("slots")).alias("n")).first()["n"] or 0
    keys = frequent(lines.select("slots"), _pairs, size / 4, least)
    base, found = 0, None
    filled = lines.select("slots", F.lit(None).cast("binary").alias("longer"))
    blocks = list(_blocks(keys, block))
    for i, (table, counts) in enumerate(blocks):
        own = _frame(spark, table, counts, base).select("slot", F.shiftright("key", 32).alias("pre"), F.col("key").bitwiseAND((1 << 32) - 1).alias("suf"), "a")
        found = own if found is None else found.unionByName(own)
        shared, last = spark.sparkContext.broadcast(table), i == len(blocks) - 1

        def fill(batches: Iterator[pa.RecordBatch], shared=shared, base=base, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s, bounds = _line_array(batch.column("slots"))
                new = np.full(len(s), -1) if batch.column("longer").null_count else _line_array(batch.column("longer"))[0].astype(np.int64)
                good = np.flatnonzero((s[:-1] >= 0) & (s[1:] >= 0))
                at = shared.value.slot(s[good].astype(np.uint64) << np.uint64(32) | s[good + 1].astype(np.uint64))
                new[good[at >= 0]] = base + at[at >= 0]
                old = batch.column("slots")
                if last:  # one gap is as good as many, and lines of gaps say nothing
                    keep = np.ones(len(new), bool)
                    keep[1:] = (new[1:] >= 0) | (new[:-1] >= 0)
                    keep[bounds[:-1][np.diff(bounds) > 0]] = True
                    sums = np.append(0, np.cumsum(keep))
                    full = np.append(0, np.cumsum(new >= 0))[bounds]
                    some = np.flatnonzero(np.diff(full) > 0)
                    lengths = sums[bounds[some + 1]] - sums[bounds[some]]
                    inside = np.repeat(np.diff(full) > 0, np.diff(bounds))
                    new, bounds = new[keep & inside], np.append(0, np.cumsum(lengths))
                    old = pa.nulls(len(some), pa.binary())
                yield pa.RecordBatch.from_arrays([old, _line_column(new, bounds)], names=["slots", "longer"])

        after = written(filled.mapInArrow(fill, "slots binary, longer binary"))
        forget(filled)
        filled, base = after, base + len(counts)
    forget(keys)
    return found, filled


#: A phrase's cut of the lowest score, the first of several; products go to 38 digits.
#: ``first`` and ``last`` are the counts of its first and last 1, 2, ... words.
LOWEST_CUT = """
    array_min(transform(sequence(1, size(first) - 1), k -> named_struct(
        'score', (cast(1000 * a AS decimal(19,0)) * cast(n AS decimal(19,0))) div (cast(first[k - 1] AS decimal(19,0)) * cast(last[size(last) - k - 1] AS decimal(19,0))),
        'k', k, 'l', first[k - 1], 'r', last[size(last) - k - 1])))
"""


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, block: int = BLOCK) -> tuple[list[DataFrame], DataFrame]:
    """All phrases of 1 to ``longest`` words that occur ``least`` times in texts of their
    language, a table a length (lang, words, a, first, last, and pre and suf, the slots of
    what a longer one is made of), and the words of each language (lang, n).

    Counting goes length by length. Of two or more words only phrases of two overlapping
    frequent ones are counted, since no other can be frequent; in each part the candidates
    (see ``counted``) get a minimal perfect hash, under which the mappers' keys are counted
    in arrays. The frequent ones get another, which is broadcast in blocks of bounded size
    and turns documents into lines of slots, which the next length reads in their place. A
    key is compared with the one stored at its slot: for longer phrases the two slots
    themselves, for words a hash of 64 bits. Where a word with a slot is spelt otherwise
    than another of that slot, anywhere, all is counted anew with other hashes.

    Cases: see ``collocations``.
    """
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    docs = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lang_key"), text_of(text_col).alias("text"))
    seed = 0
    while True:  # another seed if two words share a key
        found, stored = _word_lines(docs, least, seed, block)
        words = written(stored.where("word IS NOT NULL").select("slot", "lang", "word").distinct())
        if words.groupBy("slot").count().where("count > 1").limit(1).count() == 0:
            break
        forget(words)
        forget(stored)
        seed += 1
    n = written(stored.where("word IS NULL").groupBy("lang").agg(F.sum("n_words").alias("n")))
    out = [written(found.join(words, "slot").select("slot", "lang", F.array("word").alias("words"), "a", F.array("a").alias("first"), F.array("a").alias("last")))]
    forget(words)
    lines = stored.where("word IS NULL").select("slots")
    for _ in range(longest - 1):
        found, after = _longer(lines, least, block)
        forget(stored)
        stored, lines, shorter = after, after.select(F.col("longer").alias("slots")), out[-1]
        head = shorter.select(F.col("slot").alias("pre"), "lang", F.col("words").alias("head"), F.col("first").alias("before"))
        tail = shorter.select(F.col("slot").alias("suf"), F.element_at("words", -1).alias("word"), F.col("last").alias("after"))
        joined = found.join(head, "pre").join(tail, "suf")
        out.append(written(joined.select("slot", "lang", F.concat("head", F.array("word")).alias("words"), "a", F.concat("before", F.array("a")).alias("first"), F.concat("after", F.array("a")).alias("last"), "pre", "suf")))
    forget(stored)
    return out, n


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, block: int = BLOCK, **columns: str) -> DataFrame:
    """The ``top`` phrases of each language by the score of their weakest cut: lang, rank,
    phrase, a, l, r, n, score.

    ``a`` is how often a phrase of 2 to ``longest`` words occurs within pieces of text,
    ``l`` and ``r`` how often what a cut makes of it does, ``n`` the words of the language;
    the score is the whole part of 1000 a n / (l r). A phrase inside a longer one that
    occurs as often is left out: it is inside one of a word more that does, too.

    Cases: a null language is ``und``; null and empty texts have no words; ties of scores
    go to the more frequent, then to the phrase that is less in UTF-8; repeated rows
    count each; a table without frequent phrases, or without rows, gives no rows; other
    columns are ignored, whatever their names.
    """
    levels, n = phrases(docs, least=least, longest=longest, block=block, **columns)
    scored = None
    for i, own in enumerate(levels[1:], 1):
        if i + 1 < len(levels):
            inside = levels[i + 1].select(F.explode(F.array("pre", "suf")).alias("slot"), "a").distinct()
            own = own.join(inside, ["slot", "a"], "left_anti")
        own = own.select("lang", F.array_join("words", " ").alias("phrase"), "a", "first", "last")
        scored = own if scored is None else scored.unionByName(own)
    cut = F.expr(LOWEST_CUT)
    scored = scored.join(n, "lang").withColumn("cut", cut).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
