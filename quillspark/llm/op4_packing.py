"""Best-fit packing by minimum bin slack over the histogram of lengths."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import partitions, text_of, written

#: Unicode white space, as the tokenizer's expression knows it.
LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(vocabulary: str, added: bool = False):
    """Text -> ids of the byte-level BPE in ``vocabulary`` (a tokenizers JSON file).

    The vocabulary and merges of that file are run by tiktoken, which gives the same
    ids (tests compare the two libraries) at four times the speed. The rank of a
    token is its id. With ``added`` the file's added tokens in a text are one id each,
    as the library has it by default; without, their strings are ordinary text.
    """
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    with open(vocabulary, encoding="utf-8") as f:
        file = json.load(f)
    model, special = file["model"], {t["content"]: t["id"] for t in file["added_tokens"]} if added else {}
    # byte-level BPE writes byte b as a printable character: itself where printable, else 256, 257, ...
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte_of for c in token) and not (token.startswith("<|") and token.endswith("|>"))}
    both = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    short = (lambda text: both.encode(text, allowed_special="all")) if added else both.encode_ordinary

    def encode(text: str) -> list[int]:
        """The expression that cuts text into words recurses on long white space; such a
        run is a piece by itself, but for its last character where a word follows it."""
        ids, at = [], 0
        for run in LONG_SPACE.finditer(text):
            end = run.end()
            if end < len(text) and not any(text.startswith(s, end) for s in special):
                end -= 1
            ids += short(text[at : run.start()])
            ids += both._encode_single_piece(text[run.start() : end])
            at = end
        return ids + short(text[at:]) if at else short(text)

    return encode


def tokenised(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Cut every whole document into pieces of at most ``capacity`` tokens.

    A document is its token ids and ``end_id``. Only longer documents are cut; every
    piece but the first is full. Ids are summarised as a CRC-32 of their unsigned
    32-bit little-endian form; ``with_ids`` adds the ids themselves.
    """
    vocabulary = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary, added=True)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*encode(text), end_id], dtype="<u4")
                bounds = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    out.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) + ((ids[a:b].astype(np.int32),) if with_ids else ()))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return source.mapInPandas(cut, PIECES + ", ids array<int>" * with_ids)


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """One bin: the largest length left, then the fullest sum of the rest.

    Bit s of ``reach`` says that some of the lengths so far sum to s. A length that
    may be used n times goes in as the parts 1, 2, 4, ... of n, long ones first, so
    that walking back over the kept bitsets prefers few long pieces.
    """
    first = max(counts)
    room, used = capacity - first, {first: 1}
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        n, part = min(counts[length] - (length == first), room // length), 1
        while n > 0 and not reach >> room & 1:
            part = min(part, n)
            more = (reach | reach << (part * length)) & mask
            if more != reach:
                steps.append((length, part, reach))
                reach = more
            n, part = n - part, part * 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            at -= part * length
            used[length] = used.get(length, 0) + part
    return sorted(used.items(), reverse=True)


def packing_plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Bins for a histogram {length: count}, as rows (length, first rank, end rank,
    pieces a bin, first bin, offset in the bin).

    A combination is used as often as the counts allow and each use of the dynamic
    programme exhausts a length or halves its count, so the plan depends on the
    number of lengths (at most ``capacity``), not on the number of pieces.
    """
    left = {length: n for length, n in histogram.items() if n > 0}
    done, rows, bins = dict.fromkeys(left, 0), [], 0
    while left:
        combination = fullest(left, capacity)
        times = min(left[length] // n for length, n in combination)
        offset = 0
        for length, n in combination:
            rows.append((length, done[length], done[length] + n * times, n, bins, offset))
            offset += n * length
            done[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
        bins += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (doc_id, piece, length, ...).

    The driver sees one count per length. A piece's rank among those of its length is
    its rank in a hashed bucket plus the counts of the buckets before, so a length
    that a third of all pieces have is spread over all buckets. The plan (bounded by
    ``capacity``) goes to the executors and each piece finds its place by its rank.
    ``pieces`` should be a written table, since it is read more than once.
    """
    spark, n = pieces.sparkSession, partitions(pieces.sparkSession)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if histogram and max(histogram) > capacity:
        raise ValueError("a piece is longer than a sequence")
    plan = packing_plan(histogram, capacity)
    shared = spark.sparkContext.broadcast(plan)
    salted = pieces.withColumn("__b", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(n)))
    counts = salted.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("length", "__b", (F.sum("__n").over(Window.partitionBy("length").orderBy("__b")) - F.col("__n")).alias("__before"))
    order = [F.col(c) for c in ("doc_id", "piece", "start") if c in pieces.columns]
    ranked = salted.withColumn("__rn", F.row_number().over(Window.partitionBy("length", "__b").orderBy(*order)) - 1).join(before, ["length", "__b"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = shared.value
        # plan rows are sorted by (length, first rank): find the last that begins at or before
        scale = np.int64(p[:, 2].max() + 1) if len(p) else np.int64(1)
        at = np.searchsorted(p[:, 0] * scale + p[:, 1], length.to_numpy(np.int64) * scale + rank.to_numpy(np.int64), side="right") - 1
        row, inside = p[at], rank.to_numpy(np.int64) - p[at, 1]
        return pd.DataFrame({"sequence_id": row[:, 4] + inside // row[:, 3], "offset": row[:, 5] + inside % row[:, 3] * row[:, 0]})

    return ranked.withColumn("__p", place("length", F.col("__rn") + F.col("__before"))).select(*pieces.columns, F.col("__p.sequence_id"), F.col("__p.offset"))


def pack_documents(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Tokenise, cut and pack ``docs``: one row per piece, with its place.

    Cases: a null or empty text is the one token ``end_id``; ``doc_id`` may be null or
    repeat, each row is packed for itself; an empty table gives an empty result; other
    columns are ignored.
    """
    return pack(written(tokenised(docs, capacity, end_id, vocabulary)), capacity)
