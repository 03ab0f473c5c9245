"""Substring dedup against a table of all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm.common import utf8_batch
from quillspark.llm.op12_substrings import Confirmed, Windows, covered, grams, substring_dedup, without_repeats

from .helpers import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, size=35):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.fixture(scope="module")
def passages():
    """Passages that whole, cut, moved and edited recur; repetitive and odd texts."""
    rnd = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "bdfgk" for b in "aeiou"] + ["É", "日本", "a.b"]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    common = [words(n) for n in (34, 35, 36, 60, 120, 300)]
    out = [None, "", "\n \t", "one", " ".join(["ab"] * 100), " ".join(["x", "y", "z"] * 40), "Ab " * 34 + "ab"]
    for _ in range(40):
        text = words(rnd.randint(0, 60))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(common)
            a = rnd.randint(0, len(p) // 2)
            p = p[a : rnd.randint(a, len(p))] if rnd.random() < 0.6 else list(p)
            if p and rnd.random() < 0.3:
                p[rnd.randrange(len(p))] = "edited"
            text += p + words(rnd.randint(0, 10))
        out.append(rnd.choice([" ", "  ", "\n", "\x0b\t"]).join(text))
    return out + ["  " + out[12] + "\n", " ".join(words(30000))]


@pytest.mark.parametrize("shard_chars", [500, 10**9])
def test_without_repeats(spark, prose, passages, shard_chars):
    texts = prose + passages
    docs = documents(spark, texts).withColumn("shard", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("n_words", F.lit(2))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in without_repeats(docs, shard_chars=shard_chars).collect()}
    assert got == dict(enumerate(brute(texts)))
    assert sum(n for _, n, _ in got.values()) > 5000


def test_short_windows(spark, passages):
    for window, gram in ((2, 1), (5, 5), (7, 3)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in without_repeats(documents(spark, passages), window=window, gram=gram, shard_chars=2000).collect()}
        assert got == dict(enumerate(brute(passages, window)))


def test_repeated_rows_null_ids_and_no_rows(spark, passages):
    text = " ".join(f"w{i}" for i in range(50))
    docs = documents(spark, [text, "short text"]).unionByName(documents(spark, [text, "short text"])).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert sorted(tuple(r)[1:] for r in without_repeats(docs).collect()) == [(2, 0, "short text")] * 2 + [(50, 50, "")] * 2
    assert without_repeats(documents(spark, [])).count() == 0
    assert without_repeats(documents(spark, [None, ""])).count() == 2
    got = substring_dedup(documents(spark, passages))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert {r.doc_id: r.kept_sha256 for r in got.collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, (_, _, t) in enumerate(brute(passages))}


def windows(texts, size, gram):
    import pyarrow as pa

    return Windows(*utf8_batch(pa.array(texts)), size, gram)


def test_runs_and_automaton():
    h = np.random.default_rng(1).integers(0, 2**63, 40).astype(np.uint64)
    for size in (1, 2, 5, 32, 35, 40):
        got = grams(h, size)
        assert len(got) == 41 - size and len(set(got.tolist())) == len(got)
        assert (grams(h[3:], size) == got[3:]).all() if size <= 37 else True
    text = " ".join(f"w{i % 97}v{i % 13}" for i in range(400))
    w = windows([text, text + " more", "other " + text], 35, 8)
    assert w.count.sum() == len(w.at) == 366 + 367 + 367
    one = windows([text], 35, 8)
    same = set(one.passage.tolist()) & set(w.passage.tolist())
    assert len(same) > 0.9 * len(one.passage)
    # one confirmed window: the automaton finds it in all three texts, and nothing else
    at = one.hash[100]
    key = np.repeat(one.key, one.count)[100]
    inside = covered(w, Confirmed(np.array([key]), np.array([at])))
    assert inside.sum() == 35 * 3
