"""Phrase collocations against counters of all phrases, and the perfect hash by itself."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm.common import utf8_batch
from quillspark.llm.op11_collocations import LOWEST_CUT, PerfectHash, collocations, counted

from .helpers import documents

PIECE = re.compile(r"[.,;:!?\x0A-\x0D]")
WORD = re.compile(r"[^\x20\x09]+")


def brute(rows, least, longest=5, top=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        counts = f.setdefault(lang, Counter())
        for piece in PIECE.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = WORD.findall(piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                counts.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        kept = []
        for p, a in found.items():
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if 100 * inside[p] < 100 * a:
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def talk():
    """Texts of a few words, in pieces, with phrases that recur and overlap."""
    rnd = random.Random(11)
    vocabulary = ["The", "the", "a", "É", "é", "日本", "x-y", "'s", "of", "new", "york", "city", "in"]
    fixed = ["New York City", "in the new york", "a a a a a a", "of the of the of", "É é 日本"]
    out = [None, "", " \t", "?!", "one.two,three", "new\x0byork\x0cnew york", "The" + " the" * 4000, "Łódź ǅ İ İ"]
    for _ in range(300):
        out.append("".join(rnd.choice(fixed + vocabulary) + rnd.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "? "]) for _ in range(rnd.randint(1, 30))))
    return [(t, rnd.choice(["en", "en", "en", "", None, "und"])) for t in out]


def rows_of(spark, talk):
    return spark.createDataFrame([(i, t, lang, 1, "x") for i, (t, lang) in enumerate(talk)], "doc_id long, text string, lang string, slots int, word string")


@pytest.mark.parametrize(("least", "block"), [(5, 1 << 22), (4, 120)])  # 120: several blocks a length
def test_collocations(spark, talk, least, block):
    got = collocations(rows_of(spark, talk), least=least, block=block)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    want = brute(talk, least)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_other_lengths_and_limits(spark, talk):
    assert sorted(map(tuple, collocations(rows_of(spark, talk), least=20, longest=2, top=5).collect())) == brute(talk, 20, 2, 5)
    assert sorted(map(tuple, collocations(rows_of(spark, talk).withColumnRenamed("lang", "n").withColumn("lang", F.lit("z")), least=20, longest=3, lang_col="n").collect())) == brute(talk, 20, 3)


def test_nothing_to_count(spark):
    assert collocations(documents(spark, [])).count() == 0
    assert collocations(documents(spark, [None, "", "a b c d e f"])).count() == 0


def test_scores_are_exact(spark):
    a, n = 9 * 10**12, 10**14
    df = spark.createDataFrame([(a, n, [a + 7, a], [a + 9, a])], "a long, n long, first array<long>, last array<long>").select(F.expr(LOWEST_CUT).alias("c")).select("c.*")
    assert tuple(df.first()) == (1000 * a * n // ((a + 7) * (a + 9)), 1, a + 7, a + 9)
    tied = spark.createDataFrame([(10, 100, [10, 20, 10], [10, 20, 10])], "a long, n long, first array<long>, last array<long>").select(F.expr(LOWEST_CUT).alias("c")).select("c.*")
    assert tuple(tied.first()) == (5000, 1, 10, 20)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 200_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    table = PerfectHash(keys)
    assert sorted(table.slot(keys).tolist()) == list(range(len(keys)))
    assert (table.keys[table.slot(keys)] == keys).all()
    strangers = np.setdiff1d(rng.integers(0, 2**64, 1000, dtype=np.uint64), keys)
    assert (table.slot(strangers) == -1).all()


def test_counted():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(9):
        keys, n = np.unique(rng.zipf(1.3, 20_000).astype(np.uint64), return_counts=True)
        rows.append((keys, n.astype(np.int32)))
    want = Counter()
    for keys, n in rows:
        want.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
    key, a = counted(rows, 30)
    assert dict(zip(key.tolist(), a.tolist(), strict=True)) == {k: v for k, v in want.items() if v >= 30}
    assert len(counted([], 3)[0]) == 0


def test_words_that_share_a_hash():
    import pyarrow as pa

    from quillspark.llm import op11_collocations as op11

    data, bounds = utf8_batch(pa.array(["aa bb aa cc", "bb dd aa"]))
    w = op11.Words(data, bounds, np.zeros(2, np.int64), 0)
    key = np.array([1, 1, 1, 2, 1, 3, 1], np.uint64)
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    assert op11.strays(w, data, first, which, np.array([5, 6, -1])).tolist() == [1, 4]
    assert op11.strays(w, data, first, which, np.array([-1, 6, 7])).tolist() == []
