"""Exact dedup, embedding near-dedup and the Jaccard join against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm.common import components
from quillspark.llm.op1_exact_dedup import exact_dedup, without_copies
from quillspark.llm.op2_embedding_dedup import Cells, cell_keys, near_duplicates, nearest_e8, planned, shortest
from quillspark.llm.op6_jaccard_join import jaccard_join, one_of_each_group

from .helpers import documents, smallest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_exact_dedup(spark, prose):
    docs = documents(spark, prose).unionByName(documents(spark, ["one"], 1).withColumn("doc_id", F.lit(None).cast("long")))
    groups = defaultdict(list)
    for i, t in enumerate(prose):
        groups[t or ""].append(i)
    got = exact_dedup(docs).collect()
    assert len(got) == len(prose) + 1
    for r in got:
        if r.doc_id is None:
            assert r.keep_id == max(groups["one"]) and not r.kept
            continue
        text = prose[r.doc_id] or ""
        size = len(groups[text]) + (text == "one")
        assert (r.keep_id, r.group_size, r.kept) == (max(groups[text]), size, r.doc_id == max(groups[text]))
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert {r.doc_id for r in exact_dedup(docs, keep="min").where("kept").collect()} == {min(g) for g in groups.values()}
    left = without_copies(documents(spark, prose))
    assert left.columns == documents(spark, []).columns and left.count() == len(groups)
    assert exact_dedup(documents(spark, [])).count() == 0


def sets_of(text):
    w = [x for x in WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_join(texts):
    s = [sets_of(t) for t in texts]
    links = [(i, j) for i in range(len(s)) for j in range(i) if s[i] & s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j])]
    return s, smallest(range(len(s)), links)


@pytest.mark.parametrize("bits", [8, 22])  # with 8 bits every shingle is of one class: all are frequent
def test_jaccard_join(spark, prose, bits):
    s, component = brute_join(prose)
    got = jaccard_join(documents(spark, prose), sketch_bits=bits, block=8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s[i]), component[i]) for i in range(len(prose))}


def test_jaccard_join_of_frequent_tokens(spark):
    """A passage that most texts share is frequent: pairs of its tokens are the keys."""
    rnd = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        w = list(passage)
        for _ in range(rnd.integers(0, 4)):
            w[rnd.integers(0, 60)] = f"e{rnd.integers(0, 9999)}"
        texts.append(" ".join(w + [f"t{rnd.integers(0, 50)}" for _ in range(rnd.integers(0, 8))]))
    s, component = brute_join(texts)
    got = jaccard_join(documents(spark, texts), block=16).collect()
    assert {r.doc_id: r.component_id for r in got} == component


def test_jaccard_join_edges(spark, prose):
    assert jaccard_join(documents(spark, [])).count() == 0
    docs = documents(spark, prose).unionByName(documents(spark, [prose[9]]).withColumn("doc_id", F.lit(None).cast("long")))
    got = [r for r in jaccard_join(docs).collect() if r.doc_id is None]
    assert len(got) == 1 and got[0].component_id is None
    _, component = brute_join(prose)
    kept = one_of_each_group(documents(spark, prose))
    assert kept.columns == documents(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in component.items() if i == c)


def test_an_id_of_several_texts_links_as_each_of_them(spark):
    rnd = np.random.default_rng(9)
    w = lambda n: [f"w{x}" for x in rnd.integers(0, 9999, n)]
    a, b, c = w(60), w(80), w(70)
    near = lambda x: " ".join([*x[:-1], "z"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (0, " ".join(c)), (7, " ".join(c)), (7, " ".join(w(50))), (7, " ".join(c)), (8, near(c))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in rows], documents(spark, []).schema)
    got = jaccard_join(docs).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (0, 0), (7, 0), (8, 0)} and len(got) == len(rows)


def test_components(spark):
    rnd = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rnd.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(70)]
    want = smallest({x for e in edges if e[0] != e[1] for x in e}, edges)
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == want


def test_e8():
    assert shortest().shape == (240, 8) and np.allclose((shortest() ** 2).sum(1), 2)
    x = np.random.default_rng(0).normal(0, 2, (500, 8))
    z = nearest_e8(x)
    halves = np.allclose(2 * z, np.rint(2 * z))
    assert halves and np.allclose(z.sum(1) % 2, 0)
    near = ((x[:, None, :] - (z[:, None, :] + shortest()[None])) ** 2).sum(2).min(1)
    assert (((x - z) ** 2).sum(1) <= near + 1e-9).all()


def brute_vectors(rows, threshold=0.93):
    fit = [(i, lab, np.array(v, float)) for i, lab, v in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(i, j) for k, (i, a, x) in enumerate(fit) for j, b, y in fit[:k] if a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold]
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return n, smallest([r[0] for r in rows], links)


def test_embedding_near_dedup(spark):
    rnd = np.random.default_rng(1)
    rows = [(1, 0, None), (2, 0, []), (3, 0, [0.0] * 8), (4, 0, [1.0, None]), (5, 0, [float("nan"), 1.0]), (6, 0, [float("inf"), 1.0]), (7, None, [1.0] * 16), (8, 1, [1.0] * 16), (9, 1, [2.0] * 16), (10, 2, [1.0] * 16)]
    for g in range(60):
        base = rnd.normal(size=16)
        for _ in range(rnd.integers(1, 12)):
            rows.append((len(rows) + 1, int(g % 3), (base + rnd.normal(size=16) * rnd.uniform(0, 0.35)).tolist()))
    rows += [(len(rows) + 1 + i, 1, rows[20][2]) for i in range(40)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, label int, embedding array<double>, rep int")
    n, component = brute_vectors(rows)
    got = {r.vec_id: r for r in near_duplicates(df, block=16).collect()}
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got.values())
    assert 0.99 * sum(n.values()) <= found <= sum(n.values())
    if found == sum(n.values()):
        assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {r[0]: (n[r[0]], component[r[0]], component[r[0]] == r[0]) for r in rows}
    assert near_duplicates(df.where("vec_id < 0")).count() == 0
    two = {r.vec_id: r.n_links for r in near_duplicates(df, cells=Cells(12, 1.6, lattices=2)).collect()}
    assert sum(two.values()) >= 0.99 * sum(n.values()) and all(two[i] <= n[i] for i in two)
    nulls = df.selectExpr("vec_id", "cast(null as string) as label", "embedding").union(df.selectExpr("cast(null as long)", "'a'", "embedding"))
    assert {(r.n_links, r.component_id == r.vec_id) for r in near_duplicates(nulls).where("vec_id is not null").collect()} == {(0, True)}
    words = df.selectExpr("vec_id", "case label when 0 then 'x' when 1 then 'y' when 2 then '0.5' end as label", "embedding", "label as component_id")
    assert {r.vec_id: r.n_links for r in near_duplicates(words).collect()} == {i: r.n_links for i, r in got.items()}


def test_vectors_that_meet_grow_slower_than_their_number():
    """Eight times the vectors of one label: each meets less than four times as many in its cells,
    and nearly all pairs at the threshold still meet."""
    rnd = np.random.default_rng(4)
    met = []
    for n in (8000, 64000):
        x = rnd.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1)[:, None]
        cells = planned(n, 0.93)
        keys = cell_keys(x, np.zeros(n), cells).ravel()
        _, count = np.unique(keys, return_counts=True)
        met.append((count.astype(float) ** 2).sum() / n)
        y = rnd.normal(size=(2000, 64))
        y -= (y * x[:2000]).sum(1)[:, None] * x[:2000]
        y = 0.93 * x[:2000] + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1)[:, None]
        a, b = (np.sort(cell_keys(v, np.zeros(2000), cells).reshape(2000, -1), axis=1) for v in (x[:2000], y))
        assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b, strict=True)]) > 0.99
    assert met[1] < 4 * met[0]


def test_recall_at_the_threshold(spark):
    """Pairs of random vectors at cosines from 0.93 up: at least 0.99 of the links are found."""
    rnd = np.random.default_rng(2)
    rows = []
    for i in range(400):
        a = rnd.normal(size=64)
        a /= np.linalg.norm(a)
        b = rnd.normal(size=64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = rnd.uniform(0.9301, 0.96)
        rows += [(2 * i, 0, a.tolist()), (2 * i + 1, 0, (c * a + np.sqrt(1 - c * c) * b).tolist())]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    assert got.agg(F.sum("n_links")).first()[0] >= 2 * 400 * 0.99


def test_signatures_miss_no_pair():
    """Any two sets of enough overlap share a key that allows both sizes, for all shares
    of frequent tokens and several thresholds."""
    from quillspark.llm.op6_jaccard_join import signatures

    rnd = np.random.default_rng(11)
    for trial in range(3000):
        num, den = [(75, 100), (1, 2), (9, 10), (3, 10)][trial % 4]
        pool = rnd.choice(2**60, 80, replace=False).astype(np.uint64)
        heat_of = dict(zip(pool.tolist(), rnd.choice([0, 1, 3, 5], 80, p=[[0.1, 0, 0.4, 0.5], [0.5, 0.3, 0.2, 0], [0, 0, 0, 1]][trial % 3]).tolist()))
        n = int(rnd.integers(1, 60))
        x = set(rnd.choice(pool, n, replace=False).tolist())
        y = set(x)
        for t in rnd.permutation(sorted(x)).tolist()[: int(rnd.integers(0, max(1, n // 3) + 1))]:
            y.discard(t)
        y |= set(rnd.choice(pool, int(rnd.integers(0, max(1, n // 3) + 1)), replace=False).tolist())
        if not y or den * len(x & y) < num * len(x | y):
            continue
        found = []
        for s in (x, y):
            a = np.array(sorted(s), np.uint64)
            k, kind, most = signatures(a, np.array([heat_of[t] for t in a.tolist()]), 3, num, den)
            best = {}
            for key, m in zip(zip(k.tolist(), kind.tolist()), most.tolist()):
                best[key] = max(best.get(key, 0), m)
            found.append(best)
        assert any(found[0][k] >= len(y) and found[1][k] >= len(x) for k in found[0].keys() & found[1].keys()), (len(x), len(y), num, den)
