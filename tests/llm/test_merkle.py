"""The Merkle manifest against a tree built in a loop."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm.op13_merkle import audited, folded, leaf_of, manifest

from .helpers import documents

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def tree(leaves, fan_out):
    """The root of a list of leaves, and of each leaf its siblings level by level."""
    level, proofs, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // fan_out * fan_out :][:fan_out]
            proofs[i].append((run[: p % fan_out], run[p % fan_out + 1 :]))
            at[i] = p // fan_out
        level = [h("".join(level[i : i + fan_out])) for i in range(0, len(level), fan_out)]
    return level[0], proofs


def brute(rows, fan_out=16):
    """(id, leaf) -> subroot, root, siblings; rows that agree in both are interchangeable but for their place."""
    sources = defaultdict(list)
    for r in rows:
        sources[r["source"]].append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        rs = sorted(sources[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        built[s] = (rs, *tree([leaf(r) for r in rs], fan_out))
    root, tops = tree([built[s][1] for s in names], fan_out) if names else (None, [])
    return [(r, built[s][1], root, proof + top) for s, top in zip(names, tops, strict=True) for r, proof in zip(built[s][0], built[s][2], strict=True)]


def wanted(rows):
    out = []
    for r, subroot, root, proof in brute(rows):
        seen = dict(r)
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
            seen["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
        at = leaf(seen)
        for left, right in proof:
            at = h("".join([*left, at, *right]))
        siblings = h("".join("".join(left + right) for left, right in proof))
        out.append((r["doc_id"], leaf(r), subroot, root, siblings, at, at == root))
    return sorted(out, key=str)


def as_rows(df):
    return [r.asDict() for r in df.select(*FIELDS).collect()]


def checked(df):
    got = sorted((tuple(r) for r in audited(df).collect()), key=str)
    assert got == wanted(as_rows(df))
    return got


def test_manifest(spark, prose):
    docs = documents(spark, ["Ééß UPPER ÀÉ", *prose] * 3)  # several levels in a source, null and empty texts
    docs = docs.unionByName(documents(spark, ["same", "same"]).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(documents(spark, ["again"] * 3).withColumn("doc_id", F.lit(7).cast("long")))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 4 > 0, F.col("lang"))).withColumn("leaf", F.lit(1)).withColumn("pos", F.lit("clash")).withColumn("t", F.lit(2))
    got = checked(docs)
    assert len({r[3] for r in got}) == 1 and {r[6] for r in got} == {True, False}


@pytest.mark.parametrize(("n", "sources"), [(0, 1), (1, 1), (16, 1), (257, 1), (18, 18)])
def test_sizes(spark, n, sources):
    docs = documents(spark, [f"T{i}" for i in range(n)])
    assert len(checked(docs.withColumn("source", F.concat(F.lit("é"), (F.col("doc_id") % sources).cast("string"))))) == n


def test_equal_rows_keep_their_places(spark):
    docs = documents(spark, ["x"]).withColumn("source", F.lit(None).cast("string")).crossJoin(spark.range(40).select(F.lit(0).alias("z")))
    got = audited(docs).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, wanted(as_rows(docs))))
    assert len({r.proof_sha256 for r in got}) > 1


def test_other_trees_and_fields(spark, prose):
    docs = documents(spark, prose)
    kept = manifest(docs, fields=("text",), tree_col="lang", fan_out=3, extra={"now": leaf_of(docs, ("text",))})
    assert kept.columns == ["doc_id", "leaf", "subroot", "root", "proof", "now"]
    assert kept.where(folded(F.col("now"), F.col("proof")) == F.col("root")).count() == len(prose)
    assert kept.where(folded(F.sha2(F.lit("other"), 256), F.col("proof")) == F.col("root")).count() == 0
