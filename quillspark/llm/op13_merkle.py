"""Merkle manifest of a dataset: a hash tree a source, a tree over the sources, a proof a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import partitions, written

#: What a leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN_OUT = 16


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def encoded(value: Column) -> Column:
    """A field of a leaf: ``-`` if null, else its length in UTF-8 bytes, ``:`` and itself."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_of(docs: DataFrame, fields: tuple[str, ...] = FIELDS, instead: dict[str, Column] | None = None) -> Column:
    """The leaf of a row of ``docs``; ``instead`` puts other values in place of fields."""
    return digest(F.concat(*[encoded((instead or {}).get(f, docs[f"`{f}`"])) for f in fields]))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` leads to by ``proof``."""
    return F.aggregate(proof, leaf, lambda h, step: digest(F.concat(step["left"], h, step["right"])))


def proof_digest(proof: Column) -> Column:
    """The hash of all siblings of a proof, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""))


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (t, ...) with ``pos``, the place of each in its tree ``t`` by ``order``, and
    ``m``, the rows of its tree, without a task per tree.

    Rows are range-partitioned by tree and order and numbered where they lie; the rows
    of a tree in one partition are a block, and blocks (at most the partitions plus the
    trees) say how many rows of their tree lie before them.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(partitions(spark), "t", *order).sortWithinPartitions("t", *order)
    dealt = written(dealt.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    blocks = dealt.groupBy("t", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("t")
    earlier = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("t", "part", (earlier - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("m"))
    return written(dealt.withColumn("part", part).join(blocks, ["t", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift"))


def _grown(leaves: DataFrame, fan_out: int) -> list[DataFrame]:
    """The levels of all trees from the leaves up, each persisted: (t, pos, hash, m, kids).
    ``m`` is the number of nodes of the tree on that level; a tree ends where it is 1."""
    levels, most = [leaves], leaves.agg(F.max("m")).first()[0] or 0
    while most > 1:
        runs = levels[-1].where("m > 1").groupBy("t", F.expr(f"pos div {fan_out}").alias("pos"), F.expr(f"(m + {fan_out - 1}) div {fan_out}").alias("m"))
        kids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda kid: kid["hash"])  # at most fan_out
        levels.append(written(runs.agg(kids.alias("kids")).withColumn("hash", digest(F.array_join("kids", "")))))
        most = -(-most // fan_out)
    return levels


def _pushed(levels: list[DataFrame], roots: DataFrame, fan_out: int) -> DataFrame:
    """The leaves with their proofs, pushed down from ``roots`` (t, root, suffix): a child
    joins its parent and prepends its siblings to the suffix the parent inherited."""
    above = None
    at = F.pmod("pos", F.lit(fan_out)).cast("int")
    step = F.struct(F.array_join(F.slice("kids_above", F.lit(1), at), "").alias("left"), F.array_join(F.slice("kids_above", at + 2, F.lit(fan_out)), "").alias("right"))
    for nodes in reversed(levels):
        got = nodes.where("m = 1").join(roots, "t")
        if above is not None:
            parents = above.select("t", F.col("pos").alias("up"), F.col("kids").alias("kids_above"), "suffix", "root")
            inner = nodes.where("m > 1").withColumn("up", F.expr(f"pos div {fan_out}")).join(parents, ["t", "up"])
            got = got.unionByName(inner.withColumn("suffix", F.concat(F.array(step), F.col("suffix"))).drop("up", "kids_above"))
        above = got
    return above


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", tree_col: str = "source", fan_out: int = FAN_OUT, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: its id, ``leaf``, ``subroot`` (of its source), ``root``
    (of the dataset) and ``proof``, an array of (left, right) siblings from the leaf's run
    to the root's; ``folded(leaf, proof)`` is ``root`` exactly if the row is unchanged.
    ``extra`` names further columns over ``docs`` to carry along.

    Built bottom-up, a persisted level at a time, and proofs are pushed top-down; both
    join on (source, place), so that a source that holds most rows is spread like any
    other. Texts are read once, to be hashed, and are not shuffled.

    Cases: a null text or any other null field has its own encoding and differs from
    an empty one; a null id is placed before all others; rows that share source and id
    are ordered by leaf; equal rows have the same leaf and places of their own; a null
    source is a tree of its own, before all others; an empty table has no rows; other
    columns are ignored, whatever their names.
    """
    tree = docs[f"`{tree_col}`"].cast("string")
    rows = docs.select(
        F.when(tree.isNull(), "").otherwise(F.concat(F.lit("="), tree)).alias("t"),
        docs[f"`{id_col}`"].alias("id"),
        leaf_of(docs, fields).alias("hash"),
        F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in (extra or {}).items()]).alias("extra"),
    )
    levels = _grown(_placed(written(rows), ["id", "hash"]), fan_out)
    subroots = levels[0].where("m = 1").select("t", "hash")
    for nodes in levels[1:]:
        subroots = subroots.unionByName(nodes.where("m = 1").select("t", "hash"))
    sources = _placed(written(subroots.select(F.lit("").alias("t"), F.col("t").alias("tree"), "hash")), ["tree"])
    tops = _grown(sources, fan_out)
    root = tops[-1].select("hash").first()
    none = F.array().cast("array<struct<left:string,right:string>>")
    top = docs.sparkSession.createDataFrame([("", root[0] if root else None)], "t string, root string").withColumn("suffix", none)
    roots = written(_pushed(tops, top, fan_out).select(F.col("tree").alias("t"), F.col("hash").alias("subroot"), "root", "suffix"))
    out = _pushed(levels, roots.select("t", F.struct("subroot", "root").alias("root"), "suffix"), fan_out)
    return out.select(F.col("id").alias(id_col), F.col("hash").alias("leaf"), "root.subroot", "root.root", F.col("suffix").alias("proof"), *[F.col("extra")[n].alias(n) for n in extra or {}])


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audited(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` held against a copy in which the text of every row whose
    id's CRC-32 is divisible by 5 is lower-cased: ``folded_root`` is what such a row (or an
    unchanged one) leads to by its original siblings, ``verified`` whether that is the root.

    Cases: as in ``manifest``; a null id is never tampered with, a null text stays null, and
    a text without A-Z is unchanged and so verified.
    """
    hit = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0, F.lit(False))
    text = docs["text"].cast("string")
    tampered = F.when(hit, leaf_of(docs, instead={"text": lowered(text)})).otherwise(leaf_of(docs))
    got = manifest(docs, extra={"shown": tampered})
    return got.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.col("shown"), F.col("proof")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
