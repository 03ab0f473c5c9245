"""Exact dedup: 128-bit content hash, one id per group, bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import text_of


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", carry: tuple[str, ...] = ()) -> DataFrame:
    """Mark exact copies. One row per row of ``docs``, dropped ones too.

    Rows group by the MD5 (128 bits) of the UTF-8 text *and the text itself*: the
    hash places the row and settles nearly every comparison, the aggregate's key
    equality compares the bytes inside a hash group, so two texts with one hash
    stay apart. Copies combine before the shuffle, so a group of any size sends a
    row per input partition. Only groups of two or more come back to the rows, by
    (hash, SHA-256), in an equi-join whose large keys adaptive execution splits.

    Cases: a null text is an empty one; a null id never becomes ``keep_id`` unless
    all its group's ids are null, and such rows are not ``kept`` beside a row that
    has an id; rows that repeat an id and a text are both ``kept``; an empty table
    gives an empty result. Columns of ``docs`` not named in ``carry`` are left out,
    so clashing names do no harm. ``keep`` is "max" or "min".
    """
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    body = text_of(text_col)
    digests = [F.unhex(F.md5(body.cast("binary"))).alias("__h"), F.sha2(body.cast("binary"), 256).alias("__sha")]
    pick = F.max if keep == "max" else F.min
    groups = (
        docs.select(F.col(id_col).alias("__id"), body.alias("__body"), digests[0])
        .groupBy("__h", "__body")
        .agg(pick("__id").alias("__keep"), F.count(F.lit(1)).alias("__n"))
        .where("__n > 1")
        .select(F.col("__h").alias("__gh"), F.sha2(F.col("__body").cast("binary"), 256).alias("__gsha"), "__keep", "__n")
    )
    rows = docs.select(F.col(id_col).alias("__id"), *digests, F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]).alias("__carried"))
    keep_id = F.coalesce("__keep", "__id")
    return rows.join(groups, (F.col("__h") == F.col("__gh")) & (F.col("__sha") == F.col("__gsha")), "left").select(
        F.col("__id").alias("doc_id"),
        keep_id.alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(keep_id).alias("kept"),
        F.col("__sha").alias("text_sha256"),
        *([F.col("__carried")] if carry else []),
    )


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all its columns and nothing added."""
    cols = tuple(docs.columns)
    return exact_dedup(docs, carry=cols, **options).where("kept").select(*[F.col(f"__carried.c{i}").alias(c) for i, c in enumerate(cols)])
