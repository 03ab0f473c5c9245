"""Tables after a write (S14-S21, S23): each is a plan over the table before, to be
written to a new place and switched to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upserted(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows replace those of their key; of several with one key any stays."""
    new = rows.dropDuplicates(key).select(*table.columns)
    return table.join(new.select(*key), key, "left_anti").unionByName(new)


def inserted_new(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the table does not have are added (insert-ignore)."""
    return table.unionByName(rows.join(table.select(*key), key, "left_anti").dropDuplicates(key).select(*table.columns))


def deleted_with_dependents(tables: dict[str, DataFrame], ids: DataFrame, parent: str, parent_key: str, foreign: str) -> dict[str, DataFrame]:
    """All tables without the rows of the ids (one column) of ``parent``."""
    gone = ids.toDF("__id")
    out = {}
    for name, t in tables.items():
        column = parent_key if name == parent else foreign
        out[name] = t.join(gone, t[column] == gone["__id"], "left_anti")
    return out


def incremented(table: DataFrame, events: DataFrame, key: str, column: str) -> DataFrame:
    """A counter after events (key per row)."""
    n = events.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return table.join(n, key, "left").withColumn(column, F.coalesce(column, F.lit(0)) + F.coalesce("__n", F.lit(0))).drop("__n")


def merged_report(before: DataFrame, now: DataFrame) -> DataFrame:
    """Import reports by sha256: what is new replaces what was, except "already_imported",
    which leaves the former; failures that a later entry put right go (S21)."""
    rank = F.when((F.col("__run") == 1) & (F.col("status") == "already_imported"), 2).when(F.col("__run") == 1, 0).otherwise(1)
    rows = before.withColumn("__run", F.lit(0)).unionByName(now.withColumn("__run", F.lit(1)))
    w = Window.partitionBy("sha256").orderBy(rank, "filename")
    kept = rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn", "__run")
    done = kept.where("status <> 'failed'").select("filename").distinct()
    return kept.where("status <> 'failed'").unionByName(kept.where("status = 'failed'").join(done, "filename", "left_anti").select(*kept.columns))


def with_columns_of(table: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The table with columns it lacks added as nulls."""
    return table.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in table.columns})


def restamped(vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """Vectors without a version take their document's."""
    d = docs.select(F.col("id").alias("document_id"), F.col("version").alias("__v"))
    return vectors.join(d, "document_id", "left").withColumn("document_version", F.coalesce("document_version", "__v")).drop("__v")


def of_current_versions(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows (document_id, document_version, ...) that were made of the version that
    ``docs`` (id, version) has now: what a slower writer made of an older one is not to
    replace it (the check of lost updates)."""
    now = docs.select(F.col("id").alias("document_id"), F.col("version").cast("int").alias("document_version"))
    return rows.withColumn("document_version", F.col("document_version").cast("int")).join(now, ["document_id", "document_version"], "left_semi").select(*rows.columns)
