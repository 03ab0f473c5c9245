"""The engine's tables as views over the Parquet tables at hand."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Ids of chunks are the document's times this, plus their place: more lines than a text
#: of a gigabyte can have.
CHUNKS = 1 << 30


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``; where a local session (one
    machine) names none, one in its warehouse. On a cluster without one: an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def own_folder(spark: SparkSession) -> str:
    """A new place in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed and stored in the shared folder, as a plan that begins there; the
    files are deleted when the driver ends."""
    spark = df.sparkSession
    path = own_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the document they touch: ``k`` of their properties."""
    return read(spark, sf_dir, "events").withColumn("document_id", F.get_json_object("props", "$.k").cast("long"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where(F.col("doc_id").isNotNull())
    share = F.when(F.col("doc_id") % 7 == 0, "pending").when(F.col("doc_id") % 5 == 0, "private").otherwise("shared")
    return d.select(
        F.col("doc_id").alias("id"),
        (F.col("doc_id") % 12).alias("owner_id"),
        F.substring(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), 1, 40).alias("title"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.col("lang").alias("category"),
        F.array("lang", "source").alias("tags"),
        F.lit(1).alias("version"),
        F.lit("ready").alias("status"),
        share.alias("share_status"),
        F.col("source").alias("kb"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id") * 60).alias("created_at"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and downloads of each document, as counts over the event table."""
    e = events(spark, sf_dir).where(F.col("document_id").isNotNull())
    return e.groupBy(F.col("document_id").alias("id")).agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "purchase").alias("downloads"))


def reactions(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    """Likes (clicks) or favourites (purchases): one row per user and document."""
    e = events(spark, sf_dir).where((F.col("event_type") == event_type) & F.col("document_id").isNotNull())
    return e.select("user_id", "document_id").distinct()


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk per non-blank line of a document, with a chapter for every eight lines
    and a section for every three lines of a chapter."""
    d = documents(spark, sf_dir).select("id", "version", "title", "filename", "tags", "owner_id", "share_status", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    number, within = F.floor(F.col("chunk_index") / 8) + 1, F.floor((F.col("chunk_index") % 8) / 3) + 1
    return d.where(F.trim("content") != "").select(
        (F.col("id") * CHUNKS + F.col("chunk_index")).alias("chunk_id"),
        F.col("id").alias("document_id"),
        F.col("version").alias("document_version"),
        "chunk_index", "content", "title", "filename", "tags", "owner_id", "share_status",
        F.concat(F.lit("第"), number.cast("string"), F.lit("章")).alias("chapter"),
        F.concat(number.cast("string"), F.lit("."), within.cast("string")).alias("section"),
        F.lit("content").alias("content_type"),
    )


#: The same views for DuckDB, to put in front of a query.
SQL = """
    ev AS (SELECT *, TRY_CAST(props ->> 'k' AS BIGINT) AS document_id FROM events),
    docs AS (SELECT doc_id AS id, doc_id % 12 AS owner_id, substr(split_part(coalesce(text, ''), chr(10), 1), 1, 40) AS title, 'doc-' || doc_id || '.txt' AS filename,
                    lang AS category, [lang, source] AS tags, 1 AS version,
                    CASE WHEN doc_id % 7 = 0 THEN 'pending' WHEN doc_id % 5 = 0 THEN 'private' ELSE 'shared' END AS share_status, source AS kb,
                    epoch_ms((1700000000 + doc_id * 60) * 1000) AS created_at, coalesce(text, '') AS text
             FROM documents WHERE doc_id IS NOT NULL),
    counters AS (SELECT document_id AS id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS downloads
                 FROM ev WHERE document_id IS NOT NULL GROUP BY 1),
    likes AS (SELECT DISTINCT user_id, document_id FROM ev WHERE event_type = 'click' AND document_id IS NOT NULL),
    favorites AS (SELECT DISTINCT user_id, document_id FROM ev WHERE event_type = 'purchase' AND document_id IS NOT NULL),
    lines AS (SELECT id, title, filename, tags, owner_id, share_status, string_split(text, chr(10)) AS l FROM docs),
    chunks AS (SELECT id * 1073741824 + i - 1 AS chunk_id, id AS document_id, i - 1 AS chunk_index, l[i] AS content, title, filename, tags, owner_id, share_status,
                      '第' || ((i - 1) // 8 + 1) || '章' AS chapter, ((i - 1) // 8 + 1) || '.' || (((i - 1) % 8) // 3 + 1) AS section
               FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM lines) WHERE trim(l[i], ' ') <> '')
"""
