"""From files to stored chunks (API5): validated, decoded, cleaned, cut and projected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunking
from quillspark.sources import readers
from quillspark.sources.tables import settled


def ingest(spark: SparkSession, path: str, owner_id: int, documents: DataFrame | None = None, layer: Callable[[bytes], list[str]] | None = None, recognise: Callable[[str, int, int], list[tuple[int, str]]] | None = None) -> dict[str, DataFrame]:
    """Plans of what the files under ``path`` add to the tables.

    ``documents`` are the stored ones (id, filename, owner_id, version, file_size, sha256).
    Bytes that a document of this owner has, or an earlier path under ``path``, are passed
    over; what other owners have makes no difference. Every other file is a document of
    its own, with a new id, but one: the only new file of a name that exactly one document
    of the owner has is the next version of that. Two new files of one name, in different
    folders, are two documents. ``layer`` reads the pages of a PDF file, ``recognise``
    those whose text layer is not reliable.

    Returns ``report`` (path, filename, problem, document_id, version, same_as: a row a
    file; ``problem`` is null where the file was taken, "known" where the owner has its
    bytes as ``document_id``, "repeated" where ``same_as``, another path, has them),
    ``documents`` (rows to upsert by id), ``chunks`` (rows that replace those of their
    documents) and ``projection``, what search reads of them.
    """
    found = readers.validated(readers.files(spark, path))
    known = documents if documents is not None else spark.createDataFrame([], "id long, filename string, owner_id long, version int, file_size long, sha256 string")
    own = known.where(F.col("owner_id") == owner_id)
    hashed = readers.new_files(found.where("problem is null"), own)
    pages = readers.text_pages(hashed).unionByName(readers.docx_text(hashed))
    if layer is not None:
        pages = pages.unionByName(readers.pdf_pages(hashed, layer))
    if recognise is not None:
        bad = pages.where(~T.is_reliable(F.coalesce("text", F.lit(""))) & F.col("page").isNotNull())
        pages = readers.with_recognised(pages, readers.recognised_pages(readers.page_ranges(bad, 8), recognise))
    pages = settled(pages)  # files are read and decoded once
    readable = pages.groupBy("path").agg(F.bool_or(F.col("text").isNotNull()).alias("__read"))
    taken = hashed.join(readable, "path", "left")

    # ids by rank within a stretch of hashes plus the files of the stretches before: no task holds all files
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    mine = own.groupBy("filename").agg(F.max_by(F.struct("id", "version"), "version").alias("__old"), F.countDistinct("id").alias("__ids")).where("__ids = 1").drop("__ids")
    good = taken.where("__read").withColumn("__part", F.substring("sha256", 1, 2))
    sizes = good.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n"))  # 256 rows
    new = F.col("__top") + F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy("sha256", "path"))
    rows = good.join(F.broadcast(sizes.select("__part", "__before")), "__part").crossJoin(top).withColumn("__new", new).join(mine, "filename", "left")
    names = good.groupBy("filename").agg(F.count(F.lit(1)).alias("__names"))  # two files of a name are two documents
    rows = rows.join(names, "filename").withColumn("__old", F.when(F.col("__names") == 1, F.col("__old")))
    docs = rows.select(
        "path", F.coalesce(F.col("__old.id"), F.col("__new")).cast("long").alias("id"), F.lit(owner_id).cast("long").alias("owner_id"), T.display_title("filename").alias("title"), "filename",
        (F.coalesce(F.col("__old.version"), F.lit(0)) + 1).cast("int").alias("version"), F.col("length").alias("file_size"), "sha256", "mime", F.array().cast("array<string>").alias("tags"), F.lit("private").alias("share_status"),
    )

    docs = settled(docs)
    keyed = pages.join(docs.select("path", F.col("id").alias("document_id")), "path").select("document_id", "page", "text")
    texts = keyed.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: F.coalesce(p["text"], F.lit(""))), "\n\n").alias("text"))
    cut = chunking.replace_chunks(texts, keyed)
    chunks = cut.where("status = 'ok'").drop("status").join(docs.select(F.col("id").alias("document_id"), F.col("version").alias("document_version")), "document_id")
    status = cut.groupBy(F.col("document_id").alias("id")).agg(F.when(F.max("status") == "ok", "ready").otherwise(F.max("status")).alias("status"))
    docs = docs.join(status, "id", "left").withColumn("status", F.coalesce("status", F.lit("empty")))

    # the report: a row a file, whatever became of it
    state = taken.select("path", F.when(~F.coalesce("__read", F.lit(False)), F.when(F.col("extension") == "pdf", "no text layer").otherwise("encoding")).alias("__p"), F.lit(True).alias("__new"))
    stored = own.groupBy(F.col("file_size").cast("long").alias("length"), "sha256").agg(F.min("id").alias("__known"), F.max_by("version", F.struct(-F.col("id"))).alias("__known_version"))
    sums = found.select("path", "filename", "problem", "length", F.sha2("content", 256).alias("sha256"))
    first = hashed.select("length", "sha256", F.col("path").alias("__first"))
    told = sums.join(state, "path", "left").join(stored, ["length", "sha256"], "left").join(first, ["length", "sha256"], "left").join(docs.select("path", "id", "version"), "path", "left")
    passed = F.col("problem").isNull() & F.col("__new").isNull()
    report = told.select(
        "path", "filename",
        F.when(passed & F.col("__known").isNotNull(), "known").when(passed, "repeated").otherwise(F.coalesce("problem", "__p")).alias("problem"),
        F.coalesce("id", F.when(passed, F.col("__known"))).alias("document_id"),
        F.coalesce("version", F.when(passed, F.col("__known_version"))).alias("version"),
        F.when(passed & F.col("__known").isNull(), F.col("__first")).alias("same_as"),
    )
    return {"report": report, "documents": docs.drop("path"), "chunks": chunks, "projection": chunking.search_projection(docs, chunks)}
