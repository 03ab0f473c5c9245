"""Files into pages."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

# What may be uploaded, and what its first bytes are.
MIME = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain", "md": "text/markdown"}
MAGIC = {"pdf": "255044462D", "docx": "504B"}
MAX_BYTES = 1 << 30


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the files under ``path``, names put right."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.withColumn("filename", T.repaired_filename(F.regexp_replace("path", r"^.*/", "")))


def validated(f: DataFrame) -> DataFrame:
    """Add ``extension``, ``mime`` and ``problem`` (null if the file may be read)."""
    ext = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    first = F.hex(F.substring("content", 1, 5))
    head = F.hex(F.substring("content", 1, 8192))
    zero = head.rlike("^(?:..)*?00")
    bad = F.when(~ext.isin(*MIME), "extension").when(first.startswith("4D5A"), "executable")
    for e, magic in MAGIC.items():
        bad = bad.when((ext == e) & ~first.startswith(magic), "content")
    bad = bad.when(ext.isin("txt", "md") & zero, "binary")
    return f.withColumns({"extension": ext, "mime": F.element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), ext), "problem": bad})


def decoded(content: str):
    """A column of bytes as UTF-8, else as GB 18030, both strictly; null if neither fits."""

    def one(b: bytes) -> str | None:
        for name in ("utf-8-sig", "gb18030"):
            try:
                return bytes(b).decode(name)
            except UnicodeDecodeError:
                pass
        return None

    @F.pandas_udf("string")
    def read(values: pd.Series) -> pd.Series:
        return values.map(one, na_action="ignore")

    return read(content)


def text_pages(f: DataFrame) -> DataFrame:
    """Pages of text files: (path, page, text), one page without a number."""
    return f.where(F.col("extension").isin("txt", "md")).select("path", F.lit(None).cast("int").alias("page"), decoded("content").alias("text"))


def split_pages(texts: DataFrame) -> DataFrame:
    """Pages between form feeds of (path, text): numbers from 1."""
    return texts.select("path", F.posexplode(T.pages_of("text")).alias("p", "text")).select("path", (F.col("p") + 1).alias("page"), "text")


def docx_text(f: DataFrame) -> DataFrame:
    """Paragraphs of Word files (S5), by the standard library."""

    @F.pandas_udf("string")
    def read(content: pd.Series) -> pd.Series:
        import io
        import zipfile
        from xml.etree import ElementTree

        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

        def one(b: bytes) -> str | None:
            try:
                root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(bytes(b))).read("word/document.xml"))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                return None
            return "\n\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))

        return content.map(one, na_action="ignore")

    return f.where(F.col("extension") == "docx").select("path", F.lit(None).cast("int").alias("page"), read("content").alias("text"))


def pdf_pages(f: DataFrame, layer: Callable[[bytes], list[str]]) -> DataFrame:
    """Pages of the text layer of PDF files (S3) by a function of a file's bytes that
    returns a text per page; none is in the environment. A file that it fails on has no
    pages, so that all of them are recognised."""

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(path, n, text) for n, text in enumerate(layer(bytes(content)), 1)]
                except Exception:  # noqa: BLE001  whatever a parser makes of a broken file
                    continue
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return f.where(F.col("extension") == "pdf").select("path", "content").mapInPandas(run, "path string, page int, text string")


def with_recognised(pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """Pages whose text layer is not reliable take the recognised text of (path, page,
    text); a file without pages takes all its recognised ones (S6)."""
    o = recognised.select("path", "page", T.recognised("text").alias("__o"))
    p = pages.withColumn("__bad", ~T.is_reliable(F.coalesce("text", F.lit(""))))
    kept = p.join(o, ["path", "page"], "left").select("path", "page", F.when(F.col("__bad"), F.coalesce("__o", "text")).otherwise(F.col("text")).alias("text"))
    whole = o.join(pages.select("path").distinct(), "path", "left_anti").where(F.col("__o") != "").select("path", "page", F.col("__o").alias("text"))
    return kept.unionByName(whole)


def page_ranges(pages: DataFrame, batch: int) -> DataFrame:
    """Pages (path, page) as runs of consecutive numbers of at most ``batch``."""
    w = Window.partitionBy("path").orderBy("page")
    p = pages.select("path", "page").distinct().withColumn("run", F.col("page") - F.row_number().over(w))
    p = p.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("path", "run").orderBy("page")) - 1) / batch))
    return p.groupBy("path", "run", "part").agg(F.min("page").alias("first"), F.max("page").alias("last")).select("path", "first", "last")


def recognised_pages(ranges: DataFrame, recognise: Callable[[str, int, int], list[tuple[int, str]]], languages: tuple[str, ...] = (), available: tuple[str, ...] = (), most_pages: int | None = None) -> DataFrame:
    """Recognise ranges of pages (path, first, last) by a function of path, first and last
    page that returns (page, text); blank pages go. Tasks are what runs at once (S8).

    ``languages`` that are not ``available`` are an error before anything runs. A file of
    which more than ``most_pages`` would be recognised is refused: a row without a page
    tells its path.
    """
    if missing := sorted({*languages} - {*available}):
        raise ValueError(f"languages that are not installed: {', '.join(missing)}")
    if most_pages is not None:
        size = ranges.groupBy("path").agg((F.sum(F.col("last") - F.col("first") + 1) > most_pages).alias("__refused"))
        ranges = ranges.join(size, "path")
        refused = size.where("__refused").select("path", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("text"))
        return recognised_pages(ranges.where("not __refused").drop("__refused"), recognise).unionByName(refused)

    def run(batches):
        for b in batches:
            rows = [(p, n, t) for p, a, z in zip(b["path"], b["first"], b["last"], strict=True) for n, t in recognise(p, int(a), int(z))]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    got = ranges.mapInPandas(run, "path string, page int, text string")
    return got.withColumn("text", T.recognised("text")).where(F.col("text") != "")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, filename) of the files under ``path``; no file is opened."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return f.withColumn("filename", T.repaired_filename(F.regexp_replace("path", r"^.*/", "")))


def identified(spark: SparkSession, path: str, known: DataFrame, lengths: int = 1000) -> DataFrame:
    """Which files under ``path`` are new, in two phases (S12): (path, filename, length,
    sha256, known_id, same_as).

    Lengths are listed first. Only files of a length that a known file (id, file_size,
    sha256) or another one here has are read and hashed; the rest are new as they are and
    have no ``sha256``. ``known_id`` is the known file of the same bytes (of several the
    least), ``same_as`` the first path here of the same bytes, where that is another. The
    scan that hashes is told the lengths, up to so many; beyond, a join does the work.
    """
    meta = listed(spark, path)
    twice = meta.groupBy("length").count().where("count > 1").select("length")
    suspects = meta.select("length").distinct().join(known.select(F.col("file_size").cast("long").alias("length")), "length", "left_semi").unionByName(twice).distinct()
    few = [r[0] for r in suspects.limit(lengths + 1).collect()]
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if len(few) <= lengths:
        wanted = F.lit(False)
        for n in few:
            wanted = wanted | (F.col("length") == n)
        content = content.where(wanted)
    else:
        content = content.join(suspects, "length", "left_semi")
    hashes = content.select("path", F.sha2("content", 256).alias("sha256"))
    k = known.groupBy(F.col("file_size").cast("long").alias("length"), "sha256").agg(F.min("id").alias("known_id"))
    got = meta.join(hashes, "path", "left").join(k, ["length", "sha256"], "left")
    first = got.where("sha256 IS NOT NULL").groupBy("length", "sha256").agg(F.min("path").alias("__first"))
    got = got.join(first, ["length", "sha256"], "left").withColumn("same_as", F.when(F.col("__first") != F.col("path"), F.col("__first")))
    return got.select("path", "filename", "length", "sha256", "known_id", "same_as")


def new_files(f: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose bytes no known file has: by length and SHA-256 (S12). ``known``:
    file_size, sha256. Of several with the same bytes the first path stays."""
    h = f.withColumn("sha256", F.sha2("content", 256))
    k = known.select(F.col("file_size").alias("length"), "sha256")
    first = h.groupBy("length", "sha256").agg(F.min("path").alias("path"))
    return h.join(k, ["length", "sha256"], "left_anti").join(first, ["length", "sha256", "path"], "left_semi")


def query(spark: SparkSession, statement: str, **args) -> DataFrame:
    """A parameterised statement: values are bound, never pasted."""
    return spark.sql(statement, args=args)
