"""Audits of stored chunks and of load tests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import catalogue as K
from quillspark.functions import text as T
from quillspark.sources.tables import settled


def order_violations(chunks: DataFrame, by: str = "document_id", order: tuple[str, ...] = ("chunk_index",), page: str = "page_start") -> DataFrame:
    """Rows whose page is before the last page named ahead of them."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.nullif(F.col(page), F.lit(0)), ignorenulls=True).over(w)
    return chunks.withColumn("previous_page", seen).where((F.col(page) > 0) & (F.col(page) < F.col("previous_page")))


def chapter_summary(chunks: DataFrame) -> DataFrame:
    """Per document and chapter: pages, chunks, noise hits, chunks without a vector."""
    return chunks.groupBy("document_id", "chapter").agg(
        F.min(F.nullif(F.col("page_start"), F.lit(0))).alias("first_page"),
        F.max("page_end").alias("last_page"),
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(F.col("content").rlike(K.AUDIT_NOISE)).alias("noise"),
        F.count_if(F.col("embedded") == 0).alias("missing"),
    )


def percentile(values: Column, p: float) -> Column:
    """sorted[min(n - 1, floor(n p))] of an array; null of an empty one."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(F.array_sort(values), F.least(n, F.floor(n * F.lit(p)).cast("int") + 1)))


def selected(values: DataFrame, p: float, buckets: int = 256) -> DataFrame:
    """(key, value): of the numbers of each key (key, x) the one at place
    min(n - 1, floor(n p)) of their order (A17), exactly.

    Round by round the numbers between a key's bounds are counted in ``buckets`` ranges of
    equal width; the range that holds the place gives, by its least and largest number, the
    next bounds, until they are one number. The ends fall into different ranges, so every
    round narrows; numbers over nine decades take some five rounds. A round is one scan
    that combines to ``buckets`` rows a key before anything is shuffled, so neither a task
    nor a window holds the numbers of a key.
    """
    x = values.where(F.col("x").isNotNull() & ~F.isnan("x")).select("key", F.col("x").cast("double").alias("x"))
    place = F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p)))
    bounds = settled(x.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).select("key", place.alias("place"), "low", "high"))
    while bounds.where("low < high").limit(1).count():
        bucket = F.least(F.lit(buckets - 1), F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * buckets)).cast("int")
        inside = x.join(bounds.where("low < high"), "key").where(F.col("x").between(F.col("low"), F.col("high")))
        counts = inside.groupBy("key", "place", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("low"), F.max("x").alias("high"))
        upto = F.sum("c").over(Window.partitionBy("key").orderBy("bucket"))
        found = counts.withColumn("upto", upto).where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("c") <= F.col("place")))
        bounds = settled(bounds.where("low >= high").unionByName(found.select("key", (F.col("place") - F.col("upto") + F.col("c")).alias("place"), "low", "high")))
    return bounds.select("key", F.col("low").alias("value"))


def latency_report(requests: DataFrame, seconds: float, p: float = 0.95, buckets: int = 256) -> DataFrame:
    """Per endpoint: requests, errors, error rate, throughput and the p-th percentile of
    the latencies, by ``selected`` (A18)."""
    of = requests.groupBy("endpoint").agg(F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("ok")).alias("errors"))
    found = selected(requests.select(F.col("endpoint").alias("key"), F.col("ms").alias("x")), p, buckets).select(F.col("key").alias("endpoint"), F.col("value").alias("p95"))
    return of.join(found, "endpoint", "left").select(
        "endpoint", "requests", "errors", (F.col("errors") / F.col("requests")).alias("error_rate"), (F.col("requests") / F.lit(float(seconds))).alias("per_second"), "p95"
    )


def next_chapter(proposed: list[int | None], now: int, most: int) -> int | None:
    """The first proposal that a document at chapter ``now`` can be at: the same or the
    next one; the first chapter at the beginning."""
    allowed = {1} if now == 0 else {now, now + 1}
    return next((n for n in proposed if n in allowed and 1 <= n <= most), None)


def repaired_chapters(chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chapters that only stay or step up by one, from 1 to the document's number of
    chapters (W10). ``chunks``: document_id, chunk_index, content, section, content_type;
    ``chapters``: document_id, n.

    A chunk proposes the chapter that a line at its beginning (180 characters) announces
    in digits, else the major number of its section; a section of another chapter is
    dropped. Proposals are columns; the walk along a document moves three numbers a chunk.
    """
    number = lambda c, pattern: F.regexp_extract(c, pattern, 1).try_cast("int")
    told = number(F.substring("content", 1, 180), K.CHAPTER_LINE)
    major = number(F.coalesce("section", F.lit("")), r"^([0-9]{1,2})\.")
    c = chunks.join(chapters, "document_id").select("document_id", "chunk_index", "section", F.col("n").alias("most"), (F.col("content_type") == "toc").alias("toc"), told.alias("told"), major.alias("major"))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk_index")
        now, labels = 0, []
        for toc, told, major, section, most in group[["toc", "told", "major", "section", "most"]].astype(object).where(group.notna(), None).itertuples(index=False):
            if toc:
                labels.append((None, None))
                continue
            now = next_chapter([told, major], now, most) or now
            fits = not major or next_chapter([major], now, most) is not None
            labels.append((f"第{int(now)}章" if now else None, section if fits else None))
        return pd.DataFrame({"document_id": group["document_id"], "chunk_index": group["chunk_index"], "chapter": [a for a, _ in labels], "section": [b for _, b in labels]})

    return c.groupBy("document_id").applyInPandas(walk, "document_id long, chunk_index long, chapter string, section string")


def reindex_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per document: raw and kept chunks, advertisements left, labelled chunks."""
    raw = before.groupBy("document_id").agg(F.count(F.lit(1)).alias("raw"))
    kept = after.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("kept"), F.count_if(T.is_advertisement("content")).alias("advertisements"), F.count_if(F.col("chapter").isNotNull()).alias("with_chapter"), F.count_if(F.col("section").isNotNull()).alias("with_section")
    )
    return raw.join(kept, "document_id", "left").fillna(0)
