"""From hits to evidence and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import catalogue as K
from quillspark.functions import text as T

REPRESENTATIVES, CHAPTERS = 16, 24


def neighbours(anchors: DataFrame, chunks: DataFrame, reach: int = 1) -> DataFrame:
    """Chunks at most ``reach`` from an anchor in its document, version and chapter, and
    its section unless the anchor is a heading without one (J5).

    The first anchor (by ``pos``) that fits gives score, chapter and section; rows are in
    order of document and place. An equi-join on the exact neighbour places, so a long
    document costs its anchors, not its length.
    """
    a = anchors.select(
        "query_id", "pos", "document_id", F.col("document_version").alias("av"), F.col("chunk_index").alias("ai"), F.col("chapter").alias("ach"),
        F.col("section").alias("ase"), F.col("content_type").alias("at"), "score", F.explode(F.sequence(F.col("chunk_index") - reach, F.col("chunk_index") + reach)).alias("chunk_index"),
    )
    j = a.join(chunks, ["document_id", "chunk_index"])
    fits = (F.col("document_version") == F.col("av")) & F.col("chapter").eqNullSafe(F.col("ach"))
    fits &= F.col("section").eqNullSafe(F.col("ase")) | (F.col("ase").isNull() & (F.col("at") == "heading"))
    w = Window.partitionBy("query_id", "chunk_id").orderBy("pos")
    got = j.where(fits).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1)
    return got.select("query_id", "document_id", "chunk_index", "chunk_id", "content", F.col("ach").alias("chapter"), F.col("ase").alias("section"), "score", F.col("pos").alias("anchor"))


def contiguous(hits: DataFrame) -> DataFrame:
    """Number the runs of consecutive chunks of one section among a query's hits
    (query_id, document_id, document_version, chapter, section, chunk_index, pos); runs
    are ordered by their best position (W5). Gaps and islands."""
    same = ["query_id", "document_id", "document_version", "chapter", "section"]
    island = F.col("chunk_index") - F.row_number().over(Window.partitionBy(*same).orderBy("chunk_index"))
    h = hits.withColumn("__island", island)
    h = h.withColumn("anchor", F.min("pos").over(Window.partitionBy(*same, "__island")))
    return h.withColumn("run", F.dense_rank().over(Window.partitionBy("query_id").orderBy("anchor"))).drop("__island")


def overlap_merged(parts: Column, overlap: bool = False, most: int = 240) -> Column:
    """Passages as one text, line by line; with ``overlap``, what one ends and the next
    begins with (20 to ``most`` characters) is kept once (R19)."""
    if not overlap:
        return F.array_join(parts, "\n")

    def add(left: Column, right: Column) -> Column:
        top = F.least(F.lit(most), F.length(left), F.length(right))
        sizes = F.when(top >= 20, F.sequence(top, F.lit(20), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        size = F.try_element_at(F.filter(sizes, lambda n: F.right(left, n) == F.left(right, n)), F.lit(1))
        return F.when(size.isNull(), F.concat(left, F.lit("\n"), right)).otherwise(F.concat(left, F.substring(right, size + 1, F.length(right))))

    return F.aggregate(F.slice(parts, 2, 1 << 30), F.element_at(parts, 1), add)


def packed(hits: DataFrame, budget: int = 6000, overhead: int = 32, overlap: bool = False) -> DataFrame:
    """Evidence within a budget of tokens (W6): runs of hits in order, each as one text
    without injected sentences. A run too large tries its first chunk alone; one that
    still does not fit is passed over and later ones are tried.

    ``hits``: query_id, pos, document_id, document_version, chunk_index, chapter, section,
    title, filename, content, page_start, page_end, quality_score. A query's runs (its
    result list is bounded) are folded in order as an array.
    """
    inside = ["chunk_index", "content", "page_start", "page_end", "quality_score"]
    runs = contiguous(hits).groupBy("query_id", "run", "document_id", "chapter", "section", "title", "filename").agg(F.array_sort(F.collect_list(F.struct(*inside))).alias("c"))

    def form(c: Column) -> Column:
        raw = overlap_merged(F.transform(c, lambda x: T.trimmed(x["content"])), overlap)
        return F.struct(T.sanitized(raw).alias("text"), F.size(T.sentences(raw)).alias("lines"))

    head = T.estimated_tokens(F.concat_ws(" ", "title", "filename", F.coalesce("chapter", F.lit("")), F.coalesce("section", F.lit(""))))
    cost = lambda f: head + T.estimated_tokens(f["text"]) + overhead
    first = F.slice("c", 1, 1)
    r = runs.withColumns({"whole": form(F.col("c")), "alone": form(first)})
    option = lambda f, c: F.struct(f["text"].alias("text"), cost(f).alias("cost"), F.greatest(F.lit(0), f["lines"] - F.size(T.sentences(f["text"]))).alias("redacted"), F.size(c).alias("n"))
    r = r.withColumns({"w": option(F.col("whole"), F.col("c")), "a": option(F.col("alone"), first)})
    lists = r.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("run", "w", "a"))).alias("runs"))

    def step(state: Column, x: Column) -> Column:
        fits = lambda o: (o["text"] != "") & (o["cost"] <= state["left"])
        use = F.when(fits(x["w"]), x["w"]).when((x["w"]["text"] != "") & (x["w"]["n"] > 1) & fits(x["a"]), x["a"])
        taken = F.struct(x["run"].alias("run"), use["text"].alias("text"), use["cost"].alias("cost"), use["n"].alias("n"), use["redacted"].alias("redacted"))
        return F.struct(
            F.when(use.isNull(), state["left"]).otherwise(state["left"] - use["cost"]).alias("left"), F.when(use.isNull(), state["got"]).otherwise(F.concat(state["got"], F.array(taken))).alias("got")
        )

    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<struct<run:int,text:string,cost:bigint,n:int,redacted:int>>").alias("got"))
    got = lists.select("query_id", F.posexplode(F.aggregate("runs", start, step)["got"]).alias("p", "t")).select("query_id", (F.col("p") + 1).alias("evidence_id"), "t.*")
    meta = runs.withColumnRenamed("n", "__n") if "n" in runs.columns else runs
    j = got.join(meta, ["query_id", "run"])
    c = F.slice("c", F.lit(1), F.col("n"))
    pages = lambda f: F.filter(F.transform(c, lambda x: x[f]), lambda v: v.isNotNull())
    return j.select(
        "query_id", "evidence_id", "document_id", "title", "chapter", "section", "text", "cost", "redacted",
        F.transform(c, lambda x: x["chunk_index"]).alias("chunks"), F.try_element_at(pages("page_start"), F.lit(1)).alias("page_start"),
        F.try_element_at(pages("page_end"), F.lit(-1)).alias("page_end"), F.array_min(F.transform(c, lambda x: x["quality_score"])).alias("quality"),
    )


def first_wins(current: DataFrame, historical: DataFrame, limit: int = 6) -> DataFrame:
    """Hits of two lists (query_id, position, chunk_id, ...) as one of at most ``limit``
    (U1): the current ones in order, then those of before that are not among them."""
    both = current.withColumn("__source", F.lit(0)).unionByName(historical.withColumn("__source", F.lit(1)), allowMissingColumns=True)
    order = (F.col("__source"), F.col("position"), F.col("chunk_id"))
    first = both.withColumn("__rn", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(*order))).where(F.col("__rn") == 1)
    merged = first.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return merged.where(F.col("position") <= limit).drop("__source", "__rn")


def evidence_prompt(evidence: DataFrame) -> DataFrame:
    """One text per query: numbered, escaped evidence in order."""
    place = F.concat_ws(" / ", T.escaped("title"), T.escaped("chapter"), T.escaped("section"))
    line = F.concat(F.lit("["), F.col("evidence_id").cast("string"), F.lit("] "), place, F.lit("\n"), T.escaped("text"))
    return evidence.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("evidence_id", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("prompt"))


# ---- representatives --------------------------------------------------------------


def representative_rank() -> Column:
    """How well a chunk stands for its surroundings."""
    body = T.compact(T.text("content"))
    letters = T.count_chars(body, r"\p{L}\p{N}")
    han = F.when(letters > 0, T.count_chars(body, r"\p{IsHan}") / letters).otherwise(0.0)
    kind = F.when(F.col("content_type") == "content", 3.0).when(F.col("content_type") == "heading", 1.0).otherwise(0.0)
    exercise = F.when(F.concat_ws(" ", F.coalesce("section", F.lit("")), "content").rlike(K.EXERCISES), 2.0).otherwise(0.0)
    named = F.when(F.coalesce("section", F.lit("")) != "", 0.8).otherwise(0.0)
    short = F.when(F.length(body) < 120, 1.5).otherwise(0.0)
    return kind + named + F.coalesce(F.col("quality_score"), F.lit(0.0)) + han * 3 - exercise + F.least(F.lit(1.2), F.length(body) / 500) - short


def body_chunks(chunks: DataFrame) -> DataFrame:
    """Neither tables of contents nor exercises."""
    return chunks.where((F.col("content_type") != "toc") & ~F.concat_ws(" ", F.coalesce("section", F.lit("")), F.substring("content", 1, 120)).rlike(K.EXERCISES))


def representatives(chunks: DataFrame, limit: int = REPRESENTATIVES, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The best chunk of each of up to ``limit`` stretches of equal length."""
    order = Window.partitionBy(*by).orderBy("document_id", "chunk_index")
    c = body_chunks(chunks).withColumn("r", F.round(representative_rank(), 10)).withColumn("__i", F.row_number().over(order) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    c = c.withColumn("bucket", F.floor(F.col("__i") * F.least(F.lit(limit), "__n") / F.col("__n")))
    best = Window.partitionBy(*by, "bucket").orderBy(F.desc("r"), "document_id", "chunk_index")
    return c.withColumn("__rn", F.row_number().over(best)).where(F.col("__rn") == 1).drop("__rn", "__i", "__n")


def chapter_representatives(chunks: DataFrame, limit: int = REPRESENTATIVES, chapters: int = CHAPTERS) -> DataFrame:
    """The best chunk of each section of the first ``chapters`` chapters, a section of
    every chapter in turn until there are ``limit`` (W8); one chapter gives its first.

    Chapters without any section have four stretches instead. Where no chunk has a
    chapter, use ``representatives``.
    """
    number = F.coalesce(F.regexp_extract(F.col("chapter"), "第([0-9]+)章", 1).try_cast("int"), F.lit(999))
    c = chunks.where(F.coalesce("chapter", F.lit("")) != "").withColumn("__no", number)
    group = ["query_id", "document_id", "chapter"]
    first = c.groupBy("query_id", "document_id", "chapter", "__no").agg(F.min("chunk_index").alias("__first"))
    place = first.withColumn("__chapter", F.row_number().over(Window.partitionBy("query_id").orderBy("__no", "document_id", "__first"))).where(F.col("__chapter") <= chapters)
    c = body_chunks(c.join(place.select(*group, "__chapter"), group))
    w = Window.partitionBy(*group)
    sectioned = F.max((F.coalesce("section", F.lit("")) != "").cast("int")).over(w) == 1
    stretch = F.floor((F.row_number().over(w.orderBy("chunk_index")) - 1) * 4 / F.count(F.lit(1)).over(w)).cast("string")
    major = F.regexp_extract(F.coalesce("section", F.lit("")), r"^([0-9]+\.[0-9]+)", 1)
    own = F.when(major != "", major).when(F.coalesce("section", F.lit("")) != "", F.col("section")).otherwise("unsectioned")
    c = c.withColumn("bucket", F.when(sectioned, own).otherwise(stretch)).withColumn("r", F.round(representative_rank(), 10))
    b = Window.partitionBy(*group, "bucket")
    c = c.withColumn("__begin", F.min("chunk_index").over(b)).withColumn("__rn", F.row_number().over(b.orderBy(F.desc("r"), "chunk_index"))).where(F.col("__rn") == 1)
    c = c.withColumn("__turn", F.row_number().over(Window.partitionBy(*group).orderBy("__begin")))
    order = Window.partitionBy("query_id").orderBy("__turn", "__chapter")
    return c.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).drop("__no", "__chapter", "__begin", "__rn", "__turn")


def systematic_sample(rows: DataFrame, k: int, by: list[str], order: list[str]) -> DataFrame:
    """Rows at the places round(i (n-1) / (k-1)), i < k, of each group; all if n <= k."""
    w = Window.partitionBy(*by)
    r = rows.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("__n") - 1) / F.lit(max(k - 1, 1)) + 0.5))
    return r.where((F.col("__n") <= k) | F.array_contains(places, F.col("__i").cast("long"))).drop("__i", "__n")


def chapter_anchored(hits: DataFrame, limit: int = 5) -> DataFrame:
    """Answer contexts (R14): where the question names a chapter, hits that name it too,
    of the first such hit's document; else the first hits of the best hit's document; and
    the first hits where it names none."""
    marker = F.regexp_extract(T.compact("query"), K.CHAPTER, 0)
    digits = {c: str(i) for i, c in enumerate("一二三四五六七八九十", 1)}
    raw = F.regexp_extract(T.compact("query"), K.CHAPTER, 1)
    other = F.concat(F.lit("第"), F.element_at(F.create_map(*[F.lit(x) for kv in digits.items() for x in kv]), raw), F.lit("章"))
    where = T.compact(F.concat_ws("", *[T.text(c) for c in ("title", "chapter", "section", "content")]))
    h = hits.withColumn("__asked", marker != "").withColumn("__in", F.coalesce(F.contains(where, marker), F.lit(False)) | F.coalesce(F.contains(where, other), F.lit(False)))
    w = Window.partitionBy("query_id")
    h = h.withColumn("__any", F.max(F.col("__in").cast("int")).over(w) == 1)
    h = h.withColumn("__doc", F.coalesce(F.min_by("document_id", F.when(F.col("__in"), F.col("rank"))).over(w), F.min_by("document_id", "rank").over(w)))
    keep = ~F.col("__asked") | ((F.col("document_id") == F.col("__doc")) & (~F.col("__any") | F.col("__in")))
    h = h.where(keep).withColumn("position", F.row_number().over(w.orderBy("rank"))).where(F.col("position") <= limit)
    return h.drop("__asked", "__in", "__any", "__doc")


# ---- answers -----------------------------------------------------------------------


def extractive_answers(hits: DataFrame) -> DataFrame:
    """One answer per query from its first four hits (query_id, query, position, content):
    the sentences that hold the question's terms, cited by position, each passage once,
    with a notice where the sources disagree (X12)."""
    h = hits.where(F.col("position") <= 4).withColumn("__s", T.evidence_sentences("query", "content"))
    h = h.withColumn("__e", F.substring(F.array_join("__s", " "), 1, 600)).withColumn("__sig", F.substring(T.compact("__e"), 1, 80))
    first = F.row_number().over(Window.partitionBy("query_id", "__sig").orderBy("position"))
    h = h.where(F.col("__e") != "").withColumn("__rn", first).where(F.col("__rn") == 1)
    got = h.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("position", F.col("__e").alias("e"), F.col("__s").alias("s")))).alias("x"))
    parts = F.transform("x", lambda x: F.concat(x["e"], F.lit(" ["), x["position"].cast("string"), F.lit("]")))
    clash = F.size(T.conflict_values("query", F.array_join(F.flatten(F.transform("x", lambda x: x["s"])), "\n"))) > 0
    head, foot = K.ANSWER_HEAD.split("{}"), F.array(F.lit(K.ANSWER_FOOT))
    notice = F.when(clash, F.array(F.lit(K.CONFLICT_NOTICE))).otherwise(F.array().cast("array<string>"))
    whole = F.concat(F.array(F.concat(F.lit(head[0]), T.trimmed("query"), F.lit(head[1]))), notice, parts, foot)
    return got.select("query_id", F.array_join(whole, "\n\n").alias("answer"))


def overview_answers(hits: DataFrame) -> DataFrame:
    """One line per hit: its section, chapter or number and two sentences."""
    label = F.coalesce("section", "chapter", F.concat(F.lit(K.SOURCE_LABEL), F.col("position").cast("string")))
    said = F.substring(F.array_join(F.slice(T.sentences(T.sanitized("content")), 1, 2), " "), 1, 260)
    line = F.concat(F.lit("- "), label, F.lit("："), said, F.lit(" ["), F.col("position").cast("string"), F.lit("]"))
    got = hits.groupBy("query_id", "query").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("l")))), lambda x: x["l"]).alias("l"))
    head = K.OVERVIEW_HEAD.split("{}")
    return got.select("query_id", F.array_join(F.concat(F.array(F.concat(F.lit(head[0]), T.trimmed("query"), F.lit(head[1]))), F.col("l")), "\n").alias("answer"))


def citations(hits: DataFrame) -> DataFrame:
    """Hits as stored citations, content cut to 320 characters."""
    return hits.withColumn("content", F.substring("content", 1, 320))


def detailed_enough(answers: DataFrame) -> DataFrame:
    """Whether an overview (answer, documents, chapters, sections and what it cites of
    them, as arrays) is detailed (X16): 36 characters, all documents, 80 % of three or
    more chapters, 60 % of three or more sections."""
    part = lambda have, all_, share: (F.size(F.array_distinct(all_)) < 3) | (F.size(F.array_intersect(have, all_)) >= F.ceil(F.size(F.array_distinct(all_)) * share))
    ok = (F.length(T.compact("answer")) >= 36) & (F.size(F.array_except("documents", "cited_documents")) == 0)
    return answers.withColumn("detailed", ok & part(F.col("cited_chapters"), F.col("chapters"), 0.8) & part(F.col("cited_sections"), F.col("sections"), 0.6))
