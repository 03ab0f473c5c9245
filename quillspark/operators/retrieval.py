"""Hybrid retrieval: lexical, metadata, exact and vector channels, fused by ranks
(R2-R6, V1-V2, W1, W2, A11-A13)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.sources.tables import settled

# Channel weights, the constant of rank fusion, limits.
WEIGHTS = {"content": 1.0, "metadata": 1.25, "exact": 1.25, "vector": 1.0}
RRF_K = 60
MIN_COSINE = 0.35
CAP, SIGNATURE = 3, 180


def candidate_limit(limit: int) -> int:
    return min(500, max(60, limit * 8))


def grams(c: Column | str) -> Column:
    """Index terms with repeats: words of a-z, 0-9 and _, pairs of neighbouring Han."""
    runs = F.regexp_extract_all(F.lower(T.text(c)), F.lit(r"[a-z0-9_]+|[\x{4e00}-\x{9fff}]+"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"^[\x{4e00}-\x{9fff}]{2,}$"), pairs(r)).otherwise(F.array(r))))


def broadcast_if_small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` to be broadcast if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def held(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` computed once for the several places that read it: to be broadcast if it has
    at most ``rows`` rows, else stored in the shared folder."""
    found = df.limit(rows + 1).collect()
    return settled(df) if len(found) > rows else F.broadcast(df.sparkSession.createDataFrame(found, df.schema))


def field_text(chunks: DataFrame, names: Sequence[str]) -> Column:
    """The text that a channel reads of the columns ``names``."""
    kinds = dict(chunks.dtypes)
    return F.concat_ws(" ", *[T.text(F.array_join(f, " ") if kinds[f].startswith("array") else f) for f in names])


def index_terms(chunks: DataFrame, fields: dict[str, Sequence[str]], carry: Sequence[str] = ()) -> DataFrame:
    """(channel, term, chunk_id) of each channel's fields, a row per occurrence, in one
    pass over the chunks; ``carry`` names further columns of a chunk."""
    found = F.array(*[F.struct(F.lit(name).alias("channel"), grams(field_text(chunks, names)).alias("terms")) for name, names in fields.items()])
    one = chunks.select("chunk_id", *carry, F.explode(found).alias("f"))
    return one.select("f.channel", F.explode("f.terms").alias("term"), "chunk_id", *carry)


def postings(chunks: DataFrame, fields: dict[str, Sequence[str]], only: DataFrame | None = None) -> DataFrame:
    """(channel, term, chunk_id, tf): the inverted index of the channels' fields, of the
    terms ``only`` if given, which are filtered before anything is shuffled. Repeats
    within a chunk combine before the shuffle."""
    terms = index_terms(chunks, fields)
    terms = terms if only is None else terms.join(broadcast_if_small(only), "term", "left_semi")
    return terms.groupBy("channel", "term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))


def in_blocks(queries: DataFrame, size: int, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``search`` over all queries, ``size`` at a time, so that what it broadcasts is
    never more than ``size`` rows; each block is one pass over the index."""
    n = queries.count()
    if n <= size:
        return search(F.broadcast(queries))
    numbered = queries.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(-(-2 * n // size))))
    found = [search(F.broadcast(numbered.where(F.col("__block") == b).drop("__block"))) for b in range(-(-2 * n // size))]
    return reduce(DataFrame.unionByName, found)


def query_grams(queries: DataFrame) -> DataFrame:
    """(query_id, term), distinct."""
    return queries.select("query_id", F.explode(F.array_distinct(F.flatten(F.transform(T.query_terms("query"), grams)))).alias("term"))


def within(chunks: DataFrame, scopes: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What keeps of hits (query_id, chunk_id, ...) those of the documents that their
    question is about; ``scopes``: query_id, document_id. A question without a row there
    is about all documents."""
    s = scopes.select("query_id", "document_id").distinct()
    asked = s.select("query_id").distinct().withColumn("__asked", F.lit(True))

    def keep(hits: DataFrame) -> DataFrame:
        h = hits.join(chunks.select("chunk_id", "document_id"), "chunk_id").join(broadcast_if_small(asked), "query_id", "left")
        h = h.join(broadcast_if_small(s.withColumn("__in", F.lit(True))), ["query_id", "document_id"], "left")
        return h.where(F.col("__asked").isNull() | F.col("__in")).select(*hits.columns)

    return keep


def ranked(hits: DataFrame, limit: int, *by: str) -> DataFrame:
    """The best ``limit`` hits of each query (and of ``by``) with their ranks, ties by chunk."""
    w = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def lexical_channels(chunks: DataFrame, queries: DataFrame, fields: dict[str, Sequence[str]], limit: int, keep: Callable[[DataFrame], DataFrame] = lambda hits: hits) -> DataFrame:
    """(channel, query_id, chunk_id, score, rank) of the hits that ``keep`` keeps, by the sum of tf x idf squared over the
    query's terms in a channel's fields, idf = log10(chunks / chunks with the term).

    Terms that no query has are dropped where they are read, so what is shuffled grows
    with the queries' hits, not with the index. The postings are shuffled once: document
    frequencies count the same rows (of the column that scores need, so that the plan
    reuses the exchange).
    """
    terms = query_grams(queries)
    total = chunks.agg(F.count(F.lit(1)).alias("total"))
    found = postings(chunks, fields, only=terms.select("term").distinct())
    return scored_channels(terms, found, total, limit, keep)


def scored_channels(terms: DataFrame, found: DataFrame, total: DataFrame, limit: int, keep: Callable[[DataFrame], DataFrame], key: Sequence[str] = ()) -> DataFrame:
    """Ranked hits of queries' ``terms`` (query_id, term) in postings ``found`` (channel,
    term, chunk_id, tf) of ``total`` chunks (one row). ``key`` names columns of a chunk
    that ``found`` is dealt out by: scores are summed where the postings are. The weights,
    a few rows a term, go to them where they are few."""
    few = terms.limit(10_001).count() <= 10_000
    df = found.groupBy("channel", "term").agg(F.count("tf").alias("df"))
    idf = df.select("channel", "term", F.pow(F.log10(total.scalar() / F.col("df")), F.lit(2)).alias("idf2"))
    weights = terms.join(idf, "term")
    scored = found.join(F.broadcast(weights) if few else weights, ["channel", "term"]).groupBy("channel", "query_id", *key, "chunk_id").agg(F.round(F.sum(F.col("tf") * F.col("idf2")), 8).alias("score"))
    return ranked(keep(scored.where("score > 0").drop(*key)), limit, "channel")


def lexical_channel(chunks: DataFrame, queries: DataFrame, fields: Sequence[str], limit: int) -> DataFrame:
    """One of ``lexical_channels``: (query_id, chunk_id, score, rank)."""
    return lexical_channels(chunks, queries, {"content": fields}, limit).drop("channel")


#: What the two lexical channels of a search read.
LEXICAL = {"content": ("content", "chapter", "section"), "metadata": ("title", "filename", "tags")}


def metadata_text() -> Column:
    """What the exact channel reads of a chunk beside its content."""
    return F.lower(F.concat_ws(" ", T.text("title"), T.text("filename"), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")))


def exact_channel(chunks: DataFrame, queries: DataFrame, limit: int, terms: int = 8, keep: Callable[[DataFrame], DataFrame] = lambda hits: hits) -> DataFrame:
    """Chunks that hold one of a query's first terms: of four characters or more
    anywhere, shorter ones in title, filename or tags only. Score 1, rank by chunk."""
    q = queries.select("query_id", F.slice(F.filter(T.query_terms("query"), lambda t: F.length(t) >= 2), 1, terms).alias("terms"))
    c = chunks.select("chunk_id", F.lower(T.text("content")).alias("__body"), metadata_text().alias("__meta"))
    hit = F.exists("terms", lambda t: F.contains(F.col("__meta"), t) | ((F.length(t) >= 4) & F.contains(F.col("__body"), t)))
    found = in_blocks(q, 1000, lambda some: c.join(some, hit).select("query_id", "chunk_id", F.lit(1.0).alias("score")))
    return ranked(keep(found), limit)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine in double precision; -1 for empty, unequal or zero vectors."""
    a, b = (F.transform(T.col(x), lambda v: v.cast("double")) for x in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fine = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(~F.coalesce(fine, F.lit(False)), -1.0).otherwise(F.when(F.coalesce(norm, F.lit(0.0)) == 0, -1.0).otherwise(dot(a, b) / norm))


def vector_channel(vectors: DataFrame, queries: DataFrame, limit: int, least: float = MIN_COSINE, keep: Callable[[DataFrame], DataFrame] = lambda hits: hits) -> DataFrame:
    """Current vectors (chunk_id, embedding) by cosine with each query's (query_id,
    vector), those that are no number left out: the unrounded value decides, the rounded one ranks. Each query scans all
    vectors once; the queries, few and small, are the broadcast side."""
    near = cosine("embedding", "vector")
    search = lambda some: vectors.select("chunk_id", "embedding").join(some, (near >= least) & ~F.isnan(near)).select("query_id", "chunk_id", near.alias("c"))
    scored = in_blocks(queries.select("query_id", "vector"), 1000, search)
    return ranked(keep(scored.select("query_id", "chunk_id", F.round("c", 4).alias("score"))), limit)


def fuse(channels: dict[str | None, DataFrame], weights: dict[str, float] = WEIGHTS, k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal ranks: rows (query_id, chunk_id, rrf, score = rrf over the
    query's largest, a rank per channel, lexical_score, semantic_score, rank). Hits under
    the name None tell their channel in a column of it."""
    rows = None
    for name, hits in channels.items():
        channel = F.col("channel") if name is None else F.lit(name)
        weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), channel)
        one = hits.select("query_id", "chunk_id", channel.alias("channel"), (weight / (k + F.col("rank"))).alias("part"), "rank", F.col("score").alias("s"))
        rows = one if rows is None else rows.unionByName(one)
    got = rows.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum("part"), 12).alias("rrf"),
        *[F.max(F.when(F.col("channel") == c, F.col("rank"))).alias(f"{c}_rank") for c in WEIGHTS],
        F.coalesce(F.max(F.when(F.col("channel") != "vector", F.col("s"))), F.lit(0.0)).alias("lexical_score"),
        F.coalesce(F.max(F.when(F.col("channel") == "vector", F.col("s"))), F.lit(-1.0)).alias("semantic_score"),
    )
    best = F.max("rrf").over(Window.partitionBy("query_id"))
    got = got.withColumn("score", F.col("rrf") / F.greatest(best, F.lit(1e-6)))
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "chunk_id")))


def capped(hits: DataFrame, limit: int, cap: int = CAP, carry: Sequence[str] = ()) -> DataFrame:
    """The first ``limit`` hits by rank, at most ``cap`` a document and one of each
    passage, where a passage counts as seen only once it is taken.

    ``hits``: query_id, rank, document_id, signature. Whether a hit is taken depends on
    those taken before, so each query's candidates (at most a few hundred, by the
    channels' limits) are folded in order as an array.
    """
    row = F.struct("rank", "document_id", "signature", *carry)
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("h"))

    def step(taken: Column, x: Column) -> Column:
        full = F.size(taken) >= limit
        crowded = F.size(F.filter(taken, lambda t: t["document_id"] == x["document_id"])) >= cap
        known = (x["signature"] != "") & F.exists(taken, lambda t: t["signature"] == x["signature"])
        return F.when(full | crowded | known, taken).otherwise(F.concat(taken, F.array(x)))

    kind = dict(hits.select(F.array(row).alias("h")).dtypes)["h"]
    taken = lists.select("query_id", F.posexplode(F.aggregate("h", F.array().cast(kind), step)).alias("pos", "x"))
    return taken.select("query_id", (F.col("pos") + 1).alias("position"), "x.*")


def related_documents(hits: DataFrame, k: int = 6) -> DataFrame:
    """Documents of a result list: best score, hits, first rank; the top ``k``."""
    got = hits.groupBy("query_id", "document_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first_rank"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("hits"), "first_rank")
    return got.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def dominant_document(hits: DataFrame, first: int = 8, least: int = 2, ratio: float = 1.15) -> DataFrame:
    """The document that most of the first relevant hits come from: (query_id,
    document_id), where it has two or more and, on a tie of counts, leads the next
    one's score by 15 %."""
    got = hits.where(F.col("rank") <= first).groupBy("query_id", "document_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 10).alias("s"), F.min("rank").alias("r"))
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), F.desc("s"), "r")
    got = got.withColumns({"place": F.row_number().over(w), "n2": F.lead("n").over(w), "s2": F.lead("s").over(w)})
    clear = F.col("n2").isNull() | (F.col("n") > F.col("n2")) | (F.col("s") >= F.col("s2") * ratio)
    return got.where((F.col("place") == 1) & (F.col("n") >= least) & clear).select("query_id", "document_id")


def strongest_document(hits: DataFrame, candidates: DataFrame) -> DataFrame:
    """Of the candidates (query_id, document_id, pos) the one with most and best hits,
    or the first (A13)."""
    got = hits.groupBy("query_id", "document_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 10).alias("s"))
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), F.desc("s"), "pos")
    j = candidates.join(got, ["query_id", "document_id"], "left").fillna(0, ["n", "s"])
    return j.withColumn("place", F.row_number().over(w)).where("place = 1").select("query_id", "document_id")


def merged_subqueries(hits: DataFrame) -> DataFrame:
    """Hits of a question's sub-queries (query_id, sub, chunk_id, score, relevant, ...) as
    one list: the best relevant hit of each sub-query first, then all by best score (R13).
    Windows over the hits themselves, which are not joined to anything again."""
    w = Window.partitionBy("query_id", "sub").orderBy(F.desc("relevant"), F.desc("score"), "chunk_id")
    one = Window.partitionBy("query_id", "chunk_id")
    h = hits.withColumn("__seed", F.when(F.col("relevant") & (F.row_number().over(w) == 1), F.col("sub")))
    h = h.withColumns({"__seed": F.min("__seed").over(one), "score": F.max("score").over(one), "__rn": F.row_number().over(one.orderBy("sub"))}).where(F.col("__rn") == 1)
    order = Window.partitionBy("query_id").orderBy(F.col("__seed").asc_nulls_last(), F.desc("score"), "chunk_id")
    return h.withColumn("rank", F.row_number().over(order)).drop("__seed", "__rn")


def outcome(hits: DataFrame, first: int = 3) -> DataFrame:
    """Whether a result list (query_id, query, rank, the channels' ranks, title, filename,
    tags, chapter, section, content) is sufficient (R20): channels agree, two passages
    cover 0.3 of the terms, metadata match, or one covers 0.55."""
    agree = F.size(F.filter(F.array(*[F.col(f"{c}_rank") for c in WEIGHTS]), lambda x: x.isNotNull())) >= 2
    cover = T.outcome_coverage("query", "title", "filename", "chapter", "section", "content")
    q = T.signature_text("query")
    fields = F.transform(F.concat(F.array("title", "filename"), "tags"), lambda f: T.signature_text(T.text(f)))
    exact = F.exists(fields, lambda f: (F.length(f) >= 2) & (F.contains(q, f) | F.contains(f, q)))
    got = hits.where(F.col("rank") <= first).groupBy("query_id").agg(F.bool_or(agree).alias("a"), F.count_if(cover >= 0.3).alias("n"), F.bool_or(exact).alias("e"), F.max(cover).alias("m"))
    return got.select("query_id", F.when(F.col("a") | (F.col("n") >= 2) | F.col("e") | (F.col("m") >= 0.55), "sufficient").otherwise("retrieval_insufficient").alias("outcome"))


def relevant(hits: DataFrame) -> DataFrame:
    """Add ``relevant`` (R11): the passage holds what is asked the definition of and the
    chapter matches, a third of the terms or a Latin term occurs, or any term does and
    the lexical score or two channels support it."""
    h = hits.withColumns(
        {"__chapter": T.requested_chapter("query"), "__cover": T.term_coverage("query", "title", "chapter", "section", "content"), "__subject": T.definition_subject("query"), "__terms": T.core_terms("query"),
         "__where": T.normalized(F.concat_ws(" ", T.text("title"), T.text("content"))), "__body": T.normalized(T.text("content"))}
    )
    latin = F.filter("__terms", lambda t: t.rlike("(?i)^[a-z0-9_]+$"))
    agree = F.size(F.filter(F.array(*[F.col(f"{c}_rank") for c in WEIGHTS]), lambda x: x.isNotNull())) >= 2
    cover = F.col("__cover")
    support = (cover >= 0.3) | F.exists(latin, lambda t: F.contains(F.col("__where"), T.normalized(t))) | ((cover > 0) & ((F.coalesce("lexical_score", F.lit(0.0)) >= 0.18) | agree))
    ok = T.subject_defined(F.col("__subject"), F.col("__body")) & (F.coalesce(F.col("__chapter") == F.col("chapter"), F.lit(False)) | support)
    return h.withColumn("relevant", ok).drop("__chapter", "__cover", "__subject", "__terms", "__where", "__body")
