"""Searching and asking, end to end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import arguments
from quillspark.functions import catalogue as K
from quillspark.functions import text as T
from quillspark.operators import conversation as C
from quillspark.operators import evidence as E
from quillspark.operators import retrieval as R
from quillspark.operators.access import User, accessible, matching
from quillspark.operators.index import Index
from quillspark.operators.nearest import scan
from quillspark.plans.api import chapter_contexts, resolved_scopes
from quillspark.sources.tables import settled


@dataclass
class Corpus:
    """What a search reads: ``chunks`` as the search projection has them, vectors
    (chunk_id, embedding) that are current, or what makes them of chunks, and, if there is one, the stored ``index`` of
    the chunks, which the lexical channels then read in place of their texts."""

    chunks: DataFrame
    vectors: DataFrame | Callable[[DataFrame], DataFrame] | None = None
    filters: dict = field(default_factory=dict)
    index: Index | None = None


def search(corpus: Corpus, user: User, queries: DataFrame, limit: int = 12, cap: int = R.CAP, scopes: DataFrame | None = None, most: int = 50) -> DataFrame:
    """Ranked hits of queries (query_id, query and, for the vector channel, vector).

    Access and filters come first, so that all channels see only what the user may; the
    four channels are fused by weighted reciprocal ranks and capped a document. Without
    vectors the search is lexical. ``scopes`` (query_id, document_id) names the documents
    that a question is about.
    """
    limit = arguments.limit(limit, most=most)
    chunks = corpus.chunks.where(accessible(user) & matching(**{"id_col": "document_id", **corpus.filters}))
    n = R.candidate_limit(limit)
    keep = (lambda hits: hits) if scopes is None else R.within(chunks, scopes)
    if corpus.index is None:
        channels = {None: R.lexical_channels(chunks, queries, R.LEXICAL, n, keep), "exact": R.exact_channel(chunks, queries, n, keep=keep)}
    else:
        index = corpus.index.pinned()
        channels = {None: index.lexical_channels(queries, n, chunks, keep), "exact": index.exact_channel(queries, n, allowed=chunks, keep=keep)}
    if corpus.vectors is not None and "vector" in queries.columns:
        own = corpus.vectors(chunks) if callable(corpus.vectors) else corpus.vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        channels["vector"] = scan(own, queries, n, keep=None if scopes is None else keep)
    fused = chunks.join(R.held(R.fuse(channels)), "chunk_id")  # texts of hits only, none is shuffled for it
    fused = fused.withColumn("signature", F.substring(T.signature_text("content"), 1, R.SIGNATURE))
    carry = ["chunk_id", "score", "lexical_score", "semantic_score", *[f"{c}_rank" for c in R.WEIGHTS], "title", "filename", "tags", "chapter", "section", "content", "chunk_index", "document_version", "content_type"]
    return R.capped(fused, limit, cap, carry).join(queries.select("query_id", "query"), "query_id")


def relevant_hits(corpus: Corpus, user: User, queries: DataFrame, limit: int, scopes: DataFrame | None = None) -> DataFrame:
    """Relevant hits of questions, ranked: a question for several facts is searched for
    each; hits that are tables of contents or not relevant to any of them are left out."""
    vector = [c for c in queries.columns if c == "vector"]
    parts = queries.select("query_id", F.posexplode(T.multi_fact_queries("query")).alias("sub", "part"), *vector)
    keyed = parts.select(F.concat_ws("#", "query_id", "sub").alias("query_id"), F.col("part").alias("query"), *vector)
    if scopes is not None:
        scopes = parts.select("query_id", "sub").join(scopes, "query_id").select(F.concat_ws("#", "query_id", "sub").alias("query_id"), "document_id")
    hits = R.relevant(search(corpus, user, keyed, limit * 2, scopes=scopes)).where(F.col("content_type") != "toc")
    hits = hits.withColumns({"sub": F.substring_index("query_id", "#", -1).cast("int"), "query_id": F.expr("substring(query_id, 1, length(query_id) - length(substring_index(query_id, '#', -1)) - 1)")})
    kept = R.merged_subqueries(hits.where("relevant").drop("rank", "position")).drop("query", "relevant")
    return kept.join(queries.select(F.col("query_id").cast("string").alias("query_id"), "query"), "query_id")


def packed_contexts(contexts: DataFrame) -> DataFrame:
    """Evidence of contexts in the order of their position."""
    missing = {c: F.lit(None).cast(kind) for c, kind in (("page_start", "int"), ("page_end", "int"), ("quality_score", "double")) if c not in contexts.columns}
    return E.packed(contexts.withColumns({"pos": F.col("position"), **missing}))


def ask(corpus: Corpus, user: User, queries: DataFrame, limit: int = 6) -> dict[str, DataFrame]:
    """Relevant hits, contexts, packed evidence and extractive answers of questions."""
    kept = relevant_hits(corpus, user, queries, limit)
    contexts = E.chapter_anchored(kept, limit)
    evidence = packed_contexts(contexts)
    return {"hits": kept, "contexts": contexts, "evidence": evidence, "prompt": E.evidence_prompt(evidence), "answers": E.extractive_answers(contexts)}


#: Of a chunk, what contexts and evidence read.
CONTEXT = ("document_version", "title", "filename", "content_type", "page_start", "page_end", "quality_score")


def converse(corpus: Corpus, user: User, turns: DataFrame, docs: DataFrame, cited: DataFrame | None = None, history: DataFrame | None = None, in_base: bool = False, limit: int = 6) -> dict[str, DataFrame]:
    """Answers to the questions of conversations, end to end.

    ``turns``: conv_id, turn, role, text; ``docs``: id, title, owner_id, share_status;
    ``cited``: what answers before a question cited (query_id, document_id), ``history``:
    contexts of them that are still accessible (query_id, position, chunk_id, ...); a
    question's query_id is conv_id/turn.

    A question is classified and, if it leans on the one before, rewritten; refinements
    of an answer are not searched for. Its documents are those that it names, else what
    the conversation was about, else the dominant one of a first search; a second search
    sees those only. Contexts of an overview are representatives of the documents'
    chapters, others are relevant hits with their neighbours; those of a follow-up are
    filled up from the history. Everything is planned for all questions at once; what
    several steps read (result lists, a few rows a question) is stored.
    """
    t = C.rewritten(C.with_history(turns)).withColumn("query_id", F.concat_ws("/", "conv_id", "turn"))
    refined = F.col("intent").isin("refinement", "summarize_previous")
    questions = settled(t.select("query_id", "intent", F.col("query").alias("original"), F.col("rewritten").alias("query"), "applied", "reason", F.try_element_at("answers", F.lit(-1)).alias("before"), C.query_type("query").alias("query_type")))
    asked = questions.where(~refined).select("query_id", "query", "query_type", "intent")
    chunks = corpus.chunks.where(accessible(user) & matching(**{"id_col": "document_id", **corpus.filters}))
    seen = docs.where(accessible(user))

    named = settled(C.named_documents(asked, seen, user.id))
    none = named.where(F.lit(False))
    leaning = asked.where(F.col("intent").isin(*C.LEANING)).select("query_id")
    inherited = none if cited is None else cited.join(leaning, "query_id", "left_semi").select("query_id", "document_id")
    before = settled(named.unionByName(inherited.join(named.select("query_id").distinct(), "query_id", "left_anti")))
    first = settled(relevant_hits(corpus, user, asked.select("query_id", "query"), limit, before))
    scopes = settled(resolved_scopes(asked, seen, named, inherited, R.dominant_document(first), first.where("rank = 1").select("query_id", "document_id"), in_base))
    about = scopes.select("query_id", F.explode("document_ids").alias("document_id"))

    overview = asked.where("query_type = 'overview'").join(about.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "query")
    of_scope = chunks.join(about.join(overview, "query_id"), "document_id")
    of_scope = of_scope.withColumns({c: F.lit(1.0) for c in ("quality_score",) if c not in of_scope.columns})
    chapters = chapter_contexts(of_scope, user)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("document_id", "chunk_index"))
    chapters = chapters.withColumn("position", F.coalesce(*[F.col(c) for c in ("position",) if c in chapters.columns], place).cast("int")).where(F.col("position") <= 2 * limit)

    local = asked.join(overview.select("query_id"), "query_id", "left_anti").select("query_id", "query")
    hits = settled(E.chapter_anchored(relevant_hits(corpus, user, local, limit, about), limit))
    wide = E.neighbours(hits.withColumn("pos", F.col("position")), chunks)
    wide = wide.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("anchor", "document_id", "chunk_index")))
    wide = wide.join(chunks.select("chunk_id", *[c for c in CONTEXT if c in chunks.columns]), "chunk_id").join(local, "query_id")

    columns = ["query_id", "query", "position", "document_id", "document_version", "chunk_id", "chunk_index", "chapter", "section", "title", "filename", "content", "content_type"]
    contexts = wide.select(*columns).unionByName(chapters.select(*columns)).withColumn("content", T.sanitized("content")).where(F.col("content") != "")
    if history is not None:
        old = history.join(leaning, "query_id", "left_semi").join(asked.select("query_id", "query"), "query_id").select(*columns)
        contexts = E.first_wins(contexts, old, 2 * limit)
    contexts = settled(contexts)
    evidence = packed_contexts(contexts)

    said = E.extractive_answers(contexts.join(overview.select("query_id"), "query_id", "left_anti")).unionByName(E.overview_answers(contexts.join(overview.select("query_id"), "query_id", "left_semi")))
    used = contexts.groupBy("query_id").agg(F.array_sort(F.collect_set("document_id")).alias("__ids"), F.array_sort(F.collect_list(F.struct("position", "chunk_id", "content"))).alias("__c"))
    out = questions.join(scopes, "query_id", "left").join(used, "query_id", "left").join(said, "query_id", "left")
    scope = F.when(F.col("query_type") == "overview", F.coalesce(C.explicit_scope("query"), F.lit("document_overview"))).otherwise("local")
    answer = F.when(refined, F.coalesce(T.refined("original", "before"), F.lit(K.NOTHING_KNOWN))).otherwise(F.coalesce("answer", F.lit(K.NOTHING_KNOWN)))
    evidence_of = F.transform(F.coalesce("__c", F.array().cast("array<struct<position:int,chunk_id:bigint,content:string>>")), lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["content"].alias("content")))
    answers = out.select(
        "query_id", "intent", "original", "query", "applied", "reason", "query_type", scope.alias("retrieval_scope"), "document_ids", F.coalesce("scope_source", F.lit("none")).alias("scope_source"),
        F.when(refined | F.col("__c").isNotNull(), "sufficient").otherwise("retrieval_insufficient").alias("outcome"), answer.alias("answer"),
        C.stored_state(F.col("query"), scope, F.coalesce("document_ids", "__ids"), F.lit(1), evidence_of).alias("state"),
    )
    return {"questions": questions, "scopes": scopes, "hits": first, "contexts": contexts, "evidence": evidence, "prompt": E.evidence_prompt(evidence), "answers": answers}
