"""What callers ask for, as plans over the engine's tables (§2.13, C7, R16, R17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import catalogue as K
from quillspark.functions import text as T
from quillspark.operators import analytics, evidence
from quillspark.operators.access import User, accessible, accessible_base, hidden_when_revoked, in_bases, in_scope, matching
from quillspark.operators.conversation import asks_for_several_documents


def list_documents(docs: DataFrame, favorites: DataFrame, user: User, scope: str = "all", sort: str = "updated", limit: int = 50, links: DataFrame | None = None, bases: list[int] | None = None, **filters) -> DataFrame:
    found = in_scope(docs, user, scope, favorites).where(matching(**filters))
    if bases and links is not None:
        found = in_bases(found, links, bases)
    return analytics.listing(found, sort, limit)


def document_detail(docs: DataFrame, links: DataFrame, bases: DataFrame, versions: DataFrame, user: User, document_id: int) -> DataFrame:
    """One document with its bases and, latest first, its versions, as nested arrays."""
    one = docs.where((F.col("id") == document_id) & accessible(user))
    mine = links.where(F.col("document_id") == document_id).join(bases.where(accessible_base(user)).select(F.col("id").alias("kb_id"), "name"), "kb_id")
    kb = mine.agg(F.array_sort(F.collect_list(F.struct("kb_id", "name"))).alias("bases"))
    old = versions.where(F.col("document_id") == document_id).agg(F.reverse(F.array_sort(F.collect_list(F.struct("version", "filename")))).alias("versions"))
    return one.crossJoin(kb).crossJoin(old)  # one row each


def list_bases(bases: DataFrame, links: DataFrame, user: User) -> DataFrame:
    """Bases the user may see, with all documents linked to them counted."""
    n = links.groupBy(F.col("kb_id").alias("id")).agg(F.count("document_id").alias("documents"))
    return bases.where(accessible_base(user)).join(n, "id", "left").fillna(0, ["documents"]).orderBy("id")


def list_sessions(sessions: DataFrame, messages: DataFrame, bases: DataFrame, user: User) -> DataFrame:
    """The user's sessions with their messages counted; those of a base that the user may
    no longer see are left out."""
    n = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"))
    seen = bases.where(accessible_base(user)).select(F.col("id").alias("kb_id"), F.lit(True).alias("__ok"))
    mine = sessions.where(F.col("user_id") == user.id).join(seen, "kb_id", "left").where(F.col("kb_id").isNull() | F.col("__ok"))
    return mine.drop("__ok").join(n.withColumnRenamed("session_id", "id"), "id", "left").fillna(0, ["messages"]).orderBy(F.desc("updated_at"), F.desc("id"))


def session_messages(messages: DataFrame, docs: DataFrame, user: User, session_id: int) -> DataFrame:
    """Messages of a session in order, those that cite what was revoked blanked."""
    return hidden_when_revoked(messages.where(F.col("session_id") == session_id), docs.where(accessible(user)).select("id")).orderBy("message_id")


def comments_of(comments: DataFrame, users: DataFrame, document_id: int) -> DataFrame:
    named = users.select(F.col("id").alias("user_id"), F.col("username"))
    return comments.where(F.col("document_id") == document_id).join(named, "user_id").orderBy(F.desc("created_at"), F.desc("id"))


def admin_users(users: DataFrame, docs: DataFrame, viewer: User) -> DataFrame:
    """Users with what they own counted; contacts masked but for the viewer's own row
    and for system admins."""
    plain = F.lit(viewer.role == "system_admin") | (F.col("id") == viewer.id)
    out = analytics.user_overview(users, docs)
    return out.withColumns({c: F.when(plain, F.col(c)).otherwise(T.masked_contact(c)) for c in ("email", "phone") if c in users.columns})


def chapter_contexts(chunks: DataFrame, user: User, chapter: str | None = None, most: int = 4000) -> DataFrame:
    """Representative chunks of the documents in (query_id, ...) rows: of good quality,
    at most ``most`` of a query in order, by chapters where there are any (R16)."""
    found = chunks.where(accessible(user) & (F.col("quality_score") >= 0.48))
    if chapter:
        found = found.where(F.col("chapter") == chapter)
    w = Window.partitionBy("query_id").orderBy("document_id", "chunk_index")
    found = found.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= most).drop("__rn")
    with_chapter = found.where(F.coalesce("chapter", F.lit("")) != "").select("query_id").distinct()
    by_chapter = evidence.chapter_representatives(found.join(with_chapter, "query_id", "left_semi"))
    rest = evidence.representatives(found.join(with_chapter, "query_id", "left_anti"))
    return by_chapter.unionByName(rest, allowMissingColumns=True)


def stored_contexts(chunks: DataFrame, user: User, ids: list[int], stored_generation: int | None, generation: int) -> DataFrame:
    """Chunks of a stored state that are still current and accessible, in its order, of
    score 1; none if the embedding generation changed (R17)."""
    if stored_generation and stored_generation != generation:
        return chunks.where(F.lit(False)).withColumn("score", F.lit(1.0))
    wanted = list(dict.fromkeys(i for i in ids if isinstance(i, int) and i > 0))
    place = F.array_position(F.array(*[F.lit(i).cast("long") for i in wanted]).cast("array<long>"), F.col("chunk_id").cast("long"))
    return chunks.where(F.col("chunk_id").isin(wanted) & accessible(user)).withColumn("score", F.lit(1.0)).orderBy(place)


def resolved_scopes(queries: DataFrame, docs: DataFrame, explicit: DataFrame, inherited: DataFrame, dominant: DataFrame, first_hits: DataFrame, in_base: bool) -> DataFrame:
    """The documents that each question is about, and why (C7): (query_id, document_ids,
    scope_source). ``queries``: query_id, query, query_type; the others: query_id,
    document_id; ``docs`` are the accessible ones.

    What the question names; what the conversation was about; the only document there
    is, in a base or for an overview; all of them where an overview asks for several;
    else, unless the question is about a conflict, the dominant document, and for an
    overview that of the first hit.
    """
    lists = lambda d: d.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_set("document_id")).alias("ids"))
    out = queries
    for name, d in (("__e", explicit), ("__i", inherited), ("__d", dominant), ("__f", first_hits)):
        out = out.join(lists(d).withColumnRenamed("ids", name), "query_id", "left")
    n = docs.agg(F.count(F.lit(1)).alias("__n"), F.min("id").alias("__only"))
    out = out.crossJoin(n)  # one row
    overview, one = F.col("query_type") == "overview", F.array("__only")
    several = overview & F.lit(in_base) & asks_for_several_documents("query")
    free = ~F.col("query").rlike(K.ABOUT_CONFLICT)
    pick = lambda ids, why: F.struct(ids.alias("ids"), F.lit(why).alias("why"))
    everything = F.lit(None).cast("array<long>")  # no list: all documents of the base
    got = (
        F.when(F.col("__e").isNotNull(), pick(F.col("__e"), "query"))
        .when(F.col("__i").isNotNull(), pick(F.col("__i"), "history"))
        .when((F.col("__n") == 1) & F.lit(in_base), pick(one, "knowledge_base"))
        .when((F.col("__n") == 1) & overview, pick(one, "dominant"))
        .when(several, pick(everything, "knowledge_base"))
        .when(free & F.col("__d").isNotNull(), pick(F.col("__d"), "dominant"))
        .when(free & overview & F.col("__f").isNotNull(), pick(F.col("__f"), "dominant"))
        .otherwise(pick(everything, "knowledge_base" if in_base else "none"))
    )
    return out.withColumn("__s", got).select("query_id", F.col("__s.ids").alias("document_ids"), F.col("__s.why").alias("scope_source"))


def chart_points(trend: DataFrame) -> DataFrame:
    """A trend (day, value) as points of a 100 x 92 chart, two decimals."""
    w, every = Window.orderBy("day"), Window.partitionBy()
    t = trend.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(every), "__top": F.greatest(F.lit(1), F.max("value").over(every))})
    x = F.when(F.col("__n") == 1, 50.0).otherwise(F.col("__i") / (F.col("__n") - 1) * 100)
    return t.select("day", F.round(x, 2).alias("x"), F.round(92 - F.col("value") / F.col("__top") * 78, 2).alias("y"))
