"""Questions in conversations: intents, scopes, rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import catalogue as K
from quillspark.functions import text as T
from quillspark.operators.matching import holding
from quillspark.operators.retrieval import cosine
from quillspark.sources.tables import settled

LEANING = ("contextual_query", "follow_up", "explain_previous", "continue_previous")


def query_type(c: Column | str) -> Column:
    return F.when(T.any_match(T.compact(c), K.OVERVIEW), "overview").otherwise("local")


def is_contextual(c: Column | str) -> Column:
    return T.any_match(T.compact(c), K.CONTEXTUAL)


def intent(c: Column | str, after_answer: Column) -> Column:
    """One of eight intents; six of them need an answer before."""
    q = T.compact(c)
    rules = (("summarize_previous", K.SUMMARIZE), ("continue_previous", K.CONTINUE), ("explain_previous", K.EXPLAIN), ("refinement", K.REFINEMENT), ("follow_up", K.FOLLOW_UP), ("contextual_query", [*K.CONTEXTUAL, K.THIS_CHAPTER]))
    out = F
    for name, patterns in rules:
        out = out.when(after_answer & T.any_match(q, patterns), name)
    return out.when(T.any_match(q, K.OVERVIEW), "overview").otherwise("new_query")


def explicit_scope(c: Column | str) -> Column:
    """The scope that rules settle; null where vectors have to."""
    q = T.compact(c)
    overview = T.any_match(q, K.OVERVIEW)
    return (
        F.when(ordinal(q).isNotNull() | q.rlike(K.EXISTENCE), "local")
        .when(q.rlike(K.CHAPTER) & overview, "chapter_overview")
        .when(overview, "document_overview")
        .when(q.rlike(K.ENUMERATION) | q.rlike(K.HOW_WHAT), "local")
    )


def scope_by_vectors(queries: DataFrame, prototypes: DataFrame, least: float = 0.45, margin: float = 0.025) -> DataFrame:
    """Scopes of (query_id, query, vector) by the nearest of three prototypes (scope,
    vector): near and clear enough, else local; a chapter overview names a chapter."""
    p = F.broadcast(prototypes.select("scope", F.col("vector").alias("__p")))
    got = queries.crossJoin(p).groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct((-cosine("vector", "__p")).alias("d"), "scope"))).alias("r"))
    best, second = F.element_at("r", 1), F.try_element_at("r", F.lit(2))
    sure = (-best["d"] >= least) & (second.isNull() | (second["d"] - best["d"] >= margin))
    scope = F.when(~sure, "local").when((best["scope"] == "chapter_overview") & ~T.compact("query").rlike(K.CHAPTER), "document_overview").otherwise(best["scope"])
    return got.select("query_id", F.coalesce(explicit_scope("query"), scope).alias("scope"))


def asks_for_documents(c: Column | str) -> Column:
    q = T.compact(c)
    return q.rlike(K.INVENTORY_NOUN) & ~q.rlike(K.INVENTORY_CONTENT) & T.any_match(q, K.INVENTORY)


def asks_for_profile(c: Column | str) -> Column:
    q = T.compact(c)
    return F.contains(q, F.lit("知识库")) & q.rlike(K.PROFILE_CUE) & ~q.rlike(K.PROFILE_LIST)


def asks_for_bases(c: Column | str) -> Column:
    q = T.compact(c)
    return F.contains(q, F.lit("知识库")) & ~q.rlike(K.INVENTORY_NOUN) & ~asks_for_profile(c) & (q.rlike(K.BASE_CUE) | q.rlike(K.BASE_CONTENTS))


def asks_for_several_documents(c: Column | str) -> Column:
    return T.compact(c).rlike(K.SEVERAL_DOCUMENTS)


def ordinal(c: Column | str) -> Column:
    """The number of a point that a question refers to, up to ten in Chinese numerals."""
    found = T.extract(c, K.ORDINAL)
    named = F.create_map(*[F.lit(x) for i, d in enumerate("一二三四五六七八九十", 1) for x in (d, i)])
    value = F.when(found.rlike("^[0-9]+$"), found.try_cast("int")).otherwise(F.element_at(named, found))
    return F.when(value > 0, value)


def referenced_point(query: Column | str, answers: Column) -> Column:
    """The point of that number in the latest of ``answers`` (oldest first) that has one."""
    n = ordinal(query)
    points = F.transform(F.reverse(answers), lambda a: F.try_element_at(F.filter(F.transform(F.split(a, "\n+"), T.trimmed), lambda x: x.rlike(K.BULLET)), n))
    return F.when(n.isNotNull(), F.regexp_replace(F.try_element_at(F.filter(points, lambda p: p.isNotNull()), F.lit(1)), K.BULLET_MARK, ""))


def with_history(turns: DataFrame, history: int = 8) -> DataFrame:
    """User turns (conv_id, turn, text as query) with the last question and the answers,
    oldest first, among the ``history`` messages before."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-history, -1)
    t = turns.withColumn("previous_question", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w))
    t = t.withColumn("answers", F.collect_list(F.when(F.col("role") == "assistant", F.col("text"))).over(w))
    return t.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"), "previous_question", "answers")


def rewritten(turns: DataFrame) -> DataFrame:
    """Add ``rewritten``, ``applied``, ``reason`` and ``entities`` to turns (query,
    previous_question, answers) (C5, C6): a question that leans on the one before is put
    so that it stands alone, unless a number or a negation would be lost."""
    q, before = T.trimmed(T.text("query")), F.nullif(T.trimmed(T.text("previous_question")), F.lit(""))
    kind = intent(T.text("query"), F.size("answers") > 0)
    point = referenced_point(T.text("query"), F.col("answers"))
    subject = T.trimmed(F.regexp_replace(F.regexp_replace(before, K.POLITE_PREFIX, ""), K.ASKING_SUFFIX, ""))
    about = F.when(subject == "", before).otherwise(subject)
    chapter = F.regexp_extract(T.text("query"), K.CHAPTER, 0)
    other = F.concat(F.regexp_replace(before, rf"^(.*?){K.CHAPTER.replace('(', '(?:')}", F.concat(F.lit("$1"), chapter)), F.lit("\n追问："), q)
    added = F.concat(before, F.lit(" "), chapter, F.lit("\n追问："), q)
    leaning = kind.isin(*LEANING) & before.isNotNull()
    out = (
        F.when(~leaning, q)
        .when(point.isNotNull(), F.concat(F.lit("请围绕以下上一轮要点继续回答“"), q, F.lit("”："), point))
        .when(kind == "explain_previous", F.concat(F.lit("请更详细地解释"), about))
        .when(kind == "continue_previous", F.concat(F.lit("请继续介绍"), about, F.lit("尚未展开的相关内容")))
        .when(T.compact("query").rlike(K.PRONOUN), F.concat(about, F.regexp_replace(T.compact("query"), K.PRONOUN, "")))
        .when((chapter != "") & before.rlike(K.CHAPTER), other)
        .when(chapter != "", added)
        .otherwise(F.concat(before, F.lit("\n追问："), q))
    )
    t = turns.withColumns({"intent": kind, "__r": out})
    must = F.regexp_extract_all(T.text("query"), F.lit(f"({K.MUST_SURVIVE})"), F.lit(1))
    kept = F.forall(must, lambda m: F.contains(F.col("__r"), m))
    final = F.when(kept, F.col("__r")).otherwise(q)
    applied = kept & (T.trimmed("__r") != q)
    fresh = F.slice(F.filter(F.array_except(T.query_terms("__r"), T.query_terms(T.text("query"))), lambda x: F.length(x) >= 2), 1, 8)
    reason = F.when(~kept, "drift_guard").when(applied, "conversation_coreference").otherwise("not_needed")
    return t.withColumns({"rewritten": final, "applied": applied, "reason": reason, "entities": F.when(kept, fresh).otherwise(F.array().cast("array<string>"))}).drop("__r")


#: Parts that the documents of a subject are dealt out to.
SUBJECT_PARTS = 32


def named_documents(queries: DataFrame, docs: DataFrame, user_id: int) -> DataFrame:
    """Documents that a question names (J9): a subject's name in question and title, or
    the title's core (4 characters or more) in the question; the user's own where any is.
    (query_id, document_id). Titles meet the questions that hold their rarest stretch of
    four characters; equal ones, and equal questions, do so once.

    Whether a question names an own document is known from the titles and subjects that
    own documents have, so only pairs that are returned are made, each by one way: by its
    title, else by the first subject that both have.
    """
    subjects = lambda c: F.filter(F.array(*[F.lit(n) for n in K.SUBJECTS]), lambda n: F.contains(F.col(c), n))
    q = queries.select("query_id", T.normalized("query").alias("text")).distinct().withColumn("__qs", subjects("text"))
    d = docs.select(F.col("id").alias("document_id"), "owner_id", T.normalized("title").alias("__t"), T.core_title("title").alias("phrase"))
    d = settled(d.withColumn("__ds", subjects("__t")).drop("__t"))
    mine = d.where(F.col("owner_id") == user_id)
    texts = q.select(F.col("text").alias("text_id"), "text").distinct()
    by_text = holding(texts, d.select("phrase"), 4).select(F.col("text_id").alias("text"), "phrase")
    titles = settled(q.join(by_text, "text").select("query_id", "phrase").distinct())
    own = titles.join(mine.select("phrase"), "phrase", "left_semi").select("query_id")
    own = own.unionByName(q.select("query_id", F.explode("__qs").alias("subject")).join(mine.select(F.explode("__ds").alias("subject")), "subject", "left_semi").select("query_id"))
    q = settled(q.join(own.distinct().withColumn("__own", F.lit(True)), "query_id", "left"))

    def pairs(asked: DataFrame, d: DataFrame) -> DataFrame:
        by_title = titles.join(asked.select("query_id").distinct(), "query_id", "left_semi").join(d, "phrase").select("query_id", "document_id", "owner_id")
        part = F.pmod(F.xxhash64("document_id"), F.lit(SUBJECT_PARTS)).cast("int")
        parts = F.explode(F.sequence(F.lit(0), F.lit(SUBJECT_PARTS - 1))).alias("part")
        some = asked.select("query_id", "text", "__qs", F.explode("__qs").alias("subject")).select("*", parts)
        both = some.join(d.select("*", F.explode("__ds").alias("subject"), part.alias("part")), ["subject", "part"])
        titled = F.coalesce((F.length("phrase") >= 4) & F.contains("text", F.col("phrase")), F.lit(False))
        first = F.col("subject") == F.get(F.array_intersect("__qs", "__ds"), F.lit(0))
        return by_title.unionByName(both.where(first & ~titled).select("query_id", "document_id", "owner_id"))

    got = pairs(q.where("__own"), mine).unionByName(pairs(q.where("__own is null"), d))
    again = lambda df, c: not df.groupBy(c).count().where("count > 1").isEmpty()
    if again(q, "query_id") or again(d, "document_id"):
        got = got.distinct()
    return got.select("query_id", "document_id")


def mentioned_bases(queries: DataFrame, bases: DataFrame) -> DataFrame:
    """The base that a question names (T5): of those whose name it holds next to the word
    for a base, the one of the longest name, then the latest; else the only one whose
    name holds what the question calls a base. (query_id, kb_id). ``bases``: id, name,
    those that the user may see. Names and questions meet by stretches of characters that
    they share."""
    word = F.lit("知识库")
    q = queries.select("query_id", T.compact("query").alias("text")).withColumn("text_id", F.col("query_id"))
    b = bases.select(F.col("id").alias("kb_id"), T.compact(T.text("name")).alias("name")).where(F.col("name") != "")
    spoken = F.when(F.contains("name", word), F.array("name")).otherwise(F.array(F.concat("name", word), F.concat(word, "name")))
    said = b.select("kb_id", "name", F.explode(spoken).alias("phrase"))
    by_name = holding(q, said, 3).join(said, "phrase").select(F.col("text_id").alias("query_id"), "kb_id", "name", F.lit(True).alias("named"))

    alias = F.coalesce(T.extract("text", K.BASE_IN), T.extract("text", K.BASE_FROM), T.extract("text", K.BASE_LEADING))
    calls = q.select("query_id", alias.alias("phrase"))
    names = b.select("name").distinct().select(F.col("name").alias("text_id"), F.col("name").alias("text"))
    by_call = holding(names, calls, 2).join(calls, "phrase").join(b, F.col("text_id") == F.col("name")).select("query_id", "kb_id", "name", F.lit(False).alias("named"))

    h = by_name.unionByName(by_call).groupBy("query_id", "kb_id", "name").agg(F.max("named").alias("named"))
    w = Window.partitionBy("query_id")
    h = h.withColumns({"__any": F.bool_or("named").over(w), "__n": F.count(F.lit(1)).over(w)})
    h = h.where(F.when(F.col("__any"), F.col("named")).otherwise(F.col("__n") == 1))
    return h.withColumn("__rn", F.row_number().over(w.orderBy(F.desc(F.length("name")), F.desc("kb_id")))).where(F.col("__rn") == 1).select("query_id", "kb_id")


STATE = "version int, originalQuery string, scope string, documentIds array<long>, generation int, evidence array<struct<chunk_id:long,content:string>>"


def parsed_state(c: Column | str) -> Column:
    """A stored retrieval state; null if malformed, of an unknown version or blank."""
    s = F.from_json(T.col(c), STATE)
    return F.when(s["version"].isin(1, 2) & (T.trimmed(F.coalesce(s["originalQuery"], F.lit(""))) != ""), s)


def stored_state(query: Column, scope: Column, ids: Column, generation: Column, evidence: Column) -> Column:
    """The state as JSON, with at most 12 passages of 1600 characters."""
    cut = F.transform(F.slice(evidence, 1, 12), lambda e: F.struct(e["chunk_id"].alias("chunk_id"), F.substring(e["content"], 1, 1600).alias("content")))
    return F.to_json(F.struct(F.lit(2).alias("version"), query.alias("originalQuery"), scope.alias("scope"), ids.alias("documentIds"), generation.alias("generation"), cut.alias("evidence")))
