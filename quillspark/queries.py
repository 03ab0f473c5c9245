"""The registered queries over the engine's operators, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import access, analytics, audit, chunking, conversation, evidence, retrieval, vectors
from quillspark.operators.access import User
from quillspark.operators.index import Index
from quillspark.plans import search as plans
from quillspark.plans.indexes import line_index, vector_index
from quillspark.sources import sinks, tables
from quillspark.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ME = User(3)
#: Six questions that every search query asks.
QUESTIONS = [("q1", "the reading of thing"), ("q2", "die Verein und der"), ("q3", "la pation avec"), ("q4", "src0 en"), ("q5", "is that andst 内存管理"), ("q6", "de la que el")]
QUESTIONS_SQL = "questions(query_id, query) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in QUESTIONS) + ")"


def registered(sql: str | None = None, views: bool = True):
    """Register a query under its function's name; ``views`` puts the tables' views first."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {tables.SQL} {sql}" if views else sql
        return f

    return add


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id string, query string")


def asked(spark: SparkSession) -> DataFrame:
    """Questions of one term, since relevance looks for whole terms without blanks."""
    rows = [("a1", "thing"), ("a2", "verein"), ("a3", "pation"), ("a4", "src0"), ("a5", "究竟 license 是什么")]
    return spark.createDataFrame(rows, "query_id string, query string")


def popular(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf).withColumn("updated_at", F.col("created_at"))
    return analytics.with_popularity(docs, tables.counters(spark, sf), tables.reactions(spark, sf, "click"))


POPULAR = """, liked AS (SELECT document_id AS id, count(*) AS likes FROM likes GROUP BY 1),
    pop AS (SELECT d.*, coalesce(c.views, 0) AS views, coalesce(c.downloads, 0) AS downloads, coalesce(l.likes, 0) AS likes,
                   coalesce(c.views, 0) + 2 * coalesce(c.downloads, 0) + 3 * coalesce(l.likes, 0) AS popularity
            FROM docs d LEFT JOIN counters c USING (id) LEFT JOIN liked l USING (id))"""
SEEN = "(owner_id = 3 OR share_status = 'shared')"


# ---- dashboards and listings -------------------------------------------------------


@registered(f"{POPULAR} SELECT count(*) AS documents, coalesce(sum(views), 0)::BIGINT AS views, coalesce(sum(downloads), 0)::BIGINT AS downloads FROM pop WHERE {SEEN}")
def stats_totals(spark, sf):
    return analytics.totals(popular(spark, sf).where(access.accessible(ME)))


@registered(f"SELECT category, count(*) AS value FROM docs WHERE {SEEN} GROUP BY 1")
def stats_categories(spark, sf):
    return analytics.by_category(tables.documents(spark, sf).where(access.accessible(ME)))


@registered("SELECT event_type AS query, count(*) AS value FROM ev WHERE user_id = 3 GROUP BY 1 ORDER BY value DESC, query LIMIT 8")
def hot_keywords(spark, sf):
    return analytics.hot_keywords(tables.events(spark, sf).withColumnRenamed("event_type", "query"), ME)


@registered("SELECT * FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS value FROM ev GROUP BY 1 ORDER BY day DESC LIMIT 14) ORDER BY day")
def search_trend(spark, sf):
    return analytics.search_trend(tables.events(spark, sf))


@registered(f"{POPULAR} SELECT id, title, popularity FROM pop WHERE {SEEN} ORDER BY popularity DESC, created_at DESC, id DESC LIMIT 8")
def popular_documents(spark, sf):
    d = analytics.dashboard(popular(spark, sf), tables.events(spark, sf).withColumnRenamed("event_type", "query"), ME)
    return d["popular"].select("id", "title", "popularity")


@registered(f"SELECT id, title FROM docs WHERE {SEEN} ORDER BY created_at DESC, id DESC LIMIT 8")
def latest_documents(spark, sf):
    d = analytics.dashboard(popular(spark, sf), tables.events(spark, sf).withColumnRenamed("event_type", "query"), ME)
    return d["latest"].select("id", "title")


@registered(f"{POPULAR} SELECT id, popularity FROM pop WHERE {SEEN} ORDER BY popularity DESC, id DESC LIMIT 50")
def documents_hot(spark, sf):
    return analytics.listing(popular(spark, sf).where(access.accessible(ME)), "hot").select("id", "popularity")


@registered(f"{POPULAR}, fav AS (SELECT document_id AS id, count(*) AS favorites FROM favorites GROUP BY 1) SELECT p.id, owner_id, category, share_status, views, downloads, likes, coalesce(favorites, 0) AS favorites, popularity FROM pop p LEFT JOIN fav USING (id) WHERE {SEEN}")
def document_listing(spark, sf):
    fav = tables.reactions(spark, sf, "purchase").groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("favorites"))
    d = popular(spark, sf).where(access.accessible(ME)).join(fav, "id", "left").fillna(0, ["favorites"])
    return d.select("id", "owner_id", "category", "share_status", "views", "downloads", "likes", "favorites", "popularity")


@registered(f"SELECT id, owner_id, share_status FROM docs WHERE {SEEN}")
def accessible_documents(spark, sf):
    return tables.documents(spark, sf).where(access.accessible(ME)).select("id", "owner_id", "share_status")


@registered("SELECT id, owner_id, share_status FROM docs")
def accessible_documents_admin(spark, sf):
    return tables.documents(spark, sf).where(access.accessible(User(1, "system_admin"))).select("id", "owner_id", "share_status")


@registered("SELECT id, owner_id FROM docs WHERE owner_id = 3")
def writable_documents(spark, sf):
    return tables.documents(spark, sf).where(access.accessible(ME, write=True)).select("id", "owner_id")


@registered(f"SELECT id FROM docs WHERE {SEEN} AND id IN (SELECT document_id FROM favorites WHERE user_id = 3)")
def scope_favorites(spark, sf):
    return access.in_scope(tables.documents(spark, sf), ME, "favorites", tables.reactions(spark, sf, "purchase")).select("id")


@registered("SELECT id, category FROM docs WHERE category = 'en' AND list_contains(tags, 'src1')")
def tag_filter(spark, sf):
    return tables.documents(spark, sf).where(access.matching(category="en", tag="src1")).select("id", "category")


@registered("SELECT kb, count(*) AS documents FROM docs WHERE kb IS NOT NULL GROUP BY 1")
def kb_document_counts(spark, sf):
    d = tables.documents(spark, sf).where(F.col("kb").isNotNull())
    return analytics.base_counts(d.select("kb").distinct(), d.select("kb", F.col("id").alias("document_id")))


@registered("""SELECT kb, id AS document_id, count(*) OVER (PARTITION BY kb) AS documents, (row_number() OVER w)::INT AS place, (row_number() OVER w) || '. ' || title AS line
    FROM docs WHERE kb IS NOT NULL WINDOW w AS (PARTITION BY kb ORDER BY created_at DESC, id DESC)""")  # fmt: skip
def kb_inventory(spark, sf):
    return analytics.base_inventory(tables.documents(spark, sf).where(F.col("kb").isNotNull()))


@registered("SELECT user_id, document_id FROM ev WHERE event_type = 'click' AND document_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def toggle_state(spark, sf):
    return analytics.toggled(tables.events(spark, sf).where("event_type = 'click' AND document_id IS NOT NULL"))


@registered("SELECT user_id, document_id FROM ev WHERE document_id IS NOT NULL GROUP BY 1, 2 HAVING arg_max(event_type IN ('click', 'purchase'), (ts, event_id))")
def last_set_state(spark, sf):
    return analytics.last_set(tables.events(spark, sf).where("document_id IS NOT NULL").withColumn("active", F.col("event_type").isin("click", "purchase")))


@registered("SELECT c_custkey AS id, left(c_name, 2) || '***@example.com' AS mail, CASE WHEN length(p) <= 4 THEN '****' ELSE left(p, 3) || '****' || right(p, 2) END AS phone FROM (SELECT *, (c_custkey * 7919)::VARCHAR AS p FROM customer)", views=False)
def mask_contact(spark, sf):
    c = tables.read(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), T.masked_contact(F.concat("c_name", F.lit("@example.com"))).alias("mail"), T.masked_contact((F.col("c_custkey") * 7919).cast("string")).alias("phone"))


@registered("SELECT d.owner_id, u.n_name AS owner, d.id FROM docs d JOIN nation u ON d.owner_id = u.n_nationkey WHERE share_status = 'pending'")
def share_queue(spark, sf):
    users = tables.read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("username"))
    return analytics.share_queue(tables.documents(spark, sf), users).select("owner_id", "owner", "id")


@registered("""SELECT conv_id * 1000 + turn AS message_id, role, CASE WHEN bad THEN NULL ELSE text END AS content, bad AS revoked
    FROM (SELECT c.*, role = 'assistant' AND NOT (conv_id % 500 IN (SELECT id FROM docs WHERE share_status = 'shared' OR owner_id = 3)) AS bad FROM conversations c)""")  # fmt: skip
def citation_revocation(spark, sf):
    m = tables.read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "role", F.col("text").alias("content"), F.array(F.col("conv_id") % 500).alias("cited"))
    return access.hidden_when_revoked(m, tables.documents(spark, sf).where(access.accessible(ME)).select("id")).select("message_id", "role", "content", "revoked")


@registered("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8", views=False)
def last_messages(spark, sf):
    return analytics.last_messages(tables.read(spark, sf, "conversations")).select("conv_id", "turn", "role")


@registered("SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY 1", views=False)
def chat_sessions(spark, sf):
    return analytics.sessions_of(tables.read(spark, sf, "conversations"))


@registered("""SELECT conv_id, turn, right(text, 1000) AS text FROM (SELECT * FROM conversations WHERE trim(coalesce(text, '')) <> '')
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6""", views=False)  # fmt: skip
def model_history(spark, sf):
    return analytics.model_history(tables.read(spark, sf, "conversations")).select("conv_id", "turn", "text")


@registered("""SELECT (SELECT count(*) FROM region r WHERE r_regionkey = 3 OR r_regionkey % 3 > 0) AS bases, (SELECT count(*) FROM events WHERE user_id = 3) AS searches""", views=False)
def visible_counts(spark, sf):
    r = tables.read(spark, sf, "region")
    kind = F.when(F.col("r_regionkey") % 3 == 0, "private").when(F.col("r_regionkey") % 3 == 1, "shared").otherwise("public")
    return analytics.visible_counts(r.select(F.col("r_regionkey").alias("owner_id"), kind.alias("visibility")), tables.events(spark, sf), ME)


@registered("""WITH RECURSIVE o AS (SELECT o_custkey AS document_id, list_extract(['request', 'approve', 'reject', 'withdraw', 'request'], substr(o_orderpriority, 1, 1)::INT) AS action, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
    w AS (SELECT document_id, 0::BIGINT AS rn, 'private' AS state FROM (SELECT DISTINCT document_id FROM o)
          UNION ALL SELECT w.document_id, o.rn, CASE WHEN action = 'request' AND state IN ('private', 'rejected') THEN 'pending' WHEN state <> 'pending' THEN state
                WHEN action = 'approve' THEN 'shared' WHEN action = 'reject' THEN 'rejected' WHEN action = 'withdraw' THEN 'private' ELSE state END
          FROM w JOIN o ON o.document_id = w.document_id AND o.rn = w.rn + 1)
    SELECT document_id, arg_max(state, rn) AS state FROM w GROUP BY 1""", views=False)  # fmt: skip
def share_state(spark, sf):
    """Orders as requests: their priority stands for what was asked of the document."""
    o = tables.read(spark, sf, "orders")
    action = F.element_at(F.create_map(*[F.lit(x) for kv in zip("12345", ("request", "approve", "reject", "withdraw", "request")) for x in kv]), F.substring("o_orderpriority", 1, 1))
    return analytics.share_state(o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("seq"), action.alias("action")))


@registered("SELECT 'documents' AS \"table\", count(*) AS rows FROM docs UNION ALL SELECT 'events', count(*) FROM ev UNION ALL SELECT 'chunks', count(*) FROM chunks")
def table_counts(spark, sf):
    return analytics.table_counts({"documents": tables.documents(spark, sf), "events": tables.events(spark, sf), "chunks": tables.line_chunks(spark, sf)})


# ---- vectors -----------------------------------------------------------------------

CHUNKS_V = "(SELECT vec_id AS chunk_id, 1 + (vec_id % 10 = 0)::INT AS document_version FROM embeddings)"
VECTORS = "(SELECT vec_id AS chunk_id, 1 AS document_version, (vec_id % 7 = 0)::INT AS stale FROM embeddings WHERE vec_id % 3 <> 0)"
SPACE = ("hash", "trigrams", 1)


def stored(spark, sf):
    e = tables.read(spark, sf, "embeddings")
    chunks = e.select(F.col("vec_id").alias("chunk_id"), (1 + (F.col("vec_id") % 10 == 0).cast("int")).alias("document_version"), F.lit("x").alias("content"), F.lit("c").alias("chapter"), F.col("label").cast("long").alias("document_id"))
    v = e.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("chunk_id"), F.lit(1).alias("document_version"), (F.col("vec_id") % 7 == 0).cast("int").alias("stale"), "embedding")
    v = v.withColumns({"provider": F.lit(SPACE[0]), "model": F.lit(SPACE[1]), "generation": F.lit(SPACE[2]), "content_hash": F.sha2(F.lit("x").cast("binary"), 256)})
    return chunks, v


@registered(f"SELECT c.chunk_id FROM {CHUNKS_V} c LEFT JOIN {VECTORS} v ON c.chunk_id = v.chunk_id AND v.document_version = c.document_version AND v.stale = 0 WHERE v.chunk_id IS NULL", views=False)
def needs_embedding(spark, sf):
    chunks, v = stored(spark, sf)
    return vectors.needing_vectors(chunks, v, SPACE).select("chunk_id")


@registered(f"""SELECT count(*) AS chunks, count(*) FILTER (v.document_version = c.document_version AND v.stale = 0) AS indexed,
    count(*) FILTER (v.chunk_id IS NOT NULL AND NOT (v.document_version = c.document_version AND v.stale = 0)) AS stale,
    count(*) - count(*) FILTER (v.document_version = c.document_version AND v.stale = 0) AS pending
    FROM {CHUNKS_V} c LEFT JOIN {VECTORS} v ON c.chunk_id = v.chunk_id""", views=False)  # fmt: skip
def embedding_stats(spark, sf):
    return analytics.chunk_coverage(*stored(spark, sf))


@registered(f"SELECT e.label::BIGINT AS document_id, count(*) AS chunks, count(v.chunk_id) AS embedded, 1::BIGINT AS chapters FROM embeddings e LEFT JOIN {VECTORS} v ON e.vec_id = v.chunk_id GROUP BY 1", views=False)
def structure_counts(spark, sf):
    return analytics.structure_counts(*stored(spark, sf))


@registered("""SELECT query_id, chunk_id, score, rank FROM (
        SELECT 'v' || q.vec_id AS query_id, e.vec_id AS chunk_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS score,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) DESC, e.vec_id) AS rank
        FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.35) WHERE rank <= 96""", views=False)  # fmt: skip
def vector_topk(spark, sf):
    return vector_index(spark, sf).search(vector_questions(spark, sf), retrieval.candidate_limit(12))


def vector_questions(spark, sf):
    """Every twentieth vector as a question."""
    e = tables.read(spark, sf, "embeddings").where("vec_id % 20 = 0")
    return e.select(F.concat(F.lit("v"), "vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@registered("""SELECT count(*) AS neighbours, true AS enough FROM (
        SELECT row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) DESC, e.vec_id) AS rank
        FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.35) WHERE rank <= 10""", views=False)  # fmt: skip
def vector_recall(spark, sf):
    """Whether probing some lists only finds 0.9 of the ten nearest vectors of all questions."""
    index, q = vector_index(spark, sf), vector_questions(spark, sf)
    truth = index.search(q, 10).select("query_id", "chunk_id")
    found = index.search(q, 10, probes=index.probes_for(0.95)).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    both = truth.join(found, ["query_id", "chunk_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("neighbours"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))


@registered("SELECT chunk_id, sha256(content) AS content_hash, 64 AS dims, true AS unit FROM chunks")
def embedding_backfill(spark, sf):
    v = vectors.embedded(tables.line_chunks(spark, sf), vectors.hashing_embedder(), SPACE)
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    return v.select("chunk_id", "content_hash", F.size("embedding").alias("dims"), ((F.abs(length - 1) < 1e-9) | (length == 0)).alias("unit"))


# ---- search ------------------------------------------------------------------------

TERMS = """runs AS (SELECT query_id, query, regexp_extract_all(lower(query), '[a-z0-9_]+|[\\x{4e00}-\\x{9fff}]+') AS r FROM questions),
    terms AS (SELECT query_id, list_distinct(flatten([CASE WHEN regexp_full_match(x, '[\\x{4e00}-\\x{9fff}]{4,}') THEN [x] || [x[i:i+1] FOR i IN range(1, length(x))] ELSE [x] END FOR x IN r])) AS t FROM runs),
    qg AS (SELECT DISTINCT query_id, g AS term FROM (SELECT query_id, unnest(flatten([CASE WHEN regexp_full_match(x, '[\\x{4e00}-\\x{9fff}]{2,}') THEN [x[i:i+1] FOR i IN range(1, length(x))] ELSE [x] END FOR x IN t])) AS g FROM terms))"""


def lexical_sql(fields: str) -> str:
    return f""", {QUESTIONS_SQL}, {TERMS},
    post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower({fields}), '[a-z0-9_]+')) AS term FROM chunks) GROUP BY 1, 2),
    idf AS (SELECT term, pow(log10((SELECT count(*) FROM chunks)::DOUBLE / count(*)), 2) AS idf2 FROM post WHERE term IN (SELECT term FROM qg) GROUP BY 1),
    scored AS (SELECT query_id, chunk_id, round(sum(tf * idf2), 8) AS score FROM qg JOIN idf USING (term) JOIN post USING (term) GROUP BY 1, 2)
    SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 96"""


@registered(lexical_sql("content || ' ' || chapter || ' ' || section"))
def lexical_topk(spark, sf):
    return line_index(spark, sf).lexical_channels(questions(spark), 96).where("channel = 'content'").drop("channel")


@registered(lexical_sql("title || ' ' || filename || ' ' || array_to_string(tags, ' ')"))
def metadata_topk(spark, sf):
    return line_index(spark, sf).lexical_channels(questions(spark), 96).where("channel = 'metadata'").drop("channel")


EXACT = f""", {QUESTIONS_SQL}, {TERMS},
    qt AS (SELECT query_id, unnest(list_filter(t, lambda x: length(x) >= 2)) AS term FROM terms),
    hit AS (SELECT DISTINCT query_id, chunk_id FROM chunks JOIN qt ON contains(lower(title || ' ' || filename || ' ' || array_to_string(tags, ' ')), term) OR (length(term) >= 4 AND contains(lower(content), term))),
    ex AS (SELECT query_id, chunk_id, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM hit)"""


@registered(EXACT + " SELECT * FROM ex WHERE rank <= 96")
def exact_topk(spark, sf):
    return line_index(spark, sf).exact_channel(questions(spark), 96)


def fused(index: Index, spark):
    q = questions(spark)
    return retrieval.fuse({None: index.lexical_channels(q, 96), "exact": index.exact_channel(q, 96)})


def fused_hits(spark, sf):
    return fused(line_index(spark, sf), spark)


FUSED = (
    lexical_sql("content || ' ' || chapter || ' ' || section").rsplit("SELECT query_id, chunk_id, score, rank FROM (SELECT *", 1)[0]
    + """, c1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 96),
    post2 AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(title || ' ' || filename || ' ' || array_to_string(tags, ' ')), '[a-z0-9_]+')) AS term FROM chunks) GROUP BY 1, 2),
    idf_2 AS (SELECT term, pow(log10((SELECT count(*) FROM chunks)::DOUBLE / count(*)), 2) AS idf2 FROM post2 WHERE term IN (SELECT term FROM qg) GROUP BY 1),
    scored2 AS (SELECT query_id, chunk_id, round(sum(tf * idf2), 8) AS score FROM qg JOIN idf_2 USING (term) JOIN post2 USING (term) GROUP BY 1, 2),
    c2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored2 WHERE score > 0) WHERE rank <= 96)"""
    + EXACT.split(TERMS, 1)[1]
    + """, parts AS (SELECT query_id, chunk_id, 1.0 / (60 + rank) AS p FROM c1 UNION ALL SELECT query_id, chunk_id, 1.25 / (60 + rank) FROM c2 UNION ALL SELECT query_id, chunk_id, 1.25 / (60 + rank) FROM ex WHERE rank <= 96),
    rrf AS (SELECT query_id, chunk_id, round(sum(p::DOUBLE), 12) AS rrf FROM parts GROUP BY 1, 2),
    fused AS (SELECT query_id, chunk_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS rank FROM rrf)"""
)


@registered(FUSED + " SELECT query_id, chunk_id, rrf, rank FROM fused")
def rrf_fusion(spark, sf):
    return fused_hits(spark, sf).select("query_id", "chunk_id", "rrf", "rank")


def ranked_hits(spark, sf):
    return line_index(spark, sf).projection().join(retrieval.held(fused_hits(spark, sf)), "chunk_id")


@registered(FUSED + """, h AS (SELECT f.*, c.document_id, f.rrf / greatest(max(f.rrf) OVER (PARTITION BY query_id), 1e-6) AS s FROM fused f JOIN chunks c USING (chunk_id)),
    g AS (SELECT query_id, document_id, max(s) AS score, count(*) AS hits, min(rank) AS first_rank FROM h GROUP BY 1, 2)
    SELECT query_id, document_id, round(score, 8) AS score, hits FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hits DESC, first_rank) <= 6""")  # fmt: skip
def related_documents(spark, sf):
    return retrieval.related_documents(ranked_hits(spark, sf)).select("query_id", "document_id", F.round("score", 8).alias("score"), "hits")


@registered(FUSED + """, h AS (SELECT f.*, c.document_id, f.rrf / greatest(max(f.rrf) OVER (PARTITION BY query_id), 1e-6) AS sc FROM fused f JOIN chunks c USING (chunk_id)),
    g AS (SELECT query_id, document_id, count(*) AS n, round(sum(sc), 10) AS s, min(rank) AS r FROM h WHERE rank <= 8 GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER w AS place, lead(n) OVER w AS n2, lead(s) OVER w AS s2 FROM g WINDOW w AS (PARTITION BY query_id ORDER BY n DESC, s DESC, r))
    SELECT query_id, document_id FROM o WHERE place = 1 AND n >= 2 AND (n2 IS NULL OR n > n2 OR s >= s2 * 1.15)""")  # fmt: skip
def dominant_document(spark, sf):
    return retrieval.dominant_document(ranked_hits(spark, sf))


#: The fold of a ranked list ``f``: at most three hits a document, one of each passage, twelve in all.
CAPPED = """, s AS (SELECT f.*, c.document_id, substr(regexp_replace(lower(c.content), '[^\\p{L}\\p{N}]+', '', 'g'), 1, 180) AS signature FROM fused f JOIN chunks c USING (chunk_id)),
    w AS (SELECT query_id, 0::BIGINT AS rank, []::BIGINT[] AS docs, []::VARCHAR[] AS known, []::BIGINT[] AS ranks FROM (SELECT DISTINCT query_id FROM s)
          UNION ALL
          SELECT query_id, rank, CASE WHEN t THEN list_append(docs, document_id) ELSE docs END, CASE WHEN t THEN list_append(known, signature) ELSE known END, CASE WHEN t THEN list_append(ranks, rank) ELSE ranks END
          FROM (SELECT w.query_id, s.rank, s.document_id, s.signature, docs, known, ranks,
                       len(ranks) < 12 AND len(list_filter(docs, lambda x: x = s.document_id)) < 3 AND NOT (s.signature <> '' AND list_contains(known, s.signature)) AS t
                FROM w JOIN s ON s.query_id = w.query_id AND s.rank = w.rank + 1)),
    taken AS (SELECT query_id, ranks FROM w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) = 1)"""


@registered(FUSED + CAPPED + " SELECT s.query_id, list_position(ranks, s.rank)::INT AS position, s.rank, document_id, signature, chunk_id FROM s JOIN taken ON s.query_id = taken.query_id AND list_contains(ranks, s.rank)")
def dedupe_topk(spark, sf):
    h = ranked_hits(spark, sf).withColumn("signature", F.substring(T.signature_text("content"), 1, 180))
    return retrieval.capped(h, 12, carry=["chunk_id"])


def indexed(spark, sf) -> plans.Corpus:
    """The line chunks as their index has them."""
    index = line_index(spark, sf)
    return plans.Corpus(index.projection().withColumn("id", F.col("document_id")), index=index)


#: The line chunks after documents went, were replaced and were added.
CHANGED = """, changed AS (SELECT chunk_id, document_id, CASE WHEN document_id % 11 = 3 THEN 'thing again ' || content ELSE content END AS content, title, filename, tags, chapter, section
    FROM chunks WHERE document_id % 13 <> 5)"""


@registered(CHANGED + FUSED.replace("FROM chunks", "FROM changed").replace("JOIN chunks", "JOIN changed") + " SELECT query_id, chunk_id, rrf, rank FROM fused")
def fusion_after_changes(spark, sf):
    """Searching an index whose documents have been added, replaced and removed since."""
    chunks = tables.line_chunks(spark, sf)
    index = Index(Store(spark, tables.own_folder(spark)))
    index.update(chunks.where("document_id % 17 <> 2"))
    index.update(chunks.where("document_id % 11 = 3").withColumn("content", F.concat(F.lit("thing again "), "content")))
    index.update(chunks.where("document_id % 17 = 2 AND document_id % 11 <> 3"), gone=chunks.where("document_id % 13 = 5").select("document_id").distinct())
    index.update(gone=chunks.where("document_id % 13 = 5").select("document_id").distinct())
    return fused(index.pinned(), spark).select("query_id", "chunk_id", "rrf", "rank")


SEEN_FUSED = f", seen AS (SELECT * FROM chunks WHERE {SEEN})" + FUSED.replace("FROM chunks", "FROM seen")


@registered(SEEN_FUSED + CAPPED + """ SELECT s.query_id, list_position(ranks, s.rank)::INT AS position, chunk_id, document_id, round(score, 8) AS score
    FROM (SELECT *, rrf / greatest(max(rrf) OVER (PARTITION BY query_id), 1e-6) AS score FROM s) s JOIN taken ON s.query_id = taken.query_id AND list_contains(ranks, s.rank)""")  # fmt: skip
def search(spark, sf):
    hits = plans.search(indexed(spark, sf), ME, questions(spark))
    return hits.select("query_id", "position", "chunk_id", "document_id", F.round("score", 8).alias("score"))


def with_vectors(spark, sf):
    """The line chunks with vectors, and every twentieth text of the benchmark as a question."""
    embedder = vectors.hashing_embedder()
    corpus = indexed(spark, sf)
    v = lambda chunks: vectors.embedded(chunks, embedder, SPACE).select("chunk_id", "embedding")
    b = tables.read(spark, sf, "benchmark").where(F.col("item_id") % 20 == 0).select(F.col("item_id").alias("chunk_id"), F.lit(1).alias("document_version"), F.col("text").alias("content"))
    q = vectors.embedded(b, embedder, SPACE).select(F.col("chunk_id"), F.col("embedding").alias("vector")).join(b, "chunk_id")
    return plans.Corpus(corpus.chunks, v, index=corpus.index), q.select(F.col("chunk_id").cast("string").alias("query_id"), F.col("content").alias("query"), "vector")


NORMAL = "regexp_replace(lower({}), '[\\s_()（）【】\\[\\]·.,，。:：-]+', '', 'g')"
#: Titles of which some name a subject, and a question about every twentieth document.
TITLED, ASKS = "CASE WHEN id % 7 = 0 THEN '操作系统 ' || title ELSE title END", "CASE WHEN id % 3 = 0 THEN '操作系统与 ' ELSE 'about ' END || title || ' please'"


@registered(f""", q AS (SELECT 'n' || id AS query_id, {NORMAL.format(ASKS)} AS q FROM docs WHERE id % 20 = 0),
    d AS (SELECT id, owner_id, t, regexp_replace(regexp_replace(t, '(?:19|20)[0-9][0-9]', '', 'g'), '[0-9]+', '', 'g') AS c FROM (SELECT id, owner_id, {NORMAL.format(TITLED)} AS t FROM docs)),
    hit AS (SELECT query_id, id, owner_id FROM q JOIN d ON (length(c) >= 4 AND contains(q, c)) OR (contains(q, '操作系统') AND contains(t, '操作系统')))
    SELECT query_id, id AS document_id FROM hit QUALIFY owner_id = 3 OR NOT bool_or(owner_id = 3) OVER (PARTITION BY query_id)""")  # fmt: skip
def named_documents(spark, sf):
    d = tables.documents(spark, sf)
    q = d.where("id % 20 = 0").select(F.concat(F.lit("n"), "id").alias("query_id"), F.expr(ASKS).alias("query"))
    return conversation.named_documents(q, d.select("id", "owner_id", F.expr(TITLED).alias("title")), ME.id)


@registered()
def hybrid_search(spark, sf):
    """All four channels over all chunks: passages of the benchmark as questions."""
    corpus, q = with_vectors(spark, sf)
    hits = plans.search(corpus, User(1, "system_admin"), q)
    return hits.select("query_id", "position", "chunk_id", "document_id", F.round("score", 8).alias("score"), F.round("semantic_score", 4).alias("semantic_score"))


@registered()
def extractive_answers(spark, sf):
    return plans.ask(indexed(spark, sf), User(1, "system_admin"), asked(spark))["answers"]


@registered()
def evidence_pack(spark, sf):
    return plans.ask(indexed(spark, sf), User(1, "system_admin"), asked(spark))["evidence"]


# ---- evidence ----------------------------------------------------------------------


def marked(spark, sf):
    """Every fifth chunk of a document as an anchor."""
    c = tables.line_chunks(spark, sf)
    return c, c.where("chunk_index % 5 = 1").withColumns({"query_id": F.lit("q"), "pos": F.col("chunk_id"), "score": F.lit(1.0)})


@registered("""SELECT 'q' AS query_id, b.document_id, b.chunk_index::INT AS chunk_index, min(a.chunk_index)::INT AS anchor_index FROM chunks a JOIN chunks b ON a.document_id = b.document_id AND abs(a.chunk_index - b.chunk_index) <= 1
    AND a.chapter = b.chapter AND a.section = b.section WHERE a.chunk_index % 5 = 1 GROUP BY 1, 2, 3""")  # fmt: skip
def neighbour_expansion(spark, sf):
    chunks, anchors = marked(spark, sf)
    n = evidence.neighbours(anchors, chunks)
    return n.select("query_id", "document_id", "chunk_index", (F.col("anchor") % tables.CHUNKS).cast("int").alias("anchor_index"))


@registered("""SELECT document_id, chunk_index::INT AS chunk_index, min(chunk_id) OVER (PARTITION BY document_id, section, island) AS anchor
    FROM (SELECT *, chunk_index - row_number() OVER (PARTITION BY document_id, chapter, section ORDER BY chunk_index) AS island FROM chunks WHERE chunk_index % 5 <> 0)""")  # fmt: skip
def contiguous_groups(spark, sf):
    c = tables.line_chunks(spark, sf).where("chunk_index % 5 <> 0").withColumns({"query_id": F.lit("q"), "pos": F.col("chunk_id")})
    return evidence.contiguous(c.withColumn("query_id", F.col("document_id").cast("string"))).select("document_id", "chunk_index", "anchor")


@registered("""SELECT document_id, chunk_index::INT AS chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) - 1 AS i, count(*) OVER (PARTITION BY document_id) AS n FROM chunks)
    WHERE n <= 5 OR list_contains([floor(k * (n - 1) / 4 + 0.5)::BIGINT FOR k IN range(0, 5)], i)""")  # fmt: skip
def systematic_sample(spark, sf):
    return evidence.systematic_sample(tables.line_chunks(spark, sf), 5, ["document_id"], ["chunk_index"]).select("document_id", "chunk_index")


RANKED_SQL = """r AS (SELECT *, round(3.0 + 0.8 + least(1.2, length(regexp_replace(content, '\\s', '', 'g')) / 500) - CASE WHEN length(regexp_replace(content, '\\s', '', 'g')) < 120 THEN 1.5 ELSE 0.0 END, 10) AS rk FROM chunks)"""


@registered(f""", {RANKED_SQL}, b AS (SELECT *, floor((row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) - 1) * least(16, count(*) OVER (PARTITION BY document_id)) / count(*) OVER (PARTITION BY document_id)) AS bucket FROM r)
    SELECT document_id, chunk_index::INT AS chunk_index, bucket::BIGINT AS bucket FROM b QUALIFY row_number() OVER (PARTITION BY document_id, bucket ORDER BY rk DESC, chunk_index) = 1""")  # fmt: skip
def representatives(spark, sf):
    c = tables.line_chunks(spark, sf).withColumns({"query_id": F.col("document_id").cast("string"), "quality_score": F.lit(0.0)})
    return evidence.representatives(c).select("document_id", "chunk_index", "bucket")


@registered(f""", {RANKED_SQL}, f AS (SELECT document_id, chapter, regexp_extract(chapter, '[0-9]+')::INT AS no FROM chunks GROUP BY ALL),
    p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY no) AS place FROM f QUALIFY place <= 24),
    s AS (SELECT r.*, place FROM r JOIN p USING (document_id, chapter)),
    t AS (SELECT *, min(chunk_index) OVER (PARTITION BY document_id, chapter, section) AS b0 FROM s QUALIFY row_number() OVER (PARTITION BY document_id, chapter, section ORDER BY rk DESC, chunk_index) = 1),
    u AS (SELECT *, row_number() OVER (PARTITION BY document_id, chapter ORDER BY b0) AS turn FROM t)
    SELECT document_id, chunk_index::INT AS chunk_index, (row_number() OVER (PARTITION BY document_id ORDER BY turn, place))::INT AS position FROM u
    QUALIFY position <= 16""")  # fmt: skip
def chapter_representatives(spark, sf):
    c = tables.line_chunks(spark, sf).withColumns({"query_id": F.col("document_id").cast("string"), "quality_score": F.lit(0.0)})
    return evidence.chapter_representatives(c).select("document_id", "chunk_index", "position")


@registered("SELECT id, (length(regexp_replace(text, '[^\\p{Han}]', '', 'g')) + ceil((length(text) - length(regexp_replace(text, '[^\\p{Han}]', '', 'g'))) / 4))::BIGINT AS tokens FROM docs")
def token_estimate(spark, sf):
    return tables.documents(spark, sf).select("id", T.estimated_tokens("text").alias("tokens"))


# ---- text --------------------------------------------------------------------------

QUALITY = """q AS (SELECT id, text, length(regexp_replace(text, '[\\s\\x{0b}]', '', 'g')) AS n, len(regexp_extract_all(text, '[\\p{Han}A-Za-z0-9]')) AS m, len(regexp_extract_all(text, '[\\x{FFFD}\\x{E000}-\\x{F8FF}]')) AS d,
              len(regexp_extract_all('  ' || regexp_replace(text, '[^\\p{L}\\p{N}]', '  ', 'g') || '  ', ' [A-Za-z] ')) AS a FROM docs),
    s AS (SELECT *, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, m / n - 4 * d / n - CASE WHEN m > 0 THEN least(0.7::DOUBLE, a / m * 0.8::DOUBLE) ELSE 0 END)) END AS score FROM q)"""


@registered(f", {QUALITY} SELECT id, round(score, 6) AS score FROM s")
def quality_score(spark, sf):
    return tables.documents(spark, sf).select("id", F.round(T.quality_score("text"), 6).alias("score"))


@registered(f""", {QUALITY}, u AS (SELECT id, unnest([trim(regexp_replace(x, '[ \\t]+', ' ', 'g')) FOR x IN string_split_regex(text, '\\r?\\n')]) AS line FROM docs),
    v AS (SELECT id, coalesce(sum(length(line)) FILTER (NOT regexp_matches(line, '(?i)taobao\\.com|bilibili|https?://|www\\.|\\.com\\b|\\.cn\\b|扫码|二维码|QQ群')), 0) AS useful FROM u GROUP BY 1)
    SELECT id, m >= 48 AND score >= 0.62::DOUBLE AND useful >= 40 AS reliable FROM s JOIN v USING (id)""")  # fmt: skip
def reliable_text(spark, sf):
    return tables.documents(spark, sf).select("id", T.is_reliable("text").alias("reliable"))


LINES = ", ln AS (SELECT id, unnest(string_split(text, chr(10))) AS raw FROM docs), nl AS (SELECT id, trim(regexp_replace(raw, '[ \\t]+', ' ', 'g')) AS line FROM ln)"


@registered(LINES + """ SELECT id, count(*) AS lines, count(*) FILTER (line = '' OR regexp_matches(line, '^(?:第\\s*)?[-—–·. ]*[0-9]{1,4}[-—–·. ]*(?:页)?$')
    OR regexp_matches(line, '(?i)taobao\\.com|bilibili|https?://|www\\.|\\.com\\b|\\.cn\\b') OR regexp_matches(line, '[\\x{FFFD}\\x{E000}-\\x{F8FF}]')) AS noise FROM nl GROUP BY 1""")  # fmt: skip
def line_noise(spark, sf):
    lines = tables.documents(spark, sf).select("id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(T.is_noise_line("line")).alias("noise"))


def pages(spark, sf):
    """A source's documents as the pages of one document."""
    d = tables.documents(spark, sf).where(F.col("kb").isNotNull())
    return d.select(F.pmod(F.xxhash64("kb"), F.lit(1 << 40)).alias("document_id"), F.col("id").cast("int").alias("page"), "text", "kb")


@registered(""", p AS (SELECT kb, id, list_filter([trim(regexp_replace(x, '[ \\t]+', ' ', 'g')) FOR x IN string_split_regex(text, '\\r?\\n')], lambda x: x <> '') AS l FROM docs WHERE kb IS NOT NULL),
    e AS (SELECT DISTINCT kb, id, unnest([regexp_replace(lower(x), '[^\\p{L}\\p{N}]+', '', 'g') FOR x IN l[1:3] || l[-3:]]) AS signature FROM p),
    n AS (SELECT kb, greatest(3, ceil(count(*) * 0.015)) AS need FROM p GROUP BY 1)
    SELECT kb, signature FROM e JOIN n USING (kb) WHERE length(signature) BETWEEN 4 AND 100 GROUP BY kb, signature, need HAVING count(DISTINCT id) >= need""")  # fmt: skip
def repeated_margins(spark, sf):
    p = pages(spark, sf)
    return chunking.repeated_margins(p).join(p.select("document_id", "kb").distinct(), "document_id").select("kb", "signature")


@registered(""", p AS (SELECT kb, id, regexp_replace(text, '[\\x{FFFD}\\x{E000}-\\x{F8FF}]', '', 'g') AS t, len(regexp_extract_all(text, '[\\x{FFFD}\\x{E000}-\\x{F8FF}]')) AS damaged FROM docs WHERE kb IS NOT NULL),
    l AS (SELECT kb, id, list_filter([trim(regexp_replace(x, '[ \\t]+', ' ', 'g')) FOR x IN string_split_regex(t, '\\r?\\n')], lambda x: x <> '') AS l FROM p),
    e AS (SELECT DISTINCT kb, id, unnest([regexp_replace(lower(x), '[^\\p{L}\\p{N}]+', '', 'g') FOR x IN l[1:3] || l[-3:]]) AS signature FROM l),
    n AS (SELECT kb, greatest(3, ceil(count(*) * 0.015)) AS need FROM p GROUP BY 1),
    m AS (SELECT kb, signature FROM e JOIN n USING (kb) WHERE length(signature) BETWEEN 4 AND 100 GROUP BY kb, signature, need HAVING count(DISTINCT id) >= need),
    u AS (SELECT kb, id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM l),
    k AS (SELECT u.*, CASE WHEN regexp_matches(line, '^(?:第\\s*)?[-—–·. ]*[0-9]{1,4}[-—–·. ]*(?:页)?$') THEN 'n' WHEN regexp_matches(line, '(?i)taobao\\.com|bilibili|https?://|www\\.|\\.com\\b|\\.cn\\b|扫码|二维码|QQ群') THEN 'a' WHEN m.signature IS NOT NULL THEN 'm' END AS kind
          FROM u LEFT JOIN m ON m.kb = u.kb AND m.signature = regexp_replace(lower(line), '[^\\p{L}\\p{N}]+', '', 'g')),
    g AS (SELECT kb, id, string_agg(line, chr(10) ORDER BY pos) FILTER (kind IS NULL) AS text, count(*) FILTER (kind = 'n') AS numbers, count(*) FILTER (kind = 'a') AS advertisements, count(*) FILTER (kind = 'm') AS margins FROM k GROUP BY 1, 2)
    SELECT p.kb, p.id::INT AS page, coalesce(g.text, '') AS text, damaged::INT AS damaged, coalesce(numbers, 0) AS numbers, coalesce(advertisements, 0) AS advertisements, coalesce(margins, 0) AS margins FROM p LEFT JOIN g USING (kb, id)""")  # fmt: skip
def cleaned_pages(spark, sf):
    p = pages(spark, sf)
    return chunking.clean_pages(p).join(p.select("document_id", "kb").distinct(), "document_id").drop("document_id")


@registered()
def chunks_plain(spark, sf):
    return chunking.chunk_plain(tables.documents(spark, sf).select(F.col("id").alias("document_id"), "text"))


@registered()
def chunks_structured(spark, sf):
    d = tables.documents(spark, sf).select(F.col("id").alias("document_id"), F.lit(1).alias("page"), "text")
    return chunking.chunk_structured(d)


@registered()
def replaced_chunks(spark, sf):
    d = tables.documents(spark, sf).select(F.col("id").alias("document_id"), "text")
    return chunking.replace_chunks(d, d.withColumn("page", F.lit(1))).groupBy("status").agg(F.countDistinct("document_id").alias("documents"), F.count("content").alias("chunks"))


@registered("SELECT conv_id, turn, len(regexp_extract_all(text, '[0-9]+')) AS n FROM conversations WHERE role = 'user'", views=False)
def question_numbers(spark, sf):
    c = tables.read(spark, sf, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", F.regexp_count("text", F.lit("[0-9]+")).alias("n"))


@registered(""", q AS (SELECT id, lower(u) AS u, v FROM (SELECT id, unnest(regexp_extract_all(text, p, 1)) AS v, unnest(regexp_extract_all(text, p, 2)) AS u
        FROM docs, (SELECT '(?i)(-?[0-9]+(?:\\.[0-9]+)?)\\s*(毫秒|秒|分钟|小时|天|日|%|％|MiB|MB|GB)' AS p))),
    g AS (SELECT id, u FROM q GROUP BY 1, 2 HAVING count(DISTINCT v) > 1),
    f AS (SELECT id, list_sort(list(DISTINCT v || u)) AS found FROM q JOIN g USING (id, u) GROUP BY 1)
    SELECT docs.id, coalesce(found, []) AS found FROM docs LEFT JOIN f ON docs.id = f.id""")  # fmt: skip
def conflict_values(spark, sf):
    d = tables.documents(spark, sf)
    return d.select("id", F.array_sort(T.conflict_values(F.lit("到底是多少"), "text")).alias("found"))


@registered("SELECT id, title || ' [1] and [' || CASE WHEN id % 5 = id % 3 THEN 1 ELSE 2 END || '].' AS answer, true AS valid FROM docs")
def citation_remap(spark, sf):
    d = tables.documents(spark, sf).select("id", F.concat("title", F.lit(" ["), (F.col("id") % 5 + 1).cast("string"), F.lit("] and ["), (F.col("id") % 3 + 1).cast("string"), F.lit("].")).alias("answer"))
    return d.select("id", T.renumbered("answer", 5).alias("answer"), T.citations_valid("answer", 5).alias("valid"))


# ---- conversations -----------------------------------------------------------------


@registered("""SELECT conv_id, turn, CASE WHEN regexp_matches(regexp_replace(text, '\\s+', '', 'g'), '目录|主要章节|(?:每|各)章|(?:整本书|全书|整体|全局|总体)') THEN 'overview' ELSE 'new_query' END AS intent FROM conversations WHERE role = 'user'""", views=False)
def intent_classes(spark, sf):
    t = conversation.with_history(tables.read(spark, sf, "conversations"))
    return t.select("conv_id", "turn", conversation.intent(F.coalesce("query", F.lit("")), F.size("answers") > 0).alias("intent"))


@registered()
def rewritten_questions(spark, sf):
    t = conversation.rewritten(conversation.with_history(tables.read(spark, sf, "conversations")))
    return t.select("conv_id", "turn", "intent", "rewritten", "applied", "reason", "entities")


# ---- Chinese questions and lines: phrases put into the messages of conversations ----------


def phrased(name: str, of: Callable, phrases: list[str], rule: str, steps: str = "") -> None:
    """Register ``of`` (a column of a column) over all messages, each of which begins with
    one of ``phrases`` and, every fourth, goes on with its own text. ``rule`` is the same of
    ``t`` in SQL, after ``steps``, tables that begin with ``said`` (conv_id, turn, t)."""
    place = "pmod(conv_id * 7 + turn * 5, {n})"
    listed = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in phrases) + "]"

    def run(spark, sf):
        m = tables.read(spark, sf, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
        own = F.when(F.col("turn") % 4 == 3, T.text("text")).otherwise("")
        phrase = F.element_at(F.array(*[F.lit(x) for x in phrases]), (F.expr(place.format(n=len(phrases))) + 1).cast("int"))
        return m.select("conv_id", "turn", F.concat(phrase, own).alias("t")).select("conv_id", "turn", of(F.col("t")).alias("result"))

    run.__name__ = name
    said = f"said AS (SELECT conv_id, turn, {listed}[(conv_id * 7 + turn * 5) % {len(phrases)} + 1] || CASE WHEN turn % 4 = 3 THEN coalesce(text, '') ELSE '' END AS t FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)"
    registered(f"WITH {said}, c AS (SELECT *, regexp_replace(t, '[\\s\\x{{0b}}]+', '', 'g') AS q FROM said){steps} SELECT conv_id, turn, {rule} AS result FROM {'r' if steps else 'c'}", views=False)(run)


def has(column: str, *patterns: str) -> str:
    """Whether one of the patterns is found in a column, in SQL."""
    return "(" + " OR ".join(f"regexp_matches({column}, '{p.replace('(?U:', '(?:')}')" for p in patterns) + ")"


def numeral_sql(x: str) -> str:
    digits = "['零', '一', '二', '三', '四', '五', '六', '七', '八', '九']"
    at = lambda part: f"(list_position({digits}, {part}) - 1)"
    tens = "^([一二三四五六七八九]?)十([一二三四五六七八九]?)$"
    left, right = f"regexp_extract({x}, '{tens}', 1)", f"regexp_extract({x}, '{tens}', 2)"
    return f"CASE WHEN regexp_matches({x}, '^[0-9]+$') THEN TRY_CAST({x} AS INT) WHEN regexp_matches({x}, '{tens}') THEN CASE WHEN {left} = '' THEN 1 ELSE {at(left)} END * 10 + CASE WHEN {right} = '' THEN 0 ELSE {at(right)} END ELSE {at(x)} END::INT"


K = T.K
AFTER_SQL = " ".join(f"WHEN {has('q', *p)} THEN '{name}'" for name, p in (("summarize_previous", K.SUMMARIZE), ("continue_previous", K.CONTINUE), ("explain_previous", K.EXPLAIN), ("refinement", K.REFINEMENT), ("follow_up", K.FOLLOW_UP), ("contextual_query", [*K.CONTEXTUAL, K.THIS_CHAPTER])))
FIRST_SQL = f"WHEN {has('q', *K.OVERVIEW)} THEN 'overview' ELSE 'new_query' END"
SAYINGS = [
    "总结一下", "继续", "为什么", "换种说法", "它的作用", "第三章", "概括全书的整体框架", "虚拟内存由哪些部分组成", "", "请用三句话概括", "第2点呢", "本章有哪些重点", "那它们有什么区别",
    "还有呢", "更详细一点", "这本书的目录", "请总结刚才的内容", "只列重点", "梳理第十二章", "每章讲什么", "请 继续", "改成表格", "thing",
]
phrased("intents_after_answers", lambda c: conversation.intent(c, F.lit(True)), SAYINGS, f"CASE {AFTER_SQL} {FIRST_SQL}")
phrased("intents_of_first_questions", lambda c: conversation.intent(c, F.lit(False)), SAYINGS, f"CASE {FIRST_SQL}")
POINT_SQL = f"regexp_extract(q, '{K.ORDINAL}', 1)"
phrased(
    "explicit_scopes", conversation.explicit_scope,
    ["第三章有哪些内容", "全书框架", "第2点", "虚拟内存", "资料中是否提到缓存", "第十条", "第0项", "第十一点", "有多少种算法", "如何分配", "总结第4章", "目录", "是否说明了步骤", ""],
    f"CASE WHEN (regexp_matches({POINT_SQL}, '^[0-9]+$') AND TRY_CAST({POINT_SQL} AS INT) > 0) OR {POINT_SQL} IN ('一', '二', '三', '四', '五', '六', '七', '八', '九', '十') OR {has('q', K.EXISTENCE)} THEN 'local' "
    f"WHEN {has('q', K.CHAPTER)} AND {has('q', *K.OVERVIEW)} THEN 'chapter_overview' WHEN {has('q', *K.OVERVIEW)} THEN 'document_overview' WHEN {has('q', K.ENUMERATION, K.HOW_WHAT)} THEN 'local' END",
)
LISTS = ["列出全部文档", "文档的内容", "知识库里有多少份资料", "你好", "有哪些知识库", "知识库简介", "文档清单", "介绍一下知识库的内容", "当前知识库有哪些文件", "知识库概览有哪些", "多少类文档", "知识库名称列表", "资料 列表", ""]
PROFILE_SQL = f"(contains(q, '知识库') AND {has('q', K.PROFILE_CUE)} AND NOT {has('q', K.PROFILE_LIST)})"
phrased("document_inventories", conversation.asks_for_documents, LISTS, f"{has('q', K.INVENTORY_NOUN)} AND NOT {has('q', K.INVENTORY_CONTENT)} AND {has('q', *K.INVENTORY)}")
phrased("base_inventories", conversation.asks_for_bases, LISTS, f"contains(q, '知识库') AND NOT {has('q', K.INVENTORY_NOUN)} AND NOT {PROFILE_SQL} AND {has('q', K.BASE_CUE, K.BASE_CONTENTS)}")
phrased("base_profiles", conversation.asks_for_profile, LISTS, PROFILE_SQL)
phrased("numerals", T.numeral, ["二十三", "十", "百", "7", "九十九", "零", "十五", "六十", "042", "一百", "二", "99999999999", ""], numeral_sql("t"))
#: A line with single blanks and none around it.
LINE_SQL = "regexp_replace(regexp_replace({}, '[ \\t]+', ' ', 'g'), '^[\\s\\x{{0b}}]+|[\\s\\x{{0b}}]+$', '', 'g')"
HEADING_SQL = f"regexp_extract({LINE_SQL.format('t')}, '{K.CHAPTER_HEADING.replace('(?U:', '(?:')}', 1)"
phrased(
    "chapter_headings", T.chapter_heading, [" 第 三 章 内存", "第一百章 ", "章节", "第12章", "第十二章：", "见第二章", "第零章", "第 9\t章 x", "3.1 第三章"],
    f"CASE WHEN {HEADING_SQL} <> '' THEN '第' || coalesce(({numeral_sql(HEADING_SQL)})::VARCHAR, {HEADING_SQL}) || '章' END",
)
SECTION = K.SECTION_NUMBER.replace("(?U:", "(?:").replace("IsHan", "Han")
SECTION_SQL = lambda k: f"regexp_extract({LINE_SQL.format('t')}, '{SECTION}', {k})"
phrased(
    "section_headings", T.section_heading, ["3.1.2  虚拟内存 概念", "3 虚拟", "12.4 、Cache 结构。说明", "1.1 x", "0.1 零", "2.10: 页表", "7.3. 段", "第1章 1.2 概述", "4.5\t换页 算法 "],
    f"CASE WHEN {has(LINE_SQL.format('t'), SECTION)} THEN {LINE_SQL.format(SECTION_SQL(1) + chr(32) + '||' + chr(32) + repr(' ') + ' || ' + SECTION_SQL(2))} END",
)
phrased(
    "contents_pages", T.looks_like_toc,
    ["第1章 a....12\n1.1 b....3\nc\nd\n", "a\nb\nc\n", "1.1 x\n1.2 y\n2.1 z\nplain\n", "1.1 x\n1.2 y\n" + "这一行说明了系统的各个组成部分以及它们之间的关系，并且足够长，可以算作正文。\n" * 2, "目录……3\n\n 绪论…… 4 \nx\ny\n"],
    "len(l) >= 4 AND (leaders >= 2 OR (outline / len(l) >= 0.45 AND prose / len(l) < 0.2))",
    f""", l AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(t, '\\r?\\n'), lambda x: {LINE_SQL.format('x')}), lambda x: x <> '') AS l FROM c),
    r AS (SELECT *, len(list_filter(l, lambda x: {has('x', K.LEADER)})) AS leaders, len(list_filter(l, lambda x: {has('x', K.OUTLINE)})) AS outline, len(list_filter(l, lambda x: length(x) >= 36 AND {has('x', K.PROSE_END)})) AS prose FROM l)""",
)
phrased(
    "quality_of_short_texts", lambda c: F.round(T.quality_score(c), 6), ["", "内存管理", "a b c", "页 x 表", "��内存", "...", "12 ab", "x"], "round(score, 6)",
    QUALITY[QUALITY.index("q AS") :].replace("q AS", ", w AS").replace("id, text", "conv_id, turn, t").replace("(text,", "(t,").replace("FROM docs", "FROM c").replace("s AS (", "r AS (").replace("FROM q)", "FROM w)"),
)


def _without_words(x: str, words: list[str]) -> str:
    for w in words:
        x = f"replace({x}, '{w}', ' ')"
    return x


phrased(
    "query_terms", lambda c: F.array_sort(T.query_terms(c)), ["请介绍一下虚拟内存", "计组 的Cache_1", "内存", "页", "x86 与 ARM64 的区别", "", "总结数据结构B树"],
    "list_sort(list_distinct(flatten([CASE WHEN regexp_full_match(x, '[\\x{4e00}-\\x{9fff}]{4,}') THEN [x] || [x[i:i+1] FOR i IN range(1, length(x))] ELSE [x] END FOR x IN runs])))",
    f""", r AS (SELECT conv_id, turn, regexp_extract_all({_without_words("replace(lower(t), '计组', '" + K.ALIASES['计组'] + "')", K.INTENT_WORDS)}, '[a-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]+') AS runs FROM c)""",
)


# ---- audits ------------------------------------------------------------------------


@registered("""SELECT l_orderkey, l_linenumber, p AS previous_page FROM (SELECT *, last_value(nullif(l_quantity::INT, 0) IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM lineitem)
    WHERE l_quantity::INT > 0 AND l_quantity::INT < p""", views=False)  # fmt: skip
def page_order_violations(spark, sf):
    c = tables.read(spark, sf, "lineitem").withColumn("page", F.col("l_quantity").cast("int"))
    return audit.order_violations(c, "l_orderkey", ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "page").select("l_orderkey", "l_linenumber", "previous_page")


@registered("""SELECT event_type AS endpoint, count(*) AS requests, count(*) FILTER (event_type = 'error' OR value IS NULL) AS errors, round(count(*) FILTER (event_type = 'error' OR value IS NULL) / count(*), 10) AS error_rate, round(count(*) / 60.0::DOUBLE, 8) AS per_second, list_sort(list(value))[least(count(value), floor(count(value) * 0.95)::BIGINT + 1)] AS p95 FROM events GROUP BY 1""", views=False)
def stress_percentile(spark, sf):
    e = tables.read(spark, sf, "events").select(F.col("event_type").alias("endpoint"), F.col("value").alias("ms"), (~((F.col("event_type") == "error") | F.col("value").isNull())).alias("ok"))
    return audit.latency_report(e, 60.0).select("endpoint", "requests", "errors", F.round("error_rate", 10).alias("error_rate"), F.round("per_second", 8).alias("per_second"), "p95")


@registered("SELECT document_id, chapter, count(*) AS chunks, count(*) FILTER (regexp_matches(content, '(?i)taobao|bilibili|QQ群|购买王道|下载网站|高清带书签|王道教育|\\x{FFFD}|[\\x{E000}-\\x{F8FF}]')) AS noise, count(*) FILTER (chunk_index % 3 = 0) AS missing FROM chunks GROUP BY 1, 2")
def chapter_summary(spark, sf):
    c = tables.line_chunks(spark, sf).withColumns({"page_start": F.col("chunk_index"), "page_end": F.col("chunk_index"), "embedded": (F.col("chunk_index") % 3 != 0).cast("int")})
    return audit.chapter_summary(c).select("document_id", "chapter", "chunks", "noise", "missing")


@registered(""", c AS (SELECT document_id, chunk_index, section, TRY_CAST(regexp_extract(substr(CASE WHEN chunk_index % 3 = 0 THEN '第 ' || (chunk_index % 5 + 1) || ' 章 ' ELSE '见第1章 ' END || content, 1, 180), '(?:^|\\n)\\s*第\\s*([0-9]{1,2})\\s*章', 1) AS INT) AS told,
          TRY_CAST(regexp_extract(section, '^([0-9]{1,2})\\.', 1) AS INT) AS major, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS rn FROM chunks),
    w AS (SELECT document_id, 0::BIGINT AS rn, 0 AS now, 0::BIGINT AS chunk_index, NULL::VARCHAR AS section FROM (SELECT DISTINCT document_id FROM c)
          UNION ALL
          SELECT document_id, rn, now, chunk_index, CASE WHEN major IS NULL OR (major BETWEEN 1 AND 6 AND (now = 0 AND major = 1 OR now > 0 AND major IN (now, now + 1))) THEN section END
          FROM (SELECT c.document_id, c.rn, c.chunk_index, c.section, c.major,
                       CASE WHEN told BETWEEN 1 AND 6 AND (now = 0 AND told = 1 OR now > 0 AND told IN (now, now + 1)) THEN told
                            WHEN major BETWEEN 1 AND 6 AND (now = 0 AND major = 1 OR now > 0 AND major IN (now, now + 1)) THEN major ELSE now END AS now
                FROM w JOIN c ON c.document_id = w.document_id AND c.rn = w.rn + 1))
    SELECT document_id, chunk_index, CASE WHEN now > 0 THEN '第' || now || '章' END AS chapter, section FROM w WHERE rn > 0""")  # fmt: skip
def chapter_repair(spark, sf):
    """Lines with a chapter before every third, and a mention that announces none before others."""
    c = tables.line_chunks(spark, sf)
    told = F.when(F.col("chunk_index") % 3 == 0, F.concat(F.lit("第 "), (F.col("chunk_index") % 5 + 1).cast("string"), F.lit(" 章 "))).otherwise("见第1章 ")
    return audit.repaired_chapters(c.withColumn("content", F.concat(told, "content")), c.select("document_id").distinct().withColumn("n", F.lit(6)))


# ---- writes ------------------------------------------------------------------------


@registered("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 0.0 ELSE c_acctbal END::DOUBLE AS value FROM customer UNION ALL SELECT -1, 0.0", views=False)
def upserted(spark, sf):
    t = tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    new = t.where("id % 2 = 0").withColumn("value", F.lit(0.0)).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(0.0).alias("value")))
    return sinks.upserted(t, new, ["id"])


@registered("SELECT c_custkey AS id FROM customer UNION SELECT s_suppkey * 100 FROM supplier", views=False)
def inserted_new(spark, sf):
    t = tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return sinks.inserted_new(t, tables.read(spark, sf, "supplier").select((F.col("s_suppkey") * 100).alias("id")), ["id"])


@registered("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)", views=False)
def cascade_delete(spark, sf):
    t = {"customer": tables.read(spark, sf, "customer"), "orders": tables.read(spark, sf, "orders")}
    gone = t["customer"].where("c_nationkey = 7").select("c_custkey")
    return sinks.deleted_with_dependents(t, gone, "customer", "c_custkey", "o_custkey")["orders"].select("o_orderkey")
