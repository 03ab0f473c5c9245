"""Demo tables of three scales (S22), equal to those of one sequence of random numbers
drawn row after row, but made in parallel.

The sequence is a linear congruential one. Every row of a table draws a fixed number of
them, so where a row's draws begin is known, and the state there is reached by jumps:
2^b steps are one step with other constants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows by scale.
PROFILES = {
    "small": {"users": 12, "knowledge_bases": 8, "documents": 80, "chunks": 8, "search_logs": 1000, "chat_sessions": 100, "likes": 500, "favorites": 350, "comments": 300},
    "medium": {"users": 40, "knowledge_bases": 18, "documents": 300, "chunks": 15, "search_logs": 6000, "chat_sessions": 500, "likes": 2500, "favorites": 1800, "comments": 1600},
    "large": {"users": 100, "knowledge_bases": 50, "documents": 1000, "chunks": 20, "search_logs": 20000, "chat_sessions": 2000, "likes": 10000, "favorites": 7000, "comments": 6000},
}
# The sequence, modulo 2^32.
SEED, FACTOR, STEP = 20260725, 1664525, 1013904223
# What rows are made of.
CATEGORIES = ["课程资料", "技术文档", "项目规范", "会议纪要", "产品手册", "培训资料"]
TOPICS = ["知识管理", "全文检索", "共享审核", "权限控制", "数据统计", "文档版本", "课程设计", "系统测试"]
BASE_TEXT = "压力测试与课程验机使用的可重复演示数据"
TEXT = "\n\n".join([
    "演示文档 {index}：{topic}", "本资料属于{category}，用于验证实验二的知识管理平台。", "系统支持用户注册登录、文档上传、分类标签、历史版本和知识库权限管理。",
    "全文检索会返回匹配片段，并根据{topic}推荐相关知识文档。", "用户可以收藏、点赞、评论，管理员负责共享审核。", "统计模块记录访问、下载、检索和问答次数。",
])
CHUNK = "{text}\n\n片段 {n} 重点说明{topic}的实现、测试与验收方法。"
COMMENT = "演示评论 {n}：该资料对{topic}的说明很清楚。"
QUESTION, ANSWER = "{topic}如何实现？", "根据演示知识库，{topic}需要结合需求、代码和测试数据进行验证。[1]"

#: Draws of a row, in the order in which tables draw.
DRAWS = {"users": 1, "knowledge_bases": 3, "files": 2, "documents": 6, "likes": 3, "favorites": 3, "comments": 4, "search_logs": 3, "chat_sessions": 5}
_LOW = (1 << 32) - 1


def _times(factor: Column | int, s: Column) -> Column:
    """factor x s modulo 2^32, within 64 bits."""
    factor = F.lit(factor) if isinstance(factor, int) else factor
    high = F.shiftleft((F.shiftright(factor, 16) * s).bitwiseAND(0xFFFF), 16)
    return (high + factor.bitwiseAND(0xFFFF) * s).bitwiseAND(_LOW)


def after(k: Column, seed: int = SEED) -> Column:
    """The state of the sequence after ``k`` draws (0 to 2^48 - 1)."""
    jumps, a, c = [], FACTOR, STEP
    for b in range(48):
        jumps.append(F.struct(F.lit(b).alias("b"), F.lit(a).cast("long").alias("a"), F.lit(c).cast("long").alias("c")))
        a, c = a * a & _LOW, (a + 1) * c & _LOW
    taken = F.filter(F.array(*jumps), lambda j: F.call_function("getbit", k.cast("long"), j["b"]) == 1)
    return F.aggregate(taken, F.lit(seed & _LOW).cast("long"), lambda s, j: (_times(j["a"], s) + j["c"]).bitwiseAND(_LOW))


def drawn(rows: DataFrame, table: str, sizes: dict[str, int], seed: int) -> DataFrame:
    """``rows`` (n from 0) with ``r0``, ``r1``, ...: the numbers from 0 to 1 that a row draws."""
    before = 0
    for name, draws in DRAWS.items():
        if name == table:
            break
        before += draws * sizes[name]
    states = [after(F.lit(before) + F.col("n") * DRAWS[table] + 1, seed)]
    out = rows.withColumn("s0", states[0])
    for i in range(1, DRAWS[table]):
        out = out.withColumn(f"s{i}", (_times(FACTOR, F.col(f"s{i - 1}")) + STEP).bitwiseAND(_LOW))
    return out.select(*rows.columns, *[(F.col(f"s{i}") / F.lit(float(1 << 32))).alias(f"r{i}") for i in range(DRAWS[table])])


def demo(spark: SparkSession, scale: str = "medium", seed: int = SEED, now_ms: int = 1_785_000_000_000, times: int = 1, prefix: str = "demo") -> dict[str, DataFrame]:
    """The demo tables; ``times`` multiplies a scale's rows. Ids count from 1, dates are
    ISO strings before ``now_ms`` (milliseconds since 1970), what is inserted twice stays
    as it was inserted first."""
    p = {k: v * (1 if k == "chunks" else times) for k, v in PROFILES[scale].items()}
    sizes = {**p, "files": p["documents"]}
    rows = lambda t: drawn(spark.range(sizes[t]).select(F.col("id").alias("n")), t, sizes, seed).withColumn("id", F.col("n") + 1)
    place = lambda r, size: F.floor(F.col(r) * size).cast("long")
    pick = lambda r, of: place(r, p[of]) + 1
    word = lambda r, words: F.element_at(F.array(*[F.lit(w) for w in words]), (place(r, len(words)) + 1).cast("int"))
    iso = lambda r, days=120: F.date_format(F.timestamp_millis((F.lit(float(now_ms)) - F.col(r) * days * 86_400_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

    def filled(template: str, **values: Column) -> Column:
        out = F.lit(template)
        for name, value in values.items():
            out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
        return out

    tag = prefix.replace("-", "_")
    users = rows("users").select("id", F.concat(F.lit(f"{tag}_"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("username"), F.concat(F.lit(tag), F.col("id").cast("string"), F.lit("@example.test")).alias("email"), F.when(F.col("id") <= 3, "department_admin").otherwise("user").alias("role"), iso("r0").alias("created_at"))
    bases = rows("knowledge_bases").select("id", pick("r1", "users").alias("owner_id"), filled("[演示] {topic}资料库 {n}", topic=word("r2", TOPICS), n=F.col("id")).alias("name"), F.lit(BASE_TEXT).alias("description"), F.when(F.col("id") % 3 == 0, "private").otherwise("shared").alias("visibility"), iso("r0").alias("created_at"))
    files = rows("files").select("id", word("r0", CATEGORIES).alias("category"), word("r1", TOPICS).alias("topic"))
    files = files.withColumn("text_content", filled(TEXT, index=F.col("id"), topic=F.col("topic"), category=F.col("category")))
    made = rows("documents").join(files, "id")
    share = F.when(F.col("id") % 7 == 0, "pending").when(F.col("id") % 5 == 0, "private").otherwise("shared")
    documents = made.select(
        "id", pick("r1", "users").alias("owner_id"), filled("[演示] {topic}案例 {n}", topic=F.col("topic"), n=F.col("id")).alias("title"), F.concat(F.lit(f"{prefix}-"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit(".txt")).alias("filename"),
        F.octet_length("text_content").cast("long").alias("file_size"), "category", F.array(F.col("topic"), F.lit("演示数据"), F.concat(F.lit("批次"), (F.col("id") % 10).cast("string"))).alias("tags"), "text_content", F.lit("ready").alias("status"), share.alias("share_status"),
        place("r2", 2000).alias("views"), place("r3", 500).alias("downloads"), F.lit(1).alias("version"), iso("r0").alias("created_at"),
    )
    versions = documents.select(F.col("id").alias("document_id"), "version", "filename", "file_size", "created_at")
    chunks = files.select("id", "text_content", F.explode(F.sequence(F.lit(0), F.lit(p["chunks"] - 1))).alias("chunk_index"))
    second = F.element_at(F.array(*[F.lit(t) for t in TOPICS]), ((F.col("id") + F.col("chunk_index")) % len(TOPICS) + 1).cast("int"))
    chunks = chunks.select(F.col("id").alias("document_id"), "chunk_index", filled(CHUNK, text=F.col("text_content"), n=F.col("chunk_index") + 1, topic=second).alias("content"))
    linked = made.select(F.explode(F.array(pick("r4", "knowledge_bases"), pick("r5", "knowledge_bases"))).alias("knowledge_base_id"), F.col("id").alias("document_id"), iso("r0").alias("added_at")).distinct()

    def relation(table: str) -> DataFrame:
        r = rows(table).select("n", pick("r0", "users").alias("user_id"), pick("r1", "documents").alias("document_id"), iso("r2").alias("created_at"))
        return r.groupBy("user_id", "document_id").agg(F.min_by("created_at", "n").alias("created_at"))

    comments = rows("comments").select("id", pick("r0", "users").alias("user_id"), pick("r1", "documents").alias("document_id"), filled(COMMENT, n=F.col("id"), topic=word("r2", TOPICS)).alias("content"), iso("r3").alias("created_at"))
    logs = rows("search_logs").select("id", pick("r0", "users").alias("user_id"), word("r1", TOPICS).alias("query"), F.lit("demo" if prefix == "demo" else f"demo:{prefix}").alias("mode"), iso("r2", 30).alias("created_at"))
    talk = rows("chat_sessions").withColumns({"topic": word("r0", TOPICS), "created_at": iso("r1", 30)})
    asked, said = filled(QUESTION, topic=F.col("topic")), filled(ANSWER, topic=F.col("topic"))
    sessions = talk.select("id", pick("r2", "users").alias("user_id"), pick("r3", "knowledge_bases").alias("knowledge_base_id"), asked.alias("title"), "created_at")
    none = F.array().cast("array<bigint>")
    turn = lambda i, role, content, cited: F.struct((2 * F.col("n") + i).alias("id"), F.lit(role).alias("role"), content.alias("content"), cited.alias("cited"))
    messages = talk.select(F.col("id").alias("session_id"), F.explode(F.array(turn(1, "user", asked, none), turn(2, "assistant", said, F.array(pick("r4", "documents"))))).alias("m"), "created_at").select("m.id", "session_id", "m.role", "m.content", "m.cited", "created_at")
    return {
        "users": users, "knowledge_bases": bases, "documents": documents, "document_versions": versions, "document_chunks": chunks, "kb_documents": linked, "likes": relation("likes"), "favorites": relation("favorites"),
        "comments": comments, "search_logs": logs, "chat_sessions": sessions, "messages": messages,
    }
