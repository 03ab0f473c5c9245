"""The demo tables against one loop over one sequence of random numbers."""

import math
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quillspark.sources import synthetic as S

NOW = 1_785_000_000_000


def sequential(p, seed):
    state = seed

    def random():
        nonlocal state
        state = (state * 1664525 + 1013904223) % 2**32
        return state / 2**32

    pick = lambda values: values[math.floor(random() * len(values))]

    def date(days=120):
        ms = int(NOW - random() * days * 86_400_000)
        return datetime.fromtimestamp(ms // 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S") + f".{ms % 1000:03d}Z"

    t = {k: [] for k in ("users", "knowledge_bases", "documents", "kb_documents", "likes", "favorites", "comments", "search_logs", "chat_sessions", "messages")}
    users, bases, docs = (range(1, p[k] + 1) for k in ("users", "knowledge_bases", "documents"))
    t["users"] = [(i, f"demo_{i:03d}", date()) for i in users]
    for i in bases:
        d = date()
        t["knowledge_bases"].append((i, pick(users), f"[演示] {pick(S.TOPICS)}资料库 {i}", d))
    files = [(pick(S.CATEGORIES), pick(S.TOPICS)) for _ in docs]
    links = {}
    for i, (category, topic) in zip(docs, files, strict=True):
        d = date()
        t["documents"].append((i, pick(users), f"[演示] {topic}案例 {i}", category, math.floor(random() * 2000), math.floor(random() * 500), d))
        for _ in range(2):
            links.setdefault((pick(bases), i), d)
    t["kb_documents"] = [(*k, v) for k, v in links.items()]
    for name in ("likes", "favorites"):
        seen = {}
        for _ in range(p[name]):
            u, doc, d = pick(users), pick(docs), date()
            seen.setdefault((u, doc), d)
        t[name] = [(*k, v) for k, v in seen.items()]
    t["comments"] = [(i + 1, pick(users), pick(docs), f"演示评论 {i + 1}：该资料对{pick(S.TOPICS)}的说明很清楚。", date()) for i in range(p["comments"])]
    t["search_logs"] = [(i + 1, pick(users), pick(S.TOPICS), date(30)) for i in range(p["search_logs"])]
    for i in range(1, p["chat_sessions"] + 1):
        topic, d = pick(S.TOPICS), date(30)
        t["chat_sessions"].append((i, pick(users), pick(bases), f"{topic}如何实现？", d))
        t["messages"] += [(2 * i - 1, i, f"{topic}如何实现？", [], d), (2 * i, i, f"根据演示知识库，{topic}需要结合需求、代码和测试数据进行验证。[1]", [pick(docs)], d)]
    return t


COLUMNS = {
    "users": ["id", "username", "created_at"], "knowledge_bases": ["id", "owner_id", "name", "created_at"], "documents": ["id", "owner_id", "title", "category", "views", "downloads", "created_at"],
    "kb_documents": ["knowledge_base_id", "document_id", "added_at"], "likes": ["user_id", "document_id", "created_at"], "favorites": ["user_id", "document_id", "created_at"],
    "comments": ["id", "user_id", "document_id", "content", "created_at"], "search_logs": ["id", "user_id", "query", "created_at"], "chat_sessions": ["id", "user_id", "knowledge_base_id", "title", "created_at"],
    "messages": ["id", "session_id", "content", "cited", "created_at"],
}


@pytest.mark.parametrize("seed", [S.SEED, 1])
def test_same_as_a_loop(spark, seed):
    got, want = S.demo(spark, "small", seed, NOW), sequential(S.PROFILES["small"], seed)
    for name, columns in COLUMNS.items():
        assert sorted(tuple(r) for r in got[name].select(*columns).collect()) == sorted(map(tuple, want[name])), name
    assert got["document_chunks"].count() == 640 and got["document_versions"].count() == 80
    chunk = got["document_chunks"].where("document_id = 3 and chunk_index = 2").first().content
    assert chunk.startswith("演示文档 3：") and chunk.endswith(f"片段 3 重点说明{S.TOPICS[5]}的实现、测试与验收方法。")


def test_far_jumps(spark):
    ks = [0, 1, 2, 3, 1000, 2**20 + 7, 2**33 + 12345, 2**45 + 1]
    got = spark.createDataFrame([(k,) for k in ks], "k long").select("k", S.after(F.col("k")).alias("s")).collect()
    for r in got:  # 2^32 draws come back to the beginning
        state = S.SEED
        a, c = 1664525, 1013904223
        k = r.k
        while k:  # the same by another way: squares of the step as a matrix
            if k & 1:
                state = (a * state + c) % 2**32
            a, c, k = a * a % 2**32, (a * c + c) % 2**32, k >> 1
        assert r.s == state
    steps = [S.SEED]
    for _ in range(1000):
        steps.append((steps[-1] * 1664525 + 1013904223) % 2**32)
    assert {r.k: r.s for r in got}[1000] == steps[1000]


def test_larger_and_in_parts(spark):
    one, many = S.demo(spark, "small", now_ms=NOW, times=3)["comments"], S.demo(spark, "small", now_ms=NOW, times=3)["comments"].repartition(5)
    assert one.count() == 900 and sorted(one.collect()) == sorted(many.collect())
