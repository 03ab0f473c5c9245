"""Phrases in texts by join against looking for every phrase in every text."""

import random

import pytest

from quillspark.operators import conversation
from quillspark.operators.matching import holding


@pytest.mark.parametrize("size", [1, 2, 4])
def test_holding(spark, size):
    rnd = random.Random(size)
    word = lambda n: "".join(rnd.choice("abc数据é") for _ in range(n))
    texts = [(i, word(rnd.randint(0, 60))) for i in range(200)] + [(200, None), (201, ""), (0, "aaaa bbbb"), (202, "数据" * 5000)]
    phrases = [word(rnd.randint(0, 8)) for _ in range(300)] + [None, "", "aaaa", "aaaa", "a.b*", "数据" * 40]
    got = holding(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string"), size)
    want = {(i, p) for i, t in texts for p in phrases if t and p and len(p) >= size and p in t}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and want


def test_no_pair_of_all_is_tried(spark):
    texts = spark.createDataFrame([(1, "x")], "text_id long, text string")
    plan = holding(texts, texts.selectExpr("text as phrase"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_named_documents(spark):
    docs = [(1, "王道操作系统2024", 3), (2, "操作系统笔记", 4), (3, "Distributed Systems", 4), (4, "distributed systems", 5), (5, "abc", 3), (6, None, 3), (7, "数据库原理 第2版", None)]
    asked = [("a", "操作系统的进程是什么"), ("b", "what do Distributed-Systems say"), ("c", "abc 是什么"), ("d", "《数据库原理第版》讲了什么"), ("e", None), ("f", "计组")]
    q = spark.createDataFrame(asked, "query_id string, query string")
    d = spark.createDataFrame(docs, "id long, title string, owner_id long")
    got = {}
    for r in conversation.named_documents(q, d, 3).collect():
        got.setdefault(r.query_id, set()).add(r.document_id)
    assert got == {"a": {1}, "b": {3, 4}, "d": {7}}  # of the subject's books the user's own
    other = conversation.named_documents(q, d, 9).where("query_id = 'a'").collect()
    assert {r.document_id for r in other} == {1, 2}
    plan = conversation.named_documents(q, d, 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_named_documents_makes_no_pair_twice(spark):
    """By title and by two subjects at once: one pair, and none of others' documents."""
    docs = [(1, "操作系统与计算机网络", 4), (2, "操作系统", 4), (3, "计算机网络", 3), (4, "操作系统实践", 4)]
    d = spark.createDataFrame(docs, "id long, title string, owner_id long")
    q = spark.createDataFrame([("a", "操作系统与计算机网络的关系"), ("b", "操作系统"), ("b", "操作系统"), ("c", "操作系统实践")], "query_id string, query string")
    got = sorted(map(tuple, conversation.named_documents(q, d, 3).collect()))
    assert got == [("a", 3), ("b", 1), ("b", 2), ("b", 4), ("c", 1), ("c", 2), ("c", 4)]
    plan = conversation.named_documents(q, d, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
