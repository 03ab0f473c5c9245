"""Searching within scopes, conversations, ingest, jobs and the checks of arguments."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark import __main__ as jobs
from quillspark.functions import arguments
from quillspark.operators import access, conversation, evidence, vectors
from quillspark.operators.access import User
from quillspark.plans import search as plans
from quillspark.plans.ingest import ingest
from quillspark.sources import readers

TEXTS = {
    1: ("计算机网络", [("第1章", "1.1 分层", "网络分层把复杂的功能划分为若干层次，每一层向上一层提供服务。"), ("第1章", "1.1 分层", "分层的好处是各层之间相互独立，便于实现和维护。"), ("第2章", "2.1 滑动窗口", "滑动窗口是一种流量控制方法，发送方可以连续发送多个分组而不必等待确认。")]),
    2: ("操作系统", [("第1章", "1.1 进程", "进程是程序的一次执行过程，是系统进行资源分配和调度的独立单位。"), ("第2章", "2.1 内存管理", "内存管理负责内存空间的分配与回收，并通过地址变换实现虚拟存储。")]),
}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(d * 100 + i, d, 1, i, t, title, f"{title}.txt", [], 3 if d == 1 else 4, "shared", c, s, "content", d) for d, (title, cs) in TEXTS.items() for i, (c, s, t) in enumerate(cs)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, document_version int, chunk_index int, content string, title string, filename string, tags array<string>, owner_id long, share_status string, chapter string, section string, content_type string, id long")
    docs = spark.createDataFrame([(1, "计算机网络", 3, "shared"), (2, "操作系统", 4, "shared")], "id long, title string, owner_id long, share_status string")
    return plans.Corpus(chunks), docs


def test_search_within_scopes(spark, corpus):
    q = spark.createDataFrame([("a", "滑动窗口"), ("b", "滑动窗口"), ("c", "内存管理")], "query_id string, query string")
    scopes = spark.createDataFrame([("b", 2)], "query_id string, document_id long")
    got = plans.search(corpus[0], User(9), q, scopes=scopes).select("query_id", "document_id").distinct().collect()
    assert {(r.query_id, r.document_id) for r in got} == {("a", 1), ("c", 2)}
    with pytest.raises(ValueError):
        plans.search(corpus[0], User(9), q, limit=51)


def test_conversations(spark, corpus):
    turns = [
        (1, 0, "user", "什么是滑动窗口"), (1, 1, "assistant", "滑动窗口是一种流量控制方法。[1]\n它可以连续发送。[1]"), (1, 2, "user", "请精简为一句话"),
        (2, 0, "user", "概括操作系统这本书的主要内容"), (3, 0, "user", "量子计算的原理是什么"), (4, 0, "user", "什么是进程"), (4, 1, "assistant", "进程是程序的一次执行过程。[1]"), (4, 2, "user", "它有什么作用"),
    ]
    t = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    got = plans.converse(corpus[0], User(9), t, corpus[1], cited=spark.createDataFrame([("4/2", 2)], "query_id string, document_id long"))
    a = {r.query_id: r for r in got["answers"].collect()}
    assert set(a) == {"1/0", "1/2", "2/0", "3/0", "4/0", "4/2"}
    assert "滑动窗口是一种流量控制方法" in a["1/0"].answer and a["1/0"].outcome == "sufficient"
    assert a["1/2"].intent == "refinement" and a["1/2"].answer == "滑动窗口是一种流量控制方法。[1]"
    assert a["2/0"].query_type == "overview" and a["2/0"].document_ids == [2] and a["2/0"].scope_source == "query" and "1.1 进程" in a["2/0"].answer and "2.1 内存管理" in a["2/0"].answer
    assert a["3/0"].outcome == "retrieval_insufficient" and a["3/0"].answer.startswith("现有资料没有提供")
    assert a["4/2"].document_ids == [2] and a["4/2"].scope_source == "history"
    assert {r.document_id for r in got["contexts"].where("query_id = '2/0'").collect()} == {2}
    state = spark.createDataFrame([(a["1/0"].state,)], "s string").select(conversation.parsed_state("s").alias("s")).first().s
    assert state.version == 2 and state.evidence[0].chunk_id in (100, 101, 102)
    neighbours = {r.chunk_id for r in got["contexts"].where("query_id = '1/0'").collect()}
    assert 102 in neighbours


def test_first_wins(spark):
    kind = "query_id string, position int, chunk_id long, source string"
    now = spark.createDataFrame([("q", 1, 5, "now"), ("q", 2, 7, "now")], kind)
    old = spark.createDataFrame([("q", 1, 7, "old"), ("q", 2, 9, "old"), ("q", 3, 11, "old"), ("r", 1, 5, "old")], kind)
    got = [(r.query_id, r.position, r.chunk_id, r.source) for r in evidence.first_wins(now, old, 3).orderBy("query_id", "position").collect()]
    assert got == [("q", 1, 5, "now"), ("q", 2, 7, "now"), ("q", 3, 9, "old"), ("r", 1, 5, "old")]


def test_bases_that_questions_name(spark):
    bases = spark.createDataFrame([(1, "网络"), (2, "网络安全"), (3, "考研知识库"), (4, " 操作 系统资料 "), (5, None)], "id long, name string")
    asked = [("a", "网络安全知识库有哪些文档"), ("b", "知识库网络里有什么文件"), ("c", "列出考研知识库的资料"), ("d", "请问操作系统知识库有多少文档"), ("e", "从网知识库查看文件"), ("f", "你好")]
    got = {r.query_id: r.kb_id for r in conversation.mentioned_bases(spark.createDataFrame(asked, "query_id string, query string"), bases).collect()}
    assert got == {"a": 2, "b": 1, "c": 3, "d": 4}


def test_arguments():
    assert arguments.limit(None) == 12 and arguments.limit("7") == 7 and arguments.limit(50) == 50
    assert arguments.identifier("3") == 3 and arguments.choice("", "sort", ("a", "b"), "a") == "a" and arguments.choice("b", "sort", ("a", "b"), "a") == "b"
    assert arguments.required_text(" x ", "name") == "x" and arguments.optional_text(None) == ""
    for call in (lambda: arguments.limit("0"), lambda: arguments.limit("1.5"), lambda: arguments.limit(True), lambda: arguments.limit(51), lambda: arguments.identifier(0), lambda: arguments.identifier("x"), lambda: arguments.identifier(1.5), lambda: arguments.identifier(2**53), lambda: arguments.choice("c", "s", ("a",), "a"), lambda: arguments.required_text("  ", "n"), lambda: arguments.optional_text("x" * 501)):
        with pytest.raises(ValueError):
            call()


def test_documents_as_shown(spark):
    d = spark.createDataFrame([(1, '["a","b"]', "/x", "body", 1, None), (2, "{", "/y", "", 0, True)], "id int, tags string, stored_path string, text_content string, favorite int, liked boolean")
    assert [tuple(r) for r in access.shown(d).orderBy("id").collect()] == [(1, ["a", "b"], True, False), (2, [], False, True)]


def test_retries():
    waited, calls = [], []

    def flaky(texts):
        calls.append(texts)
        if len(calls) < 3:
            raise vectors.ProviderError("busy", 429)
        return "done"

    assert vectors.retrying(flaky, sleep=waited.append)(["a"]) == "done" and waited == [5, 15]
    with pytest.raises(vectors.ProviderError):
        vectors.retrying(lambda t: (_ for _ in ()).throw(vectors.ProviderError("bad key", 401)), sleep=waited.append)(["a"])
    assert waited == [5, 15]
    with pytest.raises(TimeoutError):
        vectors.retrying(lambda t: (_ for _ in ()).throw(TimeoutError()), waits=(1, 2), sleep=waited.append)(["a"])
    assert waited == [5, 15, 1, 2]


def test_recognition_limits(spark):
    ranges = spark.createDataFrame([("a", 1, 3), ("b", 1, 9)], "path string, first int, last int")
    with pytest.raises(ValueError):
        readers.recognised_pages(ranges, lambda p, a, z: [], languages=("eng", "chi_sim"), available=("eng",))
    got = readers.recognised_pages(ranges, lambda p, a, z: [(n, f"page {n} of {p}") for n in range(a, z + 1)], most_pages=5).collect()
    assert sorted((r.path, r.page or 0) for r in got) == [("a", 1), ("a", 2), ("a", 3), ("b", 0)]


def test_ingest(spark, tmp_path):
    body = "第一章 概述\n" + "这一章介绍系统的组成部分以及它们之间的关系。" * 6
    (tmp_path / "a_教程.txt").write_text(body, "utf-8")
    (tmp_path / "b.md").write_bytes(("2.1 小节\n" + "正文内容说明了具体的处理步骤和注意事项。" * 6).encode("gb18030"))
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe\xfa" * 50)
    (tmp_path / "d.exe").write_bytes(b"MZ123")
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "same.txt").write_text(body, "utf-8")
    known = spark.createDataFrame([(7, "b.md", 3, 4, 10, "0" * 64)], "id long, filename string, owner_id long, version int, file_size long, sha256 string")
    got = ingest(spark, str(tmp_path), 3, known, layer=lambda b: ["PDF 的第一页内容也需要有足够的长度才能成为一个可以检索的片段，因此这里多写几句话来说明。"])
    report = {r.filename: r.problem for r in got["report"].collect()}
    assert sorted(k for k, v in report.items() if v is None) == sorted(["b.md", "e.pdf", *[k for k in ("a_教程.txt", "same.txt") if report[k] is None]])
    assert report["d.exe"] and report["c.txt"] == "encoding" and (report["a_教程.txt"], report["same.txt"]) == (None, "repeated")
    docs = {r.filename: r for r in got["documents"].collect()}
    assert docs["b.md"].id == 7 and docs["b.md"].version == 5 and len({d.id for d in docs.values()}) == 3 and min(d.id for n, d in docs.items() if n != "b.md") == 8
    assert all(d.status == "ready" for d in docs.values())
    chunks = got["chunks"].collect()
    assert {c.document_id for c in chunks} == {d.id for d in docs.values()} and {c.document_version for c in chunks if c.document_id == 7} == {5}
    assert got["projection"].count() == len(chunks)


def test_every_file_is_accounted_for(spark, tmp_path):
    text = lambda k: f"第{k}章 概述\n" + f"这一章的第{k}部分介绍系统的组成以及它们之间的关系。" * 6
    for name, body in (("x/notes.txt", text(1)), ("y/notes.txt", text(2)), ("y/copy.txt", text(1)), ("z/plan.md", text(3)), ("z/mine.txt", text(4)), ("z/theirs.txt", text(5)), ("z/twice.txt", text(6))):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body, "utf-8")
    sha = lambda k: hashlib.sha256(text(k).encode()).hexdigest()
    size = lambda k: len(text(k).encode())
    known = [(4, "plan.md", 3, 2, 1, "0" * 64), (5, "old.txt", 3, 6, size(4), sha(4)), (6, "theirs.txt", 8, 1, size(5), sha(5)), (7, "twice.txt", 3, 1, 1, "1" * 64), (8, "twice.txt", 3, 1, 2, "2" * 64)]
    known = spark.createDataFrame(known, "id long, filename string, owner_id long, version int, file_size long, sha256 string")
    got = ingest(spark, str(tmp_path), 3, known)
    report = {r.path.split(str(tmp_path) + "/")[1]: r for r in got["report"].collect()}
    assert len(report) == 7
    assert {k for k, r in report.items() if r.problem is None} == {"x/notes.txt", "y/notes.txt", "z/plan.md", "z/theirs.txt", "z/twice.txt"}
    assert report["y/copy.txt"].problem == "repeated" and report["y/copy.txt"].same_as.endswith("x/notes.txt")
    assert (report["z/mine.txt"].problem, report["z/mine.txt"].document_id, report["z/mine.txt"].version) == ("known", 5, 6)
    assert (report["z/plan.md"].document_id, report["z/plan.md"].version) == (4, 3)
    new = [report[k].document_id for k in ("x/notes.txt", "y/notes.txt", "z/theirs.txt", "z/twice.txt")]
    assert sorted(new) == [9, 10, 11, 12] and all(report[k].version == 1 for k in ("x/notes.txt", "y/notes.txt"))
    docs = {d.id: d for d in got["documents"].collect()}
    assert set(docs) == {4, *new} and [docs[i].filename for i in new[:2]] == ["notes.txt", "notes.txt"]
    assert {c.document_id for c in got["chunks"].collect()} == set(docs)
    other = ingest(spark, str(tmp_path), 8, known)["report"].where("problem is null")
    assert other.where("filename = 'theirs.txt'").count() == 0 and other.count() == 5


def test_files_are_identified_in_two_phases(spark, tmp_path):
    for name, body in (("a/one.txt", "same bytes"), ("b/two.txt", "same bytes"), ("c.txt", "same_bytes"), ("d.txt", "of its own length"), ("e.txt", "known!!")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    known = spark.createDataFrame([(3, 7, h("known!!")), (2, 7, h("known!!")), (1, 17, h("another of length"))], "id long, file_size long, sha256 string")
    for most in (1000, 0):  # with the lengths told to the scan, and by a join
        got = {r.path.split("/")[-1]: r for r in readers.identified(spark, str(tmp_path), known, most).collect()}
        assert got["two.txt"].same_as.endswith("a/one.txt") and got["one.txt"].same_as is None and got["c.txt"].same_as is None
        assert got["one.txt"].sha256 == h("same bytes") and got["e.txt"].known_id == 2 and got["d.txt"].known_id is None
    alone = readers.identified(spark, str(tmp_path), known.where("file_size = 7"))
    assert alone.where("filename = 'd.txt' and sha256 is null").count() == 1
    plan = readers.listed(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    scans = [x for x in alone._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan binaryFile" in x]
    assert all("EqualTo(length" in x or "content" not in x.split("Batched")[0] for x in scans) and any("content" not in x.split("Batched")[0] for x in scans)


def test_jobs(spark, tmp_path):
    tables, out = tmp_path / "tables", tmp_path / "out"
    pages = [(1, 1, f"第一章 概述\n{'这是本章的正文内容。' * 12}"), (1, 2, f"广告 http://x.com\n{'正文继续进行说明。' * 12}")]
    spark.createDataFrame(pages, "document_id long, page int, text string").write.parquet(str(tables / "pages"))
    chunks = spark.createDataFrame([(1, 1, 0, "x\n12\n第1章 y", "第9章", None, "content", 1, 1, 1)], "chunk_id long, document_id long, chunk_index long, content string, chapter string, section string, content_type string, page_start int, page_end int, document_version int")
    chunks.write.parquet(str(tables / "chunks"))
    vectors.embedded(chunks, vectors.hashing_embedder(), jobs.SPACE).where("false").write.parquet(str(tables / "vectors"))
    for job in ("reindex", "reembed", "rebuild", "audit", "repair-structure", "repair-noise"):
        jobs.main([job, str(tables), str(out / job)])
    read = lambda p: spark.read.parquet(str(out / p))
    assert read("reindex/chunks").count() == 2 and read("reindex/report").first().kept == 2 and read("reindex/cleaning").first().advertisements == 1
    assert read("reembed/vectors").count() == read("rebuild/vectors").count() == 1
    assert read("repair-structure/chunks").first().chapter == "第1章" and read("repair-noise/chunks").first().content == "x\n第1章 y"
    assert read("audit/chapters").count() == 1 and read("audit/order").where(F.lit(True)).count() == 0
