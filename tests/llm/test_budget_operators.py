"""Packing, mixing and the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm.op4_packing import default_vocabulary, encoder, fullest, pack_documents, packing_plan
from quillspark.llm.op5_mixing import fill, mix, mixed

from .helpers import documents


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def test_encoder_gives_the_ids_of_the_tokenizer(library, prose):
    rnd = random.Random(0)
    odd = ["<|endoftext|>", "a<|endoftext|>b", "\x00\x01", "é́ñ", "漢字かな", "🙂👍🏽", "  \n\t  x", "​﻿", "it's I'LL", "１２３ ٣", "a b", "\r\n\r\n", "x" * 5000]
    odd += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 1000), rnd.randrange(0x3000, 0x9FFF), rnd.randrange(0x1F300, 0x1F600)])) for _ in range(60)) for _ in range(300)]
    texts = [t for t in prose if t] + odd
    space = ["a" + " " * 20000, " " * 20000 + "b", "\n" * 15000 + "\u3000" * 9000 + "é", "x" + "\t" * 12000 + "\n's", " " * 30000 + "<|endoftext|>" + " " * 11000 + "<|endoftext", "\x1c" * 12000, " " * 12000 + "\x1c"]
    texts += space
    ours = encoder(default_vocabulary(), added=True)
    for t, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ours(t) == want.ids


def test_added_tokens_have_the_ids_of_the_library_at_its_defaults(spark):
    from tokenizers import Tokenizer

    default = Tokenizer.from_file(default_vocabulary())
    texts = ["a<|endoftext|>b", "<|endoftext|>", "  <|endoftext|> \n x", "<|endoftext|><|endoftext|>", "<|endoftext|", "é <|endoftext|>'s", "<|im_start|>x"]
    assert default.encode(texts[0], add_special_tokens=False).ids == [64, 50256, 65]
    got = {r.doc_id: (r.length, r.ids_crc32) for r in pack_documents(documents(spark, texts)).collect()}
    want = [[*default.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert got == {i: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in enumerate(want)}


def test_very_long_white_space(spark, library):
    texts = [" " * 5_000_000, "a" + "\n" * 1_200_000 + "b", "z" * 1_000_000]
    got = {}
    for r in pack_documents(documents(spark, texts)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_pieces_and_places(spark, library, prose):
    texts = [*prose, *prose[:20]]
    docs = documents(spark, texts).unionByName(documents(spark, ["z"]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = pack_documents(docs, capacity=256).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in [*enumerate(texts), (None, "z")]:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        got = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got))) and len(got) == -(-len(ids) // 256)
        assert all(r.length == 256 for r in got[1:])
        at = 0
        for r in got:
            part = np.array(ids[at : at + r.length], "<u4")
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(part.tobytes()))
            at += r.length
        assert at == len(ids)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 256
    assert len(seqs) <= 1.01 * sum(r.length for r in rows) / 256 + 1
    assert pack_documents(documents(spark, [])).count() == 0


def test_fullest_against_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        capacity = rnd.randint(5, 30)
        counts = dict(Counter(rnd.randint(1, capacity) for _ in range(rnd.randint(1, 8))))
        used = dict(fullest(counts, capacity))
        first = max(counts)
        rest = [x for x, n in counts.items() for _ in range(n - (x == first))]
        best = max(s for m in range(1 << len(rest)) if (s := sum(x for k, x in enumerate(rest) if m >> k & 1)) <= capacity - first)
        assert sum(x * n for x, n in used.items()) == first + best
        assert all(n <= counts[x] for x, n in used.items())


def test_plan_places_every_piece_once():
    rnd = random.Random(4)
    histogram = Counter(min(2048, int(rnd.expovariate(1 / 500)) + 1) for _ in range(50000))
    plan = packing_plan(histogram, 2048)
    for length, n in histogram.items():
        spans = sorted((a, b) for x, a, b, *_ in plan.tolist() if x == length)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    bins = max(b + (e - a) // m for _, a, e, m, b, _ in plan.tolist())
    assert bins <= -(-sum(x * n for x, n in histogram.items()) // 2048) + 2


# ---- mixing ------------------------------------------------------------------------


def test_fill_reaches_what_can_be_reached():
    rnd = random.Random(5)
    for _ in range(300):
        lengths = sorted(rnd.sample(range(0, 12), rnd.randint(1, 5)))
        counts = [rnd.randint(1, 3) for _ in lengths]
        total = sum(a * b for a, b in zip(lengths, counts))
        budget = rnd.randint(0, total)
        take = fill(lengths, counts, budget, total, 1 << 16)
        got = sum(a * b for a, b in zip(take, lengths))
        assert all(0 <= t <= c for t, c in zip(take, counts)) and got <= budget
    lengths, counts = list(range(1, 400, 3)), [5] * 133
    total = 5 * sum(lengths)
    for budget in (12345, total // 2, total - 7):
        for dp_words in (1 << 16, 500):
            assert sum(a * b for a, b in zip(fill(lengths, counts, budget, total, dp_words), lengths)) == budget


def plain_targets(sizes, share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, out, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = budget / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        out |= {s: most * sizes[s] for s in over}
        budget -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


def test_mix(spark, prose):
    texts = [t for t in prose if len(t or "") < 10000] * 3
    docs = documents(spark, texts)
    rows = mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, size(t)) for i, t in enumerate(texts))
    sizes = Counter()
    for i, t in enumerate(texts):
        sizes[f"src{i % 3}" if i % 7 else None] += size(t)
    want = plain_targets(sizes)
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.repeats * r.size and 0 <= r.repeats <= 2
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 2 for s in sizes)
    again = mix(docs.repartition(3)).collect()
    assert Counter((r.doc_id, r.taken) for r in rows) == Counter((r.doc_id, r.taken) for r in again)
    out = mixed(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.repeats for r in rows if r.repeats})
    assert mix(documents(spark, [])).count() == 0
    assert mix(documents(spark, [None, ""])).count() == 2


def test_pipeline(spark):
    """Each stage by its own brute-force rule over the smallest tables."""
    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    stages = [f for _, f in corpus_pipeline.STAGES]
    kept = stages[0](spark, docs, sf)
    assert kept.columns == docs.columns
    one = {r.doc_id: r.text for r in kept.collect()}
    assert all(one[d] == before[d] for d in one) and all(d in one for d, q in labels.items() if q == 1)
    two = {r.doc_id: r.text for r in stages[1](spark, kept, sf).collect()}
    latest = {}
    for d, t in one.items():
        latest[t] = max(d, latest.get(t, d))
    assert two == {d: t for t, d in latest.items()}
    from .test_exact_and_near import brute_join

    frame = stages[1](spark, kept, sf)
    order = sorted(two)
    _, component = brute_join([two[d] for d in order])
    three = sorted(r.doc_id for r in stages[2](spark, frame, sf).collect())
    assert three == sorted(order[i] for i, c in component.items() if i == c)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} <= set(three) and rows


def test_pipeline_stages_on_empty_tables_nulls_and_clashing_columns(spark, tmp_path):
    texts = [None, "", "one two three four five six", "one two three four five six", "x" * 5000, None]
    docs = documents(spark, texts)
    odd = docs.unionByName(documents(spark, ["no id", "no id"]).withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.withColumns({"__rn": F.lit(1), "id": F.lit("clash"), "size": F.lit(2), "sequence_id": F.lit(3), "score": F.lit(None).cast("double")})
    spark.createDataFrame([(2, 1, 0), (4, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for start in (odd, odd.where("false")):
        frame, n = start, start.count()
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            frame = stage(spark, frame, str(tmp_path))
            assert k == 4 or frame.columns == start.columns
        rows = frame.collect()
        assert bool(rows) == bool(n)
        assert {r.doc_id for r in rows} <= {0, 1, 2, 3, 4, 5, None}
