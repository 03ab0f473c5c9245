"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import small_batches, table
from quillspark.llm.op1_exact_dedup import exact_dedup
from quillspark.llm.op2_embedding_dedup import near_duplicates
from quillspark.llm.op3_secrets import scan
from quillspark.llm.op4_packing import pack_documents
from quillspark.llm.op5_mixing import mix
from quillspark.llm.op6_jaccard_join import jaccard_join
from quillspark.llm.op7_licenses import scan_licenses, scan_licenses_sql
from quillspark.llm.op8_lm_score import lm_score
from quillspark.llm.op9_html import extract
from quillspark.llm.op10_quality import quality
from quillspark.llm.op11_collocations import collocations
from quillspark.llm.op12_substrings import substring_dedup
from quillspark.llm.op13_merkle import audited


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(small_batches(spark), sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(small_batches(spark), sf_dir, "embeddings"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(small_batches(spark), sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(small_batches(spark), sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(small_batches(spark), sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(small_batches(spark), sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(small_batches(spark), sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(small_batches(spark), sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(small_batches(spark), sf_dir, "pages"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(small_batches(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(small_batches(spark), sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(small_batches(spark), sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_embedding_near_dedup, op3_secret_scan, op4_best_fit_packing, op5_source_mixing, op6_ngram_jaccard_join, op7_license_scan, op8_lm_score, op9_html_extraction, op10_quality_classifier, op11_phrase_collocations, op12_substring_dedup, op13_merkle_manifest)}

ORACLES: dict[str, str] = {
    "op11_phrase_collocations": """
        WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
        n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
        g AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m),
        f AS (SELECT lang, m, w[i:i + m - 1] AS words, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
        cut AS (
            SELECT c.lang, c.m, c.words, c.a, k, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * c.a * n.n // (l.a::HUGEINT * r.a)) AS score
            FROM f c, (SELECT unnest(range(1, 5)) AS k) k, f l, f r, n
            WHERE c.m > k.k AND l.lang = c.lang AND l.m = k AND l.words = c.words[1:k] AND r.lang = c.lang AND r.m = c.m - k AND r.words = c.words[k + 1:] AND n.lang = c.lang),
        low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
        inner_ AS (SELECT DISTINCT lang, words[i:i + m - 1] AS words, a FROM (SELECT lang, words, a, m2 AS m, unnest(range(1, f.m - m2 + 2)) AS i FROM f, (SELECT unnest(range(2, 5)) AS m2) WHERE f.m > m2)),
        kept AS (SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM inner_ x WHERE x.lang = low.lang AND x.words = low.words AND 100 * x.a >= 100 * low.a))
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank, array_to_string(words, ' ') AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
        FROM kept QUALIFY rank <= 2000
    """,
    "op12_substring_dedup": """
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w)),
        hit AS (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY h) > 1),
        gone AS (SELECT DISTINCT doc_id, i + unnest(range(35)) AS i FROM hit),
        word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
        kept AS (SELECT d.doc_id, string_agg(d.x, ' ' ORDER BY d.i) AS t, count(*) AS n FROM word d ANTI JOIN gone g ON d.doc_id = g.doc_id AND d.i = g.i GROUP BY d.doc_id)
        SELECT w.doc_id, len(w.w)::BIGINT AS n_words, len(w.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
    """,
    "op13_merkle_manifest": """
        WITH RECURSIVE
        f AS (
            SELECT doc_id, coalesce('=' || source, '') AS t, text,
                   concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
                          CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
                          CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
                          CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head,
                   list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                               lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)) AS crc
            FROM documents),
        g AS (SELECT *, CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS shown FROM f),
        l AS (SELECT doc_id, t, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
                     sha256(head || CASE WHEN shown IS NULL THEN '-' ELSE strlen(shown) || ':' || shown END) AS shown FROM g),
        p AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY t) AS m FROM l),
        node AS (
            SELECT t, 0 AS level, pos, leaf AS h, m FROM p
            UNION ALL
            SELECT t, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (m + 15) // 16 FROM node WHERE m > 1 GROUP BY t, level, pos // 16, m),
        sub AS (SELECT t, h, row_number() OVER (ORDER BY t) - 1 AS pos, count(*) OVER () AS m FROM node WHERE m = 1),
        top AS (
            SELECT 0 AS level, pos, h, m FROM sub
            UNION ALL
            SELECT level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (m + 15) // 16 FROM top WHERE m > 1 GROUP BY level, pos // 16, m),
        step AS (
            SELECT p.doc_id, n.level AS k, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos < p.pos // (16::BIGINT ** n.level)::BIGINT), '') AS a,
                   coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos > p.pos // (16::BIGINT ** n.level)::BIGINT), '') AS b
            FROM p JOIN node n ON n.t = p.t AND n.m > 1 AND n.pos // 16 = p.pos // (16::BIGINT ** (n.level + 1))::BIGINT GROUP BY p.doc_id, p.pos, n.level
            UNION ALL
            SELECT p.doc_id, 1000 + n.level, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos < s.pos // (16::BIGINT ** n.level)::BIGINT), ''),
                   coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos > s.pos // (16::BIGINT ** n.level)::BIGINT), '')
            FROM p JOIN sub s ON s.t = p.t JOIN top n ON n.m > 1 AND n.pos // 16 = s.pos // (16::BIGINT ** (n.level + 1))::BIGINT GROUP BY p.doc_id, s.pos, n.level),
        proof AS (SELECT doc_id, sha256(string_agg(a || b, '' ORDER BY k)) AS proof_sha256, list(struct_pack(a := a, b := b) ORDER BY k) AS steps FROM step GROUP BY doc_id),
        fold AS (
            SELECT p.doc_id, 1 AS i, p.shown AS h, coalesce(q.steps, []) AS steps FROM p LEFT JOIN proof q ON p.doc_id = q.doc_id
            UNION ALL
            SELECT doc_id, i + 1, sha256(steps[i].a || h || steps[i].b), steps FROM fold WHERE i <= len(steps))
        SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
        FROM p JOIN sub s ON s.t = p.t JOIN top r ON r.m = 1 LEFT JOIN proof q ON q.doc_id = p.doc_id JOIN fold f ON f.doc_id = p.doc_id AND f.i = len(f.steps) + 1
    """,
    "op6_ngram_jaccard_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                  ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
        t AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM l),
        link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.s = b.s AND a.doc_id <> b.doc_id
                 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
        SELECT l.doc_id, len(l.s) AS n_shingles, min(r.b) AS component_id FROM l JOIN reach r ON r.a = l.doc_id GROUP BY l.doc_id, l.s
    """,
    "op2_embedding_near_dedup": """
        WITH RECURSIVE fit AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                 WHERE list_inner_product(a.e, b.e) / (a.l * b.l) >= 0.93::DOUBLE),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
        SELECT e.vec_id, (SELECT count(*) FROM link WHERE a = e.vec_id) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
        FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id
    """,
    "op7_license_scan": scan_licenses_sql(),
    "op1_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER g AS keep_id,
               count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
}
