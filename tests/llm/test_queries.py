"""The registered queries over the smallest tables, and their SQL."""

import duckdb
import pytest

import __spark_entry__
from quillspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) <= names and "pipeline" in names
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([dict(zip(names, r))[c] for c in columns]) for r in cursor.fetchall())


def test_contracts_without_sql(spark):
    columns = {
        "op3_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
        "op4_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
        "op5_source_mixing": {"doc_id", "size", "source_size", "target", "taken"},
        "op8_lm_score": {"doc_id", "n_tokens", "log_prob"},
        "op9_html_extraction": {"page_id", "url", "text", "n_chars"},
        "op10_quality_classifier": {"doc_id", "held_out", "score", "predicted"},
    }
    for name, wanted in columns.items():
        got = QUERIES[name](spark, SF)
        table = "pages" if name == "op9_html_extraction" else "documents"
        assert wanted <= set(got.columns)
        assert got.count() >= spark.read.parquet(f"{SF}/{table}.parquet").count()
