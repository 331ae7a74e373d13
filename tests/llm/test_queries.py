import os

import duckdb
import pytest

from filigrane.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash": ["doc_id", "fingerprint", "component_id"],
    "op2_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op3_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"],
    "op4_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op5_decontam": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_wrapper": ["page_id", "url", "text", "n_chars"],
    "op8_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op9_suffix": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op10_quality": ["doc_id", "held_out", "score", "predicted"],
}


def test_every_operator_is_registered():
    assert set(queries.queries()) == {*COLUMNS, "pipeline", "secrets_base", "pii_base"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_for_each_input_row(spark, name):
    table = "pages" if name.startswith("op7") else "documents"
    got = queries.queries()[name](spark, SF)
    assert got.columns == COLUMNS[name]
    assert got.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want))
