"""The registered queries: names, contract columns, and equality with their SQL."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from compare import difference
from swayline.llm.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op2_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op3_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op4_language_id": "doc_id held_out lang_pred score",
    "op5_decontaminate": "doc_id item_id distance",
    "op6_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op7_lm_score": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op8_minhash": "doc_id n_shingles component_id kept",
    "op9_fingerprint": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op10_license_scan": "doc_id license score",
    "op11_spelling_variants": "word form root n n_near form_n",
    "op12_vector_dedup": "vec_id n_links component_id kept",
    "op13_conversation_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
}


def test_all_are_registered():
    assert set(COLUMNS) == set(QUERIES) and set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    out = QUERIES[name](spark, SF)
    assert out.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    if name not in SQL:
        assert out.count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert difference(QUERIES[name](spark, SF), con, SQL[name]) == ""


def test_model_beats_its_base_on_held_out_documents(spark):
    rows = QUERIES["op7_lm_score"](spark, SF).where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert rows.s > rows.b
