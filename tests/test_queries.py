"""Registered queries: SQL counterparts give the same rows; the others have checked shapes."""

import os

import pytest

import __spark_entry__ as entry
from compare import difference, oracle_connection
from swayline.plans.catalog import QUERIES
from swayline.plans import model_sql, oracle

SF = "/root/testdata/sf0.001"
SQL = oracle.SQL | model_sql.SQL
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables not present")

ITERATIVE = {
    "glmm_sensitivity", "sensitivity_top3", "glmm_mvp", "mvp_top3", "glmm_entity", "glmm_group_fe", "glmm_group_fe_recent",
    "glmm_entity_recent", "group_relative_effects", "plot_baseline_slope", "glmm_crossed_raw", "glmm_crossed_centred", "glmm_crossed_z",
    "glmm_nested", "model_diagnostics", "model_summary", "plot_model_slopes", "plot_model_top3", "boot_slopes", "predict_grid",
}


def test_every_query_has_sql_or_is_iterative():
    assert set(QUERIES) - set(SQL) == ITERATIVE
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    con = oracle_connection(SF)
    assert difference(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == ""


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["group_name", "entity", "slope", "total_slope"]
    assert rows.count() > 0
