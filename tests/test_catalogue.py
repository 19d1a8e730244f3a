"""A sample of catalogue queries against their SQL, and the shape of plans."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check import TABLES, compare

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = ("construct_corpus", "a1_verdict_tally", "l4_extract_verdict", "p1_drop_gone", "d2_balance", "d5_split_exact",
          "n3_top_level", "s2_corpus_csv", "j1_nearest_by_edit", "j2_nearest_by_cosine", "f3_count_terms", "g1_encode",
          "r2_fillers", "r9_linear_importance", "x1_score_batches", "t7_role_spans", "r4_token_error")

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    text, good = compare(spark, con, SF_DIR, name, contract.queries()[name], contract.oracle_sql()[name])
    assert good, text


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries()) and len(contract.queries()) > 100


def test_no_plan_pairs_all_rows(spark):
    for name in ("j1_nearest_by_edit", "j2_nearest_by_cosine", "d5_split_exact", "r2_fillers", "j8_soft_align"):
        plan = contract.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_verdict_rules_run_once_per_comment(spark):
    plan = contract.queries()["a4_best_comment"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert sum("ESH" in line and "regexp_extract" in line for line in plan.splitlines()) == 1
