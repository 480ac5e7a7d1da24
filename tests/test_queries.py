"""Registered queries against their SQL on the smallest tables.

All of them run with ALL_QUERIES=1; a cross-section runs by default.
"""

import os
from pathlib import Path

import pytest
from check_oracles import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
USUAL = (
    "cq_sanctioned_accounts cq_duplicate_parties path_closure evidence_coordinates mapping_states order_by_limited "
    "resolve_lexical concept_mappings materialize shape_class shape_minCount csv_source jsonl_source nquads_round_trip "
    "append_only_sink quarantine canonical_json set_digest utc_checks connector_violations column_stats key_columns "
    "catalog_references proposal_errors gate_results approval_decision drift_proposals ledger_violations golden_compare "
    "publication_gate last_valid build_rollback rollback_round_trip record_decisions review_queue pattern_optional not_exists "
    "values_product optional_unbound shape_languages validate lease_state stream_heads stream_executions register_questions"
).split()
assert set(USUAL) <= set(ORACLES)
NAMES = sorted(ORACLES) if os.environ.get("ALL_QUERIES") else USUAL

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    cursor = duck.execute(ORACLES[name])
    assert compare(df.columns, rows, [d[0] for d in cursor.description], cursor.fetchall()) == ""


def test_entry(spark):
    assert entry.entry(spark).columns == ["sanction", "party", "entity", "account"]


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
