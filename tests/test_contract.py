import sys
from pathlib import Path

import pytest

from conftest import SF

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402

# One query per area; tools/compare.py runs all of them.
CHECKED = [
    "scan_pages", "scan_years_capped", "scan_registry", "enrich_suppliers", "dedup_first", "validate_commitments",
    "flatten_state_dimensions", "mask_document", "weighted_degree_agencies", "project_via", "entropy_per_edge",
    "robust_stats", "label_propagation", "outliers_suppliers", "isolated_communities", "node_risk", "daily_counts",
    "load_counters", "snapshot_xml", "stream_ingest", "batch_fingerprint", "graph_summary", "label_propagation_full", "slugify",
]


def test_every_sql_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


@pytest.fixture(scope="module")
def connection():
    return compare.duck(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_its_sql(spark, connection, name):
    assert compare.compare(spark, connection, name, SF).startswith("ok")


def test_entry(spark):
    assert entry.entry(spark).count() == 8
