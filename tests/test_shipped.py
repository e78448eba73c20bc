"""Queries with large plans as they run in production: with generated code, adaptive plans and several partitions."""

import pytest

from lotlens.plans import cases, catalogue, more  # noqa: F401  (cases and more register their queries)

from .oracle import connect, differences

SF = "/root/testdata/sf0.001"
NAMES = (
    "listing_entities", "listing_identity", "relisted_totals_by_source", "snapshot_diff_status", "complete_quality_flags", "parse_title", "registration_examples", "title_examples",
    "ladder_prediction", "confidence_interval_rules", "target_encoding_smoothed", "oof_target_encoding", "external_canonical", "combined_rows", "flattened_extra_fields",
)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_as_shipped(spark, con, name):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true" and spark.conf.get("spark.sql.codegen.wholeStage") == "true"
    assert not differences(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLE_SQL[name])
