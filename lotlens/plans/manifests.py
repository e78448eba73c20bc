"""Manifests of runs as a table: a row for each run with its counts, and the rules for its status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("listing_records", "quality_records", "pricing_ready", "quarantined", "detail_requested", "detail_attempted", "detail_successful", "detail_failed")


def _count(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("bigint")


def plain_status() -> Column:
    """pass where the run said so."""
    return F.when(F.coalesce(F.col("ok"), F.lit(False)), "pass").otherwise("fail")


def incremental_status() -> Column:
    """pass for a listing run with details in which every listing was found, covered, priced and none failed."""
    listed = _count("listing_records")
    good = (listed > 0) & F.coalesce(F.col("coverage_ok"), F.lit(True)) & (_count("quality_records") == listed) & (_count("pricing_ready") == listed)
    return F.when(good & (_count("quarantined") == 0) & (_count("detail_failed") == 0), "pass").otherwise("fail")


def run_manifests(runs: DataFrame) -> DataFrame:
    """Identity, status and record counts of each run; ``kind`` is incremental or anything else."""
    status = F.when(F.col("kind") == "incremental", incremental_status()).otherwise(plain_status())
    text = lambda name: F.coalesce(F.col(name), F.lit("unknown")).alias(name)
    seconds = F.bround(F.col("duration_seconds"), 3).alias("duration_seconds")
    return runs.select(text("source"), text("run_id"), "kind", status.alias("status"), seconds, *[_count(c).alias(c) for c in COUNTS])


def failed_capture(runs: DataFrame, error: Column) -> DataFrame:
    """The rows that stand for captures that broke off: all counts zero, the error said."""
    return runs.select("source", "run_id", *[F.lit(0).cast("bigint").alias(c) for c in COUNTS], F.lit(False).alias("ok"), error.alias("error"))
