"""Summaries of captures: how many records and details came in, why a capture stopped, and its status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio


def detail_summary(details: DataFrame) -> DataFrame:
    """One row over detail captures (url, status, failure, attempts): distinct, good, failed, timeouts, retries."""
    failed = F.col("status") != "ok"
    return details.agg(
        F.count("*").alias("attempted"), F.count_distinct("url").alias("unique_urls"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(failed).alias("failed"), F.count_if(failed & (F.col("failure") == "timeout")).alias("timeouts"),
        F.coalesce(F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(0)).cast("bigint").alias("retries"), ratio(F.count_if(F.col("status") == "ok"), F.count("*")).alias("coverage"),
    )


def listing_summary(records, key: str, pages: Column, source_total: Column) -> DataFrame:
    return records.agg(F.count("*").alias("records"), F.count_distinct(key).alias("unique_keys"), F.max(pages).alias("pages"), F.max(source_total).alias("source_total_items"))


def stop_reason(records: Column, cap: Column, least: Column, page: Column, total_pages: Column, page_cap: Column) -> Column:
    """Why a paged capture ended; the first rule that holds."""
    return F.when(records >= cap, "record_cap_reached").when((page >= page_cap) & (records >= least), "min_records_reached_at_page_cap").when(page >= total_pages, "total_pages_reached").when(page >= page_cap, "page_cap_reached").otherwise("unknown")


def enough(records: Column, least: Column, fallback: Column | int = 0) -> Column:
    """Whether a capture has its minimum; without one ``fallback`` counts."""
    return records >= F.coalesce(least, fallback if isinstance(fallback, Column) else F.lit(fallback))


def run_status(capture_ok: Column, contract_ok: Column, coverage_ok: Column, run_ready: Column, source_total: Column) -> Column:
    """pass, no_inventory (an empty source is no failure) or the step that failed."""
    return (
        F.when((source_total == 0) & capture_ok, "no_inventory").when(~capture_ok, "capture_failed").when(~contract_ok, "contract_failed").when(~coverage_ok, "coverage_failed").when(run_ready, "pass").otherwise("quality_failed")
    )


def title_text(*parts: Column) -> Column:
    """A headline of the parts that are there."""
    return F.concat_ws(" ", *[F.nullif(F.trim(p.cast("string")), F.lit("")) for p in parts])


def km_text(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(c.cast("string"), F.lit(" km")))


def structured_raw(listing: Column) -> Column:
    """A source's structured listing (make, model, year, variant, price, ...) as raw card fields."""
    g = lambda n: listing[n].cast("string")
    return F.struct(
        title_text(g("model_year"), g("brand"), g("model")).alias("title"), g("price").alias("price"), km_text(listing["km"]).alias("km"), F.lower(g("fuel")).alias("fuel"), F.lower(g("transmission")).alias("transmission"),
        F.concat_ws(" | ", F.coalesce(g("variant"), F.lit("")), F.coalesce(km_text(listing["km"]), F.lit("")), F.coalesce(g("fuel"), F.lit("")), F.coalesce(g("transmission"), F.lit(""))).alias("variant_details"), g("variant").alias("variant"),
    )
