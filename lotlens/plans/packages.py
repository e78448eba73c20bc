"""Whole runs: a payload to layered outputs, a collection to its manifest, entities to a modelling package."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import bucket, in_test, joined_filled
from ..operators import adapters, baseline, ledger, lifecycle, metrics, profiling, quality
from ..sources import payloads, sinks

#: The modelling rows' columns in order, with what each means: the data dictionary.
MODELING_COLUMNS = {
    "listing_key": "stable listing identity", "source": "source of the latest sighting", "source_listing_id": "the source's own id", "listing_url": "page of the listing", "capture_date": "date of the latest sighting", "captured_at": "time of the latest sighting",
    "city": "city", "state": "state", "brand": "make", "model": "model family", "variant": "variant", "brand_model": "make and model", "model_year": "model year", "vehicle_age_years": "snapshot year less model year", "fuel_type": "fuel", "transmission": "gearbox",
    "km_driven": "distance in km", "km_bucket_10000": "distance, floor to 10,000", "ownership": "number of owners", "registration_code": "registration office", "listed_price_inr": "price in rupees (target)", "price_lakh": "price in lakh", "is_available": "still listed",
    "observation_count": "sightings", "first_seen_at": "first sighting", "last_seen_at": "last sighting", "listing_identity_basis": "rule behind the identity", "vehicle_fingerprint": "vehicle key across listings", "run_id": "run of the latest sighting", "baseline_split": "train or test",
}
PROTECTED = ("totals", "validation", "paths")


def run_payload(spark: SparkSession, path: str, source: str, run: adapters.Run, as_of_year: int, out: str, capture_date: str, registry: DataFrame | None = None) -> dict[str, str]:
    """Contract, canonical listings, verdicts and layers of one captured payload; fails before writing anything."""
    rows = payloads.checked_payload(spark, path, source)
    judged = quality.evaluate(adapters.canonical(rows, source, run, as_of_year), as_of_year, registry)
    raw = sinks.write_raw(rows, out, source, capture_date, run.run_id)
    return {"raw": raw} | sinks.write_layers(judged, out, capture_date, run.run_id)


def observations(silver: DataFrame) -> DataFrame:
    """Silver rows with identity and fingerprint, as sightings."""
    named = silver.withColumn("record_index", F.col("index") if "index" in silver.columns else F.monotonically_increasing_id())
    return lifecycle.with_fingerprint(lifecycle.with_identity(named))


def modeling_rows(entities: DataFrame, snapshot_year: int, seed: str = "split_v1", share: float = 0.2) -> DataFrame:
    """Flat rows of the entities with derived columns and the split."""
    have = entities.columns
    base = entities.withColumns({c: F.lit(None).cast("string") for c in MODELING_COLUMNS if c not in have and c not in ("brand_model", "vehicle_age_years", "km_bucket_10000", "price_lakh", "baseline_split")})
    out = base.withColumns({
        "brand_model": joined_filled(" ", F.col("brand"), F.col("model")), "vehicle_age_years": F.lit(snapshot_year) - F.col("model_year"), "km_bucket_10000": bucket(F.col("km_driven"), 10_000),
        "price_lakh": F.bround(F.col("listed_price_inr") / 100_000, 4),
    })
    return baseline.split_with_fallback(out, in_test(seed, share, F.col("listing_key")), share, "listing_key").select(*MODELING_COLUMNS)


def modeling_checks(rows: DataFrame, pricing_ready: int, unique_keys: int) -> DataFrame:
    need = F.lit(False)
    for c in ("source", "city", "brand", "model", "model_year", "fuel_type", "transmission", "km_driven", "listed_price_inr"):
        need = need | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    figures = rows.agg(F.count("*").alias("n"), F.count_distinct("listing_key").alias("k"), F.count_if(need).alias("gaps"), F.count_if(F.coalesce("listed_price_inr", F.lit(0)) <= 0).alias("free"))
    return ledger.checks(figures, {
        "records_do_not_exceed_snapshot_pricing_ready": F.col("n") <= pricing_ready, "records_match_lifecycle_unique_keys": F.col("n") == unique_keys, "listing_keys_are_unique": F.col("n") == F.col("k"),
        "required_modeling_fields_complete": F.col("gaps") == 0, "target_price_positive": F.col("free") == 0,
    })


def write_modeling_package(rows: DataFrame, out: str, snapshot_year: int, least_rows: int = 5) -> None:
    """Rows as CSV, JSON lines and Parquet; train and test; dictionary, profiles, medians, predictions, metrics."""
    columns = list(MODELING_COLUMNS)
    rows.write.mode("overwrite").parquet(f"{out}/rows")
    rows = rows.sparkSession.read.parquet(f"{out}/rows")
    sinks.write_csv(rows, f"{out}/rows_csv", columns)
    sinks.write_jsonl(rows, f"{out}/rows_jsonl")
    train, test = (rows.filter(F.col("baseline_split") == s) for s in ("train", "test"))
    sinks.write_csv(train, f"{out}/train_csv", columns)
    sinks.write_csv(test, f"{out}/test_csv", columns)
    rows.sparkSession.createDataFrame(list(MODELING_COLUMNS.items()), "column_name string, meaning string").write.mode("overwrite").json(f"{out}/dictionary")
    profiling.completeness(rows, columns).write.mode("overwrite").json(f"{out}/completeness")
    profiling.blind_spots(rows, snapshot_year).write.mode("overwrite").json(f"{out}/blind_spots")
    medians = baseline.group_medians(train)
    medians.write.mode("overwrite").parquet(f"{out}/medians")
    predicted = baseline.predict(test, rows.sparkSession.read.parquet(f"{out}/medians"), least_rows, "listing_key")
    predicted.write.mode("overwrite").parquet(f"{out}/predictions")
    predicted.agg(*metrics.ladder_metrics()).write.mode("overwrite").json(f"{out}/metrics")
    spark = rows.sparkSession
    summary = {k: v for k, v in profiling.dataset_summary(rows).first().asDict().items()}
    split = {r["baseline_split"]: r["count"] for r in rows.groupBy("baseline_split").count().collect()}  # two rows
    parts = ("rows", "rows_csv", "rows_jsonl", "train_csv", "test_csv", "dictionary", "completeness", "blind_spots", "medians", "predictions", "metrics", "eda_summary", "eda_report", "dataset_report")
    manifest = {"records_total": summary["n"], "columns": columns, "target": "listed_price_inr", "split": split, "snapshot_year": snapshot_year, "least_rows": least_rows, "outputs": {p: f"{out}/{p}" for p in parts}}
    sinks.write_document(spark, summary, f"{out}/eda_summary")
    tables = [sinks.markdown_table(profiling.completeness(rows, columns), "Fields", len(columns)), sinks.markdown_table(profiling.blind_spots(rows, snapshot_year), "Blind spots"), sinks.markdown_table(profiling.value_counts(rows, "brand").orderBy(F.desc("n"), "value"), "Makes")]
    sinks.write_text(spark, "\n".join([sinks.markdown_document("Modelling rows", summary), *tables]), f"{out}/eda_report")
    sinks.write_text(spark, sinks.markdown_document("Modelling package", manifest), f"{out}/dataset_report")
    sinks.write_document(spark, manifest, f"{out}/manifest")


def merged_metadata(manifest: dict, extra: dict, protected: tuple[str, ...] = PROTECTED) -> dict:
    """``manifest`` with more keys; protected ones cannot be replaced."""
    if wrong := sorted(set(extra) & set(protected)):
        raise ValueError(f"protected keys: {', '.join(wrong)}")
    return manifest | extra


def snapshot_manifest(ledger_rows: DataFrame, lifecycle_totals: dict, target: int | None = None) -> str:
    """The reconciled totals of a snapshot as JSON; raises where ledger and lifecycle disagree."""
    totals = ledger.totals(ledger_rows)
    checked = ledger.require(ledger.checks(totals, {"ledger_pricing_ready_matches_lifecycle_records": F.col("pricing_ready") == lifecycle_totals["records_total"], "ledger_listing_runs_match_lifecycle_inputs": F.col("listing_source_runs") == lifecycle_totals["source_runs"]}))
    one = totals if target is None else totals.select("*", *ledger.target_delta(F.col("pricing_ready"), F.lit(target)))
    by = {r["source"]: {k: v for k, v in r.asDict().items() if k != "source"} for r in ledger.totals_by_source(ledger_rows).collect()}  # a row for each source
    return json.dumps({"totals": one.first().asDict() | {"by_source": by}, "validation": [r.asDict() for r in checked.collect()]}, indent=2, sort_keys=True)
