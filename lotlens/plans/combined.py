"""Live and external rows as one modelling table with their lineage, its checks, and the package written from it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import in_test
from ..operators import baseline, ledger, metrics
from ..sources import documents, sinks

#: The combined rows' columns in order.
COLUMNS = ("listing_key", "dataset_origin", "market_snapshot_year", "source", "city", "brand", "model", "variant", "model_year", "fuel_type", "transmission", "ownership", "km_driven", "registration_code", "listed_price_inr")
REQUIRED = ("source", "city", "brand", "model", "model_year", "fuel_type", "transmission", "km_driven")
PREDICTED = ("listing_key", "dataset_origin", "source", "city", "brand", "model", "model_year", "fuel_type", "transmission", "ownership", "km_driven")
METRICS = ("mae", "rmse", "median_absolute_error", "mape", "within_20_pct")


def combined(live: DataFrame, external: DataFrame, live_year: int, external_year: int) -> DataFrame:
    """Both tables with dataset_origin and market_snapshot_year; keys are told apart by origin."""

    def side(rows: DataFrame, origin: str, year: int) -> DataFrame:
        named = rows.withColumns({"listing_key": F.concat(F.lit(f"{origin}_"), F.col("listing_key")), "dataset_origin": F.lit(origin), "market_snapshot_year": F.lit(year)})
        return named.select(*[F.col(c) if c in named.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS])

    return side(live, "live", live_year).unionByName(side(external, "external", external_year))


def validation(rows: DataFrame) -> DataFrame:
    """(check_name, status): rows there, unique keys, known origins, complete required columns, positive prices."""
    gaps = F.lit(False)
    for c in REQUIRED:
        gaps = gaps | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    figures = rows.agg(F.count("*").alias("n"), F.count_distinct("listing_key").alias("keys"), F.count_if(~F.col("dataset_origin").isin("live", "external")).alias("strange"), F.count_if(gaps).alias("gaps"), F.count_if(F.coalesce("listed_price_inr", F.lit(0)) <= 0).alias("free"))
    return ledger.checks(figures, {"rows_present": F.col("n") > 0, "listing_keys_are_unique": F.col("n") == F.col("keys"), "origins_known": F.col("strange") == 0, "required_complete": F.col("gaps") == 0, "price_positive": F.col("free") == 0})


def ladder(rows: DataFrame, seed: str, share: float, least_rows: int) -> DataFrame:
    """Predictions of the comparable-median ladder for the rows put aside, with their lineage."""
    test = in_test(seed, share, F.col("listing_key"))
    found = baseline.predict(rows.filter(test), baseline.group_medians(rows.filter(~test)), least_rows, "listing_key")
    lineage = rows.filter(test).select(*PREDICTED)
    return lineage.join(found, "listing_key")


def counted(rows: DataFrame, column: str) -> dict[str, int]:
    """Rows of each value of a lineage column (a few values)."""
    return {str(r[column]): r["count"] for r in rows.groupBy(column).count().orderBy(column).collect()}


def candidate(spark: SparkSession, name: str, path: str, rows: int, figures: dict | None = None) -> dict:
    """One entry of the registry; its figures are read beside the dataset where they are not given, and may be missing."""
    figures = documents.optional_object(spark, f"{path.rsplit('/', 1)[0]}/metrics.json") if figures is None else figures
    return {"id": name, "rows": rows, "dataset_path": path, "metrics": {m: figures.get(m) for m in METRICS}}


def write_package(live: DataFrame, external: DataFrame, out: str, years: tuple[int, int], paths: tuple[str, str], seed: str = "split_v1", share: float = 0.2, least_rows: int = 5) -> dict:
    """Rows as CSV and JSON lines, predictions, metrics, manifest and registry; returns the manifest. Failing checks write nothing."""
    spark = live.sparkSession
    rows = combined(live, external, *years)
    checked = ledger.require(validation(rows))
    rows.write.mode("overwrite").parquet(f"{out}/rows")
    rows = spark.read.parquet(f"{out}/rows")
    sinks.write_csv(rows, f"{out}/rows_csv", list(COLUMNS))
    sinks.write_jsonl(rows, f"{out}/rows_jsonl")
    ladder(rows, seed, share, least_rows).write.mode("overwrite").parquet(f"{out}/predictions")
    predicted = spark.read.parquet(f"{out}/predictions")
    sinks.write_csv(predicted, f"{out}/predictions_csv", predicted.columns)
    figures = predicted.agg(*metrics.ladder_metrics()).first().asDict()
    counts = {c: counted(rows, c) for c in ("dataset_origin", "source", "market_snapshot_year")}
    n = sum(counts["dataset_origin"].values())
    split = {"seed": seed, "share": share, "test_rows": predicted.count(), "least_rows": least_rows}
    manifest = {"records_total": n, "columns": list(COLUMNS), "target": "listed_price_inr", "inputs": dict(zip(("live", "external"), paths)), "counts": counts, "split": split, "validation": {r["check_name"]: r["status"] for r in checked.collect()}}
    origin = counts["dataset_origin"]
    entries = [candidate(spark, "live", paths[0], origin.get("live", 0)), candidate(spark, "external", paths[1], origin.get("external", 0)), candidate(spark, "combined", f"{out}/rows", n, figures)]
    registry = {"candidates": entries, "combined": {"records_total": n, "validation": manifest["validation"]}}
    for name, document in (("manifest", manifest), ("metrics", figures), ("registry", registry)):
        sinks.write_document(spark, document, f"{out}/{name}")
        sinks.write_text(spark, sinks.markdown_document(name, document), f"{out}/{name}_md")
    return manifest | {"registry": json.loads(json.dumps(registry))}
