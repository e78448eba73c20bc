"""Error measures of predictions, in the two conventions the domain uses, by group and over seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ladder_metrics() -> list[Column]:
    """Fractions, from per-row errors that are already rounded (absolute_error_inr, absolute_percentage_error)."""
    e, p = F.col("absolute_error_inr").cast("double"), F.col("absolute_percentage_error")
    within = lambda x: F.bround(F.count_if(p <= x) / F.nullif(F.count(p), F.lit(0)) * 100, 2)
    return [
        F.count("*").alias("n"), F.bround(F.avg(e), 2).alias("mae"), F.bround(F.sqrt(F.avg(e * e)), 2).alias("rmse"), F.bround(F.median(e), 2).alias("median_absolute_error"), F.bround(F.avg(p), 6).alias("mape"),
        F.bround(F.median(p), 6).alias("median_absolute_percentage_error"), within(0.10).alias("within_10_pct"), within(0.20).alias("within_20_pct"),
    ]


def regression_metrics(actual: Column, predicted: Column) -> list[Column]:
    """Percentages with a denominator of at least 1; R2 is one minus the residual share of the variance."""
    error = (predicted - actual).cast("double")
    size, a = F.abs(error), actual.cast("double")
    sst = F.count(a) * F.var_pop(a)
    return [
        F.count("*").alias("n"), F.bround(F.avg(size), 4).alias("mae"), F.bround(F.sqrt(F.avg(error * error)), 4).alias("rmse"), F.bround(F.avg(size / F.greatest(F.abs(a), F.lit(1.0))) * 100, 4).alias("mape_pct"),
        F.bround(F.median(size), 4).alias("median_absolute_error"), F.bround(F.avg(error), 4).alias("mean_error"), F.bround(F.median(error), 4).alias("median_error"),
        F.bround(F.avg((error < 0).cast("double")) * 100, 4).alias("underprediction_pct"), F.bround(1 - F.sum(error * error) / F.nullif(sst, F.lit(0.0)), 4).alias("r2"),
    ]


def segment_metrics(rows: DataFrame, segments: list[str], actual: Column, predicted: Column, least_rows: int = 20) -> DataFrame:
    """Metrics of every value of every segment column that has enough rows, from one shuffle."""
    parts = rows.withColumns({"__a": actual, "__p": predicted}).select("__a", "__p", F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), F.coalesce(F.col(s).cast("string"), F.lit("unknown")).alias("value")) for s in segments])).alias("s"))
    out = parts.groupBy(F.col("s.segment").alias("segment"), F.col("s.value").alias("value")).agg(*regression_metrics(F.col("__a"), F.col("__p")))
    return out.filter(F.col("n") >= least_rows)


def error_bands(ape: Column) -> list[Column]:
    """Overlapping bands of the percentage error: up to 5, 10 and 15, and above 25 percent."""
    return [F.count("*").alias("n"), F.count_if(ape <= 5).alias("within_5"), F.count_if(ape <= 10).alias("within_10"), F.count_if(ape <= 15).alias("within_15"), F.count_if(ape > 25).alias("above_25")]


def stability(runs: DataFrame, metric: str, target: float = 10.0) -> DataFrame:
    """Spread of a metric over repeated runs, and whether it holds."""
    m = F.col(metric)
    q = lambda p: F.bround(F.percentile(metric, F.lit(p)), 4)
    out = runs.agg(F.count("*").alias("runs"), F.bround(F.avg(m), 4).alias("mean"), F.bround(F.stddev_samp(m), 4).alias("std"), F.bround(F.min(m), 4).alias("min"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), F.bround(F.max(m), 4).alias("max"), F.bround(F.avg((m <= target).cast("double")), 4).alias("hit_rate"))
    return out.withColumn("status", F.when(F.col("hit_rate") >= 0.8, "stable").when(F.col("hit_rate") >= 0.5, "mostly_stable").otherwise("unstable"))
