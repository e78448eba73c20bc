"""Profiles of a table: value shares, completeness, exact summaries, blind spots, sanity and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import has_value
from .quality import field_profile

PERCENTILES = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def label(c: Column, missing: str = "unknown") -> Column:
    """Trimmed text, or ``missing`` where it is null or blank."""
    return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit(missing))


def value_counts(df: DataFrame, column: str, missing: str = "unknown") -> DataFrame:
    """value, n and its percentage of all rows.

    The total is a window over the counts, which are as many as there are values, not rows.
    """
    counts = df.groupBy(label(F.col(column), missing).alias("value")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))
    return counts.withColumn("share_pct", F.bround(F.col("n") / total * 100, 4))


def falsy_counts(df: DataFrame, column: str) -> DataFrame:
    """As :func:`value_counts`, but 0 and false also count as unknown and text is not trimmed."""
    c = F.col(column).cast("string")
    return df.groupBy(F.when(c.isNull() | c.isin("", "0", "0.0", "false"), "unknown").otherwise(c).alias("value")).agg(F.count("*").alias("n"))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, present, missing, completeness_pct ('unknown' counts as present)."""
    p = field_profile(df, {"all": columns}, present=has_value)
    pct = F.when(F.col("total") > 0, F.bround(F.col("present") / F.col("total") * 100, 4)).otherwise(0.0)
    return p.select("field", "present", (F.col("total") - F.col("present")).alias("missing"), pct.alias("completeness_pct"))


def summary(value: Column) -> list[Column]:
    """count, min, five exact percentiles (linear), max and mean of a numeric column."""
    exact = [F.bround(F.percentile(value, F.lit(p)), 4).alias(n) for n, p in PERCENTILES.items()]
    v = value.cast("double")
    return [F.count(value).alias("n"), F.bround(F.min(v), 4).alias("min"), *exact, F.bround(F.max(v), 4).alias("max"), F.bround(F.avg(v), 4).alias("mean")]


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row of :func:`summary` for each column, from one pass over name-value rows."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in columns])).alias("p")).select("p.*")
    return pairs.groupBy("field").agg(*summary(F.col("v")))


def grouped_summary(df: DataFrame, group: str, value: str, top: int | None = None) -> DataFrame:
    rows = df.filter(F.col(value).isNotNull()).groupBy(label(F.col(group)).alias("grp")).agg(*summary(F.col(value)))
    return rows if top is None else rows.orderBy(F.desc("n"), "grp").limit(top)


def median_prices(df: DataFrame, by: list[str], least_rows: int, top: int) -> DataFrame:
    """Typical price, distance and year of the largest groups; a null group stays one."""
    rows = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.median("listed_price_inr").alias("median_price"), F.bround(F.avg("listed_price_inr"), 2).alias("mean_price"), F.median("km_driven").alias("median_km"), F.median("model_year").alias("median_year")
    )
    return rows.filter(F.col("n") >= least_rows).orderBy(F.desc("n"), *by).limit(top)


def category_coverage(df: DataFrame, columns: list[str], rare: int = 10) -> DataFrame:
    """Per column: distinct values, how many are rare, the rows in those, and the largest group."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), label(F.col(c)).alias("value")) for c in columns])).alias("p")).select("p.*")
    counts = pairs.groupBy("field", "value").agg(F.count("*").alias("n"))
    few = F.col("n") < rare
    return counts.groupBy("field").agg(
        F.count("*").alias("distinct_values"), F.count_if(few).alias("rare_values"), F.coalesce(F.sum(F.when(few, F.col("n"))), F.lit(0)).alias("rare_rows"),
        F.max_by("value", F.struct(F.col("n"), F.col("value"))).alias("top_value"), F.max("n").alias("top_rows"),
    )


def rare_groups(df: DataFrame, by: list[str], below: int = 10) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.median("listed_price_inr").alias("median_price")).filter(F.col("n") < below)


def drift(df: DataFrame, by: str) -> DataFrame:
    """How the parts of a table differ: size, variety and typical values."""
    return df.groupBy(by).agg(
        F.count("*").alias("n"), F.count_distinct("city").alias("cities"), F.count_distinct("brand", "model").alias("brand_models"), F.median("listed_price_inr").alias("median_price"),
        F.median("km_driven").alias("median_km"), F.median("model_year").alias("median_year"),
    )


def blind_spots(df: DataFrame, snapshot_year: int) -> DataFrame:
    """Findings that bias a price study, with the figure that shows each: (finding, severity, figure, raised)."""
    share = lambda c: value_counts(df, c).agg(F.max("share_pct").alias("x")).select(F.lit(c).alias("k"), F.coalesce("x", F.lit(0.0)).alias("x"))
    thin = df.groupBy("brand", "model").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") < 5, F.col("n"))), F.lit(0)).cast("double").alias("x")).select(F.lit("thin").alias("k"), "x")
    missing = completeness(df, ["ownership", "variant", "registration_code"]).select(F.col("field").alias("k"), F.col("missing").cast("double").alias("x"))
    counts = df.agg(F.count_if(F.lit(snapshot_year) < F.col("model_year")).alias("future"), F.count_if(F.col("km_driven") > 300_000).alias("km"), F.count_if(F.col("listed_price_inr") > 10_000_000).alias("price"))
    extremes = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("double").alias("x")) for k in ("future", "km", "price")])).alias("e")).select("e.*")
    rules = {"source": ("source_imbalance", 60.0), "city": ("city_concentration", 20.0), "thin": ("thin_groups", 0.0), "future": ("future_model_year", 0.0), "km": ("extreme_km", 0.0), "price": ("extreme_price", 0.0)}
    rules |= {c: (f"missing_{c}", 0.0) for c in ("ownership", "variant", "registration_code")}
    facts = share("source").unionByName(share("city")).unionByName(thin).unionByName(missing).unionByName(extremes)
    name = F.create_map(*[F.lit(v) for k, (n, _) in rules.items() for v in (k, n)])[F.col("k")]
    limit = F.create_map(*[F.lit(v) for k, (_, x) in rules.items() for v in (k, x)])[F.col("k")]
    return facts.select(name.alias("finding"), F.when(F.col("k") == "future", "blocking").otherwise("warning").alias("severity"), F.bround("x", 4).alias("figure"), (F.col("x") > limit).alias("raised"))


def sanity(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """How many rows violate each test: (check_name, violations, status)."""
    one = df.agg(*[F.count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("violations")) for n in tests])).alias("r")).select("r.*")
    return rows.withColumn("status", F.when(F.col("violations") == 0, "pass").otherwise("review"))


def range_tests(snapshot_year: int) -> dict[str, Column]:
    price, km, year, owners = (F.col(c) for c in ("listed_price_inr", "km_driven", "model_year", "ownership"))
    return {
        "price_not_positive": F.coalesce(price, F.lit(0)) <= 0, "price_below_50k": price < 50_000, "price_above_3m": price > 3_000_000, "km_negative": km < 0, "km_above_300k": km > 300_000,
        "year_before_2000": year < 2000, "year_after_snapshot": year > snapshot_year, "age_negative": (F.lit(snapshot_year) - year) < 0, "owners_outside_1_5": ~owners.between(1, 5),
    }


def edge_prices(df: DataFrame) -> DataFrame:
    return df.filter((F.col("listed_price_inr") < 50_000) | (F.col("listed_price_inr") > 3_000_000))


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: size, variety and exact price quantiles."""
    q = lambda p: F.bround(F.percentile("listed_price_inr", F.lit(p)), 4)
    return df.agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.count_distinct("city").alias("cities"), F.count_distinct("brand").alias("brands"), F.count_distinct("brand", "model").alias("brand_models"), q(0.01).alias("price_p01"), q(0.5).alias("price_p50"), q(0.99).alias("price_p99"))


def side_by_side(figures: DataFrame, by: str, columns: list[str], values: list[str]) -> DataFrame:
    """A row for each figure with one column for each stated value of ``by`` (a row of ``figures`` each)."""
    long = figures.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in columns])).alias("m")).select(by, "m.metric", "m.v")
    return long.groupBy("metric").pivot(by, values).agg(F.max("v"))


def described(importances: DataFrame, metadata: DataFrame) -> DataFrame:
    """Feature importances (some dozens of rows) with what is known of each feature, and their place in order."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.orderBy(F.desc("importance"), "feature"))
    return importances.join(metadata, "feature", "left").withColumn("kind", F.coalesce("kind", F.lit("unknown"))).withColumn("place", place)


def flattened(df: DataFrame, key: str, column: str, depth: int = 4) -> DataFrame:
    """(key, path, value): every leaf of a JSON object under its dotted path; arrays, and objects below ``depth``, as JSON.

    Text that is no JSON object has no leaves; a null leaf is kept with a null value.
    """
    spark, out = df.sparkSession, None
    level = df.select(F.col(key).alias("key"), F.lit(None).cast("string").alias("path"), F.expr(f"try_parse_json(`{column}`)").alias("v"))
    for left in range(depth, 0, -1):
        inside = level.filter("schema_of_variant(v) LIKE 'OBJECT%'")
        parts = spark.sql("SELECT t.key, concat_ws('.', t.path, e.key) AS path, e.value AS v FROM {inside} t, LATERAL variant_explode(t.v) e", inside=inside)
        kind = F.expr("schema_of_variant(v)")
        nested = kind.startswith("OBJECT")
        shown = F.when(nested | kind.startswith("ARRAY"), F.to_json("v")).otherwise(F.expr("CAST(v AS STRING)"))
        leaves = (parts if left == 1 else parts.filter(~nested)).select(F.col("key").alias(key), "path", shown.alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        level = parts.filter(nested)
    return out
