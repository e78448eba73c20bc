"""Comparable-median prices: seven nested groupings, a prediction from the narrowest that is large enough.

The medians of all groupings come from one pass with GROUPING SETS. A test row looks up its candidates
with one equi-join on (level, key), because each row is turned into its at most seven keys; the narrowest
hit wins by ``min_by``. Levels whose keys are missing or blank take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = (
    ("city_brand_model_year_fuel_transmission_ownership", ("city", "brand", "model", "model_year", "fuel_type", "transmission", "ownership")),
    ("brand_model_year_fuel_transmission_ownership", ("brand", "model", "model_year", "fuel_type", "transmission", "ownership")),
    ("brand_model_year_fuel_transmission", ("brand", "model", "model_year", "fuel_type", "transmission")),
    ("brand_model_fuel_transmission", ("brand", "model", "fuel_type", "transmission")),
    ("brand_model", ("brand", "model")),
    ("brand", ("brand",)),
    ("global", ()),
)


def feature(name: str) -> Column:
    """A key part: trimmed lower case; blank becomes null."""
    return F.nullif(F.lower(F.trim(F.col(name).cast("string"))), F.lit(""))


def level_keys() -> Column:
    """array<struct<level int, name, key>> of a row's usable levels, narrowest first."""
    rows = []
    for i, (name, parts) in enumerate(LEVELS):
        whole = F.lit(True)
        for p in parts:
            whole = whole & feature(p).isNotNull()
        key = F.concat_ws("|", *[feature(p) for p in parts]) if parts else F.lit("")
        rows.append(F.when(whole, F.struct(F.lit(i).alias("level"), F.lit(name).alias("level_name"), key.alias("key"))))
    return F.array_compact(F.array(*rows))


def group_medians(train: DataFrame, price: str = "listed_price_inr") -> DataFrame:
    """level, level_name, key, median_price (whole, half to even) and n of each group of each level."""
    names = list(LEVELS[0][1])
    keyed = train.select(*[feature(n).alias(n) for n in names], F.coalesce(F.col(price), F.lit(0)).cast("bigint").alias("price"))
    grouped = keyed.groupingSets([[F.col(p) for p in parts] for _, parts in LEVELS], *names).agg(F.grouping_id(*names).alias("gid"), F.median("price").alias("m"), F.count("*").alias("n"))
    out = F.lit(None)
    for i, (name, parts) in enumerate(LEVELS):
        code = sum(1 << (len(names) - 1 - k) for k, n in enumerate(names) if n not in parts)
        usable = F.col("gid") == code
        for p in parts:
            usable = usable & F.col(p).isNotNull()
        key = F.concat_ws("|", *[F.col(p) for p in parts]) if parts else F.lit("")
        one = F.struct(F.lit(i).alias("level"), F.lit(name).alias("level_name"), key.alias("key"))
        out = F.when(usable, one) if i == 0 else out.when(usable, one)
    return grouped.select(out.alias("g"), F.bround("m", 0).cast("bigint").alias("median_price"), "n").filter("g IS NOT NULL").select("g.*", "median_price", "n")


def predict(test: DataFrame, medians: DataFrame, least_rows: int, key: str, price: str = "listed_price_inr") -> DataFrame:
    """For each ``key`` of the test rows: actual and predicted price, the level used, its size and errors.

    Of rows that repeat a key the one with the narrowest level counts, then the cheapest.
    """
    usable = medians.filter((F.col("n") >= least_rows) | (F.col("level_name") == "global")).select("level", "key", "level_name", "median_price", "n")
    wanted = test.select(F.col(key).alias("id"), F.coalesce(F.col(price), F.lit(0)).cast("bigint").alias("actual"), F.explode(level_keys()).alias("w")).select("id", "actual", "w.level", F.col("w.key").alias("key"))
    found = wanted.join(usable, ["level", "key"])
    best = found.groupBy("id").agg(F.min(F.struct("level", "actual", "median_price", "level_name", "n")).alias("b"))
    out = best.select(F.col("id").alias(key), F.col("b.actual").alias("actual_price_inr"), F.col("b.median_price").alias("predicted_price_inr"), F.col("b.level_name").alias("prediction_level"), F.col("b.n").alias("training_group_count"))
    error = F.abs(F.col("actual_price_inr") - F.col("predicted_price_inr"))
    return out.withColumns({"absolute_error_inr": error, "absolute_percentage_error": F.when(F.col("actual_price_inr") > 0, F.bround(error / F.col("actual_price_inr"), 6))})


def group_coverage(medians: DataFrame) -> DataFrame:
    return medians.groupBy("level_name").agg(F.count("*").alias("groups"), F.sum("n").alias("rows_covered"))


def split_with_fallback(rows: DataFrame, is_test: Column, share: float, key: str) -> DataFrame:
    """``baseline_split`` by a hash rule; if one side came out empty, the last keys in order are the test.

    The fallback concerns tables of a few rows: only then is anything ordered.
    """
    marked = rows.withColumn("baseline_split", F.when(is_test, "test").otherwise("train"))
    sides = marked.groupBy("baseline_split").count().collect()
    if len(sides) != 1 or sides[0]["count"] <= 1:
        return marked
    n = sides[0]["count"]
    last = rows.select(key).orderBy(F.desc(key)).limit(max(1, min(n - 1, round(n * share)))).select(key, F.lit("test").alias("t"))
    return rows.join(last, key, "left").withColumn("baseline_split", F.coalesce("t", F.lit("train"))).drop("t")
