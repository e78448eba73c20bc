"""Quality gates: reasons, warnings, completeness and the verdict of each listing, and their profiles.

A rule is a condition and a name; all rules become one array expression, so a table is judged in a
single narrow pass. The registry of sources is a small dimension, joined on the left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocabulary as V
from ..functions.parsers import flag, price_like
from ..functions.scalars import is_present, strings


def _has(df: DataFrame, *fields: str) -> Column:
    there = [is_present(F.col(f), df.schema[f].dataType) for f in fields if f in df.columns]
    out = F.lit(False)
    for t in there:
        out = out | t
    return out


def _col(df: DataFrame, field: str, kind: str) -> Column:
    return F.col(field).cast(kind) if field in df.columns else F.lit(None).cast(kind)


def completeness(df: DataFrame) -> dict[str, Column]:
    """Shares of required groups, high-value and optional fields present, and their weighted mean."""
    share = lambda groups: sum((_has(df, *g).cast("int") for g in groups), F.lit(0)) / F.lit(float(len(groups)))
    required = share([g for g, _ in V.REQUIRED_GROUPS])
    high, optional = share([(f,) for f in V.HIGH_VALUE_FIELDS]), share([(f,) for f in V.OPTIONAL_FIELDS])
    overall = required * 0.70 + high * 0.20 + optional * 0.10
    return {n: F.bround(c, 4) for n, c in (("required", required), ("high_value", high), ("optional", optional), ("overall", overall))}


def reasons(df: DataFrame, as_of_year: int, registry: bool = False) -> Column:
    """Names of the rules that keep a listing out of the priced set, in order, each once."""
    year, price, km = _col(df, "model_year", "int"), _col(df, "listed_price_inr", "bigint"), _col(df, "km_driven", "bigint")
    fuel, box, currency = _col(df, "fuel_type", "string"), _col(df, "transmission", "string"), _col(df, "currency", "string")
    captured = _col(df, "captured_at", "string")
    when = [flag(~_has(df, *fields), reason) for fields, reason in V.REQUIRED_GROUPS]
    when += [
        flag(_has(df, "captured_at") & F.try_to_timestamp(captured).isNull(), "invalid_captured_at"),
        flag(~year.between(V.FIRST_YEAR, as_of_year + 1), "invalid_model_year"),
        flag(price <= 0, "invalid_price"),
        flag((km < 0) | (km > V.KM_HARD), "invalid_km"),
        flag(~fuel.isin(*V.ALLOWED_FUELS), "unknown_fuel_type"),
        flag(~box.isin(*V.ALLOWED_GEARBOXES), "unknown_transmission"),
        flag(~currency.isin(*V.ALLOWED_CURRENCIES), "invalid_currency"),
    ]
    if registry:
        when += [flag(F.col("__role").isNull() & F.coalesce(F.col("source") != "", F.lit(False)), "unknown_source"), flag(F.col("__role").startswith("research_only") | (F.col("__priority") >= 90), "source_not_mvp_eligible")]
    record, model = _col(df, "source_record_type", "string"), _col(df, "model", "string")
    when += [
        flag((record != "") & (record != "listing"), "non_listing_record"),
        flag(_col(df, "is_available", "boolean").eqNullSafe(F.lit(False)), "listing_unavailable"),
        flag(_col(df, "commercial_vehicle_flag", "boolean").eqNullSafe(F.lit(True)), "commercial_vehicle"),
        flag(F.coalesce(_col(df, "parse_confidence", "double"), F.lit(0.0)) < V.GOLD_CONFIDENCE, "parse_confidence_below_gold_threshold"),
    ]
    said = F.coalesce(_col(df, "parse_warnings", "array<string>"), F.array().cast("array<string>"))
    critical = F.filter(said, lambda w: w.isin(*V.CRITICAL_WARNINGS))
    last = [flag(F.lower(model).rlike(r"\b\d\.\d\b"), "model_contains_engine_or_displacement"), flag(price_like(_col(df, "variant", "string")), "variant_contains_price_text")]
    return F.array_distinct(F.concat(strings(*when), critical, strings(*last)))


def warnings(df: DataFrame, registry: bool = False) -> Column:
    price, km, model = _col(df, "listed_price_inr", "bigint"), _col(df, "km_driven", "bigint"), F.lower(_col(df, "model", "string"))
    when = [flag((price > 0) & (price < V.PRICE_SOFT[0]), "price_below_soft_minimum"), flag((km > V.KM_SOFT) & (km <= V.KM_HARD), "km_above_soft_maximum")]
    when += [flag(F.col("__kind") == "classified", "classified_source")] if registry else []
    said = F.coalesce(_col(df, "parse_warnings", "array<string>"), F.array().cast("array<string>"))
    mild = F.filter(said, lambda w: ~w.isin(*V.CRITICAL_WARNINGS))
    return F.array_distinct(F.concat(strings(*when), mild, strings(flag(model.rlike(rf"\b({'|'.join(V.VARIANT_WORDS)})\b"), "model_may_contain_variant_detail"))))


def evaluate(df: DataFrame, as_of_year: int, registry: DataFrame | None = None) -> DataFrame:
    """``df`` with reasons, warnings, four completeness scores, silver_valid and pricing_ready.

    ``registry``: source, role, priority, kind (one row per source; a dimension of some dozens of rows).
    """
    rows = df
    if registry is not None:
        dim = registry.select(F.col("source").alias("__source"), F.coalesce("role", F.lit("")).alias("__role"), F.coalesce("priority", F.lit(999)).alias("__priority"), F.col("kind").alias("__kind"))
        rows = df.join(dim, F.col("source") == F.col("__source"), "left")
    known = registry is not None
    judged = rows.withColumns({"reasons": reasons(df, as_of_year, known), "warnings": warnings(df, known), **completeness(df)})
    silver = ~F.arrays_overlap("reasons", F.array(*[F.lit(r) for r in V.SILVER_BLOCKING]))
    judged = judged.withColumn("silver_valid", silver).withColumn("pricing_ready", F.col("silver_valid") & (F.size("reasons") == 0) & (F.col("required") == 1.0))
    return judged.drop("__source", "__role", "__priority", "__kind")


def run_summary(judged: DataFrame) -> DataFrame:
    """One row: counts and mean completeness of a judged run."""
    mean = lambda c: F.coalesce(F.bround(F.avg(c), 4), F.lit(0.0)).alias(f"{c}_avg")
    return judged.agg(
        F.count("*").alias("total"), F.count_if("silver_valid").alias("silver"), F.count_if("pricing_ready").alias("pricing_ready"), F.count_if(F.size("reasons") > 0).alias("quarantined"),
        mean("required"), mean("high_value"), mean("optional"), mean("overall"),
    )


def run_status(summary: DataFrame) -> DataFrame:
    """PASS if every row is priced and complete, FAIL if none is, else WARN; whether the run may be priced."""
    ready = (F.col("total") > 0) & (F.col("pricing_ready") == F.col("total")) & (F.col("quarantined") == 0) & (F.col("required_avg") == 1.0)
    status = F.when(ready, "PASS").when((F.col("total") == 0) | (F.col("silver") == 0), "FAIL").otherwise("WARN")
    return summary.withColumn("run_ready", ready).withColumn("status", status)


def histogram(judged: DataFrame, column: str) -> DataFrame:
    """Counts of the names in ``reasons`` or ``warnings``."""
    return judged.select(F.explode(column).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def field_profile(df: DataFrame, groups: dict[str, list[str]], present=is_present) -> DataFrame:
    """present, total and ratio of each field, from one aggregation turned into rows."""
    fields = [(g, f) for g, fs in groups.items() for f in fs]
    has = lambda f: present(F.col(f), df.schema[f].dataType) if f in df.columns else F.lit(False)
    one = df.agg(F.count("*").alias("total"), *[F.count_if(has(f)).alias(f"p{i}") for i, (_, f) in enumerate(fields)])
    rows = F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(f).alias("field"), F.col(f"p{i}").alias("present")) for i, (g, f) in enumerate(fields)]))
    out = one.select("total", rows.alias("r")).select("r.grp", "r.field", "r.present", "total")
    return out.withColumn("ratio", F.when(F.col("total") > 0, F.bround(F.col("present") / F.col("total"), 4)).otherwise(0.0))


def extra_field_profile(df: DataFrame, column: str = "extra_fields") -> DataFrame:
    """How often each key of a map column has a value."""
    pairs = df.select(F.explode(column).alias("key", "value"))
    return pairs.filter(F.col("value").isNotNull() & (F.trim("value") != "")).groupBy("key").agg(F.count("*").alias("present"))


def compare_sources(profiles: DataFrame, sources: list[str]) -> DataFrame:
    """Field ratios side by side (``profiles``: source, field, ratio), their spread and a note."""
    wide = profiles.groupBy("field").pivot("source", sources).agg(F.max("ratio"))
    ratios = [F.coalesce(F.col(s), F.lit(0.0)) for s in sources]
    high, low = F.greatest(*ratios), F.least(*ratios)
    note = F.when(high - low >= 0.5, "large_gap").when(low == 1.0, "complete").when(high == 0.0, "missing").otherwise("partial")
    return wide.select("field", *[r.alias(s) for r, s in zip(ratios, sources, strict=True)], F.bround(high - low, 4).alias("spread"), note.alias("note"))


def coverage(records: Column, least: Column, source_total: Column) -> Column:
    """Enough records, or all that a small source has."""
    return F.coalesce((records >= least) | ((source_total > 0) & (source_total < least) & (records >= source_total)), F.lit(False))


def completeness_gaps(profile: DataFrame, top: int = 10) -> DataFrame:
    """The fields furthest from complete."""
    return profile.filter("ratio < 1.0").orderBy("ratio", "grp", "field").limit(top)


def field_union(fields: DataFrame) -> DataFrame:
    """Every field name over all sources: which sources have it and where it was first seen (``fields``: source, field, position)."""
    return fields.groupBy("field").agg(F.sort_array(F.collect_set("source")).alias("sources"), F.min("position").alias("first_seen"))
