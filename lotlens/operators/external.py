"""An external two-file dataset: provenance, profile, canonical mapping, trust rules and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parsers as P
from ..functions.scalars import int_truncated

# The files' columns in order, and the trust rules' names.
COLUMNS = (
    "id", "car_name", "yr_mfr", "fuel_type", "kms_run", "sale_price", "city", "times_viewed", "body_type", "transmission", "variant", "assured_buy", "registered_city", "registered_state", "is_hot", "rto", "source", "make", "model",
    "car_availability", "total_owners", "broker_quote", "original_price", "car_rating", "ad_created_on", "fitness_certificate", "emi_starts_from", "booking_down_pymnt", "reserved", "warranty_avail",
)
CORE = ("car_name", "yr_mfr", "fuel_type", "kms_run", "sale_price", "city", "transmission", "variant")
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])


def read_splits(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """All files as text columns with ``split``, which file a row came from."""
    from ..sources.payloads import read_strict_csv

    out = None
    for split, path in files.items():
        one = read_strict_csv(spark, path, SCHEMA).withColumn("split", F.lit(split))
        out = one if out is None else out.unionByName(one)
    return out


def raw_profile(rows: DataFrame) -> DataFrame:
    """One row: size, ids that repeat, exact and core duplicates."""
    return rows.agg(
        F.count("*").alias("n"), (F.count("id") - F.count_distinct("id")).alias("duplicate_ids"), (F.count("*") - F.count_distinct(F.xxhash64(*COLUMNS))).alias("duplicate_rows"), (F.count("*") - F.count_distinct(F.xxhash64(*CORE))).alias("duplicate_core_rows")
    )


def model_family(c: Column) -> Column:
    """The model without engine size and in its usual spelling: 'Wagon-R-1-0' is 'Wagon R'."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"[-\s]+", " "), r"(?i)\s+\d[. ]\d\w?$", ""))
    return F.initcap(words)


def trust_reasons() -> Column:
    """Why a row is not trusted: sold between customers, or not assured."""
    channel = F.lower(F.regexp_replace(F.trim("source"), r"[_\s]+", "-"))
    reasons = F.array(
        F.when(channel.isin("customer-to-customer", "c2c"), "source_channel_customer_to_customer"),
        F.when(F.lower(F.trim("assured_buy")).isin("false", "0", "no"), "assured_buy_false"),
    )
    return F.array_compact(reasons)


def canonical(rows: DataFrame, prefix: str = "true_value_external_kaggle") -> DataFrame:
    """Listing columns of the raw rows, with key and quarantine reasons. Ids repeat across files, so the key names the file."""
    return rows.select(
        F.concat_ws("_", F.lit(prefix), "split", "id").alias("listing_key"), F.lit(prefix).alias("source"), "split", F.initcap(F.trim("city")).alias("city"), F.initcap(F.trim("make")).alias("brand"), model_family(F.col("model")).alias("model"),
        P.clean(F.col("variant")).alias("variant"), int_truncated(F.col("yr_mfr")).cast("int").alias("model_year"), P.parse_fuel(F.col("fuel_type"))["value"].alias("fuel_type"), P.parse_transmission(F.col("transmission"))["value"].alias("transmission"),
        int_truncated(F.col("kms_run")).alias("km_driven"), int_truncated(F.col("total_owners")).cast("int").alias("ownership"), F.upper(F.trim("rto")).alias("registration_code"), int_truncated(F.col("sale_price")).alias("listed_price_inr"), trust_reasons().alias("reasons"),
    )


def trusted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size("reasons") == 0)


def validate(rows: DataFrame, source: str) -> DataFrame:
    """(check_name, status): one source, unique keys, complete required columns, positive prices."""
    from .ledger import checks

    need = ("city", "brand", "model", "model_year", "fuel_type", "transmission", "km_driven", "listed_price_inr")
    missing = F.lit(False)
    for c in need:
        missing = missing | F.col(c).isNull()
    figures = rows.agg(F.count("*").alias("n"), F.count_distinct("listing_key").alias("keys"), F.count_if(F.col("source") != source).alias("others"), F.count_if(missing).alias("gaps"), F.count_if(F.coalesce("listed_price_inr", F.lit(0)) <= 0).alias("free"))
    return checks(figures, {"source_only": F.col("others") == 0, "listing_keys_are_unique": F.col("n") == F.col("keys"), "required_complete": F.col("gaps") == 0, "price_positive": F.col("free") == 0})
