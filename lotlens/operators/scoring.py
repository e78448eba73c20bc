"""Answers to price requests: clean, check, predict, warn, grade and bound, for tables of requests.

This is the batch form of a prediction service: any number of rows in, one answer a row out. Training
counts are small dimension tables joined on the left, so an unseen value is simply unmatched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsers as P
from ..functions.scalars import int_half_even
from . import features

# Accepted spellings of request words and the defaults of optional fields.
FUEL_WORDS = {"ev": "electric", "petrol_+_cng": "petrol_cng", "cng_petrol": "petrol_cng", "petrol/cng": "petrol_cng"}
GEARBOX_WORDS = {"at": "automatic", "auto": "automatic", "mt": "manual"}
SOURCE_WORDS = {"market_default": "true_value", "true_value": "true_value", "spinny": "spinny", "mahindra_first_choice": "mahindra_first_choice"}
DEFAULTS = {"variant": "unknown", "state": "unknown", "registration_code": "unknown", "ownership": "unknown", "source_context": "market_default"}


def requests(df: DataFrame) -> DataFrame:
    """Requests with defaults, aliases resolved and numbers read; ``violations`` names broken rules."""
    columns = {}
    for name, default in DEFAULTS.items():
        given = F.nullif(F.trim(F.col(name).cast("string")), F.lit("")) if name in df.columns else F.lit(None).cast("string")
        columns[name] = F.coalesce(given, F.lit(default))
    out = df.withColumns(columns)
    year = int_half_even(F.col("market_snapshot_year")).cast("int") if "market_snapshot_year" in df.columns else F.lit(None).cast("int")
    out = out.withColumns({
        "model_year": int_half_even(F.col("model_year")).cast("int"), "km_driven": int_half_even(F.col("km_driven")), "fuel_type": P.alias(F.col("fuel_type"), FUEL_WORDS), "transmission": P.alias(F.col("transmission"), GEARBOX_WORDS),
        "source": F.coalesce(P.mapped(SOURCE_WORDS, P.alias(F.col("source_context"), {})), F.lit("true_value")), "market_snapshot_year": F.coalesce(year, F.lit(features.SNAPSHOT_YEAR)),
    })
    return out.withColumn("violations", features.request_violations())


def canonicalised(df: DataFrame, maps: dict[str, DataFrame]) -> DataFrame:
    """Values in their usual spelling (``features.canonical_values`` of the training rows), else as they are."""
    for name, table in maps.items():
        known = table.select(F.col("key").alias("__k"), F.col("value").alias("__v"))
        df = df.join(known, F.lower(F.trim(name)) == F.col("__k"), "left").withColumn(name, F.coalesce("__v", F.nullif(F.trim(name), F.lit("")), F.lit("unknown"))).drop("__k", "__v")
    return df


def graded(priced: DataFrame, train: DataFrame, price: str = "predicted_price_inr") -> DataFrame:
    """``priced`` rows with warnings, confidence, interval and band."""
    for by in (("brand", "model"), ("brand",), ("model",), ("city",)):
        counts = train.groupBy(*by).agg(F.count("*").alias("__n_" + "_".join(by)))
        priced = priced.join(counts, list(by), "left")
    p = F.col(price)
    out = priced.withColumn("warnings", features.segment_warnings(p, F.col("__n_brand_model"), F.col("__n_brand"), F.col("__n_model"), F.col("__n_city")))
    out = out.withColumn("__g", features.confidence(F.col("warnings"), p, F.col("__n_brand_model")))
    edge = lambda x: F.bround(p * x, 0).cast("bigint")
    out = out.withColumns({"confidence": F.col("__g.confidence"), "interval_pct": F.col("__g.margin"), "low_price_inr": edge(1 - F.col("__g.margin")), "high_price_inr": edge(1 + F.col("__g.margin")), "price_band": features.price_band(p)})
    return out.drop("__g", "__n_brand_model", "__n_brand", "__n_model", "__n_city")


def answer(df: DataFrame, model, train: DataFrame) -> DataFrame:
    """Priced and graded answers to the requests that break no rule."""
    return graded(model.predict(requests(df).filter(F.size("violations") == 0)), train)


def rejected(df: DataFrame) -> DataFrame:
    return requests(df).filter(F.size("violations") > 0)


def batch_size_ok(n: Column, most: int = 50) -> Column:
    return n.between(1, most)
