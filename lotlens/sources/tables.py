"""The star schema's tables as listings, and scratch folders."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder (spark.checkpoint.dir); a temporary one only in local mode with that unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = tempfile.mkdtemp(prefix="lotlens-")
            atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
        shared = f"file://{_LOCAL['dir']}"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as sightings of listings: parts are models, suppliers' nations cities, orders runs."""
    t = lambda n: table(spark, sf_dir, n)
    place = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(place, F.col("l_suppkey") == F.col("s_suppkey"))
    number = F.col("l_linenumber")
    return lines.select(
        (F.col("l_orderkey") * 10 + number).cast("bigint").alias("record_index"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("record_key"), F.col("r_name").alias("source"), F.col("n_name").alias("city"), F.lit("").alias("state"), F.col("p_brand").alias("brand"), F.col("p_type").alias("model"),
        F.when(number != 5, F.col("p_name")).alias("variant"), F.year("o_orderdate").alias("model_year"), F.when(F.col("l_returnflag") == "A", "petrol").when(F.col("l_returnflag") == "N", "diesel").otherwise("unknown").alias("fuel_type"),
        F.when(F.col("l_linestatus") == "O", "manual").otherwise("automatic").alias("transmission"), F.nullif(number, F.lit(7)).alias("ownership"), F.floor(F.col("l_quantity") * 5000).cast("bigint").alias("km_driven"),
        F.floor("l_extendedprice").cast("bigint").alias("listed_price_inr"), F.col("o_orderpriority").alias("run_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("captured_at"), F.date_format("l_shipdate", "yyyy-MM").alias("capture_date"),
        F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.lit("HTTPS://Cars.Example//lot/"), F.col("l_partkey").cast("string"), F.lit("/"), (F.col("l_suppkey") % 5).cast("string"), F.lit("/?q=1"))).alias("listing_url"),
        F.when(F.col("l_suppkey") % 2 != 0, F.concat(F.lit("ID "), F.col("l_partkey").cast("string"))).alias("source_listing_id"), F.when(number % 4 != 0, F.concat(F.lit("KA0"), (number % 4).cast("string"))).alias("registration_code"),
        F.when(number == 6, "USD").otherwise("INR").alias("currency"), F.when(number == 3, 0.72).otherwise(0.95).alias("parse_confidence"), (F.col("l_discount") < 0.095).alias("is_available"), F.lit("listing").alias("source_record_type"),
    )


LISTINGS_SQL = """
listings AS (
  SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS record_index, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS record_key, r_name AS source, n_name AS city, '' AS state, p_brand AS brand, p_type AS model,
    CASE WHEN l_linenumber <> 5 THEN p_name END AS variant, CAST(year(o_orderdate) AS INTEGER) AS model_year,
    CASE l_returnflag WHEN 'A' THEN 'petrol' WHEN 'N' THEN 'diesel' ELSE 'unknown' END AS fuel_type, CASE l_linestatus WHEN 'O' THEN 'manual' ELSE 'automatic' END AS transmission,
    nullif(l_linenumber, 7) AS ownership, CAST(floor(l_quantity * 5000) AS BIGINT) AS km_driven, CAST(floor(l_extendedprice) AS BIGINT) AS listed_price_inr, o_orderpriority AS run_id,
    strftime(l_shipdate, '%Y-%m-%d') AS captured_at, strftime(l_shipdate, '%Y-%m') AS capture_date,
    CASE WHEN l_suppkey % 3 <> 0 THEN 'HTTPS://Cars.Example//lot/' || l_partkey || '/' || (l_suppkey % 5) || '/?q=1' END AS listing_url,
    CASE WHEN l_suppkey % 2 <> 0 THEN 'ID ' || l_partkey END AS source_listing_id, CASE WHEN l_linenumber % 4 <> 0 THEN 'KA0' || (l_linenumber % 4) END AS registration_code,
    CASE WHEN l_linenumber = 6 THEN 'USD' ELSE 'INR' END AS currency, CASE WHEN l_linenumber = 3 THEN 0.72 ELSE 0.95 END AS parse_confidence, l_discount < 0.095 AS is_available, 'listing' AS source_record_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
