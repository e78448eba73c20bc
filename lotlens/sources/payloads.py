"""Payload scans: extracted JSON documents, page sets, attribute lists, CSV with a header contract.

Schemas are always declared; nothing is inferred. Live capture from the web is not part of an engine
that runs on a cluster: captured documents are its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import adapters


#: How many failures an error's text lists; it counts the rest.
SHOWN_FAILURES = 1000


def payload_schema(source: str) -> T.StructType:
    record = T.StructType([T.StructField("raw", T.StructType([T.StructField(n, T.StringType()) for n in adapters.raw_fields(source)]))])
    text = [T.StructField(n, T.StringType()) for n in ("source", "source_url", "captured_at", "captured_for")]
    return T.StructType([*text, T.StructField("records", T.ArrayType(record)), T.StructField("_corrupt_record", T.StringType())])


def read_payload(spark: SparkSession, path: str, source: str) -> DataFrame:
    """index (1-based), said_source, source_url and raw of each record of a JSON document."""
    doc = spark.read.schema(payload_schema(source)).option("multiLine", True).option("primitivesAsString", True).json(path)
    return doc.select(F.col("source").alias("said_source"), "source_url", F.posexplode("records").alias("pos", "record")).select("said_source", "source_url", (F.col("pos") + 1).alias("index"), F.col("record.raw").alias("raw"))


def checked_payload(spark: SparkSession, path: str, source: str) -> DataFrame:
    """The records, or ``ValueError`` with the failures of the payload's contract: the first ones, and how many more there are."""
    rows = read_payload(spark, path, source)
    head = rows.agg(F.count("*").alias("n"), F.first("said_source").alias("said"), F.first("source_url").alias("url")).first()
    found = adapters.header_failures(source, head["url"], head["n"], head["said"])
    wrong = adapters.contract(rows, source)
    found += [tuple(r) for r in wrong.orderBy("record_index", "field_name").limit(SHOWN_FAILURES).collect()]
    if found:
        more = wrong.count() - SHOWN_FAILURES
        rest = f"; and {more} more" if more > 0 else ""
        raise ValueError(f"{source} payload contract failed: {adapters.format_failures(found)}{rest}")
    return rows


def read_strict_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV whose header must be exactly the schema's names in order; anything else fails."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def first_wins(items: DataFrame, key: str, order: list[str], most: int | None = None) -> DataFrame:
    """Items of a page set in order, the first of each key, ``most`` at most."""
    w = W.partitionBy(key).orderBy(*order)
    kept = items.filter(F.col(key).isNotNull()).withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")
    return kept if most is None else kept.orderBy(*order).limit(most)


def page_items(pages: DataFrame, items: str = "items") -> DataFrame:
    """One row per item of each page, with page and pos."""
    return pages.select("page", F.posexplode(items).alias("pos", "item"))


def attributes_wide(attributes: Column, names: list[str]) -> list[Column]:
    """Columns from array<struct<code,value>>; of a repeated code the last value counts."""
    last = lambda n: F.element_at(F.filter(attributes, lambda a: a["code"] == n), -1)["value"]
    return [F.when(F.exists(attributes, lambda a, n=n: a["code"] == n), last(n)).alias(n) for n in names]


def product_passes(in_stock: Column, km: Column, *required: Column, most_km: int = 300_000) -> Column:
    """In stock unless it says otherwise, complete, and within the distance limit."""
    ok = F.coalesce(in_stock, F.lit(True)) & F.coalesce(km <= most_km, F.lit(False))
    for c in required:
        ok = ok & F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))
    return ok


def first_json_object(text: Column) -> Column:
    """The first balanced {...} in noisy text, or null; braces inside strings do not count.

    A fold over the text's characters with (depth, in string, escaped), so it stays in the JVM.
    """
    start = F.instr(text, "{")
    chars = F.split(F.substr(text, F.greatest(start, F.lit(1))), "")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        quoted = F.when(s["escaped"] | (c != '"'), s["quoted"]).otherwise(~s["quoted"])
        escaped = s["quoted"] & (c == "\\") & ~s["escaped"]
        depth = s["depth"] + F.when(~s["quoted"] & (c == "{"), 1).when(~s["quoted"] & (c == "}"), -1).otherwise(0)
        at = s["at"] + F.char_length(c)
        end = F.when((s["end"] == 0) & (depth == 0) & (at > 0), at).otherwise(s["end"])
        return F.when(s["end"] > 0, s).otherwise(F.struct(depth.alias("depth"), quoted.alias("quoted"), escaped.alias("escaped"), at.alias("at"), end.alias("end")))

    end = F.aggregate(chars, zero, step)["end"]
    return F.when((start > 0) & (end > 0), F.substr(text, start, end))
