"""Small documents beside the tables: JSON lists and objects, registries in YAML or JSON, and paths.

Metadata of runs is read by the driver, whole and once; only lists of listing rows become tables.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def _text(spark: SparkSession, path: str) -> str | None:
    """A document's text by any path that Spark can read; None where there is none."""
    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException:
        return None
    return row["value"] if row else None


def read_object(spark: SparkSession, path: str) -> dict:
    """A JSON object; anything else is a ``ValueError``."""
    text = _text(spark, path)
    value = None if text is None else json.loads(text)
    if not isinstance(value, dict):
        raise ValueError(f"not a JSON object: {path}")
    return value


def optional_object(spark: SparkSession, path: str) -> dict:
    """A JSON object, or an empty one where the document is missing, broken or of another kind."""
    try:
        return read_object(spark, path)
    except ValueError:
        return {}


def read_list(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a document that is one JSON list of objects; another kind of document is a ``ValueError``."""
    head = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim("value", F.lit(" \t\r\n\ufeff")), 1, 1).alias("c")).distinct().collect()  # one row a kind of document
    if {r["c"] for r in head} - {"["}:
        raise ValueError(f"not a JSON list: {path}")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_details(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Detail payloads of several files as one table with ``file``, which one a row came from."""
    return spark.read.schema(schema).option("multiLine", True).json(paths).withColumn("file", F.input_file_name())


def read_registry(spark: SparkSession, path: str, entries: str, schema: str) -> DataFrame:
    """A small dimension (some dozens of rows) from a YAML or JSON document: the mapping under ``entries``, its keys as the first column."""
    text = _text(spark, path)
    if text is None:
        raise ValueError(f"no registry at {path}")
    if path.rsplit(".", 1)[-1] in ("yaml", "yml"):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML registries need the yaml package; JSON ones do not") from e
        document = yaml.safe_load(text)
    else:
        document = json.loads(text)
    found = document.get(entries) if isinstance(document, dict) else None
    if not isinstance(found, dict):
        raise ValueError(f"{path} has no mapping {entries!r}")
    columns = T._parse_datatype_string(schema).fieldNames()
    return spark.createDataFrame([tuple([key, *[(value or {}).get(c) for c in columns[1:]]]) for key, value in found.items()], schema)


def resolve(path: str, *bases: str) -> str:
    """An absolute path or URL as it is; else the first place where it exists: here, then under each base; else under the last base."""
    if "://" in path or os.path.isabs(path):
        return path
    places = [path, *[os.path.join(b, path) for b in bases]]
    return next((p for p in places if os.path.exists(p)), places[-1])


def silver_path(manifest: dict) -> str:
    """Where a run manifest says its silver rows are; a manifest that doesn't is a ``ValueError``."""
    path = (manifest.get("output_paths") or {}).get("silver")
    if not path:
        raise ValueError(f"the manifest of run {manifest.get('run_id', 'unknown')} names no silver path")
    return path
