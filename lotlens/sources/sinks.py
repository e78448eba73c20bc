"""Writers: layered run outputs, flat CSV and JSON-lines with fixed conventions, small JSON documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import quality


def write_layers(judged: DataFrame, root: str, capture_date: str, run_id: str) -> dict[str, str]:
    """silver and quarantine rows and the run's summary, partitioned by source, capture_date and run_id.

    ``judged`` is read from the written evaluation, so its rules run once.
    """
    named = judged.withColumns({"capture_date": F.lit(capture_date), "run_id": F.lit(run_id)})
    by = ["source", "capture_date", "run_id"]
    named.write.mode("overwrite").partitionBy(*by).parquet(f"{root}/evaluated")
    rows = judged.sparkSession.read.parquet(f"{root}/evaluated")
    rows.filter("silver_valid").write.mode("overwrite").partitionBy(*by).parquet(f"{root}/silver")
    rows.filter(F.size("reasons") > 0).write.mode("overwrite").partitionBy(*by).parquet(f"{root}/quarantine")
    quality.run_status(quality.run_summary(rows)).write.mode("overwrite").json(f"{root}/gold/quality_summary")
    return {n: f"{root}/{n}" for n in ("evaluated", "silver", "quarantine")} | {"summary": f"{root}/gold/quality_summary"}


def write_csv(df: DataFrame, path: str, columns: list[str], booleans_as_words: bool = False) -> None:
    """Only ``columns``, null as nothing; nested values as JSON, true and false as words if wanted."""
    def shown(name: str):
        c, kind = F.col(name), df.schema[name].dataType
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(c).alias(name)
        if isinstance(kind, T.BooleanType):
            return (c.cast("string") if booleans_as_words else F.initcap(c.cast("string"))).alias(name)
        return c
    df.select(*map(shown, columns)).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """A JSON object a line, keys in order, nulls written."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def small_document(df: DataFrame, most: int = 10_000) -> str:
    """Rows of a small table as an indented JSON text with sorted keys; larger tables are refused."""
    rows = [json.loads(r["j"]) for r in df.select(F.to_json(F.struct("*")).alias("j")).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write them as a table")
    return json.dumps(rows, indent=2, sort_keys=True, ensure_ascii=False)


def markdown_table(df: DataFrame, title: str, most: int = 25) -> str:
    """The first rows of a report as a Markdown table, and how many more there are."""
    rows, n = df.limit(most).collect(), df.count()
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    body = "\n".join("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows)
    rest = f"\n{n - most} more rows.\n" if n > most else ""
    return f"## {title}\n\n{head}\n{body}\n{rest}"


def markdown_document(title: str, document: dict, depth: int = 2) -> str:
    """A small document as Markdown: plain values in a list, nested ones under headings of their own."""
    plain = {k: v for k, v in document.items() if not isinstance(v, dict)}
    said = "".join(f"- {k}: {', '.join(map(str, v)) if isinstance(v, list) else v}\n" for k, v in plain.items())
    nested = "".join(markdown_document(str(k), v, depth + 1) for k, v in document.items() if isinstance(v, dict))
    return f"{'#' * depth} {title}\n\n{said}\n{nested}"


def write_text(spark, text: str, path: str) -> None:
    """One small text document, written through Spark so that any file system will do."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_document(spark, document: dict, path: str) -> None:
    """One small JSON object with sorted keys on one line."""
    write_text(spark, json.dumps(document, sort_keys=True, ensure_ascii=False), path)


def write_raw(rows: DataFrame, root: str, source: str, capture_date: str, run_id: str) -> str:
    """The raw layer: a run's records as they came, before any parsing."""
    named = rows.withColumns({"source": F.lit(source), "capture_date": F.lit(capture_date), "run_id": F.lit(run_id)})
    named.write.mode("overwrite").partitionBy("source", "capture_date", "run_id").parquet(f"{root}/raw")
    return f"{root}/raw"
