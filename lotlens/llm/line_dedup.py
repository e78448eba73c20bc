"""Line deduplication: lines that many documents share stay only in the document with the largest id.

Lines are exploded with their positions, normalised and hashed to 128 bits. The hash table (documents
per hash, largest id) is built with partial counts, so a line that a third of all documents hold sends
one row per task and document set. Only lines over the threshold are joined back, hot lines salted, which
gives each document's positions to drop. A Bloom filter of those documents (at most 32 MB, as in exact
deduplication) lets the others pass straight through; the rest meet their positions and are reassembled.
Past about 10^8 losing documents the filter lets more of the others take the shuffled way; no result changes.

Edge cases: null text is one empty line; a null id counts as no document and keeps nothing; repeated
rows with one id count as one document and get equal results; of lines that one document repeats all stay
or all go; keys shorter than ``min_chars`` always stay; a text of any length is split whole, in the task
that holds it; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import hot_keys, let, salted_join, whole, written
from .exact_dedup import bits_set, member_cells, table_cells

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """White space (0x20, 0x09 to 0x0D) stripped at both ends, A to Z lower-cased.

    In text of single bytes that is plain lower case, which Spark does many times faster.
    """
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def hashed_lines(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """doc_id, row (hash of the text), pos and h (hash of the key) of every line whose key is long enough."""
    lines = docs.select("doc_id", F.unhex(F.md5("text")).alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    return keys.select("doc_id", "row", "pos", F.unhex(F.md5("key")).alias("h"))


def shared_lines(lines: DataFrame, min_docs: int = 3) -> DataFrame:
    """The hash of each key found in ``min_docs`` documents or more, with the document that keeps it."""
    return lines.groupBy("h").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper")).filter(F.col("n_docs") >= min_docs)


def _losing(rows: DataFrame, drops: DataFrame) -> Column:
    """A flag for each document, true wherever it has lines to drop."""
    cells = table_cells(drops.count())
    table = rows.sparkSession.sparkContext.broadcast(member_cells(drops, F.xxhash64("d", "r"), cells))

    @F.pandas_udf("boolean")
    def listed(h: pd.Series) -> pd.Series:
        return pd.Series(bits_set(table.value, h.to_numpy(np.int64), cells))

    return listed(F.xxhash64("doc_id", "row"))


def drop_shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, text (the lines that stay, joined by newline)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    lines = written(hashed_lines(rows, min_chars), "lines")
    shared = written(shared_lines(lines, min_docs), "lines-shared")
    hits = salted_join(lines, shared, "h", ["doc_id", "row"], hot_keys(lines, "h"))
    losing = hits.filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = written(losing.groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.collect_set("pos").alias("drop")), "lines-drop")
    keyed = rows.withColumn("row", F.unhex(F.md5("text")))
    flagged = keyed.withColumn("__loses", _losing(keyed, drops))
    pass_on = flagged.filter("not __loses").select("doc_id", F.size(F.split("text", "\n", -1)).cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("n_dropped"), "text")
    row = flagged.filter("__loses").select("doc_id", "row", "text")
    joined = row.join(drops.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    n_lines = F.size(F.split("text", "\n", -1))

    def rebuilt(parts: Column) -> Column:
        kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("drop")))
        return F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")

    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(let(F.split("text", "\n", -1), rebuilt))
    dropped = F.coalesce(F.size("drop"), F.lit(0))
    dropped = F.when(F.col("drop").isNull(), 0).otherwise(dropped)
    rebuilt_rows = joined.select("doc_id", n_lines.cast("bigint").alias("n_lines"), dropped.cast("bigint").alias("n_dropped"), text.alias("text"))
    return pass_on.unionByName(rebuilt_rows)
