"""Helpers that the corpus operators share: scratch tables, joins with hot keys, let-bindings and public vocabularies.

Scratch tables lie in one folder for each application under the shared folder; they serve recovery while
a result is computed from them, so they stay until :func:`sweep` is called when the results are written.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024
FILE_ROWS = 1 << 16


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the one named by spark.checkpoint.dir.

    A temporary folder is taken only in local mode with the setting unset, as in tests; on a cluster that
    is an error, because executors would not share the folder.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/lotlens-{context.applicationId}"
    if not context.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="lotlens-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return "file://" + _LOCAL["dir"]


def sweep(spark: SparkSession) -> None:
    """Delete the application's scratch tables; call it once the results that read them are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def files(rows: int) -> int:
    """How many files a table of ``rows`` narrow rows should have."""
    return max(1, -(-rows // FILE_ROWS))


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back, which cuts its lineage.

    The table outlives any executor, so a lost one costs only the tasks that were running on it. While it is
    written, rows go to Python ``BATCH_ROWS`` at a time at most, which bounds the buffers on both sides.

    ``rows``, about as many rows as its last stage can handle, holds that stage to as many tasks as :func:`files`
    says; else a small table has a file for each task. On a local file system Hadoop starts a process for each
    file and its checksum, and until such a process runs its own program it counts with the executor's whole memory.
    """
    if rows is not None:
        df = df.coalesce(files(rows))
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)


#: A key that holds one in so many rows of a table, or more, is hot; so there are that many hot keys at most.
HOT_SHARE = 1024


def hot_of(counts: DataFrame, key: str, total: int) -> DataFrame | None:
    """(``key``, reps): the hot keys of a table of ``total`` rows and how many salts each gets; None without any.

    ``counts`` has n, the rows of each key. By definition there are at most ``HOT_SHARE`` hot keys, whatever
    the table's size, with fewer than twice as many salts in all.
    """
    least = max(1, -(-total // HOT_SHARE))
    reps = F.ceil(F.col("n") / F.lit(least)).cast("int")
    hot = counts.filter(F.col("n") > least).select(key, reps.alias("reps"))
    rows = hot.toArrow()
    return counts.sparkSession.createDataFrame(rows, hot.schema) if rows.num_rows else None


def hot_keys(many: DataFrame, key: str) -> DataFrame | None:
    """:func:`hot_of` a written table."""
    return hot_of(many.groupBy(key).agg(F.count("*").alias("n")), key, many.count())


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: list[str], hot: DataFrame | None) -> DataFrame:
    """Equi-join on ``key`` in which the rows of a hot key of ``many`` are dealt over several tasks by ``spread``.

    ``one`` has at most one row a key; a hot key's is repeated for every salt.
    """
    if hot is None:
        return many.join(one, key)
    salts = F.coalesce(F.col("reps"), F.lit(1))
    left = many.join(F.broadcast(hot), key, "left").withColumn("hot_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("reps")
    right = one.join(F.broadcast(hot), key, "left").withColumn("hot_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("reps")
    return left.join(right, [key, "hot_salt"]).drop("hot_salt")


def packed(docs: DataFrame, name: str = "row") -> DataFrame:
    """``docs`` as one struct column, so that an operator's own columns can't clash with any of its."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(column: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def vocabulary(name: str, folder: str | None = None) -> str:
    """The path of a public vocabulary file; ``folder`` overrides the installed place."""
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
