"""Streams of sightings: an entity table kept up to date batch by batch, and first-seen filtering.

There is no table format with row updates here, so a micro-batch writes a new version of the entity
table next to the last one and a batch that is replayed writes its own version again: exactly once. A
batch therefore costs a pass over the whole table, and two versions are kept: the last one, and the one
before it, which a replay reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def partial_entities(observations: DataFrame, key: str, at: str) -> DataFrame:
    return observations.groupBy(key).agg(F.count("*").alias("observation_count"), F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"))


def merged_entities(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Two partial tables as one."""
    both = old.unionByName(new)
    return both.groupBy(key).agg(F.sum("observation_count").alias("observation_count"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))


class EntityTable:
    """Versions of an entity table under a folder; version n holds all batches up to n."""

    def __init__(self, spark: SparkSession, path: str, key: str, at: str):
        self.spark, self.path, self.key, self.at, self.last = spark, path, key, at, None

    def upsert(self, batch: DataFrame, number: int) -> None:
        new = partial_entities(batch, self.key, self.at)
        if number > 0:
            new = merged_entities(self.spark.read.parquet(f"{self.path}/v{number - 1}"), new, self.key)
        new.write.mode("overwrite").parquet(f"{self.path}/v{number}")
        self.last = number
        if number > 1:
            old = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{number - 2}")
            old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.last}")


def stream_entities(spark: SparkSession, source: str, schema: T.StructType, out: str, key: str, at: str, checkpoint: str, prepare=lambda df: df, glob: str | None = None) -> DataFrame:
    """Run all files available under ``source`` through the entity table and return its last version."""
    table = EntityTable(spark, out, key, at)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    query = prepare(reader.parquet(source)).writeStream.foreachBatch(table.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read()


def first_seen(stream: DataFrame, key: str, at: str, delay: str = "10 minutes") -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Sightings per window and group, late rows within ``delay`` included."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))
