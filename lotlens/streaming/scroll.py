"""Batches of cards or details in which only keys not seen before count, up to a cap.

Each micro-batch writes the rows that are new against all earlier batches under its own number, so a batch
that is replayed writes the same rows again. A scroll has ended once a number of batches in a row brought
nothing new or the cap is reached; later batches then write nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class NewRows:
    """Rows new by ``key`` under ``out``: ``most`` in all, ``most_each`` in a batch (the first by ``order``)."""

    spark: SparkSession
    out: str
    key: str
    order: list[str]
    schema: T.StructType
    most: int | None = None
    most_each: int | None = None
    idle: int = 1
    found: dict[int, int] = field(default_factory=dict)

    def earlier(self, number: int) -> DataFrame:
        """The rows that batches before ``number`` wrote."""
        paths = [f"{self.out}/batch-{n}" for n in sorted(self.found) if n < number and self.found[n]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def ended(self, number: int) -> str | None:
        """Why nothing counts any more before ``number``: cap_reached, no_new_rows, or None."""
        before = [self.found[n] for n in sorted(self.found) if n < number]
        if self.most is not None and sum(before) >= self.most:
            return "cap_reached"
        return "no_new_rows" if len(before) >= self.idle and not any(before[-self.idle :]) else None

    def add(self, batch: DataFrame, number: int) -> None:
        if self.ended(number):
            self.found[number] = 0
            return
        before = sum(c for n, c in self.found.items() if n < number)
        room = [c for c in (None if self.most is None else self.most - before, self.most_each) if c is not None]
        first = batch.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min_by(F.struct(*self.schema.fieldNames()), F.struct(*self.order)).alias("row")).select("row.*")
        fresh = first.join(self.earlier(number).select(self.key), self.key, "left_anti").select(*self.schema.fieldNames())
        fresh = fresh.orderBy(*self.order).limit(min(room)) if room else fresh
        fresh.write.mode("overwrite").parquet(f"{self.out}/batch-{number}")
        self.found[number] = self.spark.read.schema(self.schema).parquet(f"{self.out}/batch-{number}").count()

    def rows(self) -> DataFrame:
        return self.earlier(max(self.found, default=-1) + 1)


def scroll(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, key: str, order: list[str], most: int | None = None, most_each: int | None = None, idle: int = 1) -> NewRows:
    """Run all files available under ``source``, one a batch, through :class:`NewRows`."""
    state = NewRows(spark, out, key, order, schema, most, most_each, idle)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    reader.json(source).writeStream.foreachBatch(state.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return state
