"""Changes that arrive as a stream, applied batch by batch.

``apply_changes`` reads change rows (op, _id, fields...), watermarked, and folds every micro-batch into a table that a
``TableSink`` keeps as versions in a folder: a batch is applied once however often it is tried, since its number names the
version. ``windowed_counts`` is the streaming form of COUNT ... GROUP BY over event-time windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


@dataclass
class TableSink:
    """A table of the latest row for each ``_id``, one folder for each version, named by the batch that made it."""

    spark: SparkSession
    path: str
    schema: str  # DDL with _id and a sequence column ``seq``

    def versions(self) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        done = (s.getPath() for s in fs.listStatus(p))
        return sorted(int(x.getName()[1:]) for x in done if x.getName().startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame:
        """The newest version, or the newest older than a batch."""
        vs = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{vs[-1]}") if vs else self.spark.createDataFrame([], self.schema)

    def fold(self, batch: DataFrame, number: int) -> None:
        """batch (op and the table's columns): of equal ids the highest seq counts; op delete removes the row."""
        last = Window.partitionBy("_id").orderBy(F.col("seq").desc(), F.col("op"))
        new = batch.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
        old = self.read(before=number)
        kept = old.join(new.select("_id"), "_id", "left_anti").select(*old.columns)
        kept.unionByName(new.where("op != 'delete'").select(*old.columns)).write.mode("overwrite").parquet(f"{self.path}/v{number}")


def apply_changes(changes: DataFrame, sink: TableSink, checkpoint: str) -> StreamingQuery:
    """Starts the query that folds every micro-batch of a streaming DataFrame into sink."""
    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink.fold(df, n)).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, by, count) of event-time windows; rows later than delay are dropped once their window has closed."""
    counted = events.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.col("w.start").alias("start"), by, "count")
