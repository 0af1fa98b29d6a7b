"""Daily transactions as a stream: de-duplicated days, rolled up to months by upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def distinct_days(stream: DataFrame, *, late: str = "2 days") -> DataFrame:
    """The first row of every (id, date) in a stream with event time ``ts``; later ones within ``late`` are dropped."""
    return stream.withWatermark("ts", late).withColumn("date", F.to_date("ts")).dropDuplicatesWithinWatermark(["id", "date"])


def daily_counts(stream: DataFrame, *, late: str = "2 days") -> DataFrame:
    """(day, id, n, value) in one-day event-time windows, emitted once the watermark has passed."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "id").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.to_date("w.start").alias("day"), "id", "n", "value")


def month_totals(spark: SparkSession, folder: str) -> DataFrame:
    """(id, year_month, days, value) over all batches that :func:`write_days` has written."""
    days = spark.read.parquet(folder)
    last = days.groupBy("id", "day").agg(F.max_by(F.struct("n", "value"), "batch").alias("r"))
    return last.groupBy("id", F.date_format("day", "yyyy-MM").alias("year_month")).agg(F.count("*").alias("days"), F.sum("r.value").alias("value"))


def write_days(days: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append finished days with their batch number; a batch that is run again replaces itself by number."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return days.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
