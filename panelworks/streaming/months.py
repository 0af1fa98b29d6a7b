"""Calendar months of a stream: days are held as state until the watermark has passed their month's end."""

from __future__ import annotations

import contextlib
import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = dt.date(1970, 1, 1)


def month_end_ms(year_month: str) -> int:
    """The first millisecond (UTC) after a month ``yyyy-MM``."""
    y, m = map(int, year_month.split("-"))
    return (dt.date(y + m // 12, m % 12 + 1, 1) - _EPOCH).days * 86_400_000


def _days(df: DataFrame) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return df.select("id", F.date_format("ts", "yyyy-MM").alias("year_month"), F.dayofmonth("ts").alias("day"), ms.alias("ts_ms"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"), F.col("ts").cast("timestamp").alias("ts"))


def closed_days(stream: DataFrame, *, late: str = "2 days") -> DataFrame:
    """(id, year_month, day, value) of a stream (id, ts, value): a day's latest row, once the watermark has passed its month's end.

    Rows may come late by ``late``, twice or in any order. Later ones count while their month is
    open and are dropped when it is closed. State is a row for each day of an open month (ties:
    the larger value), so a day counts once however often it comes; a month's days leave it
    together, in one batch. Rows without id or time are left out. To be started under :func:`_one_state`.
    """
    rows = _days(stream.where("id IS NOT NULL AND ts IS NOT NULL")).withWatermark("ts", late)
    # State is cleared by the month's end as event time. The watermark is the lesser of both columns', which is that of the rows' own time.
    end = F.add_months(F.trunc("ts", "MM"), 1).cast("timestamp")
    rows = rows.select("id", "year_month", "day", "ts_ms", "value", end.alias("month_end")).withWatermark("month_end", late)
    return rows.groupBy("id", "year_month", "month_end", "day").agg(F.max(F.struct("ts_ms", "value")).alias("r")).select("id", "year_month", "day", "r.value")


@contextlib.contextmanager
def _one_state(spark: SparkSession) -> Iterator[None]:
    """While this holds, a stream that starts keeps its state on disk, has one stateful step and may have two watermark columns, the lesser of which counts."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": STORE, "spark.sql.streaming.statefulOperator.allowMultiple": "false", "spark.sql.streaming.multipleWatermarkPolicy": "min"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _sums(days: DataFrame) -> DataFrame:
    return days.groupBy("id", "year_month").agg(F.count("*").alias("days"), F.sum("value").alias("value"))


def months_of(rows: DataFrame) -> DataFrame:
    """The same months in batch: the latest row of each day, added up by id and month."""
    day = _days(rows.where("id IS NOT NULL AND ts IS NOT NULL")).groupBy("id", "year_month", "day").agg(F.max(F.struct("ts_ms", "value")).alias("r"))
    return _sums(day.select("id", "year_month", "r.value"))


def collect_closed(stream: DataFrame, folder: str, *, late: str = "2 days") -> DataFrame:
    """(id, year_month, days, value) of the months closed by all that a stream has now, as :func:`months_of` has them, written under ``folder``.

    A call with the same folder goes on where the last one ended. A batch's days
    (:func:`closed_days`) are whole months, so it is added up alone; one that is run again
    replaces itself by its number.
    """
    days = closed_days(stream, late=late)

    def put(batch: DataFrame, number: int) -> None:
        _sums(batch).write.mode("overwrite").parquet(f"{folder}/months/batch={number}")

    out = days.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    with _one_state(stream.sparkSession):
        running = out.start()
    running.awaitTermination()
    kind = days.schema["id"].dataType.simpleString()
    return stream.sparkSession.read.schema(f"id {kind}, year_month string, days long, value double").parquet(f"{folder}/months").select("id", "year_month", "days", "value")
