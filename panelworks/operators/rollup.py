"""Panels to one row per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(c: str) -> Column:
    """Sum that is 0 and not null where nothing is there."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def daily_rates(panel: DataFrame, active_days: DataFrame, metric: str = "revenue") -> DataFrame:
    """The panel with ``active_days`` and ``daily_<metric>`` by a left join on (id, date).

    Null where no days are known, 0 where there were 0 days, else metric over days.
    """
    joined = panel.join(active_days, ["id", "date"], "left")
    days = F.col("active_days")
    rate = F.when(days.isNull(), F.lit(None)).when(days == 0, 0.0).otherwise(F.try_divide(F.col(metric), days))
    return joined.withColumn(f"daily_{metric}", rate)


def site_rollup(panel: DataFrame, metrics: Sequence[str], attributes: Sequence[str], *, order: Sequence[str] = ("date",)) -> DataFrame:
    """One row per id: months, first and last date, total_ and avg_monthly_ of metrics, latest attributes.

    Latest means of the row that is last by ``order``, nulls included. One shuffle; every
    aggregate combines before it.
    """
    totals = [total(m).alias(f"total_{m}") for m in metrics]
    latest = F.max_by(F.struct(*attributes), F.struct(*order)).alias("latest_")
    grouped = panel.groupBy("id").agg(F.count("*").alias("active_months"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), *totals, latest)
    months = F.col("active_months")
    return grouped.select(
        "id", "active_months", "first_date", "last_date",
        *[f"total_{m}" for m in metrics],
        *[F.try_divide(F.col(f"total_{m}"), months).alias(f"avg_monthly_{m}") for m in metrics],
        *[F.col(f"latest_.{a}").alias(a) for a in attributes],
    )


def average_daily(rated: DataFrame, metric: str = "revenue") -> DataFrame:
    """(id, total_active_days, avg_daily): mean of the daily rates; without one, total over 30 days a month."""
    fallback = F.try_divide(total(metric), F.count("*") * 30)
    return rated.groupBy("id").agg(
        F.coalesce(F.sum("active_days"), F.lit(0)).alias("total_active_days"),
        F.coalesce(F.avg(f"daily_{metric}"), fallback).alias("avg_daily"),
    )


def first_non_null(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """For each id the first value of every column that is not null, by ``order``."""
    return df.groupBy("id").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])


def dataset_totals(sites: DataFrame, families: Sequence[str]) -> DataFrame:
    """(metric, dataset_total, avg_per_active_month) of the total_ columns, in one pass."""
    months = F.sum("active_months")
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("metric"), F.col(f"sum_{f}").alias("dataset_total")) for f in families])).alias("s")
    sums = sites.agg(months.alias("months"), *[F.sum(f"total_{f}").alias(f"sum_{f}") for f in families])
    return sums.select("months", stacked).select("s.metric", "s.dataset_total", F.try_divide(F.col("s.dataset_total"), F.col("months")).alias("avg_per_active_month"))
