"""Daily tables to monthly activity of every entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by ``order``: aggregates before the shuffle, no window."""
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("row_")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"row_.{c}").alias(c) for c in rest])


def monthly_activity(transactions: DataFrame, status: DataFrame, *, active: str = "Active") -> DataFrame:
    """(id, year_month, gtvid, active_days, transaction_days, total_days_in_data).

    transactions: id, date, transactions, gtvid; status: id, date, status, gtvid; either may
    repeat days, of which the first (by gtvid and value) counts. Days of both tables are
    joined fully, so a month is there if either has it.
    """
    t = first_by(transactions.select("id", "date", "transactions", F.col("gtvid").alias("gtvid_t")), ["id", "date"], ["gtvid_t", "transactions"])
    s = first_by(status.select("id", "date", "status", F.col("gtvid").alias("gtvid_s")), ["id", "date"], ["gtvid_s", "status"])
    days = t.join(s, ["id", "date"], "full").select(
        "id",
        F.date_format("date", "yyyy-MM").alias("year_month"),
        F.coalesce("gtvid_t", "gtvid_s").alias("gtvid"),
        F.coalesce(F.col("status") == active, F.lit(False)).alias("active"),
        F.coalesce(F.col("transactions") > 0, F.lit(False)).alias("sold"),
    )
    return days.groupBy("id", "year_month").agg(
        F.min("gtvid").alias("gtvid"),
        F.count_if("active").cast("int").alias("active_days"),
        F.count_if("sold").cast("int").alias("transaction_days"),
        F.count("*").cast("int").alias("total_days_in_data"),
    )


def active_days_per_month(days: DataFrame) -> DataFrame:
    """The largest of the active days reported for an (id, date); reports may repeat."""
    return days.groupBy("id", "date").agg(F.max("active_days").alias("active_days"))
