"""Relative strength: short over long trailing means, all horizons and metrics in one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (short, long) days of the horizons.
HORIZONS = ((95, 185), (185, 370), (370, 740))
EPSILON = 1e-6


def relative_strength(
    panel: DataFrame,
    metrics: Mapping[str, str],
    horizons: Sequence[tuple[int, int]] = HORIZONS,
    *,
    least: int = 2,
    as_of: Column | None = None,
    only_recent: bool = False,
) -> DataFrame:
    """(id, rs_<name>_<short>_<long>, ...) for metrics {name: column}; the suffix only with several horizons.

    Windows end at the panel's last date (at ``as_of``: later rows are left out) and hold both
    ends. (short mean + 1e-6) / (long mean + 1e-6) with at least ``least`` values in both, else
    1. ``only_recent`` drops ids without a row in the first short window. Columns that the panel
    lacks are skipped.
    """
    if as_of is not None:
        panel = panel.where(F.col("date") <= as_of)
    end = F.broadcast(panel.agg(F.max("date").alias("end_")))  # one row
    rows = panel.crossJoin(end)
    wanted = {n: c for n, c in metrics.items() if c in panel.columns}
    aggs = []
    for name, column in wanted.items():
        for days in sorted({d for h in horizons for d in h}):
            inside = F.when(F.col("date") >= F.date_sub("end_", days), F.col(column))
            aggs += [F.avg(inside).alias(f"a_{name}_{days}"), F.count(inside).alias(f"c_{name}_{days}")]
    recent = F.count_if(F.col("date") >= F.date_sub("end_", horizons[0][0])).alias("recent_")
    grouped = rows.groupBy("id").agg(recent, *aggs)
    out = []
    for name in wanted:
        for s, l in horizons:
            enough = (F.col(f"c_{name}_{s}") >= least) & (F.col(f"c_{name}_{l}") >= least)
            ratio = (F.col(f"a_{name}_{s}") + EPSILON) / (F.col(f"a_{name}_{l}") + EPSILON)
            value = F.coalesce(F.nanvl(F.when(enough, ratio), F.lit(1.0)), F.lit(1.0))
            out.append(value.alias(f"rs_{name}_{s}_{l}" if len(horizons) > 1 else f"rs_{name}"))
    if only_recent:
        grouped = grouped.where("recent_ > 0")
    return grouped.select("id", *out)


def prior_mean(panel: DataFrame, metric: str, rows: int = 30) -> DataFrame:
    """The mean of the ``rows`` rows before each one, by date within its id; null at the first."""
    from pyspark.sql import Window as W

    frame = W.partitionBy("id").orderBy("date").rowsBetween(-rows, -1)
    return panel.withColumn(f"prior_{metric}", F.avg(metric).over(frame))
