"""Encoding and scaling, with fitted parameters as small tables that scoring uses again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelworks.functions.scalar import between_percentiles, boolean_text_flag, clip, yes_no_flag
from panelworks.operators.scoring import column_percentiles, percentiles

MISSING = "__MISSING__"


def encode_flags(df: DataFrame, yes_no: Sequence[str] = (), booleans: Sequence[str] = (), texts: Sequence[str] = ()) -> DataFrame:
    """<column>_encoded for Yes/No strings, boolean columns and true/false strings."""
    cols = {f"{c}_encoded": yes_no_flag(F.col(c)) for c in yes_no}
    cols |= {f"{c}_encoded": F.col(c).cast("tinyint") for c in booleans}
    cols |= {f"{c}_encoded": boolean_text_flag(F.col(c)) for c in texts}
    return df.withColumns(cols)


def one_hot(df: DataFrame, column: str, values: Sequence[str] | None = None, *, most: int = 1000) -> DataFrame:
    """One 0/1 column ``<column>_<safe value>`` per value; without a list the values are looked up.

    That look-up is one action and takes at most ``most`` values, else it raises. Null rows have 0.
    """
    if values is None:
        found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{column} has more than {most} values")
        values = sorted(r[0] for r in found)
    plain = lambda v: v.replace(" ", "_").replace("-", "_").lower()
    return df.withColumns({f"{column}_{plain(v)}": F.coalesce((F.col(column) == v).cast("tinyint"), F.lit(0).cast("tinyint")) for v in values})


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """(value): the n most frequent values, ties by value; at most n rows."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("c_")).orderBy(F.desc("c_"), "value").limit(n).select("value")


def bin_rare(df: DataFrame, column: str, top: DataFrame, other: str = "Other") -> DataFrame:
    """``column`` with all values outside ``top`` (value), and nulls, replaced by ``other``."""
    known = top.select(F.col("value").alias(column), F.lit(True).alias("known_"))
    return df.join(known, column, "left").withColumn(column, F.when(F.col("known_"), F.col(column)).otherwise(other)).drop("known_")


def label_vocabulary(df: DataFrame, column: str) -> DataFrame:
    """(value, code): sorted values numbered from 0, null as MISSING.

    The values are numbered by one window, so a vocabulary is expected to be a dictionary
    and not an id column.
    """
    values = df.select(F.coalesce(F.col(column), F.lit(MISSING)).alias("value")).distinct()
    return values.select("value", (F.row_number().over(W.orderBy("value")) - 1).alias("code"))


def label_encode(df: DataFrame, column: str, vocabulary: DataFrame, *, unseen_as_missing: bool = False) -> DataFrame:
    """<column>_code by the vocabulary; unseen values get 0 (or MISSING's code)."""
    codes = vocabulary.select(F.col("value").alias("value_"), F.col("code").alias(f"{column}_code"))
    out = df.withColumn("value_", F.coalesce(F.col(column), F.lit(MISSING))).join(codes, "value_", "left").drop("value_")
    default = F.lit(0)
    if unseen_as_missing:
        out = out.crossJoin(F.broadcast(vocabulary.agg(F.coalesce(F.max(F.when(F.col("value") == MISSING, F.col("code"))), F.lit(0)).alias("missing_"))))
        default = F.col("missing_")
    return out.withColumn(f"{column}_code", F.coalesce(F.col(f"{column}_code"), default)).drop("missing_")


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: for each column its p1, p99, and mean and population deviation after clipping to them.

    Nulls and NaN are left out of the percentiles and replaced by 0 after.
    """
    filled = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns])
    ends = column_percentiles(filled, columns, (0.01, 0.99))
    clipped = filled.crossJoin(F.broadcast(ends))  # one row
    inside = lambda c: clip(F.coalesce(F.col(c), F.lit(0.0)), F.col(f"p_{c}")[0], F.col(f"p_{c}")[1])
    moments = [x for c in columns for x in (F.avg(inside(c)).alias(f"m_{c}"), F.stddev_pop(inside(c)).alias(f"s_{c}"))]
    return clipped.agg(*[F.first(f"p_{c}").alias(f"p_{c}") for c in columns], *moments)


def scale(df: DataFrame, columns: Sequence[str], fitted: DataFrame, limit: float = 10.0) -> DataFrame:
    """<column>_z by a fitted scaler, the same for training and scoring: clip, scale, clip to +-limit.

    A column without deviation is divided by 1.
    """
    out = df.crossJoin(F.broadcast(fitted))  # one row
    for c in columns:
        x = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0))
        s = F.col(f"s_{c}")
        z = (clip(x, F.col(f"p_{c}")[0], F.col(f"p_{c}")[1]) - F.col(f"m_{c}")) / F.when(s == 0, 1.0).otherwise(s)
        out = out.withColumn(f"{c}_z", clip(z, -limit, limit))
    return out.drop(*[f"{k}_{c}" for c in columns for k in "pms"])


def prepare_target(df: DataFrame, column: str) -> DataFrame:
    """<column>_y: null and NaN as the median, clipped to p1 and p99, scaled by mean and population deviation."""
    x = F.nanvl(F.col(column).cast("double"), F.lit(None))
    ends = percentiles(df, x, (0.5,), "med_")
    filled = df.crossJoin(F.broadcast(ends)).withColumn("x_", F.coalesce(x, F.col("med_")[0])).drop("med_")
    p = percentiles(filled, "x_", (0.01, 0.99), "p_")
    filled = filled.crossJoin(F.broadcast(p)).withColumn("x_", clip(F.col("x_"), F.col("p_")[0], F.col("p_")[1])).drop("p_")
    m = filled.agg(F.avg("x_").alias("m_"), F.stddev_pop("x_").alias("s_"))
    return filled.crossJoin(F.broadcast(m)).withColumn(f"{column}_y", (F.col("x_") - F.col("m_")) / F.when(F.col("s_") == 0, 1.0).otherwise(F.col("s_"))).drop("x_", "m_", "s_")


def thresholds(df: DataFrame, column: str, lower: float, upper: float = 100.0, *, sigma: float | None = None) -> DataFrame:
    """One row (low, high): percentiles of the column, or mean + sigma deviations; high is null if open."""
    if sigma is not None:
        return df.agg((F.avg(column) + sigma * F.stddev_pop(column)).alias("low"), F.lit(None).cast("double").alias("high"))
    p = percentiles(df, column, (lower / 100, min(upper, 100) / 100))
    high = F.lit(None).cast("double") if upper >= 100 else F.col("p")[1]
    return p.select(F.col("p")[0].alias("low"), high.alias("high"))


def lookalike(df: DataFrame, column: str, limits: DataFrame, to: str = "label") -> DataFrame:
    """1 for values from low up to high (open if null), else 0."""
    rows = df.crossJoin(F.broadcast(limits))  # one row
    label = F.when(F.col("high").isNull(), between_percentiles(F.col(column), F.col("low"), None)).otherwise(between_percentiles(F.col(column), F.col("low"), F.col("high")))
    return rows.withColumn(to, label).drop("low", "high")


def feature_columns(columns: Sequence[str], preset: Sequence[str], selected: Sequence[str] | None = None, leakage: Sequence[str] = ()) -> list[str]:
    """Columns of the preset that exist, are selected (None: all) and do not leak the target, in the preset's order."""
    return [c for c in preset if c in columns and (selected is None or c in selected) and c not in leakage]


def unscale(df: DataFrame, column: str, fitted: DataFrame, of: str, to: str) -> DataFrame:
    """``to``: a value on the scale of :func:`fit_scaler`'s column ``of``, turned back into its units."""
    back = F.col(column) * F.when(F.col("s_") == 0, 1.0).otherwise(F.col("s_")) + F.col("m_")
    return df.crossJoin(F.broadcast(fitted.select(F.col(f"m_{of}").alias("m_"), F.col(f"s_{of}").alias("s_")))).withColumn(to, back).drop("m_", "s_")  # one row
