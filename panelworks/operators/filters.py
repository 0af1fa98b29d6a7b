"""Interactive filters and lookups over the entity table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_multi(df: DataFrame, filters: Mapping[str, Any], fields: Mapping[str, str]) -> DataFrame:
    """Rows that match one of the values of every field.

    ``fields`` maps names to columns. No filters at all give no rows; unknown fields, null,
    empty strings and empty lists are passed over, so that only such filters give all rows.
    """
    if not filters:
        return df.limit(0)
    for name, value in filters.items():
        values = [v for v in (value if isinstance(value, list | tuple | set) else [value]) if v is not None and v != ""]
        if name in fields and fields[name] in df.columns and values:
            df = df.where(F.col(fields[name]).isin(*values))
    return df


def filter_options(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, options): the sorted distinct values of each column that are not null or blank, as text.

    Values are made distinct over the cluster before they are listed. False of a boolean column is an option.
    """
    names = [c for c in columns if c in df.columns]
    long = df.select(*[F.col(c).cast("string").alias(c) for c in names]).unpivot([], names, "field", "value_")
    found = long.where(F.trim("value_") != "").distinct().groupBy("field").agg(F.sort_array(F.collect_list("value_")).alias("options"))
    # A field without values has no options, but its row.
    every = F.explode(F.array(*[F.lit(c) for c in names])).alias("field")
    return df.sparkSession.range(1).select(every).join(found, "field", "left").select("field", F.coalesce("options", F.array().cast("array<string>")).alias("options"))


def site_details(ids: DataFrame, details: DataFrame, coordinates: DataFrame, metrics: DataFrame) -> DataFrame:
    """Everything known of the ids (id): columns of the three tables, ``partial`` and ``sources``.

    Ids that no table has give no row; ``partial`` says that the details are missing.
    """
    marked = lambda df, name: df.withColumn(f"has_{name}", F.lit(True))
    out = ids.select("id").distinct()
    for name, table in (("details", details), ("coordinates", coordinates), ("metrics", metrics)):
        out = out.join(marked(table, name), "id", "left")
    has = [F.when(F.col(f"has_{n}"), F.lit(n)) for n in ("details", "coordinates", "metrics")]
    out = out.withColumn("sources", F.array_compact(F.array(*has))).where(F.size("sources") > 0)
    return out.withColumn("partial", F.col("has_details").isNull()).drop("has_details", "has_coordinates", "has_metrics")


def document(df: DataFrame, groups: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """(id, document): the columns as JSON, by group and display name, nulls left out."""
    parts = [F.struct(*[F.col(c).alias(label) for label, c in columns.items()]).alias(g) for g, columns in groups.items()]
    return df.select("id", F.to_json(F.struct(*parts)).alias("document"))


def in_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is among ``ids`` (left semi join)."""
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def not_active(df: DataFrame, status: str = "status", active: str = "Active") -> DataFrame:
    """Rows with another status than active; null is neither."""
    return df.where(F.col(status) != active)


def catalog(experiments: DataFrame, *, task: str | None = None, order: str = "newest") -> DataFrame:
    """Experiments of a task, by ``newest``, ``oldest`` or ``best`` (primary metric, nulls last)."""
    if task is not None:
        experiments = experiments.where(F.col("task") == task)
    by = {"newest": F.desc("created"), "oldest": F.asc("created"), "best": F.desc_nulls_last("metric")}[order]
    return experiments.orderBy(by, "name")


def feature_overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """(feature, side): shared, only_first or only_second for two sets of features."""
    a = first.select("feature").distinct().withColumn("a_", F.lit(True))
    b = second.select("feature").distinct().withColumn("b_", F.lit(True))
    side = F.when(F.col("a_") & F.col("b_"), "shared").when(F.col("a_"), "only_first").otherwise("only_second")
    return a.join(b, "feature", "full").select("feature", side.alias("side"))


def shared_by_all(sets: Sequence[DataFrame]) -> DataFrame:
    """(feature): in every one of the sets."""
    out = sets[0].select("feature")
    for s in sets[1:]:
        out = out.intersect(s.select("feature"))
    return out.distinct()


def coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: distinct ids of a, of a also in b, their share, and ids only in b."""
    x = a.select("id").distinct().withColumn("a_", F.lit(1))
    y = b.select("id").distinct().withColumn("b_", F.lit(1))
    both = x.join(y, "id", "full")
    n, shared = F.count("a_"), F.count_if(F.col("a_").isNotNull() & F.col("b_").isNotNull())
    return both.agg(n.alias("n_first"), shared.alias("n_shared"), F.try_divide(shared, n).alias("share"), F.count_if(F.col("a_").isNull()).alias("n_only_second"))


def newest_complete(experiments: DataFrame, by: str = "task") -> DataFrame:
    """For each ``by`` the experiment created last among those marked complete (ties: the greatest name)."""
    rest = [c for c in experiments.columns if c != by]
    last = F.max_by(F.struct(*rest), F.struct("created", "name")).alias("r_")
    return experiments.where("complete").groupBy(by).agg(last).select(by, "r_.*")


def beyond_newest(experiments: DataFrame, keep: int = 10) -> DataFrame:
    """The experiments that retention drops: all but the ``keep`` created last (ties by name)."""
    newest = experiments.orderBy(F.desc("created"), F.desc("name")).limit(keep).select("name")
    return experiments.join(newest, "name", "left_anti")


def temporal_split(panel: DataFrame, train_until: Column, gap_days: int = 30) -> DataFrame:
    """``part``: train up to a date, test after it and a gap; rows in the gap are left out."""
    day = F.col("date")
    part = F.when(day <= train_until, "train").when(day > F.date_add(train_until, gap_days), "test")
    return panel.withColumn("part", part).where(F.col("part").isNotNull())


def site_list(sites: DataFrame, scores: DataFrame, statuses: DataFrame, *, values: Sequence[str], unknown: str = "Unknown") -> DataFrame:
    """Every site with its values, 0 where it has none, and its status, ``unknown`` where that is missing or empty.

    Of statuses that share an id the greatest is taken; repeated sites each get a row.
    """
    first = scores.groupBy("id").agg(*[F.max(c).alias(c) for c in values])
    status = statuses.groupBy("id").agg(F.max("status").alias("status"))
    out = sites.join(first, "id", "left").join(status, "id", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(first.schema[c].dataType)) for c in values} | {"status": F.coalesce(F.nullif("status", F.lit("")), F.lit(unknown))})


def preset_union(presets: DataFrame) -> DataFrame:
    """(kind, features): the sorted features that any preset (preset, kind, feature) has, by kind."""
    return presets.select("kind", "feature").where("feature IS NOT NULL").distinct().groupBy("kind").agg(F.sort_array(F.collect_list("feature")).alias("features"))


def preset_features(presets: DataFrame, preset: str, available: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """(feature): those of a preset that the table has (feature) and, if given, that are selected."""
    out = presets.where(F.col("preset") == preset).select("feature").distinct().join(available.select("feature").distinct(), "feature", "left_semi")
    return out if selected is None else out.join(selected.select("feature").distinct(), "feature", "left_semi")
