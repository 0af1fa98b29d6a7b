"""Readers with declared schemas and null policies, and the writers of the exports."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelworks.functions.scalar import null_tokens

#: Strings that stand for a missing value in the panel file.
NULL_TOKENS = ("", "NA", "null", "Unknown")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, *, null_values: Sequence[str] = (), rename: Mapping[str, str] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV with header, by a declared schema.

    ``null_values`` are read as null in every column: columns are read as text, cleaned and
    cast; a value that does not fit its type is null. ``columns`` keeps those that exist
    (by their new names), and only these are parsed.
    """
    declared = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in declared])
    raw = spark.read.csv(path, schema=text, header=True, enforceSchema=False)
    named = dict(rename or {})
    out = []
    for f in declared:
        name = named.get(f.name, f.name)
        if columns is not None and name not in columns:
            continue
        c = F.col(f"`{f.name}`")
        c = null_tokens(c, null_values) if null_values else c
        out.append((c if isinstance(f.dataType, T.StringType) else c.try_cast(f.dataType)).alias(name))
    df = raw.select(*out)
    return df if columns is None else df.select([f"`{c}`" for c in columns if c in df.columns])


def read_labels(spark: SparkSession, path: str, key: str = "gtvid", label: str = "actual_label") -> DataFrame:
    """(key, label) from CSV: rows without a key are skipped, a missing or bad label is 0."""
    raw = spark.read.csv(path, header=True)
    value = F.col(label).try_cast("int") if label in raw.columns else F.lit(0)
    return raw.where(F.trim(F.col(key)) != "").select(F.col(key), F.coalesce(value, F.lit(0)).alias(label))


def read_json_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents (one a file) by a schema; damaged ones are skipped."""
    text = spark.read.text(path, wholetext=True).where("trim(value) <> ''")
    # A damaged document gives a struct of nulls beside its text.
    parsed = text.select(F.from_json("value", f"struct<{T._parse_datatype_string(schema).add('corrupt_', 'string').simpleString()[7:]}", {"columnNameOfCorruptRecord": "corrupt_"}).alias("r"))
    return parsed.where("r.corrupt_ IS NULL").select("r.*").drop("corrupt_")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length) of the files under a folder, newest first."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "modificationTime", "length").orderBy(F.desc("modificationTime"), "path")


def table_facts(spark: SparkSession, path: str) -> tuple[T.StructType, int]:
    """Schema and number of rows of a Parquet table, from footers."""
    df = spark.read.parquet(path)
    return df.schema, df.count()


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, *, single: bool = False) -> None:
    """CSV with header; ``single`` gives one file, for small downloads only."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def training_export(df: DataFrame, target: str, threshold: float) -> DataFrame:
    """(gtvid, target, actual_label): label 1 from the threshold on."""
    return df.select("gtvid", target, F.coalesce((F.col(target) >= threshold).cast("int"), F.lit(0)).alias("actual_label"))


def non_active_export(df: DataFrame, target: str, threshold: float, auc: float, top: int = 5000) -> DataFrame:
    """Scored non-active rows by probability, highest first, with a flag for the top ones."""
    from panelworks.operators.scoring import top_flag

    rows = df.select("gtvid", "status", F.col("score").alias("predicted_probability"), F.coalesce((F.col(target) >= threshold).cast("int"), F.lit(0)).alias("actual_label"), F.lit(auc).alias("model_roc_auc"))
    return top_flag(rows, "predicted_probability", top, f"top_{top}", "gtvid").orderBy(F.desc("predicted_probability"), "gtvid")


def test_predictions_export(df: DataFrame, target: str, threshold: float, auc: float) -> DataFrame:
    """(gtvid, predicted_probability, actual_label, model_roc_auc) of the test rows, by id."""
    label = F.coalesce((F.col(target) >= threshold).cast("int"), F.lit(0))
    return df.select("gtvid", F.col("score").alias("predicted_probability"), label.alias("actual_label"), F.lit(auc).alias("model_roc_auc")).orderBy("gtvid")


def all_sites_export(df: DataFrame) -> DataFrame:
    """(gtvid, category, status, predicted_probability, rank) of every scored site, highest first; equal scores by id."""
    from panelworks.operators.scoring import _numbered

    rows = df.select("gtvid", "category", F.coalesce(F.nullif("status", F.lit("")), F.lit("Unknown")).alias("status"), F.col("score").alias("predicted_probability"))
    return _numbered(rows, [F.desc_nulls_last("predicted_probability"), F.asc("gtvid")], "rank").orderBy("rank")


def scored_export(df: DataFrame, model_type: str, experiment: str, scored_at: str | None = None) -> DataFrame:
    """``df`` with the literal columns model_type, experiment_id and scored_at (ISO time; null if not given)."""
    return df.withColumns({"model_type": F.lit(model_type), "experiment_id": F.lit(experiment), "scored_at": F.lit(scored_at).cast("string")})


def summary_text(totals: DataFrame) -> str:
    """A plain report of :func:`panelworks.operators.rollup.dataset_totals` (a row per metric)."""
    return "\n".join(f"{r['metric']}: total {r['dataset_total']:,.2f}, per active month {r['avg_per_active_month'] or 0:,.2f}" for r in totals.collect())


def to_json_text(value: object) -> str:
    return json.dumps(value, indent=2, default=str)
