"""Session settings for large runs, and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "panelworks", **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC; ``conf`` overrides (dots as __).

    ANSI mode stays on. Shuffle partitions are left to the cluster: adaptive execution joins
    small ones, so a number for the largest shuffle does no harm to the others.
    """
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for one intermediate table under the session's ``spark.checkpoint.dir``.

    Where that setting is absent a temporary folder is chosen, but only if the session runs
    in one process; on a cluster no other machine could read it, so this raises. The folder
    is deleted when the driver's Python ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = Path(tempfile.mkdtemp(prefix="panelworks-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/panelworks-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already; the folder is only scratch
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared scratch folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
