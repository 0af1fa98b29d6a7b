"""The driver tables as panel, entity and score tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its DuckDB SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def R(expression: str, digits: int = 6) -> str:
    """SQL: rounded, without negative zero; a nudge keeps exact halves from going either way."""
    return f"(round(({expression}) + 1e-{digits + 3}, {digits}) + 0)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded as :func:`R` does."""
    return df.select([(F.round(F.col(c) + 10.0 ** -(digits + 3), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def round_binary(x: Column, digits: int) -> Column:
    """x rounded as SQL does it for doubles: scaled, rounded to a whole number, scaled back (Spark rounds the decimal that it prints)."""
    return F.round(x * 10.0**digits) / 10.0**digits


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'Active' WHEN 'O' THEN 'Removed' END"


def panel(spark: SparkSession, d: str) -> DataFrame:
    """(id, date, revenue, impressions, status, priority): orders by customer and month, latest attributes."""
    o = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "Active").when(F.col("o_orderstatus") == "O", "Removed"))
    last = F.max_by(F.struct("status", "o_orderpriority"), F.struct("o_orderdate", "o_orderkey")).alias("l")
    g = o.groupBy(F.col("o_custkey").alias("id"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date"))
    return g.agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count("*").alias("impressions"), last).select("id", "date", "revenue", "impressions", "l.status", F.col("l.o_orderpriority").alias("priority"))


PANEL = f"""panel AS (SELECT o_custkey AS id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
 round(sum(o_totalprice), 2) AS revenue, CAST(count(*) AS BIGINT) AS impressions,
 arg_max_null({STATUS_SQL}, row(o_orderdate, o_orderkey)) AS status,
 arg_max_null(o_orderpriority, row(o_orderdate, o_orderkey)) AS priority FROM orders GROUP BY 1, 2)"""


def active_days(spark: SparkSession, d: str) -> DataFrame:
    """(id, date, active_days): days with orders; some months unknown, some with 0."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date"), "o_orderdate")
    m = F.col("id") + F.month("date")
    g = o.where(m % 5 != 0).groupBy("id", "date").agg(F.countDistinct("o_orderdate").alias("n"))
    return g.select("id", "date", F.when(m % 7 == 0, 0).otherwise(F.col("n")).cast("long").alias("active_days"))


ACTIVE_DAYS = """active_days AS (SELECT id, date, CAST(CASE WHEN (id + month(date)) % 7 = 0 THEN 0 ELSE n END AS BIGINT) AS active_days FROM
 (SELECT o_custkey AS id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(DISTINCT o_orderdate) AS n FROM orders GROUP BY 1, 2)
 WHERE (id + month(date)) % 5 <> 0)"""


def sites(spark: SparkSession, d: str) -> DataFrame:
    """(id, active_months, total_revenue, avg_monthly_revenue, status, priority), one row per customer with orders."""
    from panelworks.operators.rollup import site_rollup

    s = site_rollup(panel(spark, d), ["revenue"], ["status", "priority"])
    return s.select("id", "active_months", F.round("total_revenue", 2).alias("total_revenue"), F.round("avg_monthly_revenue", 6).alias("avg_monthly_revenue"), "status", "priority")


SITES = PANEL + """, sites AS (SELECT id, CAST(count(*) AS BIGINT) AS active_months, round(sum(revenue), 2) AS total_revenue,
 round(sum(revenue) / count(*), 6) AS avg_monthly_revenue, arg_max_null(status, date) AS status, arg_max_null(priority, date) AS priority
 FROM panel GROUP BY id)"""


def people(spark: SparkSession, d: str) -> DataFrame:
    """(id, segment, nation, acctbal, p, q, label, lat, lon): customers with two scores, a label and a place."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("acctbal"))
    c = c.withColumn("p", F.round((F.col("acctbal") + 1000) / 11000, 6))
    c = c.withColumn("q", F.round((F.col("id") * 104729 % 1000).cast("double") / 2000 + F.col("p") / 2, 7))
    c = c.withColumn("label", ((F.col("id") * 7919 % 100).cast("double") < F.col("p") * 100).cast("int"))
    return c.withColumn("lat", 25 + (F.col("id") * 37 % 2400).cast("double") / 100).withColumn("lon", -125 + (F.col("id") * 91 % 5500).cast("double") / 100)


PEOPLE = """people0 AS (SELECT c_custkey AS id, c_mktsegment AS segment, c_nationkey AS nation, c_acctbal AS acctbal, round((c_acctbal + 1000) / 11000, 6) AS p FROM customer),
people AS (SELECT *, round(CAST(id * 104729 % 1000 AS DOUBLE) / 2000 + p / 2, 7) AS q,
 CAST(CAST(id * 7919 % 100 AS DOUBLE) < p * 100 AS INTEGER) AS label,
 25 + CAST(id * 37 % 2400 AS DOUBLE) / 100 AS lat, -125 + CAST(id * 91 % 5500 AS DOUBLE) / 100 AS lon FROM people0)"""


def stores(spark: SparkSession, d: str) -> DataFrame:
    """(id, lat, lon): suppliers as places of interest."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return s.withColumn("lat", 25 + (F.col("id") * 53 % 2400).cast("double") / 100).withColumn("lon", -125 + (F.col("id") * 67 % 5500).cast("double") / 100)


STORES = "stores AS (SELECT s_suppkey AS sid, 25 + CAST(s_suppkey * 53 % 2400 AS DOUBLE) / 100 AS slat, -125 + CAST(s_suppkey * 67 % 5500 AS DOUBLE) / 100 AS slon FROM supplier)"


def miles_sql(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 3958.8 * asin(sqrt(least(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2), 1.0))))"


def flags(spark: SparkSession, d: str) -> DataFrame:
    """(id, yes_no, truth, open, kind): flags of order lines in the forms that sources use."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_returnflag").alias("f"), F.max("l_linestatus").alias("s"), F.max("l_quantity").alias("m"))
    return li.select("id", F.when(F.col("f") == "A", "Yes").when(F.col("f") == "N", "No").otherwise("Unknown").alias("yes_no"), F.when(F.col("s") == "O", "TRUE").otherwise("false").alias("truth"), F.when(F.col("m") < 45, F.col("m") > 30).alias("open"), F.when(F.col("m") > 48, "Full Time").when(F.col("m") > 40, "part-time").alias("kind"))


FLAGS = """flags AS (SELECT l_orderkey AS id, CASE min(l_returnflag) WHEN 'A' THEN 'Yes' WHEN 'N' THEN 'No' ELSE 'Unknown' END AS yes_no,
 CASE WHEN max(l_linestatus) = 'O' THEN 'TRUE' ELSE 'false' END AS truth, CASE WHEN max(l_quantity) < 45 THEN max(l_quantity) > 30 END AS open,
 CASE WHEN max(l_quantity) > 48 THEN 'Full Time' WHEN max(l_quantity) > 40 THEN 'part-time' END AS kind FROM lineitem GROUP BY 1)"""
