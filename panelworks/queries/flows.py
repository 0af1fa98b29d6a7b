"""Queries: a stream's closed months, and lines that come from shape files."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.operators import geo
from panelworks.queries.base import PEOPLE, STORES, R, people, query, rounded, stores, table
from panelworks.session import scratch_path
from panelworks.sources import shapes
from panelworks.streaming import months


@query(f"""WITH days AS (SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS value FROM orders GROUP BY 1, 2),
m AS (SELECT id, date_trunc('month', day) AS month, count(*) AS days, sum(value) AS value FROM days GROUP BY 1, 2)
SELECT id, strftime(month, '%Y-%m') AS year_month, CAST(days AS BIGINT) AS days, {R('value', 2)} AS value FROM m WHERE month + INTERVAL 1 MONTH <= (SELECT max(o_orderdate) FROM orders) - INTERVAL 2 DAY""")
def stream_months(spark, d):
    """Orders as a stream: the months that the watermark has closed."""
    # A pattern, as a stream's source may be one file or a folder.
    source = spark.readStream.schema(table(spark, d, "orders").schema).parquet(f"{d}/orders.parque[t]")
    rows = source.select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"))
    return rounded(months.collect_closed(rows, scratch_path(spark, "months")), 2)


@query(f"""WITH {PEOPLE}, {STORES}, seg AS (SELECT slat AS lat1, slon AS lon1, slat + 1 AS lat2, slon + 3 AS lon2 FROM stores UNION ALL SELECT slat + 1, slon + 3, slat + 0.5, slon + 5 FROM stores),
v AS (SELECT id, (lon1 - lon) * cos(radians(lat)) AS ax, lat1 - lat AS ay, (lon2 - lon) * cos(radians(lat)) AS bx, lat2 - lat AS by_ FROM people CROSS JOIN seg WHERE lat BETWEEN 30 AND 40 AND lon BETWEEN -115 AND -90),
t AS (SELECT *, least(greatest(-(ax * (bx - ax) + ay * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 0), 1) AS t FROM v),
m AS (SELECT id, sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (by_ - ay), 2)) * (3958.8 * pi() / 180) AS miles FROM t)
SELECT id, {R('min(miles)', 4)} AS miles FROM m GROUP BY id HAVING min(miles) <= 50""")
def road_distances(spark, d):
    """Lines of two segments, written as shape files and read back for an area, and the nearest within 50 miles."""
    corner = lambda y, x: F.struct((F.col("lat") + y).alias("lat"), (F.col("lon") + x).alias("lon"))
    lines = stores(spark, d).select(F.concat(F.lit("I-"), F.col("id").cast("string")).alias("line"), F.array(corner(0.0, 0.0), corner(1.0, 3.0), corner(0.5, 5.0)).alias("points"))
    path = scratch_path(spark, "roads")
    shapes.write_lines(lines, path)
    # 50 miles are less than a degree of latitude, and less than 1.1 degrees of longitude at 45 degrees.
    read = shapes.read_lines(spark, path, box=(29.0, -116.1, 41.0, -88.9))
    near = people(spark, d).where("lat BETWEEN 30 AND 40 AND lon BETWEEN -115 AND -90")
    return rounded(geo.nearest_segment(near, shapes.segments_of(read), limit=50.0).select("id", "miles"), 4)
