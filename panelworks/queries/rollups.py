"""Queries: activity, roll-up, momentum, geography."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.operators import activity, geo, momentum, rollup, stats
from panelworks.queries.base import ACTIVE_DAYS, PANEL, PEOPLE, SITES, STORES, R, active_days, miles_sql, panel, people, query, rounded, sites, stores, table


def _daily(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.to_date("ts").alias("date"), "event_type", "value", F.concat(F.lit("G"), F.col("user_id").cast("string")).alias("gtvid"))
    t = e.where("event_type = 'purchase'").select("id", "date", F.floor("value").alias("transactions"), "gtvid")
    s = e.where("event_type IN ('signup', 'error')").select("id", "date", F.when(F.col("event_type") == "signup", "Active").otherwise("Error").alias("status"), "gtvid")
    return t, s


@query("""WITH t AS (SELECT user_id AS id, CAST(ts AS DATE) AS date, min(floor(value)) AS txn FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
s AS (SELECT user_id AS id, CAST(ts AS DATE) AS date, min(CASE WHEN event_type = 'signup' THEN 'Active' ELSE 'Error' END) AS status FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1, 2),
j AS (SELECT id, date, txn, status FROM t FULL JOIN s USING (id, date))
SELECT id, strftime(date, '%Y-%m') AS year_month, 'G' || CAST(id AS VARCHAR) AS gtvid, CAST(count(*) FILTER (status = 'Active') AS INTEGER) AS active_days,
 CAST(count(*) FILTER (txn > 0) AS INTEGER) AS transaction_days, CAST(count(*) AS INTEGER) AS total_days_in_data FROM j GROUP BY 1, 2""")
def monthly_activity(spark, d):
    return activity.monthly_activity(*_daily(spark, d))


@query(f"""WITH {PANEL} SELECT id, CAST(count(*) AS BIGINT) AS active_months, min(date) AS first_date, max(date) AS last_date, {R('sum(revenue)', 2)} AS total_revenue,
 CAST(sum(impressions) AS DOUBLE) AS total_impressions, {R('sum(revenue) / count(*)')} AS avg_monthly_revenue, {R('CAST(sum(impressions) AS DOUBLE) / count(*)')} AS avg_monthly_impressions,
 arg_max_null(status, date) AS status, arg_max_null(priority, date) AS priority FROM panel GROUP BY id""")
def site_rollup(spark, d):
    out = rollup.site_rollup(panel(spark, d), ["revenue", "impressions"], ["status", "priority"])
    return rounded(out.withColumn("total_revenue", F.round("total_revenue", 2)).withColumn("total_impressions", F.col("total_impressions").cast("double")))


@query("""SELECT o_custkey AS id, arg_min(o_orderpriority, row(o_orderdate, o_orderkey)) FILTER (o_orderstatus <> 'P') AS priority,
 arg_min(o_totalprice, row(o_orderdate, o_orderkey)) FILTER (o_totalprice > 100000) AS price FROM orders GROUP BY 1""")
def first_nonnull_attrs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderdate", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("price"))
    return rollup.first_non_null(o, ["priority", "price"], ["o_orderdate", "o_orderkey"])


RATED = f"""{PANEL}, {ACTIVE_DAYS}, rated AS (SELECT p.id, p.date, revenue, a.active_days,
 CASE WHEN a.active_days IS NULL THEN NULL WHEN a.active_days = 0 THEN 0 ELSE revenue / a.active_days END AS daily FROM panel p LEFT JOIN active_days a ON a.id = p.id AND a.date = p.date)"""


@query(f"WITH {RATED} SELECT id, date, active_days, {R('daily', 4)} AS daily_revenue FROM rated")
def daily_rates(spark, d):
    return rounded(rollup.daily_rates(panel(spark, d), active_days(spark, d)).select("id", "date", "active_days", "daily_revenue"), 4)


@query(f"""WITH {RATED} SELECT id, CAST(coalesce(sum(active_days), 0) AS BIGINT) AS total_active_days, {R('coalesce(avg(daily), sum(revenue) / (count(*) * 30))', 4)} AS avg_daily FROM rated GROUP BY id""")
def daily_rate_fallback(spark, d):
    return rounded(rollup.average_daily(rollup.daily_rates(panel(spark, d), active_days(spark, d))), 4)


def _rs(metric: str, s: int, l: int) -> str:
    a = lambda n: f"avg({metric}) FILTER (date >= e - {n})"
    c = lambda n: f"count({metric}) FILTER (date >= e - {n})"
    return R(f"CASE WHEN {c(s)} >= 2 AND {c(l)} >= 2 THEN ({a(s)} + 1e-6) / ({a(l)} + 1e-6) ELSE 1 END")


ENDED = "ended AS (SELECT panel.*, (SELECT max(date) FROM panel) AS e FROM panel)"


@query(f"WITH {PANEL}, {ENDED} SELECT id, {_rs('revenue', 185, 370)} AS rs_revenue FROM ended GROUP BY id HAVING count(*) FILTER (date >= e - 185) > 0")
def relative_strength(spark, d):
    return rounded(momentum.relative_strength(panel(spark, d), {"revenue": "revenue"}, [(185, 370)], only_recent=True))


@query(f"WITH {PANEL}, {ENDED} SELECT id, " + ", ".join(f"{_rs(m, s, l)} AS rs_{n}_{s}_{l}" for n, m in (("Revenue", "revenue"), ("Impressions", "impressions")) for s, l in momentum.HORIZONS) + " FROM ended GROUP BY id")
def relative_strength_multi(spark, d):
    return rounded(momentum.relative_strength(panel(spark, d), {"Revenue": "revenue", "Impressions": "impressions", "Absent": "nvis"}))


@query(f"WITH {PANEL}, early AS (SELECT * FROM panel WHERE date <= DATE '1999-12-31'), ended AS (SELECT early.*, (SELECT max(date) FROM early) AS e FROM early) SELECT id, {_rs('revenue', 95, 185)} AS rs_revenue FROM ended GROUP BY id")
def relative_strength_asof(spark, d):
    return rounded(momentum.relative_strength(panel(spark, d), {"revenue": "revenue"}, [(95, 185)], as_of=F.lit("1999-12-31").cast("date")))


@query(f"WITH {PANEL} SELECT id, date, {R('avg(revenue) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)', 4)} AS prior_revenue FROM panel")
def rolling_prior(spark, d):
    return rounded(momentum.prior_mean(panel(spark, d), "revenue").select("id", "date", "prior_revenue"), 4)


@query(f"""WITH {PANEL}, s AS (SELECT id, count(*) AS m, sum(revenue) AS a, sum(impressions) AS b FROM panel GROUP BY id)
SELECT 'revenue' AS metric, {R('sum(a)', 0)} AS dataset_total, {R('sum(a) / sum(m)', 2)} AS avg_per_active_month FROM s
UNION ALL SELECT 'impressions', CAST(sum(b) AS DOUBLE), {R('CAST(sum(b) AS DOUBLE) / CAST(sum(m) AS DOUBLE)', 2)} FROM s""")
def dataset_totals(spark, d):
    s = rollup.site_rollup(panel(spark, d), ["revenue", "impressions"], ["status"]).withColumn("total_impressions", F.col("total_impressions").cast("double"))
    out = rollup.dataset_totals(s, ["revenue", "impressions"])
    return out.select("metric", (F.round("dataset_total", 0) + 0.0).alias("dataset_total"), (F.round("avg_per_active_month", 2) + 0.0).alias("avg_per_active_month"))


@query(f"WITH {SITES} SELECT status AS value, CAST(count(*) AS BIGINT) AS n, {R('CAST(count(*) AS DOUBLE) / sum(count(*)) OVER ()')} AS share FROM sites GROUP BY status")
def status_distribution(spark, d):
    return rounded(stats.value_counts(sites(spark, d), "status"))


@query(f"""WITH {PEOPLE}, n AS (SELECT n_nationkey AS k, n_name, n_regionkey FROM nation), o AS (SELECT o_custkey AS k, min(o_totalprice) AS least FROM orders GROUP BY 1)
SELECT id, n_name AS nation_name, least AS least_price FROM people LEFT JOIN n ON n.k = people.nation LEFT JOIN o ON o.k = people.id""")
def geo_left_joins(spark, d):
    c = people(spark, d).withColumnRenamed("id", "cid").withColumnRenamed("nation", "id")
    c = geo.left_join_all(c, [(table(spark, d, "nation"), "n_nationkey", ["n_name"])])
    c = c.drop("id").withColumnRenamed("cid", "id")
    c = geo.left_join_all(c, [(table(spark, d, "orders"), "o_custkey", ["o_totalprice"])])
    return c.select("id", F.col("n_name").alias("nation_name"), F.col("o_totalprice").alias("least_price"))


@query("SELECT id, arg_min(name, row(price, name)) AS name, min(price) AS price FROM (SELECT l_suppkey AS id, 'Part#' || CAST(l_partkey AS VARCHAR) AS name, l_extendedprice AS price FROM lineitem) GROUP BY id")
def interstate_min(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.concat(F.lit("Part#"), F.col("l_partkey").cast("string")).alias("name"), F.col("l_extendedprice").alias("price"))
    return geo.nearest_of_many(li, "name", "price")


@query(f"""WITH {STORES}, m AS (SELECT a.sid AS id, b.sid AS other, {miles_sql('a.slat', 'a.slon', 'b.slat', 'b.slon')} AS miles FROM stores a JOIN stores b ON a.sid <> b.sid)
SELECT id, {R('min(miles)', 4)} AS miles FROM m GROUP BY id""")
def nearest_self(spark, d):
    s = stores(spark, d)
    return rounded(geo.nearest(s, s, exclude_self=True, cell=2.0).select("id", "miles"), 4)


@query(f"""WITH {PEOPLE}, {STORES}, m AS (SELECT id, sid, {miles_sql('lat', 'lon', 'slat', 'slon')} AS miles FROM people CROSS JOIN stores) SELECT id, {R('min(miles)', 4)} AS miles FROM m GROUP BY id""")
def nearest_poi(spark, d):
    return rounded(geo.nearest(people(spark, d), stores(spark, d), cell=2.0).select("id", "miles"), 4)


def _segments(spark, d):
    s = stores(spark, d)
    return s.select(F.concat(F.lit("I-"), F.col("id").cast("string")).alias("line"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), (F.col("lat") + 1).alias("lat2"), (F.col("lon") + 3).alias("lon2"))


@query(f"""WITH {PEOPLE}, {STORES}, seg AS (SELECT slat AS lat1, slon AS lon1, slat + 1 AS lat2, slon + 3 AS lon2 FROM stores),
v AS (SELECT id, (lon1 - lon) * cos(radians(lat)) AS ax, lat1 - lat AS ay, (lon2 - lon) * cos(radians(lat)) AS bx, lat2 - lat AS by_ FROM people CROSS JOIN seg),
t AS (SELECT *, least(greatest(-(ax * (bx - ax) + ay * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 0), 1) AS t FROM v),
m AS (SELECT id, sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (by_ - ay), 2)) * (3958.8 * pi() / 180) AS miles FROM t)
SELECT id, {R('min(miles)', 4)} AS miles FROM m GROUP BY id""")
def nearest_segment(spark, d):
    return rounded(geo.nearest_segment(people(spark, d), _segments(spark, d)).select("id", "miles"), 4)


#: Corners (lat, lon) of a test area.
AREA = ((30.005, -110.005), (45.005, -112.005), (40.005, -95.005), (31.005, -90.005))


def _crossings() -> str:
    parts = []
    for (a, x), (b, y) in zip(AREA, [*AREA[1:], AREA[0]], strict=True):
        parts.append(f"CAST(lat >= {min(a, b)} AND lat < {max(a, b)} AND lon < {x} + (lat - {a}) / CAST({b} - {a} AS DOUBLE) * ({y} - ({x})) AS INTEGER)")
    return " + ".join(parts)


@query(f"WITH {PEOPLE} SELECT id, lat, lon FROM people WHERE ({_crossings()}) % 2 = 1")
def point_in_polygon(spark, d):
    return geo.within(people(spark, d), AREA).select("id", "lat", "lon")
