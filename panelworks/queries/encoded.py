"""Queries: encoding, labels, filters, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.functions import scalar
from panelworks.operators import features, filters, stats
from panelworks.queries.base import FLAGS, PEOPLE, SITES, R, flags, people, query, rounded, sites, table


@query(f"SELECT c_custkey AS id, {R('CASE WHEN c_acctbal >= 0 THEN ln(c_acctbal + 1) ELSE -ln(1 - c_acctbal) END')} AS log_acctbal FROM customer")
def signed_log(spark, d):
    return rounded(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), scalar.signed_log(F.col("c_acctbal")).alias("log_acctbal")))


@query(f"""WITH {FLAGS} SELECT id, CAST(CASE yes_no WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS TINYINT) AS yes_no_encoded, CAST(open AS TINYINT) AS open_encoded,
 CAST(CASE lower(truth) WHEN 'true' THEN 1 WHEN 'false' THEN 0 END AS TINYINT) AS truth_encoded FROM flags""")
def flag_encode(spark, d):
    out = features.encode_flags(flags(spark, d), ["yes_no"], ["open"], ["truth"])
    return out.select("id", "yes_no_encoded", "open_encoded", "truth_encoded")


@query(f"WITH {FLAGS} SELECT id, CAST(coalesce(kind = 'Full Time', false) AS TINYINT) AS kind_full_time, CAST(coalesce(kind = 'part-time', false) AS TINYINT) AS kind_part_time FROM flags")
def onehot_values(spark, d):
    return features.one_hot(flags(spark, d), "kind").select("id", "kind_full_time", "kind_part_time")


@query("""WITH t AS (SELECT p_name AS v FROM part GROUP BY 1 ORDER BY count(*) DESC, p_name LIMIT 10)
SELECT p_partkey AS id, CASE WHEN p_name IN (SELECT v FROM t) THEN p_name ELSE 'Other' END AS name FROM part""")
def topn_other(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return features.bin_rare(p, "name", features.top_values(p, "name", 10)).select("id", "name")


@query(f"""WITH {SITES}, v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT coalesce(status, '__MISSING__') AS value FROM sites WHERE id % 2 = 0))
SELECT id, CAST(coalesce(code, 0) AS INTEGER) AS status_code FROM sites LEFT JOIN v ON v.value = coalesce(status, '__MISSING__')""")
def label_encode(spark, d):
    s = sites(spark, d)
    vocabulary = features.label_vocabulary(s.where("id % 2 = 0"), "status")
    return features.label_encode(s, "status", vocabulary).select("id", F.col("status_code").cast("int").alias("status_code"))


@query(f"""WITH p AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem),
c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, least(greatest(l_extendedprice, lo), hi) AS x FROM lineitem, p), m AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {R('least(greatest((x - m) / s, -10), 10)', 5)} AS price_z FROM c, m""")
def winsor_zscore(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("price"))
    return rounded(features.scale(li, ["price"], features.fit_scaler(li, ["price"])).drop("price"), 5)


@query(f"""WITH {SITES}, f AS (SELECT id, CASE WHEN id % 11 = 0 THEN NULL ELSE avg_monthly_revenue END AS y FROM sites), g AS (SELECT id, coalesce(y, (SELECT median(y) FROM f)) AS y FROM f),
p AS (SELECT quantile_cont(y, 0.01) AS lo, quantile_cont(y, 0.99) AS hi FROM g), c AS (SELECT id, least(greatest(y, lo), hi) AS y FROM g, p), m AS (SELECT avg(y) AS m, stddev_pop(y) AS s FROM c)
SELECT id, {R('(y - m) / s', 5)} AS y_y FROM c, m""")
def target_prep(spark, d):
    s = sites(spark, d).select("id", F.when(F.col("id") % 11 != 0, F.col("avg_monthly_revenue")).alias("y"))
    return rounded(features.prepare_target(s, "y").select("id", "y_y"), 5)


def _labelled(low: str, high: str) -> str:
    return f"WITH {SITES}, t AS (SELECT {low} AS low, {high} AS high FROM sites) SELECT id, CAST(coalesce(avg_monthly_revenue >= low AND (high IS NULL OR avg_monthly_revenue <= high), false) AS INTEGER) AS label FROM sites, t"


@query(_labelled("quantile_cont(avg_monthly_revenue, 0.8)", "quantile_cont(avg_monthly_revenue, 0.95)"))
def lookalike_pct(spark, d):
    s = sites(spark, d)
    return features.lookalike(s, "avg_monthly_revenue", features.thresholds(s, "avg_monthly_revenue", 80, 95)).select("id", "label")


@query(_labelled("avg(avg_monthly_revenue) + 1.5 * stddev_pop(avg_monthly_revenue)", "CAST(NULL AS DOUBLE)"))
def lookalike_sigma(spark, d):
    s = sites(spark, d)
    return features.lookalike(s, "avg_monthly_revenue", features.thresholds(s, "avg_monthly_revenue", 0, sigma=1.5)).select("id", "label")


@query(f"""WITH {SITES}, t AS (SELECT quantile_cont(avg_monthly_revenue, 0.9) AS low FROM sites)
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (avg_monthly_revenue >= low) AS BIGINT) AS n_positive, {R('any_value(low)', 3)} AS low FROM sites, t""")
def site_counts(spark, d):
    s = sites(spark, d)
    limits = features.thresholds(s, "avg_monthly_revenue", 90)
    out = features.lookalike(s, "avg_monthly_revenue", limits).agg(F.count("*").alias("n"), F.sum("label").alias("n_positive")).crossJoin(limits.select("low"))
    return rounded(out, 3)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 6) END AS ratio FROM lineitem")
def nan_to_null(spark, d):
    li = table(spark, d, "lineitem")
    bad = F.when(F.col("l_discount") != 0, F.round(F.try_divide("l_tax", "l_discount"), 6)).when(F.col("l_tax") == 0, float("nan")).otherwise(float("inf"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scalar.finite_or_null(bad).alias("ratio"))


FIELDS = {"Segment": "segment", "Nation": "nation"}


@query(f"WITH {PEOPLE} SELECT id, segment, nation FROM people WHERE segment IN ('BUILDING', 'MACHINERY') AND nation IN (3)")
def filter_multi(spark, d):
    return filters.filter_multi(people(spark, d), {"Segment": ["BUILDING", "MACHINERY"], "Nation": 3, "Unknown": "x"}, FIELDS).select("id", "segment", "nation")


@query(f"""WITH {PEOPLE}, {FLAGS} SELECT field, options FROM (SELECT 'segment' AS field, list_sort(list(DISTINCT segment)) AS options FROM people
 UNION ALL SELECT 'nation', list_sort(list(DISTINCT CAST(nation AS VARCHAR))) FROM people)""")
def filter_options(spark, d):
    return filters.filter_options(people(spark, d), ["segment", "nation"])


@query("""SELECT c0.c_custkey AS id, CASE WHEN c0.c_custkey % 2 = 0 THEN c_mktsegment END AS segment, CASE WHEN c0.c_custkey % 3 > 0 THEN c0.c_custkey * 2 END AS lat,
 CASE WHEN c0.c_custkey % 5 = 0 THEN c0.c_custkey * 3 END AS revenue, c0.c_custkey % 2 <> 0 AS partial
 FROM customer c0 WHERE (c0.c_custkey % 2 = 0 OR c0.c_custkey % 3 > 0 OR c0.c_custkey % 5 = 0)""")
def site_detail_partial(spark, d):
    c = table(spark, d, "customer").withColumn("id", F.col("c_custkey"))
    ids = c.select("id")
    details = c.where("id % 2 = 0").select("id", F.col("c_mktsegment").alias("segment"))
    coordinates = c.where("id % 3 > 0").select("id", (F.col("id") * 2).alias("lat"))
    metrics = c.where("id % 5 = 0").select("id", (F.col("id") * 3).alias("revenue"))
    return filters.site_details(ids, details, coordinates, metrics).select("id", "segment", "lat", "revenue", "partial")


@query(f"WITH {PEOPLE}, {SITES} SELECT id, p FROM people WHERE id IN (SELECT id FROM sites WHERE status = 'Active')")
def semi_filtered(spark, d):
    return filters.in_ids(people(spark, d), sites(spark, d).where("status = 'Active'")).select("id", "p")


@query(f"WITH {SITES} SELECT id, status FROM sites WHERE status <> 'Active'")
def non_active(spark, d):
    return filters.not_active(sites(spark, d)).select("id", "status")


def _experiments(spark, d):
    return table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "regression").otherwise("classification").alias("task"), F.col("s_suppkey").alias("created"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("metric"))


@query("""SELECT s_name AS name, 'regression' AS task, s_suppkey AS created, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS metric FROM supplier WHERE s_suppkey % 2 = 0
 ORDER BY metric DESC NULLS LAST, name""")
def catalog_best(spark, d):
    return filters.catalog(_experiments(spark, d), task="regression", order="best")


@query("""WITH a AS (SELECT DISTINCT p_name AS feature FROM part WHERE p_size < 5), b AS (SELECT DISTINCT p_name AS feature FROM part WHERE p_size > 45)
SELECT feature, CASE WHEN a.feature IS NOT NULL AND b.feature IS NOT NULL THEN 'shared' WHEN a.feature IS NOT NULL THEN 'only_first' ELSE 'only_second' END AS side FROM a FULL JOIN b USING (feature)""")
def feature_overlap(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_name", "feature")
    return filters.feature_overlap(p.where("p_size < 5"), p.where("p_size > 45"))


@query("""SELECT feature FROM (SELECT p_name AS feature FROM part WHERE p_size < 10 INTERSECT SELECT p_name FROM part WHERE p_size BETWEEN 20 AND 30 INTERSECT SELECT p_name FROM part WHERE p_size > 40)""")
def feature_intersection(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_name", "feature")
    return filters.shared_by_all([p.where("p_size < 10"), p.where("p_size BETWEEN 20 AND 30"), p.where("p_size > 40")])


@query("""WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 400000)
SELECT CAST(count(a.id) AS BIGINT) AS n_first, CAST(count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS BIGINT) AS n_shared,
 round(CAST(count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS DOUBLE) / count(a.id), 6) AS share, CAST(count(*) FILTER (a.id IS NULL) AS BIGINT) AS n_only_second FROM a FULL JOIN b USING (id)""")
def id_coverage(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "id")
    return rounded(filters.coverage(o.where("o_orderstatus = 'F'"), o.where("o_totalprice > 400000")))


@query("SELECT o_orderkey AS id, strftime(make_timestamp((800000000 + o_orderkey * 1000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 3 = 0")
def job_times(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    name = F.when(F.col("id") % 3 == 0, "job_x_ab").otherwise(F.concat(F.lit("job_"), (F.col("id") * 1000 + 800000000).cast("string"), F.lit("_ab")))
    return o.select("id", scalar.job_time(name).alias("at"))


@query(f"WITH {FLAGS} SELECT id, lower(truth) IN ('true', '1', 'yes', 't') AS truth, coalesce(lower(kind) IN ('true', '1', 'yes', 't'), false) AS kind, replace(replace(lower(kind), ' ', '_'), '-', '_') AS safe FROM flags")
def boolean_edge(spark, d):
    return flags(spark, d).select("id", scalar.truthy(F.col("truth")).alias("truth"), scalar.truthy(F.col("kind")).alias("kind"), scalar.safe_name(F.col("kind")).alias("safe"))


@query("""SELECT 'kind' AS "column", CAST(count(*) FILTER (kind IS NULL) AS BIGINT) AS n_null FROM flags UNION ALL SELECT 'open', CAST(count(*) FILTER (open IS NULL) AS BIGINT) FROM flags""".replace("SELECT 'kind'", f"WITH {FLAGS} SELECT 'kind'", 1))
def null_census(spark, d):
    return stats.null_census(flags(spark, d), ["id", "yes_no", "open", "kind"])
