"""Queries: documents and labels for people, experiment retention, temporal splits, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.functions import scalar
from panelworks.operators import activity, explain, features, filters, geo, momentum, scoring, stats
from panelworks.plans import ml
from panelworks.plans import sites as site_plans
from panelworks.queries.base import ACTIVE_DAYS, PANEL, PEOPLE, SITES, R, active_days, panel, people, query, rounded, sites, table
from panelworks.sources import io


def _experiments(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("task"), (F.col("s_suppkey") % 13).alias("created"), (F.col("s_acctbal") > 0).alias("complete"))


@query("""SELECT s_nationkey AS task, arg_max(s_name, row(s_suppkey % 13, s_name)) AS name, max(s_suppkey % 13) AS created, true AS complete FROM supplier WHERE s_acctbal > 0 GROUP BY 1""")
def newest_complete(spark, d):
    return filters.newest_complete(_experiments(spark, d))


@query("SELECT s_name AS name FROM (SELECT s_name, row_number() OVER (ORDER BY s_suppkey % 13 DESC, s_name DESC) AS r FROM supplier) WHERE r > 5")
def retention_drops(spark, d):
    return filters.beyond_newest(_experiments(spark, d), 5).select("name")


@query(f"""WITH {PANEL} SELECT CASE WHEN date <= DATE '1999-06-01' THEN 'train' ELSE 'test' END AS part, CAST(count(*) AS BIGINT) AS n, min(date) AS first_date, max(date) AS last_date
FROM panel WHERE date <= DATE '1999-06-01' OR date > DATE '1999-08-30' GROUP BY 1""")
def temporal_split(spark, d):
    split = filters.temporal_split(panel(spark, d), F.lit("1999-06-01").cast("date"), 90)
    return split.groupBy("part").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query(f"WITH {PEOPLE} SELECT id, {R('1 / (1 + exp(-1.702 * (0.5 + (p - 0.7)) / 0.5))')} AS open, {R('least(greatest(0.5 + (p - 0.7) * 2, 0), 1)')} AS gate FROM people")
def stochastic_gates(spark, d):
    c = people(spark, d)
    return rounded(c.select("id", scalar.gate_probability(F.col("p") - 0.7).alias("open"), scalar.gate_value((F.col("p") - 0.7) * 2).alias("gate")))


@query(f"""WITH {PEOPLE} SELECT id, '{{"Site":{{"Segment":"' || segment || '","Nation":' || CAST(nation AS VARCHAR) || '}},"Score":{{"Label":' || CAST(label AS VARCHAR) || '}}}}' AS document FROM people""")
def site_document(spark, d):
    return filters.document(people(spark, d), {"Site": {"Segment": "segment", "Nation": "nation"}, "Score": {"Label": "label"}})


@query(f"""WITH {PEOPLE} SELECT id, CAST(CAST(round(CAST(p AS DECIMAL(18, 8)) * 100, 1) AS DECIMAL(18, 1)) AS VARCHAR) || '%' AS share, CASE WHEN label = 1 THEN 'Yes' ELSE 'No' END AS flag,
 '$' || format('{{:,.2f}}', acctbal) AS balance, format('{{:,d}}', id * 1000) AS many, CASE WHEN nation = 3 THEN 'N/A' ELSE format('{{:,d}}', CAST(nation AS BIGINT)) END AS nation FROM people""")
def shown_values(spark, d):
    show = scalar.show
    nation = F.when(F.col("nation") != 3, F.col("nation"))
    return people(spark, d).select("id", show(F.col("p"), "percent").alias("share"), show(F.col("label"), "yes_no").alias("flag"), show(F.col("acctbal"), "currency").alias("balance"), show(F.col("id") * 1000, "count").alias("many"), show(nation, "count").alias("nation"))


@query("""WITH n AS (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN 'r_' WHEN 1 THEN 'c_' ELSE 'log_' END || replace(lower(p_name), ' ', '_') || CASE WHEN p_size % 2 = 0 THEN '_encoded' ELSE '' END AS name FROM part)
SELECT name, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(name, '^(r_|c_|log_)', ''), '_encoded$', ''), '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS shown, contains(name, 'log_') AS logged FROM n""")
def display_names(spark, d):
    prefix = F.when(F.col("p_size") % 3 == 0, "r_").when(F.col("p_size") % 3 == 1, "c_").otherwise("log_")
    name = F.concat(prefix, F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")), F.when(F.col("p_size") % 2 == 0, "_encoded").otherwise(""))
    return table(spark, d, "part").select(name.alias("name")).distinct().select("name", scalar.display_name(F.col("name")).alias("shown"), F.contains("name", F.lit("log_")).alias("logged"))


# Scores have six and seven decimals: they are compared as whole numbers.
@query(f"WITH {PEOPLE} SELECT id, CAST(round(q * 10000000) AS BIGINT) > CAST(round(p * 1000000) AS BIGINT) * 10 AS better FROM people")
def score_improved(spark, d):
    better = F.round(F.col("q") * 10_000_000).cast("long") > F.round(F.col("p") * 1_000_000).cast("long") * 10
    return people(spark, d).select("id", better.alias("better"))


@query(f"""WITH {SITES}, top AS (SELECT priority FROM sites WHERE status = 'Active' AND priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, priority LIMIT 3)
SELECT id, active_months, round(total_revenue, 2) AS total_revenue, CASE WHEN priority IN (SELECT priority FROM top) THEN priority ELSE 'Other' END AS priority, {R('ln(total_revenue + 1)')} AS log_total_revenue
 FROM sites WHERE status = 'Active' AND total_revenue >= 0 AND active_months > 11""")
def training_rows(spark, d):
    t = site_plans.site_table(panel(spark, d), active_days(spark, d), metrics=["revenue"], attributes=["status", "priority"], momentum_metrics={"Revenue": "revenue"})
    top = features.top_values(t.where("status = 'Active'"), "priority", 3)
    out = site_plans.training_table(t, rare={"priority": top}, logs=["total_revenue"], months=11)
    out = out.select("id", F.col("active_months").cast("long").alias("active_months"), F.round("total_revenue", 2).alias("total_revenue"), "priority", F.col("log_total_revenue").alias("log_total_revenue"))
    return out.withColumn("log_total_revenue", F.round(F.col("log_total_revenue") + 1e-9, 6) + F.lit(0.0))


def _described(c: str) -> str:
    parts = [("mean", f"avg({c})"), ("std", f"stddev_samp({c})"), ("min", f"min({c})"), ("p25", f"quantile_cont({c}, 0.25)"), ("p50", f"median({c})"), ("p75", f"quantile_cont({c}, 0.75)"), ("max", f"max({c})")]
    return f"SELECT '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS n, " + ", ".join(f"{R(f'CAST({e} AS DOUBLE)', 2)} AS {n}" for n, e in parts) + " FROM panel"


@query(f"WITH {PANEL} {_described('revenue')} UNION ALL {_described('impressions')}")
def panel_description(spark, d):
    return rounded(stats.describe(panel(spark, d), ["revenue", "impressions"]), 2)


@query(f"""WITH {PEOPLE}, {SITES}, e AS (SELECT quantile_cont(avg_monthly_revenue, 0.2) AS lo, quantile_cont(avg_monthly_revenue, 0.95) AS hi FROM sites WHERE status = 'Active'),
v AS (SELECT id, coalesce(least(greatest((avg_monthly_revenue - lo) / (hi - lo), 0), 1), 0) AS s FROM sites, e)
SELECT id, lat, lon, {R('coalesce(s, 0)', 5)} AS revenue_score, coalesce(avg_monthly_revenue, 0.0) AS avg_monthly_revenue, coalesce(active_months, 0) AS active_months, coalesce(nullif(status, ''), 'Unknown') AS status FROM people LEFT JOIN sites USING (id) LEFT JOIN v USING (id)""")
def site_list(spark, d):
    s = scoring.revenue_score(sites(spark, d), "avg_monthly_revenue")
    out = filters.site_list(people(spark, d).select("id", "lat", "lon"), s, s.select("id", "status"), values=["revenue_score", "avg_monthly_revenue", "active_months"])
    return out.select("id", "lat", "lon", (F.round(F.col("revenue_score") + 1e-8, 5) + 0.0).alias("revenue_score"), "avg_monthly_revenue", F.col("active_months").cast("long").alias("active_months"), "status")


def _presets(spark, d):
    p = table(spark, d, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "numeric").when(F.col("p_size") % 3 == 1, "categorical").otherwise("boolean")
    return p.select(F.col("p_brand").alias("preset"), kind.alias("kind"), F.col("p_type").alias("feature"))


@query("""SELECT CASE p_size % 3 WHEN 0 THEN 'numeric' WHEN 1 THEN 'categorical' ELSE 'boolean' END AS kind, list_sort(list(DISTINCT p_type)) AS features FROM part GROUP BY 1""")
def preset_union(spark, d):
    return filters.preset_union(_presets(spark, d))


@query("""SELECT DISTINCT p_type AS feature FROM part WHERE p_brand = 'Brand#11' AND p_type IN (SELECT p_type FROM part WHERE p_size < 20)""")
def preset_features(spark, d):
    available = table(spark, d, "part").where("p_size < 20").select(F.col("p_type").alias("feature"))
    return filters.preset_features(_presets(spark, d), "Brand#11", available)


@query(f"WITH {PEOPLE} SELECT id, p, 'logistic' AS model_type, 'job_1' AS experiment_id, '2024-05-01T00:00:00' AS scored_at FROM people")
def scored_export(spark, d):
    return io.scored_export(people(spark, d).select("id", "p"), "logistic", "job_1", "2024-05-01T00:00:00")


def _exported(spark, d):
    return people(spark, d).select(F.col("id").alias("gtvid"), F.col("p").alias("score"), F.col("q").alias("revenue"), "segment", "nation")


@query(f"WITH {PEOPLE} SELECT id AS gtvid, q AS revenue, CAST(q >= 0.5 AS INTEGER) AS actual_label FROM people")
def training_export(spark, d):
    return io.training_export(_exported(spark, d), "revenue", 0.5)


@query(f"WITH {PEOPLE} SELECT id AS gtvid, p AS predicted_probability, CAST(q >= 0.5 AS INTEGER) AS actual_label, 0.87 AS model_roc_auc FROM people WHERE id % 5 = 0".replace("0.87", "CAST(0.87 AS DOUBLE)"))
def test_export(spark, d):
    return io.test_predictions_export(_exported(spark, d).where("gtvid % 5 = 0"), "revenue", 0.5, 0.87)


@query(f"""WITH {PEOPLE}, {SITES} SELECT people.id AS gtvid, CASE WHEN people.id % 3 = 0 THEN 'TRAINING' WHEN status = 'Active' THEN 'ACTIVE' ELSE 'NON_ACTIVE' END AS category, coalesce(status, 'Unknown') AS status,
 p AS predicted_probability, row_number() OVER (ORDER BY p DESC, people.id) AS rank FROM people LEFT JOIN sites USING (id)""")
def all_sites_export(spark, d):
    s = sites(spark, d)
    c = people(spark, d).select("id", F.col("p").alias("score"))
    rows = scoring.category(c, c.where("id % 3 = 0"), s.where("status = 'Active'")).join(s.select("id", "status"), "id", "left")
    return io.all_sites_export(rows.withColumnRenamed("id", "gtvid"))


@query(f"WITH {ACTIVE_DAYS}, twice AS (SELECT * FROM active_days UNION ALL SELECT id, date, active_days - 1 FROM active_days) SELECT id, date, max(active_days) AS active_days FROM twice GROUP BY 1, 2")
def active_days_max(spark, d):
    a = active_days(spark, d)
    return activity.active_days_per_month(a.union(a.withColumn("active_days", F.col("active_days") - 1)))


@query(f"""WITH {SITES}, v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT coalesce(status, '__MISSING__') AS value FROM sites WHERE status IS NULL OR status = 'Active'))
SELECT id, CAST(coalesce(code, (SELECT code FROM v WHERE value = '__MISSING__'), 0) AS INTEGER) AS status_code FROM sites LEFT JOIN v ON v.value = coalesce(status, '__MISSING__')""")
def unseen_as_missing(spark, d):
    s = sites(spark, d)
    vocabulary = features.label_vocabulary(s.where("status IS NULL OR status = 'Active'"), "status")
    return features.label_encode(s, "status", vocabulary, unseen_as_missing=True).select("id", F.col("status_code").cast("int").alias("status_code"))


@query(f"""WITH {PEOPLE}, areas AS (SELECT n_nationkey AS area, 25 + n_nationkey * 0.9 AS lo, -125 + n_nationkey * 2.1 AS west FROM nation)
SELECT id, CAST(area AS BIGINT) AS area FROM people, areas WHERE lat >= lo + 0.005 AND lat < lo + 3.005 AND lon < west + 5.005 AND lon >= west + 0.005""")
def area_join(spark, d):
    low, west = 25 + F.col("n_nationkey") * 0.9 + 0.005, -125 + F.col("n_nationkey") * 2.1 + 0.005
    corner = lambda y, x: F.struct((low + y).alias("lat"), (west + x).alias("lon"))
    areas = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("area"), F.array(corner(0.0, 0.0), corner(3.0, 0.0), corner(3.0, 5.0), corner(0.0, 5.0)).alias("corners"))
    return geo.points_in_areas(people(spark, d), areas)


@query(f"""WITH p AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {R('least(greatest(l_extendedprice, lo), hi)', 3)} AS price FROM lineitem, p""")
def inverse_scaling(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("price"))
    fitted = features.fit_scaler(li, ["price"])
    back = features.unscale(features.scale(li, ["price"], fitted).drop("price"), "price_z", fitted, "price", "price")
    return rounded(back.drop("price_z"), 3)


# Models: fitted by Spark ML, so there is no SQL that says the same.
@query()
def platt(spark, d):
    c = people(spark, d)
    return ml.platt(c.where("id % 2 = 0"), c.where("id % 2 = 1"), "label", "p").select("id", "p", "calibrated", "is_calibrated")


@query()
def cross_validation(spark, d):
    return ml.cross_validate(people(spark, d), ["p", "lat"], "label", k=5, rounds=3)


@query()
def learning_curve(spark, d):
    return ml.learning_curve(people(spark, d), ["p", "lat"], "label", fractions=(0.2, 0.6, 1.0), rounds=3)


@query()
def fleet_report(spark, d):
    from panelworks.queries.scored import _flip_rows, _flip_score

    rows = _flip_rows(spark, d)
    report = site_plans.fleet_report(rows.select("id", _flip_score({}).alias("p")), explain.counterfactual_flips(rows, ["f1", "f2", "f4", "f8"], _flip_score), people(spark, d).select("id", "label"), "label")
    return report["sites"]


@query(f"WITH {PANEL} SELECT id, count(*) FILTER (date >= (SELECT max(date) FROM panel) - 185) AS recent FROM panel GROUP BY id HAVING count(*) FILTER (date >= (SELECT max(date) FROM panel) - 185) > 0")
def recent_months(spark, d):
    p = panel(spark, d)
    end = F.broadcast(p.agg(F.max("date").alias("e")))
    ids = momentum.relative_strength(p, {"revenue": "revenue"}, [(185, 370)], only_recent=True).select("id")
    return p.crossJoin(end).where(F.col("date") >= F.date_sub("e", 185)).join(ids, "id", "left_semi").groupBy("id").agg(F.count("*").alias("recent"))
