"""Known answers and properties of the operators."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelworks.functions import scalar
from panelworks.operators import activity, explain, features, filters, geo, momentum, rollup, scoring, stats
from panelworks.plans import ml
from panelworks.plans import sites as site_plans
from panelworks.sources import io

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def day(s):
    return dt.date.fromisoformat(s)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def monthly(spark, t, s):
    a = spark.createDataFrame([(i, day(d), n, g) for i, d, n, g in t], "id string, date date, transactions long, gtvid string")
    b = spark.createDataFrame([(i, day(d), n, g) for i, d, n, g in s], "id string, date date, status string, gtvid string")
    return rows(activity.monthly_activity(a, b), "id", "year_month", "gtvid", "active_days", "transaction_days", "total_days_in_data")


def plain_months(t, s):
    """The rule over Python dictionaries: first row of a day by (gtvid, value), then days of either table by month."""
    first_t = {(i, d): min((g, n) for j, e, n, g in t if (j, e) == (i, d)) for i, d, _, _ in t}
    first_s = {(i, d): min((g, v) for j, e, v, g in s if (j, e) == (i, d)) for i, d, _, _ in s}
    months = {}
    for i, d in first_t.keys() | first_s.keys():
        g = first_t.get((i, d), first_s.get((i, d)))[0]
        months.setdefault((i, d[:7]), []).append((g, first_s.get((i, d), ("", ""))[1] == "Active", first_t.get((i, d), ("", 0))[1] > 0))
    return sorted((i, m, min(x[0] for x in days), sum(x[1] for x in days), sum(x[2] for x in days), len(days)) for (i, m), days in months.items())


def test_monthly_activity(spark):
    """Seven ids over a turn of the year, all in both tables for some days; days repeat in both; one id never sells."""
    t, s = [], []
    for n in range(7):
        for k in range(0, 64, n + 2):
            d = (dt.date(2020, 12, 3) + dt.timedelta(days=k)).isoformat()
            t.append((f"e{n}", d, 0 if n == 4 else (k * 13 + n) % 5, f"G{n}"))
            if k % 3 == 0:
                t.append((f"e{n}", d, (k + n) % 2, f"G{n}"))
        for k in range(n, 75, 3):
            d = (dt.date(2020, 11, 28) + dt.timedelta(days=k)).isoformat()
            s += [(f"e{n}", d, ("Active", "Removed", "Deactivated")[(k * n) % 3], f"G{n}")] * (1 + k % 2)
            if k % 5 == 0:
                s.append((f"e{n}", d, "Closed", f"H{n}"))
    assert monthly(spark, t, s) == plain_months(t, s)
    assert {m for _, m, *_ in plain_months(t, s)} == {"2020-11", "2020-12", "2021-01", "2021-02"}


def test_monthly_activity_of_one_table_alone(spark):
    t = [("z", "2024-02-29", 5, "A"), ("z", "2024-03-31", 0, "A"), ("y", "2024-02-10", 1, None)]
    assert monthly(spark, t, []) == [("y", "2024-02", None, 0, 1, 1), ("z", "2024-02", "A", 0, 1, 1), ("z", "2024-03", "A", 0, 0, 1)]
    s = [("z", "2024-02-29", None, "A"), ("x", "2024-12-31", "Active", "B"), ("x", "2025-01-01", "Active", "B")]
    assert monthly(spark, [], s) == [("x", "2024-12", "B", 1, 0, 1), ("x", "2025-01", "B", 1, 0, 1), ("z", "2024-02", "A", 0, 0, 1)]


SHOPS = [("m1", "Utrecht", "north"), ("m2", "Utrecht", "south"), ("m3", "Ghent", "north"), ("m4", "Bremen", "south"), ("m5", "Bremen", "east"), ("m6", "Ghent", "east")]
ALL = {r[0] for r in SHOPS}


@pytest.mark.parametrize(
    ("chosen", "expected"),
    [
        ({}, set()),
        ({"City": "Utrecht"}, {"m1", "m2"}),
        ({"City": "Bremen", "Side": "south"}, {"m4"}),
        ({"City": ["Ghent", "Bremen"], "Side": ["east"]}, {"m5", "m6"}),
        ({"City": "Lille"}, set()),
        ({"Colour": "red"}, ALL),
        ({"City": None}, ALL),
        ({"City": ""}, ALL),
        ({"City": [], "Side": "north"}, {"m1", "m3"}),
    ],
)
def test_filter_multi(spark, chosen, expected):
    df = spark.createDataFrame(SHOPS, "shop string, city string, side string")
    assert {r["shop"] for r in filters.filter_multi(df, chosen, {"City": "city", "Side": "side"}).collect()} == expected


def test_filter_options_keeps_false_and_drops_blank(spark):
    df = spark.createDataFrame([("b", True), (" ", False), (None, None), ("a", True)], "x string, y boolean")
    assert {r["field"]: r["options"] for r in filters.filter_options(df, ["x", "y", "z"]).collect()} == {"x": ["a", "b"], "y": ["false", "true"]}


def test_site_details_partial(spark):
    ids = spark.createDataFrame([("m1",), ("m3",), ("gone",)], "id string")
    details = spark.createDataFrame([("m1", "Utrecht")], "id string, city string")
    coordinates = spark.createDataFrame([("m1", 52.1), ("m3", 51.05)], "id string, lat double")
    metrics = spark.createDataFrame([("m1", 0.4)], "id string, score double")
    got = {r["id"]: (r["partial"], r["sources"]) for r in filters.site_details(ids, details, coordinates, metrics).collect()}
    assert got == {"m1": (False, ["details", "coordinates", "metrics"]), "m3": (True, ["coordinates"])}


def test_site_list_has_defaults(spark):
    sites = spark.createDataFrame([("m1",), ("m2",), ("m3",), (None,)], "id string")
    scores = spark.createDataFrame([("m1", 0.4, 7), ("m1", 0.2, 3), (None, 0.9, 1)], "id string, score double, months int")
    statuses = spark.createDataFrame([("m1", "Active"), ("m2", ""), (None, "Removed")], "id string, status string")
    got = filters.site_list(sites, scores, statuses, values=["score", "months"])
    assert {(r["id"], r["score"], r["months"], r["status"]) for r in got.collect()} == {("m1", 0.4, 7, "Active"), ("m2", 0.0, 0, "Unknown"), ("m3", 0.0, 0, "Unknown"), (None, 0.0, 0, "Unknown")}
    assert filters.site_list(sites.limit(0), scores, statuses, values=["score"]).count() == 0


def test_preset_union(spark):
    presets = spark.createDataFrame([("a", "numeric", "x"), ("b", "numeric", "x"), ("b", "numeric", "w"), ("b", "boolean", "t"), ("c", "boolean", None)], "preset string, kind string, feature string")
    assert {r["kind"]: r["features"] for r in filters.preset_union(presets).collect()} == {"numeric": ["w", "x"], "boolean": ["t"]}
    have = spark.createDataFrame([("x",), ("t",)], "feature string")
    assert rows(filters.preset_features(presets, "b", have), "feature") == [("t",), ("x",)]
    assert rows(filters.preset_features(presets, "b", have, spark.createDataFrame([("t",), ("w",)], "feature string")), "feature") == [("t",)]


@FEW
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(-3, 3), st.floats(-1e3, 1e3))), max_size=30), st.floats(0, 1))
def test_percentiles_of_groups(spark, values, share):
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in values], "g int, x double")
    got = {r["g"]: (r["n"], r["p"][0]) for r in scoring.grouped_percentiles(df, "g", "x", (share,)).collect()}
    for g in range(3):
        own = sorted(float(v) for h, v in values if h == g and v is not None)
        if not own:
            assert g not in got
            continue
        at = (len(own) - 1) * share
        low, high = own[math.floor(at)], own[math.ceil(at)]
        assert got[g][0] == len(own) and got[g][1] == pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-9, abs=1e-9)


def test_numbers_are_gapless_over_partitions(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"))
    got = scoring._numbered(df, [F.desc("k")], "n").collect()
    assert all(r["n"] == 5000 - r["k"] for r in got) and len(got) == 5000


def test_exports_of_tests_and_all_sites(spark):
    df = spark.createDataFrame([("u2", "ACTIVE", "Active", 5.0, 0.9), ("u1", "TRAINING", "", 1.0, 0.9), ("u3", "NON_ACTIVE", None, None, None)], "gtvid string, category string, status string, money double, score double")
    out = io.test_predictions_export(df, "money", 2.0, 0.75)
    assert out.columns == ["gtvid", "predicted_probability", "actual_label", "model_roc_auc"]
    assert [tuple(r) for r in out.collect()] == [("u1", 0.9, 0, 0.75), ("u2", 0.9, 1, 0.75), ("u3", None, 0, 0.75)]
    assert [(r["gtvid"], r["status"], r["rank"]) for r in io.all_sites_export(df).collect()] == [("u1", "Unknown", 1), ("u2", "Active", 2), ("u3", "Unknown", 3)]
    marked = io.scored_export(df, "mlp", "e7").first()
    assert (marked["model_type"], marked["experiment_id"], marked["scored_at"]) == ("mlp", "e7", None)


def test_platt_against_newton(spark):
    import numpy as np

    r = np.random.default_rng(4)
    x = r.random(300)
    y = (r.random(300) < 1 / (1 + np.exp(3 - 5 * x))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "p double, label int")
    w = np.zeros(2)
    for _ in range(50):  # ridge of weight 1 on the slope
        design = np.stack([x, np.ones(300)], 1)
        q = 1 / (1 + np.exp(-design @ w))
        w += np.linalg.solve((design * (q * (1 - q))[:, None]).T @ design + np.diag([1, 0]), design.T @ (y - q) - np.array([w[0], 0]))
    got = {row["p"]: row["calibrated"] for row in ml.platt(df, df, "label", "p").collect()}
    assert all(abs(got[v] - 1 / (1 + np.exp(-(w[0] * v + w[1])))) < 1e-3 for v in x)
    raw = ml.platt(df.limit(0), df, "label", "p").first()
    assert raw["calibrated"] == raw["p"] and not raw["is_calibrated"]


def test_isotonic_against_pooling(spark):
    pairs = [(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 0), (0.6, 1), (0.7, 0), (0.8, 1), (0.9, 1)]
    df = spark.createDataFrame(pairs, "p double, label int")
    pools = []
    for p, y in pairs:
        pools.append([float(y), 1, [p]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
    want = {p: s / n for s, n, own in pools for p in own}
    got = {r["p"]: r["calibrated"] for r in ml.isotonic(df, df, "label", "p").collect()}
    assert all(got[p] == pytest.approx(v) for p, v in want.items())


def test_folds_and_curves(spark):
    df = spark.range(403).select("id", (F.col("id") % 2).cast("int").alias("label"), ((F.col("id") % 2) + F.rand(3)).alias("x"))
    sizes = {r["fold"]: r["count"] for r in ml.folds(df, "id", 5).groupBy("fold").count().collect()}
    assert sorted(sizes.values()) == [80, 80, 80, 80, 83]
    scores = ml.cross_validate(df, ["x"], "label", k=3, rounds=2).collect()
    assert [r["fold"] for r in scores] == [0, 1, 2] and sum(r["n_test"] for r in scores) == 403
    assert all(r["n_train"] + r["n_test"] == 403 and r["auc"] > 0.8 for r in scores)
    curve = ml.learning_curve(df, ["x"], "label", fractions=(0.25, 1.0), rounds=2).collect()
    assert curve[0]["n_train"] < curve[1]["n_train"] <= 323 and curve[1]["auc"] > 0.8


def test_artifacts_come_back(spark, tmp_path):
    df = spark.range(60).select("id", (F.col("id") * 3.5).alias("x"), (F.col("id") > 30).cast("int").alias("label"))
    model, scaler = ml.fit_classifier(df, ["x"], "label", rounds=2), features.fit_scaler(df, ["x"])
    ml.save_artifacts(str(tmp_path / "a"), model, {"scaler": scaler})
    again, tables = ml.load_artifacts(spark, str(tmp_path / "a"), ["scaler"])
    assert rows(ml.predict(again, df, "p"), "id", "p") == rows(ml.predict(model, df, "p"), "id", "p")
    back = features.unscale(features.scale(df, ["x"], tables["scaler"]), "x_z", scaler, "x", "back")
    p1, p99 = 59 * 3.5 * 0.01, 59 * 3.5 * 0.99
    assert all(r["back"] == pytest.approx(min(max(r["x"], p1), p99)) for r in back.collect())


def test_fleet_report(spark):
    scored = spark.createDataFrame([(i, i / 20) for i in range(20)], "id long, p double")
    outcomes = spark.createDataFrame([(i, int(i > 11)) for i in range(20)], "id long, label int")
    flips = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (19, ["a"])], "id long, flips array<string>")
    report = site_plans.fleet_report(scored, flips, outcomes, "label")
    s = report["summary"].first()
    assert (s["sites"], s["tier_1"], s["tier_4"], s["with_intervention"]) == (20, 8, 12, 2)
    assert {r["id"]: r["intervention"] for r in report["sites"].collect() if r["intervention"]} == {1: "a", 2: "a+b"}


def test_empty_tiers_and_clusters_are_kept(spark):
    tiers = scoring.tier_distribution(scoring.classify_tiers(spark.createDataFrame([(0.7,), (0.72,), (0.6,), (None,)], "p double")))
    assert rows(tiers, "tier", "n") == [(1, 0), (2, 2), (3, 1), (4, 0)]
    nothing = scoring.tier_distribution(scoring.classify_tiers(spark.createDataFrame([], "p double")))
    assert rows(nothing, "tier", "n", "share") == [(t, 0, 0.0) for t in (1, 2, 3, 4)]
    few = spark.createDataFrame([(1, True)] * 9 + [(2, True)] * 9 + [(2, False)], "tier int, succeeded boolean")
    assert rows(scoring.tier_history(few).fillna(-1.0), "tier", "n", "accuracy") == [(1, 9, -1.0), (2, 10, 0.9)]
    assert rows(stats.sizes_with_zeros(spark.createDataFrame([(3,), (3,), (0,)], "c int"), "c", 4), "cluster", "n") == [(0, 1), (1, 0), (2, 0), (3, 2)]


def test_shown_percent_rounds_decimal_halves_up(spark):
    df = spark.createDataFrame([(0.1235,), (0.00049,), (0.0005,), (1.0,), (None,)], "p double")
    assert [r[0] for r in df.select(scalar.show(F.col("p"), "percent")).collect()] == ["12.4%", "0.0%", "0.1%", "100.0%", "N/A"]


def test_nearest_over_the_date_line_and_far_away(spark):
    points = spark.createDataFrame([(1, 10.0, 179.9), (2, 0.0, 0.0), (3, None, 1.0)], "id long, lat double, lon double")
    others = spark.createDataFrame([(7, 10.0, -179.8), (8, 10.0, 178.0), (9, -60.0, -150.0)], "id long, lat double, lon double")
    got = {r["id"]: r["nearest_id"] for r in geo.nearest(points, others).collect()}
    assert got[1] == 7 and set(got) == {1, 2}

    def miles(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 3958.8 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))

    assert got[2] == min((miles(0, 0, y, x), i) for i, y, x in ((7, 10, -179.8), (8, 10, 178), (9, -60, -150)))[1]
    assert geo.nearest(points, others.limit(0)).count() == 0 and geo.nearest(points.limit(0), others).count() == 0


def test_far_segments_are_found_unless_limited(spark):
    points = spark.createDataFrame([(1, 40.0, -100.0), (2, 40.0, -75.0)], "id long, lat double, lon double")
    lines = spark.createDataFrame([("a", 39.0, -101.0, 41.0, -101.0)], "line string, lat1 double, lon1 double, lat2 double, lon2 double")
    got = {r["id"]: r["miles"] for r in geo.nearest_segment(points, lines).collect()}
    assert set(got) == {1, 2} and got[1] == pytest.approx(math.cos(math.radians(40)) * 69.09, rel=0.01) and got[2] > 1000
    assert [r["id"] for r in geo.nearest_segment(points, lines, limit=200.0).collect()] == [1]


def test_area_join_against_counting_crossings(spark):
    square = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)]
    notch = [(1.0, 1.0), (5.0, 1.0), (3.0, 3.0), (5.0, 6.0), (1.0, 6.0)]
    areas = spark.createDataFrame([("square", square), ("notch", notch), ("line", square[:2])], "area string, corners array<struct<lat:double,lon:double>>")
    points = spark.createDataFrame([(i, 0.25 + i % 11 * 0.51, 0.3 + i // 11 * 0.57) for i in range(121)], "id long, lat double, lon double")

    def inside(lat, lon, c):
        hits = 0
        for (a, x), (b, y) in zip(c, [*c[1:], c[0]]):
            hits += min(a, b) <= lat < max(a, b) and lon < x + (lat - a) / (b - a) * (y - x)
        return hits % 2 == 1

    want = sorted((r["id"], n) for r in points.collect() for n, c in (("square", square), ("notch", notch)) if inside(r["lat"], r["lon"], c))
    assert rows(geo.points_in_areas(points, areas), "id", "area") == want and len(want) > 20


def test_damaged_json_is_skipped(spark, tmp_path):
    for name, text in (("a", '{"task": "x", "n": 3}'), ("b", '{"task": '), ("c", '{\n "task": "y"\n}'), ("d", "")):
        (tmp_path / f"{name}.json").write_text(text)
    assert sorted((r["task"], r["n"]) for r in io.read_json_tolerant(spark, str(tmp_path), "task string, n int").collect()) == [("x", 3), ("y", None)]


def test_shapley_values_of_a_product(spark):
    """Against the mean over all orders, and the sum rule."""
    import itertools

    import numpy as np

    f = lambda x: x[:, 0] * x[:, 1] + 2 * x[:, 2]
    df = spark.createDataFrame([(1, 2.0, 3.0, 1.0), (2, -1.0, 4.0, 0.5)], "id long, a double, b double, c double")
    base = [1.0, 1.0, 0.0]
    got = {(r["id"], r["feature"]): r["shap"] for r in explain.shapley_values(df, ["a", "b", "c"], base, f, permutations=200).collect()}
    for r in df.collect():
        x, total = np.array([r["a"], r["b"], r["c"]]), np.zeros(3)
        for order in itertools.permutations(range(3)):
            now = np.array(base)
            for j in order:
                before = f(now[None])[0]
                now[j] = x[j]
                total[j] += (f(now[None])[0] - before) / 6
        own = [got[r["id"], n] for n in "abc"]
        assert np.allclose(own, total, atol=0.5) and sum(own) == pytest.approx(f(x[None])[0] - f(np.array(base)[None])[0])


def test_flips_against_trying_all(spark):
    import itertools

    r = spark.createDataFrame([(i, i % 2, i // 2 % 2, i // 4 % 2, i / 16) for i in range(16)], "id long, a int, b int, c int, p double")
    score = lambda ch: scalar.sigmoid(ch.get("a", F.col("a")) * 0.7 + ch.get("b", F.col("b")) * 0.4 - ch.get("c", F.col("c")) * 0.6 + F.col("p") - 0.9)
    got = {x["id"]: (x["flips"], x["probability"]) for x in explain.counterfactual_flips(r, ["a", "b", "c"], score).collect()}
    plain = lambda a, b, c, p: 1 / (1 + math.exp(-(a * 0.7 + b * 0.4 - c * 0.6 + p - 0.9)))
    for x in r.collect():
        now = {k: x[k] for k in "abc"}
        if plain(**now, p=x["p"]) >= 0.5:
            assert x["id"] not in got
            continue
        best = None
        for n in (1, 2, 3):
            found = [(-plain(**(now | {k: 1 - now[k] for k in ks}), p=x["p"]), list(ks)) for ks in itertools.combinations("abc", n)]
            found = [f for f in found if -f[0] >= 0.5]
            if found:
                best = min(found)
                break
        assert (x["id"] in got) == (best is not None)
        if best:
            assert got[x["id"]][0] == best[1] and got[x["id"]][1] == pytest.approx(-best[0])


def test_finite_or_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (-float("inf"),), (0.0,), (-5.5,), (None,)], "x double")
    assert [r[0] for r in df.select(scalar.finite_or_null(F.col("x"))).collect()] == [1.0, None, None, None, 0.0, -5.5, None]


def test_exports(spark):
    data = [("k1", "Removed", 12.0, 0.31), ("k2", "Paused", 95.0, 0.64), ("k3", "Removed", None, 0.64), ("k4", "Paused", 90.0, 0.97)]
    out = io.non_active_export(spark.createDataFrame(data, "gtvid string, status string, revenue double, score double"), "revenue", 90.0, 0.7, top=2)
    assert out.columns == ["gtvid", "status", "predicted_probability", "actual_label", "model_roc_auc", "top_2"]
    assert [(r["gtvid"], r["actual_label"], r["top_2"]) for r in out.collect()] == [("k4", 1, 1), ("k2", 1, 1), ("k3", 0, 0), ("k1", 0, 0)]


def test_soft_assign(spark):
    centres = [[1.0 if i == j else 0.0 for i in range(8)] for j in range(3)]
    points = spark.createDataFrame([(0, centres[0]), (1, [0.2] * 8)], "id long, vector array<double>")
    q = explain.soft_assign(points, centres)
    got = {r["id"]: r["q"] for r in q.collect()}
    assert max(range(3), key=lambda i: got[0][i]) == 0
    assert all(abs(sum(x) - 1) < 1e-12 and min(x) >= 0 for x in got.values())
    p = [r["p"] for r in explain.target_distribution(q, 3).collect()]
    assert all(abs(sum(x) - 1) < 1e-12 for x in p)


def test_rollup_keeps_null_of_the_latest_row(spark):
    df = spark.createDataFrame([("a", day("2024-01-01"), 5.0, "x"), ("a", day("2024-02-01"), None, None)], "id string, date date, revenue double, status string")
    r = rollup.site_rollup(df, ["revenue"], ["status"]).first()
    assert (r["active_months"], r["total_revenue"], r["avg_monthly_revenue"], r["status"]) == (2, 5.0, 2.5, None)
    f = rollup.first_non_null(df, ["revenue", "status"], ["date"]).first()
    assert (f["revenue"], f["status"]) == (5.0, "x")


def test_relative_strength_needs_enough_values(spark):
    df = spark.createDataFrame([("a", day("2024-06-01"), 10.0), ("a", day("2024-05-20"), 30.0), ("b", day("2024-06-01"), 9.0), ("c", day("2023-09-01"), 9.0)], "id string, date date, revenue double")
    got = {r["id"]: r["rs_revenue"] for r in momentum.relative_strength(df, {"revenue": "revenue"}, [(30, 90)]).collect()}
    assert got["a"] == pytest.approx(1.0) and got["b"] == 1.0 and got["c"] == 1.0
    assert {r["id"] for r in momentum.relative_strength(df, {"revenue": "revenue"}, [(30, 90)], only_recent=True).collect()} == {"a", "b"}


@FEW
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6)), min_size=1, max_size=20))
def test_signed_log(spark, values):
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(scalar.signed_log(F.col("x"))).collect()]
    for v, g in zip(values, got, strict=True):
        assert (g is None) if v is None else g == pytest.approx(math.copysign(math.log1p(abs(v)), v) if v else 0.0)


@FEW
@given(st.lists(st.integers(0, 5), min_size=1, max_size=25))
def test_rank_percentile_matches_average_ranks(spark, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, s double")
    n = len(values)
    for r in scoring.rank_percentile(df, "s").collect():
        better, same = sum(v > r["s"] for v in values), sum(v == r["s"] for v in values)
        assert r["rank"] == int(better + 1 + (same - 1) / 2)
        assert r["percentile"] == pytest.approx(round((n - r["rank"]) / n * 100, 1), abs=0.051)


@FEW
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 4)), min_size=2, max_size=25))
def test_auc_matches_pairs(spark, pairs):
    df = spark.createDataFrame([(y, float(s)) for y, s in pairs], "y int, s double")
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    got = stats.auc(df, "y", "s").first()[0]
    if pos and neg:
        assert got == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))
    else:
        assert got is None


@FEW
@given(st.lists(st.one_of(st.none(), st.floats(-1e3, 1e3)), min_size=3, max_size=20))
def test_scaling_stays_within_limits(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert all(-10 <= r["x_z"] <= 10 for r in features.scale(df, ["x"], features.fit_scaler(df, ["x"])).collect())


def test_label_encoding_of_unseen(spark):
    train = spark.createDataFrame([("b",), (None,), ("a",)], "c string")
    vocabulary = features.label_vocabulary(train, "c")
    assert rows(vocabulary, "value", "code") == [("__MISSING__", 0), ("a", 1), ("b", 2)]
    new = spark.createDataFrame([("z",), ("b",), (None,)], "c string")
    assert [r["c_code"] for r in features.label_encode(new, "c", vocabulary).orderBy("c").collect()] == [0, 2, 0]


def test_wider_range_has_no_fewer_positives(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    n = [features.lookalike(df, "x", features.thresholds(df, "x", lo)).agg(F.sum("label")).first()[0] for lo in (50, 80, 90)]
    assert n == sorted(n, reverse=True)
    assert features.thresholds(df, "x", 90, 100).first()["high"] is None


def test_tiers(spark):
    df = spark.createDataFrame([(0.85,), (0.65,), (0.5,), (0.1,), (None,), (float("nan"),)], "p double")
    got = scoring.classify_tiers(df).collect()
    assert [r["tier"] for r in got] == [1, 2, 3, 4, None, None]
    assert [r["error"] is None for r in got] == [True] * 4 + [False] * 2
    assert spark.range(1).select(scalar.out_of_ten(F.lit(0.25))).first()[0] == "2 out of 10"


def test_tier_shift_is_capped_and_sequential(spark):
    counts = spark.createDataFrame([(1, 5), (2, 5), (3, 10), (4, 10)], "tier int, n long")
    moves = spark.createDataFrame([(1, 30, 1.0), (2, 30, 1.0)], "ord int, n long, rate double")
    assert rows(scoring.tier_shift(counts, moves), "tier", "before", "after") == [(1, 5, 5), (2, 5, 5 + 9 + 9 + 1 + 1), (3, 10, 0), (4, 10, 0)]


def test_nearest_equals_brute_force(spark):
    a = spark.range(60).select("id", (25 + F.col("id") * 7 % 23).cast("double").alias("lat"), (-120 + F.col("id") * 11 % 50).cast("double").alias("lon"))
    got = {r["id"]: r["miles"] for r in geo.nearest(a, a, exclude_self=True).collect()}
    pts = [(r["id"], r["lat"], r["lon"]) for r in a.collect()]

    def miles(p, q):
        x = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 3958.8 * math.asin(math.sqrt(x))

    assert got == {p[0]: pytest.approx(min(miles(p, q) for q in pts if q[0] != p[0])) for p in pts}


def test_shapley_values_add_up(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, 0.0, 1.0)], "id long, a double, b double")
    f = lambda x: x[:, 0] * x[:, 1] + x[:, 0]
    got = explain.shapley_values(df, ["a", "b"], [1.0, 1.0], f, permutations=3).groupBy("id").agg(F.sum("shap").alias("s"))
    assert {r["id"]: r["s"] for r in got.collect()} == {1: pytest.approx(8 - 2), 2: pytest.approx(0 - 2)}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID - Key,Date,n\ns1,2024-01-01,5\ns2,NA,x\nUnknown,2024-01-02,\n")
    df = io.read_csv(spark, str(tmp_path / "a.csv"), "`ID - Key` string, Date date, n long", null_values=io.NULL_TOKENS, rename={"ID - Key": "id"})
    assert [tuple(r) for r in df.collect()] == [("s1", day("2024-01-01"), 5), ("s2", None, None), (None, day("2024-01-02"), None)]
    (tmp_path / "labels.csv").write_text("gtvid,actual_label\nA,1\n,1\nB,\n")
    assert rows(io.read_labels(spark, str(tmp_path / "labels.csv")), "gtvid", "actual_label") == [("A", 1), ("B", 0)]


def test_isotonic_without_rows_keeps_raw(spark):
    df = spark.createDataFrame([(0.3,)], "p double")
    r = ml.isotonic(df.limit(0).withColumn("y", F.lit(1)), df, "y", "p").first()
    assert (r["calibrated"], r["is_calibrated"]) == (0.3, False)


def test_reliability_and_conformal(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.05), (1, 0.95)], "y int, p double")
    bins = {r["bin"]: r["n"] for r in stats.reliability(df, "y", "p").collect()}
    assert bins == {i: {0: 1, 9: 2}.get(i, 0) for i in range(10)}
    t = stats.conformal_threshold(df, "y", "p", split=False)
    assert t.first()["threshold"] == 0.95
    assert stats.ece(stats.reliability(df.limit(0), "y", "p")).first()[0] is None


def test_name_cluster(spark):
    name, text = explain.name_cluster(F.col("v"), ["open_24_hours", "screen_count", "emv"])
    got = spark.createDataFrame([([0.0, 0.5, 0.9],), ([0.0, 0.0, 0.0],)], "v array<double>").select(name.alias("n"), text.alias("t")).collect()
    assert [tuple(r) for r in got] == [("Screen Expansion", "Primary changes: screen_count; emv"), ("General Optimization", "General operational improvements")]


def test_streamed_days(spark, tmp_path):
    from panelworks.streaming import monthly as m

    src = tmp_path / "in"
    spark.createDataFrame([("a", "2024-01-01 10:00:00", 1.0), ("a", "2024-01-01 11:00:00", 2.0), ("a", "2024-03-01 00:00:00", 3.0)], "id string, t string, value double").select("id", F.to_timestamp("t").alias("ts"), "value").write.parquet(str(src))
    stream = spark.readStream.schema("id string, ts timestamp, value double").parquet(str(src))
    m.write_days(m.daily_counts(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert rows(m.month_totals(spark, str(tmp_path / "out")), "id", "year_month", "days", "value") == [("a", "2024-01", 1, 3.0)]


def test_coverage_in_words(spark):
    one = spark.createDataFrame([(0.9314, 1.25, 30.0, 0.5), (0.85, 1.0, 0.0, 0.0)], "coverage double, avg_set_size double, pct_uncertain double, pct_empty double")
    assert [r["text"] for r in stats.coverage_text(one).collect()] == ["coverage 93.1% (target 90.0% met), 30.0% uncertain, 0.5% empty", "coverage 85.0% (target 90.0% missed), 0.0% uncertain, 0.0% empty"]


def test_features_leave_out_what_leaks():
    columns = ["gtvid", "total_revenue", "log_total_revenue", "rs_Revenue", "dma_rank", "state"]
    preset = ["state", "total_revenue", "dma_rank", "gone", "log_total_revenue"]
    leaks = ["total_revenue", "log_total_revenue", "avg_daily_revenue"]
    assert features.feature_columns(columns, preset, leakage=leaks) == ["state", "dma_rank"]
    assert features.feature_columns(columns, preset, ["dma_rank", "rs_Revenue"], leaks) == ["dma_rank"]
    assert features.feature_columns(columns, preset, []) == []


def test_erf_is_close(spark):
    xs = [-3.0, -0.7, -1e-9, 0.0, 0.2, 1.0, 2.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", scalar.erf_approximation(F.col("x")).alias("e"))
    assert all(abs(r["e"] - math.erf(r["x"])) < 2e-7 for r in df.collect())


def test_silhouette_of_two_clear_clusters(spark):
    rows = [([0.0, 0.1 * i], 0) for i in range(5)] + [([9.0, 0.1 * i], 1) for i in range(5)]
    df = spark.createDataFrame(rows, "v array<double>, c int")
    assert ml.silhouette(df, "v", "c") > 0.99
    assert ml.silhouette(df.withColumn("c", (F.col("v")[1] * 10 % 2).cast("int")), "v", "c") < 0.1


def test_files_facts_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("revenue", 1234.5, None), ("visits", 7.0, 3.5)], "metric string, dataset_total double, avg_per_active_month double")
    io.write_parquet(df, str(tmp_path / "t"))
    io.write_parquet(df, str(tmp_path / "t"))  # overwrites
    schema, n = io.table_facts(spark, str(tmp_path / "t"))
    assert (schema.names, n) == (df.columns, 2)
    io.write_csv(df, str(tmp_path / "c"), single=True)
    files = io.list_files(spark, str(tmp_path / "c"), "*.csv").collect()
    assert len(files) == 1 and files[0]["length"] > 0
    assert sorted(r["metric"] for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()) == ["revenue", "visits"]
    assert io.summary_text(df.orderBy("metric")) == "revenue: total 1,234.50, per active month 0.00\nvisits: total 7.00, per active month 3.50"
    assert io.to_json_text({"a": day("2024-01-02")}) == '{\n  "a": "2024-01-02"\n}'


def test_cells_follow_the_density(spark):
    """A city of 3,000 points within a tenth of a degree and a few far ones: fine cells, and still the exact nearest."""
    city = [(i, 40.0 + (i * 37 % 1000) / 10_000, -100.0 + (i * 91 % 997) / 10_000) for i in range(3000)]
    far = [(5000, -33.0, 151.0), (5001, 64.0, 179.95), (5002, 0.0, 0.0)]
    schema = "id long, lat double, lon double"
    others = spark.createDataFrame(city + far, schema)
    assert geo.cell_for(others) == 1 / 64 and geo.cell_for(spark.createDataFrame(far, schema)) == 1.0
    assert geo.cell_for(others.where("id < 0")) == 1.0
    asked = [(1, 40.05, -99.95), (2, 41.0, -101.0), (3, 63.5, -179.9), (4, -10.0, 100.0)]
    got = {r["id"]: r["nearest_id"] for r in geo.nearest(spark.createDataFrame(asked, schema), others).collect()}

    def miles(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return math.asin(min(1.0, math.sqrt(h)))

    assert got == {a[0]: min((miles(a, b), b[0]) for b in city + far)[1] for a in asked}


def test_nearest_of_crowded_places_and_copies(spark):
    """More rows to a cell of the given width than should meet, most of them at one place: finer cells, and the least ids."""
    schema = "id long, lat double, lon double"
    at = lambda i: (i, 30.0 + (i * 37 % 50) / 40, -100.0 + (i * 91 % 70) / 35)
    rows = [at(i) for i in range(300)] + [(1000 - i, 30.51, -99.01) for i in range(200)]
    others = spark.createDataFrame(rows, schema)

    def miles(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return round(2 * 3958.8 * math.asin(math.sqrt(h)), 6)

    got = {r["id"]: (round(r["miles"], 6), r["nearest_id"]) for r in geo.nearest(others, others, exclude_self=True, cell=2.0).collect()}
    assert len(got) == 500 and all(got[a[0]] == min((miles(a, b), b[0]) for b in rows if b[0] != a[0]) for a in rows[::7])
    asked = [(1, 30.5, -99.0), (2, 45.0, -80.0), (3, 30.51, -99.01)]
    got = {r["id"]: (round(r["miles"], 6), r["nearest_id"]) for r in geo.nearest(spark.createDataFrame(asked, schema), others, cell=2.0).collect()}
    assert got == {a[0]: min((miles(a, b), b[0]) for b in rows) for a in asked}


def test_nearest_segment_of_dense_lines(spark):
    """Lines of all directions, and copies: their density narrows the reach, and the result is that of trying all."""
    rows = [(f"l{i:04d}", 30.0 + i * 37 % 101 / 50, -100.0 + i * 91 % 97 / 40, 30.0 + i * 53 % 103 / 50, -100.0 + i * 29 % 107 / 40) for i in range(400)]
    rows += [("a-copy", *rows[5][1:]), ("level", 31.0, -99.0, 31.0, -98.5), ("spot", 33.5, -97.0, 33.5, -97.0)]
    lines = spark.createDataFrame(rows, "line string, lat1 double, lon1 double, lat2 double, lon2 double")
    points = spark.createDataFrame([(i, 29.9 + i * 17 % 89 / 40, -100.1 + i * 23 % 83 / 30) for i in range(80)] + [(99, 36.0, -90.0), (100, None, 1.0)], "id long, lat double, lon double")
    assert geo._reach_for(lines, 2.0) < 1.0
    d = geo.segment_miles(*[F.col(c) for c in ("lat", "lon", "lat1", "lon1", "lat2", "lon2")])
    want = {r["id"]: r["b"] for r in points.dropna().crossJoin(lines).groupBy("id").agg(F.min(F.struct(d.alias("miles"), "line")).alias("b")).collect()}
    for limit in (None, 5.0, 0.01, 0.0):
        got = {r["id"]: (r["miles"], r["line"]) for r in geo.nearest_segment(points, lines, limit=limit).collect()}
        assert got == {k: tuple(b) for k, b in want.items() if limit is None or b["miles"] <= limit}


def test_crowded_cells_are_split(spark):
    """6,000 places in 2.4 by 5.5 degrees: 7 in a cell of an eighth of a degree, whatever width is asked for."""
    places = spark.range(6000).select("id", (25 + (F.col("id") * 53 % 240).cast("double") / 100).alias("lat"), (-125 + (F.col("id") * 67 % 550).cast("double") / 100).alias("lon"))
    assert geo.cell_for(places, (2.0, *geo.FINE), geo.FEW_POINTS) == 1 / 8


def test_hash_split_takes_decimal_shares(spark):
    counts = lambda n, shares: [r["count"] for r in explain.hash_split(spark.range(n), "id", shares).groupBy("part").count().orderBy("part").collect()]
    assert counts(90, (0.7, 0.15, 0.15)) == [63, 13, 14]
    assert counts(100, (0.29, 0.57, 0.14)) == [29, 57, 14] and counts(9, [1 / 3] * 3) == [3, 3, 3]


def test_hash_split_into_many_parts_has_a_small_plan(spark):
    """Every part by plain re-computation; the plan of 100 parts once held 4,950 sums, which took 6 GB of the driver to compile."""
    import hashlib
    from fractions import Fraction

    for shares in ([0.01] * 100, [0.0, 0.5, 0.0, 0.25, 0.25], [1.0]):
        split = explain.hash_split(spark.range(250), "id", shares, seed=7)
        assert len(split._jdf.queryExecution().optimizedPlan().toString()) < 20_000
        ends = [sum(250 * Fraction(str(s)) // 1 for s in shares[: i + 1]) for i in range(len(shares) - 1)]
        order = sorted(range(250), key=lambda i: (hashlib.md5(f"7:{i}".encode()).hexdigest(), i))
        want = {i: next((p for p, end in enumerate(ends) if at <= end), len(shares) - 1) for at, i in enumerate(order, 1)}
        assert {r["id"]: r["part"] for r in split.collect()} == want and dict(split.dtypes)["part"] == "int"
    assert explain.hash_split(spark.range(0), "id").count() == 0


def test_binary_rounding_is_that_of_sql(spark):
    import duckdb

    from panelworks.queries.base import round_binary

    xs = [k / 1000 for k in range(5, 1000, 10)]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(round_binary(F.col("x"), 2)).collect()]
    assert got == [r[0] for r in duckdb.sql(f"SELECT round(CAST(x AS DOUBLE), 2) FROM (SELECT unnest({xs}) AS x, unnest(range({len(xs)})) AS i) ORDER BY i").fetchall()]


def test_rank_percentile_at_sizes_where_shares_lie_next_to_halves(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(16)], "id long, s double")
    shown = {r["rank"]: r["percentile"] for r in scoring.rank_percentile(df, "s").collect()}
    assert shown[3] == 81.2 and shown[1] == 93.8
    assert {r["rank"]: r["percentile"] for r in scoring.rank_percentile(df, "s", digits=None).collect()}[3] == 81.25
