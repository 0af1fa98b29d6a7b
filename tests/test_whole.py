"""Cases beyond the sizes of the driver tables."""

from __future__ import annotations

import math

import numpy as np
import pytest

from panelworks.operators import explain
from panelworks.queries import QUERIES


def test_site_details_beyond_100_000(spark, tmp_path):
    spark.createDataFrame([(97 * 1032, "A"), (97, "B")], "c_custkey long, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r["id"]: r["segment"] for r in QUERIES["site_detail_partial"](spark, str(tmp_path)).collect()}
    assert got == {97 * 1032: "A", 97: None}


def test_gower_with_a_large_reference(spark):
    rng = np.random.default_rng(1)
    n = 12_000
    x, s = np.round(rng.random(n), 3), rng.choice(list("abc"), n)
    ref = spark.createDataFrame([(i, float(x[i]), str(s[i])) for i in range(n)], "rid long, x double, s string")
    rows = [(1, 0.25, "a"), (2, 0.5, "z"), (3, None, "b"), (4, 2.0, None)]
    got = {r["id"]: r["score"] for r in explain.gower_knn(spark.createDataFrame(rows, "id long, x double, s string"), ref, ["x"], ["s"]).collect()}
    for i, a, b in rows:
        d = (0 if a is None else abs(a - x) / (x.max() - x.min())) / 2 + (s != str(b)) / 2
        assert abs(got[i] - 1 / (1 + np.sort(d)[:10].mean())) < 1e-9


@pytest.fixture
def without_orders(spark, tmp_path):
    """The tables of 0.1 % with no order for every fourth customer."""
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    read("customer").write.parquet(f"{tmp_path}/customer.parquet")
    read("orders").where("o_custkey % 4 <> 1").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_shapley_store_with_customers_without_orders(spark, without_orders):
    rows = QUERIES["shapley_store"](spark, without_orders).collect()
    ids = [r["c_custkey"] for r in spark.read.parquet(f"{without_orders}/customer.parquet").collect()]
    assert sorted({r["id"] for r in rows}) == sorted(ids) and len(rows) == 5 * len(ids)
    assert all(math.isfinite(r["shap"]) for r in rows)
    before = sum(i % 3 != 0 for i in ids)
    assert {(r["computed_before"], r["computed_now"]) for r in rows} == {(before, len(ids) - before)}


def test_tier_drivers_with_customers_without_orders(spark, without_orders):
    rows = QUERIES["tier_drivers"](spark, without_orders).collect()
    n = spark.read.parquet(f"{without_orders}/customer.parquet").count()
    assert sum(r["n"] for r in rows if r["rank"] == 1) == n  # every row counts in its tier
    assert all(math.isfinite(r["mean_shap"]) and r["mean_abs"] >= abs(r["mean_shap"]) - 1e-12 for r in rows)
    assert {r["direction"] for r in rows if r["feature"] == "p"} == {"+", "-"}
