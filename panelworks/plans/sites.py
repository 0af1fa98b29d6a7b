"""The feature table of all entities, and the fleet analysis on scored ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.operators import features, momentum, rollup, scoring


def site_table(panel: DataFrame, active_days: DataFrame, *, metrics: Sequence[str], attributes: Sequence[str], momentum_metrics: Mapping[str, str], order: Sequence[str] = ("date",)) -> DataFrame:
    """Roll-up, daily rates and relative strength of every id; all by id, so one partitioning serves the joins."""
    rated = rollup.daily_rates(panel, active_days)
    table = rollup.site_rollup(panel, metrics, attributes, order=order)
    table = table.join(rollup.average_daily(rated), "id", "left")
    return table.join(momentum.relative_strength(panel, momentum_metrics), "id", "left")


def training_table(sites: DataFrame, *, status: str = "status", active: str = "Active", rare: Mapping[str, DataFrame], logs: Sequence[str], active_only: bool = True, months: int | None = None) -> DataFrame:
    """Rows fit for training: active, revenue not negative, rare categories binned by fitted lists, logs added.

    The lists of frequent categories come from training rows and are given again for scoring.
    """
    from panelworks.functions.scalar import signed_log

    out = sites.where(F.col(status) == active) if active_only else sites
    out = out.where((F.col("total_revenue") >= 0) & (F.col("avg_daily") >= 0))
    if months is not None:
        out = out.where(F.col("active_months") > months)
    for column, top in rare.items():
        out = features.bin_rare(out, column, top)
    return out.withColumns({f"log_{c}": signed_log(F.col(c)) for c in logs})


def fleet_interventions(scored: DataFrame, flips: DataFrame, *, probability: str = "p", success: float = 1.0) -> dict[str, DataFrame]:
    """The fleet report's tables: tiers, distribution, interventions (one per set of flips), shifted tiers.

    ``flips`` has (id, flips); everything is keyed by id.
    """
    tiers = scoring.classify_tiers(scored, probability)
    counts = scoring.tier_distribution(tiers)
    groups = flips.groupBy(F.concat_ws("+", "flips").alias("intervention")).agg(F.count("*").alias("n"))
    ordered = groups.select("intervention", "n", F.lit(success).alias("rate"), F.struct((-F.col("n")).alias("m"), "intervention").alias("ord"))
    return {"tiers": tiers, "distribution": counts, "interventions": ordered, "shift": scoring.tier_shift(counts, ordered)}


def fleet_report(scored: DataFrame, flips: DataFrame, outcomes: DataFrame, label: str, *, probability: str = "p", method: str = "isotonic") -> dict[str, DataFrame]:
    """The report of a fleet: calibrate, tier, group the low tiers by what would lift them, and shift.

    Tables: ``summary`` (one row: sites, mean probability, sites of each tier, sites that a set
    of flips lifts), ``sites`` (a row for each site with its tier and flips), and those of
    :func:`fleet_interventions`. ``outcomes`` (id, label) are what calibration is fitted on.
    """
    from panelworks.plans import ml

    fit = {"isotonic": ml.isotonic, "platt": ml.platt}[method]
    calibrated = fit(scored.join(outcomes, "id").where(F.col(label).isNotNull()), scored, label, probability)
    low = scoring.classify_tiers(calibrated, "calibrated").where("tier >= 3").select("id")
    chosen = flips.join(low, "id", "left_semi")
    report = fleet_interventions(calibrated, chosen, probability="calibrated")
    per_site = report["tiers"].join(chosen.select("id", F.concat_ws("+", "flips").alias("intervention")), "id", "left")
    counts = [F.count_if(F.col("tier") == t).alias(f"tier_{t}") for t in (1, 2, 3, 4)]
    summary = per_site.agg(F.count("*").alias("sites"), F.avg("calibrated").alias("mean_probability"), *counts, F.count("intervention").alias("with_intervention"))
    columns = ["id", F.col(probability).alias("raw"), "calibrated", "tier", "label", "action", "confidence", "intervention"]
    return report | {"summary": summary, "sites": per_site.select(*columns)}
