"""Scalar rules of the domain, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_MILES = 3958.8
#: Fixed values, by tier: (least probability, tier, label, action, colour).
TIERS = (
    (0.85, 1, "Recommended", "Proceed to contract", "#22c55e"),
    (0.65, 2, "Promising", "Site visit required", "#eab308"),
    (0.50, 3, "Review Required", "Detailed assessment needed", "#f97316"),
    (0.0, 4, "Not Recommended", "Do not pursue", "#ef4444"),
)


def clip(x: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """x within [low, high]; null stays null."""
    if low is not None:
        x = F.when(x < low, low).otherwise(x)
    if high is not None:
        x = F.when(x > high, high).otherwise(x)
    return x


def signed_log(x: Column) -> Column:
    """ln(x + 1) for x >= 0, and -ln(1 - x) below."""
    return F.when(x >= 0, F.log1p(x)).otherwise(-F.log1p(-x))


def finite_or_null(x: Column) -> Column:
    """Null for NaN and both infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def null_tokens(x: Column, tokens: Sequence[str] = ("", "NA", "null", "Unknown")) -> Column:
    """Null where a string is one of the tokens that stand for a missing value."""
    return F.when(~x.isin(*tokens), x)


def yes_no_flag(x: Column) -> Column:
    """Yes 1, No 0, all else null (tinyint)."""
    return F.when(x == "Yes", 1).when(x == "No", 0).cast("tinyint")


def boolean_text_flag(x: Column) -> Column:
    """true 1, false 0 in any case, all else null (tinyint)."""
    return F.when(F.lower(x) == "true", 1).when(F.lower(x) == "false", 0).cast("tinyint")


def truthy(x: Column) -> Column:
    """Whether a string means true: true, 1, yes or t in any case; null is false."""
    return F.coalesce(F.lower(x.cast("string")).isin("true", "1", "yes", "t"), F.lit(False))


def safe_name(x: Column) -> Column:
    """Spaces and hyphens as underscores, lower case."""
    return F.lower(F.translate(x, " -", "__"))


def display_name(x: Column) -> Column:
    """A column's name for people: prefix and suffix of its role dropped, words capitalised."""
    bare = F.regexp_replace(F.regexp_replace(x, "^(r|c|rs|log|avg|total)_", ""), "_encoded$", "")
    return F.initcap(F.replace(bare, F.lit("_"), F.lit(" ")))


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in miles."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return 2 * EARTH_RADIUS_MILES * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def tier(p: Column) -> Column:
    """Tier 1 to 4 of a calibrated probability; null for a value that is null or not a number."""
    out = F.lit(None).cast("int")
    for least, number, *_ in reversed(TIERS):
        out = F.when(p >= least, number).otherwise(out) if number != 4 else F.when(p.isNotNull() & ~F.isnan(p), 4)
    return F.when(F.isnan(p), F.lit(None)).otherwise(out)


def tier_part(t: Column, part: int) -> Column:
    """Label (2), action (3) or colour (4) of a tier."""
    out = F.lit(None).cast("string")
    for row in TIERS:
        out = F.when(t == row[1], row[part]).otherwise(out)
    return out


def out_of_ten(p: Column) -> Column:
    """'n out of 10 similar ones', n rounded half to even."""
    return F.format_string("%d out of 10", F.bround(p * 10).cast("int"))


def job_time(job: Column) -> Column:
    """UTC time of ids like ``job_<epoch>_<hex>``; null if there is none."""
    epoch = F.try_element_at(F.split(job, "_"), F.lit(2)).try_cast("bigint")
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def between_percentiles(x: Column, low: Column, high: Column | None) -> Column:
    """1 in [low, high] (no upper end for None), else 0; null counts as 0."""
    inside = x >= low if high is None else (x >= low) & (x <= high)
    return F.coalesce(inside, F.lit(False)).cast("int")


def in_polygon(lat: Column, lon: Column, corners: Sequence[tuple[float, float]]) -> Column:
    """Whether a point lies in the polygon of (lat, lon) corners, by counting crossed edges."""
    crossed = F.lit(0)
    for (a_lat, a_lon), (b_lat, b_lon) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if a_lat == b_lat:
            continue
        spans = (lat >= min(a_lat, b_lat)) & (lat < max(a_lat, b_lat))
        at = F.lit(a_lon) + (lat - a_lat) / (b_lat - a_lat) * (b_lon - a_lon)
        crossed = crossed + (spans & (lon < at)).cast("int")
    return crossed % 2 == 1


def erf_approximation(x: Column) -> Column:
    """Error function by the five-term rational approximation (error below 1.5e-7)."""
    # Fixed values of the approximation.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1 / (1 + p * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + c) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def gate_probability(mu: Column, sigma: float = 0.5) -> Column:
    """Probability that a stochastic gate with mean parameter mu is open, by the logistic approximation."""
    return sigmoid(1.702 * (0.5 + mu) / sigma)


def gate_value(mu: Column) -> Column:
    """The gate itself without noise: 0.5 + mu within [0, 1]."""
    return clip(0.5 + mu, 0.0, 1.0)


def show(x: Column, kind: str) -> Column:
    """A value for people: ``currency``, ``percent`` (of a share), ``count`` or ``yes_no``; null as N/A."""
    text = {
        "currency": lambda: F.concat(F.lit("$"), F.format_number(x.cast("double"), 2)),
        # Halves go up, of the decimal number that is shown and not of its binary neighbour.
        "percent": lambda: F.concat(F.format_number(F.round(x.cast("decimal(24,8)") * 100, 1), 1), F.lit("%")),
        "count": lambda: F.format_number(x.cast("double"), 0),
        "yes_no": lambda: F.when(x.cast("boolean"), "Yes").otherwise("No"),
    }[kind]()
    return F.when(x.isNull(), "N/A").otherwise(text)
