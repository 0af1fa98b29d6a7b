"""Distance joins: attributes of distance tables, nearest points, nearest segments, polygons."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelworks.functions.scalar import EARTH_RADIUS_MILES, haversine_miles, in_polygon
from panelworks.session import materialise

MILES_PER_DEGREE = EARTH_RADIUS_MILES * math.pi / 180


def left_join_all(sites: DataFrame, tables: Sequence[tuple[DataFrame, str, Sequence[str]]], key: str = "id") -> DataFrame:
    """Left joins of (table, its key, columns), each first cut to one row per key (the least row)."""
    for table, on, columns in tables:
        one = table.groupBy(F.col(on).alias(key)).agg(F.min(F.struct(*columns)).alias("r_")).select(key, "r_.*")
        sites = sites.join(one, key, "left")
    return sites


def nearest_of_many(rows: DataFrame, name: str, distance: str) -> DataFrame:
    """(id, name, distance): for each id the name at its least distance (ties: the least name)."""
    return rows.groupBy("id").agg(F.min(F.struct(distance, name)).alias("r_")).select("id", f"r_.{name}", f"r_.{distance}")


def _cells(df: DataFrame, lat: Column, lon: Column, size: float) -> DataFrame:
    return df.withColumn("cy_", F.floor(lat / size)).withColumn("cx_", F.floor(lon / size))


#: Others that a point may find in a cell on average, and the cells in degrees to choose from.
CELL_POINTS, CELLS = 64, (1.0, 1 / 4, 1 / 16, 1 / 64)
#: The same for :func:`nearest`, where a point meets nine cells and more, and for the cells of :func:`nearest_segment`.
FEW_POINTS, FINE = 8, (1.0, 1 / 2, 1 / 4, 1 / 8, 1 / 16, 1 / 32, 1 / 64, 1 / 128)
FEW_LINES, REACHES = 32, (1.0, 1 / 4, 1 / 16, 1 / 64)


def cell_for(others: DataFrame, cells: Sequence[float] = CELLS, few: int = CELL_POINTS) -> float:
    """The widest of ``cells`` (descending) in which an average row of ``others`` shares its cell with at most ``few`` rows."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), F.floor(F.col("lat") / c).alias("y"), F.floor(F.col("lon") / c).alias("x")) for c in cells]))
    counts = others.select("lat", "lon").dropna().select(each.alias("c")).groupBy("c").agg(F.count("*").cast("double").alias("n"))
    met = counts.groupBy(F.col("c.cell").alias("cell")).agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("m")).collect()  # a row for each size
    return max((r["cell"] for r in met if r["m"] <= few), default=cells[-1] if met else cells[0])


def _least(points: DataFrame, spread: Callable[[DataFrame], DataFrame], posted: DataFrame, miles: Column, name: str, keep: Column | None = None) -> DataFrame:
    """(id, b_): for each point the least (miles, name) of the pairs that meet in a cell.

    First the least distance alone, which is added up without sorting; then the names at it. So
    no pair is ever sorted or written.
    """

    def pairs(df: DataFrame) -> DataFrame:
        # Posted rows are many more than their table's size tells, so they must not be broadcast.
        met = spread(df).join(posted.hint("merge"), ["cy_", "cx_"])
        return met if keep is None else met.where(keep)

    least = materialise(pairs(points).groupBy("id").agg(F.min(miles).alias("least_")), "least")
    at = pairs(points.join(least, "id")).where(miles == F.col("least_"))
    return at.groupBy("id").agg(F.min(F.struct(miles.alias("miles"), F.col(name))).alias("b_"))


def nearest(points: DataFrame, others: DataFrame, *, exclude_self: bool = False, cell: float | None = None, rings: Sequence[int] = (1, 4)) -> DataFrame:
    """(id, nearest_id, miles): the nearest of ``others`` (id, lat, lon) to each point (id, lat, lon).

    Both sides fall into grid cells chosen by the density of ``others`` (:func:`cell_for`), at
    most ``cell`` degrees wide; a point meets the cells around its own, (2 ring + 1) squared of
    them. Of ``others`` at one place only the least id counts (two for ``exclude_self``). A distance
    is final if it is no more than that to the edge of the searched block;
    other points go to the next ring, and then to cells 4 times (from a degree on 15 times) as
    large, until one block covers the earth. Where cells divide the circle evenly,
    longitudes wrap around. What is left is written between rings, so that each ring's work is
    done once. Ties go to the least id; points without coordinates get none.
    """
    target = others.select(F.col("id").alias("nearest_id"), "lat", "lon").dropna(subset=["lat", "lon"])
    if exclude_self:
        target = target.where("nearest_id IS NOT NULL").distinct()
    place = F.row_number().over(W.partitionBy("lat", "lon").orderBy("nearest_id"))
    target = materialise(target.withColumn("place_", place).where(F.col("place_") <= (2 if exclude_self else 1)).drop("place_"), "places")
    wide = (cell or 1.0,)
    cell = cell_for(target, (*wide, *[c for c in FINE if c < wide[0]]), FEW_POINTS)
    target = target.withColumnsRenamed({"lat": "lat2", "lon": "lon2"})
    return _nearest(points.select("id", "lat", "lon").dropna(), target, exclude_self, cell, rings)


def _nearest(left: DataFrame, target: DataFrame, exclude_self: bool, cell: float, rings: Sequence[int]) -> DataFrame:
    around = round(360 / cell) if 360 % cell == 0 else None
    column = (lambda c: F.pmod(c, F.lit(around))) if around else (lambda c: c)
    gridded = _cells(target, F.col("lat2"), F.col("lon2"), cell).withColumn("cx_", column(F.col("cx_")))
    found = None
    for ring in rings:
        span = F.sequence(F.lit(-ring), F.lit(ring))

        def spread(df: DataFrame) -> DataFrame:
            near = _cells(df, F.col("lat"), F.col("lon"), cell)
            near = near.withColumn("dy_", F.explode(span)).withColumn("dx_", F.explode(span))
            return near.withColumn("cy_", F.col("cy_") + F.col("dy_")).withColumn("cx_", column(F.col("cx_") + F.col("dx_"))).drop("dy_", "dx_")

        miles = haversine_miles(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
        best = _least(left, spread, gridded, miles, "nearest_id", F.col("id") != F.col("nearest_id") if exclude_self else None)
        # Least distance to the block's edge: rows of latitude, and columns shortened by its cosine.
        lat_edge = F.least(F.col("lat") - (F.floor(F.col("lat") / cell) - ring) * cell, (F.floor(F.col("lat") / cell) + ring + 1) * cell - F.col("lat"))
        lon_edge = F.least(F.col("lon") - (F.floor(F.col("lon") / cell) - ring) * cell, (F.floor(F.col("lon") / cell) + ring + 1) * cell - F.col("lon"))
        far_lat = F.least(F.abs(F.col("lat")) + (ring + 1) * cell, F.lit(89.9))
        safe = F.least(lat_edge, lon_edge * F.cos(F.radians(far_lat)) * 0.99) * MILES_PER_DEGREE
        whole = F.lit(ring * cell >= 360)
        checked = left.join(best, "id", "left").withColumn("ok_", F.coalesce(whole | (F.col("b_.miles") <= safe), F.lit(False)))
        checked = materialise(checked, "ring")
        done = checked.where("ok_ AND b_ IS NOT NULL").select("id", "b_.nearest_id", "b_.miles")
        found = done if found is None else found.union(done)
        left = checked.where("NOT ok_").select("id", "lat", "lon")
        if left.isEmpty():
            return found
    if cell > 360 or target.isEmpty():
        return found
    return found.union(_nearest(left, target, exclude_self, cell * (4 if cell < 1 else 15), rings))


def segment_miles(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in miles from a point to a short segment, in the plane that touches at the point."""
    k = F.cos(F.radians(lat))
    ax, ay, bx, by = (lon1 - lon) * k, lat1 - lat, (lon2 - lon) * k, lat2 - lat
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.least(F.greatest(-(ax * dx + ay * dy) / F.nullif(square, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    x, y = ax + t * dx, ay + t * dy
    return F.sqrt(x * x + y * y) * MILES_PER_DEGREE


def _posted(segments: DataFrame, cell: float, by: float) -> DataFrame:
    """Every segment in the cells that have a point within ``by`` degrees (of latitude) of it, row by row of cells."""
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    rows = segments.withColumn("cy_", F.explode(F.sequence(F.floor((low - by) / cell), F.floor((high + by) / cell))))
    # The part of the segment that a point of the row may be near to, and its longitudes.
    flat = F.col("lat2") - F.col("lat1")
    share = lambda lat: F.when(flat == 0, 0.0).otherwise(F.least(F.greatest((lat - F.col("lat1")) / F.nullif(flat, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    a, b = share(F.col("cy_") * cell - by), F.when(flat == 0, 1.0).otherwise(share((F.col("cy_") + 1) * cell + by))
    rows = rows.withColumn("a_", F.col("lon1") + a * (F.col("lon2") - F.col("lon1"))).withColumn("b_", F.col("lon1") + b * (F.col("lon2") - F.col("lon1")))
    # A degree of longitude is shorter by the cosine of the latitude, so the box is the wider; a nudge covers rounding.
    polar = F.least(F.greatest(F.abs("lat1"), F.abs("lat2")) + by, F.lit(89.0))
    wide = by / F.cos(F.radians(polar)) + 1e-9
    cells = F.sequence(F.floor((F.least("a_", "b_") - wide) / cell), F.floor((F.greatest("a_", "b_") + wide) / cell))
    return rows.withColumn("cx_", F.explode(cells)).drop("a_", "b_")


def _reach_for(segments: DataFrame, reach: float) -> float:
    """``reach``, or the widest below it of :data:`REACHES` in which an average cell of a segment has at most ``FEW_LINES``."""
    for size in (reach, *[r for r in REACHES if r < reach]):
        counts = _posted(segments, size, 0.0).groupBy("cy_", "cx_").agg(F.count("*").cast("double").alias("n"))
        met = counts.agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("m")).first()["m"]
        if met is None or met <= FEW_LINES:
            break
    return size


def nearest_segment(points: DataFrame, segments: DataFrame, *, reach: float = 2.0, limit: float | None = None) -> DataFrame:
    """(id, line, miles): the nearest line to each point, within ``limit`` miles if given (else no row).

    segments: line, lat1, lon1, lat2, lon2; of equal ones only the least line counts. Every segment
    is posted to the grid cells along it, widened by a reach of at most ``reach`` degrees that
    their density gives, and meets the points of those cells. Points whose
    nearest line is farther than that are searched again with eight times the reach.
    """
    ends = ["lat1", "lon1", "lat2", "lon2"]
    once = segments.dropna(subset=ends).groupBy(*ends).agg(F.min(F.struct("line")).alias("l_")).select("l_.line", *ends)
    once = materialise(once, "segments")
    return _nearest_segment(points.select("id", "lat", "lon").dropna(), once, _reach_for(once, reach), limit)


def _nearest_segment(placed: DataFrame, segments: DataFrame, reach: float, limit: float | None) -> DataFrame:
    miles = segment_miles(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    best = _least(placed, lambda df: _cells(df, F.col("lat"), F.col("lon"), reach), _posted(segments, reach, reach), miles, "line")
    found = best.where(F.col("b_.miles") <= reach * MILES_PER_DEGREE).select("id", "b_.line", "b_.miles")
    if reach < 360 and (limit is None or reach * MILES_PER_DEGREE < limit):
        found = materialise(found, "nearest")
        left = placed.join(found, "id", "left_anti")
        if not left.isEmpty() and not segments.isEmpty():
            # No farther than the limit, and a little for rounding.
            farther = reach * 8 if limit is None else min(reach * 8, limit / MILES_PER_DEGREE * 1.000001)
            found = found.union(_nearest_segment(left, segments, farther, limit))
    return found if limit is None else found.where(F.col("miles") <= limit)


def points_in_areas(points: DataFrame, areas: DataFrame, *, cell: float = 0.5) -> DataFrame:
    """(id, area): every area that holds the point; areas: area, corners (array of lat, lon structs).

    An area is posted to the grid cells of its box and meets the points of those cells; then
    the edges that a ray crosses are counted. A point on two areas has two rows.
    """
    lats, lons = F.transform("corners", lambda c: c["lat"]), F.transform("corners", lambda c: c["lon"])
    span = lambda x: F.sequence(F.floor(F.array_min(x) / cell), F.floor(F.array_max(x) / cell))
    posted = areas.select("area", "corners", span(lats).alias("ys"), span(lons).alias("xs")).where("size(corners) > 2")
    posted = posted.select("area", "corners", F.explode("ys").alias("cy_"), "xs").select("area", "corners", "cy_", F.explode("xs").alias("cx_"))
    near = _cells(points.select("id", "lat", "lon").dropna(), F.col("lat"), F.col("lon"), cell).join(posted, ["cy_", "cx_"])
    edges = F.arrays_zip(F.col("corners").alias("a"), F.concat(F.slice("corners", 2, F.size("corners") - 1), F.slice("corners", 1, 1)).alias("b"))

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (F.col("lat") >= F.least(a["lat"], b["lat"])) & (F.col("lat") < F.greatest(a["lat"], b["lat"]))
        at = a["lon"] + (F.col("lat") - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) * (b["lon"] - a["lon"])
        return F.coalesce(spans & (F.col("lon") < at), F.lit(False))

    return near.where(F.size(F.filter(edges, crossed)) % 2 == 1).select("id", "area")


def within(points: DataFrame, corners: Sequence[tuple[float, float]]) -> DataFrame:
    """The points (lat, lon) inside a polygon; its box is tested first."""
    lats, lons = zip(*corners, strict=True)
    box = F.col("lat").between(min(lats), max(lats)) & F.col("lon").between(min(lons), max(lons))
    return points.where(box & in_polygon(F.col("lat"), F.col("lon"), corners))
