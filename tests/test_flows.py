"""Streams against their batch, and shape files against what was written."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from panelworks.operators import geo
from panelworks.sources import shapes
from panelworks.streaming import months

SCHEMA = "id long, ts timestamp_ntz, value double"


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_months_from_late_and_repeated_rows(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, f"2024-{m:02d}-{d:02d} {r.randrange(24):02d}:00:00", float(r.randrange(9))) for i in range(4) for m in (1, 2, 3) for d in range(1, 29, 3) for _ in range(r.randrange(3))]
    rows.append((9, "2024-12-31 23:59:59", 1.0))
    frame = lambda part: spark.createDataFrame(part, "id long, ts string, value double").select("id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
    # Batches in the order of time, each mixed and with rows of the one before again.
    ordered = sorted(rows, key=lambda x: x[1])
    parts = [ordered[k : k + 25] for k in range(0, len(ordered), 25)]
    source, folder = tmp_path / "in", tmp_path.as_uri() + "/out"
    source.mkdir()
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    for k, part in enumerate(parts):
        again = [x for x in (parts[k - 1] if k else []) if x[1] > part[0][1][:8]]  # of a month that is open still
        mixed = part + again
        r.shuffle(mixed)
        frame(mixed).coalesce(1).write.mode("append").parquet(str(source))
        if k in (1, len(parts) - 1):  # stopped and started again in between
            got = months.collect_closed(stream(), folder, late="31 days")
    closed = months.months_of(frame(rows)).where("year_month < '2024-11'")
    assert collected(got) == collected(closed.select(got.columns))
    assert collected(months.collect_closed(stream(), folder, late="31 days")) == collected(got)  # nothing comes twice


def test_a_late_row_counts_while_its_month_is_open(spark, tmp_path):
    source, folder = tmp_path / "in", tmp_path.as_uri() + "/out"
    source.mkdir()
    names = ["spark.sql.streaming.statefulOperator.allowMultiple", "spark.sql.streaming.multipleWatermarkPolicy"]
    before = [spark.conf.get(n, None) for n in names]
    for part in ([(1, "2024-01-28", 1.0), (1, "2024-02-20", 2.0)], [(1, "2024-02-03", 4.0), (1, "2024-01-29", 8.0)], [(1, "2024-03-03", 16.0), (2, "2024-02-29", 32.0)]):
        rows = spark.createDataFrame(part, "id long, ts string, value double")
        rows.select("id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value").coalesce(1).write.mode("append").parquet(str(source))
        got = months.collect_closed(spark.readStream.schema(SCHEMA).parquet(str(source)), folder, late="2 days")
    # February is open until a row of 2 March has come, so its late row counts; January's comes when that is closed.
    assert collected(got) == [(1, "2024-01", 1, 1.0), (1, "2024-02", 2, 6.0), (2, "2024-02", 1, 32.0)]
    assert [spark.conf.get(n, None) for n in names] == before


def test_month_ends():
    assert months.month_end_ms("1970-01") == 31 * 86_400_000
    assert months.month_end_ms("1999-12") == 946_684_800_000


def lines(spark, n, seed=1):
    r = random.Random(seed)
    rows = [(f"Route {i} é", [(round(r.uniform(-80, 80), 6), round(r.uniform(-179, 179), 6))] * (i % 3 == 0) + [(round(30 + r.random(), 6), round(-100 + r.random(), 6)) for _ in range(i % 7)]) for i in range(n)]
    return rows, spark.createDataFrame([(k, [{"lat": a, "lon": b} for a, b in p]) for k, p in rows], "line string, points array<struct<lat:double,lon:double>>").repartition(3)


def test_lines_come_back(spark, tmp_path):
    rows, df = lines(spark, 200)
    shapes.write_lines(df, str(tmp_path))
    back = shapes.read_lines(spark, tmp_path.as_uri(), recordsPerPartition="17")
    assert back.rdd.getNumPartitions() >= 12
    got = sorted((r["line"], [(p["lat"], p["lon"]) for p in r["points"]]) for r in back.collect())
    assert got == sorted(x for x in rows if x[1])
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".")]
    box = (29.0, -101.0, 32.0, -98.0)
    some = sorted(r["line"] for r in shapes.read_lines(spark, str(tmp_path), box=box).collect())
    meets = lambda p: p and min(a for a, _ in p) <= 32 and max(a for a, _ in p) >= 29 and min(b for _, b in p) <= -98 and max(b for _, b in p) >= -101
    assert some == sorted(k for k, p in rows if meets(p)) and len(some) < len(got)


def test_a_shape_file_by_hand(spark, tmp_path):
    """Two records, one of two parts and one without a shape, packed here byte by byte."""
    points = [(-1.0, 5.0), (2.0, 6.0), (3.0, 7.0), (4.0, 8.0), (5.0, 9.5)]
    shape = struct.pack("<i4d2i2i", 3, -1.0, 5.0, 5.0, 9.5, 2, 5, 0, 2) + b"".join(struct.pack("<2d", *p) for p in points)
    none = struct.pack("<i", 0)
    records = struct.pack(">2i", 1, len(shape) // 2) + shape + struct.pack(">2i", 2, len(none) // 2) + none
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, 3, -1.0, 5.0, 5.0, 9.5, 0, 0, 0, 0)
    (tmp_path / "x.shp").write_bytes(head(100 + len(records)) + records)
    (tmp_path / "x.shx").write_bytes(head(116) + struct.pack(">4i", 50, len(shape) // 2, 50 + 4 + len(shape) // 2, len(none) // 2))
    (tmp_path / "x.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 95, 7, 26, 2, 65, 6) + struct.pack("<11sc4xBB14x", b"FULLNAME", b"C", 5, 0) + b"\r" + b" I- 80" + b" none \x1a")
    got = shapes.read_lines(spark, str(tmp_path / "x.shp"))
    assert collected(got.select("line", "part", F.to_json("points"))) == [("I- 80", 0, '[{"lat":5.0,"lon":-1.0},{"lat":6.0,"lon":2.0}]'), ("I- 80", 1, '[{"lat":7.0,"lon":3.0},{"lat":8.0,"lon":4.0},{"lat":9.5,"lon":5.0}]')]
    assert shapes.read_lines(spark, str(tmp_path), box=(50.0, 50.0, 60.0, 60.0)).count() == 0
    assert shapes.segments_of(got).count() == 3


def test_damaged_or_missing_shapes(spark, tmp_path):
    assert shapes.read_lines(spark, str(tmp_path)).count() == 0
    (tmp_path / "bad.shp").write_bytes(b"\x00" * 100)
    with pytest.raises(Exception, match="does not hold polylines"):
        shapes.read_lines(spark, str(tmp_path)).count()


def test_lines_feed_the_nearest_segment(spark, tmp_path):
    rows, df = lines(spark, 40)
    shapes.write_lines(df, str(tmp_path))
    points = spark.createDataFrame([(i, 30 + i / 10, -100 + i / 7) for i in range(10)], "id long, lat double, lon double")
    read = geo.nearest_segment(points, shapes.segments_of(shapes.read_lines(spark, str(tmp_path))))
    assert collected(read) == collected(geo.nearest_segment(points, shapes.segments_of(df)))
