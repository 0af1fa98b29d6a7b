"""A data source for polylines in shape files: records are read by ranges, pruned by a box, and written back.

A shape file is three files: ``.shp`` (records with points), ``.shx`` (place of every record) and
``.dbf`` (a row of attributes for every record). A partition is a range of records of one
file: it reads its part of the index and of the attributes, and just the bytes of its records.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Fixed values of the format: file code, version, shape type of a polyline, sizes of headers.
FILE_CODE, VERSION, NOTHING, POLYLINE = 9994, 1000, 0, 3
HEADER, INDEX_ENTRY, RECORD_HEADER, FIELD = 100, 8, 8, 32
SCHEMA = "line string, part int, points array<struct<lat:double,lon:double>>"
NAME_BYTES = 100


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _bytes(system: fs.FileSystem, path: str, start: int, size: int) -> bytes:
    with system.open_input_file(path) as f:
        f.seek(start)
        return f.read(size)


def _header(words: int, box: np.ndarray) -> bytes:
    return struct.pack(">7i", FILE_CODE, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", VERSION, POLYLINE, *box, 0, 0, 0, 0)


def _meets(box: tuple[float, ...], wanted: tuple[float, ...] | None) -> bool:
    """Whether boxes (min lon, min lat, max lon, max lat) have a point in common."""
    return wanted is None or (box[0] <= wanted[2] and box[2] >= wanted[0] and box[1] <= wanted[3] and box[3] >= wanted[1])


@dataclass
class Records(InputPartition):
    """Records ``first`` to ``first + count - 1`` of one file."""

    path: str
    first: int
    count: int


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        # Options come with their names in lower case.
        self.count = int(options.get("recordsperpartition", 10_000))
        #: Option ``box``: min lat, min lon, max lat, max lon.
        given = options.get("box")
        lat0, lon0, lat1, lon1 = map(float, given.split(",")) if given else (0, 0, 0, 0)
        self.box = (lon0, lat0, lon1, lat1) if given else None

    def partitions(self) -> list[InputPartition]:
        system, root = _open(self.path)
        info = system.get_file_info(root)
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(root))
        out = []
        for f in sorted((f for f in files if f.path.endswith(".shp") and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
            head = _bytes(system, f.path, 0, HEADER)
            kind, *box = struct.unpack("<i4d", head[32:68])
            if struct.unpack(">i", head[:4])[0] != FILE_CODE or kind != POLYLINE:
                raise ValueError(f"{f.path} does not hold polylines")
            records = (system.get_file_info(f.path[:-4] + ".shx").size - HEADER) // INDEX_ENTRY
            if records and _meets(tuple(box), self.box):
                out += [Records(f.path[:-4], i, min(self.count, records - i)) for i in range(0, records, self.count)]
        return out or [Records("", 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        system, _ = _open(self.path)
        index = np.frombuffer(_bytes(system, partition.path + ".shx", HEADER + INDEX_ENTRY * partition.first, INDEX_ENTRY * partition.count), ">i4").reshape(-1, 2).astype(np.int64) * 2
        start = int(index[0, 0])
        data = _bytes(system, partition.path + ".shp", start, int(index[-1].sum()) + RECORD_HEADER - start)
        names = _attribute(system, partition.path + ".dbf", partition.first, partition.count)
        lines, parts, lats, lons, sizes = [], [], [], [], []
        for (offset, _), name in zip(index.tolist(), names):
            at = offset - start + RECORD_HEADER
            kind = struct.unpack_from("<i", data, at)[0]
            if kind == NOTHING:
                continue
            if kind != POLYLINE:
                raise ValueError("a record is not a polyline")
            *box, n_parts, n_points = struct.unpack_from("<4d2i", data, at + 4)
            if not _meets(tuple(box), self.box):
                continue
            first = np.frombuffer(data, "<i4", n_parts, at + 44)
            points = np.frombuffer(data, "<f8", 2 * n_points, at + 44 + 4 * n_parts).reshape(-1, 2)
            lines += [name] * n_parts
            parts += range(n_parts)
            sizes += np.diff(np.append(first, n_points)).tolist()
            lons.append(points[:, 0])
            lats.append(points[:, 1])
        flat = [pa.array(np.concatenate(x)) if x else pa.array([], pa.float64()) for x in (lats, lons)]
        bound = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        lists = pa.ListArray.from_arrays(bound, pa.StructArray.from_arrays(flat, ["lat", "lon"]))
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array(parts, pa.int32()), lists], ["line", "part", "points"])


def _attribute(system: fs.FileSystem, path: str, first: int, count: int) -> list[str]:
    """The first attribute of some records as text."""
    head = _bytes(system, path, 0, 64)
    header, width = struct.unpack_from("<2H", head, 8)
    size = head[32 + 16]
    rows = _bytes(system, path, header + width * first, width * count)
    return [rows[width * i + 1 : width * i + 1 + size].decode().rstrip("\x00 ") for i in range(count)]


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class LineWriter(DataSourceWriter):
    """Each task writes one shape file under a hidden name; the commit gives all their own."""

    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("shape files are appended; choose a new folder to replace some")
        self.path = options["path"]

    def write(self, rows: Iterator) -> Written:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        base = f"{root.rstrip('/')}/.{uuid.uuid4().hex}"
        box, words, number = np.array([np.inf, np.inf, -np.inf, -np.inf]), HEADER // 2, 0
        body, index, table = [], [], []
        for r in rows:
            name = (r["line"] or "").encode()
            if len(name) > NAME_BYTES:
                raise ValueError("a line's name is too long for its attribute")
            points = np.array([(p["lon"], p["lat"]) for p in r["points"] or ()], "<f8").reshape(-1, 2)
            if len(points):
                own = np.concatenate([points.min(axis=0), points.max(axis=0)])
                box = np.concatenate([np.minimum(box[:2], own[:2]), np.maximum(box[2:], own[2:])])
                content = struct.pack("<i4d3i", POLYLINE, *own, 1, len(points), 0) + points.tobytes()
            else:
                content = struct.pack("<i", NOTHING)
            number += 1
            index.append(struct.pack(">2i", words, len(content) // 2))
            body.append(struct.pack(">2i", number, len(content) // 2) + content)
            table.append(b" " + name.ljust(NAME_BYTES))
            words += (RECORD_HEADER + len(content)) // 2
        if not number:
            return Written([])
        box = np.where(np.isfinite(box), box, 0.0)
        field = struct.pack("<11sc4xBB14x", b"LINE", b"C", NAME_BYTES, 0)
        head = struct.pack("<4BIHH20x", 3, 126, 1, 1, number, 32 + FIELD + 1, NAME_BYTES + 1) + field + b"\r"
        for end, parts in ((".shp", [_header(words, box), *body]), (".shx", [_header((HEADER + INDEX_ENTRY * number) // 2, box), *index]), (".dbf", [head, *table, b"\x1a"])):
            with system.open_output_stream(base + end) as f:
                for p in parts:
                    f.write(p)
        return Written([base])

    def commit(self, messages: list[Written | None]) -> None:
        self._each(messages, lambda system, path, shown: system.move(path, shown))

    def abort(self, messages: list[Written | None]) -> None:
        self._each(messages, lambda system, path, _: system.delete_file(path))

    def _each(self, messages, do) -> None:
        system, _ = _open(self.path)
        for m in messages:
            for base in m.paths if m else ():
                folder, _, name = base.rpartition("/")
                for end in (".dbf", ".shx", ".shp"):  # a reader looks for the last
                    do(system, base + end, f"{folder}/{name.removeprefix('.')}{end}")


class ShapeLines(DataSource):
    """Format ``shape_lines``: (line, part, points), a row for each part of a polyline.

    line is the first attribute of the record. Options: ``path`` (a file or folder that driver and
    executors reach by pyarrow's file systems), ``box`` (min lat, min lon, max lat, max lon:
    files and records whose box is apart are not read further), ``recordsPerPartition``. Records
    without a shape give no row. Written rows are records of one part each; rows without
    points become records without a shape.
    """

    @classmethod
    def name(cls) -> str:
        return "shape_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LineReader:
        return LineReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(dict(self.options), overwrite)


def read_lines(spark: SparkSession, path: str, *, box: tuple[float, float, float, float] | None = None, **options: str) -> DataFrame:
    """(line, part, points) of the shape files under a path."""
    spark.dataSource.register(ShapeLines)
    reader = spark.read.format("shape_lines").options(**options)
    return (reader.option("box", ",".join(map(str, box))) if box else reader).load(path)


def write_lines(df: DataFrame, path: str) -> None:
    """Append (line, points) as shape files, one for each partition that has rows."""
    df.sparkSession.dataSource.register(ShapeLines)
    df.select("line", F.lit(0).alias("part"), "points").write.format("shape_lines").mode("append").save(path)


def segments_of(lines: DataFrame) -> DataFrame:
    """(line, lat1, lon1, lat2, lon2): the segments of polylines, as :func:`panelworks.operators.geo.nearest_segment` takes them."""
    ends = F.arrays_zip(F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(0))).alias("a"), F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))).alias("b"))
    s = lines.where("size(points) > 1").select("line", F.explode(ends).alias("s"))
    return s.select("line", F.col("s.a.lat").alias("lat1"), F.col("s.a.lon").alias("lon1"), F.col("s.b.lat").alias("lat2"), F.col("s.b.lon").alias("lon2"))
