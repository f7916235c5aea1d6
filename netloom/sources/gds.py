"""Layout streams (GDSII) as rows: boundaries, references and labels of every cell, and the flattened hierarchy.

A stream is a sequence of records. ``read_elements`` decodes a file in one task, files in parallel; ``read_runs`` indexes
where whole elements of each file begin and decodes runs of them in tasks of their own, with the same rows.

Paths become the boundaries of their outlines: each side is the line moved by half of the width, met in a mitre at a bend, or
in a bevel where the mitre would reach further than MITRE half widths; ends are flush, round, or longer by half of the width
or as given. An absolute width (below zero in the stream) counts as it stands and is magnified with the cell. A path without
width has no area and gives no row.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from netloom.operators.geometry import affine
from netloom.shared import cut

ELEMENTS = (
    "file string, cell string, kind string, ordinal int, layer int, datatype int, ring array<struct<x:double,y:double>>, ref string, "
    "text string, ox double, oy double, rotation double, reflect boolean, magnification double"
)
#: Record types of the format.
UNITS, ENDLIB, BGNSTR, STRNAME, ENDSTR, BOUNDARY, PATH, SREF, AREF, TEXT, LAYER, DATATYPE, WIDTH, XY, ENDEL, SNAME, COLROW, TEXTTYPE, STRING, STRANS, MAG, ANGLE, PATHTYPE, BGNEXTN, ENDEXTN = (
    0x03, 0x04, 0x05, 0x06, 0x07, 0x08, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x0E, 0x0F, 0x10, 0x11, 0x12, 0x13, 0x16, 0x19, 0x1A, 0x1B, 0x1C, 0x21, 0x30, 0x31,
)
PLACED = (BOUNDARY, PATH, SREF, AREF, TEXT)
#: Bytes of a run of elements, of a read while runs are looked for, and rows of a batch.
RUN_BYTES, INDEX_BYTES, ROWS = 8 << 20, 16 << 20, 10_000
#: Ends of paths: flush, round, half of the width longer, longer as given.
FLUSH, ROUND, HALF, GIVEN = 0, 1, 2, 4
#: Half widths that a mitre reaches at most, and sides of a round end.
MITRE, ROUND_SIDES = 2.0, 16


def real8(raw: bytes) -> float:
    """An excess-64, base-16 real."""
    head, mantissa = raw[0], int.from_bytes(raw[1:8], "big")
    return (-1.0 if head & 0x80 else 1.0) * mantissa / 2**56 * 16.0 ** ((head & 0x7F) - 64)


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 4 <= len(data):
        size, kind = struct.unpack_from(">HB", data, at)
        if size < 4:
            return
        yield kind, data[at + 4 : at + size]
        at += size


def outline(points: list[tuple[float, float]], width: float, ends: int = FLUSH, before: float = 0.0, after: float = 0.0) -> list[tuple[float, float]]:
    """The ring of a path; ``before`` and ``after``: by how much GIVEN ends are longer. Empty without width or length."""
    line = [p for i, p in enumerate(points) if i == 0 or p != points[i - 1]]
    half = abs(width) / 2
    if half == 0 or not line or len(line) == 1 and ends in (FLUSH, GIVEN):
        return []
    if len(line) == 1:  # a dot: its ends lie to the left and the right
        (x, y), turn = line[0], range(2 * ROUND_SIDES)
        if ends == ROUND:
            return [(x + half * math.cos(math.pi * k / ROUND_SIDES), y + half * math.sin(math.pi * k / ROUND_SIDES)) for k in turn]
        return [(x - half, y - half), (x + half, y - half), (x + half, y + half), (x - half, y + half)]
    ways = []
    for (x, y), (u, v) in zip(line, line[1:], strict=False):
        length = math.hypot(u - x, v - y)
        ways.append(((u - x) / length, (v - y) / length))
    longer = {HALF: (half, half), GIVEN: (before, after)}.get(ends, (0.0, 0.0))
    (x, y), (a, b) = line[0], ways[0]
    line[0] = (x - a * longer[0], y - b * longer[0])
    (x, y), (a, b) = line[-1], ways[-1]
    line[-1] = (x + a * longer[1], y + b * longer[1])

    def side(sign: float) -> list[tuple[float, float]]:
        """The line moved to its left (1) or right (-1)."""
        moved = [(line[0][0] - sign * half * ways[0][1], line[0][1] + sign * half * ways[0][0])]
        for k, ((x, y), (a, b), (c, d)) in enumerate(zip(line[1:-1], ways, ways[1:], strict=False)):
            bend, left = 1 + a * c + b * d, sign * (a * d - b * c)  # bend: twice the square of the half turn's cosine
            end, start = (x - sign * half * b, y + sign * half * a), (x - sign * half * d, y + sign * half * c)
            reach = min(math.dist(line[k], (x, y)), math.dist((x, y), line[k + 2]))
            if left <= 0 and bend > 2 / MITRE**2 - 1e-12 or left > 0 and bend > 1e-12 and half * left <= reach * bend:
                moved.append((x - sign * half * (b + d) / bend, y + sign * half * (a + c) / bend))
            else:  # a bevel outside; inside, the sides go by the corner where they don't meet
                moved += [end, (x, y), start] if left > 0 else [end, start]
        return [*moved, (line[-1][0] - sign * half * ways[-1][1], line[-1][1] + sign * half * ways[-1][0])]

    def cap(at: tuple[float, float], way: tuple[float, float]) -> list[tuple[float, float]]:
        """Half a circle from the right to the left of an end that points along ``way``."""
        start = math.atan2(way[1], way[0]) - math.pi / 2
        turn = [start + math.pi * k / ROUND_SIDES for k in range(1, ROUND_SIDES)] if ends == ROUND else []
        return [(at[0] + half * math.cos(t), at[1] + half * math.sin(t)) for t in turn]

    back = (-ways[0][0], -ways[0][1])
    return [*side(-1.0), *cap(line[-1], ways[-1]), *side(1.0)[::-1], *cap(line[0], back)]


def elements(data: bytes, unit: float = 1.0, cell: str | None = None, ordinal: int = 0) -> Iterator[dict]:
    """Boundaries (paths' outlines too), single and array references and labels of a stream, coordinates in user units.
    ``unit``, ``cell`` and the next ``ordinal`` hold until the stream gives its own. An array's places count one each, a path
    without an outline counts as well."""
    now = None
    for kind, body in records(data):
        if kind == UNITS:
            unit = real8(body[:8])
        elif kind == STRNAME:
            cell, ordinal = body.rstrip(b"\0").decode(), 0
            yield {"cell": cell, "kind": "cell", "ordinal": 0}
        elif kind in PLACED:
            now = {"kind": {BOUNDARY: "boundary", PATH: "path", SREF: "ref", AREF: "array", TEXT: "label"}[kind], "rotation": 0.0, "reflect": False, "magnification": 1.0}
        elif now is not None:
            if kind == LAYER:
                now["layer"] = struct.unpack(">h", body)[0]
            elif kind in (DATATYPE, TEXTTYPE):
                now["datatype"] = struct.unpack(">h", body)[0]
            elif kind == SNAME:
                now["ref"] = body.rstrip(b"\0").decode()
            elif kind == STRING:
                now["text"] = body.rstrip(b"\0").decode()
            elif kind == STRANS:
                now["reflect"] = bool(body[0] & 0x80)
            elif kind == MAG:
                now["magnification"] = real8(body)
            elif kind == ANGLE:
                now["rotation"] = math.radians(real8(body))
            elif kind == PATHTYPE:
                now["ends"] = struct.unpack(">h", body)[0]
            elif kind in (WIDTH, BGNEXTN, ENDEXTN):
                now[{WIDTH: "width", BGNEXTN: "before", ENDEXTN: "after"}[kind]] = struct.unpack(">i", body)[0] * unit
            elif kind == COLROW:
                now["grid"] = struct.unpack(">hh", body)
            elif kind == XY:
                flat = struct.unpack(f">{len(body) // 4}i", body)
                now["points"] = [(x * unit, y * unit) for x, y in zip(flat[::2], flat[1::2], strict=True)]
            elif kind == ENDEL:
                places = 1
                if "grid" in now:
                    places = now["grid"][0] * now["grid"][1]
                for k, made in enumerate(_placed(now)):
                    yield {"cell": cell, "ordinal": ordinal + k, **made}
                ordinal, now = ordinal + places, None


def _placed(element: dict) -> Iterator[dict]:
    points, grid = element.pop("points", []), element.pop("grid", None)
    if element["kind"] == "path":
        shape = {c: element.pop(c, 0) for c in ("width", "ends", "before", "after")}
        if ring := outline(points, **shape):
            yield element | {"kind": "boundary", "ring": [{"x": x, "y": y} for x, y in ring]}
    elif element["kind"] == "boundary":
        yield element | {"ring": [{"x": x, "y": y} for x, y in (points[:-1] if points[0] == points[-1] else points)]}
    elif element["kind"] == "array":
        columns, rows = grid
        (x0, y0), (x1, y1), (x2, y2) = points
        for c in range(columns):
            for r in range(rows):
                yield element | {"kind": "ref", "ox": x0 + (x1 - x0) * c / columns + (x2 - x0) * r / rows, "oy": y0 + (y1 - y0) * c / columns + (y2 - y0) * r / rows}
    elif points:
        element = {k: v for k, v in element.items() if k not in ("width", "ends", "before", "after")}  # of a label's strokes
        yield element | {"ox": points[0][0], "oy": points[0][1]}


def _frame(rows: list[dict]) -> pd.DataFrame:
    """Rows of ELEMENTS."""
    frame = pd.DataFrame(rows).reindex(columns=[c.split()[0] for c in ELEMENTS.split(", ")])
    return frame.astype({c: "Int32" for c in ("ordinal", "layer", "datatype")}).where(frame.notna(), None)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """ELEMENTS of the streams at ``path``."""

    def run(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [{"file": file, **e} for e in elements(content)]
                if rows:
                    yield _frame(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ELEMENTS)


def runs(chunks: Iterator[bytes], run_bytes: int) -> Iterator[tuple[int, int, float, str, int]]:
    """(first byte, end, unit, cell, ordinal) of runs of whole elements of a stream that comes in chunks, each of
    ``run_bytes`` or one element more, with what ``elements`` has to know at its start. Hops from record to record; of
    elements only an array's size is decoded."""
    held, base, at, start = b"", 0, 0, 0
    unit, cell, ordinal, places = 1.0, "", 0, 0
    before = unit, cell, ordinal
    for chunk in chunks:
        held, base, at = held[at:] + chunk, base + at, 0
        while at + 4 <= len(held):
            size, kind = struct.unpack_from(">HB", held, at)
            if size < 4 or at + size > len(held):
                break
            if kind in PLACED or kind == BGNSTR:
                if base + at - start >= run_bytes:
                    yield start, base + at, *before
                    start, before = base + at, (unit, cell, ordinal)
                places = 1 if kind != BGNSTR else 0
            elif kind == UNITS:
                unit = real8(held[at + 4 : at + 12])
            elif kind == STRNAME:
                cell, ordinal = held[at + 4 : at + size].rstrip(b"\0").decode(), 0
            elif kind == COLROW and places:
                columns, rows = struct.unpack_from(">hh", held, at + 4)
                places = columns * rows
            elif kind == ENDEL:
                ordinal, places = ordinal + places, 0
            at += size
    yield start, base + at, *before


@dataclass
class Run(InputPartition):
    """Whole elements that stand one after the other in a stream, and what holds at their start."""

    file: str
    start: int
    end: int
    unit: float
    cell: str
    ordinal: int


class RunsReader(DataSourceReader):
    """Index of runs and their decoder. Files are opened by pyarrow, in any store that it knows."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.run_bytes = schema, options["path"], int(options.get("run_bytes", RUN_BYTES))

    def partitions(self) -> list[Run]:
        store, place = fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")
        prefix = self.path.removesuffix(place) if ":" in self.path else "file:"
        info = store.get_file_info(place)
        files = store.get_file_info(fs.FileSelector(place, recursive=True)) if info.type == fs.FileType.Directory else [info]
        out = []
        for file in sorted((f.path for f in files if f.type != fs.FileType.Directory)):
            with store.open_input_stream(file) as stream:
                out += [Run(prefix + file, *run) for run in runs(iter(lambda: stream.read(INDEX_BYTES), b""), self.run_bytes)]
        return out

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        store, place = fs.FileSystem.from_uri(partition.file)
        with store.open_input_file(place) as file:
            data = file.read_at(partition.end - partition.start, partition.start)
        schema = to_arrow_schema(self.schema)
        rows = elements(data, partition.unit, partition.cell, partition.ordinal)
        while batch := list(islice(rows, ROWS)):
            yield pa.RecordBatch.from_pylist([{"file": partition.file, **r} for r in batch], schema)


class LayoutRuns(DataSource):
    """Layout streams at ``path`` in partitions of about ``run_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "netloom_layout"

    def schema(self) -> str:
        return ELEMENTS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RunsReader(schema, self.options)


def read_runs(spark: SparkSession, path: str, run_bytes: int = RUN_BYTES) -> DataFrame:
    """As ``read_elements``, a file or a folder, with large files in several tasks. The index is made when the plan is: one
    pass over the records' heads, not over the elements."""
    spark.dataSource.register(LayoutRuns)
    return spark.read.format(LayoutRuns.name()).option("run_bytes", str(run_bytes)).load(path)


def top_cells(rows: DataFrame) -> DataFrame:
    """(file, cell) of cells that no other refers to."""
    cells = rows.where("kind = 'cell'").select("file", "cell").distinct()
    used = rows.where("kind = 'ref'").select("file", F.col("ref").alias("cell")).distinct()
    return cells.join(used, ["file", "cell"], "left_anti")


def flatten(rows: DataFrame, top: DataFrame | None = None, max_depth: int = 64) -> DataFrame:
    """Boundaries and labels in the top cell's coordinates: (file, path, cell, kind, layer, datatype, ring, text, x, y).

    One round of joins a level of hierarchy; ``path`` is the ordinals of the references passed through. ``rows`` are read
    twice a level: cut them first.
    """
    refs = rows.where("kind = 'ref'").select("file", F.col("cell").alias("parent"), "ref", "ordinal", "ox", "oy", "rotation", "reflect", F.coalesce("magnification", F.lit(1.0)).alias("magnification"))
    flat = rows.where("kind IN ('boundary', 'label')").select("file", "cell", "kind", "layer", "datatype", "ring", "text", F.col("ox").alias("lx"), F.col("oy").alias("ly"))
    zero = [F.lit(0.0).alias(c) for c in ("px", "py", "pr")]
    level = (top if top is not None else top_cells(rows)).select("file", "cell", F.array().cast("array<int>").alias("path"), *zero, F.lit(False).alias("pm"), F.lit(1.0).alias("pg"))
    out = None
    for depth in range(max_depth + 1):
        if level.isEmpty():
            break
        if depth == max_depth:
            raise ValueError(f"hierarchy deeper than {max_depth}")
        x, y = affine(F.col("px"), F.col("py"), F.col("pr"), F.col("pm"), F.col("pg") * F.col("lx"), F.col("pg") * F.col("ly"))

        def place(p):
            px, py = affine(F.col("px"), F.col("py"), F.col("pr"), F.col("pm"), F.col("pg") * p["x"], F.col("pg") * p["y"])
            return F.struct(F.round(px, 9).alias("x"), F.round(py, 9).alias("y"))

        here = level.join(flat, ["file", "cell"]).select("file", "path", "cell", "kind", "layer", "datatype", F.transform("ring", place).alias("ring"), "text", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"))
        out = here if out is None else out.unionByName(here)
        ox, oy = affine(F.col("px"), F.col("py"), F.col("pr"), F.col("pm"), F.col("pg") * F.col("ox"), F.col("pg") * F.col("oy"))
        turn = F.col("pr") + F.when(F.col("pm"), -F.col("rotation")).otherwise(F.col("rotation"))
        below = level.join(refs.withColumnRenamed("parent", "cell"), ["file", "cell"]).select(
            "file", F.col("ref").alias("cell"), F.concat("path", F.array("ordinal")).alias("path"), ox.alias("px"), oy.alias("py"), turn.alias("pr"), (F.col("pm") != F.col("reflect")).alias("pm"), (F.col("pg") * F.col("magnification")).alias("pg")
        )
        level = cut(below, "level")
    return out
