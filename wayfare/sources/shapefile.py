"""Shapefiles as a Spark data source: read by ranges of records with a box pushed down, written by every task on its own.

Columns are the table's attributes, then xmin, xmax, ymin, ymax and parts (an
array of arrays of points x, y; null for shapes without a place). Files are
opened where tasks run, in any store that pyarrow's file systems reach.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from wayfare.session import ship

BOX = ("xmin", "xmax", "ymin", "ymax")
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
PLACE = [*(T.StructField(c, T.DoubleType()) for c in BOX), T.StructField("parts", T.ArrayType(T.ArrayType(POINT)))]
#: Fixed values of the format: shape types, file code, version, bytes of the headers.
NONE, DOT, LINE, AREA = 0, 1, 3, 5
CODE, VERSION, HEAD, ENTRY = 9994, 1000, 100, 8
LIST = "_files.json"


def _store(path: str):
    """File system and path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The .shp files without their ending: of a written folder those of its list, else all; of a file itself."""
    from pyarrow import fs

    store, at = _store(path)
    if at.endswith(".shp"):
        return [at[:-4]]
    names = sorted(i.path for i in store.get_file_info(fs.FileSelector(at)))
    listed = [n for n in names if n.endswith("/" + LIST)]
    if listed:
        with store.open_input_file(listed[0]) as f:
            return [f"{at.rstrip('/')}/{n}" for n in json.loads(f.read())]
    return [n[:-4] for n in names if n.endswith(".shp")]


def _fields(head: bytes) -> list[tuple[str, str, int, int]]:
    """name, type, bytes and decimals of a table's columns."""
    size = struct.unpack_from("<H", head, 8)[0]
    return [(f[:11].split(b"\0")[0].decode("utf-8"), chr(f[11]), f[16], f[17]) for f in (head[i : i + 32] for i in range(32, size - 1, 32)) if f[0] != 13]


def _type(kind: str, size: int, decimals: int) -> T.DataType:
    if kind in "NF":
        return T.LongType() if kind == "N" and decimals == 0 and size <= 20 else T.DoubleType()
    return T.BooleanType() if kind == "L" else T.StringType()


def _value(raw: bytes, kind: T.DataType):
    text = raw.decode("utf-8", "replace").strip(" \0")
    if not text or (isinstance(kind, T.BooleanType) and text == "?"):
        return None
    if isinstance(kind, T.BooleanType):
        return text in "YyTt"
    return int(text) if isinstance(kind, T.LongType) else float(text) if isinstance(kind, T.DoubleType) else text


class Range(ds.InputPartition):
    def __init__(self, file: str, first: int, last: int):
        self.file, self.first, self.last = file, first, last


class Reader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.step, self.schema = options["path"], int(options.get("records", 100_000)), schema
        self.tests: list[tuple[str, str, float]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Takes comparisons of the box with numbers, in full; Spark keeps the rest."""
        for f in filters:
            known = {ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}.get(type(f))
            if known and len(f.attribute) == 1 and f.attribute[0] in BOX and isinstance(f.value, (int, float)):
                self.tests.append((f.attribute[0], known, float(f.value)))
            else:
                yield f

    def _meets(self, box: dict[str, float]) -> bool:
        return all({">": box[c] > v, ">=": box[c] >= v, "<": box[c] < v, "<=": box[c] <= v}[op] for c, op, v in self.tests)

    def _may_hold(self, head: bytes) -> bool:
        """A file's box says whether any shape in it can pass."""
        x0, y0, x1, y1 = struct.unpack_from("<4d", head, 36)
        low, high = {"xmin": x0, "xmax": x0, "ymin": y0, "ymax": y0}, {"xmin": x1, "xmax": x1, "ymin": y1, "ymax": y1}
        return all((high if op[0] == ">" else low)[c] > v if op == ">" else high[c] >= v if op == ">=" else low[c] < v if op == "<" else low[c] <= v for c, op, v in self.tests)

    def partitions(self) -> list[Range]:
        store, out = _store(self.path)[0], []
        for file in _files(self.path):
            with store.open_input_file(f"{file}.shp") as f:
                if not self._may_hold(f.read(HEAD)):
                    continue
            n = (store.get_file_info(f"{file}.shx").size - HEAD) // ENTRY
            out += [Range(file, i, min(i + self.step, n)) for i in range(0, n, self.step)]
        return out

    def read(self, partition: Range | None) -> Iterator[tuple]:
        if partition is None:  # no partition is left
            return
        store = _store(self.path)[0]
        names = self.schema.names
        with store.open_input_file(f"{partition.file}.shp") as shp, store.open_input_file(f"{partition.file}.shx") as shx, store.open_input_file(f"{partition.file}.dbf") as dbf:
            top = dbf.read(32)
            size, width = struct.unpack_from("<HH", top, 8)
            fields, at = {}, 1
            for name, kind, n, decimals in _fields(top + dbf.read(size - 32)):
                fields[name] = (at, n, _type(kind, n, decimals))
                at += n
            for begin in range(partition.first, partition.last, 1000):
                count = min(1000, partition.last - begin)
                shx.seek(HEAD + begin * ENTRY)
                spots = [struct.unpack(">2i", shx.read(ENTRY)) for _ in range(count)]
                low = min(o for o, _ in spots) * 2
                shp.seek(low)
                shapes = shp.read(max(o + n for o, n in spots) * 2 + 8 - low)
                dbf.seek(size + begin * width)
                rows = dbf.read(count * width)
                for i, (offset, _) in enumerate(spots):
                    row = rows[i * width : (i + 1) * width]
                    place = self._place(shapes, offset * 2 + 8 - low)
                    if place is None or row[:1] == b"*":  # deleted
                        continue
                    yield tuple(place[c] if c in place else _value(row[fields[c][0] : fields[c][0] + fields[c][1]], fields[c][2]) if c in fields else None for c in names)

    def _place(self, data: bytes, at: int) -> dict | None:
        """Box and parts of the shape at a place, None where the pushed filters drop it; points are read of kept shapes only."""
        kind = struct.unpack_from("<i", data, at)[0] % 10  # with heights or measures: the same, then more
        if kind == NONE:
            return None if self.tests else dict.fromkeys((*BOX, "parts"))
        x0, y0, x1, y1 = struct.unpack_from("<2d", data, at + 4) * 2 if kind == DOT else struct.unpack_from("<4d", data, at + 4)
        box = {"xmin": x0, "xmax": x1, "ymin": y0, "ymax": y1}
        if not self._meets(box):
            return None
        if kind == DOT:
            return box | {"parts": [[(x0, y0)]]}
        if kind not in (LINE, AREA):
            raise ValueError(f"shape type {kind} is neither point, line nor polygon")
        parts, points = struct.unpack_from("<2i", data, at + 36)
        starts = [*struct.unpack_from(f"<{parts}i", data, at + 44), points]
        xy = struct.unpack_from(f"<{2 * points}d", data, at + 44 + 4 * parts)
        return box | {"parts": [[(xy[2 * i], xy[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:])]}


class Written(ds.WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class Writer(ds.DataSourceWriter):
    """Files of at most `records` shapes each; only those that a finished task names are in the folder's list."""

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.step = options["path"], int(options.get("records", 100_000))
        self.kind = AREA if options.get("kind", "line") == "polygon" else LINE
        self.fields = [f for f in schema if f.name not in (*BOX, "parts")]
        for f in self.fields:
            if len(f.name.encode()) > 10 or not isinstance(f.dataType, (T.StringType, T.BooleanType, T.LongType, T.IntegerType, T.DoubleType)):
                raise ValueError(f"{f.name}: names have 10 bytes at most, values are texts, numbers or booleans")

    def write(self, iterator: Iterator[T.Row]) -> Written:
        names, held = [], []
        for row in iterator:
            held.append(row)
            if len(held) == self.step:
                names.append(self._save(held))
                held = []
        return Written(names + ([self._save(held)] if held else []))

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _store(self.path)
        store.create_dir(at)
        with store.open_output_stream(f"{at}/{LIST}") as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, at = _store(self.path)
        for n in (n for m in messages if m for n in m.names):
            for end in ("shp", "shx", "dbf"):
                store.delete_file(f"{at}/{n}.{end}")

    def _save(self, rows: list[T.Row]) -> str:
        store, at = _store(self.path)
        store.create_dir(at)
        name = f"part-{uuid.uuid4().hex}"
        bodies, boxes = zip(*(self._shape(r["parts"]) for r in rows))
        seen = [b for b in boxes if b]
        box = tuple(f(b[i] for b in seen) for i, f in enumerate((min, min, max, max))) if seen else (0.0,) * 4
        offset, index = HEAD // 2, []
        for b in bodies:
            index.append(struct.pack(">2i", offset, len(b) // 2))
            offset += 4 + len(b) // 2
        head = lambda words: struct.pack(">7i", CODE, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", VERSION, self.kind, *box, 0, 0, 0, 0)
        with store.open_output_stream(f"{at}/{name}.shp") as f:
            f.write(head(offset) + b"".join(struct.pack(">2i", i + 1, len(b) // 2) + b for i, b in enumerate(bodies)))
        with store.open_output_stream(f"{at}/{name}.shx") as f:
            f.write(head((HEAD + ENTRY * len(rows)) // 2) + b"".join(index))
        with store.open_output_stream(f"{at}/{name}.dbf") as f:
            f.write(self._table(rows))
        return name

    def _shape(self, parts: list | None) -> tuple[bytes, tuple | None]:
        parts = [p for p in parts or [] if p]
        if not parts:
            return struct.pack("<i", NONE), None
        starts = [0]
        for p in parts:
            starts.append(starts[-1] + len(p))
        xs, ys = [q["x"] for p in parts for q in p], [q["y"] for p in parts for q in p]
        box = (min(xs), min(ys), max(xs), max(ys))
        flat = [v for q in zip(xs, ys) for v in q]
        return struct.pack(f"<i4d2i{len(parts)}i{len(flat)}d", self.kind, *box, len(parts), len(xs), *starts[:-1], *flat), box

    def _table(self, rows: list[T.Row]) -> bytes:
        columns = []
        for f in self.fields:
            texts = [self._text(r[f.name], f.dataType) for r in rows]
            kind = "C" if isinstance(f.dataType, T.StringType) else "L" if isinstance(f.dataType, T.BooleanType) else "F" if isinstance(f.dataType, T.DoubleType) else "N"
            width = {"C": max([1, *map(len, texts)]), "L": 1, "F": 24, "N": 20}[kind]
            if width > 254:
                raise ValueError(f"{f.name}: texts have 254 bytes at most")
            columns.append((f.name.encode(), kind, width, 15 if kind == "F" else 0, texts))
        head = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + 32 * len(columns), 1 + sum(c[2] for c in columns))
        head += b"".join(struct.pack("<11sc4xBB14x", n, k.encode(), w, d) for n, k, w, d, _ in columns) + b"\r"
        return head + b"".join(b" " + b"".join(c[4][i].ljust(c[2]) if c[1] == "C" else c[4][i].rjust(c[2]) for c in columns) for i in range(len(rows))) + b"\x1a"

    @staticmethod
    def _text(value, kind: T.DataType) -> bytes:
        if value is None:
            return b"?" if isinstance(kind, T.BooleanType) else b""
        return (b"T" if value else b"F") if isinstance(kind, T.BooleanType) else (repr(value) if isinstance(kind, T.DoubleType) else str(value)).encode()


class Shapefile(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> T.StructType:
        store, files = _store(self.options["path"])[0], _files(self.options["path"])
        fields = []
        if files:
            with store.open_input_file(f"{files[0]}.dbf") as f:
                head = f.read(32)
                fields = _fields(head + f.read(struct.unpack_from("<H", head, 8)[0] - 32))
        return T.StructType([T.StructField(n, _type(k, s, d)) for n, k, s, d in fields] + PLACE)

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Shapefile)


def read(spark: SparkSession, path: str, want: list[str] | None = None, records: int = 100_000) -> DataFrame:
    """Shapes of a file or folder; of the attributes in want those that are there. Blank texts and numbers are null, deleted rows are left out.

    Each task reads at most `records` shapes. Comparisons of xmin, xmax, ymin, ymax with numbers skip files by their
    header and shapes before their points are read. All files of a folder have the same attributes.
    """
    register(spark)
    rows = spark.read.format("shapefile").option("path", path).option("records", records).load()
    return rows if want is None else rows.select(*[c for c in want if c in rows.columns], *BOX, "parts")


def write(rows: DataFrame, path: str, kind: str = "line", records: int = 100_000) -> None:
    """Attributes and parts of rows as shapefiles in a new folder; no parts give a shape without a place."""
    register(rows.sparkSession)
    rows.write.format("shapefile").option("path", path).option("kind", kind).option("records", records).mode("append").save()
