"""PLY meshes as a Python data source: ``spark.read.format("ply").option("element", "vertex").load(path)``.

The header is the schema.  A file is one partition, or several of fixed-width
binary rows; only the rows of the element asked for are decoded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, ByteType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructField, StructType

#: Scalar names of the format, their struct code and Spark type (unsigned ones one size up).
SCALARS = {
    "char": ("b", ByteType()), "int8": ("b", ByteType()), "uchar": ("B", ShortType()), "uint8": ("B", ShortType()),
    "short": ("h", ShortType()), "int16": ("h", ShortType()), "ushort": ("H", IntegerType()), "uint16": ("H", IntegerType()),
    "int": ("i", IntegerType()), "int32": ("i", IntegerType()), "uint": ("I", LongType()), "uint32": ("I", LongType()),
    "int64": ("q", LongType()), "uint64": ("Q", DecimalType(20, 0)), "float": ("f", FloatType()), "float32": ("f", FloatType()), "double": ("d", DoubleType()), "float64": ("d", DoubleType()),
}
ROWS_A_PARTITION = 1_000_000


@dataclass
class Property:
    name: str
    kind: str
    count: str | None = None


@dataclass
class Element:
    name: str
    rows: int
    properties: list[Property] = field(default_factory=list)

    def width(self) -> int | None:
        """Bytes of a binary row, or None if it holds a list."""
        return None if any(p.count for p in self.properties) else struct.calcsize("<" + "".join(SCALARS[p.kind][0] for p in self.properties))


@dataclass
class Header:
    layout: str
    elements: list[Element]
    comments: list[str]
    size: int


def parse_header(data: bytes) -> Header:
    """Strict: magic, a known layout, known types, counts of 0 or more, and an end."""
    end = data.find(b"end_header")
    stop = data.find(b"\n", end)
    if not data.startswith(b"ply") or end < 0 or stop < 0:
        raise ValueError("no complete PLY header")
    layout, elements, comments = "", [], []
    for line in data[:end].decode("ascii").splitlines()[1:]:
        words = line.split()
        match words[:1]:
            case ["format"]:
                layout = words[1].lower()
            case ["comment"]:
                comments.append(" ".join(words[1:]))
            case ["element"]:
                if not words[2].isdigit():
                    raise ValueError(f"bad element count: {line!r}")
                elements.append(Element(words[1], int(words[2])))
            case ["property"]:
                kinds = words[2:4] if words[1] == "list" else words[1:2]
                if not elements or any(k not in SCALARS for k in kinds):
                    raise ValueError(f"bad property: {line!r}")
                elements[-1].properties.append(Property(words[4], kinds[1], kinds[0]) if words[1] == "list" else Property(words[2], words[1]))
    if layout not in ("ascii", "binary_little_endian", "binary_big_endian"):
        raise ValueError(f"unknown PLY layout: {layout!r}")
    return Header(layout, elements, comments, stop + 1)


def spark_schema(element: Element) -> StructType:
    cell = lambda p: ArrayType(SCALARS[p.kind][1], False) if p.count else SCALARS[p.kind][1]
    return StructType([StructField("row", LongType(), False), *(StructField(p.name, cell(p)) for p in element.properties)])


def _read_bytes(path: str) -> bytes:
    with open(path.removeprefix("file://").removeprefix("file:"), "rb") as f:
        return f.read()


def _head(path: str) -> bytes:
    with open(path.removeprefix("file://").removeprefix("file:"), "rb") as f:
        return f.read(1 << 16)


def _python(value, kind: str):
    if kind == "uint64":
        from decimal import Decimal

        return Decimal(value)
    return value


def decode(data: bytes, header: Header, name: str, first: int = 0, last: int | None = None) -> Iterator[tuple]:
    """Rows ``first`` to ``last`` of element ``name``; a payload that is too short is an error."""
    at = header.size
    order = ">" if header.layout == "binary_big_endian" else "<"
    tokens = iter(data[header.size :].split()) if header.layout == "ascii" else None
    for e in header.elements:
        wanted = e.name == name
        width = e.width()
        if tokens is None and width is not None:
            if at + width * e.rows > len(data):
                raise ValueError("PLY payload is too short")
            if wanted:
                form = struct.Struct(order + "".join(SCALARS[p.kind][0] for p in e.properties))
                for k in range(first, e.rows if last is None else min(last, e.rows)):
                    yield (k, *(_python(v, p.kind) for v, p in zip(form.unpack_from(data, at + k * width), e.properties, strict=True)))
                return
            at += width * e.rows
            continue
        for k in range(e.rows):
            row: list = []
            for p in e.properties:
                try:
                    if tokens is not None:
                        number = int if SCALARS[p.kind][0] in "bBhHiIqQ" else float
                        n = int(next(tokens)) if p.count else 1
                        values = [number(next(tokens)) for _ in range(n)]
                    else:
                        n = 1
                        if p.count:
                            (n,) = struct.unpack_from(order + SCALARS[p.count][0], data, at)
                            at += struct.calcsize(SCALARS[p.count][0])
                        values = list(struct.unpack_from(order + SCALARS[p.kind][0] * n, data, at))
                        at += struct.calcsize("<" + SCALARS[p.kind][0]) * n
                except (StopIteration, struct.error) as error:
                    raise ValueError("PLY payload is too short") from error
                values = [_python(v, p.kind) for v in values]
                row.append(values if p.count else values[0])
            if wanted and k >= first and (last is None or k < last):
                yield (k, *row)
        if wanted:
            return


@dataclass
class _Part(InputPartition):
    path: str
    first: int
    last: int | None


class _Reader(DataSourceReader):
    def __init__(self, path: str, element: str):
        self.path, self.element = path, element

    def partitions(self):
        header = parse_header(_head(self.path))
        e = next(e for e in header.elements if e.name == self.element)
        if header.layout == "ascii" or e.width() is None:
            return [_Part(self.path, 0, None)]
        return [_Part(self.path, k, k + ROWS_A_PARTITION) for k in range(0, max(1, e.rows), ROWS_A_PARTITION)]

    def read(self, partition):
        data = _read_bytes(partition.path)
        yield from decode(data, parse_header(data), self.element, partition.first, partition.last)


class _Writer(DataSourceWriter):
    """Writes one ASCII vertex file from rows of (x, y, z[, ...]); the rows come in one partition, in order."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, [f.name for f in schema.fields]

    def write(self, iterator):
        rows = [" ".join(format(float(v), ".17g") for v in r) for r in iterator]
        if rows:
            head = ["ply", "format ascii 1.0", f"element vertex {len(rows)}", *(f"property double {n}" for n in self.names), "end_header"]
            with open(self.path.removeprefix("file://").removeprefix("file:"), "x") as f:
                f.write("\n".join([*head, *rows]) + "\n")
        return WriterCommitMessage()


class PlyDataSource(DataSource):
    """Options: path, element (default vertex)."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self):
        header = parse_header(_head(self.options["path"]))
        wanted = self.options.get("element", "vertex")
        return spark_schema(next(e for e in header.elements if e.name == wanted))

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("element", "vertex"))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], schema)
