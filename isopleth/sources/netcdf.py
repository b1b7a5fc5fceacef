"""NetCDF classic files (CDF-1, CDF-2, CDF-5) as a Spark data source: read and written in parts by many tasks.

Reading. Only headers are read where the query is planned: a file of any size is cut into partitions, ranges of its first
axis (and of the second one, where one step of the first is large) of about `partition_bytes`, and each task seeks to its
own bytes. Ranges of coordinates prune what is read: steps of the first axis, and rows of the second; ranges of the further
axes are cut out of what was read. A row of the table is a point of the grid: a column for each dimension (its coordinate
variable, decoded where it is a time; its number where there is none), and a double for each variable. Missing and fill
values are NULL; scale and offset are applied.

Writing. Each task writes the rows of its partition as one file of 64-bit offsets (CDF-2) with `time` as its unlimited
dimension; put rows of one time into one partition before (`write_netcdf` does). A file takes its name when the job
commits, so that tasks that are run again leave nothing behind.

Options of the reader: `path` (a file, a folder, or a pattern in the last part), `variables` (by commas; else all that have
the dimensions of the largest one), `range.<dimension>` (lowest,highest), `partition_bytes`, `missing` (false: no rows for
points without any value). Paths are those of pyarrow's file systems: local ones, file:, hdfs:, s3: and so on.

Coordinate variables are expected to be one-dimensional and, for an unlimited axis, in order: only their values at the
borders of partitions are read to prune; out of order, nothing is pruned. Calendars other than the usual one are an error.
"""

from __future__ import annotations

import fnmatch
import io
import struct
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.schema import DIMENSIONS, TIME
from ..plans.session import ship

NAME = "netcdf"
PARTITION_BYTES = 32 << 20
#: Rows of an Arrow batch.
ROWS = 1 << 16

# fixed values of the file format: tags of lists, and types by number
TAG_DIMENSION, TAG_VARIABLE, TAG_ATTRIBUTE = 10, 11, 12
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
STREAMING = {4: 0xFFFFFFFF, 8: 0xFFFFFFFFFFFFFFFF}
CALENDARS = ("standard", "gregorian", "proleptic_gregorian")
_UNITS = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1000, "microsecond": 1}


def _file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path


def files_of(path: str) -> list[str]:
    """Files of a path, in order: itself, those of a folder, or those whose names match a pattern."""
    system, place = _file_system(path)
    top, _, last = place.rstrip("/").rpartition("/")
    pattern = last if any(c in last for c in "*?[") else None
    prefix = path[: len(path.rstrip("/")) - len(place.rstrip("/"))] if path.rstrip("/").endswith(place.rstrip("/")) else ""
    if pattern is None and system.get_file_info(place).type == arrow_fs.FileType.File:
        return [path]
    found = system.get_file_info(arrow_fs.FileSelector(top if pattern else place))
    names = [x.path for x in found if x.type == arrow_fs.FileType.File and not x.base_name.startswith(("_", ".")) and fnmatch.fnmatch(x.base_name, pattern or "*.nc")]
    if not names:
        raise FileNotFoundError(f"no files at {path}")
    return sorted(prefix + x for x in names)


@dataclass
class Variable:
    """A variable of a file: where its values are, and what its attributes say."""

    name: str
    dims: tuple[str, ...]
    dtype: str
    begin: int
    record: bool
    attributes: dict = field(default_factory=dict)


@dataclass
class Header:
    """What a file holds."""

    dims: dict[str, int]
    variables: dict[str, Variable]
    record_dim: str | None
    record_size: int

    def shape(self, v: Variable) -> tuple[int, ...]:
        return tuple(self.dims[d] for d in v.dims)


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at, self.wide = data, 0, 4

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, size: int | None = None) -> int:
        return int.from_bytes(self.take(size or self.wide), "big")

    def padded(self, n: int) -> bytes:
        out = self.take(n)
        self.take(-n % 4)
        return out

    def name(self) -> str:
        return self.padded(self.number()).decode()

    def items(self, tag: int) -> range:
        found, n = self.number(4), self.number()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError("not a header of this format")
        return range(n)


def parse_header(data: bytes, file_size: int) -> Header:
    """The header at the start of a file; EOFError if more bytes are needed."""
    c = _Cursor(data)
    magic = c.take(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("not a NetCDF classic file")
    c.wide = 8 if magic[3] == 5 else 4
    records = c.number()
    dims = [(c.name(), c.number()) for _ in c.items(TAG_DIMENSION)]

    def attributes() -> dict:
        out = {}
        for _ in c.items(TAG_ATTRIBUTE):
            name, kind, n = c.name(), c.number(4), c.number()
            raw = c.padded(n * np.dtype(TYPES[kind]).itemsize)
            out[name] = raw.decode("utf-8", "replace").rstrip("\0") if kind == 2 else np.frombuffer(raw, TYPES[kind])
        return out

    attributes()
    variables, sizes = {}, []
    for _ in c.items(TAG_VARIABLE):
        name = c.name()
        ids = [c.number() for _ in range(c.number())]
        own, kind = attributes(), c.number(4)
        c.number()  # a size that is computed anyway
        begin = c.number(4 if magic[3] == 1 else 8)
        record = bool(ids) and dims[ids[0]][1] == 0
        variables[name] = Variable(name, tuple(dims[i][0] for i in ids), TYPES[kind], begin, record, own)
        if record:
            sizes.append(int(np.prod([dims[i][1] for i in ids[1:]], dtype=np.int64)) * np.dtype(TYPES[kind]).itemsize)
    record_dim = next((name for name, n in dims if n == 0), None)
    # records are padded, but for a single variable
    record_size = sizes[0] if len(sizes) == 1 else sum(x + -x % 4 for x in sizes)
    if records == STREAMING[c.wide]:
        first = min((v.begin for v in variables.values() if v.record), default=0)
        records = (file_size - first) // record_size if record_size else 0
    return Header({name: n or (records if name == record_dim else 0) for name, n in dims}, variables, record_dim, record_size)


def read_header(path: str) -> Header:
    system, place = _file_system(path)
    size = system.get_file_info(place).size
    with system.open_input_file(place) as file:
        n = 1 << 16
        while True:
            try:
                return parse_header(file.read_at(min(n, size), 0), size)
            except EOFError:
                if n >= size:
                    raise ValueError(f"{path} ends within its header") from None
                n *= 4


def _time_units(v: Variable) -> tuple[int, int] | None:
    """Microseconds of a unit, and those from 1970 to its zero, of a variable that is a time."""
    unit, since, start = str(v.attributes.get("units", "")).partition(" since ")
    if not since:
        return None
    calendar = str(v.attributes.get("calendar", "standard")).lower()
    if calendar not in CALENDARS:
        raise ValueError(f"{v.name} has the calendar {calendar!r}; only {CALENDARS} are read")
    size = _UNITS.get(unit.strip().lower().rstrip("s"))
    if size is None:
        raise ValueError(f"{v.name} counts {unit!r}")
    date, _, clock = start.strip().replace("T", " ").removesuffix("Z").removesuffix(" UTC").strip().partition(" ")
    year, month, day = (int(x) for x in date.split("-"))
    seconds = 0.0
    for part, scale in zip(clock.strip().split(":") if clock.strip() else [], (3600, 60, 1), strict=False):
        seconds += float(part) * scale
    return size, (datetime(year, month, day) - datetime(1970, 1, 1)).days * 86_400_000_000 + round(seconds * 1e6)


def _decoded(v: Variable, raw: np.ndarray) -> np.ndarray:
    """Doubles, with NaN for what is missing, scaled."""
    out = raw.astype(np.float64)
    for name in ("_FillValue", "missing_value"):
        for x in np.atleast_1d(v.attributes.get(name, [])):
            if not np.isnan(float(x)):
                out[raw == x] = np.nan
    for name, apply in (("scale_factor", np.multiply), ("add_offset", np.add)):
        if name in v.attributes:
            out = apply(out, float(np.atleast_1d(v.attributes[name])[0]))
    return out


def _coordinates(v: Variable, raw: np.ndarray) -> np.ndarray:
    """Values of an axis: microseconds since 1970 of a time, else doubles."""
    units = _time_units(v)
    if units is None:
        return _decoded(v, raw)
    if raw.dtype.kind in "iu":
        return raw.astype(np.int64) * units[0] + units[1]
    return np.round(raw.astype(np.float64) * units[0]).astype(np.int64) + units[1]


def read_axis(file, header: Header, dim: str, low: int, high: int) -> np.ndarray:
    """Coordinates of a part of an axis; numbers where it has none."""
    v = header.variables.get(dim)
    if v is None or v.dims != (dim,):
        return np.arange(low, high, dtype=np.float64)
    size = np.dtype(v.dtype).itemsize
    if v.record:
        raw = b"".join(file.read_at(size, v.begin + i * header.record_size) for i in range(low, high))
    else:
        raw = file.read_at((high - low) * size, v.begin + low * size)
    return _coordinates(v, np.frombuffer(raw, v.dtype))


def read_block(file, header: Header, v: Variable, ranges: Sequence[tuple[int, int]]) -> np.ndarray:
    """Values of a block of a variable: seeks to each step of the first axis, and to the rows of the second."""
    shape = header.shape(v)
    dtype = np.dtype(v.dtype)
    row = int(np.prod(shape[2:], dtype=np.int64)) * dtype.itemsize  # of the second axis
    if len(shape) == 1:
        (low, high), step = ranges[0], header.record_size if v.record else dtype.itemsize
        if v.record:
            raw = b"".join(file.read_at(dtype.itemsize, v.begin + i * step) for i in range(low, high))
        else:
            raw = file.read_at((high - low) * step, v.begin + low * step)
        return np.frombuffer(raw, dtype)
    (low, high), (a, b) = ranges[:2]
    step = header.record_size if v.record else shape[1] * row
    if not v.record and (a, b) == (0, shape[1]):
        raw = file.read_at((high - low) * step, v.begin + low * step)
    else:
        raw = b"".join(file.read_at((b - a) * row, v.begin + i * step + a * row) for i in range(low, high))
    block = np.frombuffer(raw, dtype).reshape(high - low, b - a, *shape[2:])
    return block[(slice(None), slice(None), *(slice(*r) for r in ranges[2:]))]


def chosen(header: Header, wanted: Sequence[str] | None) -> list[Variable]:
    """The variables of a table: those asked for, or all with the dimensions of the largest one."""
    data = [v for v in header.variables.values() if v.dims and v.dims != (v.name,) and v.dtype != "S1"]
    if wanted:
        missing = [x for x in wanted if x not in {v.name for v in data}]
        if missing:
            raise ValueError(f"there are no variables {missing}; the file has {[v.name for v in data]}")
        data = [header.variables[x] for x in wanted]
        if len({v.dims for v in data}) > 1:
            raise ValueError("variables of one table have the same dimensions")
        return data
    if not data:
        raise ValueError("the file has no variables")
    largest = max(data, key=lambda v: len(v.dims))
    return [v for v in data if v.dims == largest.dims]


def _bound(text: str, time: bool) -> float:
    text = text.strip()
    if not text:
        return float("nan")
    return (datetime.fromisoformat(text) - datetime(1970, 1, 1)).total_seconds() * 1e6 if time else float(text)


@dataclass
class Part(InputPartition):
    """A block of a file."""

    path: str
    header: Header
    names: list[str]
    ranges: list[tuple[int, int]]


class NetcdfReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.path = options["path"]
        self.wanted = [x.strip() for x in options["variables"].split(",")] if options.get("variables") else None
        self.size = int(options.get("partition_bytes", PARTITION_BYTES))
        self.missing = str(options.get("missing", "true")).lower() != "false"
        self.bounds: dict[str, tuple[float, float]] = {}
        self.text = {k[len("range.") :]: x for k, x in options.items() if k.startswith("range.")}

    def _limits(self, header: Header, dim: str) -> tuple[float, float] | None:
        v = header.variables.get(dim)
        time = v is not None and _time_units(v) is not None
        text = next((x for k, x in self.text.items() if k.lower() == dim.lower()), None)
        if text is None:
            return None
        low, _, high = text.partition(",")
        low, high = _bound(low, time), _bound(high, time)
        return (-np.inf if np.isnan(low) else low, np.inf if np.isnan(high) else high)

    def partitions(self) -> list[Part]:
        return [part for path in files_of(self.path) for part in self.parts(path)]

    def parts(self, path: str) -> Iterator[Part]:
        """Blocks of a file that may hold points within the ranges."""
        header = read_header(path)
        variables = chosen(header, self.wanted)
        dims, shape = variables[0].dims, header.shape(variables[0])
        system, place = _file_system(path)
        with system.open_input_file(place) as file:
            ranges, later = [], None
            for i, (d, n) in enumerate(zip(dims, shape, strict=True)):
                limits = self._limits(header, d)
                v = header.variables.get(d)
                if limits is None or not n:
                    ranges.append((0, n))
                elif i == 0 and v is not None and v.record:
                    ranges.append((0, n))
                    later = limits
                else:
                    axis = read_axis(file, header, d, 0, n)
                    inside = np.flatnonzero((axis >= limits[0]) & (axis <= limits[1]))
                    ranges.append((int(inside[0]), int(inside[-1]) + 1) if len(inside) else (0, 0))
            if any(a == b for a, b in ranges):
                return
            width = [b - a for a, b in ranges]
            item = sum(np.dtype(v.dtype).itemsize for v in variables)
            row = item * int(np.prod(width[2:], dtype=np.int64))
            steps = max(1, self.size // max(1, row * (width[1] if len(width) > 1 else 1)))
            rows = max(1, self.size // max(1, row)) if steps == 1 else max(width[1:2], default=1)
            firsts = [(x, min(x + steps, ranges[0][1])) for x in range(*ranges[0], steps)]
            if later is not None:
                ends = np.array([read_axis(file, header, dims[0], x, x + 1)[0] for a, b in firsts for x in (a, b - 1)])
                if (np.diff(ends) >= 0).all():
                    firsts = [x for x, a, b in zip(firsts, ends[::2], ends[1::2], strict=True) if b >= later[0] and a <= later[1]]
        for first in firsts:
            seconds = [(x, min(x + rows, ranges[1][1])) for x in range(*ranges[1], rows)] if len(ranges) > 1 else [None]
            for second in seconds:
                yield Part(path, header, [v.name for v in variables], [first, *([second] if second else []), *ranges[2:]])

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # nothing is within the ranges
            return
        header = part.header
        variables = [header.variables[x] for x in part.names]
        dims = variables[0].dims
        system, place = _file_system(part.path)
        with system.open_input_file(place) as file:
            axes = [read_axis(file, header, d, *r) for d, r in zip(dims, part.ranges, strict=True)]
            times = [header.variables.get(d) is not None and _time_units(header.variables[d]) is not None for d in dims]
            inner = int(np.prod([len(x) for x in axes[1:]], dtype=np.int64))
            steps = max(1, ROWS // max(1, inner))
            rows = max(1, ROWS // max(1, int(np.prod([len(x) for x in axes[2:]], dtype=np.int64)))) if steps == 1 else max(1, inner)
            low, high = part.ranges[0]
            second = part.ranges[1] if len(axes) > 1 else (0, 1)
            for start, row in ((x, y) for x in range(low, high, steps) for y in range(*second, rows)):
                own = [(start, min(start + steps, high)), *([(row, min(row + rows, second[1]))] if len(axes) > 1 else []), *part.ranges[2:]]
                values = [_decoded(v, read_block(file, header, v, own)).reshape(-1) for v in variables]
                grid = np.meshgrid(*(x[r[0] - whole[0] : r[1] - whole[0]] for x, r, whole in zip(axes, own, part.ranges, strict=True)), indexing="ij")
                columns = [pa.array(g.reshape(-1), pa.timestamp("us")) if t else pa.array(g.reshape(-1), from_pandas=True) for g, t in zip(grid, times, strict=True)]
                batch = pa.RecordBatch.from_arrays([*columns, *(pa.array(x, from_pandas=True) for x in values)], [*dims, *part.names])
                if not self.missing:
                    batch = batch.filter(pa.array(~np.logical_and.reduce([np.isnan(x) for x in values])))
                for at in range(0, batch.num_rows, ROWS):
                    yield batch.slice(at, ROWS)


@dataclass
class Written(WriterCommitMessage):
    """A file that a task wrote, under its own name and under the one it takes."""

    own: str | None
    name: str | None


class NetcdfWriter(DataSourceArrowWriter):
    def __init__(self, options: Mapping[str, str], schema: T.StructType, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.dims = [f.name for f in schema if f.name in DIMENSIONS or isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType, T.DateType))]
        self.dims.sort(key=lambda d: d != TIME)
        self.variables = [f.name for f in schema if f.name not in self.dims]
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        batches = [b for b in iterator if b.num_rows]
        if not batches:
            return Written(None, None)
        from pyspark import TaskContext

        system, place = _file_system(self.path)
        folder = f"{place.rstrip('/')}/_temporary-{self.job}"
        system.create_dir(folder, recursive=True)
        own = f"{folder}/{uuid.uuid4().hex}.nc"
        with system.open_output_stream(own) as out:
            out.write(encode(pa.Table.from_batches(batches), self.dims, self.variables))
        return Written(own, f"{place.rstrip('/')}/part-{TaskContext.get().partitionId():05d}-{self.job}.nc")

    def commit(self, messages: list[Written | None]) -> None:
        system, place = _file_system(self.path)
        if self.overwrite and system.get_file_info(place).type == arrow_fs.FileType.Directory:
            for x in system.get_file_info(arrow_fs.FileSelector(place)):
                if x.base_name.endswith(".nc"):
                    system.delete_file(x.path)
        system.create_dir(place, recursive=True)
        for m in messages:
            if m is not None and m.own:
                system.move(m.own, m.name)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, place = _file_system(self.path)
        folder = f"{place.rstrip('/')}/_temporary-{self.job}"
        if system.get_file_info(folder).type == arrow_fs.FileType.Directory:
            system.delete_dir(folder)


def encode(rows: pa.Table, dims: Sequence[str], variables: Sequence[str]) -> bytes:
    """A file of the dense block that rows span: the first dimension is unlimited, points without a row are missing."""
    axes, places = [], []
    for d in dims:
        column = rows.column(d)
        if column.null_count:
            raise ValueError(f"the dimension {d} has missing values")
        if pa.types.is_date(column.type) or pa.types.is_timestamp(column.type):
            column = column.cast(pa.timestamp("us")).cast(pa.int64())
            values = column.to_numpy() / 86_400_000_000
        else:
            values = column.cast(pa.float64()).to_numpy()
        axis, place = np.unique(values, return_inverse=True)
        axes.append(axis)
        places.append(place)
    shape = tuple(len(x) for x in axes)
    flat = np.ravel_multi_index(places, shape)
    if len(np.unique(flat)) < len(flat):
        raise ValueError("two rows have the same coordinates")
    blocks = []
    for v in variables:
        block = np.full(int(np.prod(shape, dtype=np.int64)), np.nan)
        block[flat] = rows.column(v).cast(pa.float64()).to_numpy()
        blocks.append(block.reshape(shape[0], -1).astype(">f8"))

    def text(x: str) -> bytes:
        raw = x.encode()
        return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)

    def attributes(own: dict[str, object]) -> bytes:
        out = struct.pack(">ii", TAG_ATTRIBUTE if own else 0, len(own))
        for name, x in own.items():
            out += text(name) + (struct.pack(">i", 2) + text(x) if isinstance(x, str) else struct.pack(">iid", 6, 1, x))
        return out

    every = [(d, [i], {"units": "days since 1970-01-01", "calendar": "standard"} if rows.schema.field(d).type not in (pa.float64(), pa.float32()) and not pa.types.is_integer(rows.schema.field(d).type) else {}) for i, d in enumerate(dims)]
    every += [(v, list(range(len(dims))), {"_FillValue": float("nan")}) for v in variables]
    inner = int(np.prod(shape[1:], dtype=np.int64)) * 8
    fixed = [(1 + i, n * 8) for i, n in enumerate(shape[1:])]

    def header(begins: list[int]) -> bytes:
        out = b"CDF\x02" + struct.pack(">i", shape[0])
        out += struct.pack(">ii", TAG_DIMENSION, len(dims)) + b"".join(text(d) + struct.pack(">i", 0 if i == 0 else shape[i]) for i, d in enumerate(dims))
        out += attributes({}) + struct.pack(">ii", TAG_VARIABLE, len(every))
        for (name, ids, own), begin in zip(every, begins, strict=True):
            size = 8 if ids == [0] else inner if 0 in ids else shape[ids[0]] * 8
            out += text(name) + struct.pack(f">i{len(ids)}i", len(ids), *ids) + attributes(own) + struct.pack(">iIq", 6, min(size, 0xFFFFFFFF), begin)
        return out

    at = len(header([0] * len(every)))
    begins = [0] * len(every)
    for i, size in fixed:
        begins[i], at = at, at + size
    begins[0], at = at, at + 8
    for i in range(len(variables)):
        begins[len(dims) + i], at = at, at + inner
    out = io.BytesIO()
    out.write(header(begins))
    for axis in axes[1:]:
        out.write(axis.astype(">f8").tobytes())
    first = axes[0].astype(">f8")
    for i in range(shape[0]):
        out.write(first[i : i + 1].tobytes())
        for block in blocks:
            out.write(block[i].tobytes())
    return out.getvalue()


class NetcdfSource(DataSource):
    """The format `netcdf`."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        header = read_header(files_of(self.options["path"])[0])
        wanted = [x.strip() for x in self.options["variables"].split(",")] if self.options.get("variables") else None
        variables = chosen(header, wanted)
        out = T.StructType()
        for d in variables[0].dims:
            v = header.variables.get(d)
            out.add(d, T.TimestampNTZType() if v is not None and _time_units(v) else T.DoubleType())
        for v in variables:
            out.add(v.name, T.DoubleType())
        return out

    def reader(self, schema: T.StructType) -> NetcdfReader:
        return NetcdfReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> NetcdfWriter:
        return NetcdfWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship(spark)
    spark.dataSource.register(NetcdfSource)


def read_netcdf(spark: SparkSession, path: str, variables: Sequence[str] | None = None, ranges: Mapping[str, tuple] | None = None, partition_bytes: int = PARTITION_BYTES, missing: bool = True) -> DataFrame:
    """A long table of NetCDF files; ranges: lowest and highest value of dimensions, each of them None for no bound."""
    register(spark)
    reader = spark.read.format(NAME).option("partition_bytes", partition_bytes).option("missing", str(missing).lower())
    if variables:
        reader = reader.option("variables", ",".join(variables))
    show = lambda x: "" if x is None else x.isoformat() if hasattr(x, "isoformat") else str(x)
    for d, (low, high) in (ranges or {}).items():
        reader = reader.option(f"range.{d}", f"{show(low)},{show(high)}")
    out = reader.load(path)
    for d, bounds in (ranges or {}).items():
        for x, inside in zip(bounds, (F.col(d) >= F.lit(bounds[0]), F.col(d) <= F.lit(bounds[1])), strict=True):
            out = out if x is None else out.where(inside)
    return out


def write_netcdf(data: DataFrame, path: str, time: str = TIME, mode: str = "append") -> None:
    """A long table to NetCDF files, one for each range of times; a partition is dense in memory when it is written."""
    register(data.sparkSession)
    n = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    data.repartitionByRange(n, time).write.format(NAME).mode(mode).save(path)
