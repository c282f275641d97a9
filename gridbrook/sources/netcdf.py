"""NetCDF classic files (format versions 1 and 2): a Python data source of hyperslabs, grids, points, and a writer.

A file is read through ``pyarrow.fs``, so its path may be that of any store that this knows.  Groups, chunks and
compression belong to the other, HDF5-based format and are not read here.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from gridbrook.operators.grid import GridSpec

#: Fixed values of the format: tags of the lists, and types with their numpy kinds and default fill values.
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
KINDS = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
FILLS = {1: -127, 2: "\0", 3: -32767, 4: -2147483647, 5: 9.969209968386869e36, 6: 9.969209968386869e36}
#: Values that one task writes into a file.
MOST_VALUES = 50_000_000


@dataclass
class Variable:
    name: str
    dims: list[str]
    kind: int
    attributes: dict = field(default_factory=dict)
    begin: int = 0
    size: int = 0

    def fill_value(self):
        found = self.attributes.get("_FillValue", self.attributes.get("missing_value", FILLS[self.kind]))
        return found[0] if isinstance(found, list) else found

    def cf_attributes(self) -> dict:
        """The attributes that the climate and forecast conventions know, where they are there."""
        return {k: self.attributes[k] for k in ("standard_name", "long_name", "units", "_FillValue", "missing_value", "scale_factor", "add_offset", "calendar", "bounds", "axis", "coordinates") if k in self.attributes}


@dataclass
class Header:
    dims: dict[str, int]
    variables: dict[str, Variable]
    attributes: dict
    records: str | None = None
    record_size: int = 0

    def shape(self, name: str) -> list[int]:
        return [self.dims[d] for d in self.variables[name].dims]


def _store(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path else path.replace("file:", "", 1))


def _open(path: str):
    fs, at = _store(path)
    return fs.open_input_file(at)


def read_header(path: str) -> Header:
    with _open(path) as f:
        return _parse(f)


def _parse(f) -> Header:
    magic = f.read(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2):
        raise ValueError("not a NetCDF file of the classic format")
    offset = ">i" if magic[3] == 1 else ">q"
    number = lambda kind=">i": struct.unpack(kind, f.read(struct.calcsize(kind)))[0]

    def text() -> str:
        n = number()
        return f.read(n + -n % 4)[:n].decode("utf-8")

    def attributes() -> dict:
        number()
        out = {}
        for _ in range(number()):
            name, kind, n = text(), number(), number()
            size = n * np.dtype(KINDS[kind]).itemsize
            raw = f.read(size + -size % 4)[:size]
            out[name] = raw.decode("utf-8") if kind == 2 else np.frombuffer(raw, KINDS[kind]).tolist()
        return out

    count = number()
    number()
    dims, records, names = {}, None, []
    for _ in range(number()):
        name, size = text(), number()
        names.append(name)
        if size == 0:
            records, size = name, count
        dims[name] = size
    file_attributes = attributes()
    number()
    variables = {}
    for _ in range(number()):
        name = text()
        own = [names[number()] for _ in range(number())]
        held = attributes()
        kind, size, begin = number(), number(), number(offset)
        variables[name] = Variable(name, own, kind, held, begin, size)
    of_records = [v for v in variables.values() if v.dims[:1] == [records] and records]
    return Header(dims, variables, file_attributes, records, sum(v.size for v in of_records))


def read_slab(path: str, header: Header, name: str, start: list[int], count: list[int], stride: list[int] | None = None) -> np.ndarray:
    """A hyperslab (start from 0, count and stride for each dimension); only the rows along the first one that it needs are read."""
    v, shape, stride = header.variables[name], header.shape(name), stride or [1] * len(start)
    kind = np.dtype(KINDS[v.kind])
    if any(c > 0 and not 0 <= s <= s + (c - 1) * t < n for s, c, t, n in zip(start, count, stride, shape)):
        raise ValueError(f"hyperslab outside of {name}{shape}")
    with _open(path) as f:
        if not shape:
            f.seek(v.begin)
            return np.frombuffer(f.read(kind.itemsize), kind)[0]
        inner = math.prod(shape[1:])
        step = header.record_size if v.dims[0] == header.records else inner * kind.itemsize
        rows = []
        for k in range(count[0]):
            f.seek(v.begin + (start[0] + k * stride[0]) * step)
            rows.append(np.frombuffer(f.read(inner * kind.itemsize), kind).reshape(shape[1:]))
    whole = np.stack(rows) if rows else np.empty([0, *shape[1:]], kind)
    return whole[(slice(None), *(slice(s, s + c * t, t) for s, c, t in zip(start[1:], count[1:], stride[1:])))]


def read_whole(path: str, header: Header, name: str) -> np.ndarray:
    shape = header.shape(name)
    return read_slab(path, header, name, [0] * len(shape), shape)


def to_bytes(dims: dict[str, int], variables: list[tuple[Variable, np.ndarray]], attributes: dict | None = None) -> bytes:
    """A file of format version 2 without record variables."""
    names = list(dims)
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    text = lambda s: struct.pack(">i", len(s.encode())) + pad(s.encode())

    def held(entries: dict) -> bytes:
        out = struct.pack(">ii", ATTRIBUTES if entries else 0, len(entries))
        for k, x in entries.items():
            if isinstance(x, str):
                out += text(k) + struct.pack(">ii", 2, len(x.encode())) + pad(x.encode())
            else:
                values = np.atleast_1d(np.asarray(x, ">i4" if all(isinstance(y, int) for y in np.atleast_1d(x).tolist()) else ">f8"))
                out += text(k) + struct.pack(">ii", 4 if values.dtype.kind == "i" else 6, len(values)) + pad(values.tobytes())
        return out

    head = b"CDF\x02" + struct.pack(">i", 0) + struct.pack(">ii", DIMENSIONS if dims else 0, len(dims)) + b"".join(text(k) + struct.pack(">i", n) for k, n in dims.items()) + held(attributes or {})
    head += struct.pack(">ii", VARIABLES if variables else 0, len(variables))
    told, bodies = [], []
    for v, values in variables:
        body = pad(np.ascontiguousarray(values, KINDS[v.kind]).tobytes())
        bodies.append(body)
        told.append(text(v.name) + struct.pack(">i", len(v.dims)) + b"".join(struct.pack(">i", names.index(d)) for d in v.dims) + held(v.attributes) + struct.pack(">ii", v.kind, len(body)))
    at = len(head) + sum(len(t) + 8 for t in told)
    for t, body in zip(told, bodies):
        head += t + struct.pack(">q", at)
        at += len(body)
    return head + b"".join(bodies)


def write_bytes(path: str, raw: bytes) -> None:
    fs, at = _store(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(at) as f:
        f.write(raw)


class _Slab(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class NetcdfReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.name, self.rows = options["path"], options["variable"], int(options.get("rowsperpartition", 64))
        self.header = read_header(self.path)
        self.dims = self.header.variables[self.name].dims
        self.low, self.high = 1, self.header.dims[self.dims[0]] if self.dims else 1

    def pushFilters(self, filters):
        """Bounds of the first dimension become bounds of the slabs that are read."""
        for f in filters:
            first = isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == (self.dims[0],)
            if first and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if first and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            yield f  # Spark checks all of them again

    def partitions(self):
        return [_Slab(a - 1, min(self.rows, self.high - a + 1)) for a in range(self.low, self.high + 1, self.rows)] or [_Slab(0, 0)]

    def read(self, partition):
        shape, v = self.header.shape(self.name), self.header.variables[self.name]
        slab = read_slab(self.path, self.header, self.name, [partition.first, *[0] * (len(shape) - 1)], [partition.count, *shape[1:]])
        places = np.meshgrid(*(np.arange(1, n + 1, dtype=np.int32) + (partition.first if k == 0 else 0) for k, n in enumerate(slab.shape)), indexing="ij")
        values = slab.astype(float).ravel()
        known = (values != v.fill_value()) & ~np.isnan(values)
        values = values * v.attributes.get("scale_factor", [1.0])[0] + v.attributes.get("add_offset", [0.0])[0]
        yield pa.RecordBatch.from_arrays([*(pa.array(p.ravel()[known]) for p in places), pa.array(values[known])], [*self.dims, "value"])


class Netcdf(DataSource):
    """format("netcdf"): places (from 1) along each dimension of ``variable`` and its known values; rows of the first dimension are read in parallel."""

    @classmethod
    def name(cls):
        return "netcdf"

    def schema(self):
        return ", ".join([*(f"`{d}` int" for d in read_header(self.options["path"]).variables[self.options["variable"]].dims), "value double"])

    def reader(self, schema):
        return NetcdfReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Netcdf)


def uniform_axis(values: np.ndarray, tolerance: float = 1e-7) -> float:
    """The step of an axis; raises where its steps differ."""
    steps = np.diff(values)
    if not len(steps) or np.abs(steps - steps[0]).max() > tolerance * abs(steps[0]):
        raise ValueError("the axis is not uniform")
    return float(steps[0])


#: Names and units by which an axis is told.
LONGITUDE, LATITUDE = {"degrees_east", "degree_east", "degrees_e", "degree_e"}, {"degrees_north", "degree_north", "degrees_n", "degree_n"}


def axis_of(v: Variable) -> str | None:
    """x, y, z or t, by the variable's axis attribute, standard name, units or name."""
    told, units, name = str(v.attributes.get("axis", "")).lower(), str(v.attributes.get("units", "")).lower(), str(v.attributes.get("standard_name", v.name)).lower()
    if told in ("x", "y", "z", "t"):
        return told
    if units in LONGITUDE or name in ("projection_x_coordinate", "longitude", "x", "lon", "easting"):
        return "x"
    if units in LATITUDE or name in ("projection_y_coordinate", "latitude", "y", "lat", "northing"):
        return "y"
    if " since " in units or name == "time":
        return "t"
    return "z" if "positive" in v.attributes or name in ("height", "depth", "altitude", "z") else None


def is_longitude(v: Variable) -> bool:
    return str(v.attributes.get("units", "")).lower() in LONGITUDE or v.attributes.get("standard_name") == "longitude"


def is_latitude(v: Variable) -> bool:
    return str(v.attributes.get("units", "")).lower() in LATITUDE or v.attributes.get("standard_name") == "latitude"


def load(spark: SparkSession, path: str, variable: str) -> DataFrame:
    register(spark)
    return spark.read.format("netcdf").option("path", path).option("variable", variable).load()


def grid_from_netcdf(spark: SparkSession, path: str, variable: str) -> tuple[DataFrame, GridSpec]:
    """(i, j, [other dimensions,] value) of the cells with a value, and the grid out of the variable's uniform axes."""
    head = read_header(path)
    axes = {axis_of(head.variables[d]): d for d in head.variables[variable].dims if d in head.variables}
    if not {"x", "y"} <= set(axes):
        raise ValueError(f"{variable} has no axes x and y")
    x, y = read_whole(path, head, axes["x"]).astype(float), read_whole(path, head, axes["y"]).astype(float)
    dx, dy = uniform_axis(x), uniform_axis(y)
    if abs(abs(dy) - dx) > 1e-7 * dx:
        raise ValueError("the cells are not square")
    spec = GridSpec(len(x), len(y), float(x[0] - dx / 2), float(min(y) - dx / 2), dx, is_longitude(head.variables[axes["x"]]), top_down=dy < 0)
    cells = load(spark, path, variable)
    rest = [F.col(d) for d in head.variables[variable].dims if d not in (axes["x"], axes["y"])]
    return cells.select(F.col(axes["x"]).alias("i"), F.col(axes["y"]).alias("j"), *rest, "value"), spec


def aux_from_netcdf(spark: SparkSession, path: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(i, j, lon, lat) of two-dimensional coordinates."""
    y, x = read_header(path).variables[lon].dims
    both = load(spark, path, lon).withColumnRenamed("value", "lon").join(load(spark, path, lat).withColumnRenamed("value", "lat"), [y, x])
    return both.select(F.col(x).alias("i"), F.col(y).alias("j"), "lon", "lat")


def grid_to_netcdf(cells: DataFrame, spec: GridSpec, path: str, values: list[str] = ["value"], fill: float = -9999.0, attributes: dict | None = None) -> None:  # noqa: B006
    """One file with axes and fields of all ``values``, written by one executor task; raises for more than MOST_VALUES values."""
    if spec.nx * spec.ny * len(values) > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} values: write bands of rows")
    axes = spec.axes()
    told = lambda way: {"units": f"degrees_{way}", "axis": "X" if way == "east" else "Y"} if spec.spherical else {"units": "m", "axis": "X" if way == "east" else "Y"}

    def run(batches):
        fields = {v: np.full((spec.ny, spec.nx), fill) for v in values}
        for b in batches:
            i, j = (b.column(k).to_numpy(zero_copy_only=False).astype(int) - 1 for k in (0, 1))
            for k, v in enumerate(values):
                fields[v][j, i] = b.column(k + 2).cast(pa.float64()).fill_null(fill).to_numpy(zero_copy_only=False)
        parts = [(Variable("x", ["x"], 6, told("east")), np.array(axes["x"])), (Variable("y", ["y"], 6, told("north")), np.array(axes["y"]))]
        parts += [(Variable(v, ["y", "x"], 6, {"_FillValue": fill}), fields[v]) for v in values]
        write_bytes(path, to_bytes({"x": spec.nx, "y": spec.ny}, parts, attributes))
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], ["files"])

    cells.select("i", "j", *values).coalesce(1).mapInArrow(run, "files long").collect()


def points_to_netcdf(points: DataFrame, path: str, spherical: bool = False) -> None:
    """(point_id, x, y) as a file with a station dimension, in the order of the ids; raises for more than MOST_VALUES points."""
    if points.count() > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} points")

    def run(batches):
        rows = [b for b in batches]
        cols = [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in rows]) if rows else np.empty(0) for k in range(3)]
        order = np.argsort(cols[0], kind="stable")
        units = ("degrees_east", "degrees_north") if spherical else ("m", "m")
        parts = [(Variable("id", ["station"], 4, {}), cols[0][order]), (Variable("x", ["station"], 6, {"units": units[0]}), cols[1][order]), (Variable("y", ["station"], 6, {"units": units[1]}), cols[2][order])]
        write_bytes(path, to_bytes({"station": len(order)}, parts))
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], ["files"])

    points.select(F.col("point_id").cast("int"), F.col("x").cast("double"), F.col("y").cast("double")).coalesce(1).mapInArrow(run, "files long").collect()


def points_from_netcdf(spark: SparkSession, path: str, station: str = "station") -> DataFrame:
    """(point_id, x, y)."""
    one = lambda v, to: load(spark, path, v).select(F.col(station).alias("k"), F.col("value").alias(to))
    return one("id", "point_id").join(one("x", "x"), "k").join(one("y", "y"), "k").select(F.col("point_id").cast("long").alias("point_id"), "x", "y")
