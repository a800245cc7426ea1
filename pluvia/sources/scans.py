"""Scan files as a Spark data source: ``spark.read.format("satellite_scan")`` and ``"radar_volume"``.

A file is one scan, a container of named arrays and attributes. The reader makes a partition of
every file whose name passes the pushed filters: times come from the names, so that files of other
times are never opened, and of a file only the wanted bands, variables or sweeps are decoded. Rows
leave a task as Arrow batches, one band or sweep at a time. Spark 4.1 keeps the last filters that it
pushed with the loaded table: load anew for every other filter, as the functions below do. The same source reads a growing folder
as a stream, and writes rows of packed arrays back as files, one per row.

Containers are compressed numpy archives, alone or inside gzip; NetCDF and HDF5 files are read where
the library for them is installed, and any other kind by a function named in the option ``decoder``
(``module:function``, bytes to a mapping of names to arrays). Paths may be local or of any store that
``pyarrow.fs`` knows.
"""

from __future__ import annotations

import fnmatch
import gzip
import importlib
import io
import json
import re
import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from pluvia.functions.geo import geostationary_to_latlon
from pluvia.functions.radar import VARIABLES
from pluvia.session import spread
from pluvia.sources.files import PRODUCTS, pixel_rows

#: Files that changed less than so many seconds ago are left for the next batch of a stream.
SETTLE_SECONDS = 1.0
EPOCH = datetime(1970, 1, 1)


# --- files -----------------------------------------------------------------------------------


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it; a path without a scheme is local."""
    if re.match(r"^[a-z][a-z0-9+.-]*:/", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def list_store(path: str, pattern: str) -> list[tuple[int, str]]:
    """(time of change in nanoseconds, path) of the files below a folder, or of the file itself."""
    store, inner = open_store(path)
    info = store.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(inner, recursive=True))
    hidden = re.compile(r"(^|/)[_.]")
    keep = [
        f for f in found
        if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, pattern)
        and not hidden.search(f.path[len(inner):] if f.path != inner else f.base_name)
    ]
    return sorted((int(f.mtime_ns or 0), f.path) for f in keep)


class _Npz(Mapping):
    """Arrays of a numpy archive, each decoded when it is asked for; JSON attributes as ``attrs``."""

    def __init__(self, data: bytes):
        self.file = np.load(io.BytesIO(data), allow_pickle=False)

    def __getitem__(self, name: str):
        value = self.file[name]
        return json.loads(str(value)) if name == "attrs" else value

    def __iter__(self):
        return iter(self.file.files)

    def __len__(self) -> int:
        return len(self.file.files)


class _Hdf(Mapping):
    """Arrays and attributes of an HDF5 (or NetCDF 4) file, by path."""

    def __init__(self, data: bytes):
        try:
            import h5py
        except ImportError as e:
            raise ImportError("HDF5 and NetCDF files need h5py, or the option decoder") from e
        self.file = h5py.File(io.BytesIO(data), "r")

    def __getitem__(self, name: str):
        if name == "attrs":
            out = {k: _plain(v) for k, v in self.file.attrs.items()}
            self.file.visititems(lambda path, item: out.update({f"{path}/{k}": _plain(v) for k, v in item.attrs.items()}))
            return out
        item = self.file[name]
        scaled = np.asarray(item[()])
        if "scale_factor" in item.attrs:
            fill = item.attrs.get("_FillValue")
            missing = scaled == fill if fill is not None else np.zeros(scaled.shape, bool)
            scaled = scaled * item.attrs["scale_factor"] + item.attrs.get("add_offset", 0.0)
            scaled = np.where(missing, np.nan, scaled)
        return scaled

    def __iter__(self):
        names: list[str] = []
        self.file.visititems(lambda path, item: names.append(path) if hasattr(item, "shape") else None)
        return iter(names)

    def __len__(self) -> int:
        return len(list(iter(self)))


def _plain(value):
    value = np.asarray(value).item() if np.ndim(value) == 0 else np.asarray(value).tolist()
    return value.decode() if isinstance(value, bytes) else value


def decode(data: bytes, decoder: str | None = None) -> Mapping:
    """The container of a file's bytes, by its first bytes unless a decoder is named."""
    if decoder:
        module, _, name = decoder.partition(":")
        return getattr(importlib.import_module(module), name)(data)
    if data[:2] == b"\x1f\x8b":
        return decode(gzip.decompress(data))
    if data[:4] == b"PK\x03\x04":
        return _Npz(data)
    if data[:8] == b"\x89HDF\r\n\x1a\n":
        return _Hdf(data)
    raise ValueError("unknown container; name a decoder")


def read_container(path: str, decoder: str | None = None) -> Mapping:
    store, inner = open_store(path)
    with store.open_input_stream(inner, compression=None) as stream:
        return decode(stream.read(), decoder)


# --- kinds of scans --------------------------------------------------------------------------


class SatelliteKind:
    """Pixels of satellite products: scan angles ``x`` (columns) and ``y`` (rows), an array per band.

    Names hold the product and the start of the scan:
    ``OR_<product>-M<mode>_G<nn>_s<year><day of year><hour><minute><second><tenth>_...``.
    """

    schema = "path string, product string, creation timestamp_ntz, band string, row int, col int, x double, y double, value double"
    packed = "product string, creation timestamp_ntz, band array<string>, x array<double>, y array<double>, values array<array<double>>"
    time, choice = "creation", "band"
    name = re.compile(r"OR_(?P<product>.+?)-M\d+_G\d+_s(?P<time>\d{13,14})")

    @staticmethod
    def described(match: re.Match) -> tuple[datetime, dict]:
        text = match["time"]
        start = datetime.strptime(text[:13], "%Y%j%H%M%S") + timedelta(milliseconds=100 * int(text[13:] or 0))
        return start, {"product": match["product"]}

    @staticmethod
    def choices(container: Mapping, described: dict) -> list[str]:
        bands, _ = PRODUCTS.get(described["product"], (None, False))
        return [b for b in bands if b in container] if bands else [b for b in container if b not in ("x", "y", "attrs")]

    @staticmethod
    def rows(container: Mapping, band: str, described: dict) -> dict:
        value = np.asarray(container[band], np.float64)
        row, col = np.indices(value.shape, np.int32)
        x, y = (np.asarray(container[c], np.float64) for c in "xy")
        return {"row": row.ravel(), "col": col.ravel(), "x": x[col].ravel(), "y": y[row].ravel(), "value": value.ravel()}

    @staticmethod
    def file(row: Mapping) -> tuple[str, dict]:
        start = row["creation"]
        name = f"OR_{row['product']}-M6_G16_s{start:%Y%j%H%M%S}{start.microsecond // 100_000}_{uuid.uuid4().hex[:8]}.npz"
        shape = (len(row["y"]), len(row["x"]))
        bands = {b: np.array(v, np.float64).reshape(shape) for b, v in zip(row["band"], row["values"], strict=True)}
        return name, {"x": np.array(row["x"]), "y": np.array(row["y"]), **bands}


class RadarKind:
    """Rays of radar volumes: sweeps ``dataset1``, ``dataset2``, ... with raw variables ``data1``, ...

    Names hold the time: ``...MDN.<yyyymmddhhmmss>.PVOL...``. The attributes give each sweep's
    elevation and ray angles, each variable's gain and offset.
    """

    schema = (
        "path string, scan_ts timestamp_ntz, variable string, elev_idx int, elevation double, ray_idx int, "
        "start_az double, stop_az double, gain double, offset double, raw array<double>"
    )
    packed = (
        "scan_ts timestamp_ntz, variable array<string>, elevation array<double>, start_az array<array<double>>, "
        "stop_az array<array<double>>, gain double, offset double, raw array<array<array<array<double>>>>"
    )
    time, choice = "scan_ts", "variable"
    name = re.compile(r"MDN\.(?P<time>\d{12,14})\.PVOL")

    @staticmethod
    def described(match: re.Match) -> tuple[datetime, dict]:
        return datetime.strptime(match["time"].ljust(14, "0"), "%Y%m%d%H%M%S"), {}

    @staticmethod
    def choices(container: Mapping, described: dict) -> list[tuple[str, int]]:
        found = (re.fullmatch(r"dataset(\d+)/(data\d+)/data", name) for name in container)
        return sorted((m[2], int(m[1])) for m in found if m)

    @staticmethod
    def rows(container: Mapping, choice: tuple[str, int], described: dict) -> dict:
        data, sweep = choice
        attrs, raw = container["attrs"], np.asarray(container[f"dataset{sweep}/{data}/data"], np.float64)
        n, bins = raw.shape
        what = f"dataset{sweep}/{data}/what"
        return {
            "elev_idx": np.full(n, sweep, np.int32),
            "elevation": np.full(n, float(attrs[f"dataset{sweep}/where/elangle"])),
            "ray_idx": np.arange(n, dtype=np.int32),
            "start_az": np.asarray(attrs[f"dataset{sweep}/how/startazA"], np.float64),
            "stop_az": np.asarray(attrs[f"dataset{sweep}/how/stopazA"], np.float64),
            "gain": np.full(n, float(attrs[f"{what}/gain"])),
            "offset": np.full(n, float(attrs[f"{what}/offset"])),
            "raw": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bins), pa.array(raw.ravel())),
        }

    @staticmethod
    def file(row: Mapping) -> tuple[str, dict]:
        arrays, attrs = {}, {}
        for k, elevation in enumerate(row["elevation"]):
            sweep = f"dataset{k + 1}"
            attrs[f"{sweep}/where/elangle"] = elevation
            attrs[f"{sweep}/how/startazA"], attrs[f"{sweep}/how/stopazA"] = row["start_az"][k], row["stop_az"][k]
            for v, name in enumerate(row["variable"]):
                attrs |= {f"{sweep}/{name}/what/gain": row["gain"], f"{sweep}/{name}/what/offset": row["offset"]}
                arrays[f"{sweep}/{name}/data"] = np.array(row["raw"][v][k], np.float64)
        name = f"{uuid.uuid4().hex[:8]}-MDN.{row['scan_ts']:%Y%m%d%H%M%S}.PVOL.npz.gz"
        return name, {**arrays, "attrs": np.array(json.dumps(attrs))}


Kind = type[SatelliteKind] | type[RadarKind]


def _chosen(choice) -> str:
    return choice if isinstance(choice, str) else choice[0]


# --- reading ---------------------------------------------------------------------------------


@dataclass
class ScanFile(InputPartition):
    """One file, with what is left to choose in it."""

    path: str
    start: datetime
    described: dict
    chosen: frozenset | None


class _Bounds:
    """What the pushed filters leave: a range of times and a set of choices."""

    def __init__(self, kind: Kind):
        self.kind = kind
        self.tests: list = []
        self.chosen: frozenset | None = None

    def take(self, f: Filter) -> bool:
        """Whether the filter holds for every row of what is read from now on."""
        if not isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or len(f.attribute) != 1:
            return False
        column = f.attribute[0]
        if column == self.kind.choice and isinstance(f, (EqualTo, In)):
            some = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
            self.chosen = some if self.chosen is None else self.chosen & some
            return True
        if column == self.kind.time:
            tests = {
                EqualTo: lambda t, v: t == v, In: lambda t, v: t in v, GreaterThan: lambda t, v: t > v,
                GreaterThanOrEqual: lambda t, v: t >= v, LessThan: lambda t, v: t < v, LessThanOrEqual: lambda t, v: t <= v,
            }
            self.tests.append((tests[type(f)], f.value))
            return True
        return False

    def allow(self, start: datetime) -> bool:
        return all(test(start, value) for test, value in self.tests)


def _partitions(kind: Kind, paths: Sequence[str], bounds: _Bounds) -> list[ScanFile]:
    """Files whose name is a scan of the kind, within the bounds."""
    out = []
    for path in paths:
        match = kind.name.search(path.rsplit("/", 1)[-1])
        if match is None:
            continue
        start, described = kind.described(match)
        if bounds.allow(start) and bounds.chosen != frozenset():
            out.append(ScanFile(path, start, described, bounds.chosen))
    return out


def _read(kind: Kind, file: ScanFile, scheme: str, decoder: str | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of one file, one band or sweep at a time."""
    container = read_container(scheme + file.path, decoder)
    for choice in kind.choices(container, file.described):
        if file.chosen is not None and _chosen(choice) not in file.chosen:
            continue
        rows = kind.rows(container, choice, file.described)
        n = len(next(iter(rows.values())))
        micros = (file.start - EPOCH) // timedelta(microseconds=1)
        fixed = {"path": file.path, kind.choice: _chosen(choice), **file.described}
        columns = []
        for field in schema:
            if field.name == kind.time:
                columns.append(pa.array(np.full(n, micros, np.int64)).cast(field.type))
            elif field.name in fixed:
                columns.append(pa.array([fixed[field.name]] * n, field.type))
            else:
                value = rows[field.name]
                columns.append(value if isinstance(value, pa.Array) else pa.array(value, field.type))
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


_ARROW = {
    "string": pa.string(), "int": pa.int32(), "double": pa.float64(), "timestamp_ntz": pa.timestamp("us"),
    "array<double>": pa.list_(pa.float64()),
}


def _arrow(ddl: str) -> pa.Schema:
    """Arrow schema of the columns of a kind; sources run where there is no session."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (field.split(" ") for field in ddl.split(", "))])


def _scheme(path: str) -> str:
    """What to put before a listed path so that tasks find its store again."""
    match = re.match(r"^([a-z][a-z0-9+.-]*)://?", path)
    return "" if match is None or match[1] == "file" else f"{match[1]}://"


class ScanReader(DataSourceReader):
    def __init__(self, kind: Kind, options: Mapping):
        self.kind, self.path = kind, options["path"]
        self.pattern, self.decoder = options.get("pathglobfilter", "*"), options.get("decoder")
        self.bounds = _Bounds(kind)
        self.schema = _arrow(kind.schema)

    def pushFilters(self, filters: list[Filter]):
        # Every filter that is not taken stays with Spark.
        for f in filters:
            if not self.bounds.take(f):
                yield f

    def partitions(self) -> list[ScanFile]:
        return _partitions(self.kind, [p for _, p in list_store(self.path, self.pattern)], self.bounds)

    def read(self, partition: ScanFile) -> Iterator[pa.RecordBatch]:
        return _read(self.kind, partition, _scheme(self.path), self.decoder, self.schema)


class ScanStream(DataSourceStreamReader):
    """Files in the order of their change; the offset is the last file that was read.

    A file counts once it has not changed for ``SETTLE_SECONDS``, so that files of one moment are not
    split by the offset.
    """

    def __init__(self, kind: Kind, options: Mapping):
        self.kind, self.path = kind, options["path"]
        self.pattern, self.decoder = options.get("pathglobfilter", "*"), options.get("decoder")
        self.settle = float(options.get("settleseconds", SETTLE_SECONDS))
        self.schema = _arrow(kind.schema)

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        ripe = int((time.time() - self.settle) * 1e9)
        files = [f for f in list_store(self.path, self.pattern) if f[0] <= ripe]
        changed, path = files[-1] if files else (-1, "")
        return {"changed": changed, "path": path}

    def partitions(self, start: dict, end: dict) -> list[ScanFile]:
        after, upto = (start["changed"], start["path"]), (end["changed"], end["path"])
        paths = [p for changed, p in list_store(self.path, self.pattern) if after < (changed, p) <= upto]
        return _partitions(self.kind, paths, _Bounds(self.kind))

    def read(self, partition: ScanFile) -> Iterator[pa.RecordBatch]:
        return _read(self.kind, partition, _scheme(self.path), self.decoder, self.schema)

    def commit(self, end: dict) -> None:
        """Nothing is kept that would have to go."""


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ScanWriter(DataSourceWriter):
    """One file per row. Tasks write below a hidden folder of the run; only files of tasks that Spark
    accepts are moved to their place, so that a lost or repeated task leaves nothing behind."""

    def __init__(self, kind: Kind, options: Mapping, overwrite: bool):
        self.kind, self.path, self.overwrite = kind, options["path"], overwrite
        self.folder = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        store, inner = open_store(self.path)
        store.create_dir(f"{inner}/{self.folder}", recursive=True)
        names = []
        for row in iterator:
            name, arrays = self.kind.file(row.asDict())
            out = io.BytesIO()
            np.savez_compressed(out, **arrays)
            data = gzip.compress(out.getvalue(), 1) if name.endswith(".gz") else out.getvalue()
            with store.open_output_stream(f"{inner}/{self.folder}/{name}", compression=None) as file:
                file.write(data)
            names.append(name)
        return Written(names)

    def commit(self, messages: list) -> None:
        store, inner = open_store(self.path)
        store.create_dir(inner, recursive=True)
        new = [name for m in messages if m is not None for name in m.names]
        if self.overwrite:
            for _, old in list_store(self.path, "*"):
                if self.kind.name.search(old.rsplit("/", 1)[-1]):
                    store.delete_file(old)
        for name in new:
            store.move(f"{inner}/{self.folder}/{name}", f"{inner}/{name}")
        self._clear(store, inner)

    def abort(self, messages: list) -> None:
        self._clear(*open_store(self.path))

    def _clear(self, store: pafs.FileSystem, inner: str) -> None:
        if store.get_file_info(f"{inner}/{self.folder}").type == pafs.FileType.Directory:
            store.delete_dir(f"{inner}/{self.folder}")


class _ScanSource(DataSource):
    kind: Kind

    def schema(self) -> str:
        return self.kind.schema

    def reader(self, schema: StructType) -> ScanReader:
        return ScanReader(self.kind, self._options())

    def streamReader(self, schema: StructType) -> ScanStream:
        return ScanStream(self.kind, self._options())

    def writer(self, schema: StructType, overwrite: bool) -> ScanWriter:
        return ScanWriter(self.kind, self._options(), overwrite)

    def _options(self) -> dict:
        options = {k.lower(): v for k, v in self.options.items()}
        if not options.get("path"):
            raise ValueError("a path is needed")
        return options


class SatelliteScan(_ScanSource):
    kind = SatelliteKind

    @classmethod
    def name(cls) -> str:
        return "satellite_scan"


class RadarVolume(_ScanSource):
    kind = RadarKind

    @classmethod
    def name(cls) -> str:
        return "radar_volume"


def register(spark: SparkSession) -> None:
    """Make both formats known to a session, let it push filters to them, and run their streams to the
    end, last watermark included, when a scheduled run takes what is there."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.conf.set("spark.sql.streaming.triggerAvailableNowWrapper.enabled", "true")
    for source in (SatelliteScan, RadarVolume):
        spark.dataSource.register(source)


# --- rows of the formats ---------------------------------------------------------------------


def satellite_pixels(
    spark: SparkSession,
    folder: str,
    product: str,
    bands: list[str] | None = None,
    lat_bounds: tuple[float, float] | None = None,
    lon_bounds: tuple[float, float] | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    height: float = 35786023.0,
) -> DataFrame:
    """Valid pixels of a product inside the map bounds: ``creation, band, row, col, lat, lon, value``.

    ``start <= creation < end`` chooses the files by their names.
    """
    if product not in PRODUCTS:
        raise ValueError(f"unsupported product {product}")
    register(spark)
    scans = spark.read.format("satellite_scan").option("pathGlobFilter", f"OR_{product}-*").load(folder)
    wanted = scans.where(F.col("band").isin(bands if bands is not None else PRODUCTS[product][0]))
    if start is not None:
        wanted = wanted.where(F.col("creation") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        wanted = wanted.where(F.col("creation") < F.lit(end).cast("timestamp_ntz"))
    located = geostationary_to_latlon(wanted, "x", "y", height=height)
    # Filters stay above rows that are numbered; pushed below the formulas they would each copy all of them.
    located = located.withColumn("_number", F.monotonically_increasing_id()).where("_number >= 0")
    rows = pixel_rows(located, lat_bounds, lon_bounds, ["value"])
    return rows.select("creation", "band", "row", "col", "lat", "lon", "value")


def volume_rays(spark: SparkSession, folder: str, feature: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Rays of one variable of radar volumes, raw, with their gain and offset."""
    if feature not in VARIABLES:
        raise ValueError(f"unknown radar variable {feature}")
    register(spark)
    rays = spark.read.format("radar_volume").load(folder).where(F.col("variable") == VARIABLES[feature])
    if start is not None:
        rays = rays.where(F.col("scan_ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rays = rays.where(F.col("scan_ts") < F.lit(end).cast("timestamp_ntz"))
    return rays.drop("variable").withColumn("feature", F.lit(feature))


class _FileRows:
    """Table function of rows ``path, wanted`` (choices, comma separated): the rows of those files."""

    kind: Kind

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        schema = _arrow(self.kind.schema)
        for path, wanted in zip(batch.column("path").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            bounds = _Bounds(self.kind)
            bounds.chosen = frozenset(wanted.split(",")) if wanted else None
            for file in _partitions(self.kind, [re.sub(r"^file:/+", "/", path)], bounds):
                for rows in _read(self.kind, file, "", None, schema):
                    yield pa.Table.from_batches([rows])


def expand_files(listed: DataFrame, kind: str, wanted: list[str] | None = None, path: str = "path") -> DataFrame:
    """Rows of the listed files: an Arrow table function over the list, file by file.

    Where the files come from another query, such as a manifest, rather than from a folder. Files whose
    name is no scan of the kind give no rows.
    """
    source = {"satellite_scan": SatelliteKind, "radar_volume": RadarKind}[kind]
    rows = type(f"{source.__name__}Rows", (_FileRows,), {"kind": source})
    function = F.arrow_udtf(rows, returnType=source.schema)
    names = listed.select(F.col(path).alias("path"), F.lit(",".join(wanted or [])).alias("wanted"))
    return function(spread(names, "path").asTable())
