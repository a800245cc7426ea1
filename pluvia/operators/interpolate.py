"""Linear interpolation of scattered points at target cells.

The points are scan pixels with a row and a column, so neighbouring pixels form
quads and each quad two triangles. Scans are cut into array tiles with a halo of one
pixel, so that every triangle lies inside one row and is found there; the barycentric
weights are plain arithmetic. A static grid of checked size goes to the tiles; targets that
belong to scans meet the tiles on parts of the map. Beyond that, triangles and targets
meet as rows by equality on the map tile they touch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.session import BROADCAST_MAX_BYTES, by_key, extended, fits_broadcast

#: Pixels along a side of a scan tile, without its halo.
TILE_PIXELS = 64
#: Map tiles along a side of a part of the map where two kinds of scans meet.
MAP_PART = 16
#: Cells, and pairs of triangle and target, that are looked at together.
STEP = 1 << 18

_CORNERS = {"a": (0, 0), "b": (0, 1), "c": (1, 0), "d": (1, 1)}
# Triangle kinds by number. All corners present: two triangles on the b-c diagonal.
# One corner missing: the remaining three.
_TRIANGLES = ["abc", "dcb", "acd", "abd"]


def triangles(points: DataFrame, by: list[str], payload: list[str]) -> DataFrame:
    """Triangles of neighbouring points: corners 1-3 with position and payload.

    Every point reports to the four quads it belongs to; one aggregation per quad
    assembles the corners. Quads whose triangles face opposite ways (folded by a
    position shift) and triangles without area are dropped.
    """
    fields = ["lat", "lon", *payload]
    reports = ", ".join(
        f"struct(CAST(row - {dr} AS BIGINT) AS qr, CAST(col - {dc} AS BIGINT) AS qc, '{c}' AS corner)"
        for c, (dr, dc) in _CORNERS.items()
    )
    known = points.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)")
    corners = known.selectExpr(*by, *fields, f"explode(array({reports})) AS _q")
    quads = corners.groupBy(*by, "_q.qr", "_q.qc").agg(
        *[
            F.expr(f"max({f}) FILTER (WHERE _q.corner = '{c}') AS {c}_{f}")
            for c in _CORNERS
            for f in fields
        ]
    )
    has = lambda t: " AND ".join(f"{c}_lat IS NOT NULL" for c in t)
    aligned = f"({_area(*'abc')}) * ({_area(*'dcb')}) > 0"
    kinds = f"""CASE WHEN {has("abcd")} THEN IF({aligned}, array(0, 1), NULL)
        WHEN {has("abc")} THEN array(0) WHEN {has("bcd")} THEN array(1)
        WHEN {has("acd")} THEN array(2) WHEN {has("abd")} THEN array(3) END"""
    pick = lambda k, f: " ".join(
        ["CASE _kind", *[f"WHEN {n} THEN {t[k]}_{f}" for n, t in enumerate(_TRIANGLES)], "END"]
    )
    made = quads.selectExpr("*", f"explode({kinds}) AS _kind").selectExpr(
        *by,
        f"qr * {2**32} + qc * 4 + _kind AS tri",
        *[f"{pick(k, f)} AS {f}{k + 1}" for k in range(3) for f in fields],
    )
    return made.selectExpr("*", f"{_DET} AS det").where("det <> 0")


_DET = "(lat2 - lat3) * (lon1 - lon3) + (lon3 - lon2) * (lat1 - lat3)"


def _area(p: str, q: str, r: str) -> str:
    """Twice the signed area of the triangle of three corners."""
    return (
        f"({q}_lat - {p}_lat) * ({r}_lon - {p}_lon) - ({q}_lon - {p}_lon) * ({r}_lat - {p}_lat)"
    )


def _tile(v: str, size: float) -> str:
    return f"floor({v} / {size!r}D)"


def locate(
    tris: DataFrame,
    targets: DataFrame,
    by: list[str],
    target_by: list[str],
    tile: float,
    salts: int = 32,
    max_bytes: int = BROADCAST_MAX_BYTES,
) -> DataFrame:
    """(triangle, target) rows where the target lies in the triangle, with weights.

    ``target_by`` lists the ``by`` columns the targets carry. Targets that carry
    them all spread over scans and tiles by hash. Targets shared by all scans are
    broadcast when small enough; otherwise each tile is split over ``salts`` so
    that it does not collect the triangles of every scan in one task.
    """
    span = lambda c: (
        f"explode(sequence({_tile(f'least({c}1, {c}2, {c}3)', tile)}, "
        f"{_tile(f'greatest({c}1, {c}2, {c}3)', tile)}))"
    )
    spans = tris.selectExpr("*", f"{span('lat')} AS _ty").selectExpr("*", f"{span('lon')} AS _tx")
    at = targets.selectExpr(
        *target_by, "target", "lat AS _y", "lon AS _x",
        f"{_tile('lat', tile)} AS _ty", f"{_tile('lon', tile)} AS _tx",
    )
    on = [*target_by, "_ty", "_tx"]
    if set(target_by) == set(by) and by:
        met = spans.join(at, on, "inner")
    elif fits_broadcast(targets, max_bytes):
        met = spans.join(F.broadcast(at), on, "inner")
    else:
        salted = spans.withColumn(
            "_salt", F.pmod(F.xxhash64(*by, "tri"), F.lit(salts)).cast("int")
        )
        copies = at.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = salted.join(copies, [*on, "_salt"], "inner").drop("_salt")
    met = met.selectExpr(
        "*",
        "((lat2 - lat3) * (_x - lon3) + (lon3 - lon2) * (_y - lat3)) / det AS w1",
        "((lat3 - lat1) * (_x - lon3) + (lon1 - lon3) * (_y - lat3)) / det AS w2",
    ).selectExpr("*", "1.0D - w1 - w2 AS w3")
    # A hair of slack so that a target on a shared edge is never lost to rounding.
    return met.where("w1 >= -1e-12 and w2 >= -1e-12 and w3 >= -1e-12").drop("det", "_ty", "_tx")


def scan_tiles(points: DataFrame, by: list[str], value: str, size: int = TILE_PIXELS) -> DataFrame:
    """Scans as packed tiles: ``by, _tr, _tc`` and the list ``px`` of ``row, col, lat, lon, v``.

    A tile of ``size`` x ``size`` pixels also has the next row and column: a pixel at a border
    goes to the tiles before it too, all others move once. So every quad lies in the tile of its
    first corner. Pixels without a position are no corner of any; they are left out in the tile, as a
    filter here would copy the formulas of their position.
    """
    tr, tc = F.floor(F.col("row") / size), F.floor(F.col("col") / size)
    # Rows and columns count from 0: nothing lies before them.
    top = (F.pmod("row", F.lit(size)) == 0) & (F.col("row") > 0)
    left = (F.pmod("col", F.lit(size)) == 0) & (F.col("col") > 0)
    place = lambda r, c: F.struct(r.cast("long").alias("r"), c.cast("long").alias("c"))
    places = F.array(
        place(tr, tc), F.when(top, place(tr - 1, tc)), F.when(left, place(tr, tc - 1)),
        F.when(top & left, place(tr - 1, tc - 1)),
    )
    pixel = F.struct(
        F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"),
        F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"),
        F.col(value).cast("double").alias("v"),
    )
    sent = points.select(*by, pixel.alias("_p"), F.explode(F.filter(places, lambda p: p.isNotNull())).alias("_t"))
    placed = sent.select(*by, F.col("_t.r").alias("_tr"), F.col("_t.c").alias("_tc"), "_p")
    return by_key(placed, *by, "_tr", "_tc").groupBy(*by, "_tr", "_tc").agg(F.collect_list("_p").alias("px"))


class _Tile:
    """Triangles of one packed tile: numbers, and corners' positions and values as (n, 3)."""

    def __init__(self, px: pa.StructArray, tr: int, tc: int, size: int):
        row, col, lat, lon, v = (
            np.asarray(px.field(k).to_numpy(zero_copy_only=False), np.int64 if k < 2 else np.float64) for k in range(5)
        )
        lat, lon = np.where(np.isnan(lon), np.nan, lat), np.where(np.isnan(lat), np.nan, lon)
        r0, c0 = int(row.min()), int(col.min())
        shape = (int(row.max()) - r0 + 1, int(col.max()) - c0 + 1)
        at = (row - r0) * shape[1] + col - c0
        # Repeated pixels keep the largest of each field.
        grid = np.full((3, shape[0] * shape[1]), np.nan)
        for k, field in enumerate((lat, lon, v)):
            np.fmax.at(grid[k], at, field)
        qr, qc = (g.ravel() for g in np.indices((max(shape[0] - 1, 0), max(shape[1] - 1, 0))))
        # Quads whose first corner lies in this tile.
        own = ((qr + r0) // size == tr) & ((qc + c0) // size == tc)
        qr, qc = qr[own], qc[own]
        a = qr * shape[1] + qc
        corner = {"a": a, "b": a + 1, "c": a + shape[1], "d": a + shape[1] + 1}
        has = {k: ~np.isnan(grid[0][n]) for k, n in corner.items()}
        four = has["a"] & has["b"] & has["c"] & has["d"]
        turn = lambda t: self._area(grid, *(corner[c] for c in t))
        aligned = four & (turn("abc") * turn("dcb") > 0)
        kinds = [aligned, aligned.copy(), np.zeros_like(four), np.zeros_like(four)]
        for k, (name, lacking) in enumerate((("abc", "d"), ("dcb", "a"), ("acd", "b"), ("abd", "c"))):
            kinds[k] |= ~has[lacking] & has[name[0]] & has[name[1]] & has[name[2]]
        number, ends = [], []
        for k, name in enumerate(_TRIANGLES):
            chosen = np.flatnonzero(kinds[k])
            number.append(((qr + r0) * (1 << 32) + (qc + c0) * 4 + k)[chosen])
            ends.append(np.stack([corner[c][chosen] for c in name], 1))
        self.number, ends = np.concatenate(number), np.concatenate(ends)
        self.lat, self.lon, self.v = (g[ends] for g in grid)
        self.det = (self.lat[:, 1] - self.lat[:, 2]) * (self.lon[:, 0] - self.lon[:, 2]) + (
            self.lon[:, 2] - self.lon[:, 1]
        ) * (self.lat[:, 0] - self.lat[:, 2])
        self._keep(self.det != 0)

    @staticmethod
    def _area(grid: np.ndarray, p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        lat, lon = grid[0], grid[1]
        return (lat[q] - lat[p]) * (lon[r] - lon[p]) - (lon[q] - lon[p]) * (lat[r] - lat[p])

    def _keep(self, chosen: np.ndarray) -> None:
        for name in ("number", "lat", "lon", "v", "det"):
            setattr(self, name, getattr(self, name)[chosen])

    def hits(self, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(target, number of triangle, value) of all triangles that hold a target.

        Both meet on a regular mesh over the targets near the tile, about one target a cell.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not len(self.number):
            return none
        near = np.flatnonzero(
            (y >= self.lat.min()) & (y <= self.lat.max()) & (x >= self.lon.min()) & (x <= self.lon.max())
        )
        if not len(near):
            return none
        y, x = y[near], x[near]
        mesh = int(min(256, np.ceil(np.sqrt(len(near)))))
        (y0, y1), (x0, x1) = (y.min(), y.max()), (x.min(), x.max())
        dy, dx = (y1 - y0) / mesh or 1.0, (x1 - x0) / mesh or 1.0
        line = lambda v, first, step: np.clip(np.floor((v - first) / step), -1, mesh).astype(np.int64)
        cell = np.minimum(line(y, y0, dy), mesh - 1) * mesh + np.minimum(line(x, x0, dx), mesh - 1)
        order = np.argsort(cell, kind="stable")
        first = np.searchsorted(cell[order], np.arange(mesh * mesh + 1))
        inside = (self.lat.max(1) >= y0) & (self.lat.min(1) <= y1) & (self.lon.max(1) >= x0) & (self.lon.min(1) <= x1)
        tri = np.flatnonzero(inside)
        lo_y, hi_y = (np.clip(line(f(self.lat[tri], 1), y0, dy), 0, mesh - 1) for f in (np.min, np.max))
        lo_x, hi_x = (np.clip(line(f(self.lon[tri], 1), x0, dx), 0, mesh - 1) for f in (np.min, np.max))
        wide = hi_x - lo_x + 1
        cells = (hi_y - lo_y + 1) * wide
        found = [none]
        # So many triangles at a time that their cells, and then their targets, stay few.
        for part in np.split(np.arange(len(tri)), np.searchsorted(np.cumsum(cells), np.arange(1, cells.sum() // STEP + 1) * STEP)):
            of = np.repeat(part, cells[part])
            k = np.arange(len(of)) - np.repeat(np.cumsum(cells[part]) - cells[part], cells[part])
            at = (lo_y[of] + k // wide[of]) * mesh + lo_x[of] + k % wide[of]
            n = first[at + 1] - first[at]
            for some in np.split(np.arange(len(of)), np.searchsorted(np.cumsum(n), np.arange(1, n.sum() // STEP + 1) * STEP)):
                t = np.repeat(tri[of[some]], n[some])
                place = np.arange(len(t)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
                target = order[np.repeat(first[at[some]], n[some]) + place]
                found.append(self._weighted(t, target, y, x))
        target, number, value = (np.concatenate(c) for c in zip(*found, strict=True))
        return near[target], number, value

    def _weighted(self, t: np.ndarray, target: np.ndarray, y: np.ndarray, x: np.ndarray):
        lat, lon, ty, tx = self.lat[t], self.lon[t], y[target], x[target]
        down, right = ty - lat[:, 2], tx - lon[:, 2]
        w1 = ((lat[:, 1] - lat[:, 2]) * right + (lon[:, 2] - lon[:, 1]) * down) / self.det[t]
        w2 = ((lat[:, 2] - lat[:, 0]) * right + (lon[:, 0] - lon[:, 2]) * down) / self.det[t]
        w3 = 1.0 - w1 - w2
        # A hair of slack so that a target on a shared edge is never lost to rounding.
        ok = (w1 >= -1e-12) & (w2 >= -1e-12) & (w3 >= -1e-12)
        v = self.v[t[ok]]
        return target[ok], self.number[t[ok]], w1[ok] * v[:, 0] + w2[ok] * v[:, 1] + w3[ok] * v[:, 2]


def _lowest(target: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Of each target the place of its hit with the smallest triangle."""
    order = np.lexsort((number, target))
    return order[np.flatnonzero(np.diff(target[order], prepend=-1))]


def _null_nan(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=np.isnan(values))


def _tiles_of(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, _Tile]]:
    px, tr, tc = batch.column("px"), batch.column("_tr").to_numpy(), batch.column("_tc").to_numpy()
    for k in range(batch.num_rows):
        yield k, _Tile(px[k].values, int(tr[k]), int(tc[k]), size)


def _tiles_in(tiles: pa.StructArray, size: int) -> Iterator[_Tile]:
    """Tiles of a list of ``_tr, _tc, px``."""
    tr, tc, px = (tiles.field(k) for k in range(3))
    for k in range(len(tiles)):
        yield _Tile(px[k].values, tr[k].as_py(), tc[k].as_py(), size)


def tile_hits(tiles: DataFrame, by: list[str], y: np.ndarray, x: np.ndarray, size: int = TILE_PIXELS) -> DataFrame:
    """Of every tile its hits among static targets, packed: ``by`` and the lists ``at`` (places of
    the targets), ``tri`` and ``v``. Tiles far from all targets have no row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for k, tile in _tiles_of(batch, size):
                target, number, value = tile.hits(y, x)
                if len(target):
                    best = _lowest(target, number)
                    rows.append(k)
                    parts.append((target[best].astype(np.int32), number[best], value[best]))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]).astype(np.int32))
            flat = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, t) for c, t in enumerate((np.int32, np.int64, float))]
            lists = [pa.ListArray.from_arrays(ends, a) for a in (pa.array(flat[0]), pa.array(flat[1]), _null_nan(flat[2]))]
            keys = [batch.column(c).take(pa.array(rows, pa.int32())) for c in by]
            yield pa.RecordBatch.from_arrays([*keys, *lists], [*by, "at", "tri", "v"])

    return tiles.mapInArrow(run, extended(tiles.select(*by), "at array<int>, tri array<long>, v array<double>"))


def interpolate_packed(
    points: DataFrame, y: np.ndarray, x: np.ndarray, by: list[str], value: str = "value", size: int = TILE_PIXELS
) -> DataFrame:
    """One row per scan with its values at all static targets, in their order, NULL outside.

    Two shuffles: pixels into tiles, and the tiles' hits, packed, by scan. Scans without any hit have
    no row.
    """
    hits = tile_hits(scan_tiles(points, by, value, size), by, y, x, size)
    packed = hits.groupBy(*by).agg(F.collect_list(F.struct("at", "tri", "v")).alias("_h"))
    joined = lambda c: F.flatten(F.transform("_h", lambda h: h[c])).alias(c)
    flat = packed.select(*by, *[joined(c) for c in ("at", "tri", "v")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                at, tri, v = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("at", "tri", "v"))
                best = _lowest(at.astype(np.int64), tri)
                dense = np.full(len(y), np.nan)
                dense[at[best]] = v[best]
                out.append(dense)
            ends = pa.array((np.arange(batch.num_rows + 1) * len(y)).astype(np.int32))
            values = pa.ListArray.from_arrays(ends, _null_nan(np.concatenate([np.zeros(0), *out])))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in by], values], [*by, "values"])

    return flat.mapInArrow(run, extended(points.select(*by), "values array<double>"))


def interpolate_between(
    points: DataFrame,
    targets: DataFrame,
    by: list[str],
    value: str = "value",
    tile: float = 0.25,
    keep: bool = False,
    size: int = TILE_PIXELS,
) -> DataFrame:
    """Targets that belong to scans (``by``, ``lat``, ``lon`` and more columns) with the value of
    their scan's points there, in the column named ``value``.

    Tiles of the points go to the parts of the map that they touch, targets to the one they lie in;
    there they meet. Targets outside all triangles are left out, or kept with NULL. A part of the map
    spans ``MAP_PART`` tiles, so that a group is bounded by the pixels of an area.
    """
    if value in targets.columns:
        raise ValueError(f"targets have a column {value}")
    span = tile * MAP_PART
    part = lambda v: F.floor(v / F.lit(span))
    tiles = scan_tiles(points, by, value, size)
    edge = lambda f, c: part(f(F.transform("px", lambda p: F.when(~F.isnan(p[c]), p[c]))))
    rows, cols = (F.sequence(edge(F.array_min, c), edge(F.array_max, c)) for c in ("lat", "lon"))
    sent = tiles.withColumn("_py", F.explode(rows)).withColumn("_px", F.explode(cols))
    placed = targets.withColumns({"_py": part(F.col("lat")), "_px": part(F.col("lon"))})
    names, keys = targets.columns, [*by, "_py", "_px"]
    # Both sides are packed where they meet: a task works on rows, without a stream for every group.
    left = by_key(sent, *keys).groupBy(*keys).agg(F.collect_list(F.struct("_tr", "_tc", "px")).alias("_tiles"))
    right = by_key(placed, *keys).groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("_targets"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, heights = [], []
            for k in range(batch.num_rows):
                rows, tiles_ = batch.column("_targets")[k].values, batch.column("_tiles")[k]
                y, x = (
                    np.asarray(rows.field(names.index(c)).to_numpy(zero_copy_only=False), float) for c in ("lat", "lon")
                )
                # Targets without a position lie in no triangle.
                known = np.flatnonzero(~(np.isnan(y) | np.isnan(x)))
                found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
                if tiles_.is_valid and len(known):
                    found += [tile.hits(y[known], x[known]) for tile in _tiles_in(tiles_.values, size)]
                target, number, v = (np.concatenate(c) for c in zip(*found, strict=True))
                best = _lowest(target, number)
                at, v = known[target[best]], v[best]
                if keep:
                    every = np.full(len(y), np.nan)
                    every[at] = v
                    at, v = np.arange(len(y)), every
                out.append(rows.take(pa.array(at)))
                heights.append(v)
            if out:
                all_rows = pa.concat_arrays(out)
                columns = [all_rows.field(c) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, _null_nan(np.concatenate(heights))], [*names, value])

    met = right.join(left, keys, "left").select("_targets", "_tiles")
    return met.mapInArrow(run, extended(targets, f"{value} double"))


def static_targets(targets: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> pa.Table | None:
    """``target, lat, lon`` of a grid on the driver, unless it has more cells than ``max_bytes`` hold."""
    most = max_bytes // 40
    rows = targets.select("target", F.col("lat").cast("double"), F.col("lon").cast("double"))
    found = rows.where("lat IS NOT NULL AND lon IS NOT NULL").limit(most + 1).toArrow()
    return found if found.num_rows <= most else None


def interpolate(
    points: DataFrame,
    targets: DataFrame,
    by: list[str],
    value: str = "value",
    target_by: list[str] | None = None,
    tile: float = 0.25,
    n_targets: int | None = None,
) -> DataFrame:
    """Value at every target inside the points' triangles, per scan.

    ``points``: ``by, row, col, lat, lon, value``; ``targets``: ``target, lat, lon``
    and the ``target_by`` columns. A target on a shared edge takes the triangle with
    the smallest id. With ``n_targets`` every scan gets all targets ``0..n-1``, NULL
    where a target lies outside. Targets shared by all scans go to the tiles if they are few
    enough.
    """
    target_by = target_by or []
    grid = None if target_by else static_targets(targets)
    if grid is not None:
        hits = tile_hits(
            scan_tiles(points, by, value), by, grid.column("lat").to_numpy(), grid.column("lon").to_numpy()
        )
        each = hits.select(*by, F.explode(F.arrays_zip("at", "tri", "v")).alias("_h"))
        kind = targets.schema["target"].dataType
        names = points.sparkSession.createDataFrame(
            grid.select(["target"]).append_column("_at", pa.array(np.arange(grid.num_rows, dtype=np.int32)))
        )
        found = each.select(*by, F.col("_h.at").alias("_at"), F.col("_h.tri").alias("tri"), F.col("_h.v").alias(value))
        found = found.join(F.broadcast(names), "_at").select(*by, F.col("target").cast(kind).alias("target"), "tri", value)
    else:
        hits = locate(triangles(points, by, [value]), targets, by, target_by, tile)
        v = F.expr(f"w1 * {value}1 + w2 * {value}2 + w3 * {value}3")
        found = hits.select(*by, "target", "tri", v.alias(value))
    if n_targets is not None:
        blanks = points.select(*by).distinct().select(
            *by,
            F.explode(F.sequence(F.lit(0), F.lit(n_targets - 1))).alias("target"),
            F.lit(None).cast("long").alias("tri"),
            F.lit(None).cast("double").alias(value),
        )
        found = found.unionByName(
            blanks.withColumn("target", F.col("target").cast(found.schema["target"].dataType))
        )
    return found.groupBy(*by, "target").agg(F.min_by(value, "tri").alias(value))


def interpolation_weights(
    geometry: DataFrame, targets: DataFrame, tile: float = 0.25
) -> DataFrame:
    """Source cells and weights of every target for a geometry that never changes.

    At most three rows per target; computed once and reused for every scan.
    """
    cells = geometry.select(
        "row", "col", "lat", "lon", F.col("row").alias("r"), F.col("col").alias("c")
    )
    hits = locate(triangles(cells, [], ["r", "c"]), targets, [], [], tile)
    three = F.array(*[F.struct(F.col(f"r{k}").alias("row"), F.col(f"c{k}").alias("col"),
                               F.col(f"w{k}").alias("weight")) for k in (1, 2, 3)])
    best = hits.groupBy("target").agg(F.min_by(three, "tri").alias("_w"))
    return best.select("target", F.explode("_w").alias("_s")).select("target", "_s.*")


def apply_weights(
    cells: DataFrame,
    weights: DataFrame,
    by: list[str],
    value: str = "value",
    n_targets: int | None = None,
    on: list[str] | None = None,
) -> DataFrame:
    """Interpolated value per scan and target from a weight table.

    A target with a missing source value is missing. Weights of a checked size are
    broadcast; else the join shuffles on (row, col), whose keys are as many as the radar
    has cells. ``n_targets`` says how many targets there are, numbered from 0: three weights of
    40 bytes each, for a weight table whose own statistics do not show its size. A target
    outside is an error. ``on`` lists the columns, such as the site, that belong to a geometry:
    weights and cells share them, and they are among ``by``.
    """
    on = on or []
    known = n_targets is not None and 3 * 40 * n_targets <= BROADCAST_MAX_BYTES
    if n_targets is not None:
        wrong = F.raise_error(F.concat(F.lit(f"target outside 0..{n_targets - 1}: "), F.col("target").cast("string")))
        inside = F.col("target").between(0, n_targets - 1)
        weights = weights.withColumn(
            "target", F.when(inside, F.col("target")).otherwise(wrong.cast(weights.schema["target"].dataType))
        )
    small = (known and not on) or fits_broadcast(weights)
    joined = cells.join(F.broadcast(weights) if small else weights, [*on, "row", "col"], "inner")
    total = F.sum(F.col("weight") * F.col(value))
    complete = F.count(F.when(F.col(value).isNotNull(), 1)) == 3
    return joined.groupBy(*by, "target").agg(F.when(complete, total).alias(value))
