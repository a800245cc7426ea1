"""Frames: packing, advection along a motion field, motion by block matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.functions.arrays import clip_index, int_div, positions
from pluvia.session import bounded_batches

#: Cells of the moved frames that a task holds before it passes them on.
FOLLOWED_CELLS = 1 << 19


def unpack_frames(packed: DataFrame, nj: int, keys: list[str], values: str = "values") -> DataFrame:
    """One row per cell from one row per frame."""
    cells = packed.select(*keys, F.posexplode(values).alias("_k", "value"))
    return cells.select(
        *keys,
        int_div(F.col("_k"), nj).alias("i"),
        F.pmod(F.col("_k"), F.lit(nj)).alias("j"),
        "value",
    )


def pack_frames(
    cells: DataFrame, ni: int, nj: int, keys: list[str], sparse: bool = False
) -> DataFrame:
    """One row per frame from one row per cell.

    ``sparse`` fills absent cells with NULL first; without it a frame that is not
    complete is an error, as later reads go by position. Repeated cells keep the largest value. They
    are merged by frame and cell, on the map side first, before the frame is collected; so a frame
    with many repeats is no hot key and a group never holds more than ``ni * nj`` cells.
    """
    placed = cells.select(
        *keys, (F.col("i") * nj + F.col("j")).cast("int").alias("_k"), F.col("value")
    )
    if sparse:
        blanks = cells.select(*keys).distinct().select(
            *keys, F.explode(positions(ni * nj)).alias("_k"), F.lit(None).cast("double").alias("value")
        )
        placed = placed.unionByName(blanks)
    one = placed.groupBy(*keys, "_k").agg(F.max("value").alias("value"))
    cells_in_order = F.array_sort(F.collect_list(F.struct("_k", "value")))
    packed = one.groupBy(*keys).agg(cells_in_order.alias("_c"))
    whole = (F.size("_c") == ni * nj) & (F.get("_c", F.lit(0))["_k"] == 0) & (
        F.element_at("_c", -1)["_k"] == ni * nj - 1
    )
    values = F.transform("_c", lambda c: c["value"])
    wrong = F.raise_error(F.lit(f"a frame does not have the cells of {ni} x {nj}"))
    return packed.select(
        *keys, F.when(whole, values).otherwise(wrong.cast("array<double>")).alias("values")
    )


def frame_times(frames: DataFrame, ts: str = "frame_ts") -> DataFrame:
    """Distinct times that have a frame."""
    return frames.select(ts).distinct()


def centre_window(
    cells: DataFrame, first: int = 96, last: int = 159, diagonal: bool = False
) -> DataFrame:
    """Cells of the central block used for headline scores.

    ``diagonal`` keeps only the cells with ``i = j`` of that block.
    """
    inside = F.col("i").between(first, last) & F.col("j").between(first, last)
    return cells.where(inside & (F.col("i") == F.col("j")) if diagonal else inside)


def warp(
    frames: DataFrame,
    ni: int,
    nj: int,
    keys: list[str],
    mode: str = "bilinear",
    padding: str = "zeros",
) -> DataFrame:
    """Cells of every frame moved along its motion field (backward advection).

    ``frames``: ``keys`` and packed ``values, du, dv``; cell ``(i, j)`` reads
    ``(i + dv, j + du)``. ``padding`` is ``border`` (clamp to the edge) or ``zeros``;
    ``mode`` is ``bilinear`` or ``nearest`` (ties to even). The sources of a cell lie
    in its own row, so nothing is shuffled and the arithmetic stays in generated code.
    """
    if mode not in ("bilinear", "nearest") or padding not in ("border", "zeros"):
        raise ValueError("mode: bilinear|nearest, padding: border|zeros")
    cells = frames.select(*keys, "values", "dv", F.posexplode("du").alias("_k", "_du"))
    cells = cells.withColumns({"i": int_div(F.col("_k"), nj), "j": F.pmod("_k", F.lit(nj))})
    y, x = F.col("i") + F.get("dv", F.col("_k")), F.col("j") + F.col("_du")
    if padding == "border":
        y = F.greatest(F.least(y, F.lit(float(ni - 1))), F.lit(0.0))
        x = F.greatest(F.least(x, F.lit(float(nj - 1))), F.lit(0.0))
    cells = cells.withColumns({"_y": y, "_x": x})
    if mode == "nearest":
        cells = cells.withColumns({"_i": F.bround("_y").cast("int"), "_j": F.bround("_x").cast("int")})
        return cells.select(*keys, "i", "j", _read_cell(0, 0, ni, nj, padding).alias("value"))
    cells = cells.withColumns({"_i": F.floor("_y").cast("int"), "_j": F.floor("_x").cast("int")})
    cells = cells.withColumns(
        {
            "_wy": F.col("_y") - F.col("_i"),
            "_wx": F.col("_x") - F.col("_j"),
            **{f"_v{a}{b}": _read_cell(a, b, ni, nj, padding) for a in (0, 1) for b in (0, 1)},
        }
    )
    blended = F.expr(
        "(1 - _wy) * ((1 - _wx) * _v00 + _wx * _v01) + _wy * ((1 - _wx) * _v10 + _wx * _v11)"
    )
    return cells.select(*keys, "i", "j", blended.alias("value"))


def _read_cell(a: int, b: int, ni: int, nj: int, padding: str) -> Column:
    i, j = F.col("_i") + a, F.col("_j") + b
    cell = F.get("values", clip_index(i, ni) * nj + clip_index(j, nj))
    if padding == "border":
        return cell
    return F.when(i.between(0, ni - 1) & j.between(0, nj - 1), cell).otherwise(F.lit(0.0))


def evolve(
    frames: DataFrame,
    motion: DataFrame,
    ni: int,
    nj: int,
    n_leads: int,
    key: str = "issue_ts",
    values: str = "values",
) -> DataFrame:
    """Iterated nearest advection plus intensity change, one row per issue and lead.

    ``motion`` holds one row per (issue, lead) with packed ``du``, ``dv`` and
    ``intensity``. The rows of one issue (at most ``n_leads``) are joined to its
    frame once; the leads then follow inside the row, so the recurrence needs one
    shuffle however long the horizon is.
    """
    steps = motion.where(F.col("lead").between(1, n_leads)).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("lead", "du", "dv", "intensity"))).alias("_s")
    )
    # Both sides are packed, and their statistics count an array as one number: never a broadcast.
    joined = frames.select(key, F.col(values).alias("values")).hint("merge").join(steps, key, "inner")
    flat = joined.where("values is not null").select(
        key,
        "values",
        F.transform("_s", lambda s: s["lead"]).alias("leads"),
        F.flatten(F.transform("_s", lambda s: s["du"])).alias("du"),
        F.flatten(F.transform("_s", lambda s: s["dv"])).alias("dv"),
        F.flatten(F.transform("_s", lambda s: s["intensity"])).alias("intensity"),
    )
    rows, cols = np.divmod(np.arange(ni * nj), nj)
    kind = frames.schema[key].dataType.simpleString()
    names = [key, "lead", "values"]
    bounded_batches(frames.sparkSession)

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for pdf in batches:
            for rec in pdf.itertuples(index=False, name=None):
                at, values, leads = rec[:3]
                frame = np.asarray(values, float)
                shape = (len(leads), ni * nj)
                du, dv, gain = (np.asarray(a, float).reshape(shape) for a in rec[3:])
                for step, lead in enumerate(leads):
                    i = np.rint(np.clip(rows + dv[step], 0, ni - 1)).astype(int)
                    j = np.rint(np.clip(cols + du[step], 0, nj - 1)).astype(int)
                    frame = frame[i * nj + j] + gain[step]
                    out.append((at, int(lead), frame))
                    held += frame.size
                    if held >= FOLLOWED_CELLS:
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)

    return flat.mapInPandas(follow, f"{key} {kind}, lead int, values array<double>")


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def block_motion(
    pairs: DataFrame, ni: int, nj: int, block: int, radius: int, key: str = "frame_ts"
) -> DataFrame:
    """Best shift of every block between two frames: least squared difference.

    ``pairs`` holds ``key``, ``cur`` and ``prev`` (packed). Ties go to the smallest
    shift, then the smallest ``di``, ``dj``. Cells beyond the edge repeat it. Each
    frame pair is independent, so no shuffle is needed here.
    """
    found = block_shifts(pairs, ni, nj, block, radius, key)
    blocks = found.select(key, F.posexplode("shifts").alias("_b", "_s"))
    return blocks.select(
        key, int_div(F.col("_b"), nj // block).alias("bi"), F.pmod(F.col("_b"), F.lit(nj // block)).alias("bj"),
        "_s.di", "_s.dj", "_s.ssd",
    )


def block_shifts(
    pairs: DataFrame, ni: int, nj: int, block: int, radius: int, key: str = "frame_ts", levels: int = 0
) -> DataFrame:
    """The shifts of :func:`block_motion` as one row per pair: ``key, cur, shifts`` with an array of
    ``di, dj, ssd`` by block, beside the frame they belong to.

    With ``levels`` the search runs over a pyramid: frames are averaged over 2 x 2 cells that often;
    the coarsest level is searched within ``radius`` of its own cells, every finer one within one cell
    of twice the shift above. So shifts of up to ``radius * 2 ** levels`` cells and some more are found
    at a cost that grows with the logarithm of the shift; on smooth motion they are those of the full
    search. Sizes must be divisible by the block, and blocks by ``2 ** levels``.
    """
    if ni % block or nj % block or block % (1 << levels):
        raise ValueError("frame size must be a multiple of the block size, blocks of 2 ** levels")
    kind = pairs.schema[key].dataType.simpleString()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            cur = _stack(pdf["cur"]).reshape(-1, ni, nj)
            prev = _stack(pdf["prev"]).reshape(-1, ni, nj)
            scales = [(cur, prev)]
            for _ in range(levels):
                scales.append(tuple(_halved(a) for a in scales[-1]))
            shift = np.zeros((len(pdf), ni // block, nj // block, 2), np.int64)
            for level in range(levels, -1, -1):
                reach = radius if level == levels else 1
                shift, ssd = _best_shifts(*scales[level], block >> level, 2 * shift, reach)
            flat, cost = shift.reshape(len(pdf), -1, 2), ssd.reshape(len(pdf), -1)
            shifts = [
                [{"di": int(a), "dj": int(b), "ssd": float(c)} for (a, b), c in zip(f, s, strict=True)]
                for f, s in zip(flat, cost, strict=True)
            ]
            yield pd.DataFrame({key: pdf[key].to_numpy(), "cur": pdf["cur"].to_numpy(), "shifts": shifts})

    return pairs.select(key, "cur", "prev").mapInPandas(
        search, f"{key} {kind}, cur array<double>, shifts array<struct<di: int, dj: int, ssd: double>>"
    )


def _halved(frames: np.ndarray) -> np.ndarray:
    n, ni, nj = frames.shape
    return frames.reshape(n, ni // 2, 2, nj // 2, 2).mean(axis=(2, 4))


def _best_shifts(
    cur: np.ndarray, prev: np.ndarray, block: int, start: np.ndarray, reach: int
) -> tuple[np.ndarray, np.ndarray]:
    """Best shifts of all blocks within ``reach`` of their start, and their squared differences."""
    n, ni, nj = cur.shape
    bi, bj = ni // block, nj // block
    steps = [(di, dj) for di in range(-reach, reach + 1) for dj in range(-reach, reach + 1)]
    cells = cur.reshape(n, bi, block, bj, block).transpose(0, 1, 3, 2, 4)
    rows = (np.arange(bi) * block)[:, None] + np.arange(block)
    cols = (np.arange(bj) * block)[:, None] + np.arange(block)
    frame = np.arange(n)[:, None, None, None, None]
    best, pick = np.full((n, bi, bj), np.inf), np.zeros((n, bi, bj, 2), np.int64)
    for di, dj in steps:
        tried = start + np.array([di, dj])
        i = np.clip(rows[None, :, None, :] - tried[..., 0, None], 0, ni - 1)
        j = np.clip(cols[None, None, :, :] - tried[..., 1, None], 0, nj - 1)
        moved = prev[frame, i[..., :, None], j[..., None, :]]
        ssd = ((cells - moved) ** 2).sum(axis=(3, 4))
        # Of equal differences the smallest shift, then the smallest di, dj.
        rank = lambda s: ((s**2).sum(-1), s[..., 0], s[..., 1])
        (a, b, c), (x, y, z) = rank(tried), rank(pick)
        nearer = (a < x) | ((a == x) & ((b < y) | ((b == y) & (c < z))))
        better = (ssd < best) | ((ssd == best) & nearer)
        best, pick = np.where(better, ssd, best), np.where(better[..., None], tried, pick)
    return pick, best


def extrapolate(
    frames: DataFrame,
    motion: DataFrame,
    ni: int,
    nj: int,
    block: int,
    n_leads: int,
    key: str = "frame_ts",
    values: str = "values",
    keep_missing: bool = True,
) -> DataFrame:
    """Forecast each lead by moving every block along its own shift, clamped to the frame.

    ``motion`` holds one row per block (:func:`block_motion`), or per frame the packed shifts
    (:func:`block_shifts`). Frames without motion have NULL forecasts; without ``keep_missing`` they
    have no row. Where the shifts stand beside the frame, :func:`extrapolate_moved` needs no join.
    """
    if "shifts" not in motion.columns:
        blocks = F.array_sort(F.collect_list(F.struct("bi", "bj", "di", "dj")))
        motion = motion.groupBy(key).agg(
            F.transform(blocks, lambda b: F.struct(b["di"].alias("di"), b["dj"].alias("dj"))).alias("shifts")
        )
    how = "left" if keep_missing else "inner"
    joined = frames.select(key, F.col(values).alias("values")).join(motion.select(key, "shifts"), key, how)
    return extrapolate_moved(joined, ni, nj, block, n_leads, key)


def extrapolate_moved(
    frames: DataFrame, ni: int, nj: int, block: int, n_leads: int, key: str = "frame_ts", values: str = "values"
) -> DataFrame:
    """:func:`extrapolate` of rows that hold a frame and its ``shifts``: nothing is shuffled."""
    nbj = nj // block
    leads = frames.select(
        key, F.col(values).alias("_v"), F.col("shifts").alias("_m"),
        F.explode(F.sequence(F.lit(1), F.lit(n_leads))).alias("lead"),
    )

    def cell(k: Column) -> Column:
        i, j = int_div(k, nj), F.pmod(k, F.lit(nj))
        m = F.get("_m", int_div(i, block) * nbj + int_div(j, block))
        si = clip_index(i - F.col("lead") * m["di"], ni)
        sj = clip_index(j - F.col("lead") * m["dj"], nj)
        return F.get("_v", si * nj + sj)

    moved = F.when(F.col("_m").isNotNull(), F.transform(positions(ni * nj), cell))
    return leads.select(key, "lead", moved.alias("values"))


def ensemble_mean(
    cells: DataFrame, keys: list[str], value: str = "value", skip_missing: bool = True
) -> DataFrame:
    """Mean over members, skipping missing values (NULL or NaN).

    Without ``skip_missing`` a value that any member misses is NULL.
    """
    v = F.when(~F.isnan(value), F.col(value))
    mean = F.avg(v) if skip_missing else F.when(F.count(v) == F.count(F.lit(1)), F.avg(v))
    return cells.groupBy(*keys).agg(mean.alias(value))


def ensemble_mean_packed(
    members: DataFrame, keys: list[str], nj: int, values: str = "values"
) -> DataFrame:
    """Cell-wise ensemble mean of packed members, as cells.

    The packed members of a forecast meet first and are averaged place by place, so the shuffle carries
    arrays instead of keyed cells, and a task holds the members of one forecast, not the cells of all.
    Rows are grouped in order of their keys: what does not fit is sorted on disk. Missing values
    (NULL or NaN) are skipped, members of other lengths count where they have a cell.
    """
    met = members.select(*keys, F.col(values).alias("_v")).repartition(*keys)
    frames = met.groupBy(*keys).agg(F.collect_list("_v").alias("_m"))
    # NaN compares greater than everything, so it does not pass as a value.
    at = lambda k: F.filter(
        F.transform("_m", lambda v: F.get(v, k).cast("double")), lambda x: x.isNotNull() & ~F.isnan(x)
    )
    mean = lambda x: F.when(
        F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    )
    longest = F.array_max(F.transform("_m", F.size))
    means = F.transform(F.sequence(F.lit(0), longest - 1), lambda k: F.element_at(F.transform(F.array(at(k)), mean), 1))
    packed = frames.select(*keys, F.when(longest > 0, means).alias("values"))
    return unpack_frames(packed, nj, keys)


def map_order(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Rows from north to south, each row from west to east (a distributed range sort)."""
    return df.orderBy(F.col(lat).desc(), F.col(lon).asc())


def pivot_to_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Latitude x longitude matrix: one row per latitude, values west to east."""
    line = F.array_sort(F.collect_list(F.struct("lon", "value")))
    return cells.groupBy(*keys, "lat").agg(F.transform(line, lambda c: c["value"]).alias("row"))
