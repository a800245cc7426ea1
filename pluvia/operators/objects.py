"""Connected echo objects of radar composites and the speckle filters built on them.

One composite (rays x bins, a few hundred thousand cells) is the unit of work: its
cells meet in one task to be labelled, everything else is windows over a scan. Arrays too
large for that are labelled by tiles whose seams are joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvia.functions.arrays import smooth_symmetric
from pluvia.functions.radar import NRAYS
from pluvia.session import by_key, extended, fits_broadcast, stored

#: Rays and bins of the blocks by which cells are dealt.
BLOCK = 64


def echo_cells(
    rays: DataFrame,
    threshold: float,
    smooth_window: int | None = None,
    scan: str = "scan_id",
    ray: str = "ray",
    values: str = "values",
) -> DataFrame:
    """Cells that may take part in objects: ``(scan, ray, bin, value, core)``.

    ``core`` cells reach the threshold after smoothing along the ray and form the
    objects; the others only reach it before smoothing. Smoothing happens inside
    the packed ray.
    """
    smooth = smooth_symmetric(F.col(values), smooth_window) if smooth_window else F.col(values)
    pairs = F.arrays_zip(F.col(values).alias("raw"), smooth.alias("smooth"))
    cells = rays.select(
        F.col(scan).alias("scan"), F.col(ray).cast("int").alias("ray"),
        F.posexplode(pairs).alias("bin", "_c"),
    )
    core = F.coalesce(F.col("_c.smooth") >= threshold, F.lit(False))
    cells = cells.select("scan", "ray", "bin", F.col("_c.raw").alias("value"), core.alias("core"))
    return cells.where(F.col("core") | (F.col("value") >= threshold))


def _touching(cell: np.ndarray, nrays: int, nbins: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of 8-connected cells among sorted ones; rays wrap around."""
    ray, rbin = np.divmod(cell, nbins)
    left, right = [], []
    for dr, db in ((0, 1), (1, -1), (1, 0), (1, 1)):
        ok = (rbin + db >= 0) & (rbin + db < nbins)
        other = np.where(ok, ((ray + dr) % nrays) * nbins + rbin + db, -1)
        at = np.minimum(np.searchsorted(cell, other), max(len(cell) - 1, 0))
        near = np.flatnonzero(ok & (cell[at] == other)) if len(cell) else at
        left.append(near)
        right.append(at[near])
    return np.concatenate(left), np.concatenate(right)


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest place of each of ``n`` places' group, after joining the pairs ``a``, ``b``."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        if np.array_equal(ra, rb):
            return root
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while not np.array_equal(root, root[root]):
            root = root[root]


def _components(cell: np.ndarray, nrays: int, nbins: int) -> np.ndarray:
    """Smallest cell id of each sorted cell's 8-connected object; rays wrap around."""
    return cell[_joined(*_touching(cell, nrays, nbins), len(cell))]


def label_objects(cells: DataFrame, nbins: int, nrays: int = NRAYS) -> DataFrame:
    """Echo cells with the label of their object (NULL for cells outside any).

    The label is the smallest ``ray * nbins + bin`` of the object, so it does not
    depend on the order in which cells arrive.
    """

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ray", "bin"], ignore_index=True)
        core = pdf["core"].to_numpy(bool)
        cell = (pdf["ray"].to_numpy() * nbins + pdf["bin"].to_numpy())[core].astype(np.int64)
        labels = np.full(len(pdf), -1, np.int64)
        if cell.size:
            labels[core] = _components(cell, nrays, nbins)
        return pdf.assign(label=pd.array(labels, "Int64").copy()).assign(
            label=lambda d: d["label"].where(core)
        )[["scan", "ray", "bin", "value", "label"]]

    kind = cells.schema["scan"].dataType.simpleString()
    return cells.groupBy("scan").applyInPandas(
        label, f"scan {kind}, ray int, bin int, value double, label long"
    )


def label_by_tiles(
    cells: DataFrame, nbins: int, nrays: int = NRAYS, tile_rays: int = 256, tile_bins: int = 256
) -> DataFrame:
    """The same labels for arrays too large for one task: tiles are labelled apart, then their seams.

    A tile is one packed row. The objects of neighbouring tiles that touch across a seam, or across
    north, are linked; the links of a scan, at most four per cell of a seam, join its objects in one
    pass, whatever their length. Only tiles whose objects change their label hear of it. The cells
    move twice as packed rows, the seams once.
    """
    kind = cells.schema["scan"].dataType.simpleString()
    tile = cells.withColumns({
        "_ty": F.floor(F.col("ray") / tile_rays).cast("int"), "_tx": F.floor(F.col("bin") / tile_bins).cast("int"),
    })

    def label(key: tuple, part: pa.Table) -> pa.Table:
        ray, rbin = (part.column(c).to_numpy().astype(np.int64) for c in ("ray", "bin"))
        core = part.column("core").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        order = np.lexsort((rbin, ray))
        ray, rbin, core = ray[order], rbin[order], core[order]
        cell = (ray * nbins + rbin)[core]
        # Without wrapping: the first and the last ray are a seam.
        labels = _components(cell, nrays + 1, nbins) if cell.size else cell
        all_labels = np.full(len(order), -1, np.int64)
        all_labels[core] = labels
        edge = (
            (ray % tile_rays == 0) | (ray % tile_rays == tile_rays - 1) | (ray == 0) | (ray == nrays - 1)
            | (rbin % tile_bins == 0) | (rbin % tile_bins == tile_bins - 1)
        ) & core
        one = lambda a, t: pa.ListArray.from_arrays(
            pa.array([0, len(a)], pa.int32()), a if isinstance(a, pa.Array) else pa.array(a).cast(t)
        )
        return pa.table({
            "scan": pa.array([key[0].as_py()], part.schema.field("scan").type),
            "_ty": pa.array([key[1].as_py()], pa.int32()), "_tx": pa.array([key[2].as_py()], pa.int32()),
            "ray": one(ray, pa.int32()), "bin": one(rbin, pa.int32()),
            "value": one(part.column("value").combine_chunks().take(pa.array(order)), pa.float64()),
            "label": one(pa.array(all_labels, mask=all_labels < 0), pa.int64()),
            "edge": one((ray * nbins + rbin)[edge], pa.int64()), "edge_label": one(all_labels[edge], pa.int64()),
        })

    lists = "ray array<int>, bin array<int>, value array<double>, label array<long>, edge array<long>, edge_label array<long>"
    tiles = stored(by_key(tile, "scan", "_ty", "_tx").groupBy("scan", "_ty", "_tx").applyInArrow(label, f"scan {kind}, _ty int, _tx int, {lists}"))

    def join_seams(key: tuple, edges: pa.Table) -> pa.Table:
        cell = np.concatenate([np.zeros(0, np.int64), *[c.values.to_numpy() for c in edges.column("edge")]])
        own = np.concatenate([np.zeros(0, np.int64), *[c.values.to_numpy() for c in edges.column("edge_label")]])
        order = np.argsort(cell)
        cell, own = cell[order], own[order]
        known, place = np.unique(own, return_inverse=True)
        left, right = (place[side] for side in _touching(cell, nrays, nbins))
        root = known[_joined(left, right, len(known))]
        moved = known != root
        ray, rbin = np.divmod(known[moved], nbins)
        return pa.table({
            "scan": pa.array([key[0].as_py()] * int(moved.sum()), edges.schema.field("scan").type),
            "_ty": pa.array((ray // tile_rays).astype(np.int32)), "_tx": pa.array((rbin // tile_bins).astype(np.int32)),
            "old": pa.array(known[moved]), "new": pa.array(root[moved]),
        })

    seams = tiles.where(F.size("edge") > 0).select("scan", "edge", "edge_label")
    renamed = seams.groupBy("scan").applyInArrow(join_seams, f"scan {kind}, _ty int, _tx int, old long, new long")
    names = renamed.groupBy("scan", "_ty", "_tx").agg(F.collect_list(F.struct("old", "new")).alias("names"))
    done = tiles.drop("edge", "edge_label").join(names, ["scan", "_ty", "_tx"], "left")

    def rename(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                label_ = batch.column("label")[k].values
                names_ = batch.column("names")[k]
                if names_.is_valid:
                    old, new = (names_.values.field(c).to_numpy() for c in (0, 1))
                    order = np.argsort(old)
                    old, new = old[order], new[order]
                    value = label_.fill_null(-1).to_numpy()
                    at = np.minimum(np.searchsorted(old, value), len(old) - 1)
                    value = np.where(old[at] == value, new[at], value)
                    label_ = pa.array(value, mask=value < 0)
                scan = batch.column("scan").take(pa.array(np.full(len(label_), k)))
                columns = [batch.column(c)[k].values for c in ("ray", "bin", "value")]
                yield pa.RecordBatch.from_arrays([scan, *columns, label_], ["scan", "ray", "bin", "value", "label"])

    packed = done.select("scan", "ray", "bin", "value", "label", "names")
    return packed.mapInArrow(rename, f"scan {kind}, ray int, bin int, value double, label long")


def label_by_propagation(cells: DataFrame, nbins: int, nrays: int = NRAYS) -> DataFrame:
    """The same labels by repeated grouping: for arrays too large for one task.

    Every round all cells of a label take the smallest label among their neighbours, then
    the label of the cell that one names. A label whose cells see no other one is a whole object and
    leaves, so later rounds move the long objects only; the rounds end when none is left. Each round is
    stored once, which keeps the plan short and survives lost executors. Cells are dealt by blocks of an
    array, so that most of what they send their neighbours is merged before it moves.
    """
    core = cells.where("core").select(
        "scan", (F.col("ray").cast("long") * nbins + F.col("bin")).alias("cell")
    )
    labels = core.distinct().withColumn("label", F.col("cell"))
    ray, rbin = F.floor(F.col("cell") / nbins), F.pmod(F.col("cell"), F.lit(nbins))
    block = [F.floor(ray / BLOCK).alias("_by"), F.floor(rbin / BLOCK).alias("_bx")]
    moves = F.explode(
        F.array(
            *[
                F.struct(
                    F.when(
                        (rbin + db).between(0, nbins - 1),
                        F.pmod(ray + dr, F.lit(nrays)) * nbins + rbin + db,
                    ).alias("cell"),
                    F.lit(dr == db == 0).alias("own"),
                )
                for dr in (-1, 0, 1)
                for db in (-1, 0, 1)
            ]
        )
    )
    whole = []
    while True:
        dealt = labels.select("*", *block).repartition("scan", "_by", "_bx").select("scan", moves.alias("_m"), "label")
        sent = dealt.select("scan", "_m.cell", "label", "_m.own").where("cell is not null")
        near = sent.groupBy("scan", "cell").agg(
            F.max(F.when(F.col("own"), F.col("label"))).alias("label"),
            F.min("label").alias("_low"), F.max("label").alias("_high"),
        ).where("label is not null")
        step = stored(near)
        seen = step.where("_low < _high").groupBy("scan", "label").agg(F.min("_low").alias("_to"))
        going = stored(seen)
        whole.append(step.join(going, ["scan", "label"], "left_anti").select("scan", "cell", "label"))
        if going.isEmpty():
            break
        named = step.select("scan", F.col("cell").alias("_to"), F.col("label").alias("_at"))
        after = going.select("scan", F.col("label").alias("_at"), F.col("_to").alias("_jump"))
        names = going.join(named, ["scan", "_to"]).join(after, ["scan", "_at"], "left").select(
            "scan", "label", F.least("_to", "_at", "_jump").alias("_next")
        )
        labels = step.join(names, ["scan", "label"]).select("scan", "cell", F.col("_next").alias("label"))
    labels = whole[0]
    for part in whole[1:]:
        labels = labels.unionByName(part)
    found = labels.select(
        "scan", F.floor(F.col("cell") / nbins).cast("int").alias("ray"),
        F.pmod(F.col("cell"), F.lit(nbins)).cast("int").alias("bin"), "label",
    )
    return cells.join(found, ["scan", "ray", "bin"], "left").select(
        "scan", "ray", "bin", "value", "label"
    )


def object_stats(
    labelled: DataFrame, threshold: float, nbins: int, nrays: int = NRAYS, fill: float = 0.0
) -> DataFrame:
    """Labelled cells with the size, area/perimeter ratio and variation of their object.

    Neighbours come from windows along the ray and across rays; all windows of a
    scan share one partitioning, so the cells move once. The array has no
    neighbour beyond its first and last ray here.
    """
    cells = labelled.repartition("scan").withColumn(
        "_v", F.when(F.col("value") >= threshold, F.col("value")).otherwise(F.lit(fill))
    )
    along = Window.partitionBy("scan", "ray").orderBy("bin")
    across = Window.partitionBy("scan", "bin").orderBy("ray")
    cells = cells.withColumns(
        {
            f"_n{k}": F.struct(fn(axis).over(w).alias("at"), fn("_v").over(w).alias("v"),
                               fn("label").over(w).alias("l"))
            for k, (fn, axis, w) in enumerate(
                [(F.lag, "bin", along), (F.lead, "bin", along),
                 (F.lag, "ray", across), (F.lead, "ray", across)]
            )
        }
    )
    sides = [("bin", -1, nbins), ("bin", 1, nbins), ("ray", -1, nrays), ("ray", 1, nrays)]
    total, border = F.lit(0.0), F.lit(0)
    for k, (axis, step, size) in enumerate(sides):
        inside = (F.col(axis) + step).between(0, size - 1)
        adjacent = F.coalesce(F.col(f"_n{k}.at") == F.col(axis) + step, F.lit(False))
        outside_value = F.when(inside, F.lit(fill)).otherwise(F.lit(0.0))
        total = total + F.when(adjacent, F.col(f"_n{k}.v")).otherwise(outside_value)
        same = adjacent & F.coalesce(F.col(f"_n{k}.l") == F.col("label"), F.lit(False))
        border = border + F.when(inside & ~same, F.lit(1)).otherwise(F.lit(0))
    cells = cells.select(
        "scan", "ray", "bin", "value", "label", "_v",
        F.try_divide(F.abs(F.col("_v") - total / 4), F.col("_v")).alias("_rel"),
        border.alias("_border"),
    )
    whole = Window.partitionBy("scan", "label")
    size = F.count(F.lit(1)).over(whole)
    known = F.col("label").isNotNull()
    return cells.select(
        "scan", "ray", "bin", "value", "label",
        F.when(known, size).alias("size"),
        F.when(known, F.try_divide(size.cast("double"), F.sum("_border").over(whole))).alias(
            "ratio"
        ),
        F.when(known, F.sum(F.coalesce("_rel", F.lit(0.0))).over(whole) / size).alias("variation"),
    )


def despeckle(
    rays: DataFrame,
    nbins: int,
    nrays: int = NRAYS,
    threshold: float = 10.0,
    min_size: int = 10,
    min_ratio: float = 0.5,
    max_variation: float = 0.1,
    smooth_window: int | None = None,
    fill: float = 0.0,
    scan: str = "scan_id",
    ray: str = "ray",
) -> DataFrame:
    """Echo cells that survive: objects too small, too thin or too uneven are dropped.

    Cells not in the result hold the fill value.
    """
    cells = echo_cells(rays, threshold, smooth_window, scan, ray)
    stats = object_stats(label_objects(cells, nbins, nrays), threshold, nbins, nrays, fill)
    drop = (
        (F.col("size") < min_size)
        | (F.col("ratio") < min_ratio)
        | (F.col("variation") > max_variation)
    )
    kept = ~F.coalesce(drop, F.lit(False)) & (F.col("value") >= threshold)
    return stats.where(kept)


def echo_runs(
    rays: DataFrame,
    threshold: float,
    smooth_window: int | None = None,
    scan: str = "scan_id",
    ray: str = "ray",
    values: str = "values",
) -> DataFrame:
    """Runs of echo along the rays: ``scan, ray, runs``, a row per ray that has any.

    A run is ``first, last`` and the ``value`` and ``core`` of its cells (see :func:`echo_cells`); all is
    found inside the packed ray. Unknown values (NULL, NaN) are no echo.
    """
    raw = F.col(values).cast("array<double>")
    smooth = smooth_symmetric(raw, smooth_window) if smooth_window else raw
    kind = rays.schema[scan].dataType.simpleString()

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("value")
            offs = lists.offsets.to_numpy().astype(np.int64)
            v, s = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("value", "smooth"))
            core = s >= threshold
            on = core | (v >= threshold)
            # Where each row begins, seen from its cells; no run goes on from row to row.
            row = np.repeat(np.arange(batch.num_rows), np.diff(offs))
            opens, closes = on.copy(), on.copy()
            opens[1:] &= ~on[:-1] | (row[1:] != row[:-1])
            closes[:-1] &= ~on[1:] | (row[1:] != row[:-1])
            first, last = np.flatnonzero(opens), np.flatnonzero(closes)
            begin = np.concatenate([[0], np.cumsum(np.diff(offs))])[row[first]]
            ends = pa.array(np.concatenate([[0], np.cumsum(last - first + 1)]).astype(np.int32))
            runs = pa.StructArray.from_arrays(
                [
                    pa.array((first - begin).astype(np.int32)), pa.array((last - begin).astype(np.int32)),
                    pa.ListArray.from_arrays(ends, pa.array(v[on], pa.float64())),
                    pa.ListArray.from_arrays(ends, pa.array(core[on])),
                ],
                ["first", "last", "value", "core"],
            )
            count = np.bincount(row[first], minlength=batch.num_rows)
            has = pa.array(np.flatnonzero(count))
            of = pa.array(np.concatenate([[0], np.cumsum(count[count > 0])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("scan").take(has), batch.column("ray").take(has), pa.ListArray.from_arrays(of, runs)],
                ["scan", "ray", "runs"],
            )

    rows = rays.where(F.size(values) > 0).select(
        F.col(scan).alias("scan"), F.col(ray).cast("int").alias("ray"), raw.alias("value"), smooth.alias("smooth")
    )
    run = "struct<first: int, last: int, value: array<double>, core: array<boolean>>"
    return rows.mapInArrow(find, f"scan {kind}, ray int, runs array<{run}>")


RUN = "first int, label long, value array<double>"


def label_runs(runs: DataFrame, nbins: int, nrays: int = NRAYS) -> DataFrame:
    """Objects of :func:`echo_runs` as rows ``scan, ray, first, label, value``: a run of an object's
    cells. Labels are those of :func:`label_objects`; the runs of a scan meet in one task."""
    kind = runs.schema["scan"].dataType.simpleString()

    def label(key: tuple, rows: pa.Table) -> pa.Table:
        table_ = rows.combine_chunks()
        lists = table_.column("runs").combine_chunks()
        ray = np.repeat(table_.column("ray").to_numpy(), np.diff(lists.offsets.to_numpy()))
        parts = lists.flatten()
        first, value, core = parts.field("first").to_numpy().astype(np.int64), parts.field("value"), parts.field("core")
        sizes = np.diff(value.offsets.to_numpy())
        run = np.repeat(np.arange(len(first)), sizes)
        rbin = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        inside = core.flatten().to_numpy(zero_copy_only=False).astype(bool)
        cell = ray[run].astype(np.int64) * nbins + rbin
        order = np.argsort(cell)
        order = order[inside[order]]
        cell = cell[order]
        labels = _components(cell, nrays, nbins) if cell.size else cell
        # Runs of object cells: what lies side by side on a ray is one object.
        opens = np.flatnonzero((np.diff(cell, prepend=-2) != 1) | (cell % nbins == 0))
        ends = np.append(opens, len(cell)).astype(np.int32)
        rays_, firsts = np.divmod(cell[opens], nbins)
        return pa.table({
            "scan": pa.array([key[0].as_py()] * len(opens), rows.schema.field("scan").type),
            "ray": pa.array(rays_.astype(np.int32)), "first": pa.array(firsts.astype(np.int32)),
            "label": pa.array(labels[opens]),
            "value": pa.ListArray.from_arrays(pa.array(ends), value.flatten().take(pa.array(order))),
        })

    return by_key(runs, "scan").groupBy("scan").applyInArrow(label, f"scan {kind}, ray int, {RUN}")


def despeckle_time(
    rays: DataFrame,
    scans: DataFrame,
    nbins: int,
    nrays: int = NRAYS,
    neighbours: list[int] | None = None,
    threshold: float = 10.0,
    min_intersections: int = 1,
    smooth_window: int | None = None,
    scan: str = "scan_id",
    ray: str = "ray",
    by: list[str] | None = None,
) -> DataFrame:
    """Echo cells of objects that overlap echoes in enough neighbouring scans.

    ``scans`` gives every scan its position in time (``scan``, ``seq``) and the ``by``
    columns, such as the site and its geometry: only scans that agree in them are
    compared. Scan ids are unique over all sites, positions within ``by``.
    ``neighbours`` lists the positions to compare with. Objects and echoes travel as runs along
    their ray: a scan's runs go to the scans that look at it, and the runs of a ray that meet are
    compared as intervals. No cell has a row before the end.
    """
    offsets, by = neighbours or [-1, 1], by or []
    seqs = scans.select(F.col(scan).alias("scan"), "seq", *by)
    seqs = F.broadcast(seqs) if fits_broadcast(seqs) else seqs
    own = label_runs(echo_runs(rays, threshold, smooth_window, scan, ray), nbins, nrays).join(seqs, "scan", "inner")
    # Neighbouring scans are thresholded without smoothing.
    plain = echo_runs(rays, threshold, None, scan, ray).join(seqs, "scan", "inner")
    shifts = F.explode(F.array(*[F.lit(o) for o in offsets]))
    spans = F.transform("runs", lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last")))
    seen = plain.select(*by, "seq", "ray", spans.alias("spans"), shifts.alias("_o"))
    seen = seen.select(*by, (F.col("seq") - F.col("_o")).alias("seq"), "ray", "spans")
    mine = own.select(*by, "seq", "ray", F.struct("scan", "first", "label", "value").alias("run"))
    met = mine.unionByName(seen, allowMissingColumns=True).groupBy(*by, "seq", "ray").agg(
        F.collect_list("run").alias("_runs"), F.flatten(F.collect_list("spans")).alias("_spans")
    )
    kind = own.schema["scan"].dataType.simpleString()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, runs, counts = [], [], []
            for k in range(batch.num_rows):
                steps = np.zeros(nbins + 1, np.int64)
                spans_ = batch.column("_spans")[k].values
                np.add.at(steps, spans_.field("first").to_numpy(), 1)
                np.subtract.at(steps, spans_.field("last").to_numpy() + 1, 1)
                over = np.cumsum(steps)
                own_ = batch.column("_runs")[k].values
                sizes = np.diff(own_.field("value").offsets.to_numpy())
                for first, size in zip(own_.field("first").to_numpy().tolist(), sizes.tolist(), strict=True):
                    counts.append(over[first : first + size].astype(np.int32))
                rows += [k] * len(sizes)
                runs.append(own_)
            if not rows:
                continue
            all_runs = pa.concat_arrays(runs)
            ends = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in counts])]).astype(np.int32))
            keys = [batch.column(c).take(pa.array(rows)) for c in (*by, "seq", "ray")]
            fields = [all_runs.field(c) for c in ("scan", "first", "label", "value")]
            overlaps = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(counts)))
            most = pa.array([int(c.max()) for c in counts], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*keys, *fields, overlaps, most], [*by, "seq", "ray", "scan", "first", "label", "value", "overlaps", "most"]
            )

    schema = extended(
        met.select(*by, "seq", "ray"), f"scan {kind}, {RUN}, overlaps array<int>, most int"
    )
    counted = met.where(F.size("_runs") > 0).mapInArrow(count, schema)
    best = F.max("most").over(Window.partitionBy(*by, "seq", "label")).cast("long")
    kept = counted.withColumn("object_overlaps", best).where(F.col("object_overlaps") >= min_intersections)
    cells = kept.select(
        "scan", *by, "ray", "first", "label", "object_overlaps",
        F.posexplode(F.arrays_zip("value", "overlaps")).alias("_k", "_c"),
    )
    return cells.select(
        "scan", *by, "ray", (F.col("first") + F.col("_k")).alias("bin"), F.col("_c.value").alias("value"), "label",
        F.col("_c.overlaps").cast("long").alias("n_overlaps"), "object_overlaps",
    ).where(F.col("value") >= threshold)
