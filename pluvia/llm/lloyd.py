"""Centroid clustering by dimension-sharded Lloyd rounds, in whole numbers.

Vectors are cut into tiles of rows and blocks of columns. A task of a column block holds the
centroids' slice of its columns only and computes its share of all squared distances; shares of a
tile add up by its key, and the sum gives every vector its nearest centroid. The labels go back to
the column blocks, where each shard adds up its columns by label and updates its own slice.

The work of a task is bounded by a tile. Slices are a table of one row per block, which Spark copies
or shuffles as its size asks for; the driver sees none of the vectors. Every round is stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm.common import query, stored, table

DIMENSIONS = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
SEED = 1
BLOCK_COLUMNS = 32
TILE_ROWS = 4096
KINDS = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}

BLOCKS = "tile long, block int, n int, width int, kind int, data binary"


def _packed(values: np.ndarray) -> tuple[int, bytes]:
    """Compressed whole numbers and the bytes of each, as few as hold them all."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    kind = next(k for k, t in KINDS.items() if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return kind, pa.compress(values.astype(KINDS[kind]).tobytes(), "zstd", asbytes=True)


def _unpacked(kind: int, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, kind * n, "zstd", asbytes=True), KINDS[kind]).astype(np.int64)


def whole_vectors(rows: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: rows whose vector has ``dimensions`` finite components, as floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    unfit = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = rows.where((F.size("embedding") == dimensions) & ~unfit)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _tile_batches(dimensions: int, columns: int, rows: int):
    # Differences squared and added over all columns stay below 2 ** 63.
    limit = int(((1 << 62) // max(dimensions, 1)) ** 0.5) // 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
                if v.size and (v.min() < -limit or v.max() > limit):
                    raise ValueError(f"components beyond {limit} have no squared distance in 64 bits")
                ids = part.column("vec_id")
                out = []
                for block, first in enumerate(range(0, dimensions, columns)):
                    some = v[:, first : first + columns]
                    kind, data = _packed(some)
                    out.append((tile, block, len(v), some.shape[1], kind, data))
                # Block -1 holds the ids; a byte each says which are null.
                nulls = np.asarray(ids.is_null()).astype(np.int8).tobytes()
                keys = nulls + ids.fill_null(0).to_numpy().astype("<i8").tobytes()
                out.append((tile, -1, len(v), 0, 1, pa.compress(keys, "zstd", asbytes=True)))
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["tile", "block", "n", "width", "kind", "data"])
                tile += 1

    return run


def column_blocks(vectors: DataFrame, dimensions: int, columns: int = BLOCK_COLUMNS, rows: int = TILE_ROWS) -> DataFrame:
    """Stored tiles of ``vectors``: a row per tile and column block, and one with the ids."""
    return stored(vectors.mapInArrow(_tile_batches(dimensions, columns, rows), BLOCKS))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> DataFrame:
    """``cluster, v``: the vectors with the smallest hashes of seed and id, numbered in that order.

    Equal ids are ordered by their components; null ids come last.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    top = vectors.withColumn("h", h).orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters)
    # At most ``clusters`` rows are left.
    listed = top.agg(F.sort_array(F.collect_list(F.struct(F.col("h").isNull().alias("last"), "h", "v"))).alias("all"))
    return listed.select(F.posexplode("all").alias("cluster", "c")).select("cluster", F.col("c.v").alias("v"))


def _slices(centroids: DataFrame, dimensions: int, columns: int) -> DataFrame:
    """``block, slice``: of every block its columns of all centroids, cluster by cluster."""
    firsts = range(0, dimensions, columns)
    cut = F.array(*[F.slice("v", first + 1, columns) for first in firsts])
    parts = centroids.select("cluster", F.posexplode(cut).alias("block", "part"))
    ordered = F.sort_array(F.collect_list(F.struct("cluster", "part")))
    return parts.groupBy("block").agg(F.flatten(F.transform(ordered, lambda c: c["part"])).alias("slice"))


def _share_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every tile and block the squared distances to all centroids within the block's columns."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            x = _unpacked(r["kind"], r["data"], r["n"] * r["width"]).reshape(r["n"], r["width"])
            c = np.array(r["slice"], np.int64).reshape(-1, r["width"])
            out.append((r["tile"], r["n"], len(c), *_packed(_squared(x, c))))
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
        yield pa.RecordBatch.from_arrays(arrays, ["tile", "n", "k", "kind", "data"])


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole rows."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 52:  # doubles hold every sum exactly
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def _add_shares(key: tuple, shares: pa.Table) -> pa.Table:
    """Labels and distances of one tile from the shares of all its blocks, one share at a time."""
    total, n = None, 0
    for r in shares.to_pylist():
        n, share = r["n"], _unpacked(r["kind"], r["data"], r["n"] * r["k"]).reshape(r["n"], r["k"])
        total = share if total is None else total + share
    label = total.argmin(1)  # the first of equal ones
    far = total[np.arange(n), label]
    (kind, labels), (far_kind, distances) = _packed(label), _packed(far)
    return pa.table({
        "tile": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([n], pa.int32()),
        "label_kind": pa.array([kind], pa.int32()), "labels": pa.array([labels], pa.binary()),
        "far_kind": pa.array([far_kind], pa.int32()), "distances": pa.array([distances], pa.binary()),
    })


LABELS = "tile long, n int, label_kind int, labels binary, far_kind int, distances binary"


def assign(blocks: DataFrame, slices: DataFrame) -> DataFrame:
    """Nearest centroid and squared distance of every vector, a row per tile; equal distances go to
    the smaller number."""
    shares = blocks.where("block >= 0").join(slices, "block").mapInArrow(
        _share_batches, "tile long, n int, k int, kind int, data binary"
    )
    # A tile has one share per block, so that a group is bounded.
    return shares.groupBy("tile").applyInArrow(_add_shares, LABELS)


def _sum_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the columns and counts by block and cluster, added up over the task."""
    sums: dict[int, np.ndarray] = {}
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for r in batch.to_pylist():
            x = _unpacked(r["kind"], r["data"], r["n"] * r["width"]).reshape(r["n"], r["width"])
            label = _unpacked(r["label_kind"], r["labels"], r["n"])
            k = len(r["slice"]) // r["width"]
            block = r["block"]
            if block not in sums:
                sums[block], counts[block] = np.zeros((k, r["width"]), np.int64), np.zeros(k, np.int64)
            order = np.argsort(label, kind="stable")
            seen, first = np.unique(label[order], return_index=True)
            sums[block][seen] += np.add.reduceat(x[order], first, axis=0)
            counts[block] += np.bincount(label, minlength=k)
    rows = [(b, c, s.tolist(), int(n)) for b in sums for c, (s, n) in enumerate(zip(sums[b], counts[b], strict=True)) if n]
    columns_ = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip(columns_, types, strict=True)], ["block", "cluster", "sums", "n"]
    )


def updated(blocks: DataFrame, slices: DataFrame, labels: DataFrame, dimensions: int, columns: int) -> DataFrame:
    """Every shard's new slice: floor of sum by count, columns of an empty cluster as they were."""
    joined = blocks.where("block >= 0").join(labels.select("tile", "label_kind", "labels"), "tile").join(slices, "block")
    parts = joined.mapInArrow(_sum_batches, "block int, cluster int, sums array<long>, n long")
    cells = parts.select("block", "cluster", "n", F.posexplode("sums").alias("at", "s"))
    # Whole division rounds towards zero; the remainder says where the floor is one less.
    cells = cells.groupBy("block", "cluster", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    cells = cells.select("block", "cluster", "at", F.expr("(s - pmod(s, n)) div n").alias("mean"))
    width = F.least(F.lit(columns), F.lit(dimensions) - F.col("block") * columns)
    old = slices.select("block", F.posexplode("slice").alias("place", "old"))
    old = old.withColumn("cluster", F.floor(F.col("place") / width).cast("int")).withColumn("at", F.pmod("place", width))
    merged = old.join(cells, ["block", "cluster", "at"], "left").select("block", "place", F.coalesce("mean", "old").alias("c"))
    ordered = F.sort_array(F.collect_list(F.struct("place", "c")))
    return merged.groupBy("block").agg(F.transform(ordered, lambda c: c["c"]).alias("slice"))


def _label_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            n = r["n"]
            keys = pa.decompress(r["data"], 9 * n, "zstd", asbytes=True)
            null = np.frombuffer(keys, np.int8, n).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.frombuffer(keys, "<i8", n, n), mask=null),
                    pa.array(_unpacked(r["label_kind"], r["labels"], n).astype(np.int32)),
                    pa.array(_unpacked(r["far_kind"], r["distances"], n)),
                ],
                ["vec_id", "cluster", "distance"],
            )


def _digest(values: Column) -> Column:
    return F.sha2(F.array_join(values.cast("array<string>"), ",").cast("binary"), 256)


def cluster(
    rows: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = SEED,
    columns: int = BLOCK_COLUMNS,
    tile_rows: int = TILE_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """``vec_id, cluster, distance`` of every kept row of ``vec_id, embedding``, and the final
    centroids ``cluster, centroid``.

    Rows whose vector is null, of another length, or has a null or non-finite component are left
    out. With fewer than ``clusters`` kept vectors there are that many clusters; without any both
    tables are empty. Rows that repeat an id, or have none, count each; null ids begin a cluster only
    where there are too few others. Components too large for a 64-bit distance raise an error. Other
    columns are left out.
    """
    vectors = whole_vectors(rows, dimensions, scale)
    blocks = column_blocks(vectors, dimensions, columns, tile_rows)
    slices = stored(_slices(first_centroids(vectors, clusters, seed), dimensions, columns))
    for _ in range(rounds):
        labels = stored(assign(blocks, slices))
        slices = stored(updated(blocks, slices, labels, dimensions, columns))
    labels = stored(assign(blocks, slices))
    ids = blocks.where("block = -1").select("tile", "data")
    found = labels.join(ids, "tile").mapInArrow(_label_batches, "vec_id long, cluster int, distance long")
    width = F.least(F.lit(columns), F.lit(dimensions) - F.col("block") * columns)
    parts = slices.select("block", width.alias("width"), F.col("slice"))
    cut = F.transform(
        F.sequence(F.lit(0), (F.size("slice") / F.col("width")).cast("int") - 1),
        lambda c: F.slice("slice", c * F.col("width") + 1, F.col("width")),
    )
    by_block = parts.select("block", F.posexplode(cut).alias("cluster", "part"))
    whole = F.sort_array(F.collect_list(F.struct("block", "part")))
    centroids = by_block.groupBy("cluster").agg(F.flatten(F.transform(whole, lambda c: c["part"])).alias("centroid"))
    return found, centroids


def _oracle() -> str:
    """The rounds one after the other; ``v`` are the vectors, ``c0, c1, ...`` the centroids."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {DIMENSIONS}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {DIMENSIONS}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS cluster, v AS c FROM v
  QUALIFY cluster < {CLUSTERS}
)"""
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (
  SELECT r, vec_id, v, cluster, d FROM (
    SELECT r, vec_id, v, cluster, list_sum(list_transform(range(1, {DIMENSIONS + 1}),
      lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d FROM v, c{k})
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, cluster) = 1
)"""
        )
        if k < ROUNDS:
            steps.append(
                f"""m{k} AS MATERIALIZED (
  SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n
  FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY cluster, i
), c{k + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(mean, c) AS c FROM c{k} LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS mean FROM m{k} GROUP BY cluster) USING (cluster)
)"""
            )
    last = ROUNDS
    return (
        "WITH " + ", ".join(steps) + f"""
SELECT vec_id, cluster::INTEGER AS cluster, d AS distance,
  sum(d) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} USING (cluster)
"""
    )


@query("op13_lloyd", _oracle())
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    found = stored(found)
    # One row per cluster and one of all: both are bounded.
    of = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = found.agg(F.sum("distance").alias("inertia"))
    per_cluster = of.join(centroids.select("cluster", _digest(F.col("centroid")).alias("centroid_sha256")), "cluster")
    out = found.join(F.broadcast(per_cluster), "cluster").crossJoin(F.broadcast(whole))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
