"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are computed text by text. Distinct fingerprints, ordered by their population
counts, are cut into tiles of at most ``TILE`` values. Two fingerprints within the radius have
population counts that differ by no more than the radius, so only tile pairs whose ranges of
counts come that near are made: an equi-join of tile numbers on the population count, without
their contents. A pair is one task's exact comparison by exclusive-or and bit counts; inside
it blocks are skipped by the counts of their quarters, whose differences add up to a lower
bound of the distance. A pair returns what its links connect, each member with the first of its
group, so a large group of near copies costs as many rows as it has members, not pairs.

Links join into components by rounds of large-star and small-star steps, each stored.
Copies meet as one fingerprint, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm.common import query, stored, table
from pluvia.llm.textarrays import LOWER, SPACE, bounded_batches, pieces, raw_bytes, word_spans

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
TILE = 16_384
BLOCK = 128
QUARTERS = (0xFFFF, 0xFFFF << 16, 0xFFFF << 32, 0xFFFF << 48)


def shingle_hashes(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all ``k``-word shingles of a piece, and the offsets of the rows among them."""
    data = LOWER[data]
    starts, ends, at = word_spans(data, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    # The words of the piece, one space between them.
    sizes = ends - starts
    new = np.concatenate([[0], np.cumsum(sizes + 1)])
    joined = np.full(new[-1], 0x20, np.uint8)
    inside = np.ones(new[-1], bool)
    inside[new[1:] - 1] = False
    joined[inside] = data[~SPACE[data]]
    counts = np.diff(at)
    shingles = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), shingles)
    out_offs = np.concatenate([[0], np.cumsum(shingles)])
    first = at[row] + np.arange(len(row)) - out_offs[row]
    last = np.minimum(first + k, at[row + 1]) - 1
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    spans = zip(new[first].tolist(), (new[last + 1] - 1).tolist(), strict=True)
    return np.fromiter((digest(text[a:b], SEED) for a, b in spans), np.uint64, len(first)), out_offs


def fingerprints_of(hashes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One bit per position that over half of a row's hashes have; zero for a row without any."""
    out = np.zeros(len(offs) - 1, np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        sums = np.add.reduceat(bits, offs[:-1][full], axis=0, dtype=np.int32)
        most = 2 * sums > np.diff(offs)[full][:, None]
        out[full] = np.packbits(most, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _fingerprint_batches(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in pieces(batches):
            f = fingerprints_of(*shingle_hashes(data, offs, k))
            names = rows.schema.names[:-1]  # all but the text
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in names), pa.array(f.view(np.int64))], [*names, "f"]
            )

    return run


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, key: str | None = None) -> DataFrame:
    """``doc_id, f``: the fingerprint as a signed 64-bit number; null texts are empty. With ``key`` the
    long column of that name stands between them, as ``key``."""
    bounded_batches(docs.sparkSession)
    keys = [] if key is None else [F.col(f"`{key}`").cast("long").alias("key")]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *keys, F.col("text").cast("string").alias("text")
    )
    schema = "doc_id long, f long" if key is None else "doc_id long, key long, f long"
    return rows.mapInArrow(_fingerprint_batches(shingle_words), schema)


def _quarter_counts(f: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(f & np.uint64(m)) for m in QUARTERS], 1).astype(np.int16)


def _tile_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per tile of a sorted partition: number, range of population counts, contents."""
    part, nth, held = TaskContext.get().partitionId(), 0, np.zeros(0, np.int64)

    def row(f: np.ndarray) -> pa.RecordBatch:
        counts = np.bitwise_count(f.view(np.uint64))
        return pa.RecordBatch.from_pylist(
            [{"tile": (part << 32) + nth, "low": int(counts.min()), "high": int(counts.max()), "fs": f.tobytes()}],
            schema=pa.schema([("tile", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("fs", pa.binary())]),
        )

    for batch in batches:
        held = np.concatenate([held, batch.column("f").to_numpy(zero_copy_only=False)])
        while len(held) >= TILE:
            yield row(held[:TILE])
            held, nth = held[TILE:], nth + 1
    if len(held):
        yield row(held)


def tiles(distinct: DataFrame, n: int) -> DataFrame:
    """Tiles of distinct fingerprints ``f``, ordered by population counts over ``n`` partitions."""
    part = lambda mask: F.bit_count(F.col("f").bitwiseAND(F.lit(mask)))
    keyed = distinct.select(
        "f", F.bit_count("f").alias("pc"), part(0xFFFFFFFF).alias("half"), part(0xFFFF).alias("q0"),
        part(0xFFFF << 32).alias("q2"),
    )
    order = ["pc", "half", "q0", "q2", "f"]
    ranged = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("f")
    return ranged.mapInArrow(_tile_batches, "tile long, low int, high int, fs binary")


def merge_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (smallest place of each group) after joining the groups of all places ``i``, ``j``."""
    a, b = labels[i], labels[j]
    apart = a != b
    if not apart.any():
        return labels
    pairs = np.unique(np.stack([np.maximum(a, b)[apart], np.minimum(a, b)[apart]], 1), axis=0)
    up = {int(x): int(x) for x in np.unique(pairs)}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in pairs.tolist():
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    to = np.arange(len(labels))
    to[list(up)] = [root(x) for x in up]
    return to[labels]


def near_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """What the links between two tiles (or inside one) connect: each value with the first of its
    group, for groups of two or more."""
    qa, qb = _quarter_counts(a), _quarter_counts(b)
    sa, sb = np.arange(0, len(a), BLOCK), np.arange(0, len(b), BLOCK)
    low_a, high_a = np.minimum.reduceat(qa, sa), np.maximum.reduceat(qa, sa)
    low_b, high_b = np.minimum.reduceat(qb, sb), np.maximum.reduceat(qb, sb)
    both, shift = (a, 0) if same else (np.concatenate([a, b]), len(a))
    labels = np.arange(len(both))
    for k, x in enumerate(sa):
        gap = np.maximum(low_a[k] - high_b, low_b - high_a[k])
        near = np.flatnonzero(np.maximum(gap, 0).sum(1) <= radius)
        left = a[x : x + BLOCK, None]
        if same:
            near = near[near >= k]
        # Blocks that lie side by side are compared together, four at a time.
        for run in np.split(near, np.flatnonzero(np.diff(near) != 1) + 1) if len(near) else ():
            for m in range(0, len(run), 4):
                y0, y1 = run[m] * BLOCK, (run[min(m + 3, len(run) - 1)] + 1) * BLOCK
                hits = np.flatnonzero(np.bitwise_count(left ^ b[None, y0:y1]) <= radius)
                if len(hits):
                    width = min(y1, len(b)) - y0
                    labels = merge_labels(labels, hits // width + x, hits % width + y0 + shift)
    member = np.flatnonzero(labels != np.arange(len(both)))
    return both[member], both[labels[member]]


def _link_batches(radius: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = batch.column("same").to_pylist()
            parts = [raw_bytes(batch.column(c)) for c in ("fa", "fb")]
            for k in range(batch.num_rows):
                a, b = (
                    np.frombuffer(data[offs[k] : offs[k + 1]].tobytes(), np.uint64) for data, offs in parts
                )
                u, v = near_links(a, b, radius, same[k])
                if len(u):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"]
                    )

    return run


def fingerprint_links(distinct: DataFrame, radius: int, n: int) -> DataFrame:
    """Links ``u, v`` between distinct fingerprints that connect all that lie within ``radius``."""
    bounded_batches(distinct.sparkSession)
    tiled = stored(tiles(distinct, n))
    box = tiled.select("tile", "low", "high")
    left = box.select(
        F.col("tile").alias("ta"), F.explode(F.sequence(F.col("low"), F.col("high") + radius)).alias("p")
    )
    right = box.select(F.col("tile").alias("tb"), F.col("low").alias("p"))
    # Tiles are in order of their counts, so the later tile of a pair begins where p stands.
    pairs = left.join(right, "p").where("ta <= tb").drop("p")
    contents = pairs.join(tiled.select(F.col("tile").alias("ta"), F.col("fs").alias("fa")), "ta").join(
        tiled.select(F.col("tile").alias("tb"), F.col("fs").alias("fb")), "tb"
    )
    dealt = contents.select((F.col("ta") == F.col("tb")).alias("same"), "fa", "fb", "ta", "tb")
    dealt = dealt.repartition(4 * n, F.xxhash64("ta", "tb")).drop("ta", "tb")
    return dealt.mapInArrow(_link_batches(radius), "u long, v long")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for all nodes of ``links`` (u, v): root is the smallest node reachable.

    Each round hangs every node's larger neighbours on its smallest one (large star), then its
    smaller neighbours likewise (small star). Paths shorten by half in a round, and the rows
    never outnumber the links. Rounds end when one changes nothing.
    """
    edges = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = low.select("u", F.col("m").alias("v"))
        edges = stored(small.union(own).where("u <> v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _partitions(spark: SparkSession, partitions: int | None) -> int:
    return partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def roots(marked: DataFrame, max_bits: int, n: int) -> DataFrame:
    """``f, least, root``: of every fingerprint its smallest id and the fingerprint of its component."""
    smallest = stored(marked.groupBy("f").agg(F.min("doc_id").alias("least")))
    joined = stored(components(stored(fingerprint_links(smallest.select("f"), max_bits, n))))
    return smallest.join(joined, smallest["f"] == joined["node"], "left").select(
        "f", "least", F.coalesce("root", "f").alias("root")
    )


def near_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, partitions: int | None = None
) -> DataFrame:
    """``doc_id, f, component_id``: one row per row of ``docs``.

    ``component_id`` is the smallest id among the rows that a chain of links of at most
    ``max_bits`` bits reaches. Null and empty texts have fingerprint zero and link like any
    other. Repeated ids keep their rows; a null id is larger than all others and is the
    component only of rows that are linked to null ids alone. An empty table gives an empty
    result; other columns are left out.
    """
    n = _partitions(docs.sparkSession, partitions)
    marked = stored(fingerprints(docs, shingle_words))
    known = roots(marked, max_bits, n)
    lowest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    by_value = stored(known.join(lowest, "root").select("f", "component_id"))
    # Equal fingerprints of many copies: Spark splits such a key, as the other side has it once.
    return marked.join(by_value, "f").select("doc_id", "f", "component_id")


def hexadecimal(f: Column) -> Column:
    return F.lower(F.lpad(F.hex(f), 16, "0"))


def keep_first(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` of each component, with all its columns: that with the smallest id, null ids
    last, and of rows that repeat the id the first stored one.

    Rows are numbered when they are stored, so neither repeated nor missing ids matter.
    """
    key = next(name for k in range(len(docs.columns) + 1) if (name := f"_row{k}") not in docs.columns)
    rows = stored(docs.withColumn(key, F.monotonically_increasing_id()))
    marked = stored(fingerprints(rows, shingle_words, key))
    known = stored(roots(marked, max_bits, _partitions(docs.sparkSession, None)))
    placed = marked.join(known.select("f", "root"), "f")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    # The least row of a component: partial minima, so a large component is no hot key.
    first = placed.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.key").alias("key"))
    gone = stored(marked.select("key").join(first, "key", "left_anti").select(F.col("key").alias("_gone")))
    return rows.join(gone, rows[key] == gone["_gone"], "left_anti").drop(key)


@query("op5_simhash")
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal(F.col("f")).alias("fingerprint"), "component_id")
