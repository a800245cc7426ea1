"""Benchmark decontamination by q-gram lemma filtering.

An item of ``m`` characters that occurs in a text with at most ``k`` edits shares at least
``m + 1 - q (k + 1)`` q-grams with it, and these lie on at most ``k + 1`` neighbouring
diagonals. So the shared q-grams are counted in diagonal bands, ``2 (k + 1)`` wide and
overlapping by half: one band holds all that a match shares. Bands that reach the bound are
verified by banded alignment of the whole item. The bound is positive from 20 characters on with
``q = 10``, and for the shorter items that may have an edit with ``q = 8``. Items too short for
an edit are looked up as whole words by their hash, then compared.

The lemma holds for any part of an item's q-grams: of ``p`` of them a match lacks ``q k`` at most.
So q-grams that very many items share, such as those of a common preamble, are left out of the
index for every item that has enough others; this loses no match.

The items travel with the query in blocks of at most ``BLOCK_CHARS`` characters (one longer item
is a block of its own), whose index each task builds; every block is one pass over the texts, and
nothing is shuffled. Shared q-grams are counted, and bands aligned, some at a time, so a task's
memory is bounded by its block and its piece.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm.charlm import letter_stream
from pluvia.llm.common import query, stored, table
from pluvia.llm.textarrays import SortedHashes, bounded_batches, mixed, pieces, raw_bytes

#: Length of the q-grams of items of at least so many characters.
Q_OF = {20: 10, 17: 8}
EDIT_RATE = 0.06
#: Items without a letter or digit have nothing to find.
MIN_ITEM_CHARS = 1
#: Scripts written without spaces: a word may begin and end anywhere (first and last code point).
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
BLOCK_CHARS = 4_000_000
#: Items that may share a q-gram before it is left out, if enough others remain: so many, that
#: ``SPARE`` of them must be found.
COMMON = 16
SPARE = 8
#: Pairs of q-grams, and cells of an alignment, that are held together.
PAIRS_AT_ONCE = 1_000_000
CELLS_AT_ONCE = 2_000_000
MARK_BITS = 22


def folded(stream: np.ndarray) -> np.ndarray:
    """One byte per character: equal characters stay equal, so no shared q-gram is lost."""
    return (stream ^ (stream >> 7)).astype(np.uint8)


def qgram_keys(stream: np.ndarray, q: int) -> np.ndarray:
    """64-bit key of the ``q`` characters (8 to 16) from each position on."""
    n = len(stream) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = np.zeros(len(stream) + 8, np.uint8)
    raw[: len(stream)] = folded(stream)
    word = np.ndarray((len(stream),), "<u8", raw, strides=(1,))
    first = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    return first ^ mixed(word[q - 8 : q - 8 + n])


def span_keys(stream: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """64-bit key of the ``size`` characters from each start on."""
    h = np.full(len(starts), size, np.uint64)
    for k in range(size):
        h = mixed(h ^ stream[starts + k])
    return h


def unspaced(stream: np.ndarray) -> np.ndarray:
    out = np.zeros(len(stream), bool)
    if len(stream) and stream.max() >= UNSPACED[0][0]:
        for a, b in UNSPACED:
            out |= (stream >= a) & (stream <= b)
    return out


class Index:
    """Where items have their keys: ``posts`` (item << 32 | offset) in the order of the keys."""

    def __init__(self, size: int, keys: list[np.ndarray], items: list[int], lacking: list[int] | None = None):
        """``lacking``: of each item, how many of its keys a match may lack. Common keys are then left
        out where that leaves enough."""
        self.size = size  # characters of a key
        posts = [np.int64(k) << 32 | np.arange(len(x), dtype=np.int64) for k, x in zip(items, keys, strict=True)]
        self.need = None
        if lacking is not None:
            kept = _rare(keys, np.array(lacking, np.int64))
            self.need = {k: len(p) - lack for k, p, lack in zip(items, kept, lacking, strict=True)}
            keys = [x[p] for x, p in zip(keys, kept, strict=True)]
            posts = [x[p] for x, p in zip(posts, kept, strict=True)]
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        distinct, first = np.unique(flat[order], return_index=True)
        self.keys = SortedHashes(distinct)
        self.first = np.append(first, len(flat))  # of each key, its place in ``posts``
        self.posts = np.concatenate(posts)[order]
        self.marks = np.zeros(1 << MARK_BITS, bool)  # by leading bits of a key: may be in the index
        self.marks[flat >> np.uint64(64 - MARK_BITS)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys that the index holds, and their places in it."""
        spots = np.flatnonzero(self.marks[keys >> np.uint64(64 - MARK_BITS)])
        place = self.keys.find(keys[spots])
        return spots[place >= 0], place[place >= 0]

    def posts_of(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All posts of the keys at ``place``, and which of them each belongs to."""
        n = self.first[place + 1] - self.first[place]
        each = np.repeat(np.arange(len(place)), n)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        return self.posts[self.first[place[each]] + nth], each


def _rare(keys: list[np.ndarray], lacking: np.ndarray) -> list[np.ndarray]:
    """Places of the keys to keep of each item: the rarest, all that at most ``COMMON`` items share and
    at least so many that a match has ``SPARE`` of them (or all)."""
    distinct, at = np.unique(np.concatenate([np.unique(x) for x in keys]), return_inverse=True)
    shared = np.bincount(at)
    out = []
    for x, lack in zip(keys, lacking.tolist(), strict=True):
        count = shared[np.searchsorted(distinct, x)]
        order = np.argsort(count, kind="stable")
        n = max(int((count <= COMMON).sum()), min(len(x), lack + SPARE))
        out.append(np.sort(order[:n]))
    return out


@dataclass
class Block:
    """Items of a block, the indexes of their q-grams and those of the short items by length."""

    ids: np.ndarray
    text: np.ndarray  # characters of all items
    offs: np.ndarray
    qgrams: list[Index]
    short: list[Index]

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offs)


def edits_allowed(m: np.ndarray) -> np.ndarray:
    return (EDIT_RATE * m).astype(np.int64)


def make_block(ids: list[int], texts: list[str]) -> Block:
    data, offs = raw_bytes(pa.array(texts, pa.string()))
    stream, at, _ = letter_stream(data, offs, 0, digits=True)
    # The space that ends each row is no part of the item.
    parts = [stream[a : b - 1] for a, b in zip(at[:-1], at[1:], strict=True)]
    parts = [p[:-1] if len(p) and p[-1] == 0x20 else p for p in parts]
    parts = [p[1:] if len(p) and p[0] == 0x20 else p for p in parts]
    kept = [k for k, p in enumerate(parts) if len(p) >= MIN_ITEM_CHARS]
    parts = [parts[k] for k in kept]
    groups: dict[tuple[bool, int], list[int]] = {}
    for k, p in enumerate(parts):
        q = next((q for least, q in Q_OF.items() if len(p) >= least), 0)
        groups.setdefault((q > 0, q or len(p)), []).append(k)
    qgrams, short = [], []
    for (long, size), items in sorted(groups.items()):
        if long:
            lacking = [size * int(edits_allowed(np.array(len(parts[k])))) for k in items]
            qgrams.append(Index(size, [mixed(qgram_keys(parts[k], size)) for k in items], items, lacking))
        else:
            short.append(Index(size, [span_keys(parts[k], np.zeros(1, np.int64), size) for k in items], items))
    return Block(
        np.array([ids[k] for k in kept], np.int64), np.concatenate([np.zeros(0, np.uint32), *parts]),
        np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), qgrams, short,
    )


def _whole_words(stream: np.ndarray, at: np.ndarray, block: Block) -> np.ndarray:
    """Rows ``row, item`` of the short items that stand in a row as whole words."""
    found = [np.zeros((0, 2), np.int64)]
    free = unspaced(stream)
    gap = stream == 0x20
    # Between the character before and this one a word may begin or end.
    edge = np.ones(len(stream) + 1, bool)
    edge[1:-1] = gap[:-1] | gap[1:] | free[:-1] | free[1:]
    edge[at] = True
    begin = np.flatnonzero(edge[:-1] & ~gap)
    row = np.searchsorted(at, begin, "right") - 1
    for index in block.short:
        m = index.size
        fits = np.flatnonzero(begin + m <= at[row + 1])
        fits = fits[edge[begin[fits] + m]]
        spots, place = index.find(span_keys(stream, begin[fits], m))
        posts, each = index.posts_of(place)
        item, where = posts >> 32, fits[spots[each]]
        lanes = np.arange(m)
        same = (stream[begin[where][:, None] + lanes] == block.text[block.offs[item][:, None] + lanes]).all(1)
        found.append(np.unique(np.stack([row[where], item], 1)[same], axis=0))
    return np.concatenate(found)


def _bands(stream: np.ndarray, at: np.ndarray, block: Block, index: Index) -> np.ndarray:
    """Rows ``row, item, band`` whose shared q-grams reach the bound."""
    q = index.size
    spots, place = index.find(mixed(qgram_keys(stream, q)))
    row = np.searchsorted(at, spots, "right") - 1
    whole = spots + q <= at[row + 1]
    spots, place, row = spots[whole], place[whole], row[whole]
    if not len(spots):
        return np.zeros((0, 3), np.int64)
    upto = np.cumsum(index.first[place + 1] - index.first[place])
    cuts = np.searchsorted(upto, np.arange(1, int(upto[-1]) // PAIRS_AT_ONCE + 1) * PAIRS_AT_ONCE)
    held: tuple[np.ndarray, np.ndarray] = (np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
    for some in np.split(np.arange(len(spots)), cuts):
        post, each = index.posts_of(place[some])
        item, of = post >> 32, some[each]
        k = edits_allowed(block.sizes[item])
        # Diagonals are counted from one item length before the row.
        diagonal = spots[of] - at[row[of]] - (post & 0xFFFFFFFF) + block.sizes[item]
        band = diagonal // (k + 1)
        triples = np.stack([np.tile(row[of], 2), np.tile(item, 2), np.concatenate([band, band - 1])], 1)
        held = _counted(np.concatenate([held[0], triples]), np.concatenate([held[1], np.ones(len(triples), np.int64)]))
    found, count = held
    need = np.array([index.need[i] for i in found[:, 1].tolist()], np.int64)
    return found[count >= np.maximum(1, need)]


def _counted(triples: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct triples with the sums of their counts."""
    if not len(triples):
        return triples, count
    order = np.lexsort(triples.T[::-1])
    triples, count = triples[order], count[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(triples, axis=0) != 0).any(1)]))
    return triples[new], np.add.reduceat(count, new)


def banded_edits(stream: np.ndarray, at: np.ndarray, block: Block, bands: np.ndarray) -> np.ndarray:
    """Fewest edits between each band's item and any part of its row, within the band.

    All bands advance together, one item character per step; a row of the table holds the
    band's diagonals with as many more on either side as edits are allowed.
    """
    row, item, band = bands.T
    m = block.sizes[item]
    k = edits_allowed(m)
    width = int(4 * k.max() + 4)
    # Text position, in the row, of the first diagonal for the item's first character.
    begin = band * (k + 1) - m - k
    lanes = np.arange(width)
    low, high = at[row], at[row + 1]
    # Entry d after i characters: fewest edits that end before text position begin + i + d.
    table_ = np.zeros((len(bands), width), np.int32)
    best = np.full(len(bands), 1 << 20, np.int32)
    live = np.arange(len(bands))
    for i in range(int(m.max())):
        if i % 16 == 0:
            # Edits only grow: bands whose best cell has too many are done for.
            live = live[table_[live].min(1) <= k[live]]
        live = live[i < m[live]]
        if not len(live):
            break
        where = (begin[live] + i)[:, None] + lanes + low[live][:, None]
        inside = (where >= low[live][:, None]) & (where < high[live][:, None])
        char = stream[np.clip(where, 0, len(stream) - 1)]
        same = inside & (char == block.text[block.offs[item[live]] + i][:, None])
        old = table_[live]
        new = old + ~same
        new[:, :-1] = np.minimum(new[:, :-1], old[:, 1:] + 1)
        new = np.minimum.accumulate(new - lanes, axis=1) + lanes
        table_[live] = new
        done = live[m[live] == i + 1]
        best[done] = table_[done].min(1)
    return best


def find_items(data: np.ndarray, offs: np.ndarray, block: Block) -> list[tuple[int, int, int]]:
    """``(row, item id, edits)`` of every item that occurs in a row within its edit budget."""
    if not len(block.ids):
        return []
    stream, at, _ = letter_stream(data, offs, 0, digits=True)
    out: dict[tuple[int, int], int] = {}
    if block.short:
        for row, item in _whole_words(stream, at, block).tolist():
            out[row, int(block.ids[item])] = 0
    bands = np.concatenate([np.zeros((0, 3), np.int64), *[_bands(stream, at, block, x) for x in block.qgrams]])
    # Bands of items of like size together, so many that their cells stay few. A row that is shorter than
    # an item less its edits has no match.
    m = block.sizes[bands[:, 1]]
    bands = bands[np.diff(at)[bands[:, 0]] >= m - edits_allowed(m)]
    bands = bands[np.argsort(block.sizes[bands[:, 1]], kind="stable")]
    width = 4 * edits_allowed(block.sizes[bands[:, 1]]) + 4
    part = 0
    while part < len(bands):
        # Widths grow, so the last band of a part bounds all of it.
        upto = part + 1
        while upto < len(bands) and (upto + 1 - part) * width[upto] <= CELLS_AT_ONCE:
            upto += 1
        some = bands[part:upto]
        part = upto
        edits = banded_edits(stream, at, block, some)
        fit = edits <= edits_allowed(block.sizes[some[:, 1]])
        for (row, item, _), e in zip(some[fit].tolist(), edits[fit].tolist(), strict=True):
            key = (row, int(block.ids[item]))
            out[key] = min(e, out.get(key, e))
    return [(r, i, e) for (r, i), e in sorted(out.items())]


def benchmark_blocks(benchmark: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of the benchmark block by block, one on the driver at a time; items without an id
    or text are left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = F.length("text").cast("long") + 1
    total = items.agg(F.sum(size)).first()[0] or 0
    n = -(-total // limit)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        rows.sort()
        yield [r.item_id for r in rows], [r.text for r in rows]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, edits``: every item that a row of ``docs`` holds, the fewest edits.

    Case, punctuation and white space do not count. An item counts where all of it occurs, within
    its edits; items of up to 16 characters, which have none, only as whole words. Null and empty texts hold nothing; repeated
    rows are reported each. Without items, or on an empty table, the result is empty. Other
    columns are left out.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, edits int"

    def finder(ids: list[int], texts: list[str]):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = make_block(ids, texts)
            for part, data, offs in pieces(batches):
                found = find_items(data, offs, block)
                where, items, edits = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(where, pa.int64())), pa.array(items, pa.int64()),
                     pa.array(edits, pa.int32())], ["doc_id", "item_id", "edits"],
                )

        return run

    out = docs.sparkSession.createDataFrame([], schema)
    for ids, texts in benchmark_blocks(benchmark):
        out = out.union(rows.mapInArrow(finder(ids, texts), schema))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    bounded_batches(docs.sparkSession)
    fields = docs.columns
    # The rows travel under positions, so that no column of theirs can clash.
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(fields)])
    text = f"c{fields.index('text')}"

    def cleaner(ids: list[int], texts: list[str]):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = make_block(ids, texts)
            for part, data, offs in pieces(batches, text):
                clean = np.ones(part.num_rows, bool)
                clean[[row for row, _, _ in find_items(data, offs, block)]] = False
                yield part.filter(pa.array(clean))

        return run

    for nth, (ids, texts) in enumerate(benchmark_blocks(benchmark)):
        # A pass ends before the next block begins: a task holds one index.
        inner = (stored(inner) if nth else inner).mapInArrow(cleaner(ids, texts), inner.schema)
    return inner.toDF(*fields)


@query("op3_decontaminate")
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
