"""Removal of repeated 100-byte strings, by prefix-free parsing.

A rolling hash over the text sets triggers: the smallest hash within reach. Each 100-byte
window belongs to the first such trigger inside it, so equal windows have it at the same place,
and the windows of one trigger are a phrase: a run of neighbouring starts. The phrases are the
dictionary, their sequence is the parse. Copied text repeats whole phrases, and a phrase that
occurred before is removed as a whole, without looking at its windows. Only where phrases share
their trigger's context but not all their bytes (the edges of copied passages) must their
windows be told apart; they are put in order with all windows of such phrases, as a suffix array
restricted to 100 bytes would have them, and all but the first of equals are removed.

Phrases meet by the hash of their trigger's context. Before that each task compares the phrases
of some pieces and drops those it has seen, so no context has more rows than there are such
pieces, however often a line occurs. Phrases that must be told apart are cut into sub-phrases of
nine windows around a common core of 92 bytes: they meet by the hash of the core, and the eight
bytes on either side tell their windows apart, byte by byte. Cores with more than ``HOT_ROWS``
rows go on as single windows, spread by hashes of their own. Hashes have 64 bits, phrases must
agree in two.

The table must be one that reads the same way twice (a stored table), as rows are numbered by
their place in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm.common import query, stored, table
from pluvia.llm.textarrays import bounded_batches, mixed, pieces, span_hasher

WINDOW = 100
#: Bytes after a trigger by which phrases meet; the trigger lies in the rest of the window.
CONTEXT = 32
#: Bytes of a task's input whose phrases are compared before they are passed on.
HELD_BYTES = 24_000_000
#: Windows of a sub-phrase; the bytes beside its core fit one 64-bit word.
LANES = 9
CORE = WINDOW - LANES + 1
HOT_ROWS = 2000
PHRASE, SUB, REMOVED, ASKED = range(4)
NULL_ID = np.iinfo(np.int64).max


def triggers(data: np.ndarray) -> np.ndarray:
    """For every window start, the place of the smallest 8-byte hash within reach (the first of
    equals). The last entries have no whole window."""
    n = len(data)
    reach = WINDOW - CONTEXT + 1
    if n < WINDOW:
        return np.zeros(0, np.int64)
    grams = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    rank = mixed(grams) & np.uint64(0xFFFFFFFF00000000) | np.arange(n - 7, dtype=np.uint64)
    step = 1
    while 2 * step <= reach:
        rank = np.minimum(rank[:-step], rank[step:])
        step *= 2
    rest = reach - step
    rank = np.minimum(rank[: len(rank) - rest], rank[rest:])
    return (rank[: n - WINDOW + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def phrases(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, trigger, first and last window start of every phrase of a piece."""
    at = triggers(data)
    whole = np.zeros(len(at) + 1, bool)
    sizes = np.diff(offs)
    valid = np.repeat(offs[1:] - WINDOW, sizes)[: len(at)] >= np.arange(len(at))
    whole[:-1] = valid
    starts = np.flatnonzero(valid)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) != 1) | (np.diff(at[starts]) != 0)
    # Neighbouring starts of two rows belong to different phrases.
    row = np.searchsorted(offs, starts, "right") - 1
    new[1:] |= np.diff(row) != 0
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return row[first], at[starts[first]], starts[first], starts[last]


def sub_phrases(data: np.ndarray, hashes, trigger, first, last) -> tuple[np.ndarray, ...]:
    """Cuts phrases into sub-phrases: which phrase, hash of the core, bytes left and right of it
    that its windows use, first start, number of windows, left bytes of the first window."""
    high, low = (trigger - first) // LANES, (trigger - last) // LANES
    n = high - low + 1
    which = np.repeat(np.arange(len(first)), n)
    bucket = high[which] - (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n))
    core = trigger[which] - bucket * LANES
    start = np.maximum(first[which], core - LANES + 1)
    size = np.minimum(last[which], core) - start + 1
    lead = core - start
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    word = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    # The byte next to the core is the highest of the left word and the lowest of the right one.
    left = _top(word[core], lead) << (np.uint64(8) * (np.uint64(8) - lead.astype(np.uint64)) & np.uint64(63))
    right = _bottom(word[core + CORE + 8], LANES - 1 - (lead - size + 1))
    return which, hashes(core, core + CORE), np.where(lead > 0, left, np.uint64(0)), right, start, size, lead


def _top(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ``n`` highest bytes (0 to 8) of each word."""
    n = n.astype(np.uint64)
    return np.where(n > 0, word >> ((np.uint64(64) - np.uint64(8) * n) & np.uint64(63)), np.uint64(0))


def _bottom(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ``n`` lowest bytes (0 to 8) of each word."""
    n = n.astype(np.uint64)
    mask = (np.uint64(1) << (np.uint64(8) * n & np.uint64(63))) - np.uint64(1)
    return np.where(n < 8, word & mask, word)


FIELDS = ["kind", "part", "k", "x", "y", "doc", "row", "start", "n", "aux"]
SCHEMA = "kind int, part long, k long, x long, y long, doc long, row long, start long, n int, aux int"
_NUMBERS = [pa.int32(), *[pa.int64()] * 7, pa.int32(), pa.int32()]


def _batch(kind: int, k, x, y, doc, row, start, n, aux) -> pa.RecordBatch:
    """Phrases are dealt by their context, everything else by row."""
    part = k if kind == PHRASE else row
    arrays = [np.full(len(k), kind), part, k, x, y, doc, row, start, n, aux]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(a).astype(t.to_pandas_dtype())) for a, t in zip(arrays, _NUMBERS, strict=True)], FIELDS
    )


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _groups(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys begins."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def _parse_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases, sub-phrases and removals of a partition, some pieces at a time."""
    held: list = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        k, x, doc, row, start, n = cols = [np.concatenate([h[0][c] for h in held]) for c in range(6)]
        order = np.lexsort((start, row, doc, x, k))
        key = _groups(k[order])
        string = key | _groups(x[order])
        group = np.cumsum(key) - 1
        kinds = np.bincount(group, string)[group] if len(k) else string
        none = np.zeros(len(k), np.int64)

        def rows(kind: int, which: np.ndarray, aux: int = 0) -> pa.RecordBatch:
            k, x, doc, row, start, n = (c[which] for c in cols)
            return _batch(kind, k, x, none[which], doc, row, start, n, np.full(len(k), aux))

        yield rows(REMOVED, order[~string])
        yield rows(PHRASE, order[string & (kinds == 1)])
        # One row tells other tasks that this context has several phrases.
        yield rows(PHRASE, order[key & (kinds > 1)], 1)
        several = np.zeros(len(k), bool)
        several[order[string & (kinds > 1)]] = True
        begin, subs = 0, []
        for (_, _, d, r, s, m), data, trigger, base in held:
            some = np.flatnonzero(several[begin : begin + len(d)])
            hashes = span_hasher(data)
            begin += len(d)
            first = s[some] + base[some]
            which, core, left, right, at, number, lead = sub_phrases(data, hashes, trigger[some], first, first + m[some] - 1)
            own = some[which]
            subs.append((_signed(core), _signed(left), _signed(right), d[own], r[own], at - base[own], number, lead))
        yield from _unrepeated([np.concatenate(c) for c in zip(*subs, strict=True)])

    for rows, data, offs in pieces(batches):
        where, trigger, first, last = phrases(data, offs)
        hashes = span_hasher(data)
        doc = rows.column("doc_id").fill_null(NULL_ID).to_numpy()[where]
        row = rows.column("row").to_numpy()[where]
        k = _signed(hashes(trigger, trigger + CONTEXT))
        x = _signed(hashes(first, last + WINDOW))
        del hashes
        held.append(((k, x, doc, row, first - offs[where], last - first + 1), data, trigger, offs[where]))
        size += len(data)
        if size >= HELD_BYTES:
            yield from flush()
            held.clear()
            size = 0
    if held:
        yield from flush()


def _unrepeated(subs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sub-phrases, each once; those that came before are removed as a whole."""
    k, x, y, doc, row, start, n, lead = subs
    order = np.lexsort((start, row, doc, lead, n, y, x, k))
    first = _groups(*(a[order] for a in (k, x, y, n, lead)))
    for kind, which in ((REMOVED, order[~first]), (SUB, order[first])):
        yield _batch(kind, *(a[which] for a in subs))


def _whole_groups(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut so that the rows of one key stay together."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = cols if held is None else [np.concatenate(pair) for pair in zip(held, cols, strict=True)]
        key = held[batch.schema.names.index(column)]
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield [c[:cut] for c in held]
            held = [c[cut:] for c in held]
    if held is not None:
        yield held


def _resolve_phrases(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases by context: removes repeats, asks for the first of each that has a rival. Other
    rows pass."""

    def split() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            other = np.asarray(batch.column("kind")) != PHRASE
            if other.any():
                passed.append(batch.filter(pa.array(other)))
            yield batch.filter(pa.array(~other))

    passed: list[pa.RecordBatch] = []
    for kind, _, k, x, y, doc, row, start, n, odd in _whole_groups(split(), "k"):
        yield from passed
        passed.clear()
        order = np.lexsort((start, row, doc, odd, x, k))
        key = _groups(k[order])
        string = key | _groups(x[order])
        group = np.cumsum(key) - 1
        rivals = np.bincount(group, string | (odd[order] > 0))[group] > 1
        rivals |= np.bincount(group, odd[order] > 0)[group] > 0
        real = odd[order] == 0
        # Rows that only flag a context stand last among equals; they are no occurrence here.
        cols = (k, x, y, doc, row, start, n, odd)
        for to, which in ((REMOVED, order[real & ~string]), (ASKED, order[real & string & rivals])):
            yield _batch(to, *(c[which] for c in cols))
    yield from passed


def _asked_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sub-phrases of the phrases asked for: ``starts`` holds start and length of each."""
    for rows, data, offs in pieces(batches):
        packed = rows.column("starts")
        n = np.asarray(packed.value_lengths())
        value = np.asarray(packed.flatten())
        owner = np.repeat(np.arange(rows.num_rows), n)
        first = (value >> 24) + offs[owner]
        last = first + (value & 0xFFFFFF) - 1
        doc = rows.column("doc_id").fill_null(NULL_ID).to_numpy()
        row = rows.column("row").to_numpy()
        trigger = triggers(data)[first]
        which, core, left, right, at, number, lead = sub_phrases(data, span_hasher(data), trigger, first, last)
        own = owner[which]
        yield _batch(SUB, _signed(core), _signed(left), _signed(right), doc[own], row[own], at - offs[own], number, lead)


def _lane(x: np.ndarray, y: np.ndarray, left: int) -> tuple[np.ndarray, np.ndarray]:
    """What tells the windows with ``left`` bytes before the core apart."""
    return (
        _top(x.view(np.uint64), np.full(len(x), left)),
        _bottom(y.view(np.uint64), np.full(len(y), LANES - 1 - left)),
    )


def _resolve_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sub-phrases by core: of equal windows all but the first are removed."""
    for k, x, y, doc, row, start, n, lead in _whole_groups(batches, "k"):
        for left in range(LANES):
            has = np.flatnonzero((lead >= left) & (lead - n < left))
            a, b = _lane(x[has], y[has], left)
            at = start[has] + lead[has] - left
            order = np.lexsort((at, row[has], doc[has], b, a, k[has]))
            again = order[~_groups(k[has][order], a[order], b[order])]
            which = has[again]
            none = np.zeros(len(which), np.int64)
            yield _batch(REMOVED, none, none, none, doc[which], row[which], at[again], none + 1, none)


def _window_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single windows of sub-phrases, each as the core of its own with nothing beside it."""
    for batch in batches:
        k, x, y, doc, row, start, n, lead = (c.to_numpy() for c in batch.columns)
        for left in range(LANES):
            has = np.flatnonzero((lead >= left) & (lead - n < left))
            a, b = _lane(x[has], y[has], left)
            own = mixed(mixed(mixed(k[has].view(np.uint64)) + a) * np.uint64(3) + b + np.uint64(left))
            none = np.zeros(len(has), np.int64)
            # The lane stays in the bytes beside the core, so equal rows are equal windows.
            yield _batch(
                SUB, _signed(own), _signed(a), _signed(b), doc[has], row[has], start[has] + lead[has] - left, none + 1,
                none + left,
            ).select(["k", "x", "y", "doc", "row", "start", "n", "aux"])


def numbered(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text``; rows are numbered by their place in the table."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )


def _by_row(found: DataFrame) -> DataFrame:
    """``row, starts``: all starts of a row, each with its length in the lowest 24 bits."""
    one = F.shiftleft("start", 24) + F.col("n")
    return found.groupBy("row").agg(F.collect_list(one).alias("starts"))


def repeated_starts(rows: DataFrame) -> DataFrame:
    """``row, start, n``: runs of window starts whose string starts earlier too."""
    sub = "k long, x long, y long, doc long, row long, start long, n int, aux int"
    parsed = rows.mapInArrow(_parse_batches, SCHEMA)
    dealt = parsed.repartition("part").sortWithinPartitions("kind", "k")
    once = stored(dealt.mapInArrow(_resolve_phrases, SCHEMA))
    removed = once.where(F.col("kind") == REMOVED).select("row", "start", "n")
    asked = rows.join(_by_row(once.where(F.col("kind") == ASKED)), "row").select("row", "doc_id", "text", "starts")
    fields = ["k", "x", "y", "doc", "row", "start", "n", "aux"]
    subs = stored(
        once.where(F.col("kind") == SUB).select(*fields).union(asked.mapInArrow(_asked_batches, SCHEMA).select(*fields))
    )
    hot = stored(subs.groupBy("k").count().where(F.col("count") > HOT_ROWS).select("k"))
    cold = subs.join(hot, "k", "left_anti").select(*fields)
    single = subs.join(hot, "k", "left_semi").select(*fields).mapInArrow(_window_batches, sub)
    last = cold.union(single).repartition("k").sortWithinPartitions("k").mapInArrow(_resolve_windows, SCHEMA)
    return removed.union(last.select("row", "start", "n"))


def _digest_batches(with_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in pieces(batches):
            packed = rows.column("starts")
            value = np.asarray(packed.flatten())
            owner = np.repeat(np.arange(rows.num_rows), np.asarray(packed.value_lengths().fill_null(0)))
            first = (value >> 24) + offs[owner]
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + (value & 0xFFFFFF) + WINDOW - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            begins[offs[:-1][np.diff(offs) > 0]] = gone[offs[:-1][np.diff(offs) > 0]]
            total = lambda a: np.diff(np.concatenate([[0], np.cumsum(a)])[offs])
            kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
            out = [rows.column("doc_id"), np.diff(offs), total(gone), total(begins)]
            out.append(kept if with_text else [hashlib.sha256(t).hexdigest() for t in kept])
            types = [pa.int64()] * 4 + [pa.binary() if with_text else pa.string()]
            yield pa.RecordBatch.from_arrays(
                [a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(out, types, strict=True)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def without_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of every row of a stored table.

    ``kept`` are the bytes that stay, or their SHA-256 without ``with_text``. A null text is
    empty. Rows are in the order of their ids, null ids last, equal ids in the table's order;
    each is a document of its own. An empty table gives an empty result, other columns are
    left out.
    """
    bounded_batches(docs.sparkSession)
    rows = numbered(docs)
    found = rows.join(_by_row(repeated_starts(rows)), "row", "left").select("doc_id", "text", "starts")
    kind = "binary" if with_text else "string"
    return found.mapInArrow(
        _digest_batches(with_text), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {kind}"
    )


@query("op8_suffix_dedup")
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), False).withColumnRenamed("kept", "kept_sha256")
