"""Hidden Markov language model of word sequences.

A text is its lower-cased words and an end. Latent states emit words; Baum-Welch counts of all
training texts, added up over the partitions, re-estimate start, transition and emission
probabilities. The likelihood of a text is exact: the scaled forward recursion over the whole
of it.

Every word has emission probabilities of its own per state: its expected counts, one more
token dealt by the states' shares, and a share of the unigram model; a word that training did not
see has the last two. The vocabulary grows with the corpus, so it is split. The ``HEAD`` most
frequent words (a bound, found by a histogram of counts) travel with the query. All others are
dealt to ranges of their hashes. Texts are stored as chunks of about ``RUN_TOKENS`` symbols, and
each chunk and range share one sorted list of words. Only then on do counts move, one packed array
per chunk and range: a range adds up the arrays of its chunks and answers each with the sums of its
words. So frequent words never are keys of a shuffle, no row is a single word, and where the split
lies does not change the model. A range holds about ``RANGE_TOKENS`` tokens whatever the corpus'
size. Every step is stored, and what the next step replaces is deleted.

Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm.common import forget, query, remainder, stored, table
from pluvia.llm.textarrays import LOWER, SortedHashes, bounded_batches, gathered, give_back, mixed, pieces, span_hashes, word_spans

STATES = 6
HEAD = 50_000
#: Iterations, all on all training texts: so many, and those that the caller asks for.
FIRST_ITERATIONS = 8
ITERATIONS = 2
SEED = 5
#: Weight of the unigram distribution in a state's emissions, in tokens.
SMOOTHING = 50.0
#: Tokens of a chunk, whose texts share a list of words.
RUN_TOKENS = 5_000_000
#: Symbols of a chunk whose recursions run side by side; a single longer text runs alone.
PART_TOKENS = 800_000
#: Steps of a likelihood's recursion of which one is scaled, in double precision; and of a count's recursions; the
#: least sum that may come of the latter; rows that are counted together.
FORWARD_EVERY = 8
SCALE_EVERY = 4
LEAST = 1e-25
BLOCK_ROWS = 1 << 15
#: Tokens outside the head whose words make a range.
RANGE_TOKENS = 500_000
#: Tasks that add up the heads of all chunks.
HEAD_TASKS = 32
#: Distinct words that a task adds up before it passes them on.
HELD_WORDS = 2_000_000


def piece_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a piece, and the rows' offsets among them."""
    low = LOWER[data]
    starts, ends, at = word_spans(low, offs)
    return span_hashes(low, starts, ends), at


def _count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``w, n`` over all pieces of a partition, added up while they fit."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        w, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        return w, np.bincount(at, np.concatenate([x[1] for x in held])).astype(np.int64)

    for _, data, offs in pieces(batches):
        held.append(np.unique(piece_words(data, offs)[0], return_counts=True))
        if sum(len(x[0]) for x in held) > HELD_WORDS:
            held[:] = [merged()]
            if len(held[0][0]) > HELD_WORDS // 2:
                yield _rows(["w", "n"], held[0][0].view(np.int64), held[0][1])
                held.clear()
    if held:
        w, n = merged()
        yield _rows(["w", "n"], w.view(np.int64), n)


def _rows(names: list[str], *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names)


@dataclass
class Vocabulary:
    """Head words with their counts, and the totals of all training tokens."""

    head: SortedHashes
    counts: np.ndarray  # of the head words, in the order of their hashes
    n_texts: int  # the count of the end
    n_tokens: int
    n_kinds: int
    rare_tokens: int
    rare_kinds: int

    @property
    def rare(self) -> int:
        """Symbol of all words outside the head; the end is the one after it."""
        return len(self.counts)

    @property
    def ranges(self) -> int:
        """Ranges of the hashes of the words outside the head; grows with their tokens."""
        return 1 + self.rare_tokens // RANGE_TOKENS

    def symbols(self, h: np.ndarray) -> np.ndarray:
        place = self.head.find(h)
        return np.where(place < 0, np.int32(self.rare), place)

    @property
    def mass(self) -> float:
        return self.n_tokens + self.n_kinds + 1.0

    def unigram(self) -> np.ndarray:
        """Add-one probabilities of the head, all other words with those not seen, and the end."""
        return (np.append(self.counts, [self.rare_tokens, self.n_texts]) + self.kinds()) / self.mass

    def kinds(self) -> np.ndarray:
        """Words behind each symbol; the words not seen count as one."""
        return np.append(np.ones(len(self.counts)), [self.rare_kinds + 1.0, 1.0])

    def base(self, c: np.ndarray) -> np.ndarray:
        """log10 of the add-one probability of words with count ``c``."""
        return np.log10((c + 1.0) / self.mass)


def vocabulary(counts: DataFrame, n_texts: int, head: int = HEAD) -> Vocabulary:
    """From the counts ``w, n`` of all training words: the driver gets at most ``head`` of them."""
    level = F.floor(F.log2("n") * 8).cast("int").alias("level")
    histogram = counts.groupBy(level).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")).collect()
    kinds = tokens = 0
    least = 1 << 30
    for r in sorted(histogram, reverse=True):
        if kinds + r.kinds > head:
            break
        kinds, tokens, least = kinds + r.kinds, tokens + r.n, r.level
    rows = counts.where(F.floor(F.log2("n") * 8).cast("int") >= least).toPandas()
    w = rows.w.to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(w)
    all_kinds, all_tokens = sum(r.kinds for r in histogram), sum(r.n for r in histogram)
    return Vocabulary(
        SortedHashes(w[order]), rows.n.to_numpy().astype(np.int64)[order], n_texts, all_tokens + n_texts,
        all_kinds + bool(n_texts), all_tokens - tokens, all_kinds - kinds,
    )


def noise(h: np.ndarray, states: int) -> np.ndarray:
    """Log-normal factors of words (rows) and states that depend on the word's hash alone."""
    out = np.empty((len(h), states))
    for s in range(states):
        a, b = (
            ((mixed(h + np.uint64(2 * (SEED * 64 + s) + k)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
            for k in (0, 1)
        )
        out[:, s] = np.exp(0.5 * np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b))
    return out


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states; all words outside the head together have one row
    #: Emissions of such a word with counts c: (c + added + smooth * (sum of c + 1)) / total.
    added: np.ndarray | float = 0.0
    smooth: float = 0.0
    total: np.ndarray | float = 1.0

    @staticmethod
    def begin(words: Vocabulary, rest: np.ndarray, states: int) -> "Hmm":
        """Near the unigram model, with states that last; noise breaks the tie between them.

        ``rest``: sums of the first counts, ``(n + 1) * noise``, of all words outside the head.
        """
        end = (words.n_texts + 1) * noise(np.zeros(1, np.uint64), states)
        head = (words.counts + 1)[:, None] * noise(words.head.keys[: len(words.counts)], states)
        emit = np.vstack([head, rest + 1.0, end])
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return Hmm(np.full(states, 1 / states), move, emit / emit.sum(0), total=emit.sum(0))

    def updated(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, words: Vocabulary) -> "Hmm":
        k = len(self.start)
        start = start + 1.0
        move = move + 1.0 / k
        share = emit.sum(0) + 1e-9
        share /= share.sum()
        emit = emit + words.kinds()[:, None] * share + SMOOTHING * words.unigram()[:, None]
        total = emit.sum(0)
        return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / total, share, SMOOTHING / words.mass, total)

    def of_counts(self, c: np.ndarray) -> np.ndarray:
        """Emissions of words outside the head, as exact as their counts."""
        kind, k = c.dtype, len(self.start)
        out = np.dot(c, np.full((k, k), self.smooth, kind))
        out += c
        out += (self.added + self.smooth).astype(kind) if isinstance(self.added, np.ndarray) else kind.type(self.added + self.smooth)
        out /= np.asarray(self.total, kind)
        return out


class Packed:
    """Sequences side by side, longest first: step ``t`` is one slice of all that are that long."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, laid: bool = False):
        """``laid``: the symbols lie in the order of the steps already, as a chunk's do."""
        self.order = np.argsort(-sizes, kind="stable")
        ordered = sizes[self.order]
        n = int(ordered[0]) if len(ordered) else 0
        self.live = np.searchsorted(-ordered, -np.arange(1, n + 1), "right")  # how many reach step t
        self.steps = np.concatenate([[0], np.cumsum(self.live)])
        if laid:
            self.symbols = symbols
            return
        place = np.empty(len(sizes), np.int64)
        place[self.order] = np.arange(len(sizes))
        # Where each symbol goes: its step's slice, its sequence's place in it. A chunk has less than
        # 2 ** 31 symbols.
        at = np.arange(len(symbols), dtype=np.int32)
        at -= np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
        at = self.steps.astype(np.int32)[at]
        at += np.repeat(place.astype(np.int32), sizes)
        self.symbols = np.empty(len(symbols), np.int32)
        self.symbols[at] = symbols

    @property
    def spans(self) -> list[tuple[int, int, int]]:
        """Number of sequences, begin and end of every step's slice."""
        return list(zip(self.live.tolist(), self.steps[:-1].tolist(), self.steps[1:].tolist(), strict=True))

    def added(self, values: np.ndarray) -> np.ndarray:
        """Sums of the symbols' values by sequence, in the original order."""
        total, out = np.zeros(len(self.order), values.dtype), np.empty(len(self.order), values.dtype)
        for live, lo, hi in self.spans:
            total[:live] += values[lo:hi]
        out[self.order] = total
        return out


def parted(sizes: np.ndarray) -> list[slice]:
    """Which sequences' recursions run side by side."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PART_TOKENS, "right")) - 1)
        out.append(slice(lo, hi))
        lo = hi
    return out


def packs(symbols: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[slice, Packed]]:
    """Sequences some at a time: which, and packed."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for which in parted(sizes):
        yield which, Packed(symbols[ends[which.start] : ends[which.stop]], sizes[which])


def forward(model: Hmm, x: Packed, every: int = FORWARD_EVERY) -> np.ndarray:
    """Natural-log likelihoods in the original order, by the forward recursion.

    Its vectors are scaled at every ``every``-th step; a sequence adds its scales and the sum at its end.
    """
    k = len(model.start)
    total = np.zeros(len(x.order))
    emitted = np.take(model.emit, x.symbols.astype(np.int64), 0)
    ones, a = np.ones((k, k)), emitted[:0]
    ends = np.append(x.live[1:], 0).tolist()
    for t, ((live, lo, hi), on) in enumerate(zip(x.spans, ends, strict=True)):
        now = emitted[lo:hi]
        now *= model.start if t == 0 else np.dot(a[:live], model.move)
        if t % every == every - 1:
            c = np.dot(now, ones)
            now /= c
            total[:live] += np.log(c[:, 0])
        if on < live:
            total[on:live] += np.log(now[on:].sum(1))
        a = now
    out = np.empty(len(x.order))
    out[x.order] = total
    return out


def expected_counts(model: Hmm, x: Packed, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of the sequences, by the backward recursion."""
    k = len(model.start)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, len(model.emit)))
    add_counts(model, relative(model.emit, kind), x, start, move, emit)
    return start, move, emit.T


def relative(emit: np.ndarray, kind: type) -> np.ndarray:
    """Emissions of each symbol as parts of their sum; counts depend on no more."""
    total = np.dot(emit, np.ones((emit.shape[1],) * 2, emit.dtype))
    return np.divide(emit, total, out=np.zeros_like(emit), where=total > 0).astype(kind, copy=False)


def add_counts(
    model: Hmm, parts: np.ndarray, x: Packed, start: np.ndarray, move: np.ndarray, emit: np.ndarray,
    space: np.ndarray | None = None, every: int = SCALE_EVERY,
) -> None:
    """Adds the expected starts, moves and emissions (states x symbols) of the sequences. ``space`` is used
    for the vectors, if given: three times as many values as the symbols have states, or more.

    Both recursions are scaled at some steps only, as the counts of each step are divided by their own
    sum. The forward one leaves the vector of the step before beside every symbol, the backward one
    ``w = emission * b`` of its own step; of these two all counts follow at once. Should a sum come too close
    to zero, all is done again with every step scaled.
    """
    k, kind, n = len(start), parts.dtype, len(x.symbols)
    if not n:
        return
    symbols = x.symbols.astype(np.int64)
    flat = (np.empty(3 * n * k, kind) if space is None else space)[: 3 * n * k].reshape(3, -1)
    w, past, found = flat[0].reshape(n, k), flat[1].reshape(n, k), flat[2].reshape(k, n)
    np.take(parts, symbols, 0, out=w, mode="clip")
    first, ones = int(x.live[0]), np.ones((k, k), kind)
    begin, step = model.start.astype(kind), model.move.astype(kind)
    spans = list(enumerate(x.spans))
    held, at = np.tile(begin, (first, 1)), 0
    for t, (live, lo, hi) in spans[1:]:
        now, a = held[:live], past[lo:hi]
        np.multiply(now, w[at : at + live], out=a)
        if t > 1 and (t - 1) % every == 0:
            np.dot(a, ones, out=now)
            a /= now
        np.dot(a, step, out=now)
        at = lo
    back = np.ascontiguousarray(step.T)
    # Sequences that end at a step begin there with ones.
    held[:] = 1
    for t, (live, lo, hi) in reversed(spans):
        now, some = held[:live], w[lo:hi]
        some *= now
        if t % every == 0:
            np.dot(some, ones, out=now)
            some /= now
        np.dot(some, back, out=now)
    opening = w[:first] * begin
    sums = np.dot(opening, ones)
    low, moves = sums.min(), np.zeros((k, k))
    np.divide(opening.T, sums.T, out=found[:, :first])
    block = np.empty((2, min(n, BLOCK_ROWS), k), kind)
    for lo in range(first, n, BLOCK_ROWS):
        a, own = past[lo : lo + BLOCK_ROWS], w[lo : lo + BLOCK_ROWS]
        counts, sums = block[:, : len(a)]
        np.dot(a, step, out=counts)
        counts *= own
        np.dot(counts, ones, out=sums)
        low = min(low, sums.min())
        a /= sums
        moves += np.dot(a.T, own)
        np.divide(counts.T, sums.T, out=found[:, lo : lo + len(a)])
    if every > 1 and not low > LEAST:
        add_counts(model, parts, x, start, move, emit, space, 1)
        return
    start += found[:, :first].sum(1, dtype=np.float64)
    move += moves * model.move
    for s in range(k):
        emit[s] += np.bincount(symbols, found[s], emit.shape[1])


#: Texts of a chunk; and of each chunk and range the sorted words, or numbers of them.
CHUNKS = "chunk long, range int, ids array<long>, sizes array<int>, cuts array<int>, data binary, n int"
PARTS = "range int, chunk long, n int, data binary"
#: The range of a chunk's texts, and of the sums of starts, moves and head.
SUMS = -1
#: In place of a chunk: all words of a range with their counts, the first sums.
WORDS, FIRST = -(1 << 62), -(1 << 62) + 1


def _pack(values: np.ndarray) -> bytes:
    """Little-endian values, the first bytes of all, then the second ones and so on, compressed."""
    planes = np.ascontiguousarray(values.reshape(-1).view(np.uint8).reshape(-1, values.dtype.itemsize).T)
    return pa.compress(pa.py_buffer(planes), "zstd", asbytes=True)


def _unpack(data, kind: str, n: int, out: np.ndarray | None = None) -> np.ndarray:
    """The values, in ``out`` if it is given."""
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, "zstd"), np.uint8).reshape(size, n)
    values = np.empty(n, f"<u{size}") if out is None else out.view(f"<u{size}")
    values[:] = planes[-1]
    for plane in planes[-2::-1]:
        values <<= 8
        values |= plane
    return values.view(kind)


def _given(rows: pa.Table) -> Iterator[dict]:
    """Rows whose packed columns stay where they are."""
    packed = [c for c in rows.column_names if pa.types.is_binary(rows.schema.field(c).type)]
    plain = rows.drop_columns(packed).to_pylist()
    for row, *data in zip(plain, *(rows.column(c) for c in packed), strict=True):
        yield row | {c: d.as_buffer() for c, d in zip(packed, data, strict=True)}


def _parts(rows: list[tuple], sums: bool = False) -> pa.RecordBatch:
    names = ["range", "chunk", "n", "data", "sums"][: 4 + sums]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()][: 4 + sums]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return _rows(names, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)])


def _ranges(words: np.ndarray, n: int) -> np.ndarray:
    """Edges of ``n`` ranges of hashes among sorted words."""
    borders = np.array([(r << 64) // n for r in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(words, borders), [len(words)]])


def _chunk_batches(words: Vocabulary, ranges: int):
    """Whole texts with their ends, about ``RUN_TOKENS`` symbols a row, and the chunk's other words.

    The symbols lie as the recursions take them, part by part, and ``cuts`` has the bytes of each part. Symbols
    from ``words.rare + 2`` on are places in the chunk's list of words outside the head, which follows in a row
    per range: ``n`` hashes, then how often each occurs.
    """

    def lists(values: list, kind: pa.DataType, nulls: int) -> pa.Array:
        """A list for the texts, none for the ranges."""
        return pa.array([values] + [None] * nulls, pa.list_(kind))

    def rows(chunk: int, held: list) -> pa.RecordBatch:
        symbols, h, sizes = (np.concatenate([x[k] for x in held]) for k in range(3))
        ids = pa.concat_arrays([x[3] for x in held])
        held.clear()
        rare, at, times = np.unique(h, return_inverse=True, return_counts=True)
        symbols[symbols == words.rare] = words.rare + 2 + at
        del h, at
        # Longest texts first, so that parts of a chunk hold texts of like length and take few steps.
        order = np.argsort(-sizes, kind="stable")
        starts = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        ids = ids.take(pa.array(order))
        texts = [_pack(Packed(gathered(symbols, starts[p], sizes[p]), sizes[p]).symbols) for p in parted(sizes)]
        edges = _ranges(rare, ranges)
        full = [r for r in range(ranges) if edges[r] < edges[r + 1]]
        cut = [slice(edges[r], edges[r + 1]) for r in full]
        data = [b"".join(texts), *[_pack(np.concatenate([rare[c], times[c].astype(np.uint64)])) for c in cut]]
        return _rows(
            ["chunk", "range", "ids", "sizes", "cuts", "data", "n"], pa.array([chunk] * (1 + len(full)), pa.int64()),
            pa.array([SUMS, *full], pa.int32()), lists(ids.to_pylist(), pa.int64(), len(full)),
            lists(sizes.tolist(), pa.int32(), len(full)), lists([len(x) for x in texts], pa.int32(), len(full)),
            pa.array(data, pa.binary()), pa.array([len(symbols), *[c.stop - c.start for c in cut]], pa.int32()),
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        held: list = []
        total = 0
        for part, data, offs in pieces(batches):
            h, at = piece_words(data, offs)
            symbols = words.symbols(h)
            h = h[symbols == words.rare]
            symbols = np.insert(symbols, at[1:], np.int32(words.rare + 1))
            held.append((symbols, h, np.diff(at) + 1, part.column("doc_id")))
            total += len(symbols)
            if total >= RUN_TOKENS:
                yield rows(chunk, held)
                chunk, held, total = chunk + 1, [], 0
        if held:
            yield rows(chunk, held)

    return run


def _chunks(docs: DataFrame, words: Vocabulary) -> tuple[DataFrame, DataFrame]:
    """``chunk, ids, sizes, cuts, data, n``: the texts; ``chunk, range, data, n``: words by range."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = stored(rows.mapInArrow(_chunk_batches(words, words.ranges), CHUNKS), clear=True, packed=True)
    texts = both.where(F.col("range") == SUMS).select("chunk", "ids", "sizes", "cuts", "data", "n")
    return texts, both.where(F.col("range") != SUMS).select("chunk", "range", "data", "n")


def _words_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sorted words of a chunk in a range, and how often each occurs there."""
    both = _unpack(row["data"], "<u8", 2 * row["n"])
    return both[: row["n"]], both[row["n"] :].astype(np.int64)


def _first_answers(states: int):
    """Of a range the places of every chunk's words among all of its words, and the first counts.

    Rows of the chunk's number carry the counts for it, rows of ``~chunk`` its places; one row has all
    words with their counts, one the first sums.
    """

    def run(key: tuple, lists: pa.Table) -> pa.Table:
        r = key[0].as_py()
        rows = list(_given(lists))
        own = [_words_of(row) for row in rows]
        words, at = np.unique(np.concatenate([w for w, _ in own]), return_inverse=True)
        n = np.bincount(at, np.concatenate([k for _, k in own])).astype(np.int64)
        c = ((n + 1)[:, None] * noise(words, states)).astype("<f4")
        out = [(r, WORDS, len(words), _pack(np.concatenate([words, n.astype(np.uint64)]))), (r, FIRST, states, _pack(c.sum(0, dtype=np.float64)))]
        lo = 0
        for row, (w, _) in zip(rows, own, strict=True):
            places = at[lo : lo + len(w)]
            lo += len(w)
            out.append((r, row["chunk"], len(w), _pack(c[places])))
            out.append((r, ~row["chunk"], len(w), _pack(places.astype("<i4"))))
        return pa.Table.from_batches([_parts(out)])

    return run


def _answers(states: int, last: bool):
    """A range's sums: one answer for each chunk, or, if none follows, all of them with chunk ``WORDS``."""

    def run(key: tuple, parts: pa.Table, places: pa.Table) -> pa.Table:
        at = {~row["chunk"]: _unpack(row["data"], "<i4", row["n"]) for row in _given(places)}
        total = np.zeros((1 + max((int(a.max()) for a in at.values()), default=-1), states))
        for row in _given(parts):
            total[at[row["chunk"]]] += _unpack(row["data"], "<f4", row["n"] * states).reshape(-1, states)
        total = total.astype("<f4")
        r = key[0].as_py()
        if last:
            return pa.Table.from_batches([_parts([(r, WORDS, len(total), _pack(total))])])
        return pa.Table.from_batches([_parts([(r, chunk, len(a), _pack(total[a])) for chunk, a in at.items()])])

    return run


def _laid(text: dict) -> Iterator[tuple[slice, Packed]]:
    """Texts of a chunk some at a time, as ``packs``."""
    sizes, lo = np.asarray(text["sizes"], np.int64), 0
    for which, n in zip(parted(sizes), text["cuts"], strict=True):
        some = sizes[which]
        yield which, Packed(_unpack(text["data"][lo : lo + n], "<i4", int(some.sum())), some, laid=True)
        lo += n


def _unpacked(own: pa.Table, width: int, kind: str) -> Iterator[tuple[int, slice, np.ndarray]]:
    """The answers of all ranges to a chunk in order: the range, which of the chunk's words, their values."""
    lo = 0
    for row in sorted(_given(own), key=lambda row: row["range"]):
        yield row["range"], slice(lo, lo + row["n"]), _unpack(row["data"], kind, row["n"] * width).reshape(-1, width)
        lo += row["n"]


def _counted(model: Hmm, words: Vocabulary):
    """A chunk's expected counts: a row for the head with start and moves, one per range."""
    k, size = len(model.start), len(words.counts) + 2

    def run(texts: pa.Table, own: pa.Table) -> pa.Table:
        out = []
        for text in _given(texts):
            parts = np.empty((size + sum(own.column("n").to_pylist()), k), np.float32)
            parts[:size] = relative(model.emit, np.float32)
            ranges = []
            for r, which, c in _unpacked(own, k, "<f4"):
                parts[size:][which] = relative(model.of_counts(c), np.float32)
                ranges.append((r, which))
            start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, len(parts)))
            space = np.empty(3 * k * max(min(text["n"], PART_TOKENS), max(text["sizes"])), np.float32)
            for _, x in _laid(text):
                add_counts(model, parts, x, start, move, emit, space)
            del parts, space, x
            head, tail = emit[:, :size].T, emit[:, size:]
            head[words.rare] = tail.sum(1)
            sums = np.vstack([start[None], move, head]).astype("<f4")
            out.append((SUMS, text["chunk"], len(sums), None, _pack(sums)))
            for r, which in ranges:
                found = tail[:, which].T.astype("<f4", order="C")
                out.append((r, text["chunk"], len(found), _pack(found), None))
        return pa.Table.from_batches([_parts(out, True)])

    return run


def _sum_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the heads of a task's chunks."""
    total = None
    for batch in batches:
        for row in batch.to_pylist():
            sums = _unpack(row["sums"], "<f4", row["n"]).astype(np.float64)
            total = sums if total is None else total + sums
    if total is not None:
        yield _rows(["n", "sums"], pa.array([len(total)], pa.int32()), pa.array([_pack(total)], pa.binary()))


def baum_welch(
    model: Hmm, texts: DataFrame, places: DataFrame, answers: DataFrame, words: Vocabulary, last: bool
) -> tuple[Hmm, DataFrame]:
    """One iteration over all texts: the new model and the ranges' new answers, after the last one their sums.

    The driver gets the sums of the head, an array from each of ``HEAD_TASKS`` tasks.
    """
    k = len(model.start)
    mine = answers.where(F.col("chunk") >= 0)
    counted = texts.groupBy("chunk").cogroup(mine.groupBy("chunk")).applyInArrow(_counted(model, words), PARTS + ", sums binary")
    parts = stored(counted, clear=True, packed=True)
    sums = np.zeros((1 + k + len(words.counts) + 2, k))
    heads = parts.where("sums is not null").select((F.col("n") * k).cast("int").alias("n"), "sums").coalesce(HEAD_TASKS)
    for row in heads.mapInArrow(_sum_batches, "n int, sums binary").collect():
        sums += _unpack(bytes(row.sums), "<f8", row.n).reshape(-1, k)
    tails = parts.where(F.col("range") != SUMS).select("range", "chunk", "n", "data").groupBy("range")
    new = stored(tails.cogroup(places.groupBy("range")).applyInArrow(_answers(k, last), PARTS), clear=True, packed=True)
    forget(parts)
    return model.updated(sums[0], sums[1 : 1 + k], sums[1 + k :], words), new


def fit(docs: DataFrame, states: int = STATES, head: int = HEAD, iterations: int = ITERATIONS) -> tuple[Hmm, Vocabulary, DataFrame]:
    """Model, vocabulary, and the words of ``docs`` outside the head by range: ``range, n, words, data``,
    hashes with their counts, and counts per state."""
    spark = docs.sparkSession
    bounded_batches(spark)
    given = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = stored(given.mapInArrow(_count_batches, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), clear=True)
    words = vocabulary(counts, given.count(), head)
    forget(counts)
    texts, lists = _chunks(given, words)
    first = stored(lists.groupBy("range").applyInArrow(_first_answers(states), PARTS), clear=True, packed=True)
    rest = np.zeros(states)
    for row in first.where(F.col("chunk") == FIRST).toLocalIterator():
        rest += _unpack(bytes(row.data), "<f8", states)
    model = Hmm.begin(words, rest, states)
    places = first.where((F.col("chunk") < 0) & (F.col("chunk") > FIRST))
    answers = first
    rounds = FIRST_ITERATIONS + iterations
    for k in range(rounds):
        old = answers
        model, answers = baum_welch(model, texts, places, old, words, k + 1 == rounds)
        if old is not first:
            forget(old)
    own = first.where(F.col("chunk") == WORDS).select("range", "n", F.col("data").alias("words"))
    sums = answers.where(F.col("chunk") == WORDS).select("range", "data")
    known = stored(own.join(sums, "range"), clear=True, packed=True)
    for done in (texts, first, answers):
        forget(done)
    return model, words, known


def _known(states: int):
    """Of every chunk's words in a range their training counts (0: not seen) and counts per state."""

    def run(key: tuple, lists: pa.Table, known: pa.Table) -> pa.Table:
        words, n, c = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, states), "<f4")
        for row in _given(known):
            words, n = _words_of({"n": row["n"], "data": row["words"]})
            c = _unpack(row["data"], "<f4", row["n"] * states).reshape(-1, states)
        table_ = np.vstack([np.hstack([n[:, None], c]), np.zeros((1, 1 + states))])  # the last row: not seen
        out = []
        for row in _given(lists):
            w, _ = _words_of(row)
            at = np.minimum(np.searchsorted(words, w), max(len(words) - 1, 0))
            at = np.where(words[at] == w, at, len(words)) if len(words) else np.zeros(len(w), np.int64)
            out.append((key[0].as_py(), row["chunk"], len(w), _pack(table_[at])))
        return pa.Table.from_batches([_parts(out)])

    return run


def score(docs: DataFrame, model: Hmm, words: Vocabulary, counts: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Null and empty texts are their end alone. Repeated rows are scored each, other columns are
    left out. Without training texts every token has probability one in the base model.
    """
    k = len(model.start)

    def run(texts: pa.Table, own: pa.Table) -> pa.Table:
        out = []
        for text in _given(texts):
            sizes = np.asarray(text["sizes"], np.int64)
            found = np.concatenate([np.zeros((0, 1 + k)), *[c for _, _, c in _unpacked(own, 1 + k, "<f8")]])
            local = Hmm(model.start, model.move, np.vstack([model.emit, model.of_counts(found[:, 1:])]))
            n = np.concatenate([words.counts, [0, words.n_texts], found[:, 0].astype(np.int64)])
            in_base, seen = words.base(n), (n > 0).astype(np.int64)
            logs, base, known = np.empty(len(sizes)), np.empty(len(sizes)), np.empty(len(sizes), np.int64)
            for which, x in _laid(text):
                logs[which] = forward(local, x)
                base[which], known[which] = x.added(in_base[x.symbols]), x.added(seen[x.symbols])
            out.append(_rows(
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"], pa.array(text["ids"], pa.int64()),
                sizes, known, np.full(len(sizes), words.n_tokens, np.int64), base, logs / np.log(10),
            ))
            del local, found
        give_back()
        return pa.Table.from_batches(out)

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    texts, lists = _chunks(docs, words)
    own = lists.groupBy("range").cogroup(counts.groupBy("range")).applyInArrow(_known(k), PARTS)
    return texts.groupBy("chunk").cogroup(stored(own, clear=True, packed=True).groupBy("chunk")).applyInArrow(run, schema)


@query("op6_hmm")
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    scored = score(docs, *fit(docs.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
