"""Byte-level BPE of whole texts by replaying the merges over all words together.

A task cuts its texts by the tokenizer's pattern and numbers the distinct words. All words that are
not a token themselves lie side by side as linked lists of their bytes. An inverted index holds,
for every rank, the positions of the pairs of neighbouring tokens whose bytes together are the
token of that rank. Ranks are taken in ascending order, some thousand positions at a time; a merge
looks again only at the pairs left and right of it. Within a word the lowest rank goes first and
equal ranks from the left, which is what the tiktoken library does, also where a merge brings up a
pair of a lower rank. Words do not touch one another, so any number of them merge together.

A task remembers the words it knows, up to ``TABLE_WORDS``; its memory is bounded by that and by
pieces of texts, but for one longer text. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm.common import query, table
from pluvia.llm.textarrays import SortedHashes, bounded_batches, gathered, mixed, pieces

#: Words that a task remembers before it starts afresh, and bytes of new words that are merged together.
TABLE_WORDS = 500_000
REPLAY_BYTES = 4_000_000
#: Positions that are taken from the index in one step, at least, if there are so many.
STEP = 16_384
#: Texts that are numbered before their new words are merged, in bytes.
HELD_BYTES = 16_000_000
NONE = np.iinfo(np.int32).max


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Merges:
    """All pairs of tokens that make a token, as sorted hash arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte needs a rank")
        self.ranks = ranks
        self.letter = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs, made = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    made.append(rank)
        # ``mixed`` is one to one, so that a hash is a pair.
        keys = mixed(np.array(pairs, np.uint64))
        order = np.argsort(keys)
        self.pairs = SortedHashes(keys[order])
        self.made = np.append(np.array(made, np.int32)[order], np.int32(NONE))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two tokens make together, ``NONE`` where there is none."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        return self.made[self.pairs.find(mixed(key))]


class _Index:
    """Positions by rank; ranks come out in ascending order."""

    def __init__(self):
        self.lists: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []

    def add(self, ranks: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        edges = np.flatnonzero(np.diff(ranks, prepend=-1, append=-1)).tolist()
        firsts = ranks[edges[:-1]].tolist()
        for rank, lo, hi in zip(firsts, edges[:-1], edges[1:], strict=True):
            known = self.lists.get(rank)
            if known is None:
                self.lists[rank] = [at[lo:hi]]
                heapq.heappush(self.heap, rank)
            else:
                known.append(at[lo:hi])

    def take(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """All positions of the lowest ranks, of as many ranks as give ``least`` positions."""
        ranks, parts, n = [], [], 0
        while self.heap and n < least:
            rank = heapq.heappop(self.heap)
            for part in self.lists.pop(rank):
                ranks.append(rank)
                parts.append(part)
                n += len(part)
        return np.repeat(np.array(ranks, np.int32), [len(p) for p in parts]), np.concatenate(parts)


def replay(merges: Merges, data: np.ndarray, offs: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of words side by side (bytes and offsets), and the words' offsets among them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
    token = merges.letter[data]
    word = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    full = np.diff(offs) > 0
    after[offs[1:][full] - 1] = -1
    before[offs[:-1][full]] = -1
    #: Rank of the pair that begins at a position; a position of the index counts only while it has that rank.
    rank_at = np.full(n, NONE, np.int32)
    index = _Index()

    def look(at: np.ndarray) -> None:
        nxt = after[at]
        found = np.where(nxt < 0, NONE, merges.rank(token[at], token[nxt])).astype(np.int32)
        rank_at[at] = found
        some = found != NONE
        index.add(found[some], at[some])

    for lo in range(0, n, 1 << 20):
        look(np.arange(lo, min(n, lo + (1 << 20)), dtype=np.int32))
    alive = np.ones(n, bool)
    while index.heap:
        ranks, at = index.take(step)
        valid = rank_at[at] == ranks
        ranks, at = ranks[valid], at[valid]
        if not len(at):
            continue
        # Of each word the lowest rank, its positions from the left, each once.
        order = np.lexsort((at, ranks, word[at]))
        ranks, at = ranks[order], at[order]
        new = np.concatenate([[True], at[1:] != at[:-1]])
        ranks, at = ranks[new], at[new]
        w = word[at]
        opens = np.concatenate([[True], w[1:] != w[:-1]])
        group = np.cumsum(opens) - 1
        lowest = ranks == ranks[opens][group]
        later = ~lowest
        # Of pairs that overlap one another, every second one from the left.
        at_low, w_low = at[lowest], w[lowest]
        apart = np.concatenate([[True], after[at_low[:-1]] != at_low[1:]])
        place = np.arange(len(at_low))
        free = (place - np.maximum.accumulate(np.where(apart, place, 0))) % 2 == 0
        chosen, r, w_low = at_low[free], ranks[lowest][free], w_low[free]
        # Where a merge of several in a word brings up a lower rank, only the first of them is made.
        first = np.concatenate([[True], w_low[1:] != w_low[:-1]])
        if not first.all():
            many = ~first | np.append(~first[1:], False)
            hold = _brings_lower(merges, token, after, before, chosen[many], r[many])
            if hold.any():
                words = np.unique(w_low[many][hold])
                held = np.isin(w_low, words) & ~first
                index.add(r[held], chosen[held])
                # Pairs that overlapped a merge that is held back may stand after all.
                skipped = np.isin(w[lowest], words) & ~free
                index.add(ranks[lowest][skipped], at_low[skipped])
                chosen, r = chosen[~held], r[~held]
        index.add(ranks[later], at[later])
        second = after[chosen]
        beyond = after[second]
        token[chosen] = r
        after[chosen] = beyond
        inside = beyond >= 0
        before[beyond[inside]] = chosen[inside]
        alive[second] = False
        rank_at[second] = NONE
        left = before[chosen]
        touched = np.concatenate([chosen, left[left >= 0]])
        look(np.unique(touched))
    return token[alive], np.concatenate([[0], np.cumsum(alive)])[offs]


def _brings_lower(merges, token, after, before, chosen, r) -> np.ndarray:
    """Whether one of the pairs beside a merge, once it and those left of it are made, ranks lower."""
    made = np.full(len(chosen), NONE, np.int32)
    second = after[chosen]
    beyond = after[second]
    right = np.where(beyond < 0, made, merges.rank(r, token[beyond]))
    left = before[chosen]
    # The token before is new if the merge to the left ends there.
    joined = np.concatenate([[False], second[:-1] == left[1:]]) & (left >= 0)
    left_token = np.where(joined, r, token[left])
    lower = np.where(left < 0, made, merges.rank(left_token, r))
    return (right < r) | (lower < r)


class _Words(dict):
    """Number of every word; new ones are noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at


class Encoder:
    """Ids of texts; distinct words are merged once."""

    def __init__(self, path: str, table_words: int = TABLE_WORDS):
        import public_tokenizers
        import regex

        self.merges = Merges(read_ranks(path))
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        self.table_words = table_words
        self.forget()

    def forget(self) -> None:
        self.words = _Words()
        self.flat, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def numbers(self, text: str) -> np.ndarray:
        found = self.cut(text)
        if len(found) < 2:
            return np.array([self.words[w] for w in found], np.int32)
        return np.fromiter(itemgetter(*found)(self.words), np.int32, len(found))

    def learn(self) -> None:
        """Merge the words that were not known."""
        new, self.words.new = [w.encode() for w in self.words.new], []
        own = self.merges.ranks
        flat, sizes = [self.flat], [np.zeros(0, np.int64)]
        lo = 0
        while lo < len(new):
            hi, total = lo, 0
            while hi < len(new) and (hi == lo or total + len(new[hi]) <= REPLAY_BYTES):
                total += len(new[hi])
                hi += 1
            some = new[lo:hi]
            whole = np.fromiter((own.get(w, -1) for w in some), np.int32, len(some))
            rest = [w if t < 0 else b"" for w, t in zip(some, whole.tolist(), strict=True)]
            offs = np.concatenate([[0], np.cumsum(np.fromiter(map(len, rest), np.int64, len(rest)))])
            ids, at = replay(self.merges, np.frombuffer(b"".join(rest), np.uint8), offs)
            # A word that is a token has no merged ids; its own goes where they would be.
            known = whole >= 0
            flat.append(np.insert(ids, at[:-1][known], whole[known]))
            sizes.append(np.diff(at) + known)
            lo = hi
        self.first = np.append(self.first, self.first[-1] + np.cumsum(np.concatenate(sizes)))
        self.flat = np.concatenate(flat)

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        start = self.first[numbers]
        return gathered(self.flat, start, self.first[numbers + 1] - start)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.words) > self.table_words:
            self.forget()
        numbers = [self.numbers(t) for t in texts]
        self.learn()
        return [self.ids(n) for n in numbers]


def _encode_batches(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        held: list[tuple[pa.Array, list[np.ndarray]]] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            encoder.learn()
            for doc_ids, numbers in held:
                sizes = np.concatenate([[0], np.cumsum([len(x) for x in numbers])])
                at = np.concatenate(numbers)
                ends = np.concatenate([[0], np.cumsum(encoder.first[at + 1] - encoder.first[at])])[sizes]
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(encoder.ids(at)))
                yield pa.RecordBatch.from_arrays([doc_ids, ids], ["doc_id", "ids"])
            held.clear()
            if len(encoder.words) > encoder.table_words:
                encoder.forget()

        for rows, data, _ in pieces(batches):
            numbers = [encoder.numbers(t or "") for t in rows.column("text").to_pylist()]
            held.append((rows.column("doc_id"), numbers))
            total += len(data)
            # New words stand against the same bound as known ones.
            if total >= HELD_BYTES or len(encoder.words) > encoder.table_words:
                yield from flush()
                total = 0
        if held:
            yield from flush()

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids``: the token ids of every row's whole text.

    Null and empty texts have no ids. Repeated rows are encoded each, ids of rows may be null, other
    columns are left out. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode_batches(path), "doc_id long, ids array<int>")


def _decode_batches(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sorted((rank, token) for token, rank in read_ranks(path).items())
        size = np.zeros(of[-1][0] + 1, np.int64)
        size[[rank for rank, _ in of]] = [len(token) for _, token in of]
        first = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(token for _, token in of), np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy()[ends[0] : ends[-1]]
            n = size[ids]
            out = gathered(flat, first[ids], n)
            at = np.concatenate([[0], np.cumsum(n)])[ends - ends[0]]
            data = pa.Array.from_buffers(
                pa.binary(), batch.num_rows, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())]
            )
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, data], ["doc_id", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes that the ids of each row stand for. Null ids are none."""
    bounded_batches(encoded.sparkSession)
    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(_decode_batches(path), "doc_id long, ids array<int>, decoded binary")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op12_bpe")
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_path()
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
