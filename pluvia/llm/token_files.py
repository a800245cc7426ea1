"""Token files: ids of whole texts, Re-Pair compressed per shard, with random access.

Texts are ordered by id over range partitions, tokenized, and each document ends with an end id.
A shard holds the ids of consecutive documents, about ``SHARD_TOKENS`` of them. Re-Pair turns
frequent pairs of neighbouring ids into nonterminals, again and again: a round counts all pairs
of the shard and replaces the most frequent ones together, so that a shard costs a few passes
over its array. No pair crosses a document, so every document can be decoded by itself.

A shard is one row of a Parquet file, written by Spark's committer in the shared folder: a lost
task leaves nothing behind. Its block is little-endian binary (see ``pack_shard``): rules,
their expansion lengths, the place of each document in the sequence, the sequence.

Texts are cut at single spaces and line feeds, where no token of the byte-level tokenizer can cross.
Arrow numbers the distinct pieces of a block of texts, and each of them goes through the tokenizer
once per block. Texts with neighbouring white space go through it whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pluvia.llm.common import query, stored, table
from pluvia.llm.textarrays import bounded_batches, gathered, give_back, pieces

END_ID = 2
SHARD_TOKENS = 2_000_000
#: Uses from which a pair gets a rule; a rule takes the bytes of six symbols.
MIN_USES = 32
#: A round replaces the pairs that are at least this part as frequent as the most frequent one.
NEAR_TOP = 16
#: Bytes of texts whose pieces are numbered together.
BLOCK_BYTES = 24_000_000
#: Bytes of the batches that these blocks are made of.
FILE_BATCH_BYTES = 4 << 20
#: Parts that the library encodes, pieces that the pattern cuts, words whose ids are gathered and places
#: that Re-Pair hashes in one step; they bound the memory of what is needed for a moment only.
PARTS_AT_ONCE = 20_000
PIECES_AT_ONCE = 50_000
WORDS_AT_ONCE = 500_000
TEXTS_AT_ONCE = 1_000
PLACES_AT_ONCE = 1 << 20
MAGIC = b"RPF1"
#: White space (of any alphabet) at an end of a piece or next to other white space.
_ENTANGLED = re.compile(r"^\s|\s\s|\s$")
#: Characters whose kind all versions of Unicode agree on; none is white space.
_PLAIN = ((0x21, 0x7E), (0xA1, 0x24F))
_token_id = attrgetter("id")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand
    for themselves, the others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


def _plain_pattern(pattern: str) -> re.Pattern:
    """The pattern for texts of plain characters and white space: the classes of the pattern are written out,
    which the standard library matches faster."""
    import regex

    def members(found: re.Match) -> str:
        return "".join(re.escape(chr(c)) for a, b in _PLAIN for c in range(a, b + 1) if regex.match(found[0], chr(c)))

    kind = re.compile(r"\\p\{\w+\}")
    sets = re.compile(r"\[[^\]]*\]|" + kind.pattern)
    return re.compile(sets.sub(lambda m: kind.sub(members, m[0] if m[0][0] == "[" else f"[{m[0]}]"), pattern))


def _strings(names: pa.Array, mark: str) -> list[str]:
    """The strings of an array, none of which holds ``mark``; one decoding for all."""
    if not len(names):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
    return pc.binary_join(whole, pa.scalar(mark, names.type))[0].as_py().split(mark)


class Tokenizer:
    """Encodes texts with the ``tokenizers`` library, each distinct piece of a call once.

    Pieces of plain characters are cut by the tokenizer's own pattern into parts, and the
    library's model encodes each distinct part once; other pieces go through the whole
    tokenizer.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tokenizers

        whole = tokenizers.Tokenizer.from_file(path)
        self.encode = whole.encode
        # Texts that hold one of these go through the whole tokenizer.
        self.special = ["\0", *(str(t.content) for t in whole.get_added_tokens_decoder().values())]
        self.parts = _plain_pattern(public_tokenizers.PATTERN).findall
        self.letters = _byte_letters()
        self.mark = self.letters[10]  # stands for a line feed, which plain pieces do not hold
        self.model = whole.model

    def _direct(self, text: str) -> np.ndarray:
        return np.array(self.encode(text, add_special_tokens=False).ids, np.uint32)

    def _part_ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts, one after the other, and how many each has; a line feed that stands
        between pieces has none. Each other part is one call of the library's model."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
        for k in range(0, len(parts), PARTS_AT_ONCE):
            # The bytes of all at once; no part holds the zero between them.
            text = "\0".join(parts[k : k + PARTS_AT_ONCE]).encode().decode("latin-1").translate(self.letters)
            found = [self.model.tokenize(x) if x != self.mark else [] for x in text.split(self.letters[0])]
            sizes.append(np.fromiter(map(len, found), np.int32, len(found)))
            ids.append(np.fromiter(map(_token_id, chain.from_iterable(found)), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def _plain_ids(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct plain pieces, one after the other, and how many each has. The pattern runs over
        many pieces at once, on lines of their own."""
        cut = []
        for k in range(0, len(names), PIECES_AT_ONCE):
            lines = (" " + "\n ".join(names[k : k + PIECES_AT_ONCE])).replace(" \0", "") + "\n"
            cut.append(pa.array(self.parts(lines), pa.large_string()))
        parts = pa.concat_arrays(cut).dictionary_encode()
        del cut
        known = _strings(parts.dictionary, "\0")
        flat, sizes = self._part_ids(known)
        at = np.asarray(parts.indices)
        ids = gathered(flat, (np.cumsum(sizes) - sizes)[at], sizes[at])
        ends = np.cumsum(sizes[at])[at == known.index("\n")]
        return ids, np.diff(ends, prepend=0)

    def _piece_ids(self, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces, where each begins, how many it has, and its kind. ``\\0word`` stands
        alone, all others follow a space."""
        plain = _plain(names)
        ids, n = [np.zeros(0, np.uint32)], np.zeros(len(names), np.int64)
        kinds = np.zeros(len(names), np.int8)
        if plain.any():
            own, n[plain] = self._plain_ids([w for w, usual in zip(names, plain.tolist(), strict=True) if usual])
            ids.append(own)
        for k in np.flatnonzero(~plain).tolist():
            w = names[k]
            alone = w[:1] == "\0"
            body = w[1:] if alone else w
            if body or not alone:
                ids.append(self._direct(body if alone or w == "\n" else " " + body))
                n[k] = len(ids[-1])
            kinds[k] = (3 if alone else 2) if not body else int(w != "\n" and bool(_ENTANGLED.search(body)))
        # Plain pieces lie first, then the others, each in their order.
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        start = np.empty(len(names), np.int64)
        start[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate(ids), start, n, kinds

    def encode_all(self, texts: list[str] | pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, an end id behind each, one after the other, and their offsets. Null
        texts are empty."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = texts.cast(pa.large_string()).fill_null("")
        special = np.zeros(len(texts), bool)
        for mark in self.special:
            special |= np.asarray(pc.match_substring(texts, mark))
        whole = {k: self._direct(texts[k].as_py()) for k in np.flatnonzero(special).tolist()}
        usual = ~special & (np.asarray(pc.binary_length(texts)) > 0)
        first, none = (pa.scalar(x, pa.large_string()) for x in ("\0", ""))
        # Some texts at a time are cut and their words numbered; only the distinct ones of each wait for the others.
        n_words, words = np.zeros(len(texts), np.int64), [pa.array([], pa.large_string()).dictionary_encode()]
        for k in range(0, len(texts), TEXTS_AT_ONCE):
            own = usual[k : k + TEXTS_AT_ONCE]
            some = texts.slice(k, TEXTS_AT_ONCE).filter(pa.array(own))
            lined = pc.binary_join_element_wise(first, pc.replace_substring(some, "\n", " \n \0"), none)
            lists = pc.split_pattern(lined, " ")
            n_words[k : k + TEXTS_AT_ONCE][own] = np.asarray(pc.list_value_length(lists))
            words.append(lists.flatten().dictionary_encode())
            del some, lined, lists
        edges = np.concatenate([[0], np.cumsum(n_words)])
        words = pa.chunked_array(words).unify_dictionaries()
        at = np.concatenate([np.asarray(some.indices) for some in words.chunks])
        names = _strings(words.chunk(0).dictionary, " ")
        del words
        # What each step needed for a moment goes before the next one takes its own.
        give_back()
        flat, starts, sizes, kinds = self._piece_ids(names)
        del names
        give_back()
        # The end of a text is one more piece, the last one.
        flat, starts, sizes = np.append(flat, np.uint32(end_id)), np.append(starts, len(flat)), np.append(sizes, 1)
        ids, counts = np.empty(int(sizes[at].sum()) + len(texts), np.uint32), [np.zeros(0, np.int64)]
        lo = done = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + WORDS_AT_ONCE, "right")) - 1)
            some = np.insert(at[edges[lo] : edges[hi]], edges[lo + 1 : hi + 1] - edges[lo], len(starts) - 1)
            n = sizes[some]
            ends = np.cumsum(n)[np.cumsum(n_words[lo:hi] + 1) - 1]
            ids[done : done + ends[-1]] = gathered(flat, starts[some], n)
            counts.append(np.diff(ends, prepend=0))
            lo, done = hi, done + int(ends[-1])
        offs = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        # Empty pieces are white space next to white space, but for those at the ends of a text.
        kind = kinds[at]
        full = np.flatnonzero(n_words)
        first, last = edges[:-1][full], edges[1:][full] - 1
        kind[first] = np.where(kind[first] == 3, 0, kind[first])
        kind[last] = np.where(kind[last] >= 2, 0, kind[last])
        if kind.any():
            for k in np.unique(np.searchsorted(edges, np.flatnonzero(kind), "right") - 1).tolist():
                whole[k] = self._direct(texts[k].as_py())
        if whole:
            own = {k: np.append(v, np.uint32(end_id)) for k, v in whole.items()}
            parts = [own.get(k, ids[offs[k] : offs[k + 1]]) for k in range(len(texts))]
            ids = np.concatenate(parts)
            offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, offs


def _plain(pieces_: list[str]) -> np.ndarray:
    """Which pieces are of plain characters, and not empty."""
    some = [_plain_some(pieces_[k : k + PIECES_AT_ONCE]) for k in range(0, len(pieces_), PIECES_AT_ONCE)]
    return np.concatenate([np.zeros(0, bool), *some])


def _plain_some(pieces_: list[str]) -> np.ndarray:
    sizes = np.fromiter(map(len, pieces_), np.int64, len(pieces_))
    text = np.frombuffer("".join(pieces_).encode("utf-32-le"), "<u4")
    ends = np.cumsum(sizes)
    odd = ~np.any([(text >= a) & (text <= b) for a, b in _PLAIN], axis=0)
    # The zero that marks a piece that stands alone is no part of it.
    alone = np.zeros(len(pieces_), bool)
    full = np.flatnonzero(sizes)
    alone[full] = text[(ends - sizes)[full]] == 0
    odd[(ends - sizes)[alone]] = False
    count = np.concatenate([[0], np.cumsum(odd)])
    return (count[ends] == count[ends - sizes]) & (sizes - alone > 0)


def re_pair(ids: np.ndarray, offs: np.ndarray, min_uses: int = MIN_USES) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sequence, offsets of the rows in it, rules (pairs of symbols), first nonterminal.

    Symbol ``base + r`` stands for rule ``r``, whose two symbols are ids or earlier rules. Every round
    replaces the pairs with at least ``1 / NEAR_TOP`` of the uses of the most frequent one together; the
    rounds end when no pair has ``min_uses``. No chosen pair is left after its round, and none without a
    new symbol comes up, so once all with ``min_uses`` were chosen only pairs of later symbols count.
    """
    seq = ids.astype(np.uint32)
    offs = offs.astype(np.int64)
    base = int(seq.max()) + 1 if len(seq) else 0
    rules = np.zeros((0, 2), np.uint32)
    recent = 0  # pairs of two symbols before this one are settled
    while len(seq) >= 2:
        # Pairs fit 32 bits as long as all symbols fit 16.
        narrow = base + len(rules) <= 1 << 16
        kind, half = (np.uint32, 16) if narrow else (np.uint64, 32)
        stir, shift = (0x9E3779B1, 12) if narrow else (0x9E3779B97F4A7C15, 44)
        key = seq[:-1].astype(kind) << kind(half) | seq[1:].astype(kind)
        # No pair goes across rows: its second symbol is the first of a row.
        inner = offs[1:-1]
        across = np.zeros(len(key), bool)
        across[inner[(inner > 0) & (inner < len(seq))] - 1] = True
        near = None
        if recent:
            late = seq >= recent
            near = np.flatnonzero(late[:-1] | late[1:]).astype(np.int32)
            if not len(near):
                break
            key, across = key[near], across[near]

        def slots(lo: int) -> np.ndarray:
            """Hash of the pairs from ``lo`` on, the last one for those across rows."""
            some = (key[lo : lo + PLACES_AT_ONCE] * kind(stir) >> kind(shift)).astype(np.intp)
            some[across[lo : lo + PLACES_AT_ONCE]] = 1 << 20
            return some

        # Counts by hash leave few candidates, which are then counted exactly.
        count = np.zeros((1 << 20) + 1, np.int64)
        steps = range(0, len(key), PLACES_AT_ONCE)
        for lo in steps:
            count += np.bincount(slots(lo), minlength=len(count))
        count[-1] = 0
        # A slot counts all pairs with its hash, so it may promise too much, never too little.
        least = max(min_uses, int(count.max()) // NEAR_TOP)
        settled = least == min_uses
        frequent = count >= least
        spots = np.concatenate([(np.flatnonzero(frequent[slots(lo)]) + lo).astype(np.int32) for lo in steps])
        if not len(spots):
            break
        key = key[spots]
        if near is not None:
            spots = near[spots]
        ordered = np.sort(key)
        edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        pairs, uses = ordered[edges[:-1]], np.diff(edges)
        top = np.argsort(uses, kind="stable")[::-1]
        least = max(min_uses, int(uses.max()) // NEAR_TOP)
        pairs = pairs[top[uses[top] >= least]]
        if not len(pairs):
            break
        # Of pairs with one hash the most frequent stays; the others wait for the next round.
        pairs = pairs[::-1]
        rule_of = np.full((1 << 20) + 1, -1, np.int32)
        rule_of[(pairs * kind(stir) >> kind(shift)).astype(np.intp)] = np.arange(len(pairs))
        if settled and np.count_nonzero(rule_of >= 0) == len(pairs):
            recent = base + len(rules)
        which = rule_of[(key * kind(stir) >> kind(shift)).astype(np.int32)]
        chosen = which >= 0
        chosen[chosen] = pairs[which[chosen]] == key[chosen]
        spots, which = spots[chosen], which[chosen]
        del key, ordered, edges, across, near
        if not len(spots):
            break
        # Of pairs that overlap one another, every second one from the left is replaced.
        starts = np.concatenate([[True], np.diff(spots) != 1])
        place = np.arange(len(spots), dtype=np.int32)
        free = (place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0
        spots, which = spots[free], which[free]
        used = np.bincount(which, minlength=len(pairs)) > 0
        number = np.cumsum(used) - 1
        found = pairs[used]
        seq[spots] = (base + len(rules) + number).astype(np.uint32)[which]
        low = found & kind((1 << half) - 1)
        rules = np.vstack([rules, np.stack([found >> kind(half), low], 1).astype(np.uint32)])
        keep = np.ones(len(seq), bool)
        keep[spots + 1] = False
        offs = np.concatenate([[0], np.cumsum(keep)])[offs]
        seq = seq[keep]
    return seq, offs, rules, base


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids that every symbol from 0 on stands for, one after the other, and their offsets.

    Rules follow their symbols, so stretches of rules that name only earlier symbols are
    expanded together: about one stretch per round.
    """
    sizes = np.ones(base, np.int64)
    flat = np.arange(base, dtype=np.uint32)
    highest = rules.max(1) if len(rules) else np.zeros(0, np.uint32)
    at = 0
    while at < len(rules):
        later = np.flatnonzero(highest[at:] >= len(sizes))
        upto = at + int(later[0]) if len(later) else len(rules)
        pairs = rules[at:upto].ravel().astype(np.int64)
        offs = np.cumsum(sizes) - sizes
        flat = np.concatenate([flat, gathered(flat, offs[pairs], sizes[pairs])])
        sizes = np.append(sizes, sizes[pairs].reshape(-1, 2).sum(1))
        at = upto
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def expand(seq: np.ndarray, flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return gathered(flat, offs[seq], offs[seq + 1] - offs[seq])


def pack_shard(ids: np.ndarray, offs: np.ndarray) -> bytes:
    """Header (counts and widths), rules, expansion lengths, offsets of documents, sequence."""
    seq, at, rules, base = re_pair(ids, offs)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    lengths = np.diff(expansions(rules, base)[1])[base:]
    head = np.array([len(offs) - 1, len(ids), base, len(rules), len(seq), width], "<u8")
    parts = [rules.astype("<u4"), lengths.astype("<u4"), offs.astype("<u8"), at.astype("<u8"), seq.astype(f"<u{width}")]
    return MAGIC + head.tobytes() + b"".join(p.tobytes() for p in parts)


class Shard:
    """A packed shard. Documents are decoded one by one or all together."""

    def __init__(self, block: bytes):
        if block[:4] != MAGIC:
            raise ValueError("not a token shard")
        n_docs, self.n_tokens, base, n_rules, n_seq, width = np.frombuffer(block, "<u8", 6, 4).tolist()
        at = 4 + 48

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(block, kind, n, at)
            at += out.nbytes
            return out

        rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u4", n_rules)
        self.offs = take("<u8", n_docs + 1).astype(np.int64)
        self.at = take("<u8", n_docs + 1).astype(np.int64)
        self.seq = take(f"<u{width}", n_seq)
        self.rules, self.base = rules, base

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that symbols stand for, by the stored lengths."""
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.base
        out[rule] = self.lengths[symbols[rule] - self.base]
        return out

    def document(self, k: int) -> np.ndarray:
        """The ids of one document; only its own symbols are expanded, level by level."""
        part = self.seq[self.at[k] : self.at[k + 1]].astype(np.int64)
        while (rule := part >= self.base).any():
            where = np.cumsum(1 + rule) - (1 + rule)
            out = np.empty(len(part) + int(rule.sum()), np.int64)
            out[where] = part
            pairs = self.rules[part[rule] - self.base]
            out[where[rule]], out[where[rule] + 1] = pairs[:, 0], pairs[:, 1]
            part = out
        return part.astype(np.uint32)

    def token(self, i: int) -> int:
        """The id at place ``i`` of the shard: the stored lengths lead to its symbol, and in that
        symbol's rules down to it."""
        k = int(np.searchsorted(self.offs, i, "right")) - 1
        part = self.seq[self.at[k] : self.at[k + 1]].astype(np.int64)
        ends = np.cumsum(self._sizes(part))
        s = int(np.searchsorted(ends, i - self.offs[k], "right"))
        symbol, rest = int(part[s]), int(i - self.offs[k] - (ends[s - 1] if s else 0))
        while symbol >= self.base:
            left, right = (int(x) for x in self.rules[symbol - self.base])
            size = int(self._sizes(np.array([left]))[0])
            symbol, rest = (left, rest) if rest < size else (right, rest - size)
        return symbol

    def all(self) -> np.ndarray:
        return expand(self.seq.astype(np.int64), *expansions(self.rules, self.base))


SHARD_SCHEMA = "part int, nth int, n_docs long, n_tokens long, doc_ids binary, null_ids binary, block binary"


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in blocks of about ``BLOCK_BYTES`` of text, whatever the size of a batch; a longer text is a
    block of its own."""
    held: list[pa.RecordBatch] = []
    total = 0

    def block() -> pa.RecordBatch:
        out = pa.concat_batches(held) if len(held) > 1 else held[0]
        held.clear()
        return out

    for part, data, _ in pieces(batches, limit=BLOCK_BYTES):
        if held and total + len(data) > BLOCK_BYTES:
            yield block()
            total = 0
        held.append(part)
        total += len(data)
        del part, data
    if held:
        yield block()


def _shard_batches(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, tokenizer = TaskContext.get().partitionId(), 0, Tokenizer(path)
        # What is encoded and in no shard yet.
        keys: list[pa.Array] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal nth, total
            ids, n = np.concatenate(held), np.concatenate(sizes)
            held.clear()
            doc_ids = pa.concat_arrays(keys)
            row = [
                part, nth, len(n), len(ids), doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes(),
                np.asarray(doc_ids.is_null()).astype(np.uint8).tobytes(),
                pack_shard(ids, np.concatenate([[0], np.cumsum(n)])),
            ]
            nth, total = nth + 1, 0
            keys.clear(), sizes.clear()
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            names = ["part", "nth", "n_docs", "n_tokens", "doc_ids", "null_ids", "block"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for rows in _blocks(batches):
            ids, offs = tokenizer.encode_all(rows.column("text"), end_id)
            doc_ids = rows.column("doc_id")
            del rows
            lo = 0
            while lo < len(doc_ids):
                # Whole documents until the shard has its tokens.
                hi = min(int(np.searchsorted(offs, offs[lo] + shard_tokens - total)), len(doc_ids))
                held.append(ids[offs[lo] : offs[hi]])
                sizes.append(np.diff(offs[lo : hi + 1]))
                keys.append(doc_ids.slice(lo, hi - lo))
                total += len(held[-1])
                lo = hi
                if total >= shard_tokens:
                    yield flush()
            # What is left waits for the next block; the rest of this one goes.
            held[:] = [x.copy() for x in held]
            del ids, offs
            give_back()
        if total:
            yield flush()
        del tokenizer
        give_back()

    return run


def write_shards(
    docs: DataFrame, path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None
) -> DataFrame:
    """Writes the shards of all rows in ascending id order (null ids first, equal ids by the first
    characters of their text, then by its hash) and returns the table of the files. Null texts come first
    and are empty: their end id alone. Rows that agree in all are dealt by their place, so a repeated or
    missing id is no hot key."""
    spark = docs.sparkSession
    bounded_batches(spark, FILE_BATCH_BYTES)
    # Half the usual number of ranges: the more texts a block has, the fewer distinct pieces for each of them.
    n = partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", "_head", "_hash", "_place"]
    placed = rows.withColumns({
        "_head": F.substring("text", 1, 64), "_hash": F.xxhash64("text"), "_place": F.monotonically_increasing_id()
    })
    ordered = placed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return stored(ordered.mapInArrow(_shard_batches(path, end_id, shard_tokens), SHARD_SCHEMA))


def shard_starts(shards: DataFrame) -> DataFrame:
    """``part, nth, start``: tokens before each shard, from sums per range partition."""
    sizes = shards.select("part", "nth", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per range partition, whatever the number of documents.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("nth")) - F.col("n_tokens")
    return sizes.withColumn("_in", inside).join(parts.select("part", before.alias("_before")), "part").select(
        "part", "nth", (F.col("_before") + F.col("_in")).alias("start")
    )


def _document_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            start, doc_ids, nulls, block = (batch.column(c)[row].as_py() for c in ("start", "doc_ids", "null_ids", "block"))
            shard = Shard(block)
            ids = shard.all().astype("<u4")
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(shard.offs[:-1], shard.offs[1:], strict=True)]
            mask = np.frombuffer(nulls, np.uint8).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(doc_ids, "<i8"), mask=mask), pa.array(start + shard.offs[:-1]),
                 pa.array(np.diff(shard.offs)), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all documents, decoded from the files."""
    bounded_batches(shards.sparkSession)
    placed = shards.select("part", "nth", "doc_ids", "null_ids", "block").join(shard_starts(shards), ["part", "nth"])
    return placed.select("start", "doc_ids", "null_ids", "block").mapInArrow(
        _document_batches, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_digest(docs: DataFrame, path: str) -> DataFrame:
    """Write the shards of ``docs`` and read them back. An empty table gives an empty result."""
    return read_documents(write_shards(docs, path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op4_token_files")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"), default_path())
