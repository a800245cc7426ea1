"""Character n-grams and interpolated Kneser-Ney estimates for models with several classes.

A text is read as lower-case letters, with one space for everything between them. An n-gram of
``order`` characters is one 64-bit number: the characters' places in the model's alphabet, at
``60 // order`` bits each; hashes of it (one to one) are what the sorted tables hold. Every character
has a place of its own: where the alphabet is too wide for an order, the order is lowered
(``fitting_order``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from pluvia.llm.textarrays import SortedHashes, mixed, pieces

SPACE = 0x20


_LETTERS: dict[bool, np.ndarray] = {}


def letters(digits: bool = False) -> np.ndarray:
    """Lower-case letter (or digit) of every code point of the basic plane; a space if it is none."""
    if digits not in _LETTERS:
        out = np.full(1 << 16, SPACE, np.uint32)
        for c in range(1 << 16):
            if chr(c).isalpha() or digits and chr(c).isalnum():
                out[c] = ord(chr(c).lower()[0])
        _LETTERS[digits] = out
    return _LETTERS[digits]


def lowered(cp: np.ndarray, digits: bool = False) -> np.ndarray:
    """:func:`letters` of code points of all planes."""
    out = letters(digits)[np.minimum(cp, 0xFFFF)]
    wide = np.flatnonzero(cp >= 1 << 16)
    if len(wide):
        kinds, at = np.unique(cp[wide], return_inverse=True)
        chars = [chr(c) for c in kinds.tolist()]
        own = [ord(c.lower()[0]) if c.isalpha() or digits and c.isalnum() else SPACE for c in chars]
        out[wide] = np.array(own, np.uint32)[at]
    return out


def code_points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the offsets of the rows among them."""
    if not len(data):
        return np.zeros(0, np.uint32), offs
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    out = data[lead].astype(np.uint32)
    wide = np.flatnonzero(out >= 0xC0)
    if len(wide):
        first, at = out[wide], lead[wide]
        nxt = [data[np.minimum(at + k, len(data) - 1)].astype(np.uint32) & 0x3F for k in (1, 2, 3)]
        two = (first & 0x1F) << 6 | nxt[0]
        three = (first & 0x0F) << 12 | nxt[0] << 6 | nxt[1]
        four = (first & 0x07) << 18 | nxt[0] << 12 | nxt[1] << 6 | nxt[2]
        out[wide] = np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))
    return out, np.searchsorted(lead, offs)


def letter_stream(
    data: np.ndarray, offs: np.ndarray, pad: int, digits: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and single spaces of all rows, each after ``pad`` spaces and before one.

    Returns the characters, the rows' offsets (at the first pad), and which rows have a letter.
    """
    cp, at = code_points(data, offs)
    low = lowered(cp, digits)
    gap = low == SPACE
    keep = ~gap
    # A space stays where it follows a letter of the same row.
    first = np.zeros(len(low) + 1, bool)
    first[at] = True
    keep[1:] |= gap[1:] & ~gap[:-1] & ~first[1:-1]
    kept = low[keep]
    upto = np.concatenate([[0], np.cumsum(keep)])[at]
    rows = np.arange(len(at))
    offs_out = upto + rows * (pad + 1)
    out = np.full(offs_out[-1], SPACE, np.uint32)
    row_of = np.repeat(rows[:-1], np.diff(upto))
    out[np.arange(len(kept)) + (row_of + 1) * pad + row_of] = kept
    return out, offs_out, np.diff(upto) > 0


def fitting_order(n_chars: int, order: int) -> int:
    """The longest n-grams, up to ``order``, that keep ``n_chars`` characters apart."""
    while order > 1 and (1 << (60 // order)) - 2 < n_chars:
        order -= 1
    return order


def alphabet_table(chars: np.ndarray, order: int) -> np.ndarray:
    """Place of each code point in the alphabet: 1, 2, ...; the last entry, which stands for all code
    points beyond the table, and those between are unknown."""
    if fitting_order(len(chars), order) != order:
        raise ValueError(f"{len(chars)} characters need a lower order than {order}")
    size = max([1 << 16, *(int(c) + 2 for c in chars)])
    out = np.full(size, (1 << (60 // order)) - 1, np.uint32)
    out[chars] = np.arange(1, len(chars) + 1)
    return out


def packed(ids: np.ndarray, order: int) -> np.ndarray:
    """n-gram that ends at each position from ``order - 1`` on."""
    bits = np.uint64(60 // order)
    n = max(len(ids) - order + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(order):
        out = out << bits | ids[k : k + n]
    return out


def row_grams(data, offs, table, order, in_word=False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of all rows (one per letter, space or end), the rows' offsets among them, letters.

    With ``in_word`` an n-gram does not reach back over the space before its word; it is then
    shorter and begins with that space.
    """
    stream, at, has = letter_stream(data, offs, order - 1)
    ids = table[np.minimum(stream, len(table) - 1)].astype(np.uint64)
    grams = packed(ids, order)
    if in_word and len(grams):
        last = np.maximum.accumulate(np.where(stream == SPACE, np.arange(len(stream), dtype=np.int32), 0))
        reach = np.arange(order - 1, len(stream)) - last[order - 2 : -1] + 1
        bits = 60 // order
        masks = np.array([(1 << bits * k) - 1 for k in range(order + 1)], np.uint64)
        grams &= masks[np.minimum(reach, order)]
    inside = np.ones(len(grams), bool)
    # n-grams that begin in the last order - 1 characters of a row belong to two rows.
    for k in range(1, order):
        where = at[1:-1] - k
        inside[where[(where >= 0) & (where < len(grams))]] = False
    sizes = np.maximum(np.diff(at) - (order - 1), 0)
    return grams[inside], np.concatenate([[0], np.cumsum(sizes)]), has


def char_count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``c, n``: how often each character occurs."""
    for _, data, offs in pieces(batches):
        c, n = np.unique(letter_stream(data, offs, 0)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)), pa.array(n)], ["c", "n"])


def gram_count_batches(table: np.ndarray, order: int, column: str, in_word: bool = False):
    """``cls, gram, n`` of rows with a class number in ``column``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in pieces(batches):
            grams, at, _ = row_grams(data, offs, table, order, in_word)
            of_row = rows.column(column).to_numpy(zero_copy_only=False)
            cls = np.repeat(of_row, np.diff(at))
            for c in np.unique(of_row):
                g, n = np.unique(grams[cls == c], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(g), c, np.int64)), pa.array(g.view(np.int64)), pa.array(n)], ["cls", "gram", "n"]
                )

    return run


class Level:
    """Estimates of one order for all classes, over the n-grams that any class has.

    ``mass`` is what a class gives to the n-gram itself, ``backoff`` (by context) what it
    leaves to the shorter one; ``p`` is the interpolated probability.
    """

    def __init__(self, grams, mass, contexts, backoff, p):
        self.grams, self.mass, self.contexts, self.backoff, self.p = grams, mass, contexts, backoff, p


def _discount(n: np.ndarray) -> float:
    n1, n2 = (n == 1).sum(), (n == 2).sum()
    return float(n1 / (n1 + 2 * n2)) if n1 and n2 else 0.5


def _added(classes: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([g for g, _ in classes]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([n for _, n in classes]), len(grams))


def kneser_ney(
    counts: list[tuple[np.ndarray, np.ndarray]], order: int, n_chars: int, shared=False, spreads=0.0, expected=0.0
) -> list[Level]:
    """Levels of lengths 1 to ``order`` from ``(n-grams in order, counts)`` of every class.

    An n-gram backs off to the one without its first character, which counts in how many
    contexts it goes on. With ``shared`` these counts are of all classes together, so that the
    classes differ only in the n-grams that were counted. Those are discounted by ``spreads``
    times their root and ``expected`` times the count that the classes together let expect, if
    either is given, else by a constant.
    """
    bits = 60 // order
    everyone, number = _added(counts)
    levels: list[Level] = []
    todo = []
    none = np.zeros(0, np.uint64), np.zeros(0)
    gone_on = [none] * len(counts)
    for k in range(order, 0, -1):
        classes = []
        for (g, n), below in zip(counts, gone_on, strict=True):
            own = (g >> np.uint64(bits * (k - 1)) > 0) & (g >> np.uint64(bits * k) == 0 if k < order else True)
            g, n = g[own], n[own].astype(float)
            cut = np.full(len(g), _discount(n))
            if spreads or expected:
                total = sum(x.sum() for x in (c[1] for c in counts))
                usual = number[np.searchsorted(everyone, g)] * counts[len(classes)][1].sum() / total
                cut = spreads * np.sqrt(n) + expected * usual
            other = np.full(len(below[0]), _discount(below[1]))
            grams = np.concatenate([g, below[0]])
            classes.append((grams, np.concatenate([n, below[1]]), np.concatenate([cut, other])))
        todo.append(classes)
        mask = np.uint64((1 << bits * (k - 1)) - 1)
        if shared:
            gone_on = [np.unique(np.unique(np.concatenate([g for g, _, _ in classes])) & mask, return_counts=True)] * len(counts)
        else:
            gone_on = [np.unique(np.unique(g) & mask, return_counts=True) for g, _, _ in classes]
    for k, classes in enumerate(reversed(todo), 1):
        grams = np.unique(np.concatenate([g for g, _, _ in classes]))
        contexts = np.unique(grams >> np.uint64(bits))
        mass = np.zeros((len(grams), len(classes)))
        backoff = np.ones((len(contexts), len(classes)))
        for c, (g, n, cut) in enumerate(classes):
            if not len(g):
                continue
            kept = np.maximum(n - cut, 0)
            at = np.searchsorted(contexts, g >> np.uint64(bits))
            total = np.bincount(at, n, len(contexts))
            mass[np.searchsorted(grams, g), c] = kept / total[at]
            rest = np.bincount(at, n - kept, len(contexts))
            has = total > 0
            backoff[has, c] = rest[has] / total[has]
        own = backoff[np.searchsorted(contexts, grams >> np.uint64(bits))] if len(grams) else backoff[:0]
        if k == 1:
            shorter = np.full((len(grams), len(classes)), 1 / (n_chars + 1))
        else:
            mask = np.uint64((1 << bits * (k - 1)) - 1)
            shorter = levels[-1].p[np.searchsorted(levels[-1].grams, grams & mask)]
        levels.append(Level(grams, mass, contexts, backoff, mass + own * shorter))
    return levels


def hashed(keys: np.ndarray, values: np.ndarray) -> tuple[SortedHashes, np.ndarray]:
    """A sorted hash array of ``keys`` with the values in its order."""
    h = mixed(keys)
    order = np.argsort(h)
    return SortedHashes(h[order]), values[order]
