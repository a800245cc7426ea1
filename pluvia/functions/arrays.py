"""Operations on packed frames and rays: one row holds one dense array.

Packing keeps a frame's cells in one row, so stencils, pooling and cropping need
no shuffle. Arrays are row-major: cell ``(i, j)`` is element ``i * nj + j``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def positions(n: int) -> Column:
    """``[0, ..., n-1]``; empty for ``n = 0``."""
    return F.sequence(F.lit(0), F.lit(n - 1)) if n > 0 else F.array().cast("array<int>")


def int_div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("int")


def map_values(values: Column, fn: Callable[[Column], Column]) -> Column:
    """Apply a scalar column function to every cell."""
    return F.transform(values, fn)


def clip_index(k: Column, n: int) -> Column:
    return F.greatest(F.least(k, F.lit(n - 1)), F.lit(0))


def crop_centre(values: Column, ni: int, nj: int, size: int) -> Column:
    """Middle ``size x size`` block; an odd remainder leaves the extra cell at the end."""
    if ni < size or nj < size:
        raise ValueError("crop is larger than the frame")
    top, left = (ni - size) // 2, (nj - size) // 2
    rows = F.transform(
        positions(size), lambda r: F.slice(values, (r + top) * nj + left + 1, size)
    )
    return F.flatten(rows)


def pad_centre(values: Column, ni: int, nj: int, size: int) -> Column:
    """Surround the frame with zeros up to ``size x size``."""
    if ni > size or nj > size:
        raise ValueError("target is smaller than the frame")
    top, left = (size - ni) // 2, (size - nj) // 2
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    rows = F.transform(
        positions(ni),
        lambda r: F.concat(zeros(left), F.slice(values, r * nj + 1, nj), zeros(size - nj - left)),
    )
    return F.concat(zeros(top * size), F.flatten(rows), zeros((size - ni - top) * size))


def subgrid(values: Column, nj: int, i1: int, i2: int, j1: int, j2: int) -> Column:
    """Rows ``i1..i2-1`` and columns ``j1..j2-1``."""
    rows = F.transform(
        F.sequence(F.lit(i1), F.lit(i2 - 1)), lambda r: F.slice(values, r * nj + j1 + 1, j2 - j1)
    )
    return F.flatten(rows)


def downsample4(values: Column, ni: int, nj: int) -> Column:
    """Quarter-size frame: each cell is the mean of the middle 2x2 of a 4x4 block."""
    oi, oj = ni // 4, nj // 4

    def block(k: Column) -> Column:
        first = (int_div(k, oj) * 4 + 1) * nj + F.pmod(k, F.lit(oj)) * 4 + 1
        a, b = F.get(values, first), F.get(values, first + 1)
        c, d = F.get(values, first + nj), F.get(values, first + nj + 1)
        return (a + b + c + d) / 4

    return F.transform(positions(oi * oj), block)


def max_pool(values: Column, ni: int, nj: int, kernel: int = 5, stride: int = 2) -> Column:
    """Maximum over sliding windows that lie fully inside the frame."""
    oi, oj = (ni - kernel) // stride + 1, (nj - kernel) // stride + 1
    if oi <= 0 or oj <= 0:
        return F.array().cast("array<double>")

    def window(k: Column) -> Column:
        first = int_div(k, oj) * (stride * nj) + F.pmod(k, F.lit(oj)) * stride
        rows = [F.array_max(F.slice(values, first + r * nj + 1, kernel)) for r in range(kernel)]
        return F.greatest(*rows) if kernel > 1 else rows[0]

    return F.transform(positions(oi * oj), window)


def smooth_symmetric(values: Column, window: int) -> Column:
    """Moving average along an array, edges mirrored (edge element included)."""
    before, after = window // 2, (window - 1) // 2
    n = F.size(values)
    head = F.reverse(F.slice(values, 1, before)) if before else F.slice(values, 1, 0)
    tail = (
        F.reverse(F.slice(values, F.greatest(n - after + 1, F.lit(1)), after))
        if after
        else F.slice(values, 1, 0)
    )
    padded = F.concat(head, values, tail)
    return F.transform(
        F.sequence(F.lit(1), n),
        lambda k: F.aggregate(F.slice(padded, k, window), F.lit(0.0), lambda s, v: s + v) / window,
    )


def every_nth(values: Column, n: int, start: int = 0) -> Column:
    """De-interleave: elements ``start, start+n, ...``."""
    return F.filter(values, lambda _, k: F.pmod(k, F.lit(n)) == start)
