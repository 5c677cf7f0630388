"""Space-filling-curve keys as Column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from curvespace.functions.quantize import bucket_of, quantize
from curvespace.params import SfcParams


def _spread(v: Column, bits: int, step: int) -> Column:
    """Bit i of ``v`` moved to bit ``step * i``."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(v, i).bitwiseAND(F.lit(1).cast("long")), step * i))
    return out


def _table(v: Column, bits: int, step: int) -> Column:
    """The same by looking ``v`` up in the list of all spread numbers: one reference to ``v``, so keys of computed
    cells stay small expressions."""
    spread = [sum((n >> i & 1) << (step * i) for i in range(bits)) for n in range(1 << bits)]
    return F.get(F.expr(f"array({', '.join(f'{n}L' for n in spread)})"), v.cast("int"))


def spread3(v: Column, bits: int) -> Column:
    return _spread(v, bits, 3) if bits > 10 else _table(v, bits, 3)


def spread2(v: Column, bits: int) -> Column:
    return _spread(v, bits, 2) if bits > 10 else _table(v, bits, 2)


def morton3(x: Column, y: Column, z: Column, bits: int = 10) -> Column:
    """Three-dimensional Morton key, x before y before z at every bit, most significant bits first."""
    return F.shiftleft(spread3(x, bits), 2) + F.shiftleft(spread3(y, bits), 1) + spread3(z, bits)


def morton2(x: Column, y: Column, bits: int = 10) -> Column:
    """Two-dimensional Morton key, x before y."""
    return F.shiftleft(spread2(x, bits), 1) + spread2(y, bits)


def _turns(bits: int) -> tuple[list[int], list[int]]:
    """Digits and next state of the two-dimensional Hilbert curve over ``bits`` levels, for (state << 2 * bits) + (x << bits) + y. A state
    says whether the axes are exchanged (1) and whether both run backwards (2) within a square."""
    digits, after = [], []
    for state in range(4):
        for cell in range(1 << 2 * bits):
            at, d = state, 0
            for i in range(bits - 1, -1, -1):
                x, y = cell >> bits + i & 1, cell >> i & 1
                x, y = (y, x) if at & 1 else (x, y)
                x, y = (1 - x, 1 - y) if at & 2 else (x, y)
                d = 4 * d + (3 * x ^ y)
                at = at if y else at ^ 1 ^ 2 * x
            digits.append(d)
            after.append(at)
    return digits, after


def hilbert2(x: Column, y: Column, bits: int = 10) -> Column:
    """Place of cell (x, y) along the two-dimensional Hilbert curve of order ``bits``; :func:`hilbert_xy` is its inverse. The state of
    the square passes down the levels, five at a time, so the first digits are the place of the square around the cell."""
    state, d, left = F.lit(0).cast("long"), F.lit(0).cast("long"), bits
    while left:
        n = left % 5 or 5
        left -= n
        digits, after = (F.expr(f"array({', '.join(f'{v}L' for v in t)})") for t in _turns(n))
        own = lambda v: F.shiftright(v, left).bitwiseAND(F.lit((1 << n) - 1).cast("long"))  # noqa: B023, E731
        at = (F.shiftleft(state, 2 * n) + F.shiftleft(own(x), n) + own(y)).cast("int")
        d, state = F.shiftleft(d, 2 * n) + F.get(digits, at), F.get(after, at)
    return d


def take_bits(key: Column, total: int, take: int) -> Column:
    """The first ``take`` of ``total`` bits of a key, the others zero."""
    return F.shiftleft(F.shiftright(key, total - take), total - take)


def cells(p: SfcParams, lat: Column, lon: Column, t: Column) -> tuple[Column, Column, Column]:
    """Cell numbers on the three axes; the last is the time bucket for bucketed keys."""
    x, y = quantize(lat, *p.lat, p.bits, p.floors), quantize(lon, *p.lon, p.bits, p.floors)
    if p.bucketed:
        return x, y, bucket_of(t, p.time[0], p.bucket_s, p.num_buckets)
    return x, y, quantize(F.greatest(t, F.lit(p.time[0])), *p.time, p.bits, p.floors)


def key_of_cells(p: SfcParams, x: Column, y: Column, z: Column) -> Column:
    if p.bucketed:
        return F.shiftleft(z, 2 * p.bits) + plane_key(p, x, y)
    return morton3(x, y, z, p.bits)


def plane_key(p: SfcParams, x: Column, y: Column) -> Column:
    """The two-dimensional part of a bucketed key."""
    return hilbert2(x, y, p.bits) if p.true_hilbert else morton2(x, y, p.bits)


def keys_of(p: SfcParams, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """:func:`key_of_cells` for arrays of cells inside a task."""

    def spread(v: np.ndarray, step: int) -> np.ndarray:
        return sum((v >> i & 1) << step * i for i in range(p.bits))

    if not p.bucketed:
        return (spread(x, 3) << 2) + (spread(y, 3) << 1) + spread(z, 3)
    if not p.true_hilbert:
        return (z << 2 * p.bits) + (spread(x, 2) << 1) + spread(y, 2)
    state, d, left = np.zeros_like(x), np.zeros_like(x), p.bits
    while left:
        n = left % 5 or 5
        left -= n
        digits, after = (np.array(t, np.int64) for t in _turns(n))
        at = (state << 2 * n) + ((x >> left & (1 << n) - 1) << n) + (y >> left & (1 << n) - 1)
        d, state = (d << 2 * n) + digits[at], after[at]
    return (z << 2 * p.bits) + d


def encode(p: SfcParams, lat: Column, lon: Column, t: Column) -> Column:
    """Curve key of a point; ``h3`` and ``h2t`` are Morton keys too, with rounded cells, unless ``true_hilbert`` is set."""
    return key_of_cells(p, *cells(p, lat, lon, t))


def block_id(key: Column, block_bits: int = 6) -> Column:
    """Number of the aligned block of ``2**block_bits`` keys."""
    return F.shiftright(key, block_bits)


def hilbert_xy(d: Column, bits: int) -> tuple[Column, Column]:
    """Cell (x, y) of step ``d`` along the two-dimensional Hilbert curve of order ``bits``."""
    x = y = state = F.lit(0).cast("long")
    left = bits
    while left:
        n = left % 5 or 5
        left -= n
        digits, after = _turns(n)
        cell, turned = [0] * len(digits), [0] * len(digits)
        for at, own in enumerate(digits):
            place = (at >> 2 * n << 2 * n) + own
            cell[place], turned[place] = at & (1 << 2 * n) - 1, after[at]
        cells, states = (F.expr(f"array({', '.join(f'{v}L' for v in t)})") for t in (cell, turned))
        at = (F.shiftleft(state, 2 * n) + F.shiftright(d, 2 * left).bitwiseAND(F.lit((1 << 2 * n) - 1).cast("long"))).cast("int")
        got = F.get(cells, at)
        x, y, state = F.shiftleft(x, n) + F.shiftright(got, n), F.shiftleft(y, n) + got.bitwiseAND(F.lit((1 << n) - 1).cast("long")), F.get(states, at)
    return x, y
