"""Blocks of a curve refined to the boxes of windows: what a task of :func:`curvespace.operators.cover.fine_cover` does with its windows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa

from curvespace.functions.curves import keys_of
from curvespace.params import SfcParams

#: Blocks that are refined at once; a window that may need more is refined by itself.
TOGETHER = 250_000

Ranges = tuple[np.ndarray, np.ndarray, np.ndarray]


def refined(box: np.ndarray, owner: np.ndarray, p: SfcParams, fine: int, budget: int) -> Ranges:
    """``owner, lo, hi`` of the blocks that hold the boxes, columns of ``box`` (least and greatest x, y, z), as
    :func:`curvespace.operators.cover.fine_cover` tells; the boxes of an owner share its budget."""
    axes = 2 if p.bucketed else 3
    of, z, last = np.arange(box.shape[1]), np.zeros(box.shape[1], np.int64), np.zeros(box.shape[1], np.int64)
    open_ = np.ones(len(of), bool)
    if p.bucketed:
        x0, x1, y0, y1, z0, z1 = box
        side = 2**p.bits - 1
        whole = ((x0 <= 0) & (y0 <= 0) & (x1 >= side) & (y1 >= side)) | (z1 - z0 >= budget)
        many = np.where(whole, 1, z1 - z0 + 1)
        of = np.repeat(of, many)
        z = z0[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        last, open_ = np.where(whole[of], z1[of], z), ~whole[of]
    at = np.stack([np.zeros_like(z), np.zeros_like(z), z])
    done = [(of[~open_], at[:, ~open_], last[~open_], p.bits)]
    of, at = of[open_], at[:, open_]
    held = np.bincount(owner[done[0][0]], minlength=owner.max() + 1)
    for s in range(p.bits, fine, -1):
        half = 1 << s - 1
        low, high = box[0 : 2 * axes : 2, of], box[1 : 2 * axes : 2, of]
        place = at[:axes]
        excess = (1 << s * axes) - (np.minimum(place + 2 * half - 1, high) - np.maximum(place, low) + 1).prod(0)
        kids = ((low < place + half).astype(np.int64) + (high >= place + half)).prod(0) - 1
        own = owner[of]
        grown = held + np.bincount(own, minlength=len(held))
        split = excess > 0
        if (grown + np.bincount(own, weights=kids * split, minlength=len(held)).astype(np.int64) > budget).any():
            order = np.lexsort((at[1], at[0], at[2], -excess, ~split, own))
            first = np.searchsorted(own[order], own[order])
            more = np.cumsum((kids * split)[order])
            more -= np.where(first > 0, more[first - 1], 0)
            split[order] &= grown[own[order]] + more <= budget
        stays = ~split
        done.append((of[stays], at[:, stays], at[2, stays], s))
        held = held + np.bincount(own[stays], minlength=len(held))
        parts = []
        for d in product((0, 1), repeat=axes):
            child = at[:, split] + half * np.array([*d, *[0] * (3 - axes)])[:, None]
            meets = ((child[:axes] + half - 1 >= low[:, split]) & (child[:axes] <= high[:, split])).all(0)
            parts.append((of[split][meets], child[:, meets]))
        of, at = np.concatenate([o for o, _ in parts]), np.concatenate([a for _, a in parts], axis=1)
    done.append((of, at, at[2], fine))
    of, at, last = (np.concatenate([d[i] for d in done], axis=-1) for i in range(3))
    s = np.repeat([d[3] for d in done], [len(d[0]) for d in done])
    # a block's keys are one stretch of the curve, which its corner's key shows when the digits within the block are cut off
    lo = keys_of(p, *at) >> axes * s << axes * s
    hi = lo + (1 << axes * s) - 1
    if p.bucketed:
        lo, hi = np.where(last > at[2], at[2] << 2 * p.bits, lo), np.where(last > at[2], (last + 1 << 2 * p.bits) - 1, hi)
    return owner[of], lo, hi


def merged(own: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Ranges:
    """Ranges of one owner that overlap or touch as one, by owner and start."""
    order = np.lexsort((lo, own))
    own, lo, hi = own[order], lo[order], hi[order]
    tops, rank = np.unique(hi, return_inverse=True)
    top = tops[np.maximum.accumulate(own * len(tops) + rank) - own * len(tops)]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (lo[1:] > top[:-1] + 1)
    return own[new], lo[new], top[np.append(new[1:], True)]


def widest(own: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int) -> Ranges:
    """:func:`merged` ranges as at most ``most`` an owner: the widest gaps between them stay, the first of equals."""
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    gap = np.where(new, -1, lo - np.roll(hi, 1))
    order = np.lexsort((lo, -gap, own))
    place = np.arange(len(own)) - np.searchsorted(own, own)  # owners stand at the same places in both orders
    new[order] |= place < most - 1
    return own[new], lo[new], hi[np.append(new[1:], True)]


def ranges_of(p: SfcParams, fine: int, budget: int, most: int | None):
    """A function for ``mapInArrow``: batches of ``name, boxes`` (lists of the corners of boxes) to ``name, lo, hi``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            owner = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            flat = lists.flatten()
            box = np.stack([flat.field(i).to_numpy() for i in range(6)])
            wide = [(box[2 * i + 1] >> s) - (box[2 * i] >> s) + 1 for i, s in enumerate((fine, fine, 0 if p.bucketed else fine))]
            need = np.minimum(wide[0] * wide[1] * wide[2], budget)
            chunk = np.cumsum(np.bincount(owner, weights=need, minlength=b.num_rows)) // TOGETHER
            for c in np.unique(chunk):
                names = np.flatnonzero(chunk == c)
                mine = (owner >= names[0]) & (owner <= names[-1])
                got = merged(*refined(box[:, mine], owner[mine] - names[0], p, fine, budget))
                own, lo, hi = got if most is None else widest(*got, most)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own + names[0])), pa.array(lo), pa.array(hi)], names=["name", "lo", "hi"])

    return run
