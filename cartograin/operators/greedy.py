"""The greedy rule over many tiles at once, in numpy: who leads, who joins whom, and what can't be told within a tile.

Points are held by half cells (tiles cut into squares of half a radius), in the order of their keys. Any two points of a half
cell are within the radius of each other, so only the earliest undecided one of each can be next; it is decided when no half
cell within reach holds an earlier undecided one that could touch it. A new leader is compared once with the points in the
half cells around it. So pairs of points are never listed, and work grows with points times leaders within reach, which
the radius bounds.
"""

from __future__ import annotations

import numpy as np

#: Half cells in a row of a tile's numbering: more than any tile and its margin have.
ROW = 256
#: Open points of a half cell that are told apart; of more, only the earliest counts, for all within reach.
APART = 64
LAST = np.iinfo(np.int64).max
_AROUND = np.array([a * ROW + b for a in range(-2, 3) for b in range(-2, 3)], np.int64)


def _spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges start to end the number of each range and the places in it, one after the other."""
    size = end - start
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start, size)


def decided(tile: np.ndarray, i: np.ndarray, j: np.ndarray, key: np.ndarray, x: np.ndarray, y: np.ndarray, lead: np.ndarray, sure: np.ndarray, r: float, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    """(leader, known) of each point: the place of its leader among them, and whether that can be told.

    tile: a number for each tile; i, j: the point's half cell within it, from 2 to ROW - 3; lead: known leaders, earlier than
    all points; sure: whether a point may lead, that is, whether all earlier points in its radius are here. strict: only what
    is nearer than r is within the radius. Known leaders get no answer.
    """
    code = (tile * ROW + i) * ROW + j
    order = np.lexsort((key, ~lead, code))
    code, key, x, y, lead, sure = (v[order] for v in (code, key, x, y, lead, sure))
    n = len(code)
    first = np.flatnonzero(np.diff(code, prepend=code[:1] - 1))
    cells, ends = code[first], np.append(first[1:], n)
    own = np.repeat(np.arange(len(first)), ends - first)
    at = np.searchsorted(cells, (cells[:, None] + _AROUND).ravel())
    at[at == len(cells)] = 0
    at = at.reshape(-1, len(_AROUND))
    at[cells[at] != cells[:, None] + _AROUND] = -1
    undecided, best, barred = ~lead, np.full(n, LAST), np.full(n, LAST)
    leads = lead.copy()

    def within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = ((x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2) ** 0.5
        return d < r if strict else d <= r

    def reach(points: np.ndarray, marks: np.ndarray, crowd: np.ndarray | None = None) -> np.ndarray:
        """Lowers marks of later points within the radius to the points' keys (of crowded ones, of all later points around)."""
        around = at[own[points]]
        which, slot = np.nonzero(around >= 0)
        cell = around[which, slot]
        span, other = _spans(first[cell], ends[cell])
        point = points[which[span]]
        later = ~lead[other] & (lead[point] | (key[other] > key[point]))
        point, other = point[later], other[later]
        met = within(point, other) if crowd is None else within(point, other) | crowd[point]
        point, other = point[met], other[met]
        np.minimum.at(marks, other, key[point])
        return other

    known = np.flatnonzero(lead)
    if len(known):
        undecided[reach(known, best)] = False
    waiting, crowd = np.full(len(cells), LAST), np.zeros(n, bool)
    while True:
        left = np.flatnonzero(undecided)
        if not len(left):
            break
        heads = np.flatnonzero(np.diff(own[left], prepend=-1))
        nexts, cell = left[heads], own[left[heads]]
        many = np.diff(np.append(heads, len(left))) > 1
        waiting[:] = LAST
        waiting[cell] = np.arange(len(nexts))
        around = at[cell]
        other = np.where(around >= 0, waiting[around], LAST)
        which, slot = np.nonzero(other != LAST)
        rival = other[which, slot]
        before = key[nexts[rival]] < key[nexts[which]]
        which, rival = which[before], rival[before]
        touches = many[rival] | within(nexts[rival], nexts[which])
        ready = np.ones(len(nexts), bool)
        ready[which[touches]] = False
        new = nexts[ready & sure[nexts] & (barred[nexts] == LAST)]
        leads[new] = True
        undecided[new] = False
        if len(new):
            undecided[reach(new, best)] = False
        shut = nexts[ready & ~leads[nexts] & undecided[nexts]]
        if len(shut):  # all that is left of these half cells is within the radius of an open point
            span, place = _spans(first[own[shut]], ends[own[shut]])
            place = place[undecided[place]]
            undecided[place] = False
            heads = np.flatnonzero(np.diff(own[place], prepend=-1))
            sizes = np.diff(np.append(heads, len(place)))
            crowd[place[heads]] = sizes > APART
            told = np.repeat(sizes <= APART, sizes)
            told[heads] = True
            reach(place[told], barred, crowd)
    leader = np.where(leads, key, best)
    sure_of = leads | ((best != LAST) & (best < barred))
    out, told = np.zeros(n, np.int64), np.zeros(n, bool)
    told[order] = sure_of
    if sure_of.any():  # from keys to places: both by tile and the key's rank
        keys, rank = np.unique(key, return_inverse=True)
        by = tile[order] * len(keys)
        sort = np.argsort(by + rank)
        at = sort[np.searchsorted((by + rank)[sort], by[sure_of] + np.searchsorted(keys, leader[sure_of]))]
        out[order[sure_of]] = order[at]
    return out, told
