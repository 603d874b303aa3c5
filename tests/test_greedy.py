"""The vectorised greedy rule against a plain loop over the points in order, with what can't be told near a tile's edge."""

import numpy as np
import pytest

from cartograin.operators import greedy


def in_order(tile, key, x, y, lead, sure, r, strict):
    """Leader of each point, None where an earlier open point could matter."""
    out = {}
    for t in set(tile):
        own = [k for k in range(len(key)) if tile[k] == t]
        leads, open_ = [k for k in own if lead[k]], []
        for p in sorted((k for k in own if not lead[k]), key=lambda k: key[k]):
            near = lambda ks: [key[q] for q in ks if (d := ((x[p] - x[q]) ** 2 + (y[p] - y[q]) ** 2) ** 0.5) < r or d == r and not strict]  # noqa: B023, E731
            first, barred = min(near(leads), default=None), min(near(open_), default=None)
            if first is not None:
                out[p] = first if barred is None or first < barred else None
            elif barred is None and sure[p]:
                leads.append(p)
                out[p] = key[p]
            else:
                open_.append(p)
                out[p] = None
    return out


@pytest.mark.parametrize("seed", range(60))
def test_rule(seed):
    rng = np.random.default_rng(seed)
    n, r, strict = int(rng.integers(0, 250)), 0.03 * rng.choice([1, 2, 5]), bool(rng.integers(2))
    tile, key = rng.integers(0, 3, n), rng.permutation(10 * n + 1)[:n].astype(np.int64)
    x, y = (rng.random(n), rng.random(n)) if rng.integers(2) else (rng.integers(0, 30, n) * r / 2 % 1, rng.integers(0, 30, n) * r / 4 % 1)
    lead = rng.random(n) < rng.choice([0, 0.05])
    key[lead] -= 20 * n
    sure = np.ones(n, bool) if rng.integers(2) else (x > 2 * r) & (x < 1 - 2 * r) & (y > 2 * r)
    i, j = (np.floor(v * 2 / r).astype(np.int64) + 4 for v in (x, y))
    leader, known = greedy.decided(tile, i, j, key, x, y, lead, sure, r, strict)
    want = in_order(tile, key, x, y, lead, sure, r, strict)
    for p, first in want.items():
        assert not known[p] or key[leader[p]] == first and tile[leader[p]] == tile[p]
        assert known[p] or first is None or not sure.all()


@pytest.mark.parametrize("spot", [1, 1e-9])
def test_crowds(spot):
    """Thousands of points in one place, in order and against it; an open crowd holds back those around it."""
    n = 5000
    x, y = 0.5 + spot * 0.001 * np.random.default_rng(1).random((2, n))
    at = np.zeros(n, np.int64), np.floor(x * 200).astype(np.int64) + 4, np.floor(y * 200).astype(np.int64) + 4
    for key in (np.arange(n), np.arange(n)[::-1].copy()):
        leader, known = greedy.decided(*at, key, x, y, np.zeros(n, bool), np.ones(n, bool), 0.01, False)
        assert known.all() and (key[leader] == 0).all()
        _, known = greedy.decided(*at, key, x, y, np.zeros(n, bool), np.zeros(n, bool), 0.01, False)
        assert not known.any()
