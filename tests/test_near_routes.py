"""Neighbour lists and the path search on them, against plain loops."""

import tracemalloc

import numpy as np
import pytest

from acreline.operators import routes
from acreline.plans import catalog


def places(n: int, seed: int, step: float | None = None) -> np.ndarray:
    rng = np.random.default_rng(seed)
    points = np.column_stack([34 + rng.random(n), -82 - rng.random(n)])
    return np.round(points / step) * step if step else points


@pytest.mark.parametrize(("n", "step"), [(2, None), (5, None), (130, None), (700, None), (400, 0.1), (300, 1.0)])
def test_lists_hold_the_nearest(n, step):
    points = places(n, n, step)
    got = routes.nearest_lists(points, 8, leaf=16)
    flat = np.column_stack([points[:, 0], points[:, 1] * np.cos(np.radians(points[:, 0].mean()))])
    d = ((flat[:, None] - flat[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    k = min(8, n - 1)
    assert got.shape == (n, k)
    assert (got != np.arange(n)[:, None]).all() and all(len(set(row)) == k for row in got.tolist())
    assert np.allclose(np.take_along_axis(d, got, axis=1), np.sort(d, axis=1)[:, :k])


@pytest.mark.parametrize(("n", "seed", "step"), [(3, 1, None), (4, 2, None), (12, 3, None), (60, 4, None), (60, 5, 0.25), (300, 6, None)])
def test_never_longer_than_all_pairs(n, seed, step):
    points = places(n, seed, step)
    start = routes.nearest_first(points)
    kernel = routes.or_opt(points, routes.two_opt(points, start))
    got = routes.improved(points, start)
    assert sorted(got.tolist()) == list(range(n)) and got[0] == start[0]
    assert routes.path_miles(points[got]) <= routes.path_miles(points[kernel]) + 1e-9


@pytest.mark.parametrize("seed", range(6))
def test_no_better_move_is_left(seed):
    """With all others as neighbours the end is a path that no reversal and no relocation shortens."""
    n = 24
    points = places(n, seed)
    got = routes.near_opt(points, np.arange(n), k=n).tolist()
    length = lambda order: routes.path_miles(points[np.array(order)])
    least = length(got) - 1e-7
    assert got[0] == 0
    for i in range(1, n):
        for j in range(i + 1, n + 1):
            assert length(got[:i] + got[i:j][::-1] + got[j:]) >= least
            part, rest = got[i:j], got[:i] + got[j:]
            if len(part) <= 3:
                for to in range(1, len(rest) + 1):
                    for turned in (part, part[::-1]):
                        assert length(rest[:to] + turned + rest[to:]) >= least


def test_long_routes_get_shorter_in_little_memory():
    points = places(3_000, 9)
    start = routes.nearest_first(points)
    tracemalloc.start()
    got = routes.improved(points, start)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(got.tolist()) == list(range(3_000)) and got[0] == 0
    assert routes.path_miles(points[got]) < 0.9 * routes.path_miles(points[start])
    assert peak < 8_000_000  # a distance matrix would take 72 MB


def test_query_of_long_routes(spark):
    rows = catalog.queries()["l16_long_routes"](spark, "/root/testdata/sf0.01").collect()
    long = [r for r in rows if r.n > routes.TWO_OPT_MAX]
    assert long and all(r.after <= r.before + 1e-9 for r in rows)
    assert all(r.after < r.before for r in long)
