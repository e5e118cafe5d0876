"""Walks over areas of many stops: the nearest next one without a look at all pairs, and best stops moved to the front."""

import time

import numpy as np
import pytest

from acreline.operators import routes


def plain_walk(points, start):
    left, order = np.ones(len(points), bool), [start]
    left[start] = False
    while left.any():
        order.append(int(np.where(left, routes.miles(points[order[-1]], points), np.inf).argmin()))
        left[order[-1]] = False
    return order


def places(kind, n=1200):
    rng = np.random.default_rng(4)
    if kind == "grid":  # many distances are equal
        return np.column_stack([34.5 + rng.integers(0, 40, n) / 200, -82.6 + rng.integers(0, 40, n) / 200])
    if kind == "towns":
        return rng.normal(0, 0.01, (n, 2)) + rng.choice([[34.5, -82.5], [34.9, -82.5], [60.0, 10.0], [-33.0, 179.99], [-33.0, -179.99]], n)
    if kind == "one place":
        return np.tile([[34.5, -82.5]], (n, 1))
    return np.column_stack([34.5 + rng.random(n) / 5, -82.6 + rng.random(n) / 5])


@pytest.mark.parametrize("kind", ["plain", "grid", "towns", "one place"])
@pytest.mark.parametrize("leaf", [5, 48])
def test_nearest_left_against_all_pairs(kind, leaf):
    points = places(kind)
    assert routes.nearest_left(points, 7, leaf=leaf, group=6).tolist() == plain_walk(points, 7)


def plain_front_load(points, order, scores, slots=22, share=0.3, extra=0.12):
    limit = routes.path_miles(points[order]) * (1 + extra)
    top = set(np.argsort(-scores, kind="stable")[: max(1, int(len(order) * share))].tolist())
    order = list(order)
    for i in [i for i in range(slots, len(order)) if order[i] in top]:
        for at in range(1, min(slots, i)):
            moved = order[:at] + [order[i]] + order[at:i] + order[i + 1 :]
            if order[at] not in top and routes.path_miles(points[moved]) <= limit:
                order = moved
                break
    return order


@pytest.mark.parametrize(("n", "extra"), [(1, 0.12), (5, 0.12), (22, 0.12), (23, 0.5), (24, 0.12), (60, 0.12), (150, 0.02), (150, 0.12), (150, 0.0), (400, 0.004)])
def test_front_load_as_step_by_step(n, extra):
    for seed in range(6):
        rng = np.random.default_rng(seed)
        points, scores = rng.random((n, 2)) / 5 + [34.5, -82.6], rng.integers(0, 10, n) / 10.0
        order = routes.nearest_first(points)
        assert routes.front_load(points, order, scores, extra=extra, block=7).tolist() == plain_front_load(points, order, scores, extra=extra)


def test_large_area_takes_seconds():
    """Looks at all pairs grew with the square of the stops: 2.6 s for 6,000."""
    points = places("plain", 20_000)
    began = time.time()
    order = routes.front_load(points, routes.nearest_first(points), np.arange(20_000) % 10 / 10.0)
    assert sorted(order.tolist()) == list(range(20_000))
    assert time.time() - began < 12
