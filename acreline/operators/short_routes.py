"""The kernels of `routes` over many routes of one length at once, since most routes are a few stops and a call for each costs more than its work.

Each takes points as routes x stops x (lat, lng) and orders as routes x stops, and gives
what the kernel of the same name gives route by route.
"""

from __future__ import annotations

import functools

import numpy as np

from acreline.operators import routes

#: Stops of the routes that are taken together; longer ones may have clusters of their own.
MOST = 9


def distances(points: np.ndarray) -> np.ndarray:
    return routes.miles(points[:, :, None], points[:, None])


def nearest_first(d: np.ndarray) -> np.ndarray:
    many, n = d.shape[:2]
    every = np.arange(many)
    order = np.zeros((many, n), np.int64)
    taken = np.zeros((many, n), bool)
    taken[:, 0] = True
    for i in range(1, n):
        order[:, i] = np.where(taken, np.inf, d[every, order[:, i - 1]]).argmin(axis=1)
        taken[every, order[:, i]] = True
    return order


def two_opt(d: np.ndarray, order: np.ndarray, passes: int = routes.TWO_OPT_PASSES) -> np.ndarray:
    many, n = order.shape
    if n < 4:
        return order
    order, every, place = order.copy(), np.arange(many), np.arange(n)
    for _ in range(passes):
        better = False
        for i in range(1, n - 1):
            before, first, ends, after = order[:, i - 1, None], order[:, i, None], order[:, i + 1 :], order[:, i + 2 :]
            at = every[:, None]
            gain = d[at, before, first] - d[at, before, ends]
            gain[:, :-1] += d[at, ends[:, :-1], after] - d[at, first, after]
            k = gain.argmax(axis=1)
            rows = np.flatnonzero(gain[every, k] > 1e-9)
            if len(rows):
                last = (k[rows] + i + 1)[:, None]
                order[rows] = order[rows[:, None], np.where((place >= i) & (place <= last), i + last - place, place)]
                better = True
        if not better:
            break
    return order


def or_opt(d: np.ndarray, order: np.ndarray, passes: int = 30, least: float = 1e-3) -> np.ndarray:
    many, n = order.shape
    if n < 3:
        return order
    order, at = order.copy(), np.arange(many)[:, None]
    for _ in range(passes):
        better = False
        for size in (1, 2):
            for i in range(1, n - size + 1):
                part, rest = order[:, i : i + size], np.delete(order, slice(i, i + size), axis=1)
                head, tail = part[:, :1], part[:, -1:]
                gap = np.zeros((many, n - size))
                gap[:, :-1] = d[at, rest[:, :-1], rest[:, 1:]]
                saved = d[at, order[:, i - 1, None], head] - gap[:, i - 1, None]
                if i < n - size:
                    saved = saved + d[at, tail, rest[:, i, None]]
                costs = d[at, rest, head] - gap
                costs[:, :-1] += d[at, tail, rest[:, 1:]]
                k = costs.argmin(axis=1)
                rows = np.flatnonzero(saved[:, 0] - costs[at[:, 0], k] > least)
                if len(rows):
                    to = k[rows, None]
                    stays = np.arange(n - size)
                    moved = np.empty((len(rows), n), np.int64)
                    np.put_along_axis(moved, np.where(stays <= to, stays, stays + size), rest[rows], axis=1)
                    np.put_along_axis(moved, to + 1 + np.arange(size), part[rows], axis=1)
                    order[rows] = moved
                    better = True
        if not better:
            break
    return order


@functools.lru_cache(2 * MOST)
def moves(n: int, longest: int = 3) -> np.ndarray:
    """Every path that a reversal or a relocation of `longest` stops makes of 0..n-1; the first stop stays."""
    base, out = list(range(n)), set()
    for x in range(1, n):
        for y in range(x + 2, n + 1):
            out.add((*base[:x], *base[x:y][::-1], *base[y:]))
        for size in range(1, min(longest, n - x) + 1):
            part, rest = base[x : x + size], base[:x] + base[x + size :]
            for to in range(1, len(rest) + 1):
                out |= {(*rest[:to], *part, *rest[to:]), (*rest[:to], *part[::-1], *rest[to:])}
    return np.array(sorted(out - {tuple(base)})).reshape(-1, n)


def improvable(d: np.ndarray, order: np.ndarray, least: float = 5e-10) -> np.ndarray:
    """Whether any of a route's moves shortens it; `near_opt` leaves all others as they are."""
    n = order.shape[1]
    some = moves(n)
    if not len(some):
        return np.zeros(len(order), bool)
    along = np.take_along_axis(np.take_along_axis(d, order[:, :, None], axis=1), order[:, None], axis=2)
    now = along[:, np.arange(n - 1), np.arange(1, n)].sum(axis=1)
    best = np.full(len(order), np.inf)
    for at in range(0, len(some), 16):
        best = np.minimum(best, along[:, some[at : at + 16, :-1], some[at : at + 16, 1:]].sum(axis=2).min(axis=1))
    return now - best > least


def ordered(points: np.ndarray, improve: bool, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(orders, miles) of routes of at most MOST stops: nearest first, then shortened if asked for."""
    orders, lengths = [], []
    for begin in range(0, len(points), block):
        some = points[begin : begin + block]
        d = distances(some)
        order = nearest_first(d)
        if improve:
            order = or_opt(d, two_opt(d, order))
            for i in np.flatnonzero(improvable(d, order)).tolist():
                order[i] = routes.near_opt(some[i], order[i])
        at = np.arange(len(some))[:, None]
        orders.append(order)
        lengths.append(d[at, order[:, :-1], order[:, 1:]].sum(axis=1))
    return np.concatenate(orders), np.concatenate(lengths)
