"""Route ordering: small numpy kernels, one route a group; everything around them is DataFrame work.

A route is at most some thousand stops, so a group is bounded by the route, never by the
table.
"""

from __future__ import annotations

import itertools
import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreline.functions import text

TWO_OPT_MAX, TWO_OPT_PASSES = 300, 50
#: Points of which each is held against all to find the nearest one left; more are looked at leaf by leaf.
ALL_PAIRS = 1_500


def miles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Haversine distances between rows of (lat, lng) in degrees, broadcast."""
    a, b = np.radians(a), np.radians(b)
    h = np.sin((b[..., 0] - a[..., 0]) / 2) ** 2 + np.cos(a[..., 0]) * np.cos(b[..., 0]) * np.sin((b[..., 1] - a[..., 1]) / 2) ** 2
    return 2 * 3959.0 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


def path_miles(points: np.ndarray) -> float:
    return float(miles(points[:-1], points[1:]).sum()) if len(points) > 1 else 0.0


def nearest_first(points: np.ndarray, start: int = 0) -> np.ndarray:
    """Order by going to the nearest unvisited point, ties to the earlier row."""
    if len(points) > ALL_PAIRS:
        return nearest_left(points, start)
    left = np.ones(len(points), bool)
    order = [start]
    left[start] = False
    while left.any():
        d = np.where(left, miles(points[order[-1]], points), np.inf)
        order.append(int(d.argmin()))
        left[order[-1]] = False
    return np.array(order)


def cut_leaves(flat: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers of leaves of at most `most` points, cut at medians of the widest side."""
    leaves, open_parts = [], [np.arange(len(flat))]
    while open_parts:
        part = open_parts.pop()
        if len(part) <= most:
            leaves.append(part)
            continue
        wide = int(np.ptp(flat[part], axis=0).argmax())
        cut = np.argpartition(flat[part, wide], len(part) // 2)
        open_parts += [part[cut[: len(part) // 2]], part[cut[len(part) // 2 :]]]
    return leaves


def nearest_left(points: np.ndarray, start: int = 0, leaf: int = 48, group: int = 48, listed: int = 10) -> np.ndarray:
    """The order of nearest_first without a look at all pairs: lists of neighbours, and where all of a list are visited, leaves that still hold points.

    Distances of lists and boxes are in space, where a straight line grows with the miles on the
    sphere, so a leaf whose box is farther than the best point holds no nearer one.
    """
    n = len(points)
    lat, lng = np.radians(points).T
    space = np.column_stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)])
    near = near_rows(space, listed)
    far = miles(points[:, None], points[near])
    by = np.lexsort((near, far), axis=1)
    near, far = np.take_along_axis(near, by, axis=1), np.take_along_axis(far, by, axis=1)
    # what isn't listed is as far as the last one listed at least, but for rounding
    sure = far < (far[:, -1:] * (1 - 1e-9) - 1e-12)
    leaves = cut_leaves(space, leaf)
    own = np.empty(n, np.int64)
    for i, x in enumerate(leaves):
        own[x] = i
    low, high = (np.array([f(space[x], axis=0) for x in leaves]) for f in (np.min, np.max))
    # leaves follow each other as they were cut, so neighbours in the list are neighbours on the map
    firsts = range(0, len(leaves), group)
    low_of, high_of = (np.array([f(x[i : i + group], axis=0) for i in firsts]) for x, f in ((low, np.min), (high, np.max)))
    count, count_of = [len(x) for x in leaves], [sum(len(x) for x in leaves[i : i + group]) for i in firsts]
    nowhere = 9.0

    def away(here: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        gap = np.maximum(0, np.maximum(a - here, here - b))
        return (gap * gap).sum(axis=1)

    def search(at: int) -> int:
        here, spot = space[at], points[at]
        best, chosen, bound = np.inf, -1, np.inf

        def look(k: int) -> None:
            nonlocal best, chosen, bound
            some = leaves[k] = leaves[k][left[leaves[k]]]
            d = miles(spot, points[some])
            nearest = float(d.min())
            if nearest <= best:
                row = int(some[d == nearest].min())
                best, chosen = nearest, row if nearest < best else min(row, chosen)
                # a little more than the line of so many miles, for what rounding may do
                bound = (2 * math.sin(best / 7918.0) * (1 + 1e-9) + 1e-12) ** 2

        k = int(own[at])
        if count[k]:
            look(k)
        groups = away(here, low_of, high_of)
        for j in np.argsort(groups, kind="stable").tolist() if chosen < 0 else np.flatnonzero(groups <= bound).tolist():
            if groups[j] > bound:
                continue
            gap = away(here, low[j * group : (j + 1) * group], high[j * group : (j + 1) * group])
            for i in np.flatnonzero(gap <= bound).tolist() if chosen >= 0 else np.argsort(gap, kind="stable").tolist():
                if gap[i] <= bound and j * group + i != k and count[j * group + i]:
                    look(j * group + i)
        return chosen

    order, left, at = np.empty(n, np.int64), np.ones(n, bool), start
    for step in range(n):
        order[step], left[at] = at, False
        k = int(own[at])
        count[k] -= 1
        count_of[k // group] -= 1
        if not count[k]:
            low[k] = high[k] = nowhere
        if not count_of[k // group]:
            low_of[k // group] = high_of[k // group] = nowhere
        if step + 1 < n:
            open_ = left[near[at]]
            first = int(open_.argmax())
            at = int(near[at, first]) if open_[first] and sure[at, first] else search(at)
    return order


def next_nearest(points: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Order of visiting all points from a place, always the nearest next one on the plane."""
    left, order, here = np.ones(len(points), bool), [], start
    while left.any():
        order.append(int(np.where(left, planar_miles(here, points), np.inf).argmin()))
        left[order[-1]] = False
        here = points[order[-1]]
    return np.array(order, dtype=np.int64)


#: A turn of over so many degrees costs up to so many miles more.
SHARP_TURN, TURN_MILES = 45.0, 0.5


def bearings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Degrees from north, 0 to 360, from one place to others."""
    a, b = np.radians(a), np.radians(b)
    d = b[..., 1] - a[..., 1]
    x = np.cos(a[..., 0]) * np.sin(b[..., 0]) - np.sin(a[..., 0]) * np.cos(b[..., 0]) * np.cos(d)
    return (np.degrees(np.arctan2(np.sin(d) * np.cos(b[..., 0]), x)) + 360) % 360


def planar_miles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Miles on the plane, longitude shrunk by the mean latitude."""
    x = (b[..., 1] - a[..., 1]) * np.cos(np.radians((a[..., 0] + b[..., 0]) / 2))
    return np.sqrt(x * x + (b[..., 0] - a[..., 0]) ** 2) * 69


def fewer_turns(points: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Order by the nearest unvisited point where a sharp turn counts as more miles, in proportion to its angle; from the point nearest to `start`, else the first row."""
    first = int(planar_miles(start, points).argmin()) if start is not None else 0
    left = np.ones(len(points), bool)
    order, heading = [first], None
    left[first] = False
    while left.any():
        here = points[order[-1]]
        cost = planar_miles(here, points)
        if heading is not None:
            turn = np.abs(bearings(here, points) - heading)
            turn = np.where(turn > 180, 360 - turn, turn)
            cost = cost + np.where(turn > SHARP_TURN, turn / 180 * TURN_MILES, 0)
        order.append(int(np.where(left, cost, np.inf).argmin()))
        left[order[-1]] = False
        heading = float(bearings(here, points[order[-1]]))
    return np.array(order)


def two_opt(points: np.ndarray, order: np.ndarray, passes: int = TWO_OPT_PASSES, most: int = TWO_OPT_MAX) -> np.ndarray:
    """Reverse stretches of an open path of at most `most` stops while that shortens it; the first stop stays."""
    n = len(order)
    if not 4 <= n <= most:
        return order
    d = miles(points[:, None], points[None])
    order = order.copy()
    for _ in range(passes):
        better = False
        for i in range(1, n - 1):
            j = np.arange(i + 1, n)
            after = np.append(order[i + 2 :], -1)
            now = d[order[i - 1], order[i]] + np.where(after >= 0, d[order[j], after], 0)
            then = d[order[i - 1], order[j]] + np.where(after >= 0, d[order[i], after], 0)
            gain = now - then
            k = int(gain.argmax())
            if gain[k] > 1e-9:
                order[i : j[k] + 1] = order[i : j[k] + 1][::-1]
                better = True
        if not better:
            break
    return order


def or_opt(points: np.ndarray, order: np.ndarray, passes: int = 30, least: float = 1e-3, most: int = TWO_OPT_MAX) -> np.ndarray:
    """Move one or two neighbouring stops of a path of at most `most` elsewhere while that saves at least `least`; the first stop stays."""
    if not 3 <= len(order) <= most:
        return order
    d = miles(points[:, None], points[None])
    order = np.array(order)
    for _ in range(passes):
        better = False
        for size in (1, 2):
            for i in range(1, len(order) - size + 1):
                part, rest = order[i : i + size], np.delete(order, slice(i, i + size))
                # what the path saves without the part, and what each place for it costs; the last place has no stop after it
                gap = np.append(d[rest[:-1], rest[1:]], 0)
                saved = d[order[i - 1], part[0]] + (d[part[-1], rest[i]] if i < len(rest) else 0) - gap[i - 1]
                costs = d[rest, part[0]] + np.append(d[part[-1], rest[1:]], 0) - gap
                k = int(costs.argmin())
                if saved - costs[k] > least:
                    order = np.concatenate([rest[: k + 1], part, rest[k + 1 :]])
                    better = True
        if not better:
            break
    return order


def nearest_lists(points: np.ndarray, k: int = 8, leaf: int = 64) -> np.ndarray:
    """The k nearest other points of each on the plane, nearest first: n x min(k, n - 1) row numbers."""
    return near_rows(np.column_stack([points[:, 0], points[:, 1] * np.cos(np.radians(points[:, 0].mean()))]), k, leaf)


def near_rows(flat: np.ndarray, k: int = 8, leaf: int = 64) -> np.ndarray:
    """The k nearest other rows of each, nearest first: n x min(k, n - 1) row numbers.

    Points are cut at medians into leaves; a leaf looks only into leaves whose boxes are
    nearer than the farthest neighbour it has in itself, so no distance matrix is held.
    """
    n = len(flat)
    k = min(k, n - 1)
    leaves = cut_leaves(flat, max(leaf, 2 * k + 1))
    low, high = (np.array([f(flat[part], axis=0) for part in leaves]) for f in (np.min, np.max))

    def among(rows: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = ((flat[rows, None] - flat[None, others]) ** 2).sum(axis=2)
        d[rows[:, None] == others] = np.inf
        nth = np.argpartition(d, k - 1, axis=1)[:, :k]
        far = np.take_along_axis(d, nth, axis=1)
        by = np.lexsort((others[nth], far), axis=1)
        return others[np.take_along_axis(nth, by, axis=1)], far.max(axis=1)

    out = np.empty((n, k), np.int64)
    for i, part in enumerate(leaves):
        reach = among(part, part)[1].max()
        gap = np.maximum(0, np.maximum(low - high[i], low[i] - high))
        out[part] = among(part, np.concatenate([leaves[j] for j in np.flatnonzero((gap**2).sum(axis=1) <= reach)]))[0]
    return out


def near_opt(points: np.ndarray, order: np.ndarray, k: int = 8, longest: int = 3, least: float = 1e-9) -> np.ndarray:
    """Reversals and relocations of an open path that bring a stop beside one of its k nearest, while they shorten it; the first stop stays.

    Only stops whose neighbourhood has changed are looked at again, memory grows with the
    stops, and a path of any length is taken. It never gets longer.
    """
    n = len(order)
    if n < 3:
        return order
    lists = nearest_lists(points, k)
    near, apart = lists.tolist(), miles(points[:, None], points[lists]).tolist()
    lat, lng = np.radians(points).T.tolist()
    cosine = np.cos(np.radians(points[:, 0])).tolist()
    path = order.tolist()
    pos = [0] * n
    for i, a in enumerate(path):
        pos[a] = i

    def dist(a: int, b: int) -> float:
        """Miles between stops; none to the place behind the last stop, -1."""
        if a < 0 or b < 0:
            return 0.0
        h = math.sin((lat[b] - lat[a]) / 2) ** 2 + cosine[a] * cosine[b] * math.sin((lng[b] - lng[a]) / 2) ** 2
        return 7918.0 * math.asin(min(1.0, math.sqrt(h)))

    def at(i: int) -> int:
        return path[i] if i < n else -1

    def best_move(a: int) -> tuple | None:
        """(first place, end, where it goes, whether turned, stops at the edges that change) of stop a's best move."""
        best, move = least, None
        i = pos[a]
        s, p = at(i + 1), path[i - 1] if i else -1
        to_s, to_p = dist(a, s), dist(p, a)
        for c, d in zip(near[a], apart[a], strict=True):
            if s >= 0 and d >= to_s and d >= to_p:
                break  # nearest first: a reversal that gains has a shorter new edge at one of its stops
            j = pos[c]
            # a's next edge and c's next edge
            t = at(j + 1)
            gain = to_s + dist(c, t) - d - dist(s, t)
            if gain > best:
                best, move = gain, (min(i, j) + 1, max(i, j) + 1, None, True, (a, s, c, t))
            if i and j:
                # the edges before a and before c
                u = path[j - 1]
                gain = to_p + dist(u, c) - d - dist(p, u)
                if gain > best:
                    best, move = gain, (min(i, j), max(i, j), None, True, (a, p, c, u))
        for size in range(1, longest + 1):
            # a stretch that starts or ends at a goes beside c
            for first in (i, i - size + 1)[: 2 if size > 1 else 1]:
                last = first + size - 1
                if first < 1 or last >= n:
                    continue
                b = path[last] if first == i else path[first]
                left, right = path[first - 1], at(last + 1)
                saved = dist(left, path[first]) + dist(path[last], right) - dist(left, right)
                if saved + dist(a, b) <= best:
                    continue  # no place costs less than the stretch's own ends are apart
                for c, d in zip(near[a], apart[a], strict=True):
                    j = pos[c]
                    if first <= j <= last:
                        continue
                    if j != first - 1:
                        t = at(j + 1)
                        gain = saved - d - dist(b, t) + dist(c, t)
                        if gain > best:
                            best, move = gain, (first, last + 1, j + 1, first != i, (a, b, left, right, c, t))
                    if j and j != last + 1:
                        u = path[j - 1]
                        gain = saved - d - dist(b, u) + dist(u, c)
                        if gain > best:
                            best, move = gain, (first, last + 1, j, first == i, (a, b, left, right, c, u))
        return move

    waiting, queued = deque(path), [True] * n
    while waiting:
        a = waiting.popleft()
        queued[a] = False
        move = best_move(a)
        if move is None:
            continue
        x, y, to, turned, ends = move
        part = path[x:y][::-1] if turned else path[x:y]
        if to is not None and to < x:
            part, x = part + path[to:x], to
        elif to is not None:
            part, y = path[y:to] + part, to
        path[x:y] = part
        for j in range(x, y):
            pos[path[j]] = j
        for e in ends:
            if e >= 0 and not queued[e]:
                queued[e] = True
                waiting.append(e)
    return np.array(path)


def improved(points: np.ndarray, order: np.ndarray, most: int = TWO_OPT_MAX) -> np.ndarray:
    """2-opt and relocation over all pairs of a path of at most `most` stops, then over neighbour lists, which longer ones have alone."""
    return near_opt(points, or_opt(points, two_opt(points, order, most=most), most=most))


def kmeans(points: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Lloyd's assignment; the first centre is the first row, each next one the farthest from those taken."""
    k = min(k, len(points))
    chosen = [0]
    while len(chosen) < k:
        d = np.min([((points - points[c]) ** 2).sum(axis=1) for c in chosen], axis=0)
        chosen.append(int(d.argmax()))
    centers = points[chosen].astype(float)
    own = np.zeros(len(points), int)
    for _ in range(rounds):
        own = ((points[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(k):
            if (own == c).any():
                centers[c] = points[own == c].mean(axis=0)
    return own


def clusters_of(points: np.ndarray) -> int:
    """One below ten points or three miles of spread, else the spread in three miles, two to four."""
    if len(points) < 10:
        return 1
    spread = float(miles(points.min(axis=0), points.max(axis=0)))
    return 1 if spread <= 3 else min(4, max(2, int(spread / 3 + 0.5)))


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull by a monotone chain, counter-clockwise, as row numbers."""
    order = np.lexsort((points[:, 1], points[:, 0]))
    cross = lambda o, a, b: (points[a, 0] - points[o, 0]) * (points[b, 1] - points[o, 1]) - (points[a, 1] - points[o, 1]) * (points[b, 0] - points[o, 0])
    chains = []
    for seq in (order, order[::-1]):
        chain: list[int] = []
        for p in seq.tolist():
            while len(chain) >= 2 and cross(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        chains.append(chain[:-1])
    return np.array(chains[0] + chains[1] or order[:1].tolist())


def hulls(rows: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """key, lat, lng: the convex hull's vertices of each key.

    The hull of hulls is the hull, so a key's rows are cut into parts first and only the
    parts' vertices meet.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        return group.iloc[hull(group[["lat", "lng"]].to_numpy())][[key, "lat", "lng"]]

    kind = f"{key} string, lat double, lng double"
    cut = rows.select(key, "lat", "lng", F.pmod(F.xxhash64("lat", "lng"), F.lit(parts)).alias("part")).distinct()
    return cut.groupBy(key, "part").applyInPandas(one, kind).groupBy(key).applyInPandas(one, kind)


def front_load(points: np.ndarray, order: np.ndarray, scores: np.ndarray, slots: int = 22, share: float = 0.3, extra: float = 0.12, block: int = 4096) -> np.ndarray:
    """Best-scored stops among the first ones, while the path stays within `extra` more miles.

    What a move adds is told from the stops beside its two places, for a block of stops at once;
    the path is measured as a whole when a stop has moved.
    """
    order = np.array(order)
    now = path_miles(points[order])
    limit = now * (1 + extra)
    top = np.zeros(len(order), bool)
    top[np.argsort(-scores, kind="stable")[: max(1, int(len(order) * share))]] = True
    waiting = slots + np.flatnonzero(top[order[slots:]])
    at = 0
    # a stop that moves leaves all behind it where they are
    while at < len(waiting):
        places = 1 + np.flatnonzero(~top[order[1:slots]])
        if not len(places):
            break
        some = waiting[at : at + block]
        here, before = points[order[some]], points[order[some - 1]]
        ends = some + 1 == len(order)
        after = points[order[np.where(ends, some, some + 1)]]
        saved = miles(before, here) + np.where(ends, 0, miles(here, after) - miles(before, after))
        a, b = points[order[places - 1]], points[order[places]]
        more = miles(a[None], here[:, None]) + miles(here[:, None], b[None]) - miles(a, b)[None] - saved[:, None]
        fits = now + more <= limit
        which = np.flatnonzero(fits.any(axis=1))
        if not len(which):
            at += len(some)
            continue
        i, to = int(some[which[0]]), int(places[fits[which[0]].argmax()])
        order[to : i + 1] = np.roll(order[to : i + 1], 1)
        now = path_miles(points[order])
        at += int(which[0]) + 1
    return order


def route_order(points: np.ndarray, improve: bool = True) -> np.ndarray:
    """Clusters by the nearest next centre and stops by the nearest next one in each, then shortened if asked for."""
    k = clusters_of(points)
    own = kmeans(points, k) if k > 1 else np.zeros(len(points), int)
    centers = np.array([points[own == c].mean(axis=0) for c in np.unique(own)])
    order: list[int] = []
    for c in nearest_first(centers):
        rows = np.flatnonzero(own == np.unique(own)[c])
        start = int(miles(points[order[-1]], points[rows]).argmin()) if order else 0
        order += rows[nearest_first(points[rows], start)].tolist()
    path = np.array(order)
    return improved(points, path) if improve else path


def whole_routes(batches: Iterator[pa.RecordBatch], route: str, least: int = 50_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, first row of each route and the number of rows) of sorted batches: tables of some ten thousand rows, none of which ends within a route."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append(batch)
        if not held or (batch is not None and sum(b.num_rows for b in held) < least):
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key, absent = table[route].fill_null(0).to_numpy(), table[route].is_null().to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (absent[1:] != absent[:-1])]))
        # the last route may go on in the next batch
        end = table.num_rows if batch is None else int(starts[-1])
        held = table.slice(end).to_batches()
        if end:
            yield table.slice(0, end), np.append(starts[starts < end], end)
        elif batch is not None:
            least = 2 * table.num_rows


def ordered_routes(stops: DataFrame, route: str = "route_id", improve: bool = True) -> DataFrame:
    """route, id, seq (from 1) and miles of the whole path; stops have lat, lng and pos.

    Routes of a few stops, which are nearly all, are ordered together with others of their length.
    """

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from acreline.operators import short_routes

        for table, bounds in whole_routes(batches, route):
            points = np.column_stack([table["lat"].to_numpy(), table["lng"].to_numpy()])
            starts, sizes = bounds[:-1], np.diff(bounds)
            path, length = np.empty(len(points), np.int64), np.empty(len(points))
            for n in np.unique(sizes).tolist():
                rows = starts[sizes == n][:, None] + np.arange(n)
                if n <= short_routes.MOST:
                    order, far = short_routes.ordered(points[rows], improve)
                    path[rows], length[rows] = np.take_along_axis(rows, order, axis=1), far[:, None]
                    continue
                for at in rows:
                    order = route_order(points[at], improve)
                    path[at], length[at] = at[order], path_miles(points[at[order]])
            seq = (np.arange(len(points)) - np.repeat(starts, sizes) + 1).astype(np.int32)
            out = pa.table({route: table[route], "id": table["id"].take(pa.array(path)), "seq": pa.array(seq), "miles": pa.array(length)})
            yield from out.combine_chunks().to_batches(max_chunksize=50_000)

    # few bytes but much work a route: a stated number of partitions isn't merged by size
    dealt = stops.select(route, "pos", "id", "lat", "lng").repartition(int(stops.sparkSession.conf.get("spark.sql.shuffle.partitions")), route)
    return dealt.sortWithinPartitions(route, "pos", "id").select(route, "id", "lat", "lng").mapInArrow(some, f"{route} long, id long, seq int, miles double")


def boustrophedon(props: DataFrame, group: str = "zip_code") -> DataFrame:
    """Street by street in alphabetical order: odd numbers up, even numbers back, as `seq`."""
    odd = F.col("house_number") % 2 == 1
    keyed = props.withColumns({"street": text.street_key(F.col("street_name")), "side": F.when(odd, 0).otherwise(1), "along": F.when(odd, F.col("house_number")).otherwise(-F.col("house_number"))})
    return keyed.withColumn("seq", F.row_number().over(Window.partitionBy(group).orderBy("street", "side", "along", "id")))


def sweep(selected: DataFrame, props: DataFrame) -> DataFrame:
    """All rows on the selected rows' streets."""
    streets = selected.select("zip_code", "street_name").distinct()
    return props.join(streets, ["zip_code", "street_name"], "left_semi")


def greedy_assign(scores: DataFrame, penalty: float = 30.0) -> DataFrame:
    """route_id, rep: routes in id order take the rep of best score, less `penalty` for each route the rep has."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        taken: dict[int, int] = {}
        out = []
        for route, part in group.sort_values(["route_id", "rep"]).groupby("route_id", sort=True):
            value = part["score"].to_numpy() - penalty * np.array([taken.get(r, 0) for r in part["rep"].tolist()])
            rep = int(part["rep"].iloc[int(value.argmax())])
            taken[rep] = taken.get(rep, 0) + 1
            out.append((route, rep))
        return pd.DataFrame(out, columns=["route_id", "rep"])

    return scores.groupBy("team").applyInPandas(one, "route_id long, rep long")
