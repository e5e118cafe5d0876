"""Routes of a few stops are ordered together, as each would be alone."""

import numpy as np
import pandas as pd
import pytest

from acreline.operators import routes, short_routes


def some(m, n, seed=3):
    rng = np.random.default_rng(seed + n)
    points = np.stack([34.5 + rng.integers(0, 40, (m, n)) / 200, -82.6 + rng.integers(0, 40, (m, n)) / 200], axis=-1)
    points[: m // 4, -1] = points[: m // 4, 0]  # two stops in one place
    return points


@pytest.mark.parametrize("n", range(1, short_routes.MOST + 1))
def test_together_as_alone(n):
    points = some(120, n)
    for improve in (False, True):
        got, miles = short_routes.ordered(points, improve, block=50)
        want = [routes.route_order(p, improve) for p in points]
        assert (got == want).all()
        assert np.allclose(miles, [routes.path_miles(p[o]) for p, o in zip(points, want, strict=True)], atol=1e-9)


def test_left_alone_are_at_their_best():
    points = some(200, 7)
    d = short_routes.distances(points)
    order = short_routes.two_opt(d, short_routes.nearest_first(d))
    still = ~short_routes.improvable(d, order)
    assert 0 < still.sum() < len(points)
    assert all((routes.near_opt(p, o) == o).all() for p, o in zip(points[still], order[still], strict=True))


def test_routes_across_batches(spark):
    rng = np.random.default_rng(9)
    sizes = [3, 1, 700, 9, 10, 25, 2, 4] * 12
    rows = pd.DataFrame({"route_id": np.repeat(np.arange(len(sizes)), sizes), "pos": np.concatenate([np.arange(n)[::-1] for n in sizes])})
    rows = rows.assign(id=np.arange(len(rows)), lat=34.5 + rng.random(len(rows)) / 5, lng=-82.6 + rng.random(len(rows)) / 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = routes.ordered_routes(spark.createDataFrame(rows), improve=False).toPandas().sort_values(["route_id", "seq"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for route, g in rows.groupby("route_id"):
        g = g.sort_values("pos")
        mine = got[got["route_id"] == route]
        assert mine["id"].tolist() == g["id"].to_numpy()[routes.route_order(g[["lat", "lng"]].to_numpy(), False)].tolist()
        assert mine["seq"].tolist() == list(range(1, len(g) + 1))


def test_many_routes_take_seconds(spark):
    """A call a route took over a millisecond: 60,000 routes of four stops took more than a minute of one core."""
    import time

    from pyspark.sql import functions as F

    stops = spark.range(240_000).select((F.col("id") / 4).cast("long").alias("route_id"), (F.col("id") % 4).cast("int").alias("pos"), "id", (F.col("id") * 7919 % 10007 / 50035 + 34.5).alias("lat"), (F.col("id") * 104729 % 10009 / 50045 - 82.65).alias("lng"))
    routes.ordered_routes(stops.limit(100)).count()
    began = time.time()
    assert routes.ordered_routes(stops).filter("seq = 4").count() == 60_000
    assert time.time() - began < 30
