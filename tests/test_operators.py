"""Operators that SQL doesn't express: invariants, round trips and small golden frames."""

import numpy as np
import pytest

from acreline.functions import geo
from acreline.operators import filters, joins, ordered, routes, rules, scoring, snapshots
from acreline.plans.base import Tables
from acreline.plans.ordered import routed
from tests.conftest import SF


def test_two_opt_keeps_stops_and_never_lengthens():
    rng = np.random.default_rng(1)
    for n in (1, 2, 4, 30, 120):
        points = rng.uniform(34.5, 34.7, (n, 2))
        path = routes.nearest_first(points)
        better = routes.or_opt(points, routes.two_opt(points, path))
        assert sorted(better.tolist()) == list(range(n))
        assert better[0] == path[0]
        assert routes.path_miles(points[better]) <= routes.path_miles(points[path]) + 1e-9


def test_front_load_bounds_the_extra_way():
    rng = np.random.default_rng(2)
    points, scores = rng.uniform(34.5, 34.7, (60, 2)), rng.uniform(0, 1, 60)
    path = routes.nearest_first(points)
    out = routes.front_load(points, path, scores)
    assert sorted(out.tolist()) == sorted(path.tolist())
    assert routes.path_miles(points[out]) <= 1.12 * routes.path_miles(points[path]) + 1e-9


def test_hull_of_hulls(spark):
    t = Tables(spark, SF)
    got = {(r.zip_code, r.lat, r.lng) for r in routes.hulls(t.props, "zip_code").collect()}
    frame = t.props.select("zip_code", "lat", "lng").toPandas()
    want = {(z, *p) for z, part in frame.groupby("zip_code") for p in part[["lat", "lng"]].drop_duplicates().to_numpy()[routes.hull(part[["lat", "lng"]].drop_duplicates().to_numpy())].tolist()}
    assert got == {(z, a, b) for z, a, b in want}


def test_optimised_routes_are_permutations(spark):
    stops = routed(Tables(spark, SF))
    plain = {r.route_id: r.miles for r in routes.ordered_routes(stops, improve=False).collect()}
    rows = routes.ordered_routes(stops).collect()
    assert all(r.miles <= plain[r.route_id] + 1e-6 for r in rows)
    assert sorted((r.route_id, r.id) for r in rows) == sorted((r.route_id, r.id) for r in stops.collect())


@pytest.mark.parametrize("few", [True, False])
def test_polygon_corners(spark, few):
    from pyspark.sql import functions as F

    square = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
    rows = spark.createDataFrame([(0.5, 0.5, True), (1.5, 0.5, False), (0.5, -0.1, False)], "lat double, lng double, want boolean")
    assert rows.filter(geo.in_polygon(F.col("lat"), F.col("lng"), square) != F.col("want")).count() == 0
    assert rows.filter(geo.in_polygon(F.col("lat"), F.col("lng"), square[:2], few_is_inside=few)).count() == (3 if few else 0)


def test_valid_sale_golden(spark):
    from pyspark.sql import functions as F

    golden = [
        (None, None, "SC", None, True), (29_999.0, None, "SC", None, False), (30_000.0, None, "SC", None, True), (40_000.0, 200_000.0, "SC", None, False), (40_000.0, 24_999.0, "SC", None, False),
        (999.0, None, "TX", None, False), (0.0, None, "TX", None, True), (1_000.0, None, "TX", None, True), (50_000.0, 25_000.0, None, None, True), (90_000.0, None, "SC", "Vacant Land", False),
    ]
    rows = spark.createDataFrame(golden, "price double, assessed double, state string, kind string, want boolean").withColumn("sold", F.current_date())
    assert rows.filter(filters.valid_sale(F.col("price"), F.col("assessed"), F.col("state"), F.col("kind"), F.col("sold")) != F.col("want")).count() == 0


def test_effective_status_order(spark):
    from pyspark.sql import functions as F

    props = spark.createDataFrame([(1, "SOLD"), (2, "HARD_NO"), (3, "X"), (4, "X"), (5, "X")], "id long, status string")
    logs = spark.createDataFrame([(1, 3, "NO_ANSWER", "2024-01-30"), (2, 4, "CALLBACK", "2024-01-10"), (3, 5, "HARD_NO", "2024-01-01")], "event_id long, pid long, status string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.id: r.effective for r in rules.effective_status(props, logs, F.lit("2024-01-31").cast("timestamp")).collect()}
    assert got == {1: "ELIGIBLE", 2: "HARD_NO", 3: "COOLDOWN", 4: "ELIGIBLE", 5: "HARD_NO"}


def test_propensity_is_the_weighted_sum(spark):
    from pyspark.sql import functions as F

    t, now = Tables(spark, SF), F.lit("2001-08-02").cast("timestamp")
    parts = [scoring.quality(t.props), scoring.heat(t.props, now), scoring.distress(t.props, now)]
    frame = t.props.select("id", scoring.ownership(F.col("sold_date"), now).alias("ownership"))
    for p in parts:
        frame = frame.join(p, "id")
    frame = frame.join(scoring.contact_penalty(t.logs), F.col("id") == F.col("pid"), "left").toPandas().set_index("id")
    raw = sum(frame[c] * w for c, w in scoring.WEIGHTS.items()) - frame["penalty"].fillna(0)
    want = 1 / (1 + np.exp(-6 * (raw - 0.5)))
    got = scoring.propensity(t.props, t.logs, now).toPandas().set_index("id")["propensity"]
    assert np.allclose(got.sort_index(), want.sort_index())


def test_adwin_needs_sixty(spark):
    make = lambda n, at: [("k", i, 1.0 if i > at else 0.0) for i in range(n)]
    for n, at, cut in ((59, 20, None), (60, 29, None), (61, 29, 30), (100, 43, 44)):
        rows = spark.createDataFrame(make(n, at), "key string, i int, v double")
        got = ordered.adwin(rows, "key", ["i"], "v").collect()
        assert (got[0].cut_at if got else None) == cut


def test_merge_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, x string, y int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 3)], "id int, x string, y int")
    once = snapshots.merge(old, new, "id")
    assert {(r.id, r.x, r.y, r.action) for r in once.collect()} == {(1, "a", 1, "existed"), (2, "b", 5, "updated"), (3, "c", 3, "inserted")}
    again = snapshots.merge(once.drop("action"), new, "id").drop("action")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.drop("action").collect()))


def test_random_delete_keeps_the_rest(spark):
    rows = spark.range(1000)
    left = snapshots.delete_random(rows, "id", 100, 7)
    assert left.count() == 900
    assert {r.id for r in left.collect()} == {r.id for r in snapshots.delete_random(rows.repartition(7), "id", 100, 7).collect()}


def test_alias_join_has_no_nested_loop(spark):
    t = Tables(spark, SF)
    plan = joins.alias_join(t.logs, t.props.select("id", "address_hash", "legacy_hash"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_reach_the_scan(spark):
    t = Tables(spark, SF)
    plan = t.logs.filter("rep = 7").select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "user_id" in plan.split("PushedFilters")[1].split("]")[0]


def test_greedy_assignment_spreads(spark):
    rows = [(0, r, p, 50.0 + (p == 1)) for r in range(4) for p in (1, 2)]
    got = {r.route_id: r.rep for r in routes.greedy_assign(spark.createDataFrame(rows, "team int, route_id long, rep long, score double")).collect()}
    assert sorted(got.values()) == [1, 1, 2, 2]


@pytest.mark.parametrize("n", [5, 60, 61, 150, 300])
def test_relocation_on_long_routes(n):
    """Stops put out of place are moved back, and every accepted move shortens the path."""
    points = np.stack([np.linspace(34, 36, n), np.zeros(n)], axis=1)
    order = np.arange(n)
    order = np.concatenate([order[:2], order[3:], order[2:3]])
    got = routes.or_opt(points, order)
    assert sorted(got.tolist()) == list(range(n)) and got[0] == 0
    assert routes.path_miles(points[got]) == pytest.approx(routes.path_miles(points))
    assert routes.or_opt(points, np.arange(n)).tolist() == list(range(n))
