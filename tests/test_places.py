"""Polygon covers, route splitting and generation, clusters of sales, picks: against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from acreline.operators import aggregates, clusters, cover, generate, routes
from acreline.plans.base import AS_OF, Tables
from acreline.plans.priority import staged
from tests.conftest import SF


def inside(lat, lng, polygon):
    hit = np.zeros(len(lat), bool)
    for (la, na), (lb, nb) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if la != lb:
            hit ^= ((la > lat) != (lb > lat)) & (lng < (nb - na) * (lat - la) / (lb - la) + na)
    return hit


def star(center, radii):
    turn = np.linspace(0, 2 * np.pi, len(radii), endpoint=False)
    return [(center[0] + r * np.sin(a), center[1] + r * np.cos(a)) for a, r in zip(turn.tolist(), radii, strict=True)]


POLYGONS = {
    "square": [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)], "spike": star((0.5, 0.5), [0.9, 0.05] * 7), "tiny": star((0.2, 0.7), [0.004, 0.001, 0.003, 0.002, 0.004]), "thin": [(0.1, -0.5), (0.1001, 1.5), (0.1002, -0.5)],
    "large": star((0.0, 0.0), [30.0, 28.0, 31.0, 25.0, 29.0, 33.0]), "bow": [(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0)], "two": [(0.0, 0.0), (1.0, 1.0)], "point": [(0.3, 0.3)] * 3, "west": star((-0.4, -0.3), [0.5] * 40),
}


def test_cover_against_every_pair(spark):
    rng = np.random.default_rng(5)
    lat, lng = rng.uniform(-1, 1.2, 4000), rng.uniform(-1, 1.6, 4000)
    lat[:300], lng[:300] = 0.2 + rng.normal(0, 0.003, 300), 0.7 + rng.normal(0, 0.003, 300)
    lat[300:500] = np.round(lat[300:500], 1)  # on the lines of grids and edges
    points = spark.createDataFrame(pd.DataFrame({"id": np.arange(4000), "lat": lat, "lng": lng}))
    shapes = spark.createDataFrame([(k, [{"lat": float(a), "lng": float(b)} for a, b in v]) for k, v in POLYGONS.items()], "name string, vertices array<struct<lat: double, lng: double>>")
    got = cover.holding(points, shapes, "id", "name")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = {(int(i), k) for k, v in POLYGONS.items() if len(v) > 2 for i in np.flatnonzero(inside(lat, lng, v))}
    assert {(r.id, r.name) for r in got.collect()} == want
    cells = cover.covers(shapes, "name").groupBy("name").agg(F.count("*").alias("n"), F.count_if("inner").alias("inner")).collect()
    assert all(r.n <= (cover.ACROSS + 2) ** 2 for r in cells) and {r.name for r in cells if r.inner > 300} >= {"square", "large", "west"}
    assert cover.holding(points, shapes.limit(0), "id", "name").count() == 0


def test_properties_in_hulls_of_zips(spark):
    t = Tables(spark, SF)
    hulls = routes.hulls(t.props, "zip_code").toPandas()
    shapes = [(z, [{"lat": a, "lng": b} for a, b in g[["lat", "lng"]].to_numpy().tolist()]) for z, g in hulls.groupby("zip_code")]
    # the hull's vertices come in any order from its parts
    order = lambda v: sorted(v, key=lambda p: np.arctan2(p["lat"] - np.mean([x["lat"] for x in v]), p["lng"] - np.mean([x["lng"] for x in v])))
    shapes = [(z, order(v)) for z, v in shapes]
    got = cover.holding(t.props.select("id", "lat", "lng"), spark.createDataFrame(shapes, "zip string, vertices array<struct<lat: double, lng: double>>"), "id", "zip").toPandas()
    p = t.props.select("id", "lat", "lng").toPandas()
    want = sum(int(inside(p["lat"].to_numpy(), p["lng"].to_numpy(), [(x["lat"], x["lng"]) for x in v]).sum()) for _, v in shapes)
    assert len(got) == want > len(p)


def doors(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    town = rng.integers(0, 3, n)
    lat, lng = 34.5 + town * 0.1 + rng.normal(0, 0.01, n), -82.5 + town * 0.05 + rng.normal(0, 0.01, n)
    lat[: n // 3], lng[: n // 3] = 34.5, -82.5  # a third stands in one place
    return pd.DataFrame({"id": np.arange(n), "owner": np.where(np.arange(n) % 4 == 0, 1, 2), "lat": lat, "lng": lng})


def test_compact_routes_hold_each_door_once(spark):
    rows = doors(spark)
    got = generate.compact(spark.createDataFrame(rows), "owner", 40, part=300).toPandas()
    assert sorted(got["id"]) == rows["id"].tolist()
    assert got.groupby("route").size().max() <= 40
    assert (got.groupby("route")["owner"].nunique() == 1).all()
    both = got.merge(rows, on="id")
    spread = both[both["id"] >= 1000].groupby("route")[["lat", "lng"]].agg(np.ptp).max(axis=1)
    assert spread.median() < 0.02  # a town alone is three times as wide


@pytest.mark.parametrize(("most", "part"), [(40, 300), (7, 50), (25, 25), (90, 60)])
def test_compact_routes_are_as_few_as_can_be(spark, most, part):
    rows = doors(spark)
    rows.loc[2000:2001, ["lat", "lng"]] = 80.0, 170.0  # two far away: nearly all others are in one bin
    got = generate.compact(spark.createDataFrame(rows), "owner", most, part=part).toPandas()
    assert sorted(got["id"]) == rows["id"].tolist()
    assert got.groupby("route").size().max() <= most
    assert got.groupby("owner")["route"].nunique().to_dict() == {o: -(-n // most) for o, n in rows.groupby("owner").size().items()}


def test_generated_routes(spark):
    t = Tables(spark, SF)
    as_of = F.lit(AS_OF).cast("timestamp")
    rows = staged(t)
    made, stops = generate.generate(rows, t.logs, "owner_id", as_of, most=12, start=(34.6, -82.55), part=40)
    made, stops = made.toPandas(), stops.toPandas()
    able = generate.eligible(rows, t.logs, as_of).select("id").toPandas()
    assert sorted(stops["id"]) == sorted(able["id"]) and stops["id"].is_unique
    assert made["houses"].max() <= 12 and made["houses"].sum() == len(stops)
    assert all(sorted(g["seq"]) == list(range(1, len(g) + 1)) for _, g in stops.groupby("route"))
    for _, g in made.groupby("owner_id"):
        assert sorted(g["rank"]) == list(range(1, len(g) + 1))
        assert g.sort_values("rank")["competitiveness"].is_monotonic_decreasing
    # a route's measures by a plain loop
    place = {r.id: (r.lat, r.lng) for r in rows.select("id", "lat", "lng").collect()}
    for r in made.head(20).itertuples():
        walk = stops[stops["route"] == r.route].sort_values("seq")
        points = np.array([place[i] for i in walk["id"]])
        length = routes.path_miles(points)
        assert abs(r.miles - round(length, 2)) < 0.011
        assert abs(r.score - walk["score"].sum()) <= 0.5
        start = float(routes.miles(np.array([34.6, -82.55]), points[0]))
        base = walk["score"].mean() * 0.6 + len(walk) / max(length, 0.1) * 40
        assert any(abs(np.floor(base * (1 + min(0.2, d / 50)) - min(2 * start, 20) + 0.5) - r.competitiveness) < 0.5 for d in range(1, 13))
    _, cut = generate.generate(rows, t.logs, "owner_id", as_of, most=12, longest=4.0)
    assert 0 < cut.count() < len(stops)
    assert cut.groupBy("route").agg(F.sum("leg").alias("m")).filter("m > 4.0001").count() == 0


def test_front_loading_keeps_the_start_and_the_bound():
    rng = np.random.default_rng(3)
    points, scores = rng.uniform(0, 0.05, (60, 2)), rng.random(60)
    order = routes.nearest_first(points)
    moved = generate.front_loaded(points, order, scores)
    assert sorted(moved) == list(range(60)) and moved[0] == order[0]
    assert routes.path_miles(points[moved]) <= routes.path_miles(points[order]) * 1.12 + 1e-9
    best = set(np.argsort(-scores)[:18])
    assert len(best & set(moved[:22])) >= len(best & set(order[:22]))


@pytest.mark.parametrize("kernel", [routes.two_opt, routes.or_opt])
def test_compact_routes_get_shorter(spark, kernel):
    rows = Tables(spark, SF).props
    split = generate.compact(rows, "owner_id", 100).select("id", "route").join(rows, "id").toPandas()
    better = []
    for _, g in split.sort_values("id").groupby("route"):
        points = g[["lat", "lng"]].to_numpy()
        order = routes.nearest_first(points)
        before, after = routes.path_miles(points[order]), routes.path_miles(points[kernel(points, order)])
        assert after <= before + 1e-9
        better.append(after < before - 1e-9)
    assert sum(better) > len(better) / 2


def test_sold_clusters_against_the_whole_loop(spark):
    rng = np.random.default_rng(8)
    n = 900
    town = rng.integers(0, 12, n)
    lat, lng = 33.0 + (town % 4) * 0.11 + rng.normal(0, 0.03, n), -82.0 + (town // 4) * 0.9 + rng.normal(0, 0.03, n)
    rows = pd.DataFrame({"id": rng.permutation(n), "owner": town % 2, "lat": lat, "lng": lng})
    frame = spark.createDataFrame(rows).withColumns({"confidence": F.lit("high"), "status": F.when(F.col("id") % 50 == 0, "REJECTED").otherwise("SOLD"), "sold_date": F.lit("2001-08-01").cast("timestamp")})
    parts = clusters.independent(frame, "owner", 5.0).toPandas()
    assert parts.groupby("owner")["part"].nunique().min() > 1
    got = {(r.owner, r.id): r.cluster for r in clusters.sold_clusters(frame, "owner", F.lit("2001-08-02").cast("timestamp")).collect()}
    want = {}
    for owner, g in rows[rows["id"] % 50 != 0].sort_values("id").groupby("owner"):
        own = clusters.first_near(g[["lat", "lng"]].to_numpy(), 5.0)
        ids = g["id"].to_numpy()
        for c in np.unique(own):
            if (own == c).sum() >= 20:
                want |= {(owner, int(i)): int(ids[own == c][0]) for i in ids[own == c]}
    assert got == want and len(set(want.values())) > 5


@pytest.mark.parametrize("name", ["lognormal", "constant", "outlier", "ties", "few", "none"])
@pytest.mark.parametrize("narrow", [aggregates.NARROW, 50])
def test_overall_picks_on_any_distribution(spark, name, narrow):
    rng = np.random.default_rng(2)
    v = {"lognormal": rng.lognormal(0, 4, 20_000), "constant": np.full(5000, 3.5), "outlier": np.append(rng.normal(size=20_000), [1e12, -1e300]), "ties": rng.integers(0, 4, 20_000).astype(float), "few": np.array([2.0]), "none": np.zeros(0)}[name]
    rows = spark.createDataFrame([(float(x), -float(x)) for x in v] + [(None, None), (float("nan"), None)], "a double, b double")
    got = aggregates.overall_picks(rows, {"mid": (F.col("a"), 0.5), "high": (F.col("a"), 0.99), "low": (F.col("b"), 0.01)}, 1e-3, narrow).first()
    pick = lambda x, q: None if not len(x) else float(np.sort(x)[min(int(len(x) * q), len(x) - 1)])
    assert (got.mid, got.high, got.low) == (pick(v, 0.5), pick(v, 0.99), pick(-v, 0.01))


def test_laid_out_tables_join_without_an_exchange(spark):
    from acreline.sources import layout

    t = Tables(spark, SF)
    by_cell, sales = layout.cells(t.props)
    tables = {n: layout.lay_out(rows, n) for n, rows in {"logs": t.logs, "aliases": layout.aliases(t.props), "properties_by_cell": by_cell, "sales_by_cell": sales, "properties": t.props}.items()}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        logs = layout.known_logs(spark, tables["logs"], tables["aliases"])
        heat = layout.heat_counts(spark, tables["properties_by_cell"], tables["sales_by_cell"])
        for rows in (logs, heat):
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        from acreline.plans import catalog

        same = lambda rows, name: sorted(map(tuple, rows.collect())) == sorted(map(tuple, catalog.queries()[name](spark, SF).collect()))
        assert same(logs.select("event_id", "id"), "d03_alias_join") and same(heat, "d13_heat_join")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    one = spark.table(tables["properties"]).filter("address_hash = 'H7'")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan doesn't tell
    try:
        assert "SelectedBucketsCount: 1 out of 8" in one._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert spark.table(tables["properties"]).schema == layout.LAYOUTS["properties"].schema
    assert layout.fitted(t.props.select("id", F.lit(1).alias("other")), layout.LAYOUTS["aliases"]).columns == ["alias", "id", "address_hash"]


@pytest.mark.parametrize("name", ["a15_nested_listing", "a16_webhook", "a17_verification", "i58_json_paths"])
def test_json_is_parsed_once_a_row(spark, name):
    from acreline.plans import catalog

    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 1
    assert "get_json_object" not in plan and "from_json" not in plan
