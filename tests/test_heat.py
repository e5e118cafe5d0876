"""The boost of a sale within 0.1 mile: against every pair, and where very many places are crowded."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from acreline.operators import routes, scoring

AS_OF = "2001-08-02"


@pytest.mark.parametrize(("south", "west"), [(34.5, -82.6), (-0.02, -0.02), (64.0, 20.0)])
def test_heat_against_every_pair(spark, south, west):
    rng = np.random.default_rng(6)
    n = 2500
    lat, lng = south + rng.random(n) / 25, west + rng.random(n) / 25
    lat[:200], lng[:200] = np.round(lat[:200], 3), np.round(lng[:200], 3)  # on the lines of parts
    days = rng.integers(0, 3650, n)
    sold = pd.Timestamp(AS_OF) - pd.to_timedelta(days, "D")
    rows = pd.DataFrame({"id": np.arange(n), "lat": lat, "lng": lng, "sold_date": sold})
    got = scoring.heat(spark.createDataFrame(rows), F.lit(AS_OF).cast("timestamp")).toPandas().sort_values("id")["heat"].to_numpy()
    late = days <= 365
    points = np.column_stack([lat, lng])
    near = (routes.miles(points[:, None], points[late][None]) <= scoring.HEAT_MILES).any(axis=1)
    r, c = np.floor(lat / 0.004), np.floor(lng / 0.004)
    around = (abs(r[:, None] - r[late]) <= 1) & (abs(c[:, None] - c[late]) <= 1)
    warm = 1 - np.exp(-(around * np.exp(-0.005 * days[late])).sum(axis=1))
    assert 0.1 < near.mean() < 0.9
    assert np.allclose(got, np.where(near, np.minimum(1, warm * scoring.HEAT_BOOST), warm), atol=1e-9)


def test_crowded_places_are_not_held_against_each_other(spark):
    """300,000 places in two square miles, half of them sold, were six billion pairs."""
    rows = spark.range(300_000).select("id", (F.lit(34.5) + F.col("id") * 7919 % 10007 / 10007.0 * 0.02).alias("lat"), (F.lit(-82.6) + F.col("id") * 104729 % 10009 / 10009.0 * 0.02).alias("lng"), F.expr(f"timestamp'{AS_OF}' - make_interval(0, 0, 0, CAST(id % 730 AS INT))").alias("sold_date"))
    began = time.time()
    assert scoring.heat(rows, F.lit(AS_OF).cast("timestamp")).filter("heat > 0.9").count() == 300_000
    assert time.time() - began < 40
