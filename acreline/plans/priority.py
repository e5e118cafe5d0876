"""Queries of K1, K2 and of the cells they count in (I18)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.functions import geo
from acreline.operators import priority
from acreline.plans.base import Tables
from acreline.plans.catalog import query
from acreline.plans.rules import NOW, now

STATES = ("ELIGIBLE", "UNVERIFIED", "CALLBACK", "NO_ANSWER", "NOT_MOVED_IN", "DM_NOT_HOME", "QUALIFIED", "HARD_NO", "SOLD")
#: Learned multipliers, as a trained model would give them.
LEARNED = {"age_gt_10": 1.1, "price_gt_300k": 0.9, "single_family": 1.2, "recent_sale": 1.05, "high_value": 0.8, "large_lot": 1.15}

HEX = f"""axial AS (SELECT *, (lng * {geo.HEX_SHRINK}e0 * 0.5773502691896258e0 - lat * 0.3333333333333333e0) / {geo.HEX_SIZE}e0 AS fq, lat * 0.6666666666666666e0 / {geo.HEX_SIZE}e0 AS fr FROM props),
near AS (SELECT *, floor(fq + 0.5e0) AS nq, floor(fr + 0.5e0) AS nr, floor((0e0 - fq - fr) + 0.5e0) AS ns FROM axial),
off AS (SELECT *, abs(nq - fq) AS dq, abs(nr - fr) AS dr, abs(ns - (0e0 - fq - fr)) AS ds FROM near),
cells AS (SELECT *, CAST(CASE WHEN dq > dr AND dq > ds THEN -nr - ns ELSE nq END AS BIGINT) AS hq, CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -nq - ns ELSE nr END AS BIGINT) AS hr,
  CASE id % 9 {' '.join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STATES))} END AS es, date_diff('millisecond', sold_date, {NOW}) / 86400000e0 AS days FROM off)"""


def staged(t: Tables) -> DataFrame:
    """Properties with an effective status of every kind, by their id."""
    return t.props.withColumn("effective_status", F.element_at(F.array(*[F.lit(s) for s in STATES]), (F.col("id") % 9 + 1).cast("int")))


def _recency(month: str) -> str:
    return f"CASE WHEN days / {month} <= 3 THEN 80 WHEN days / {month} <= 6 THEN 60 WHEN days / {month} <= 12 THEN 40 ELSE 20 END"


@query("i18_hex_cells", f"WITH {HEX}\nSELECT hq AS q, hr AS r, count(*) AS n FROM cells GROUP BY 1, 2")
def i18(t: Tables) -> DataFrame:
    q, r = geo.hexagon(F.col("lat"), F.col("lng"))
    return t.props.groupBy(q.alias("q"), r.alias("r")).agg(F.count("*").alias("n"))


EQUITY = "price * (1 + days / 365e0 * 0.03e0) * (0.2e0 + least(1e0, days / 365e0 / 30e0) * 0.8e0)"


@query("k01_property_score", f"""WITH {HEX},
steps(a, b) AS (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)),
act AS (SELECT hq + a AS q, hr + b AS r, count(*) AS active FROM cells, steps WHERE es IN ('SOLD', 'QUALIFIED', 'UNVERIFIED') GROUP BY 1, 2),
seen AS (SELECT p.id, count(*) AS visits, count(*) FILTER (l.status = 'NO_ANSWER') AS unanswered FROM props p JOIN logs l ON l.address_hash IN (p.address_hash, p.legacy_hash) GROUP BY p.id),
base AS (SELECT id, es, price, property_type, year_built, lot_size, days, CAST(100 + CASE es WHEN 'ELIGIBLE' THEN 60 WHEN 'UNVERIFIED' THEN 40 WHEN 'CALLBACK' THEN 100 WHEN 'NO_ANSWER' THEN 30 WHEN 'NOT_MOVED_IN' THEN 20 WHEN 'DM_NOT_HOME' THEN 50 WHEN 'QUALIFIED' THEN 80
  WHEN 'SOLD' THEN {_recency('30e0')} ELSE 0 END
  + CASE WHEN days IS NULL THEN 0 ELSE CASE WHEN {EQUITY} > 200000 THEN 60 WHEN {EQUITY} > 100000 THEN 30 ELSE 0 END + CASE WHEN days / 365e0 < 1 THEN -30 WHEN days / 365e0 > 7 THEN 40 ELSE 0 END END
  + CASE WHEN property_type = 'Single Family' THEN 20 WHEN property_type IN ('Condo', 'Townhouse') THEN -10 WHEN property_type = 'Multi-Family' THEN 10 ELSE 0 END + least(coalesce(active, 0) * 5, 50)
  + CASE WHEN visits > 3 THEN -60 WHEN visits = 1 AND unanswered = 1 THEN 25 WHEN visits = 2 AND unanswered = 2 THEN -10 ELSE 0 END + CASE WHEN price > 1000000 THEN 30 ELSE 0 END AS DOUBLE) AS s
  FROM cells LEFT JOIN act ON q = hq AND r = hr LEFT JOIN seen USING (id)),
one AS (SELECT *, CASE WHEN 2001 - year_built > 10 THEN s * 1.1e0 ELSE s END AS s1 FROM base), two AS (SELECT *, CASE WHEN price > 300000 THEN s1 * 0.9e0 ELSE s1 END AS s2 FROM one),
three AS (SELECT *, CASE WHEN property_type = 'Single Family' THEN s2 * 1.2e0 ELSE s2 END AS s3 FROM two), four AS (SELECT *, CASE WHEN days / 365e0 <= 3 THEN s3 * 1.05e0 ELSE s3 END AS s4 FROM three),
five AS (SELECT *, CASE WHEN price > 750000 THEN s4 * 0.8e0 ELSE s4 END AS s5 FROM four), six AS (SELECT *, CASE WHEN lot_size > 10890 THEN s5 * 1.15e0 ELSE s5 END AS s6 FROM five)
SELECT id, CASE WHEN es = 'HARD_NO' THEN 0e0 ELSE greatest(0e0, floor(s6 + 0.5e0)) END AS score FROM six""")
def k01(t: Tables) -> DataFrame:
    return priority.property_scores(staged(t), t.logs, now(t), LEARNED).select("id", "score")


@query("k02_quick_score", f"""WITH {HEX}
SELECT id, CAST(CASE es WHEN 'HARD_NO' THEN 0 WHEN 'ELIGIBLE' THEN 160 WHEN 'CALLBACK' THEN 200 WHEN 'QUALIFIED' THEN 180 WHEN 'UNVERIFIED' THEN 140 WHEN 'NO_ANSWER' THEN 130 ELSE 100 END
  + CASE WHEN es = 'SOLD' AND days IS NOT NULL THEN {_recency('30.44e0')} ELSE 0 END + CASE WHEN price > 1000000 THEN 30 ELSE 0 END AS DOUBLE) AS score FROM cells""")
def k02(t: Tables) -> DataFrame:
    return priority.quick_scores(staged(t), now(t)).select("id", "score")
