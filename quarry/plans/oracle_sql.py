"""SQL fragments for the DuckDB oracle (one text per registered query).

These restate each query's meaning in plain SQL with ordinary windows; they are the
correctness reference, not an execution path.
"""

from __future__ import annotations


def lcg_sql(x: str, steps: int = 1) -> str:
    v = x
    for _ in range(steps):
        v = f"((({v}) % 2147483648) * 1103515245 + 12345) % 2147483648"
    return v


def r6(x: str, d: int = 6) -> str:
    return f"round(({x}) + 1e-9, {d})"


EV_RN = """ev_rn AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"""

RAW_TRIPS = """raw_trips AS (
  SELECT event_id AS trip_id, strftime(ts, '%Y-%m') AS file,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS pickup_at,
         strftime(next_ts, '%Y-%m-%d %H:%M:%S') AS dropoff_at,
         user_id AS pickup_location_id, CAST(floor(value) AS BIGINT) AS dropoff_location_id
  FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events)
  WHERE next_ts IS NOT NULL)"""

TRIPS = RAW_TRIPS + """,
trips0 AS (
  SELECT trip_id, file, strptime(pickup_at, '%Y-%m-%d %H:%M:%S') AS pickup_at,
         strptime(dropoff_at, '%Y-%m-%d %H:%M:%S') AS dropoff_at,
         CAST(coalesce(pickup_location_id, -1) AS BIGINT) AS pickup_location_id,
         CAST(coalesce(dropoff_location_id, -1) AS BIGINT) AS dropoff_location_id
  FROM raw_trips),
trips AS (
  SELECT *, CAST(((floor((epoch_us(dropoff_at) - epoch_us(pickup_at)) / 1000000) % 86400) + 86400) % 86400
                 AS BIGINT) AS trip_duration
  FROM trips0)"""

SPLIT = TRIPS + f""",
gated AS (SELECT file, pickup_location_id, count(*) AS n_rows FROM trips GROUP BY ALL HAVING count(*) >= 4),
split AS (
  SELECT t.*, g.n_rows,
         row_number() OVER (PARTITION BY t.file, t.pickup_location_id
                            ORDER BY {lcg_sql('t.trip_id')}, t.trip_id) <= ceil(g.n_rows / 4) AS is_test
  FROM trips t JOIN gated g USING (file, pickup_location_id)),
xy AS (SELECT file, pickup_location_id, is_test, dropoff_location_id AS x,
              CAST(trip_duration AS DOUBLE) AS y FROM split)"""

OLS = """ols AS (
  SELECT file, pickup_location_id, 'linear_regression' AS model,
         round(avg(abs(y - (intercept + slope * x))) + 1e-9, 3) AS mae
  FROM xy JOIN (
    SELECT file, pickup_location_id,
           CASE WHEN var_pop(x) > 0 THEN regr_slope(y, x) ELSE 0.0 END AS slope,
           CASE WHEN var_pop(x) > 0 THEN regr_intercept(y, x) ELSE avg(y) END AS intercept
    FROM xy WHERE NOT is_test GROUP BY ALL) f USING (file, pickup_location_id)
  WHERE is_test GROUP BY ALL)"""


def tree_cte(name: str, random_split: bool) -> str:
    if random_split:
        u = f"({lcg_sql(lcg_sql('n.lo_x') + ' + n.hi_x')}) / 2147483648.0"
        low = f"n.x <= n.lo_x + {u} * (n.hi_x - n.lo_x)"
        model = "decision_tree_random"
    else:
        low = "(n.x - n.lo_x) <= (n.hi_x - n.x)"
        model = "decision_tree"
    return f"""{name}_tr AS (
  SELECT file, pickup_location_id, x, avg(y) AS mean_y FROM xy WHERE NOT is_test GROUP BY ALL),
{name}_nb AS (
  SELECT q.file, q.pickup_location_id, q.x,
         max(t.x) FILTER (WHERE t.x <= q.x) AS lo_x, min(t.x) FILTER (WHERE t.x >= q.x) AS hi_x
  FROM (SELECT DISTINCT file, pickup_location_id, x FROM xy WHERE is_test) q
  JOIN {name}_tr t USING (file, pickup_location_id) GROUP BY ALL),
{name}_pred AS (
  SELECT n.file, n.pickup_location_id, n.x,
         CASE WHEN lo_x IS NULL THEN h.mean_y WHEN hi_x IS NULL THEN l.mean_y
              WHEN lo_x = hi_x THEN l.mean_y WHEN {low} THEN l.mean_y ELSE h.mean_y END AS pred
  FROM {name}_nb n
  LEFT JOIN {name}_tr l ON l.file = n.file AND l.pickup_location_id = n.pickup_location_id AND l.x = n.lo_x
  LEFT JOIN {name}_tr h ON h.file = n.file AND h.pickup_location_id = n.pickup_location_id AND h.x = n.hi_x),
{name} AS (
  SELECT file, pickup_location_id, '{model}' AS model, round(avg(abs(y - pred)) + 1e-9, 3) AS mae
  FROM xy JOIN {name}_pred USING (file, pickup_location_id, x) WHERE is_test GROUP BY ALL)"""


TRANSFORMS = """tf AS (
  SELECT user_id AS video, rn - 1 AS frame, event_id, ts, value AS dx,
         CAST(regexp_extract(props, '"k":\\s*(-?\\d+)', 1) AS DOUBLE) AS dy,
         (CAST(regexp_extract(props, '"k":\\s*(-?\\d+)', 1) AS DOUBLE) - 50.0) / 1000.0 AS da
  FROM ev_rn)"""

VOTES = """votes AS (SELECT user_id AS item, rn AS k, event_type AS label FROM ev_rn)"""

POINTS = """pts AS (
  SELECT vec_id, i AS pt, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y
  FROM embeddings, range(0, 32) r(i) WHERE 2 * i + 2 <= len(embedding))"""

TRIALS = """trials AS (
  SELECT o_orderkey AS trial_id, o_orderpriority AS series, o_orderstatus AS scheme,
         month(o_orderdate) % 4 + 1 AS working_set, o_totalprice AS runtime,
         o_custkey % 97 AS spilled, o_custkey % 13 AS migrations, o_orderkey % 29 AS remote_migrations
  FROM orders)"""
