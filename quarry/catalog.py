"""Registered queries: name -> (builder(spark, sf_dir) -> DataFrame, oracle SQL or None).

Every builder reads the shared tables (directly or through ``plans.inputs``) and runs over
whole tables. The oracle SQL states the same result for DuckDB over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalars import lcg, stable_round
from quarry.operators import exchange as X
from quarry.operators import logs as LG
from quarry.operators import motion as MO
from quarry.operators import results as RS
from quarry.operators import trajectory as TR
from quarry.operators import trips as T
from quarry.operators import voting as V
from quarry.plans import inputs as I
from quarry.plans import oracle_sql as S
from quarry.plans.sequence import number_rows
from quarry.session import scratch_path
from quarry.sources.tables import table

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def query(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _split(spark, d):
    return T.split_train_test(T.prepare_trips(I.raw_trips(spark, d)))


# ---------------------------------------------------------------- many-model training

@query("scan_pushdown", """
SELECT event_id, ts, user_id, value FROM events WHERE user_id = 42""")
def q_scan_pushdown(spark, d):
    """Equality filter + 4-column projection: both reach the parquet scan."""
    return table(spark, d, "events").filter(F.col("user_id") == 42).select("event_id", "ts", "user_id", "value")


@query("trip_prepare", "WITH " + S.TRIPS + """
SELECT trip_id, file, pickup_at, dropoff_at, pickup_location_id, dropoff_location_id, trip_duration FROM trips""")
def q_trip_prepare(spark, d):
    return T.prepare_trips(I.raw_trips(spark, d)).select(
        "trip_id", "file", "pickup_at", "dropoff_at", "pickup_location_id", "dropoff_location_id",
        "trip_duration")


@query("group_gate", "WITH " + S.TRIPS + """
SELECT file, pickup_location_id, count(*) AS n_rows FROM trips GROUP BY ALL HAVING count(*) >= 4""")
def q_group_gate(spark, d):
    return T.gated_groups(T.prepare_trips(I.raw_trips(spark, d)))


@query("split_train_test", "WITH " + S.SPLIT + """
SELECT trip_id, file, pickup_location_id, is_test FROM split""")
def q_split_train_test(spark, d):
    return _split(spark, d).select("trip_id", "file", "pickup_location_id", "is_test")


@query("ols_group_mae", "WITH " + S.SPLIT + ", " + S.OLS + """
SELECT * FROM ols""")
def q_ols_group_mae(spark, d):
    return T.ols_group_mae(_split(spark, d))


@query("tree_group_mae", "WITH " + S.SPLIT + ", " + S.tree_cte("tree", False) + """
SELECT * FROM tree""")
def q_tree_group_mae(spark, d):
    return T.tree_group_mae(_split(spark, d), random_split=False)


@query("tree_random_group_mae", "WITH " + S.SPLIT + ", " + S.tree_cte("rtree", True) + """
SELECT * FROM rtree""")
def q_tree_random_group_mae(spark, d):
    return T.tree_group_mae(_split(spark, d), random_split=True)


@query("rank_models", "WITH " + S.SPLIT + ", " + S.OLS + ", " + S.tree_cte("tree", False) + ", "
       + S.tree_cte("rtree", True) + """
SELECT *, row_number() OVER (PARTITION BY file, pickup_location_id ORDER BY mae, model) AS model_rank
FROM (SELECT * FROM ols UNION ALL SELECT * FROM tree UNION ALL SELECT * FROM rtree)""")
def q_rank_models(spark, d):
    return T.rank_models(T.all_model_scores(_split(spark, d)))


@query("best_model", "WITH " + S.SPLIT + ", " + S.OLS + ", " + S.tree_cte("tree", False) + ", "
       + S.tree_cte("rtree", True) + """
SELECT file, pickup_location_id, arg_min(model, (mae, model)) AS model, min(mae) AS mae
FROM (SELECT * FROM ols UNION ALL SELECT * FROM tree UNION ALL SELECT * FROM rtree) GROUP BY ALL""")
def q_best_model(spark, d):
    s = T.all_model_scores(_split(spark, d))
    return s.groupBy(*T.GROUP).agg(F.min_by("model", F.struct("mae", "model")).alias("model"),
                                   F.min("mae").alias("mae"))


@query("group_x_model", "WITH " + S.TRIPS + """
SELECT file, pickup_location_id, model, CAST(n_rows - ceil(n_rows / 4) AS BIGINT) AS n_train,
       CAST(ceil(n_rows / 4) AS BIGINT) AS n_test
FROM (SELECT file, pickup_location_id, count(*) AS n_rows FROM trips GROUP BY ALL HAVING count(*) >= 4),
     (VALUES ('linear_regression'), ('decision_tree'), ('decision_tree_random')) m(model)""")
def q_group_x_model(spark, d):
    return T.group_x_model(T.prepare_trips(I.raw_trips(spark, d)))


@query("train_counters", "WITH " + S.TRIPS + """
SELECT file, count(*) AS n_locations, count(*) FILTER (WHERE n_rows >= 4) AS n_trained,
       count(*) FILTER (WHERE n_rows >= 4) * 3 AS n_model_fits
FROM (SELECT file, pickup_location_id, count(*) AS n_rows FROM trips GROUP BY ALL) GROUP BY file""")
def q_train_counters(spark, d):
    return T.train_counters(T.prepare_trips(I.raw_trips(spark, d)))


# ---------------------------------------------------------------- trajectory smoothing

RADIUS = 5          # smoothing radius = frames per second of the stand-in video
FPS = 5
CHECKPOINT_EVERY = 50
MAX_FRAMES = 50
N_SINKS = 4
TF = "WITH " + S.EV_RN + ", " + S.TRANSFORMS
RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _tf(spark, d):
    return I.transforms(spark, d)


@query("running_sum", TF + f"""
SELECT video, frame, {S.r6('sum(dx) OVER w')} AS cum_dx, {S.r6('sum(dy) OVER w')} AS cum_dy,
       {S.r6('sum(da) OVER w')} AS cum_da
FROM tf WINDOW w AS (PARTITION BY video ORDER BY frame {RUN})""")
def q_running_sum(spark, d):
    return TR.running_sum(_tf(spark, d))


SMOOTH_SQL = TF + f""",
tr AS (SELECT *, sum(dx) OVER w AS tx, sum(dy) OVER w AS ty, sum(da) OVER w AS ta
       FROM tf WINDOW w AS (PARTITION BY video ORDER BY frame {RUN})),
per AS (SELECT video, count(*) AS n, arg_min(tx, frame) AS fx, arg_min(ty, frame) AS fy, arg_min(ta, frame) AS fa,
               arg_max(tx, frame) AS lx, arg_max(ty, frame) AS ly, arg_max(ta, frame) AS la FROM tr GROUP BY video),
sm AS (
SELECT video, frame,
  {S.r6(f"(sum(tx) OVER c + greatest({RADIUS} - frame, 0) * fx + greatest({RADIUS} - (n - 1 - frame), 0) * lx) / {2 * RADIUS + 1} - tx + dx")} AS smooth_dx,
  {S.r6(f"(sum(ty) OVER c + greatest({RADIUS} - frame, 0) * fy + greatest({RADIUS} - (n - 1 - frame), 0) * ly) / {2 * RADIUS + 1} - ty + dy")} AS smooth_dy,
  {S.r6(f"(sum(ta) OVER c + greatest({RADIUS} - frame, 0) * fa + greatest({RADIUS} - (n - 1 - frame), 0) * la) / {2 * RADIUS + 1} - ta + da")} AS smooth_da
FROM tr JOIN per USING (video)
WINDOW c AS (PARTITION BY video ORDER BY frame ROWS BETWEEN {RADIUS} PRECEDING AND {RADIUS} FOLLOWING))"""


@query("smooth", SMOOTH_SQL + " SELECT * FROM sm")
def q_smooth(spark, d):
    return TR.smooth(_tf(spark, d), RADIUS)


@query("pairwise", TF + f"""
SELECT * FROM (
  SELECT video, frame, lag(event_id) OVER w AS prev_event_id, event_id,
         {S.r6('dx - lag(dx) OVER w')} AS delta_dx
  FROM tf WINDOW w AS (PARTITION BY video ORDER BY frame)) WHERE frame >= 1""")
def q_pairwise(spark, d):
    return TR.pairwise(_tf(spark, d))


@query("segments", TF + f"""
SELECT video, CAST(floor(greatest(frame - 1, 0) / {TR.SEGMENT_FRAMES}) AS BIGINT) AS segment,
       count(*) AS n_frames, min(frame) AS first_frame, max(frame) AS last_frame FROM tf GROUP BY ALL""")
def q_segments(spark, d):
    return TR.segments(_tf(spark, d))


@query("checkpoint_rows", TF + f"""
SELECT * FROM (
  SELECT video, frame, {S.r6('sum(dx) OVER w')} AS cum_dx, {S.r6('sum(dy) OVER w')} AS cum_dy,
         {S.r6('sum(da) OVER w')} AS cum_da
  FROM tf WINDOW w AS (PARTITION BY video ORDER BY frame {RUN})) WHERE frame % {CHECKPOINT_EVERY} = 0""")
def q_checkpoint_rows(spark, d):
    return TR.checkpoint_rows(_tf(spark, d), CHECKPOINT_EVERY)


@query("idempotent_sink", TF + """,
dl AS (SELECT video, frame FROM tf UNION ALL SELECT video, frame FROM tf WHERE frame % 7 = 3)
SELECT video, count(*) AS n_received, count(DISTINCT frame) AS n_delivered,
       count(*) - count(DISTINCT frame) AS n_duplicates,
       max(frame) + 1 - count(DISTINCT frame) AS n_missing, max(frame) AS last_frame
FROM dl GROUP BY video""")
def q_idempotent_sink(spark, d):
    return TR.idempotent_sink(TR.replayed_deliveries(_tf(spark, d)))


@query("completeness", SMOOTH_SQL + """
SELECT e.video, e.expected, coalesce(s.delivered, 0) AS delivered, coalesce(s.delivered, 0) = e.expected AS complete
FROM (SELECT user_id AS video, count(*) AS expected FROM events GROUP BY 1) e
LEFT JOIN (SELECT video, count(*) AS delivered FROM sm GROUP BY 1) s USING (video)""")
def q_completeness(spark, d):
    expected = table(spark, d, "events").select(F.col("user_id").alias("video"))
    return TR.completeness(expected, TR.smooth(_tf(spark, d), RADIUS)).select(
        "video", "expected", "delivered", "complete")


PAIRS_SQL = "WITH " + S.POINTS + """,
pairs AS (
  SELECT a.vec_id, a.pt, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1,
         CASE WHEN abs(b.x) <= 0.4 AND abs(b.y) <= 0.4 THEN 1 ELSE 0 END AS status
  FROM pts a JOIN pts b ON b.vec_id = a.vec_id + 1 AND b.pt = a.pt),
g AS (
  SELECT vec_id, count(*) AS n_points, avg(x0) mx0, avg(y0) my0, avg(x1) mx1, avg(y1) my1,
         sum(x0 * x0 + y0 * y0) sqq, sum(x0 * x1 + y0 * y1) sdot, sum(x0 * y1 - y0 * x1) scross
  FROM pairs WHERE status = 1 GROUP BY vec_id),
ab AS (
  SELECT *, sqq - n_points * (mx0 * mx0 + my0 * my0) AS s,
         CASE WHEN sqq - n_points * (mx0 * mx0 + my0 * my0) <> 0 THEN
           (sdot - n_points * (mx0 * mx1 + my0 * my1)) / (sqq - n_points * (mx0 * mx0 + my0 * my0)) END AS a,
         CASE WHEN sqq - n_points * (mx0 * mx0 + my0 * my0) <> 0 THEN
           (scross - n_points * (mx0 * my1 - my0 * mx1)) / (sqq - n_points * (mx0 * mx0 + my0 * my0)) END AS b
  FROM g),
raw AS (SELECT vec_id, n_points, mx1 - a * mx0 + b * my0 AS dx, my1 - b * mx0 - a * my0 AS dy, atan2(b, a) AS da FROM ab),
fit AS (
  SELECT vec_id, n_points, """ + S.r6("dx") + " AS dx, " + S.r6("dy") + " AS dy, " + S.r6("da") + """ AS da FROM raw)"""


@query("similarity_fit", PAIRS_SQL + " SELECT * FROM fit")
def q_similarity_fit(spark, d):
    return TR.similarity_fit(TR.point_pairs(table(spark, d, "embeddings")))


@query("apply_transform", PAIRS_SQL + """
SELECT p.vec_id, p.pt,
  """ + S.r6("1.04 * (cos(da) * x - sin(da) * y + dx)") + """ AS x_out,
  """ + S.r6("1.04 * (sin(da) * x + cos(da) * y + dy)") + """ AS y_out
FROM pts p JOIN raw f ON f.vec_id = p.vec_id WHERE f.da IS NOT NULL""")
def q_apply_transform(spark, d):
    return TR.apply_transform(I.points(spark, d), TR.fit_motion(TR.point_pairs(table(spark, d, "embeddings"))))


CONSENSUS_SQL = "WITH " + S.POINTS + f""",
mv AS (SELECT vec_id, cos((vec_id % 7) / 20.0) AS c, sin((vec_id % 7) / 20.0) AS s, (vec_id % 11) / 50.0 AS tx, (vec_id % 5) / 40.0 AS ty
       FROM embeddings),
m AS (SELECT a.vec_id, a.pt, a.x AS x0, a.y AS y0,
             CASE WHEN a.pt % 3 = 0 THEN b.x ELSE c * a.x - s * a.y + tx END AS x1,
             CASE WHEN a.pt % 3 = 0 THEN b.y ELSE s * a.x + c * a.y + ty END AS y1
      FROM pts a JOIN pts b ON b.vec_id = a.vec_id + 1 AND b.pt = a.pt JOIN mv ON mv.vec_id = a.vec_id),
sz AS (SELECT vec_id, count(*) AS n FROM m GROUP BY 1),
sm AS (SELECT vec_id, n, k, {S.lcg_sql(f'(vec_id * {MO.SAMPLES} + k)', 1)} % n AS i,
              {S.lcg_sql(f'(vec_id * {MO.SAMPLES} + k)', 2)} % (n - 1) AS r FROM sz, range(0, {MO.SAMPLES}) q(k) WHERE n > 1),
pq AS (SELECT sm.vec_id, k, p.x0 AS px, p.y0 AS py, p.x1 AS pu, p.y1 AS pv, q.x0 - p.x0 AS x, q.y0 - p.y0 AS y, q.x1 - p.x1 AS u, q.y1 - p.y1 AS v
       FROM sm JOIN m p ON p.vec_id = sm.vec_id AND p.pt = i JOIN m q ON q.vec_id = sm.vec_id AND q.pt = (i + 1 + r) % n),
ab AS (SELECT *, (x * u + y * v) / (x * x + y * y) AS a, (x * v - y * u) / (x * x + y * y) AS b FROM pq WHERE x * x + y * y > 1e-12),
fs AS (SELECT vec_id, k, a, b, pu - a * px + b * py AS dx, pv - b * px - a * py AS dy FROM ab),
sc AS (SELECT f.vec_id, k, any_value(a) AS a, any_value(b) AS b, any_value(dx) AS dx, any_value(dy) AS dy,
              count(*) FILTER (WHERE (a * x0 - b * y0 + dx - x1) ** 2 + (b * x0 + a * y0 + dy - y1) ** 2 <= {MO.TOLERANCE ** 2}) AS hits
       FROM fs f JOIN m ON m.vec_id = f.vec_id GROUP BY f.vec_id, k),
be AS (SELECT vec_id, arg_max(struct_pack(a := a, b := b, dx := dx, dy := dy, hits := hits), (hits, -k)) AS f FROM sc GROUP BY vec_id),
inl AS (SELECT m.* FROM m JOIN be ON be.vec_id = m.vec_id
        WHERE (f.a * x0 - f.b * y0 + f.dx - x1) ** 2 + (f.b * x0 + f.a * y0 + f.dy - y1) ** 2 <= {MO.TOLERANCE ** 2}),
g AS (SELECT vec_id, count(*) AS n, avg(x0) AS mx, avg(y0) AS my, avg(x1) AS mu, avg(y1) AS mw, sum(x0 * x0 + y0 * y0) AS qq,
             sum(x0 * x1 + y0 * y1) AS dt, sum(x0 * y1 - y0 * x1) AS cr FROM inl GROUP BY vec_id),
h AS (SELECT *, (dt - n * (mx * mu + my * mw)) / (qq - n * (mx * mx + my * my)) AS a,
             (cr - n * (mx * mw - my * mu)) / (qq - n * (mx * mx + my * my)) AS b FROM g)
SELECT vec_id, sz.n AS n_points, h.n AS n_inliers, {S.r6('mu - a * mx + b * my')} AS dx, {S.r6('mw - b * mx - a * my')} AS dy,
       {S.r6('atan2(b, a)')} AS da FROM sz JOIN h USING (vec_id)"""


@query("consensus_fit", CONSENSUS_SQL)
def q_consensus_fit(spark, d):
    """Motions planted in the pairs of vectors, a third of the matches being outliers, found again."""
    return MO.rounded(MO.consensus_fit(MO.planted(MO.matches(MO.vector_pairs(table(spark, d, "embeddings"))))))


@query("rising_runs", TF + """,
sg AS (SELECT video, CAST(floor(greatest(frame - 1, 0) / 200) AS BIGINT) AS segment, frame, dx,
              lag(dx) OVER (PARTITION BY video, floor(greatest(frame - 1, 0) / 200) ORDER BY frame) AS before FROM tf),
rn AS (SELECT *, sum(CASE WHEN dx > before THEN 0 ELSE 1 END) OVER (PARTITION BY video, segment ORDER BY frame) AS run FROM sg)
SELECT video, segment, min(frame) AS first_frame, count(*) AS n_frames, min(dx) AS low, max(dx) AS high
FROM rn GROUP BY video, segment, run""")
def q_rising_runs(spark, d):
    """A table function over the frames of each segment, one row per run of rising values."""
    from quarry.functions.tables import rising_runs
    return rising_runs(_tf(spark, d))


@query("nearest_centroid", """
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL),
d AS (SELECT e.vec_id, e.label, c.label AS other, sum((e.x - c.x) ** 2) AS dist FROM e JOIN c USING (i) GROUP BY ALL)
SELECT vec_id, label, arg_min(other, (dist, other)) AS nearest, """ + S.r6("min(dist)") + """ AS distance FROM d GROUP BY vec_id, label""")
def q_nearest_centroid(spark, d):
    """Vectors scored with the labels' centroids by a scorer that is made once a task."""
    from quarry.operators.scoring import centroids, nearest_centroid
    em = table(spark, d, "embeddings")
    return nearest_centroid(em, centroids(em)).withColumn("distance", stable_round("distance", 6))


@query("tolerant_scores", r"""
SELECT event_id, CASE WHEN k % 3 <> 0 THEN 100 // (k % 3) END AS score
FROM (SELECT event_id, CAST(regexp_extract(props, '"k":\s*(-?\d+)', 1) AS BIGINT) AS k FROM events)""")
def q_tolerant_scores(spark, d):
    """A Python model that fails on a third of the rows: these are null, the others scored."""
    from quarry.functions.udfs import tolerant_udf
    score = tolerant_udf(lambda s: s.map(lambda k: 100 // (int(k) % 3)), "long")
    k = F.regexp_extract("props", r'"k":\s*(-?\d+)', 1)
    return table(spark, d, "events").select("event_id", score(k).alias("score"))


@query("own_moments", f"""
WITH m AS (SELECT l_returnflag, avg(l_extendedprice) AS mu FROM lineitem GROUP BY 1)
SELECT l_returnflag, count(*) AS n, {S.r6('any_value(mu)', 4)} AS mean, {S.r6('avg((l_extendedprice - mu) ** 2)', 2)} AS variance,
       {S.r6('avg((l_extendedprice - mu) ** 3) / avg((l_extendedprice - mu) ** 2) ** 1.5')} AS skewness
FROM lineitem JOIN m USING (l_returnflag) GROUP BY l_returnflag""")
def q_own_moments(spark, d):
    """Moments by an aggregate of one's own: partial states per task, merged in a tree."""
    from quarry.functions.aggregates import Moments, aggregate
    return aggregate(_li(spark, d), ["l_returnflag"], "l_extendedprice", Moments()).select(
        "l_returnflag", "n", stable_round("mean", 4).alias("mean"), stable_round("variance", 2).alias("variance"),
        stable_round("skewness", 6).alias("skewness"))


@query("own_histogram", """
WITH b AS (SELECT user_id, CAST(least(greatest(floor(value / 10), 0), 9) AS BIGINT) AS bin FROM events),
c AS (SELECT u.user_id, r.bin, count(b.bin) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN range(0, 10) r(bin)
      LEFT JOIN b ON b.user_id = u.user_id AND b.bin = r.bin GROUP BY ALL)
SELECT user_id, sum(n)::BIGINT AS n, string_agg(n::VARCHAR, ',' ORDER BY bin) AS bins, arg_max(bin, (n, -bin)) AS fullest
FROM c GROUP BY user_id""")
def q_own_histogram(spark, d):
    """Histograms of every user's values by an aggregate of one's own."""
    from quarry.functions.aggregates import Histogram, aggregate
    return aggregate(table(spark, d, "events"), ["user_id"], "value", Histogram(0.0, 100.0, 10)).withColumn(
        "bins", F.array_join(F.transform("bins", lambda b: b.cast("string")), ","))


@query("cap_per_group", TF + f"""
SELECT video, frame, event_id FROM tf WHERE frame < {MAX_FRAMES}""")
def q_cap_per_group(spark, d):
    ev = I.first_events(spark, d, MAX_FRAMES, [])
    return TR.cap_per_group(ev.select(F.col("user_id").alias("video"), (F.col("rn") - 1).alias("frame"), "event_id"), MAX_FRAMES)


@query("paced_events", TF + f""",
st AS (SELECT video, min(ts) AS s FROM tf GROUP BY video),
du AS (SELECT video, frame, ts, CAST(epoch_us(s) + floor(frame * 1000000 / {FPS}) AS BIGINT) AS due_us
       FROM tf JOIN st USING (video))
SELECT video, frame, due_us, {S.r6('(epoch_us(ts) - due_us) / 1e6')} AS lateness_s FROM du""")
def q_paced_events(spark, d):
    return TR.paced(_tf(spark, d), FPS)


@query("round_robin", f"""
SELECT user_id % {N_SINKS} AS sink, count(DISTINCT user_id) AS n_videos, count(*) AS n_frames
FROM events GROUP BY 1""")
def q_round_robin(spark, d):
    tf = table(spark, d, "events").select(F.col("user_id").alias("video"))
    return TR.round_robin_sinks(tf, N_SINKS)


# ---------------------------------------------------------------- majority vote

VOTE_SQL = "WITH " + S.EV_RN + ", " + S.VOTES + """,
vc AS (SELECT *, count(*) OVER (PARTITION BY item, label ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
       FROM votes WHERE k <= 11),
vg AS (SELECT item, count(*) AS n,
              arg_min(label, k) FILTER (WHERE k <= 3 AND c >= 2) AS el, min(k) FILTER (WHERE k <= 3 AND c >= 2) AS ek,
              arg_min(label, k) FILTER (WHERE k >= 4 AND c >= floor(k / 2) + 1) AS ll,
              min(k) FILTER (WHERE k >= 4 AND c >= floor(k / 2) + 1) AS lk
       FROM vc GROUP BY item),
res AS (SELECT item, CAST(CASE WHEN ek IS NOT NULL THEN least(3, n) WHEN lk IS NOT NULL THEN lk ELSE n END AS BIGINT) AS models_run,
               coalesce(el, ll) AS winner, ek IS NOT NULL AS stopped_early FROM vg),
ran AS (SELECT v.* FROM votes v JOIN res r USING (item) WHERE v.k <= r.models_run),
pick AS (SELECT item, k, label,
         ['Resnet18','Resnet50','Resnet101','BEiT','ConvNeXT','ViT384','MIT_B0'][CAST(""" \
    + S.lcg_sql("item * 1000 + k") + """ % 7 + 1 AS INTEGER)] AS model,
         [0.007, 0.007, 0.011, 0.018, 0.006, 0.059, 0.016][CAST(""" + S.lcg_sql("item * 1000 + k") \
    + """ % 7 + 1 AS INTEGER)] AS service_s
         FROM votes WHERE k <= 11)"""


def _votes(spark, d):
    return I.votes(spark, d, V.MAX_RUN)


@query("majority_vote", VOTE_SQL + " SELECT * FROM res")
def q_majority_vote(spark, d):
    return V.majority_vote(_votes(spark, d))


@query("vote_tally", VOTE_SQL + " SELECT item, label, count(*) AS n_votes FROM ran GROUP BY ALL")
def q_vote_tally(spark, d):
    v = _votes(spark, d)
    return V.vote_tally(v, V.majority_vote(v))


@query("model_pick", VOTE_SQL + " SELECT item, k, label, model, CAST(service_s AS DOUBLE) AS service_s FROM pick")
def q_model_pick(spark, d):
    return V.model_pick(_votes(spark, d).filter(F.col("k") <= V.MAX_RUN))


@query("vote_summary", VOTE_SQL + """,
lat AS (SELECT item, sum(CAST(p.service_s AS DOUBLE)) AS latency_s FROM ran JOIN pick p USING (item, k) GROUP BY item),
j AS (SELECT r.*, CASE WHEN l.latency_s > 0 THEN l.latency_s END AS pos FROM res r LEFT JOIN lat l USING (item))
SELECT count(*) AS n_items, CAST(sum(models_run) AS BIGINT) AS total_models_run,
       count(*) FILTER (WHERE stopped_early) AS n_stopped_at_3,
       """ + S.r6("sum(pos)") + " AS total_latency_s, " + S.r6("avg(pos)") + " AS mean_latency_s, " \
    + S.r6("max(pos)") + " AS max_latency_s, count(winner) AS n_decided FROM j")
def q_vote_summary(spark, d):
    v = _votes(spark, d)
    return V.vote_summary(v, V.majority_vote(v))


# ---------------------------------------------------------------- sort, shuffle, dataflow

N_SLICES = 8  # divides the 64 elements of a vector, so no element is left over
N_SHUFFLES = 3
N_BUCKETS = 7
N_RANGE = 8
ROW_ID = "(l_orderkey * 8 + l_linenumber)"


def _li(spark, d):
    return table(spark, d, "lineitem")


def _slices(spark, d):
    return X.split_slices(table(spark, d, "embeddings"), N_SLICES)


@query("gen_rows", f"""
SELECT {ROW_ID} AS row_id, {ROW_ID} % 8 AS block, {S.lcg_sql(ROW_ID, 1)} AS c_0, {S.lcg_sql(ROW_ID, 2)} AS c_1
FROM lineitem""")
def q_gen_rows(spark, d):
    return X.gen_rows(_li(spark, d), 2, 8)


@query("global_sort", """
SELECT l_orderkey, l_linenumber, l_extendedprice,
       row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS pos FROM lineitem""")
def q_global_sort(spark, d):
    return X.global_sort(_li(spark, d))


@query("random_shuffle", f"""
SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY {S.lcg_sql(ROW_ID)}, {ROW_ID}) AS pos FROM lineitem""")
def q_random_shuffle(spark, d):
    return X.random_shuffle(_li(spark, d))


@query("range_partition", f"""
SELECT CAST({N_RANGE} AS BIGINT) AS n_outputs, count(*) AS n_rows, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
       CAST(0 AS BIGINT) AS n_overlaps FROM lineitem""")
def q_range_partition(spark, d):
    """Exactly N ordered outputs, checked by what does not depend on where the bounds fall."""
    return X.range_invariants(X.range_partition(_li(spark, d), N_RANGE))


@query("partition_stats", f"""
SELECT l_orderkey // {X.BLOCK_KEYS} AS block, count(*) AS num_rows, count(DISTINCT l_orderkey) AS num_orders,
       min(l_orderkey) AS first_key, max(l_orderkey) AS last_key, {S.r6('sum(l_extendedprice)', 2)} AS total_price
FROM lineitem GROUP BY 1""")
def q_partition_stats(spark, d):
    return X.partition_stats(_li(spark, d))


@query("ordered_delivery", f"""
SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS pos,
       true AS in_its_range FROM lineitem""")
def q_ordered_delivery(spark, d):
    """Line items in ordered outputs, read back by the manifest: the position each is delivered
    at, and whether it lies between its output's smallest and largest key."""
    from quarry.operators.ordered import manifest, read_ordered, write_ordered
    keys = ["l_extendedprice", "l_orderkey", "l_linenumber"]
    li = _li(spark, d).select(*keys)
    path = write_ordered(li, keys, N_RANGE)
    m = manifest(spark, path).select("output", "lo", "hi")
    key = F.struct(*keys)
    return read_ordered(spark, path, li.schema).join(F.broadcast(m), "output").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "pos", ((key >= F.col("lo")) & (key <= F.col("hi"))).alias("in_its_range"))


@query("ordered_report", f"""
SELECT {N_RANGE}::BIGINT AS n_outputs, count(*) AS n_rows, 0::BIGINT AS broken_inside, 0::BIGINT AS broken_between FROM lineitem""")
def q_ordered_report(spark, d):
    """How often the order is broken inside and between the outputs of a shuffled delivery."""
    from quarry.operators.ordered import order_report, write_ordered
    r = X.row_ids(_li(spark, d)).select("row_id").withColumn("k", lcg("row_id"))
    return order_report(spark, write_ordered(r, ["k", "row_id"], N_RANGE), ["k", "row_id"], r.schema)


SLICES_SQL = f"""WITH sl AS (
  SELECT vec_id, label, s AS slice_idx, CAST(floor(len(embedding) / {N_SLICES}) AS BIGINT) AS sz, embedding
  FROM embeddings, range(0, {N_SLICES}) t(s)),
el AS (
  SELECT vec_id, label, slice_idx, sz, CAST(embedding[slice_idx * sz + i + 1] AS DOUBLE) AS v
  FROM (SELECT *, unnest(generate_series(0, sz - 1)) AS i FROM sl)),
ss AS (SELECT vec_id, label, slice_idx, count(*) AS n_values, sum(v) AS s FROM el GROUP BY ALL)"""


@query("split_slices", SLICES_SQL + f"""
SELECT vec_id, slice_idx, n_values, {S.r6('s')} AS slice_sum FROM ss""")
def q_split_slices(spark, d):
    return X.slice_summary(_slices(spark, d)).withColumn("n_values", F.col("n_values").cast("long"))


@query("all_to_all", SLICES_SQL + f"""
SELECT slice_idx, count(*) AS n_mappers, CAST(sum(n_values) AS BIGINT) AS n_values, {S.r6('sum(s)')} AS total
FROM ss GROUP BY slice_idx""")
def q_all_to_all(spark, d):
    return X.all_to_all(_slices(spark, d))


@query("parallel_shuffle", SLICES_SQL + f"""
SELECT vec_id % {N_SHUFFLES} AS shuffle_id, slice_idx, count(*) AS n_mappers, {S.r6('sum(s)')} AS total
FROM ss GROUP BY ALL""")
def q_parallel_shuffle(spark, d):
    return X.parallel_shuffle(_slices(spark, d), N_SHUFFLES)


@query("two_stage_shuffle", SLICES_SQL + f"""
SELECT slice_idx, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_mappers, {S.r6('sum(t)')} AS total
FROM (SELECT label, slice_idx, sum(s) AS t, count(*) AS n FROM ss GROUP BY ALL) GROUP BY slice_idx""")
def q_two_stage_shuffle(spark, d):
    return X.two_stage_shuffle(_slices(spark, d))


@query("one_slice", SLICES_SQL + f"""
SELECT vec_id, {S.r6('s')} AS slice_sum FROM ss WHERE slice_idx = 0""")
def q_one_slice(spark, d):
    return X.one_slice(table(spark, d, "embeddings"), N_SLICES)


@query("skewed_group", f"""
SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey END AS skew_key, count(*) AS n_rows,
       {S.r6('sum(l_quantity)')} AS sum_qty FROM lineitem GROUP BY 1""")
def q_skewed_group(spark, d):
    return X.skewed_group(_li(spark, d))


BUCKET_SQL = f"""WITH b AS (SELECT s_suppkey, ntile({N_BUCKETS}) OVER (ORDER BY s_suppkey) AS bucket FROM supplier),
bp AS (SELECT s_suppkey, bucket, row_number() OVER (PARTITION BY bucket ORDER BY s_suppkey) AS pos_in_bucket FROM b)"""


def _buckets(spark, d):
    return X.balanced_buckets(table(spark, d, "supplier"), "s_suppkey", N_BUCKETS)


@query("balanced_buckets", BUCKET_SQL + " SELECT * FROM bp")
def q_balanced_buckets(spark, d):
    return _buckets(spark, d).select("s_suppkey", "bucket", "pos_in_bucket")


@query("interleave", BUCKET_SQL + """
SELECT *, row_number() OVER (ORDER BY pos_in_bucket, bucket) AS rr_order FROM bp""")
def q_interleave(spark, d):
    return X.interleave(_buckets(spark, d), "s_suppkey", N_BUCKETS)


@query("stage_chain", f"""
SELECT l_orderkey, l_linenumber,
       {S.r6('(l_extendedprice * (1 - l_discount) * (1 + l_tax) - l_quantity) / 2')} AS stage_out FROM lineitem""")
def q_stage_chain(spark, d):
    return X.stage_chain(_li(spark, d))


@query("diamond", f"""
WITH sh AS (SELECT * FROM lineitem)
SELECT coalesce(a.l_returnflag, b.l_returnflag) AS l_returnflag, a.sum_qty, b.avg_price
FROM (SELECT l_returnflag, {S.r6('sum(l_quantity)')} AS sum_qty FROM sh GROUP BY 1) a
JOIN (SELECT l_returnflag, {S.r6('avg(l_extendedprice)')} AS avg_price FROM sh GROUP BY 1) b
ON a.l_returnflag IS NOT DISTINCT FROM b.l_returnflag""")
def q_diamond(spark, d):
    return X.diamond(_li(spark, d))


@query("three_way", f"""
SELECT o_orderkey, o_orderstatus, c_mktsegment, n_lines, {S.r6('rev')} AS revenue
FROM (SELECT l_orderkey, count(*) AS n_lines, sum(l_extendedprice * (1 - l_discount)) AS rev FROM lineitem GROUP BY 1) l
JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey""")
def q_three_way(spark, d):
    return X.three_way(_li(spark, d), table(spark, d, "orders"), table(spark, d, "customer"))


@query("gather_all", f"""
SELECT count(*) AS n_rows, {S.r6('sum(l_quantity)')} AS sum_qty, {S.r6('sum(l_extendedprice)')} AS sum_price,
       {S.r6('avg(l_discount)')} AS avg_disc FROM lineitem""")
def q_gather_all(spark, d):
    return X.gather_all(_li(spark, d))


@query("partial_final", f"""
SELECT l_returnflag, l_linestatus, {S.r6('sum(l_quantity)')} AS sum_qty, {S.r6('sum(l_extendedprice)')} AS sum_base_price,
       {S.r6('sum(l_extendedprice * (1 - l_discount))')} AS sum_disc_price,
       {S.r6('sum(l_extendedprice * (1 - l_discount) * (1 + l_tax))')} AS sum_charge,
       {S.r6('avg(l_quantity)')} AS avg_qty, {S.r6('avg(l_extendedprice)')} AS avg_price,
       {S.r6('avg(l_discount)')} AS avg_disc, count(*) AS count_order
FROM lineitem GROUP BY ALL""")
def q_partial_final(spark, d):
    return X.partial_final(_li(spark, d))


@query("scatter_gather", f"""
SELECT l_returnflag, count(*) AS n_parts, {S.r6('avg(a)')} AS avg_of_avgs
FROM (SELECT l_returnflag, l_suppkey, avg(l_extendedprice) AS a FROM lineitem GROUP BY ALL) GROUP BY 1""")
def q_scatter_gather(spark, d):
    return X.scatter_gather(_li(spark, d))


@query("running_backlog", """
WITH pd AS (
  SELECT day, sum(delta) AS delta FROM (
    SELECT strftime(o.o_orderdate, '%Y-%m-%d') AS day, count(*) AS delta
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1
    UNION ALL
    SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, -count(*) AS delta FROM lineitem GROUP BY 1) GROUP BY day)
SELECT day, CAST(delta AS BIGINT) AS delta,
       CAST(sum(delta) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS backlog FROM pd""")
def q_running_backlog(spark, d):
    return X.running_backlog(_li(spark, d), table(spark, d, "orders"))


@query("hetero_union", f"""
SELECT 'sort' AS kind, count(*) AS n_rows, {S.r6('sum(l_extendedprice)')} AS total FROM lineitem
UNION ALL SELECT 'shuffle', count(*), {S.r6('sum(o_totalprice)')} FROM orders
UNION ALL SELECT 'stream', count(*), {S.r6('sum(value)')} FROM events""")
def q_hetero_union(spark, d):
    def one(df, kind, col):
        return df.agg(F.count(F.lit(1)).alias("n_rows"), stable_round(F.sum(col), 6).alias("total")) \
                 .select(F.lit(kind).alias("kind"), "n_rows", "total")
    return (one(_li(spark, d), "sort", "l_extendedprice")
            .unionByName(one(table(spark, d, "orders"), "shuffle", "o_totalprice"))
            .unionByName(one(table(spark, d, "events"), "stream", "value")))


@query("param_grid", """
SELECT series, workers, partitions, partition_size, trial
FROM (SELECT DISTINCT o_orderpriority AS series FROM orders),
     (VALUES (8), (16)) w(workers), (VALUES (320), (512)) p(partitions),
     (VALUES (10000000), (50000000), (100000000)) s(partition_size), range(1, 4) t(trial)""")
def q_param_grid(spark, d):
    from quarry.operators import sweep
    return sweep.param_grid(table(spark, d, "orders").select(F.col("o_orderpriority").alias("series")).distinct())


# ---------------------------------------------------------------- result analytics

TRIALS_SQL = "WITH " + S.TRIALS
SCHEMES = ["F", "O", "P"]


@query("trial_stats", TRIALS_SQL + f"""
SELECT series, scheme, count(*) AS n_trials, {S.r6('avg(runtime)')} AS mean_runtime,
       {S.r6('stddev_pop(runtime)')} AS std_runtime, {S.r6('var_pop(runtime)', 3)} AS var_runtime,
       CAST(floor(sum(spilled) / count(*)) AS BIGINT) AS spilled_floor_mean,
       {S.r6('avg((migrations + remote_migrations) / 8)')} AS per_node_mean
FROM trials GROUP BY ALL""")
def q_trial_stats(spark, d):
    return RS.trial_stats(I.trials(spark, d))


@query("result_pivot", TRIALS_SQL + f"""
SELECT working_set, coalesce({S.r6("avg(runtime) FILTER (WHERE scheme = 'F')")}, 0.0) AS F,
       coalesce({S.r6("avg(runtime) FILTER (WHERE scheme = 'O')")}, 0.0) AS O,
       coalesce({S.r6("avg(runtime) FILTER (WHERE scheme = 'P')")}, 0.0) AS P,
       coalesce({S.r6("avg(runtime) FILTER (WHERE scheme IS NULL OR scheme NOT IN ('F', 'O', 'P'))")}, 0.0) AS other
FROM trials WHERE series = '1-URGENT' GROUP BY working_set""")
def q_result_pivot(spark, d):
    return RS.result_pivot(I.trials(spark, d), "1-URGENT", SCHEMES)


@query("result_table", TRIALS_SQL + f"""
SELECT series, scheme, working_set, min(runtime) AS min_runtime, max(runtime) AS max_runtime,
       {S.r6('avg(runtime)')} AS mean_runtime, {S.r6('avg(spilled)')} AS mean_spilled,
       {S.r6('avg(migrations)')} AS mean_migrations
FROM trials GROUP BY ALL""")
def q_result_table(spark, d):
    return RS.result_table(I.trials(spark, d))


@query("error_bars", TRIALS_SQL + f"""
SELECT series, scheme, {S.r6('avg(runtime)')} AS mean_runtime,
       {S.r6('avg(runtime) - stddev_pop(runtime) / 2')} AS bar_lo, {S.r6('avg(runtime) + stddev_pop(runtime) / 2')} AS bar_hi
FROM trials GROUP BY ALL""")
def q_error_bars(spark, d):
    return RS.error_bars(I.trials(spark, d))


LAT_SQL = "WITH " + S.EV_RN + f""",
lat AS (SELECT event_type AS file, user_id AS video, rn - 1 AS frame, event_id, 1.0 + value / 1000.0 AS latency_s FROM ev_rn),
mx AS (SELECT file, max(frame) AS mf FROM lat GROUP BY file),
kept AS (SELECT l.*, (latency_s - 1) * 1000 AS ms FROM lat l JOIN mx USING (file) WHERE frame > {3 * FPS} AND frame < mf)"""


def _latencies(spark, d):
    ev = I.numbered_events(spark, d, ["value", "event_type"])
    tf = ev.select("event_type", F.col("user_id").alias("video"), (F.col("rn") - 1).alias("frame"),
                   "event_id", F.col("value").alias("dx"))
    return RS.frame_latencies(tf)


@query("latency_stats", LAT_SQL + f"""
SELECT file, count(*) AS n, {S.r6('avg(ms)')} AS mean_ms, {S.r6('quantile_cont(ms, 0.5)')} AS p50_ms,
       {S.r6('quantile_cont(ms, 0.9)')} AS p90_ms, {S.r6('quantile_cont(ms, 0.99)')} AS p99_ms,
       {S.r6('max(ms)')} AS max_ms FROM kept GROUP BY file""")
def q_latency_stats(spark, d):
    return RS.latency_stats(_latencies(spark, d), FPS)


@query("ecdf", """
SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id)
       / count(*) OVER (PARTITION BY event_type) AS ecdf FROM events""")
def q_ecdf(spark, d):
    return RS.ecdf(table(spark, d, "events"), ["event_type"], "value", "event_id")


@query("last_value", """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_event_type, count(*) AS n_lines FROM events GROUP BY 1""")
def q_last_value(spark, d):
    return RS.last_value(table(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"])


# ---------------------------------------------------------------- text and logs

WORDS_SQL = r"""CASE WHEN regexp_replace(text, '^\s+|\s+$', '', 'g') = '' THEN []::VARCHAR[]
     ELSE regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') END"""


def _words_sql(col: str) -> str:
    return WORDS_SQL.replace("text", col)


PARSE_SQL = f"""
WITH w AS (SELECT doc_id, text, {_words_sql('text')} AS w FROM documents),
i AS (SELECT *, coalesce(list_position(w, 'the'), 0) AS idx, instr(text, 'and') AS pos FROM w),
r AS (SELECT *, CASE WHEN pos > 0 THEN {_words_sql('substr(text, pos + 1)')} END AS rest FROM i),
t AS (SELECT *, CASE WHEN pos > 0 AND coalesce(list_position(rest, 'and'), 0) > 0
                     THEN rest[list_position(rest, 'and') + 2] END AS tok FROM r)
SELECT doc_id,
       CASE WHEN idx > 0 THEN coalesce(w[idx + 1], '') ELSE '' END AS amount,
       CASE WHEN idx > 0 THEN coalesce(w[idx + 3], '') ELSE '' END AS objects,
       CASE WHEN idx > 0 THEN coalesce(w[idx + 8], '') ELSE '' END AS throughput,
       coalesce(try_cast(CASE WHEN idx > 0 THEN coalesce(w[idx + 1], '') ELSE '' END AS DOUBLE), 0.0) AS amount_num,
       substr(tok, 1, length(tok) - 1) AS duration
FROM t"""


@query("parse_stats", PARSE_SQL)
def q_parse_stats(spark, d):
    return LG.parse_stats(table(spark, d, "documents"), "the", duration_marker="and")


@query("parse_numbers", PARSE_SQL.replace("'the'", "'version'"))
def q_parse_numbers(spark, d):
    """The same after a marker that numbers follow, so they are parsed where there are any."""
    return LG.parse_stats(table(spark, d, "documents"), "version", duration_marker="and")


@query("sum_stats", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
w AS (SELECT doc_id, {_words_sql('line')} AS w FROM l),
h AS (SELECT doc_id, list_position(w, 'the') AS p, w FROM w WHERE coalesce(list_position(w, 'the'), 0) > 0)
SELECT doc_id, count(*) AS n_lines, sum(coalesce(try_cast(w[p + 1] AS DOUBLE), 0)) AS amount,
       sum(coalesce(try_cast(w[p + 3] AS DOUBLE), 0)) AS objects FROM h GROUP BY doc_id""")
def q_sum_stats(spark, d):
    return LG.sum_stats(table(spark, d, "documents"), "the")


@query("first_match", """
SELECT b.item_id, min(d.doc_id) AS doc_id
FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id""")
def q_first_match(spark, d):
    tokens = table(spark, d, "benchmark").select("item_id", F.col("text").alias("token"))
    return LG.first_match(tokens, table(spark, d, "documents").select("doc_id", "text")).select("item_id", "doc_id")


@query("log_runs", """
WITH a AS (SELECT user_id, event_type,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
                  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn2 FROM events)
SELECT user_id, event_type, min(rn) AS run_start, count(*) AS run_length FROM a GROUP BY user_id, event_type, rn - rn2""")
def q_log_runs(spark, d):
    return LG.run_lengths(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


# ---------------------------------------------------------------- sources and scalar functions

N_TRAILING = 6
BATCH_SIZE = 500
N_IMAGES = 12


@query("distinct_keys", """
SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, user_id FROM events""")
def q_distinct_keys(spark, d):
    return table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id").distinct()


@query("scan_by_month", f"""
SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n_orders,
       {S.r6('sum(o_totalprice)')} AS revenue FROM orders GROUP BY ALL""")
def q_scan_by_month(spark, d):
    o = table(spark, d, "orders")
    return (o.groupBy(F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("month"))
             .agg(F.count(F.lit(1)).alias("n_orders"), stable_round(F.sum("o_totalprice"), 6).alias("revenue")))


@query("last_n_files", f"""
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS file, * FROM orders),
lastm AS (SELECT DISTINCT file FROM m ORDER BY file DESC LIMIT {N_TRAILING})
SELECT file, count(*) AS n_orders, {S.r6('sum(o_totalprice)')} AS revenue FROM m WHERE file IN (SELECT file FROM lastm)
GROUP BY file""")
def q_last_n_files(spark, d):
    from quarry.sources.partitioned import last_n_periods
    o = table(spark, d, "orders").withColumn("file", F.date_format("o_orderdate", "yyyy-MM"))
    return (last_n_periods(o, "file", N_TRAILING).groupBy("file")
            .agg(F.count(F.lit(1)).alias("n_orders"), stable_round(F.sum("o_totalprice"), 6).alias("revenue")))


@query("modulo_lookup", f"""
SELECT e.event_id, p.p_partkey, p.p_name FROM events e
JOIN part p ON p.p_partkey = e.event_id % {N_IMAGES} + 1""")
def q_modulo_lookup(spark, d):
    catalogue = table(spark, d, "part").filter(F.col("p_partkey").between(1, N_IMAGES)).select("p_partkey", "p_name")
    ev = table(spark, d, "events").select("event_id", (F.pmod("event_id", F.lit(N_IMAGES)) + 1).alias("p_partkey"))
    # p_partkey is the part key, so the filtered catalogue has at most N_IMAGES rows.
    return ev.join(F.broadcast(catalogue), "p_partkey").select("event_id", "p_partkey", "p_name")


@query("batch_arrivals", f"""
SELECT event_id, seq, seq // {BATCH_SIZE} AS batch FROM (
  SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq FROM events)""")
def q_batch_arrivals(spark, d):
    from quarry.plans.sequence import number_rows
    ev = number_rows(table(spark, d, "events").select("event_id", "ts"), [], ["ts", "event_id"], rn="_rn")
    seq = F.col("_rn") - 1
    return ev.select("event_id", seq.alias("seq"), F.floor(seq / F.lit(BATCH_SIZE)).cast("long").alias("batch"))


@query("normalize_vec", """
SELECT vec_id, i - 1 AS i,
       round((x - [0.485, 0.456, 0.406][((i - 1) % 3) + 1]) / [0.229, 0.224, 0.225][((i - 1) % 3) + 1] + 1e-9, 6) AS value
FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)""")
def q_normalize_vec(spark, d):
    from quarry.functions.scalars import normalize_channels
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return e.select("vec_id", F.col("i").cast("long").alias("i"),
                    stable_round(normalize_channels(F.col("x").cast("double"), F.col("i")), 6).alias("value"))


@query("strict_bool", """
SELECT toxic = 1 AS flag, count(*) AS n FROM labels GROUP BY 1""")
def q_strict_bool(spark, d):
    from quarry.functions.scalars import strict_bool
    raw = table(spark, d, "labels").select(
        F.when(F.col("toxic") == 1, F.lit("true")).otherwise(F.lit("False")).alias("flag_text"))
    return raw.select(strict_bool("flag_text").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("size_plan", """
SELECT l_returnflag, count(*) AS n_rows, count(*) * 64 AS est_bytes,
       CAST(least(ceil(count(*) * 64 / 65536), 8) AS BIGINT) AS num_partitions FROM lineitem GROUP BY 1""")
def q_size_plan(spark, d):
    from quarry.functions.scalars import ceil_div
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"))
    g = g.withColumn("est_bytes", F.col("n_rows") * 64)
    return g.withColumn("num_partitions", F.least(ceil_div("est_bytes", F.lit(65536)), F.lit(8)).cast("long"))


@query("metrics_json", TRIALS_SQL + """,
runs AS (SELECT series, sum(runtime) AS time, count(*) AS num_partitions, max(trial_id) AS partition_size,
                sum(spilled) AS spilled, sum(migrations) AS migrations FROM trials GROUP BY series)
SELECT round(time + 1e-9, 2) AS time, true AS success, num_partitions, partition_size, m.name,
       CAST(CASE m.name WHEN 'spilled' THEN spilled ELSE migrations END AS DOUBLE) AS value, 'gauge' AS type
FROM runs, (VALUES ('spilled'), ('migrations')) m(name)""")
def q_metrics_json(spark, d):
    """Metrics documents written as JSON and read back, one row per run and metric."""
    from quarry.sources import sinks
    runs = I.trials(spark, d).groupBy("series").agg(
        F.sum("runtime").alias("time"), F.lit(True).alias("success"), F.count(F.lit(1)).alias("num_partitions"),
        F.max("trial_id").alias("partition_size"), F.sum("spilled").alias("spilled"),
        F.sum("migrations").alias("migrations"))
    path = scratch_path(spark, "metrics-json")
    sinks.write_metrics_json(sinks.metrics_records(runs, ["spilled", "migrations"]), path)
    return sinks.read_metrics_json(spark, path).withColumn("time", stable_round("time", 2))


@query("csv_roundtrip", """
SELECT o_totalprice AS object_store_size, o_custkey AS num_workers, CAST(month(o_orderdate) AS BIGINT) AS num_partitions,
       CAST(o_orderkey AS DOUBLE) AS partition_size, o_totalprice / 2 AS runtime FROM orders""")
def q_csv_roundtrip(spark, d):
    """Result rows appended as header-less CSV and read back under their fixed schema."""
    from quarry.sources import results_csv, sinks
    o = table(spark, d, "orders").select(
        F.col("o_totalprice").alias("object_store_size"), F.col("o_custkey").alias("num_workers"),
        F.month("o_orderdate").alias("num_partitions"), F.col("o_orderkey").cast("double").alias("partition_size"),
        (F.col("o_totalprice") / 2).alias("runtime"))
    path = scratch_path(spark, "results-csv")
    sinks.append_csv(o, path)
    return results_csv.read_results(spark, path, "config_sweep", header=False)


@query("latency_text_roundtrip", """
SELECT event_id AS frame, 1.0 + value / 1000.0 AS latency_s FROM events""")
def q_latency_text_roundtrip(spark, d):
    """Latency lines written as text and read back."""
    from quarry.sources import sinks
    lat = table(spark, d, "events").select(F.col("event_id").alias("frame"),
                                           (F.lit(1.0) + F.col("value") / F.lit(1000.0)).alias("latency_s"))
    path = scratch_path(spark, "latency-text")
    sinks.write_latency_text(lat, path)
    return sinks.read_latency_text(spark, path)


@query("scan_year_month", f"""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n_orders,
       {S.r6('sum(o_totalprice)')} AS revenue FROM orders GROUP BY ALL""")
def q_scan_year_month(spark, d):
    """Orders laid out by year and month, found again by the paths of their files."""
    from quarry.sources.partitioned import read_year_month, write_year_month
    path = scratch_path(spark, "year-month")
    write_year_month(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), path, "o_orderdate")
    return (read_year_month(spark, path).groupBy("year", "month")
            .agg(F.count(F.lit(1)).alias("n_orders"), stable_round(F.sum("o_totalprice"), 6).alias("revenue")))


@query("generated_rows", f"""
SELECT row_id, {S.lcg_sql('row_id', 1)} AS c_0, {S.lcg_sql('row_id', 2)} AS c_1
FROM (SELECT unnest(range(0, (SELECT count(*) FROM lineitem))) AS row_id)""")
def q_generated_rows(spark, d):
    """Generated rows keyed by the places of the line items in key order."""
    li = number_rows(_li(spark, d).select("l_orderkey", "l_linenumber"), [], ["l_orderkey", "l_linenumber"])
    return li.select((F.col("rn") - 1).alias("row_id")).select("row_id", *[lcg("row_id", j + 1).alias(f"c_{j}") for j in range(2)])


@query("source_scan", """
SELECT l_orderkey, l_suppkey, l_quantity, l_returnflag FROM lineitem
WHERE l_suppkey >= 5 AND l_returnflag IN ('A', 'R') AND l_quantity < 30""")
def q_source_scan(spark, d):
    """Line items through the Python source: filters pushed into it, row groups pruned by statistics."""
    from quarry.sources.table_files import scan
    li = scan(spark, f"{d.rstrip('/')}/lineitem.parquet", ["l_orderkey", "l_suppkey", "l_quantity", "l_returnflag"])
    return li.filter((F.col("l_suppkey") >= 5) & F.col("l_returnflag").isin("A", "R") & (F.col("l_quantity") < 30))


@query("delivery_log", TF + """,
dl AS (SELECT video, frame FROM tf UNION ALL SELECT video, frame FROM tf WHERE frame % 7 = 3
       UNION ALL SELECT video, frame FROM tf WHERE frame >= 25 AND frame < 30)
SELECT video, count(*) AS n_received, count(DISTINCT frame) AS n_delivered,
       count(*) - count(DISTINCT frame) AS n_duplicates,
       max(frame) + 1 - count(DISTINCT frame) AS n_missing, max(frame) AS last_frame
FROM dl GROUP BY video""")
def q_delivery_log(spark, d):
    """Deliveries through the exactly-once sink: two epochs that overlap, the second replayed; the
    replay leaves nothing, so every row counts as often as its epochs delivered it."""
    from quarry.sources import delivery_log
    rows = TR.replayed_deliveries(_tf(spark, d)).select("video", "frame").checkpoint()
    path = scratch_path(spark, "delivery-log")
    delivery_log.append(rows.filter("frame < 30"), path, 0)
    later = rows.filter("frame >= 30").unionByName(rows.filter("frame >= 25 and frame < 30").distinct())
    for _ in range(2):
        delivery_log.append(later, path, 1)
    return TR.idempotent_sink(delivery_log.read_log(spark, path, "video long, frame long"))


@query("task_lines", r"""
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations),
w AS (SELECT *, """ + _words_sql("line") + r""" AS w FROM l)
SELECT conv_id, turn, coalesce(w[2], '') AS task_name, coalesce(regexp_extract(line, '(\[[^\]]*\])', 1), '') AS priority,
       count(*) AS n_lines FROM w GROUP BY ALL""")
def q_task_lines(spark, d):
    """Name and priority parsed from every line of the conversations, as from a task log."""
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    t = lines.select("conv_id", "turn", LG.parse_task_line(F.col("line")).alias("t"))
    return t.groupBy("conv_id", "turn", F.coalesce("t.task_name", F.lit("")).alias("task_name"),
                     F.coalesce("t.priority", F.lit("")).alias("priority")).agg(F.count(F.lit(1)).alias("n_lines"))


TASK_RUNS_SQL = r"""
WITH log AS (SELECT user_id, ts, event_id, 'run ' || event_type || ' [' || CAST(floor(value / 100) AS BIGINT) || ']' AS line FROM events),
p AS (SELECT user_id, ts, event_id, regexp_split_to_array(line, '\s+')[2] AS task_name,
             regexp_extract(line, '(\[[^\]]*\])', 1) AS priority FROM log),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
             row_number() OVER (PARTITION BY user_id, task_name, priority ORDER BY ts, event_id) AS rn2 FROM p)
SELECT user_id, task_name, priority, min(rn) AS run_start, count(*) AS run_length
FROM a GROUP BY user_id, task_name, priority, rn - rn2"""


@query("task_log_runs", TASK_RUNS_SQL)
def q_task_log_runs(spark, d):
    """Task log lines made from the events, parsed, and the runs of equal (task, priority)."""
    line = F.concat(F.lit("run "), "event_type", F.lit(" ["), F.floor(F.col("value") / 100).cast("string"), F.lit("]"))
    t = table(spark, d, "events").select("user_id", "ts", "event_id", LG.parse_task_line(line).alias("task"))
    return LG.run_lengths(t, ["user_id"], ["ts", "event_id"], "task").select(
        "user_id", "task.task_name", "task.priority", "run_start", "run_length")


@query("null_key_group", f"""
SELECT l.quality, count(*) AS n_docs, {S.r6('avg(d.n_chars)')} AS avg_chars
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY l.quality""")
def q_null_key_group(spark, d):
    """Unlabelled documents form their own (null) quality bucket instead of vanishing."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    lab = table(spark, d, "labels").select("doc_id", "quality")
    return (docs.join(lab, "doc_id", "left").groupBy("quality")
                .agg(F.count(F.lit(1)).alias("n_docs"), stable_round(F.avg("n_chars"), 6).alias("avg_chars")))


# ---------------------------------------------------------------- streaming

@query("stream_running_sum", TF + f"""
SELECT video, frame, {S.r6('sum(dx) OVER w')} AS cum_dx, {S.r6('sum(dy) OVER w')} AS cum_dy,
       {S.r6('sum(da) OVER w')} AS cum_da
FROM tf WINDOW w AS (PARTITION BY video ORDER BY frame {RUN})""")
def q_stream_running_sum(spark, d):
    from quarry.streaming.trajectory import run_stream
    return run_stream(_tf(spark, d), RADIUS, mode="running")


@query("stream_smooth", SMOOTH_SQL + " SELECT * FROM sm")
def q_stream_smooth(spark, d):
    from quarry.streaming.trajectory import run_stream
    return run_stream(_tf(spark, d), RADIUS, mode="smooth")


@query("stream_vote", VOTE_SQL + " SELECT * FROM res")
def q_stream_vote(spark, d):
    from quarry.streaming.votes import run_stream
    ev = I.first_events(spark, d, V.MAX_RUN, ["event_type"])
    return run_stream(ev.select(F.col("user_id").alias("item"), F.col("rn").alias("k"), F.col("event_type").alias("label"), "ts"))


ENDED_SQL = TF + """,
kept AS (SELECT video, count(*) AS delivered, max(frame) AS last FROM tf
         WHERE NOT (video % 4 = 1 AND frame % 41 = 7) GROUP BY 1),
ends AS (SELECT k.video, CASE WHEN k.video % 3 <> 0 THEN n END AS expected, delivered, last
         FROM kept k JOIN (SELECT video, count(*) AS n FROM tf GROUP BY 1) USING (video)),
ended AS (SELECT video, expected, delivered, coalesce(expected, last + 1) - delivered AS n_missing,
                 coalesce(expected = delivered, false) AS complete,
                 CASE WHEN expected = delivered THEN 'marker' ELSE 'timer' END AS ended_by FROM ends)"""


@query("stream_completeness", ENDED_SQL + " SELECT * FROM ended")
def q_stream_completeness(spark, d):
    from quarry.streaming.completeness import lossy_deliveries, run_stream
    return run_stream(lossy_deliveries(_tf(spark, d)))


@query("stream_job_done", ENDED_SQL + """
SELECT (SELECT count(DISTINCT user_id) FROM events) AS n_videos, count(*) AS n_ended, count_if(complete)::BIGINT AS n_complete,
       (SELECT count(DISTINCT user_id) FROM events) = count(*) AS done FROM ended""")
def q_stream_job_done(spark, d):
    from quarry.streaming.completeness import job_done, lossy_deliveries, run_stream
    expected = table(spark, d, "events").select(F.col("user_id").alias("video"))
    return job_done(expected, run_stream(lossy_deliveries(_tf(spark, d))))


@query("stream_latency", TF + f""",
st AS (SELECT video, min(ts) AS s FROM tf GROUP BY video),
du AS (SELECT video, frame, ts, CAST(epoch_us(s) + floor(frame * 1000000 / {FPS}) AS BIGINT) AS due_us
       FROM tf JOIN st USING (video))
SELECT video, frame, due_us, {S.r6('(epoch_us(ts) - due_us) / 1e6')} AS lateness_s, false AS behind FROM du""")
def q_stream_latency(spark, d):
    from quarry.streaming.latency import run_stream
    return run_stream(_tf(spark, d), FPS)[0].drop("at_us")


@query("batched_equals_batch", f"""
SELECT event_type, count(*) AS n_events, {S.r6('sum(value)')} AS total FROM events GROUP BY 1""")
def q_batched_equals_batch(spark, d):
    from quarry.streaming.batches import batched_totals
    return batched_totals(table(spark, d, "events"))


def queries() -> dict[str, Builder]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
