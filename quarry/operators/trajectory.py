"""Trajectory smoothing over ordered per-video transforms (dx, dy, da per frame).

Every ordered step runs through ``plans.sequence``: running sums are chunk-local sums
plus a carry, centred means are chunk windows with halo rows, so one long video is
spread over many tasks. Per-video constants (first/last trajectory value, frame count)
come from an aggregate and join back on ``video``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.motion import matches, vector_pairs
from quarry.functions.scalars import epoch_micros, stable_round
from quarry.plans.nullsafe import join_keys
from quarry.plans.sequence import DEFAULT_CHUNK_ROWS, neighbours, running_totals, window_sums

AXES = ("x", "y", "a")
SEGMENT_FRAMES = 200
SCALE = 1.04


def _numbered(tf: DataFrame) -> DataFrame:
    return tf.withColumn("rn", F.col("frame") + 1)


def trajectory(tf: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Add tx, ty, ta: running sums of dx, dy, da from the first frame."""
    t = _numbered(tf)
    return running_totals(t, ["video"], "rn",
                          {"tx": F.col("dx"), "ty": F.col("dy"), "ta": F.col("da")}, chunk_rows)


def running_sum(tf: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    t = trajectory(tf, chunk_rows)
    return t.select("video", "frame", *[stable_round(f"t{a}", 6).alias(f"cum_d{a}") for a in AXES])


def smooth(tf: DataFrame, radius: int, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Centred moving mean of the trajectory over 2r+1 frames, edges replicated, then
    out = mean - trajectory + transform (the smoothed transform to apply to the frame)."""
    t = trajectory(tf, chunk_rows)
    per = t.groupBy("video").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.min_by(f"t{a}", "frame").alias(f"_first_{a}") for a in AXES],
        *[F.max_by(f"t{a}", "frame").alias(f"_last_{a}") for a in AXES])
    w = window_sums(t, ["video"], "rn", {f"_s{a}": F.col(f"t{a}") for a in AXES},
                    radius, radius, chunk_rows)
    w = join_keys(w, per, ["video"])
    head = F.greatest(F.lit(radius) - F.col("frame"), F.lit(0))
    tail = F.greatest(F.lit(radius) - (F.col("_n") - 1 - F.col("frame")), F.lit(0))
    outs = []
    for a in AXES:
        mean = (F.col(f"_s{a}") + head * F.col(f"_first_{a}") + tail * F.col(f"_last_{a}")) \
            / F.lit(2 * radius + 1)
        outs.append(stable_round(mean - F.col(f"t{a}") + F.col(f"d{a}"), 6).alias(f"smooth_d{a}"))
    return w.select("video", "frame", *outs)


def pairwise(tf: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Each frame with its predecessor (frames 1..n-1)."""
    t = neighbours(_numbered(tf), ["video"], "rn",
                   {"prev_event_id": ("event_id", -1), "prev_dx": ("dx", -1)}, chunk_rows)
    return (t.filter(F.col("frame") >= 1)
             .select("video", "frame", "prev_event_id", "event_id",
                     stable_round(F.col("dx") - F.col("prev_dx"), 6).alias("delta_dx")))


def segments(tf: DataFrame, period: int = SEGMENT_FRAMES) -> DataFrame:
    """Feature-tracking segments: reset after every frame i > 0 with i % period == 0."""
    seg = F.floor(F.greatest(F.col("frame") - 1, F.lit(0)) / F.lit(period)).cast("long")
    return (tf.withColumn("segment", seg).groupBy("video", "segment")
              .agg(F.count(F.lit(1)).alias("n_frames"), F.min("frame").alias("first_frame"),
                   F.max("frame").alias("last_frame")))


def checkpoint_rows(tf: DataFrame, every: int, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """The running sum a restart would reload: every ``every``-th frame."""
    return running_sum(tf, chunk_rows).filter(F.col("frame") % every == 0)


def replayed_deliveries(tf: DataFrame, replay_mod: int = 7, replay_at: int = 3) -> DataFrame:
    """Deliveries as a sink sees them after restarts: frames with frame % m == r arrive twice."""
    copies = F.when(F.col("frame") % replay_mod == replay_at, F.array(F.lit(0), F.lit(1))) \
              .otherwise(F.array(F.lit(0)))
    return tf.select("video", "frame", "dx", F.explode(copies).alias("attempt"))


def idempotent_sink(deliveries: DataFrame) -> DataFrame:
    """Drop repeated (video, frame) deliveries and report, per video, what was received,
    kept, and how many indices are missing below the highest one (0 = in order)."""
    each = deliveries.groupBy("video", "frame").agg(F.count(F.lit(1)).alias("_c"))
    return (each.groupBy("video").agg(F.sum("_c").alias("n_received"), F.count("frame").alias("n_delivered"),
                                      F.max("frame").alias("last_frame"))
                .select("video", "n_received", "n_delivered", (F.col("n_received") - F.col("n_delivered")).alias("n_duplicates"),
                        (F.col("last_frame") + 1 - F.col("n_delivered")).alias("n_missing"), "last_frame"))


def completeness(expected: DataFrame, delivered: DataFrame) -> DataFrame:
    """Expected vs delivered frame counts per video (left join keeps videos with nothing)."""
    e = expected.groupBy("video").agg(F.count(F.lit(1)).alias("expected"))
    d = delivered.groupBy("video").agg(F.count(F.lit(1)).alias("delivered"))
    j = join_keys(e, d, ["video"], "left").withColumn("delivered", F.coalesce("delivered", F.lit(0)))
    return j.withColumn("complete", F.col("delivered") == F.col("expected"))


def point_pairs(vectors: DataFrame, bound: float = 0.4) -> DataFrame:
    """Match point i of vector v with point i of vector v+1 (vec_id, embedding); status = 1 when the
    moved point stays inside the frame (|x|, |y| <= bound). Vectors are joined, then their points
    become rows."""
    inside = (F.abs(F.col("x1")) <= bound) & (F.abs(F.col("y1")) <= bound)
    return matches(vector_pairs(vectors)).select("vec_id", F.inline("m")).withColumn("status", F.when(inside, 1).otherwise(0))


def similarity_fit(pairs: DataFrame) -> DataFrame:
    """The fit of :func:`fit_motion`, rounded for a report."""
    return fit_motion(pairs).select("vec_id", "n_points", *[stable_round(c, 6).alias(c) for c in ("dx", "dy", "da")])


def fit_motion(pairs: DataFrame) -> DataFrame:
    """Least-squares rotation+scale+shift from matched points (valid ones only), as
    (dx, dy, da), not rounded. One aggregate pass of sums; S = 0 gives nulls."""
    p = pairs.filter(F.col("status") == 1)
    g = p.groupBy("vec_id").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.avg("x0").alias("mx0"), F.avg("y0").alias("my0"),
        F.avg("x1").alias("mx1"), F.avg("y1").alias("my1"),
        F.sum(F.col("x0") * F.col("x0") + F.col("y0") * F.col("y0")).alias("sqq"),
        F.sum(F.col("x0") * F.col("x1") + F.col("y0") * F.col("y1")).alias("sdot"),
        F.sum(F.col("x0") * F.col("y1") - F.col("y0") * F.col("x1")).alias("scross"))
    n = F.col("n_points")
    s = F.col("sqq") - n * (F.col("mx0") ** 2 + F.col("my0") ** 2)
    a = (F.col("sdot") - n * (F.col("mx0") * F.col("mx1") + F.col("my0") * F.col("my1"))) / s
    b = (F.col("scross") - n * (F.col("mx0") * F.col("my1") - F.col("my0") * F.col("mx1"))) / s
    g = g.withColumn("_s", s).withColumn("_a", F.when(s != 0, a)).withColumn("_b", F.when(s != 0, b))
    dx = F.col("mx1") - F.col("_a") * F.col("mx0") + F.col("_b") * F.col("my0")
    dy = F.col("my1") - F.col("_b") * F.col("mx0") - F.col("_a") * F.col("my0")
    return g.select("vec_id", "n_points", dx.alias("dx"), dy.alias("dy"), F.atan2("_b", "_a").alias("da"))


def apply_transform(points: DataFrame, fit: DataFrame, cx: float = 0.0, cy: float = 0.0,
                    scale: float = SCALE) -> DataFrame:
    """Move each point by its vector's (dx, dy, da), then scale about (cx, cy)."""
    j = points.join(fit.filter(F.col("da").isNotNull()).select("vec_id", "dx", "dy", "da"), "vec_id")
    c, s = F.cos("da"), F.sin("da")
    x1 = c * F.col("x") - s * F.col("y") + F.col("dx")
    y1 = s * F.col("x") + c * F.col("y") + F.col("dy")
    return j.select("vec_id", "pt",
                    stable_round(F.lit(cx) + F.lit(scale) * (x1 - F.lit(cx)), 6).alias("x_out"),
                    stable_round(F.lit(cy) + F.lit(scale) * (y1 - F.lit(cy)), 6).alias("y_out"))


def cap_per_group(tf: DataFrame, max_frames: int) -> DataFrame:
    """The frames a source yields: min(frame_count, max_frames) per video."""
    return tf.filter(F.col("frame") < max_frames).select("video", "frame", "event_id")


def paced(tf: DataFrame, fps: int) -> DataFrame:
    """Frame i of a video is due at start + i/fps; lateness = arrival - due."""
    start = tf.groupBy("video").agg(F.min("ts").alias("_start"))
    due = epoch_micros("_start") + F.floor(F.col("frame") * F.lit(1_000_000) / F.lit(fps))
    t = join_keys(tf, start, ["video"]).withColumn("due_us", due.cast("long"))
    late = (epoch_micros("ts") - F.col("due_us")) / F.lit(1e6)
    return t.select("video", "frame", "due_us", stable_round(late, 6).alias("lateness_s"))


def round_robin_sinks(tf: DataFrame, n_sinks: int) -> DataFrame:
    return (tf.withColumn("sink", F.pmod("video", F.lit(n_sinks)))
              .groupBy("sink").agg(F.countDistinct("video").alias("n_videos"),
                                   F.count(F.lit(1)).alias("n_frames")))
