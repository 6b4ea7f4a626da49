"""Motion between consecutive frames by consensus: similarity fits that outliers do not move.

Matched points stay one array a pair of vectors; vectors are joined, never their points. Seeded
minimal samples (two matches fix a similarity) are scored by how many matches agree with them
within a tolerance, and the least-squares fit of the best sample's agreeing matches is the result.
The samples come from a reproducible generator, so the fit is the same in every run. All of it is
built-in expressions over the arrays, without a shuffle after the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalars import lcg, stable_round

SAMPLES, TOLERANCE = 24, 1e-3


def vector_pairs(vectors: DataFrame) -> DataFrame:
    """vec_id, ``u`` and ``v``: a vector (vec_id, embedding) and the one with the next vec_id."""
    a = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("u"))
    b = vectors.select((F.col("vec_id") - 1).alias("_before"), F.col("embedding").cast("array<double>").alias("v"))
    return a.join(b, F.col("vec_id") == F.col("_before")).drop("_before")


def matches(pairs: DataFrame) -> DataFrame:
    """vec_id and ``m``, the matched points (pt, x0, y0, x1, y1): point i of a vector is its elements
    2i and 2i + 1. A null vector has no match."""
    n = F.floor(F.least(*[F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0) for c in "uv"]) / 2).cast("int")
    point = lambda i: F.struct(
        i.cast("long").alias("pt"), F.get("u", 2 * i).alias("x0"), F.get("u", 2 * i + 1).alias("y0"),
        F.get("v", 2 * i).alias("x1"), F.get("v", 2 * i + 1).alias("y1"))
    points = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), point))
    return pairs.select("vec_id", F.coalesce(points, F.array().cast(
        "array<struct<pt:bigint,x0:double,y0:double,x1:double,y1:double>>")).alias("m"))


def least_squares(m: Column) -> Column:
    """(a, b, dx, dy) of x1 = a x0 - b y0 + dx, y1 = b x0 + a y0 + dy over the matches; null where all
    x0, y0 are equal or there is none."""
    names = ("n", "x", "y", "u", "v", "qq", "dot", "cross")
    zero = F.struct(*[F.lit(0.0).alias(c) for c in names])

    def add(s: Column, p: Column) -> Column:
        x, y, u, v = p["x0"], p["y0"], p["x1"], p["y1"]
        return F.struct(*[(s[c] + t).alias(c) for c, t in zip(names, (
            F.lit(1.0), x, y, u, v, x * x + y * y, x * u + y * v, x * v - y * u))])

    def done(s: Column) -> Column:
        mx, my, mu, mv = (s[c] / s["n"] for c in ("x", "y", "u", "v"))
        size = s["qq"] - s["n"] * (mx * mx + my * my)
        a = (s["dot"] - s["n"] * (mx * mu + my * mv)) / size
        b = (s["cross"] - s["n"] * (mx * mv - my * mu)) / size
        return F.when((s["n"] > 1) & (size > 1e-12), F.struct(a.alias("a"), b.alias("b"), (mu - a * mx + b * my).alias("dx"),
                                                             (mv - b * mx - a * my).alias("dy")))

    return F.aggregate(m, zero, add, done)


def _agree(f: Column, p: Column, tolerance: float) -> Column:
    ex = f["a"] * p["x0"] - f["b"] * p["y0"] + f["dx"] - p["x1"]
    ey = f["b"] * p["x0"] + f["a"] * p["y0"] + f["dy"] - p["y1"]
    return ex * ex + ey * ey <= F.lit(tolerance * tolerance)


def consensus_fit(matched: DataFrame, samples: int = SAMPLES, tolerance: float = TOLERANCE) -> DataFrame:
    """vec_id, n_points, n_inliers and the unrounded dx, dy, da of matches (vec_id, m). Ties between
    samples go to the first; without two matches, or where every sample is degenerate, the motion is
    null."""
    n = F.size("m")

    def sample(s: Column) -> Column:
        i = F.pmod(lcg(F.col("vec_id") * samples + s), n).cast("int")
        j = F.pmod(i + 1 + F.pmod(lcg(lcg(F.col("vec_id") * samples + s)), n - 1), n).cast("int")
        p, q = F.get("m", i), F.get("m", j)
        x, y, u, v = (q[c] - p[c] for c in ("x0", "y0", "x1", "y1"))
        size = x * x + y * y
        a, b = (x * u + y * v) / size, (x * v - y * u) / size
        return F.when(size > 1e-12, F.struct(a.alias("a"), b.alias("b"), (p["x1"] - a * p["x0"] + b * p["y0"]).alias("dx"),
                                            (p["y1"] - b * p["x0"] - a * p["y0"]).alias("dy")))

    tried = F.when(n > 1, F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), sample))
    scored = F.transform("_f", lambda f, s: F.when(f.isNotNull(), F.struct(
        F.size(F.filter("m", lambda p: _agree(f, p, tolerance))).alias("n"), (-s).alias("s"), f.alias("f"))))
    d = matched.select("vec_id", "m", tried.alias("_f")).select("vec_id", "m", F.array_max(scored).alias("_best"))
    d = d.select("vec_id", n.cast("long").alias("n_points"), F.coalesce(F.col("_best.n"), F.lit(0)).cast("long").alias("n_inliers"),
                 F.when(F.col("_best").isNotNull(), F.filter("m", lambda p: _agree(F.col("_best.f"), p, tolerance))).alias("_in"))
    d = d.withColumn("_fit", F.when(F.col("_in").isNotNull(), least_squares(F.col("_in"))))
    return d.select("vec_id", "n_points", "n_inliers", F.col("_fit.dx").alias("dx"), F.col("_fit.dy").alias("dy"),
                    F.atan2("_fit.b", "_fit.a").alias("da"))


def planted(matched: DataFrame) -> DataFrame:
    """The matches with a known motion in them: points whose number is no multiple of 3 move by an
    angle and a shift that depend on the vector; the others stay as matched, which is anywhere."""
    angle = (F.col("vec_id") % 7) / F.lit(20.0)
    dx, dy = (F.col("vec_id") % 11) / F.lit(50.0), (F.col("vec_id") % 5) / F.lit(40.0)

    def moved(p: Column) -> Column:
        x = F.cos(angle) * p["x0"] - F.sin(angle) * p["y0"] + dx
        y = F.sin(angle) * p["x0"] + F.cos(angle) * p["y0"] + dy
        out = p["pt"] % 3 == 0
        return F.struct(p["pt"].alias("pt"), p["x0"].alias("x0"), p["y0"].alias("y0"), F.when(out, p["x1"]).otherwise(x).alias("x1"),
                        F.when(out, p["y1"]).otherwise(y).alias("y1"))

    return matched.select("vec_id", F.transform("m", moved).alias("m"))


def rounded(fit: DataFrame) -> DataFrame:
    return fit.select("vec_id", "n_points", "n_inliers", *[stable_round(c, 6).alias(c) for c in ("dx", "dy", "da")])
