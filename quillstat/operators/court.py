"""The court's markings as tables: lines, segments, sample points; nearest markings and how well a map fits them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstat.functions import params as P
from quillstat.functions.scalar import project

_MID = P.COURT_W / 2


def court_lines(spark: SparkSession) -> DataFrame:
    """(line, nth, x, y): every marking as a chain of points in metres; those of the right basket are the left one's mirrored."""
    corner = _MID - P.CORNER_Y
    join = P.HOOP_X + math.sqrt(P.ARC_R**2 - corner**2)
    # Straight parts: name, first place in the chain, points.
    straight = {
        ("outer", 0): [(0, 0), (P.COURT_L, 0), (P.COURT_L, P.COURT_W), (0, P.COURT_W), (0, 0)], ("half", 0): [(P.COURT_L / 2, 0), (P.COURT_L / 2, P.COURT_W)],
        ("lane", 0): [(0, _MID - P.LANE_HALF), (P.LANE_DEPTH, _MID - P.LANE_HALF), (P.LANE_DEPTH, _MID + P.LANE_HALF), (0, _MID + P.LANE_HALF)],
        ("three", 0): [(0, P.CORNER_Y), (join, P.CORNER_Y)], ("three", 62): [(join, P.COURT_W - P.CORNER_Y), (0, P.COURT_W - P.CORNER_Y)],
    }
    points = spark.createDataFrame([(name, at + k, float(x), float(y)) for (name, at), chain in straight.items() for k, (x, y) in enumerate(chain)], "line string, nth int, x double, y double")
    # Arcs: name, first place, centre, radius, sine of the half angle (none: the whole circle), points.
    arcs = spark.createDataFrame([("centre", 0, P.COURT_L / 2, P.CENTRE_R, None, 80), ("ft_circle", 0, P.LANE_DEPTH, P.FT_RADIUS, 1.0, 60), ("three", 2, P.HOOP_X, P.ARC_R, corner / P.ARC_R, 60), ("restricted", 0, P.HOOP_X, P.RESTRICTED_R, 1.0, 30)], "line string, at int, cx double, r double, sine double, n int")
    half = F.asin("sine")
    low, span = F.coalesce(-half, F.lit(0.0)), F.coalesce(2 * half, F.lit(2 * math.pi))
    angle = low + span * F.col("k") / (F.col("n") - 1)
    bent = arcs.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("line", (F.col("at") + F.col("k")).alias("nth"), (F.col("cx") + F.col("r") * F.cos(angle)).alias("x"), (_MID + F.col("r") * F.sin(angle)).alias("y"))
    every = points.unionByName(bent)
    once = F.col("line").isin("outer", "half", "centre")
    left = every.where(~once).withColumn("line", F.concat(F.lit("left "), "line"))
    right = every.where(~once).select(F.concat(F.lit("right "), "line").alias("line"), "nth", (P.COURT_L - F.col("x")).alias("x"), "y")
    return every.where(once).unionByName(left).unionByName(right)


def segments(lines: DataFrame) -> DataFrame:
    """(line, nth, x, y, x2, y2, length) between a chain's points."""
    w = Window.partitionBy("line").orderBy("nth")
    pairs = lines.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)}).where("x2 IS NOT NULL")
    return pairs.withColumn("length", F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")))


def sample_points(lines: DataFrame, step: float = 0.1) -> DataFrame:
    """(line, nth, k, x, y): about a point every `step` metres along each segment, its end left out, two a segment at least."""
    cut = segments(lines).withColumn("_n", F.greatest(F.lit(2), F.floor(F.col("length") / step).cast("int")))
    at = lambda a, b: (F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.col("_n")).alias(a)
    return cut.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select("line", "nth", "k", at("x", "x2"), at("y", "y2"))


def nearest_line(points: DataFrame, lines: DataFrame, reach: float, x: str = "x", y: str = "y", cell: float = 1.0) -> DataFrame:
    """The points with line and away: the marking nearest to each within `reach` metres (the first by name of equals), null beyond.

    Segments stand in every grid cell that a box `reach` wider than theirs touches, so a point meets those of its own
    cell only. Equal places meet once.
    """
    at = lambda c, off=0.0: F.floor((c + off) / cell)
    low, high = lambda a, b: at(F.least(a, b), -reach), lambda a, b: at(F.greatest(a, b), reach)
    dealt = segments(lines).select("line", F.col("x").alias("_x1"), F.col("y").alias("_y1"), "x2", "y2", F.explode(F.sequence(low("x", "x2"), high("x", "x2"))).alias("_cx"), F.sequence(low("y", "y2"), high("y", "y2")).alias("_cys"))
    dealt = dealt.withColumn("_cy", F.explode("_cys")).drop("_cys")
    places = points.select(F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py")).dropna().distinct().withColumns({"_cx": at(F.col("_px")), "_cy": at(F.col("_py"))})
    dx, dy = F.col("x2") - F.col("_x1"), F.col("y2") - F.col("_y1")
    along = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((F.col("_px") - F.col("_x1")) * dx + (F.col("_py") - F.col("_y1")) * dy, dx * dx + dy * dy))), F.lit(0.0))
    away = F.hypot(F.col("_px") - F.col("_x1") - along * dx, F.col("_py") - F.col("_y1") - along * dy)
    met = places.join(dealt, ["_cx", "_cy"]).select("_px", "_py", "line", away.alias("away")).where(F.col("away") <= reach)
    best = met.groupBy("_px", "_py").agg(F.min(F.struct("away", "line")).alias("_b")).select("_px", "_py", "_b.line", "_b.away")
    return points.join(best, (F.col(x).cast("double") == F.col("_px")) & (F.col(y).cast("double") == F.col("_py")), "left").drop("_px", "_py")


def alignment(response: DataFrame, views: DataFrame, lines: DataFrame, step: float = 0.12, shift: int = 14, least: int = 40, height: int = P.OVERLAY_Y) -> DataFrame:
    """(view, n, score): the mean line response under a view's projected markings over that under the same ones `shift` pixels lower.

    views: (view, h), h the map from court to pixels; response: (view, px, py, value), the pixels of the picture, which
    end at `height` for this purpose. n: markings on the picture; with fewer than `least` the score is null. 1 is chance.
    """
    chain = sample_points(lines, step).withColumn("_seg", F.dense_rank().over(Window.orderBy("line", "nth")))  # a fixed model of some hundred segments
    n = chain.agg(F.max("_seg")).first()[0]
    put = views.withColumn("_seg", F.explode(F.sequence(F.lit(1), F.lit(n)))).join(F.broadcast(chain.select("_seg", "x", "y")), "_seg")
    u, v = project([F.col("h")[k] for k in range(9)], F.col("x"), F.col("y"))
    put = put.select("view", F.rint(u).alias("px"), F.rint(v).alias("py")).dropna().where((F.abs("px") < 1e6) & (F.abs("py") < 1e6))
    both = put.select("view", F.explode(F.array(*[F.struct(F.lit(o).alias("low"), F.col("px").cast("long").alias("px"), (F.col("py") + o).cast("long").alias("py")) for o in (0, shift)])).alias("_p")).select("view", "_p.*")
    seen = both.where((F.col("py") >= 0) & (F.col("py") < height)).groupBy("view", "low", "px", "py").agg(F.count("*").alias("times"))
    hit = seen.join(response.select("view", F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"), "value"), ["view", "px", "py"])
    on = lambda o: F.col("low") == o
    mean = lambda o: F.try_divide(F.sum(F.when(on(o), F.col("value") * F.col("times"))), F.sum(F.when(on(o), F.col("times"))))
    sums = hit.groupBy("view").agg(F.coalesce(F.sum(F.when(on(0), F.col("times"))), F.lit(0)).alias("n"), F.coalesce(mean(0), F.lit(0.0)).alias("_on"), F.coalesce(mean(shift), F.lit(0.0)).alias("_off"))
    scored = views.select("view").join(sums, "view", "left").select("view", F.coalesce("n", F.lit(0)).alias("n"), F.col("_on"), F.col("_off"))
    return scored.select("view", "n", F.when(F.col("n") >= least, F.col("_on") / F.greatest("_off", F.lit(1e-6))).alias("score"))
