"""Who holds the ball: holders, holding states, passes and interceptions, possession."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstat.functions import params as P
from quillstat.functions.scalar import half_even


def frame_holders(people: DataFrame, ball: DataFrame) -> DataFrame:
    """(shot, frame, pid, team): the person whose widened box holds the ball best, unless an opponent is nearly as close."""
    p, b = people.where("team IN ('light', 'dark') AND pid <> ''"), ball.select("shot", "frame", "cx", "cy")
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    inside = F.col("cx").between(F.col("x1") - 0.15 * w, F.col("x2") + 0.15 * w) & F.col("cy").between(F.col("y1") - 0.10 * h, F.col("y1") + 0.95 * h)
    metric = F.hypot((F.col("cx") - (F.col("x1") + F.col("x2")) / 2) / (0.65 * w), (F.col("cy") - (F.col("y1") + 0.55 * h)) / (0.5 * h))
    near = p.join(b, ["shot", "frame"]).where(inside).select("shot", "frame", "pid", "team", metric.alias("metric"))
    return best_unless_contested(near, ["shot", "frame"], "pid", "team", "metric", P.CONTEST)


def best_unless_contested(rows: DataFrame, keys: list[str], who: str, side: str, metric: str, margin: float) -> DataFrame:
    """The row of least metric (then least `who`) of each key, dropped if another side's best is within the margin."""
    best = Window.partitionBy(*keys).orderBy(metric, who)
    every = Window.partitionBy(*keys)
    ranked = rows.withColumns({"_nth": F.row_number().over(best), "_side": F.first(side).over(best)})
    rival = F.min(F.when(F.col(side) != F.col("_side"), F.col(metric))).over(every)
    return ranked.withColumn("_rival", rival).where((F.col("_nth") == 1) & (F.coalesce("_rival", F.lit(float("inf"))) - F.col(metric) >= margin)).drop("_nth", "_side", "_rival")


def holder_states(holders: DataFrame, shot: str = "shot", frame: str = "frame", pid: str = "pid", team: str = "team", gap: int = P.HOLD_GAP, least: int = P.HOLD_ROWS) -> DataFrame:
    """(shot, pid, team, start, end, n): runs of one holder in consecutive holder rows, at most `gap` frames apart, of `least` rows or more."""
    w = Window.partitionBy(shot).orderBy(frame)
    new = F.coalesce((F.lag(pid).over(w) != F.col(pid)) | (F.col(frame) - F.lag(frame).over(w) > gap), F.lit(True)).cast("int")
    runs = holders.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(shot, "_run", pid).agg(F.first(team).alias(team), F.min(frame).alias("start"), F.max(frame).alias("end"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_run")


def with_positions(states: DataFrame, frames: DataFrame) -> DataFrame:
    """X0, Y0 at each state's start and X1, Y1 at its end; null where the player has no place then. Rows without a place don't count."""
    spots = frames.where(F.col("Xs").isNotNull() & F.col("Ys").isNotNull()).groupBy("pid", "frame").agg(F.min(F.struct("Xs", "Ys")).alias("_at"))
    for k, at in (("0", "start"), ("1", "end")):
        spot = spots.select(F.col("pid"), F.col("frame").alias(at), F.col("_at.Xs").alias(f"X{k}"), F.col("_at.Ys").alias(f"Y{k}"))
        states = states.join(spot, ["pid", at], "left")
    return states


def detect_events(states: DataFrame, key: str = "shot", pass_gap: int = P.PASS_GAP, pass_dist: float = P.PASS_DIST, steal_gap: int = P.STEAL_GAP, basket_dist: float = P.BASKET_DIST, baskets: tuple = ((P.HOOP_X, P.COURT_W / 2), (P.COURT_L - P.HOOP_X, P.COURT_W / 2)), fps: float = float(P.FPS)) -> DataFrame:
    """(key, frame, type, team, from_pid, to_pid, dist_m, gap_s) from adjacent states of two players.

    A pass stays in the team, within the gap, over a known distance of at least pass_dist. An interception goes to the
    other team (its `team` is the new holder's), within a shorter gap, at a known place not near a basket; its distance
    may be unknown.
    """
    w = Window.partitionBy(key).orderBy("start", "pid")
    nxt = {f"_{c}": F.lead(c).over(w) for c in ("pid", "team", "start", "X0", "Y0")}
    pairs = states.withColumns(nxt).where((F.col("_pid") != F.col("pid")) & (F.col("_start") >= F.col("end")))
    gap, dist = F.col("_start") - F.col("end"), F.hypot(F.col("_X0") - F.col("X1"), F.col("_Y0") - F.col("Y1"))
    # Where the ball changed hands is the new holder's first place.
    clear = F.least(*[F.hypot(F.col("_X0") - x, F.col("_Y0") - y) for x, y in baskets]) > basket_dist
    kind = F.when((F.col("team") == F.col("_team")) & (gap <= pass_gap) & (dist >= pass_dist), "pass").when((F.col("team") != F.col("_team")) & (gap <= steal_gap) & clear, "interception")
    return pairs.select(key, F.col("_start").alias("frame"), kind.alias("type"), F.col("_team").alias("team"), F.col("pid").alias("from_pid"), F.col("_pid").alias("to_pid"), half_even(dist, 1).alias("dist_m"), half_even(gap / fps, 2).alias("gap_s")).where("type IS NOT NULL")


def drop_flipflops(events: DataFrame, key: str = "shot", frames: int = P.FLIP_FRAMES) -> DataFrame:
    """Two interceptions in a row, of different teams and close together, both go; pairs are judged before any is dropped."""
    w = Window.partitionBy(key).orderBy("frame", "from_pid")
    steals = events.where("type = 'interception'")
    flips = lambda step: F.coalesce((step("team").over(w) != F.col("team")) & (F.abs(step("frame").over(w) - F.col("frame")) <= frames), F.lit(False))
    kept = steals.withColumn("_flip", flips(F.lag) | flips(F.lead)).where("NOT _flip").drop("_flip")
    return events.where("type <> 'interception'").unionByName(kept)


def possession_frames(spans: DataFrame, states: DataFrame, key: str = "shot", start: str = "start", end: str = "end", team: str = "team", step: int = 1) -> DataFrame:
    """(key, frame, team) for each frame of a span [start, end): the team of the latest state begun by then, in the span or before it; null before the first."""
    spine = spans.select(key, F.explode(F.sequence(F.col(start), F.col(end) - 1, F.lit(step))).alias("frame"))
    begun = states.groupBy(key, F.col("start").alias("frame")).agg(F.max_by(team, F.struct("end", team)).alias(team))
    return latest_before(spine, begun, key, "frame", team)


def latest_before(spine: DataFrame, marks: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """Each spine row (key, order) with the values of the last mark at or before it, whether or not a spine row stands there."""
    both = marks.select(key, order, F.struct(*values).alias("_mark"), F.lit(0).alias("_is_row")).unionByName(spine.select(key, order, F.lit(1).alias("_is_row")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(order, "_is_row").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_mark", F.last("_mark", True).over(w)).where("_is_row = 1").select(key, order, *[F.col(f"_mark.{v}").alias(v) for v in values])


def possession_share(frames: DataFrame, team: str = "team", light: str = "light", dark: str = "dark") -> DataFrame:
    """(light, dark): each team's share of the frames with a known team; null if there are none."""
    share = lambda t: F.avg((F.col(team) == t).cast("double"))
    return frames.where(F.col(team).isNotNull()).agg(share(light).alias("light"), share(dark).alias("dark"))


def cumulative_counts(events: DataFrame, frames: DataFrame, key: str = "clip", kits: tuple[str, str] = ("light", "dark"), types: tuple[str, str] = ("pass", "interception")) -> DataFrame:
    """Running totals per frame of a clip, over all its shots: <kit>_<type>, <kit>_possession in per cent of the frames so far (null before any)."""
    hits = events.groupBy(key, "frame").agg(*[F.count_if((F.col("team") == k) & (F.col("type") == t)).alias(f"{k}_{t}") for k in kits for t in types])
    w = Window.partitionBy(key).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    joined = frames.join(hits, [key, "frame"], "left")
    totals = [F.sum(F.coalesce(f"{k}_{t}", F.lit(0))).over(w).alias(f"{k}_{t}") for k in kits for t in types]
    held = {k: F.sum((F.coalesce("team", F.lit("")) == k).cast("long")).over(w) for k in kits}
    every = held[kits[0]] + held[kits[1]]
    return joined.select(key, "frame", *totals, *[F.try_divide(100.0 * held[k], every).alias(f"{k}_possession") for k in kits])
