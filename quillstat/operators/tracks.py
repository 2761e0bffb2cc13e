"""Player tracks: summaries, kit clusters, stitching, smoothed motion."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstat.functions import params as P
from quillstat.functions.scalar import half_even


def inside(x: Column, y: Column, margin: float = P.INSIDE_MARGIN) -> Column:
    return x.between(-margin, P.COURT_L + margin) & y.between(-margin, P.COURT_W + margin)


def track_summary(people: DataFrame, x: str = "X", y: str = "Y") -> DataFrame:
    """Per (shot, track_id): frames, first, last, inside_share, medians of colour, number of colour samples; mapped rows only."""
    return people.where("mapped").groupBy("shot", "track_id").agg(F.count("*").alias("frames"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.avg(inside(F.col(x), F.col(y)).cast("double")).alias("inside_share"), *[F.median(c).alias(c) for c in ("L", "a", "b")], F.count("L").alias("n_colour"))


def head_tail_mean(people: DataFrame, keys: list[str], order: str, columns: list[str], n: int = 3) -> DataFrame:
    """Means over the first and the last n rows of each key: head_<c>, tail_<c>."""
    up, down = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys).orderBy(F.desc(order))
    ranked = people.withColumns({"_up": F.row_number().over(up), "_down": F.row_number().over(down)}).where((F.col("_up") <= n) | (F.col("_down") <= n))
    means = [F.avg(F.when(F.col(side) <= n, F.col(c))).alias(f"{name}_{c}") for side, name in (("_up", "head"), ("_down", "tail")) for c in columns]
    return ranked.groupBy(*keys).agg(*means)


def assign_teams(summary: DataFrame, seeds: tuple[int, ...] = (42, 43, 44, 45)) -> DataFrame:
    """(shot, track_id, team): three colour clusters ordered by lightness: dark, other, light. Tracks with too little to go by are unknown, and so are all where fewer than three colours are left."""
    ok = (F.col("n_colour") >= P.MIN_COLOUR) & (F.col("inside_share") >= P.MIN_INSIDE_SHARE) & (F.col("frames") >= P.MIN_TRACK_FRAMES)
    whole = VectorAssembler(inputCols=["L", "a", "b"], outputCol="_lab", handleInvalid="skip").transform(summary.where(ok)).select("shot", "track_id", "_lab").persist()
    if whole.select("_lab").distinct().limit(3).count() < 3:
        whole.unpersist()
        return summary.select("shot", "track_id", F.lit("unknown").alias("team"))
    models = [KMeans(k=3, seed=s, featuresCol="_lab", predictionCol="_c").fit(whole) for s in seeds]
    best = min(models, key=lambda m: m.summary.trainingCost)
    order = sorted(range(3), key=lambda k: best.clusterCenters()[k][0])
    names = {order[0]: "dark", order[1]: "other", order[2]: "light"}
    named = F.element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), F.col("_c"))
    labels = best.transform(whole).select("shot", "track_id", named.alias("team"))
    return summary.select("shot", "track_id").join(labels, ["shot", "track_id"], "left").fillna("unknown", ["team"])


def two_kits(summary: DataFrame, least: int = 5, cutoff: float = 2.5, seeds: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """(shot, track_id, team): two colour clusters of the tracks with `least` coloured frames, the lighter one light, the other dark.

    A track further from its own centre than `cutoff` times the median of all those distances (which is exact) is
    `other`; so is one with too few colours, and so are all where fewer than four tracks, or two colours, are left.
    """
    ok = (F.col("n_colour") >= least) & F.col("L").isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull()
    keys = summary.select("shot", "track_id")
    whole = VectorAssembler(inputCols=["L", "a", "b"], outputCol="_lab").transform(summary.where(ok)).select("shot", "track_id", "L", "a", "b", "_lab").persist()
    try:
        if whole.limit(4).count() < 4 or whole.select("_lab").distinct().limit(2).count() < 2:
            return keys.withColumn("team", F.lit("other"))
        models = [KMeans(k=2, seed=s, featuresCol="_lab", predictionCol="_c").fit(whole) for s in seeds]
        best = min(models, key=lambda m: m.summary.trainingCost)
    finally:
        whole.unpersist()
    centres = best.clusterCenters()
    light = int(centres[1][0] > centres[0][0])
    at = lambda k: F.when(F.col("_c") == 0, float(centres[0][k])).otherwise(float(centres[1][k]))
    away = F.sqrt(sum(((F.col(c) - at(k)) * (F.col(c) - at(k)) for k, c in enumerate(("L", "a", "b"))), F.lit(0.0)))
    put = best.transform(whole).select("shot", "track_id", "_c", away.alias("_away"))
    typical = put.agg(F.median("_away")).first()[0]
    team = F.when(F.col("_away") > cutoff * typical, "other").when(F.col("_c") == light, "light").otherwise("dark")
    return keys.join(put.select("shot", "track_id", team.alias("team")), ["shot", "track_id"], "left").fillna("other", ["team"])


def segment_quality(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(segment, frames, players_per_frame, median_players_per_frame, unique_track_ids, mean_track_len_frames, id_to_player_ratio, ball_frames_share, persons_removed), one row a segment of `lengths` (segment, frames).

    rows: (segment, frame, track_id, is_ball, on_floor). Players are persons on the floor; frames without any count as
    none, over the segment's frames from its first row on.
    """
    player = ~F.col("is_ball") & F.col("on_floor")
    first = rows.groupBy("segment").agg(F.min("frame").alias("_first"), F.count_distinct(F.when(F.col("is_ball"), F.col("frame"))).alias("_balls"), F.count_if(~F.col("is_ball") & ~F.col("on_floor")).alias("persons_removed"))
    spine = lengths.where("frames > 0").join(first, "segment").select("segment", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("frames") - 1)).alias("frame"))
    counts = spine.join(rows.where(player).groupBy("segment", "frame").agg(F.count("*").alias("_n")), ["segment", "frame"], "left")
    counts = counts.groupBy("segment").agg(half_even(F.avg(F.coalesce("_n", F.lit(0))), 2).alias("players_per_frame"), F.median(F.coalesce("_n", F.lit(0))).cast("double").alias("median_players_per_frame"))
    ids = rows.where(player & (F.col("track_id") >= 0)).groupBy("segment", "track_id").agg(F.count("*").alias("_len")).groupBy("segment").agg(F.count("*").alias("unique_track_ids"), half_even(F.avg("_len"), 1).alias("mean_track_len_frames"))
    out = lengths.join(first, "segment", "left").join(counts, "segment", "left").join(ids, "segment", "left").fillna(0, ["_balls", "persons_removed", "players_per_frame", "median_players_per_frame", "unique_track_ids", "mean_track_len_frames"])
    ratio = F.when(F.col("median_players_per_frame") > 0, half_even(F.col("unique_track_ids") / F.col("median_players_per_frame"), 2))
    return out.select("segment", "frames", "players_per_frame", "median_players_per_frame", "unique_track_ids", "mean_track_len_frames", ratio.alias("id_to_player_ratio"), half_even(F.try_divide(F.col("_balls"), F.col("frames")), 3).alias("ball_frames_share"), "persons_removed")


def _chains(tracks: pd.DataFrame) -> pd.DataFrame:
    """Greedy: a track joins the nearest open chain of its team that could have reached it, else starts one."""
    tracks = tracks.sort_values(["first", "track_id"], kind="stable")
    open_chains: list[list] = []  # team, last frame, x, y
    out = []
    for shot, track, team, first, last, hx, hy, tx, ty in tracks[["shot", "track_id", "team", "first", "last", "head_X", "head_Y", "tail_X", "tail_Y"]].itertuples(index=False, name=None):
        reach = []
        for k, (kit, seen, x, y) in enumerate(open_chains):
            gap = first - seen
            away = ((hx - x) ** 2 + (hy - y) ** 2) ** 0.5
            if kit == team and 0 < gap <= P.STITCH_GAP and away <= P.STITCH_SPEED * gap / P.FPS + P.STITCH_SLACK:
                reach.append((away, k))
        k = min(reach)[1] if reach else len(open_chains)
        open_chains[k : k + 1] = [[team, last, tx, ty]]  # extends chain k, or adds one
        out.append((shot, track, f"s{shot}-p{k}"))
    return pd.DataFrame(out, columns=["shot", "track_id", "pid"])


def stitch_tracks(people: DataFrame, summary: DataFrame, teams: DataFrame) -> DataFrame:
    """(shot, track_id, pid): broken tracks of one player joined into chains. The tracks of a shot, one row each, form a group."""
    ends = head_tail_mean(people.where("mapped"), ["shot", "track_id"], "frame", ["X", "Y"])
    usable = summary.where((F.col("frames") >= P.MIN_TRACK_FRAMES) & (F.col("inside_share") >= P.MIN_INSIDE_SHARE))
    tracks = usable.join(teams.where("team <> 'unknown'"), ["shot", "track_id"]).join(ends, ["shot", "track_id"])
    rows = tracks.select("shot", "track_id", "team", "first", "last", "head_X", "head_Y", "tail_X", "tail_Y")
    return rows.groupBy("shot").applyInPandas(_chains, "shot long, track_id long, pid string")


def label_people(people: DataFrame, pids: DataFrame, teams: DataFrame) -> DataFrame:
    """Adds pid ('' outside chains) and team ('unknown' without one)."""
    keys = ["shot", "track_id"]
    return people.join(pids, keys, "left").join(teams, keys, "left").fillna({"pid": "", "team": "unknown"})


def on_court(players: DataFrame) -> DataFrame:
    """Chains that play: away from the lines or moving, inside them for the most part, seen for a second or more."""
    edge = F.least("median_X", P.COURT_L - F.col("median_X"), "median_Y", P.COURT_W - F.col("median_Y"))
    return players.where(((edge >= 1.5) | (F.col("top_speed_ms") >= 3.0)) & (edge >= 0.4) & (F.col("inside_lines_share") >= 0.7) & (F.col("seconds_tracked") >= 1.0))


# Least-squares parabola over 15 rows: position and slope at its middle.
_HALF = P.SMOOTH_WINDOW // 2
_POSITION = [(167 - 5 * i * i) / 1105 for i in range(-_HALF, _HALF + 1)]
_SLOPE = [i / 280 for i in range(-_HALF, _HALF + 1)]


def _parabola(value: Column, i: Column) -> list[Column]:
    """What each of 15 rows at i = -7..7 adds to the coefficients (1, i, i^2) of their least-squares parabola."""
    s2, s4 = sum(k * k for k in range(-_HALF, _HALF + 1)), sum(k**4 for k in range(-_HALF, _HALF + 1))
    d = P.SMOOTH_WINDOW * s4 - s2 * s2
    return [value * (s4 - s2 * i * i) / d, value * i / s2, value * (P.SMOOTH_WINDOW * i * i - s2) / d]


def smooth_motion(rows: DataFrame, keys: list[str], frame: str = "frame", x: str = "X", y: str = "Y", fps: float = float(P.FPS)) -> DataFrame:
    """Smoothed places and speeds on a whole frame spine: (keys, frame, ok, Xs, Ys, speed, dist).

    Gaps are filled in a straight line; a frame is ok if an observation is at most NEAR_FRAMES away; runs of ok frames
    shorter than the window are dropped. Places come from a sliding parabola, at the ends of a run from the parabola of
    its first or last 15 frames; speeds there are those of the nearest whole window. Speeds over MAX_SPEED are null,
    below STILL_SPEED zero; dist adds up speed / fps.
    """
    seen = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(frame).alias("f0"), F.col(x).alias("x0"), F.col(y).alias("y0"))
    seen = seen.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "f0").orderBy("x0", "y0"))).where("_n = 1").drop("_n")
    by_f0 = Window.partitionBy(*keys).orderBy("f0")
    seen = seen.withColumns({"f1": F.lead("f0").over(by_f0), "x1": F.lead("x0").over(by_f0), "y1": F.lead("y0").over(by_f0)})
    spine = seen.withColumn("frame", F.explode(F.sequence("f0", F.coalesce(F.col("f1") - 1, F.col("f0")))))
    part = F.coalesce((F.col("frame") - F.col("f0")) / (F.col("f1") - F.col("f0")), F.lit(0.0))
    near = F.least(F.col("frame") - F.col("f0"), F.coalesce(F.col("f1") - F.col("frame"), F.lit(0)))
    line = lambda a, b: F.col(a) + part * (F.coalesce(b, a) - F.col(a))
    spine = spine.select(*keys, "frame", line("x0", "x1").alias("x"), line("y0", "y1").alias("y"), (near <= P.NEAR_FRAMES).alias("ok"))
    w = Window.partitionBy(*keys).orderBy("frame")
    run = F.sum(F.coalesce(F.col("ok") != F.lag("ok").over(w), F.lit(True)).cast("int")).over(w)
    inner = Window.partitionBy(*keys, "run").orderBy("frame")
    whole = Window.partitionBy(*keys, "run")
    runs = spine.withColumn("run", run).withColumns({"n": F.count("*").over(whole), "k": F.row_number().over(inner)})
    runs = runs.withColumn("ok", F.col("ok") & (F.col("n") >= P.SMOOTH_WINDOW))
    shifts = range(-_HALF, _HALF + 1)
    runs = runs.withColumns({f"_{c}{i}": F.lead(c, i).over(inner) if i > 0 else F.lag(c, -i).over(inner) for c in ("x", "y") for i in shifts if i})
    at = lambda c, i: F.col(f"_{c}{i}" if i else c)
    dot = lambda c, weights: sum((at(c, i) * F.lit(weight) for i, weight in zip(shifts, weights, strict=True)), F.lit(0.0))
    mid = F.col("ok") & (F.col("k") > _HALF) & (F.col("k") <= F.col("n") - _HALF)
    full = runs.withColumns({"_vx": F.when(mid, dot("x", _SLOPE) * fps), "_vy": F.when(mid, dot("y", _SLOPE) * fps), "_px": F.when(mid, dot("x", _POSITION)), "_py": F.when(mid, dot("y", _POSITION))})
    speed = F.hypot("_vx", "_vy")
    # The parabola of a run's first (last) 15 rows serves those before (after) its first (last) whole window.
    ends = {"f": (F.col("k") <= P.SMOOTH_WINDOW, F.col("k") - _HALF - 1, F.col("k") == _HALF + 1), "l": (F.col("k") > F.col("n") - P.SMOOTH_WINDOW, F.col("k") - F.col("n") + _HALF, F.col("k") == F.col("n") - _HALF)}
    sums = {f"_{c}{e}{q}": F.sum(F.when(F.col("ok") & of, part)).over(whole) for e, (of, i, _) in ends.items() for c in ("x", "y") for q, part in enumerate(_parabola(F.col(c), i))}
    full = full.withColumn("_s", speed).withColumns(sums | {f"_s{e}": F.max(F.when(mid & at_, F.col("_s"))).over(whole) for e, (_, _, at_) in ends.items()})
    early = F.col("k") <= _HALF

    def placed(p: str, c: str) -> Column:
        fitted = lambda e: F.col(f"_{c}{e}0") + F.col(f"_{c}{e}1") * ends[e][1] + F.col(f"_{c}{e}2") * ends[e][1] * ends[e][1]
        return F.when(F.col("ok"), F.coalesce(p, F.when(early, fitted("f")).otherwise(fitted("l"))))

    raw = F.when(F.col("ok"), F.coalesce("_s", F.when(early, F.col("_sf")).otherwise(F.col("_sl"))))
    kept = F.when(raw > P.MAX_SPEED, F.lit(None)).when(raw < P.STILL_SPEED, 0.0).otherwise(raw)
    out = full.select(*keys, "frame", "ok", placed("_px", "x").alias("Xs"), placed("_py", "y").alias("Ys"), kept.alias("speed"))
    return out.withColumn("dist", F.coalesce(F.sum(F.col("speed") / fps).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))


def player_table(frames: DataFrame, people: DataFrame, key: str = "pid", fps: int = P.FPS) -> DataFrame:
    """Distance, speeds and whereabouts of each chain with a second or more of speeds. people: key, shot, team, frame, X, Y."""
    kmh = lambda c: half_even(c * 3.6, 1)
    stats = frames.groupBy(key).agg(F.count("speed").alias("n"), F.sum("speed").alias("total"), F.avg("speed").alias("mean"), F.max("speed").alias("top"), F.percentile("speed", F.lit(0.9)).alias("p90"))
    s = stats.where(F.col("n") >= fps)
    s = s.select(key, half_even(F.col("n") / fps, 1).alias("seconds_tracked"), half_even(F.col("total") / fps, 1).alias("distance_m"), half_even(F.col("mean"), 2).alias("avg_speed_ms"), kmh(F.col("mean")).alias("avg_speed_kmh"), half_even(F.col("top"), 2).alias("top_speed_ms"), kmh(F.col("top")).alias("top_speed_kmh"), half_even(F.col("p90"), 2).alias("p90_speed_ms"))
    within = F.coalesce(inside(F.col("X"), F.col("Y"), 0.0), F.lit(False)).cast("double")
    where = people.groupBy(key).agg(F.min("shot").alias("shot"), F.min("team").alias("team"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), half_even(F.avg(within), 2).alias("inside_lines_share"), half_even(F.median("X"), 1).alias("median_X"), half_even(F.median("Y"), 1).alias("median_Y"))
    return where.join(s, key)
