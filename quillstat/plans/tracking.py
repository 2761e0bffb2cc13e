"""Timeline, possession, ball and motion queries over the driver's event table.

An event's user is its shot (or game), its minute or hour of the month its frame, its type its holder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstat.functions.scalar import half_even, inverse, project
from quillstat.operators import ball, clip, possession, timeline, tracks
from quillstat.plans.boxscore import read
from quillstat.shipping import ship

HOURS = 720


def _events(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, event_id, hour, minute_no, event_type, team, value, k)."""
    hour = (F.dayofmonth("ts") - 1) * 24 + F.hour("ts")
    team = F.when(F.col("event_type").isin("click", "view", "signup"), "light").otherwise("dark")
    k = F.get_json_object("props", "$.k").cast("double")
    return read(spark, d, "events").select("user_id", "event_id", hour.cast("long").alias("hour"), (hour * 60 + F.minute("ts")).cast("long").alias("minute_no"), "event_type", team.alias("team"), "value", k.alias("k"))


_EV = """SELECT user_id, event_id, (day(ts) - 1) * 24 + hour(ts) AS hour, ((day(ts) - 1) * 24 + hour(ts)) * 60 + minute(ts) AS minute_no, event_type,
 CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'light' ELSE 'dark' END AS team, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events"""


def score_timeline(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    total = lambda t: F.sum((F.col("event_type") == t).cast("long")).over(w)
    rows = _events(spark, d).select("user_id", F.col("event_id").alias("ord"), (F.col("minute_no") / 1.0).alias("minute"), total("click").alias("home"), total("view").alias("away"))
    return timeline.score_changes(rows, "user_id")


def scoring_runs(spark: SparkSession, d: str) -> DataFrame:
    return timeline.scoring_runs(score_timeline(spark, d), "user_id")


def team_leads(spark: SparkSession, d: str) -> DataFrame:
    return timeline.leads(score_timeline(spark, d), "user_id")


_TIMELINE = f"""ev AS ({_EV}), c AS (SELECT user_id, event_id AS ord, CAST(minute_no AS DOUBLE) AS minute,
 CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS home, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS away FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
m AS (SELECT *, lag(home) OVER w AS lh, lag(away) OVER w AS la FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ord)),
tl AS (SELECT user_id, ord, minute, home, away, home - away AS margin FROM m WHERE lh IS NULL OR lh <> home OR la <> away UNION ALL SELECT DISTINCT user_id, -1, 0.0, 0, 0, 0 FROM c)"""


def contested_holder(spark: SparkSession, d: str) -> DataFrame:
    """Per part, the supplier of the least price, unless another nation's is nearly as low."""
    sides = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("side"))
    rows = read(spark, d, "lineitem").select("l_partkey", "l_suppkey", half_even(F.col("l_extendedprice") / F.col("l_quantity") / 100, 3).alias("metric")).join(sides, "l_suppkey")
    return possession.best_unless_contested(rows, ["l_partkey"], "l_suppkey", "side", "metric", 0.3).select("l_partkey", "l_suppkey", "metric")


def _states(spark: SparkSession, d: str) -> DataFrame:
    return possession.holder_states(_events(spark, d), "user_id", "event_id", "event_type", "team", gap=400, least=2)


def holder_states(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d)


def _placed(spark: SparkSession, d: str) -> DataFrame:
    spots = _events(spark, d).select(F.col("event_type").alias("pid"), F.col("event_id").alias("frame"), F.col("value").alias("Xs"), F.when(F.col("k") < 90, F.col("k")).alias("Ys"))
    return possession.with_positions(_states(spark, d).withColumnRenamed("event_type", "pid"), spots)


def pass_events(spark: SparkSession, d: str) -> DataFrame:
    return possession.detect_events(_placed(spark, d), "user_id", pass_gap=4000, steal_gap=3000, baskets=((0.0, 0.0), (50.0, 50.0)))


def flipflop_drop(spark: SparkSession, d: str) -> DataFrame:
    return possession.drop_flipflops(pass_events(spark, d), "user_id", 1500)


_STATES = f"""ev AS ({_EV}), f AS (SELECT *, lag(event_type) OVER w AS lt, lag(event_id) OVER w AS lf FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(CASE WHEN lt = event_type AND event_id - lf <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM f),
st AS (SELECT user_id, event_type, min(team) AS team, min(event_id) AS start, max(event_id) AS "end", count(*) AS n FROM r GROUP BY user_id, run, event_type HAVING count(*) >= 2)"""
_PASSES = f"""{_STATES}, pl AS (SELECT st.*, a.value AS "X0", CASE WHEN a.k < 90 THEN a.k END AS "Y0", b.value AS "X1", CASE WHEN b.k < 90 THEN b.k END AS "Y1" FROM st JOIN ev a ON a.event_id = start JOIN ev b ON b.event_id = "end"),
nx AS (SELECT *, lead(event_type) OVER w AS p2, lead(team) OVER w AS t2, lead(start) OVER w AS s2, lead("X0") OVER w AS x2, lead("Y0") OVER w AS y2 FROM pl WINDOW w AS (PARTITION BY user_id ORDER BY start, event_type)),
dd AS (SELECT *, s2 - "end" AS gap, sqrt((x2 - "X1") * (x2 - "X1") + (y2 - "Y1") * (y2 - "Y1")) AS dist, least(sqrt(x2 * x2 + y2 * y2), sqrt((x2 - 50) * (x2 - 50) + (y2 - 50) * (y2 - 50))) AS off FROM nx WHERE p2 <> event_type AND s2 >= "end"),
e AS (SELECT user_id, s2 AS frame, CASE WHEN team = t2 AND gap <= 4000 AND dist >= 1.5 THEN 'pass' WHEN team <> t2 AND gap <= 3000 AND y2 IS NOT NULL AND off > 4.5 THEN 'interception' END AS type, t2 AS team, event_type AS from_pid, p2 AS to_pid, round_even(dist, 1) AS dist_m, round_even(gap / 30.0, 2) AS gap_s FROM dd),
ev2 AS (SELECT * FROM e WHERE type IS NOT NULL)"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("user_id").alias("shot")).distinct().select("shot", F.lit(0).cast("long").alias("start"), F.lit(HOURS).cast("long").alias("end"))


def possession_frames(spark: SparkSession, d: str) -> DataFrame:
    """Each user's hours of the month with the type of the latest event begun by then."""
    states = _events(spark, d).select(F.col("user_id").alias("shot"), F.col("hour").alias("start"), F.col("event_id").alias("end"), F.col("event_type").alias("team"))
    return possession.possession_frames(_spans(spark, d), states)


_LATE = (100, 700, 6)


def _late_frames(spark: SparkSession, d: str) -> DataFrame:
    """Every sixth hour of a span that begins after most users' first events."""
    start, end, _ = _LATE
    return _spans(spark, d).select("shot", F.lit(start).cast("long").alias("start"), F.lit(end).cast("long").alias("end"))


def possession_late(spark: SparkSession, d: str) -> DataFrame:
    """States that began before the span, or between its frames, count."""
    states = _events(spark, d).select(F.col("user_id").alias("shot"), F.col("hour").alias("start"), F.col("event_id").alias("end"), F.col("event_type").alias("team"))
    return possession.possession_frames(_late_frames(spark, d), states, step=_LATE[2])


def banner_thinned(spark: SparkSession, d: str) -> DataFrame:
    """Banners of events on hours that are not shown."""
    hits = _events(spark, d).where("event_type = 'purchase'").select(F.col("user_id").alias("shot"), F.col("hour").alias("frame"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("what"))
    return clip.banners(possession_late(spark, d).select("shot", "frame"), hits, "shot", "what", 10)


def possession_share(spark: SparkSession, d: str) -> DataFrame:
    share = possession.possession_share(possession_frames(spark, d).where("team IN ('click', 'view')"), light="click", dark="view")
    return share.select(half_even(F.col("light"), 6).alias("light"), half_even(F.col("dark"), 6).alias("dark"))


def running_counts(spark: SparkSession, d: str) -> DataFrame:
    hits = _events(spark, d).select(F.col("user_id").alias("shot"), F.col("hour").alias("frame"), F.when(F.col("k") < 50, "pass").otherwise("interception").alias("type"), F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).alias("team"))
    out = possession.cumulative_counts(hits, possession_frames(spark, d), "shot", kits=("click", "view"))
    return out.withColumns({c: half_even(F.col(c), 4) for c in ("click_possession", "view_possession")})


_POSS = f"""ev AS ({_EV}), sp AS (SELECT user_id AS shot, CAST(h AS BIGINT) AS frame FROM (SELECT DISTINCT user_id FROM events), generate_series(0, {HOURS - 1}) g(h)),
b AS (SELECT user_id AS shot, hour AS frame, max_by(event_type, event_id) AS t FROM ev GROUP BY 1, 2),
pf AS (SELECT shot, frame, last_value(t IGNORE NULLS) OVER (PARTITION BY shot ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS team FROM sp LEFT JOIN b USING (shot, frame))"""


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    """One place a user and hour: the last event's value and k."""
    return _events(spark, d).groupBy("user_id", "hour").agg(F.max(F.struct("event_id", "value", "k")).alias("e")).select("user_id", "hour", F.col("e.value").alias("x"), F.col("e.k").alias("y"))


_HOURLY = f"ev AS ({_EV}), hr AS (SELECT user_id, hour, max_by(value, event_id) AS x, max_by(k, event_id) AS y FROM ev GROUP BY 1, 2)"


def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    filled = ball.interpolate(_hourly(spark, d).withColumn("conf", F.lit(1.0)), ["user_id"], "hour", ["x", "y"], ["conf"])
    return filled.withColumns({"x": half_even(F.col("x"), 6), "y": half_even(F.col("y"), 6)})


def static_clutter(spark: SparkSession, d: str) -> DataFrame:
    near = ball.neighbours(_events(spark, d), "user_id", "minute_no", 2000, {"img": (("value", "k"), 30.0), "crt": (("k", "k"), 5.0)})
    return near.select("event_id", F.col("n_img").cast("long").alias("n_img"), F.col("n_crt").cast("long").alias("n_crt"))


def near_semi(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a supplier of their nation close by in account and key."""
    left = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal", (F.col("c_custkey") % 100).cast("double").alias("y"))
    right = read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_acctbal", (F.col("s_suppkey") % 100).cast("double").alias("sy"))
    return ball.near_flag(left, right, ["nation"], ("c_acctbal", "y"), ("s_acctbal", "sy"), 200.0).select("c_custkey", "near")


def homography_map(spark: SparkSession, d: str) -> DataFrame:
    n, x, y = F.col("c_nationkey"), F.col("c_acctbal") / 100, (F.col("c_custkey") % 100).cast("double")
    h = [1 + 0.01 * n, F.lit(0.02), F.lit(3.0), F.lit(0.01), F.lit(1.0), F.lit(2.0), 0.0001 * n, F.lit(0.0002), F.lit(1.0)]
    px, py = project(inverse(h), x, y)
    return read(spark, d, "customer").select("c_custkey", half_even(px, 6).alias("px"), half_even(py, 6).alias("py"))


def _motion(spark: SparkSession, d: str) -> DataFrame:
    rows = _hourly(spark, d).withColumns({"x": F.col("x") / 397.3, "y": F.col("y") / 397.3})
    return tracks.smooth_motion(rows, ["user_id"], "hour", "x", "y")


def smooth_motion(spark: SparkSession, d: str) -> DataFrame:
    return _motion(spark, d).select("user_id", "frame", "ok", *[half_even(F.col(c), 7).alias(c) for c in ("Xs", "Ys", "speed", "dist")])


def player_table(spark: SparkSession, d: str) -> DataFrame:
    people = _hourly(spark, d).select("user_id", F.col("user_id").alias("shot"), F.lit("light").alias("team"), F.col("hour").alias("frame"), (F.col("x") / 10).alias("X"), (F.col("y") / 10).alias("Y"))
    return tracks.player_table(_motion(spark, d), people, "user_id", fps=5)


_MOTION = f"""{_HOURLY}, o AS (SELECT user_id, hour AS f0, x / 397.3 AS x0, y / 397.3 AS y0, lead(hour) OVER w AS f1, lead(x / 397.3) OVER w AS x1, lead(y / 397.3) OVER w AS y1 FROM hr WINDOW w AS (PARTITION BY user_id ORDER BY hour)),
sp AS (SELECT *, unnest(generate_series(f0, coalesce(f1 - 1, f0))) AS frame FROM o),
ln AS (SELECT user_id, frame, x0 + coalesce((frame - f0) / (f1 - f0), 0) * (coalesce(x1, x0) - x0) AS x, y0 + coalesce((frame - f0) / (f1 - f0), 0) * (coalesce(y1, y0) - y0) AS y, least(frame - f0, coalesce(f1 - frame, 0)) <= 5 AS ok FROM sp),
l2 AS (SELECT *, lag(ok) OVER (PARTITION BY user_id ORDER BY frame) AS lo FROM ln),
l3 AS (SELECT *, sum(CASE WHEN lo = ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY frame) AS run FROM l2),
l4 AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS n, row_number() OVER w AS k, list(x) OVER (w ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS xs, list(y) OVER (w ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS ys FROM l3 WINDOW w AS (PARTITION BY user_id, run ORDER BY frame)),
l5 AS (SELECT *, ok AND n >= 15 AS good, ok AND k > 7 AND k <= n - 7 AS mid FROM l4),
l6 AS (SELECT *, CASE WHEN mid THEN xs END AS mx, CASE WHEN mid THEN ys END AS my,
  CASE WHEN mid THEN sqrt(pow(30 * list_sum(list_transform(xs, lambda v, i: v * (i - 8) / 280)), 2) + pow(30 * list_sum(list_transform(ys, lambda v, i: v * (i - 8) / 280)), 2)) END AS sp FROM l5),
l7 AS (SELECT *, first_value(mx IGNORE NULLS) OVER g AS fx, first_value(my IGNORE NULLS) OVER g AS fy, first_value(sp IGNORE NULLS) OVER g AS fs, last_value(mx IGNORE NULLS) OVER g AS ex, last_value(my IGNORE NULLS) OVER g AS ey, last_value(sp IGNORE NULLS) OVER g AS es,
  CASE WHEN mid THEN 0 WHEN k <= 7 THEN k - 8 ELSE k - n + 7 END AS j FROM l6 WINDOW g AS (PARTITION BY user_id, run ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
l8 AS (SELECT user_id, frame, good AS ok, CASE WHEN good THEN CASE WHEN mid THEN sp WHEN k <= 7 THEN fs ELSE es END END AS raw, j,
  CASE WHEN good THEN CASE WHEN mid THEN mx WHEN k <= 7 THEN fx ELSE ex END END AS vx, CASE WHEN good THEN CASE WHEN mid THEN my WHEN k <= 7 THEN fy ELSE ey END END AS vy FROM l7),
mo AS (SELECT user_id, frame, ok, CASE WHEN raw > 11 THEN NULL WHEN raw < 0.35 THEN 0 ELSE raw END AS speed,
  list_sum(list_transform(vx, lambda v, i: v * (167.0 / 1105 - (j * j + (i - 8) * (i - 8)) / 221.0 + j * (i - 8) / 280.0 + j * j * (i - 8) * (i - 8) * 15.0 / 61880))) AS px,
  list_sum(list_transform(vy, lambda v, i: v * (167.0 / 1105 - (j * j + (i - 8) * (i - 8)) / 221.0 + j * (i - 8) / 280.0 + j * j * (i - 8) * (i - 8) * 15.0 / 61880))) AS py FROM l8)"""


def _people(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return e.select((F.col("user_id") % 10).alias("shot"), F.col("user_id").alias("track_id"), F.col("event_id").alias("frame"), (F.col("event_type") != "error").alias("mapped"), (F.col("value") / 4).alias("X"), (F.col("k") / 6).alias("Y"), F.when(F.col("event_id") % 11 > 0, F.col("value")).alias("L"), F.col("k").alias("a"), (F.col("event_id") % 7).cast("double").alias("b"))


def track_summary(spark: SparkSession, d: str) -> DataFrame:
    return tracks.track_summary(_people(spark, d)).withColumn("inside_share", half_even(F.col("inside_share"), 6))


def head_tail_mean(spark: SparkSession, d: str) -> DataFrame:
    out = tracks.head_tail_mean(_people(spark, d).where("mapped"), ["shot", "track_id"], "frame", ["X", "Y"])
    return out.select("shot", "track_id", *[half_even(F.col(c), 6).alias(c) for c in ("head_X", "head_Y", "tail_X", "tail_Y")])


def kit_clusters(spark: SparkSession, d: str) -> DataFrame:
    return tracks.assign_teams(tracks.track_summary(_people(spark, d)))


def _hundred(user: str) -> Column:
    return F.floor(F.col(user) / 100)


def stitch_tracks(spark: SparkSession, d: str) -> DataFrame:
    """A shot is a hundred users, so more users are more shots, not larger ones; tracks are short spells of it and teams alternate."""
    w = Window.partitionBy("shot").orderBy("frame")
    e = _people(ship(spark), d).where("mapped").withColumn("shot", _hundred("track_id")).withColumn("_at", F.row_number().over(w))
    people = e.select("shot", (F.floor(F.col("_at") / 20)).alias("track_id"), F.col("_at").cast("long").alias("frame"), "mapped", "X", "Y", "L", "a", "b")
    summary = tracks.track_summary(people).withColumn("inside_share", F.lit(1.0))
    return tracks.stitch_tracks(people, summary, summary.select("shot", "track_id", F.when(F.col("track_id") % 2 == 0, "light").otherwise("dark").alias("team")))


def ball_path(spark: SparkSession, d: str) -> DataFrame:
    """A shot is a hundred users; candidates are events by hour; the court map is one constant matrix."""
    e = _events(ship(spark), d)
    balls = e.select(_hundred("user_id").alias("shot"), F.col("hour").alias("frame"), (F.col("value") % 1.0).alias("conf"), (F.col("value") * 2).alias("cx"), (F.col("k") * 4).alias("cy"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"))
    cells = {c: F.lit(float(v)) for c, v in zip(ball.H, (10, 0, 0, 0, 10, 0, 0, 0, 1), strict=True)}
    frames = balls.select("shot", "frame").distinct().withColumns({"mapped": F.lit(True)} | cells)
    people = _people(spark, d).withColumns({"shot": _hundred("track_id"), "frame": F.col("frame") % HOURS})
    return ball.ball_track(balls, frames, people).withColumns({c: half_even(F.col(c), 6) for c in ("cx", "cy", "conf")})


def thin_labels(spark: SparkSession, d: str) -> DataFrame:
    return ball.thin_labels(_events(ship(spark), d), "user_id", "hour", 3)


def first_candidates(spark: SparkSession, d: str) -> DataFrame:
    return ball.first_candidates(_events(spark, d), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


def _daily(spark: SparkSession, d: str) -> DataFrame:
    day = F.dayofmonth("ts").cast("long") - 1
    return read(spark, d, "events").groupBy("event_type", day.alias("day")).agg(half_even(F.max("value") - F.min("value") * 50, 2).alias("grey"), half_even(F.count_if(F.col("value") > 90) / F.count("*"), 6).alias("hist"))


def spike_cuts(spark: SparkSession, d: str) -> DataFrame:
    return clip.detect_cuts(_daily(spark, d), "day", "grey", "hist", "event_type", threshold=0.16, spike_ratio=1.1)


def segments(spark: SparkSession, d: str) -> DataFrame:
    totals = read(spark, d, "events").select("event_type").distinct().withColumn("total", F.lit(30).cast("long"))
    return clip.segments(spike_cuts(spark, d), totals, "day", "event_type", 2)


_CUTS = """dy AS (SELECT event_type, day(ts) - 1 AS day, round_even(max(value) - min(value) * 50, 2) AS grey, round_even(count(*) FILTER (WHERE value > 90) / count(*), 6) AS hist FROM events GROUP BY 1, 2),
d1 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY day) > 1 THEN grey END AS g FROM dy),
d2 AS (SELECT *, list_concat(list_filter(list(g) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), lambda v: v IS NOT NULL), list_filter(list(g) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), lambda v: v IS NOT NULL)) AS near FROM d1),
cut AS (SELECT event_type, day FROM d2 WHERE (g > 10 AND g > 1.1 * greatest(coalesce(list_median(near), 0), 1)) OR hist > 0.16)"""


def coverage_spine(spark: SparkSession, d: str) -> DataFrame:
    """Users and days with two events or more."""
    rows = _events(spark, d).select("user_id", F.floor(F.col("hour") / 24).alias("day"))
    spine = rows.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))).alias("day"))
    return clip.coverage(spine, rows, ["user_id", "day"], 2)


def banner_window(spark: SparkSession, d: str) -> DataFrame:
    hits = _events(spark, d).where("event_type = 'purchase'").select(F.col("user_id").alias("shot"), F.col("hour").alias("frame"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("what"))
    return clip.banners(possession_frames(spark, d).select("shot", "frame"), hits, "shot", "what")


def next_frame(spark: SparkSession, d: str) -> DataFrame:
    return clip.next_frame(_events(spark, d), "user_id", "minute_no", 20000)


def thin_frames(spark: SparkSession, d: str) -> DataFrame:
    return clip.thin_frames(_events(spark, d), "user_id", "hour", 100, 600, 6)


def best_per_bin(spark: SparkSession, d: str) -> DataFrame:
    return clip.best_per_bin(_events(spark, d), F.floor(F.col("k") / 10), "value", "event_id")


QUERIES = {f.__name__: f for f in (score_timeline, scoring_runs, team_leads, contested_holder, holder_states, pass_events, flipflop_drop, possession_frames, possession_late, banner_thinned, possession_share, running_counts, gap_fill, static_clutter, near_semi, homography_map, smooth_motion, player_table, track_summary, head_tail_mean, kit_clusters, stitch_tracks, ball_path, thin_labels, first_candidates, spike_cuts, segments, coverage_spine, banner_window, next_frame, thin_frames, best_per_bin)}

_NX, _NY = "(1 + 0.01 * n)", "(0.0001 * n)"
SQL = {
    "score_timeline": f"WITH {_TIMELINE} SELECT * FROM tl",
    "scoring_runs": f"""WITH {_TIMELINE}, g AS (SELECT user_id, ord, minute, home - lag(home) OVER w AS dh, away - lag(away) OVER w AS da, max(minute) OVER (PARTITION BY user_id) AS last FROM tl WINDOW w AS (PARTITION BY user_id ORDER BY ord)),
s AS (SELECT *, CASE WHEN dh > 0 THEN 'home' WHEN da > 0 THEN 'away' END AS side FROM g), s2 AS (SELECT *, lag(side) OVER (PARTITION BY user_id ORDER BY ord) AS ls FROM s WHERE side IS NOT NULL),
s3 AS (SELECT *, sum(CASE WHEN ls = side THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ord) AS run FROM s2),
r AS (SELECT user_id, run, side, last, CAST(sum(CASE WHEN side = 'home' THEN dh ELSE da END) AS BIGINT) AS points, min(minute) AS start FROM s3 GROUP BY ALL),
r2 AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY user_id ORDER BY run), last) AS fin FROM r)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY points DESC, run) AS INT) AS nth, side, round_even(start, 1) AS start, round_even(fin, 1) AS "end", points FROM r2 QUALIFY nth <= 5""",
    "team_leads": f"WITH {_TIMELINE}, l AS (SELECT *, coalesce(lag(margin) OVER (PARTITION BY user_id ORDER BY ord), 0) * margin < 0 AS sw FROM tl) SELECT user_id, greatest(max(margin), 0) AS home_lead, greatest(-min(margin), 0) AS away_lead, count(*) FILTER (WHERE sw) AS lead_changes FROM l GROUP BY 1",
    "contested_holder": """WITH r AS (SELECT l_partkey, l_suppkey, s_nationkey AS side, round_even(l_extendedprice / l_quantity / 100, 3) AS metric FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
b AS (SELECT *, row_number() OVER w AS nth, first_value(side) OVER w AS bs FROM r WINDOW w AS (PARTITION BY l_partkey ORDER BY metric, l_suppkey)),
c AS (SELECT *, min(metric) FILTER (WHERE side <> bs) OVER (PARTITION BY l_partkey) AS rival FROM b) SELECT l_partkey, l_suppkey, metric FROM c WHERE nth = 1 AND (rival IS NULL OR rival - metric >= 0.3)""",
    "holder_states": f"WITH {_STATES} SELECT * FROM st",
    "pass_events": f"WITH {_PASSES} SELECT * FROM ev2",
    "flipflop_drop": f"""WITH {_PASSES}, i AS (SELECT *, lag(team) OVER w AS lt, lag(frame) OVER w AS lf, lead(team) OVER w AS nt, lead(frame) OVER w AS nf FROM ev2 WHERE type = 'interception' WINDOW w AS (PARTITION BY user_id ORDER BY frame, from_pid))
SELECT * FROM ev2 WHERE type = 'pass' UNION ALL SELECT user_id, frame, type, team, from_pid, to_pid, dist_m, gap_s FROM i WHERE NOT coalesce(lt <> team AND frame - lf <= 1500, false) AND NOT coalesce(nt <> team AND nf - frame <= 1500, false)""",
    "possession_frames": f"WITH {_POSS} SELECT * FROM pf",
    "possession_late": f"""WITH ev AS ({_EV}), sp AS (SELECT user_id AS shot, CAST(h AS BIGINT) AS frame FROM (SELECT DISTINCT user_id FROM events), generate_series({_LATE[0]}, {_LATE[1] - 1}, {_LATE[2]}) g(h)),
b AS (SELECT user_id AS shot, hour AS frame, max_by(event_type, event_id) AS team FROM ev GROUP BY 1, 2) SELECT sp.shot, sp.frame, b.team FROM sp ASOF LEFT JOIN b ON sp.shot = b.shot AND sp.frame >= b.frame""",
    "banner_thinned": f"""WITH ev AS ({_EV}), sp AS (SELECT user_id AS shot, CAST(h AS BIGINT) AS frame FROM (SELECT DISTINCT user_id FROM events), generate_series({_LATE[0]}, {_LATE[1] - 1}, {_LATE[2]}) g(h)),
p AS (SELECT user_id AS shot, hour AS at, max('e' || event_id) AS what FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT sp.shot, sp.frame, CASE WHEN sp.frame - p.at <= 10 THEN p.what END AS what FROM sp ASOF LEFT JOIN p ON sp.shot = p.shot AND sp.frame >= p.at""",
    "possession_share": f"WITH {_POSS} SELECT round_even(avg(CASE WHEN team = 'click' THEN 1.0 ELSE 0 END), 6) AS light, round_even(avg(CASE WHEN team = 'view' THEN 1.0 ELSE 0 END), 6) AS dark FROM pf WHERE team IN ('click', 'view')",
    "running_counts": f"""WITH {_POSS}, h AS (SELECT user_id AS shot, hour AS frame, {', '.join(f"count(*) FILTER (WHERE event_type = '{t}' AND k {op} 50) AS {t}_{y}" for t in ('click', 'view') for y, op in (('pass', '<'), ('interception', '>=')))} FROM ev GROUP BY 1, 2),
j AS (SELECT shot, frame, {', '.join(f"CAST(sum(coalesce({t}_{y}, 0)) OVER w AS BIGINT) AS {t}_{y}" for t in ('click', 'view') for y in ('pass', 'interception'))}, sum(CASE WHEN team = 'click' THEN 1 ELSE 0 END) OVER w AS c, sum(CASE WHEN team = 'view' THEN 1 ELSE 0 END) OVER w AS v FROM pf LEFT JOIN h USING (shot, frame) WINDOW w AS (PARTITION BY shot ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT shot, frame, click_pass, click_interception, view_pass, view_interception, round_even(100.0 * c / nullif(c + v, 0), 4) AS click_possession, round_even(100.0 * v / nullif(c + v, 0), 4) AS view_possession FROM j""",
    "gap_fill": f"""WITH {_HOURLY}, o AS (SELECT *, lead(hour) OVER w - hour AS step, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM hr WINDOW w AS (PARTITION BY user_id ORDER BY hour)),
p AS (SELECT *, unnest(generate_series(0, CASE WHEN step BETWEEN 2 AND 10 THEN step - 1 ELSE 0 END)) AS i FROM o)
SELECT user_id, hour + i AS hour, round_even(CASE WHEN i = 0 THEN x ELSE x + i / step * (x1 - x) END, 6) AS x, round_even(CASE WHEN i = 0 THEN y ELSE y + i / step * (y1 - y) END, 6) AS y, CASE WHEN i = 0 THEN 1.0::DOUBLE END AS conf, i > 0 AS interpolated FROM p""",
    "static_clutter": f"WITH ev AS ({_EV}) SELECT a.event_id, count(*) FILTER (WHERE sqrt(pow(a.value - b.value, 2) + pow(a.k - b.k, 2)) <= 30) - 1 AS n_img, count(*) FILTER (WHERE sqrt(2 * pow(a.k - b.k, 2)) <= 5) - 1 AS n_crt FROM ev a JOIN ev b ON a.user_id = b.user_id AND abs(a.minute_no - b.minute_no) <= 2000 GROUP BY 1",
    "near_semi": "SELECT c_custkey, coalesce(bool_or(sqrt(pow(c_acctbal - s_acctbal, 2) + pow(c_custkey % 100 - s_suppkey % 100, 2)) <= 200), false) AS near FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1",
    "homography_map": f"""SELECT c_custkey, round_even(((1 - 2 * 0.0002) * x + (3 * 0.0002 - 0.02) * y + (0.02 * 2 - 3)) / w, 6) AS px, round_even(((2 * {_NY} - 0.01) * x + ({_NX} - 3 * {_NY}) * y + (3 * 0.01 - {_NX} * 2)) / w, 6) AS py
FROM (SELECT *, (0.01 * 0.0002 - {_NY}) * x + (0.02 * {_NY} - {_NX} * 0.0002) * y + ({_NX} - 0.02 * 0.01) AS w FROM (SELECT c_custkey, c_acctbal / 100 AS x, CAST(c_custkey % 100 AS DOUBLE) AS y, CAST(c_nationkey AS DOUBLE) AS n FROM customer))""",
    "smooth_motion": f"WITH {_MOTION} SELECT user_id, frame, ok, round_even(px, 7) AS \"Xs\", round_even(py, 7) AS \"Ys\", round_even(speed, 7) AS speed, round_even(coalesce(sum(speed / 30) OVER (PARTITION BY user_id ORDER BY frame), 0), 7) AS dist FROM mo",
    "player_table": f"""WITH {_MOTION}, s AS (SELECT user_id, count(speed) AS n, sum(speed) AS t, avg(speed) AS a, max(speed) AS m, quantile_cont(speed, 0.9) AS p FROM mo GROUP BY 1 HAVING count(speed) >= 5)
SELECT user_id, user_id AS shot, 'light' AS team, min(hour) AS first_frame, max(hour) AS last_frame, round_even(avg(CASE WHEN x / 10 BETWEEN 0 AND 94 * 0.3048 AND y / 10 BETWEEN 0 AND 50 * 0.3048 THEN 1.0 ELSE 0 END), 2) AS inside_lines_share, round_even(median(x / 10), 1) AS "median_X", round_even(median(y / 10), 1) AS "median_Y",
 round_even(max(n) / 5, 1) AS seconds_tracked, round_even(max(t) / 5, 1) AS distance_m, round_even(max(a), 2) AS avg_speed_ms, round_even(max(a) * 3.6, 1) AS avg_speed_kmh, round_even(max(m), 2) AS top_speed_ms, round_even(max(m) * 3.6, 1) AS top_speed_kmh, round_even(max(p), 2) AS p90_speed_ms FROM hr JOIN s USING (user_id) GROUP BY user_id""",
    "track_summary": f"""SELECT user_id % 10 AS shot, user_id AS track_id, count(*) AS frames, min(event_id) AS first, max(event_id) AS last, round_even(avg(CASE WHEN value / 4 BETWEEN -0.5 AND 94 * 0.3048 + 0.5 AND k / 6 BETWEEN -0.5 AND 50 * 0.3048 + 0.5 THEN 1.0 ELSE 0 END), 6) AS inside_share,
 median(CASE WHEN event_id % 11 > 0 THEN value END) AS "L", median(k) AS a, median(CAST(event_id % 7 AS DOUBLE)) AS b, count(CASE WHEN event_id % 11 > 0 THEN value END) AS n_colour FROM ({_EV}) WHERE event_type <> 'error' GROUP BY 1, 2""",
    "head_tail_mean": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS v FROM ({_EV}) WHERE event_type <> 'error')
SELECT user_id % 10 AS shot, user_id AS track_id, round_even(avg(value / 4) FILTER (WHERE u <= 3), 6) AS "head_X", round_even(avg(k / 6) FILTER (WHERE u <= 3), 6) AS "head_Y", round_even(avg(value / 4) FILTER (WHERE v <= 3), 6) AS "tail_X", round_even(avg(k / 6) FILTER (WHERE v <= 3), 6) AS "tail_Y" FROM r GROUP BY 1, 2""",
    "ball_path": f"""WITH RECURSIVE ev AS ({_EV}), balls AS (SELECT event_id, user_id // 100 AS shot, hour AS frame, value % 1.0 AS conf, value * 2 AS cx, k * 4 AS cy, 10 * (value * 2) / 100 AS xp, 10 * (k * 4) / 100 AS yp FROM ev WHERE value IS NOT NULL AND k IS NOT NULL),
c AS (SELECT * FROM balls WHERE xp BETWEEN -4 AND 94 * 0.3048 + 4 AND yp BETWEEN -4 AND 50 * 0.3048 + 12 AND cy < 640),
still AS (SELECT a.event_id FROM c a JOIN c b ON a.shot = b.shot AND abs(a.frame - b.frame) <= 15 GROUP BY 1
 HAVING count(*) FILTER (WHERE sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) <= 3) - 1 >= 6 OR count(*) FILTER (WHERE sqrt(pow(a.xp - b.xp, 2) + pow(a.yp - b.yp, 2)) <= 0.3) - 1 >= 6),
people AS (SELECT user_id // 100 AS shot, event_id % {HOURS} AS frame, value / 4 AS x, k / 6 AS y FROM ev WHERE event_type <> 'error'),
near AS (SELECT DISTINCT event_id FROM c JOIN people p ON p.shot = c.shot AND p.frame = c.frame AND sqrt(pow(xp - x, 2) + pow(yp - y, 2)) <= 2.2),
n AS (SELECT *, row_number() OVER (PARTITION BY shot ORDER BY frame, conf DESC, cx, cy) AS id, sqrt(conf) + CASE WHEN event_id IN (FROM near) THEN 0.25 ELSE 0.0 END AS rew FROM c WHERE event_id NOT IN (FROM still)),
fr AS (SELECT shot, frame, row_number() OVER (PARTITION BY shot ORDER BY frame) AS t, list(struct_pack(id := id, x := xp, y := yp, rew := rew) ORDER BY id) AS nodes FROM n GROUP BY 1, 2),
dp(shot, t, win, top, top_id) AS (
 SELECT DISTINCT shot, CAST(0 AS BIGINT), CAST([] AS STRUCT(f BIGINT, id BIGINT, x DOUBLE, y DOUBLE, val DOUBLE, back BIGINT)[]), CAST('-infinity' AS DOUBLE), CAST(NULL AS BIGINT) FROM fr
 UNION ALL SELECT shot, t, list_concat(list_filter(win, lambda a: a.f >= frame - 9), made), CASE WHEN best.v > top THEN best.v ELSE top END, CASE WHEN best.v > top THEN -best.i ELSE top_id END FROM (
  SELECT *, list_max(list_transform(made, lambda m: struct_pack(v := m.val, i := -m.id))) AS best FROM (
   SELECT shot, t, win, top, top_id, frame, list_transform(tried, lambda r: CASE WHEN r.m.g > r.base THEN struct_pack(f := frame, id := r.id, x := r.x, y := r.y, val := r.m.g, back := -r.m.i) ELSE struct_pack(f := frame, id := r.id, x := r.x, y := r.y, val := r.base, back := CASE WHEN top > 0 THEN top_id END) END) AS made FROM (
    SELECT dp.shot, fr.t, dp.win, dp.top, dp.top_id, fr.frame, list_transform(fr.nodes, lambda b: struct_pack(id := b.id, x := b.x, y := b.y, base := CASE WHEN dp.top > 0 THEN dp.top + (b.rew - 0.6) ELSE b.rew - 0.6 END,
     m := list_max(list_filter(list_transform(dp.win, lambda a: CASE WHEN fr.frame - a.f <= 10 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 30.0 * (fr.frame - a.f) / 30 + 0.8
      THEN struct_pack(g := (a.val - (0.03 * (fr.frame - a.f - 1) + 0.15 * sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / (30.0 * (fr.frame - a.f) / 30 + 0.8))) + b.rew, s := a.f - fr.frame, i := -a.id) END), lambda z: z IS NOT NULL)))) AS tried
    FROM dp JOIN fr ON fr.shot = dp.shot AND fr.t = dp.t + 1)) ) ),
seen AS (SELECT DISTINCT shot, s.id, s.val, s.back FROM (SELECT shot, unnest(win) AS s FROM dp)),
path(shot, id) AS (SELECT shot, arg_max(id, struct_pack(v := val, i := -id)) FROM seen GROUP BY 1 UNION ALL SELECT p.shot, s.back FROM path p JOIN seen s ON s.shot = p.shot AND s.id = p.id WHERE s.back IS NOT NULL),
b AS (SELECT n.shot, n.frame, n.cx, n.cy, n.conf FROM path p JOIN n ON n.shot = p.shot AND n.id = p.id),
o AS (SELECT *, lead(frame) OVER w - frame AS step, lead(cx) OVER w AS x1, lead(cy) OVER w AS y1 FROM b WINDOW w AS (PARTITION BY shot ORDER BY frame)),
g AS (SELECT *, unnest(generate_series(0, CASE WHEN step BETWEEN 2 AND 10 THEN step - 1 ELSE 0 END)) AS i FROM o)
SELECT shot, frame + i AS frame, round_even(CASE WHEN i = 0 THEN cx ELSE cx + i / step * (x1 - cx) END, 6) AS cx, round_even(CASE WHEN i = 0 THEN cy ELSE cy + i / step * (y1 - cy) END, 6) AS cy, CASE WHEN i = 0 THEN round_even(conf, 6) END AS conf, i > 0 AS interpolated FROM g""",
    "stitch_tracks": f"""WITH RECURSIVE p AS (SELECT user_id // 100 AS shot, row_number() OVER (PARTITION BY user_id // 100 ORDER BY event_id) AS at_, value / 4 AS x, k / 6 AS y FROM ({_EV}) WHERE event_type <> 'error'),
q AS (SELECT *, at_ // 20 AS track_id, row_number() OVER (PARTITION BY shot, at_ // 20 ORDER BY at_) AS u, row_number() OVER (PARTITION BY shot, at_ // 20 ORDER BY at_ DESC) AS v FROM p),
t AS (SELECT shot, track_id, min(at_) AS f, max(at_) AS l, avg(x) FILTER (WHERE u <= 3) AS hx, avg(y) FILTER (WHERE u <= 3) AS hy, avg(x) FILTER (WHERE v <= 3) AS tx, avg(y) FILTER (WHERE v <= 3) AS ty FROM q GROUP BY 1, 2 HAVING count(*) >= 15),
o AS (SELECT *, row_number() OVER (PARTITION BY shot ORDER BY f, track_id) AS k FROM t),
r(shot, k, chains, track_id, pid) AS (
 SELECT DISTINCT shot, CAST(0 AS BIGINT), CAST([] AS STRUCT(team BIGINT, l BIGINT, x DOUBLE, y DOUBLE)[]), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM o
 UNION ALL SELECT shot, k, CASE WHEN i IS NULL THEN list_append(chains, me) ELSE list_transform(chains, lambda c, j: CASE WHEN j = i THEN me ELSE c END) END, track_id, 's' || shot || '-p' || coalesce(i - 1, len(chains))
 FROM (SELECT r.shot, o.k, r.chains, o.track_id, struct_pack(team := o.track_id % 2, l := o.l, x := o.tx, y := o.ty) AS me,
  list_min(list_filter(list_transform(r.chains, lambda c, j: CASE WHEN c.team = o.track_id % 2 AND o.f - c.l BETWEEN 1 AND 30 AND sqrt(pow(o.hx - c.x, 2) + pow(o.hy - c.y, 2)) <= 7.0 * (o.f - c.l) / 30 + 0.7 THEN struct_pack(d := sqrt(pow(o.hx - c.x, 2) + pow(o.hy - c.y, 2)), i := j) END), lambda s: s IS NOT NULL)).i AS i
  FROM r JOIN o ON o.shot = r.shot AND o.k = r.k + 1))
SELECT shot, track_id, pid FROM r WHERE track_id IS NOT NULL""",
    "thin_labels": f"""WITH RECURSIVE h AS (SELECT DISTINCT user_id, hour FROM ({_EV})), t AS (SELECT user_id, min(hour) AS hour FROM h GROUP BY 1 UNION ALL SELECT t.user_id, (SELECT min(h.hour) FROM h WHERE h.user_id = t.user_id AND h.hour >= t.hour + 3) FROM t WHERE t.hour IS NOT NULL)
SELECT * FROM t WHERE hour IS NOT NULL""",
    "first_candidates": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) <= 6",
    "spike_cuts": f"WITH {_CUTS} SELECT * FROM cut",
    "segments": f"""WITH {_CUTS}, m AS (SELECT event_type, day AS start FROM cut UNION SELECT event_type, 0 FROM events), e AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY event_type ORDER BY start), 30) AS "end" FROM m) SELECT event_type, start, "end" FROM e WHERE "end" - start >= 2""",
    "coverage_spine": f"""WITH u AS (SELECT DISTINCT user_id FROM events), s AS (SELECT user_id, d FROM u, generate_series(0, 29) g(d)), c AS (SELECT s.user_id, s.d, count(e.event_id) AS n FROM s LEFT JOIN ({_EV}) e ON e.user_id = s.user_id AND e.hour // 24 = s.d GROUP BY 1, 2)
SELECT count(*) AS n_spine, CAST(median(n) AS DOUBLE) AS median_rows, round_even(avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0 END), 3) AS share_full FROM c""",
    "banner_window": f"""WITH {_POSS}, p AS (SELECT user_id AS shot, hour AS at, max('e' || event_id) AS what FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT sp.shot, sp.frame, CASE WHEN sp.frame - p.at <= 36 THEN p.what END AS what FROM sp ASOF LEFT JOIN p ON sp.shot = p.shot AND sp.frame >= p.at""",
    "next_frame": f"SELECT user_id, min(minute_no) AS minute_no FROM ({_EV}) WHERE minute_no >= 20000 GROUP BY 1",
    "thin_frames": f"SELECT user_id, hour FROM (SELECT DISTINCT user_id, hour FROM ({_EV}) WHERE hour >= 100 AND hour < 700) QUALIFY (row_number() OVER (PARTITION BY user_id ORDER BY hour) - 1) % 6 = 0",
    "best_per_bin": f"SELECT CAST(floor(k / 10) AS BIGINT) AS bin, max(value) AS value, arg_max(event_id, value * 1e9 + event_id) AS event_id FROM ({_EV}) GROUP BY 1",
}
