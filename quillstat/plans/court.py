"""Queries of maps, markings, frame features, logs and data-set labels over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.functions import params as P
from quillstat.functions.scalar import half_even, project
from quillstat.operators import boxscore as B
from quillstat.operators import clip, court, homography, labels, summary, tracks
from quillstat.plans.boxscore import read

VIEWS, WRONG = 5, 7


def _planted(view: Column) -> list[Column]:
    return [1 + 0.01 * view, F.lit(0.02), F.lit(3.0), F.lit(0.01), F.lit(1.0), F.lit(2.0), 0.0001 * view, F.lit(0.0002), F.lit(1.0)]


def homography_fit(spark: SparkSession, d: str) -> DataFrame:
    """Customers as point pairs of five views, a seventh of them wrong by far: the planted maps come back, shown where they take two places."""
    view, x, y = F.col("c_custkey") % VIEWS, F.col("c_acctbal") / 100, (F.col("c_custkey") % 100).cast("double")
    u, v = project(_planted(view), x, y)
    off = F.when(F.col("c_custkey") % WRONG == 0, 50.0 + F.col("c_custkey") % 90).otherwise(0.0)
    pairs = read(spark, d, "customer").select(view.alias("view"), x.alias("x"), y.alias("y"), (u + off).alias("u"), (v - off).alias("v"))
    found = homography.consensus(pairs, ["view"], 0.5)
    h = [F.col("h")[k] for k in range(9)]
    put = {f"{c}{k}": half_even(p, 3) for k, at in enumerate(((10.0, 20.0), (60.0, 70.0))) for c, p in zip("uv", project(h, F.lit(at[0]), F.lit(at[1])), strict=True)}
    return found.select("view", "n", "n_inliers", *[p.alias(c) for c, p in put.items()])


def nearest_line(spark: SparkSession, d: str) -> DataFrame:
    """Customers on a court: the marking nearest to each within two metres."""
    k = F.col("c_custkey")
    points = read(spark, d, "customer").select("c_custkey", (k * 37 % 3301 / 100 - 2.1).alias("x"), (k * 53 % 1907 / 100 - 1.9).alias("y"))
    near = court.nearest_line(points, court.court_lines(spark), 2.0)
    # Markings meet: which one is named there is a matter of the last bit.
    return near.select("c_custkey", half_even(F.col("away"), 6).alias("away"), F.col("line").isNotNull().alias("near"))


def frame_features(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as frames of a clip a label."""
    out = clip.frame_features(read(spark, d, "embeddings"), "label", "vec_id", "embedding", 16, -0.6, 0.6)
    return out.select("label", "vec_id", half_even(F.col("grey"), 6).alias("grey"), half_even(F.col("hist"), 6).alias("hist"))


def feature_cuts(spark: SparkSession, d: str) -> DataFrame:
    return clip.detect_cuts(frame_features(spark, d), "vec_id", "grey", "hist", "label", threshold=0.35, spike_min=0.1, spike_ratio=0.15)


def line_score(spark: SparkSession, d: str) -> DataFrame:
    """Nations' customers by segment of the market as points of periods; the last period was not played."""
    n = lambda s: F.count_if(F.col("c_mktsegment") == s).cast("string")
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    rows = read(spark, d, "customer").groupBy("c_nationkey").agg(*[n(s).alias(f"period{k}Score") for k, s in enumerate(names, 1)], F.count("*").cast("string").alias("score"))
    nations = read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("teamTricode"))
    joined = nations.join(rows, F.col("n_nationkey") == F.col("c_nationkey")).withColumn("period6Score", F.lit(None).cast("string"))
    return B.line_score(joined).withColumn("FINAL", F.col("FINAL").cast("long"))


def shot_log(spark: SparkSession, d: str) -> DataFrame:
    clock = F.format_string("PT%02dM%02d.00S", F.col("l_linenumber"), (F.col("l_orderkey") % 60).cast("int"))
    pbp = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("period"), clock.alias("clock"), F.col("l_linestatus").alias("description"), F.lit(1).alias("isFieldGoal"), F.col("l_quantity").alias("shotDistance"), F.lit(2).alias("shotValue"), F.when(F.col("l_returnflag") == "R", "MADE").otherwise("Missed").alias("shotResult"))
    return B.shot_log(B.shots(pbp, "l_orderkey", "period", "clock", "description"), "l_orderkey")


def event_list(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", F.col("event_id").alias("frame"), F.col("event_type").alias("type"), F.when(F.col("event_id") % 2 == 0, "light").otherwise("dark").alias("team"), F.lit("a").alias("from_pid"), F.lit("b").alias("to_pid"), F.col("value").alias("dist_m"), (F.col("event_id") % 75 / 30).alias("gap_s"))
    return summary.event_list(e, {"light": "BOS", "dark": "GSW"}, "user_id").select("user_id", "nth", F.col("clip time").alias("clip_time"), "type", "team", F.col("distance (m)").alias("metres"), half_even(F.col("ball in flight (s)"), 4).alias("seconds"))


def crop_labels(spark: SparkSession, d: str) -> DataFrame:
    """Events as ball candidates: where their crops lie, and their label lines."""
    k = F.get_json_object("props", "$.k").cast("double")
    rows = read(spark, d, "events").select(F.col("user_id").alias("shot"), F.col("event_id").alias("frame"), (F.col("value") * 12).alias("cx"), (k * 7).alias("cy"), (F.col("event_id") % 30 + 5).alias("w"), (F.col("event_id") % 20 + 6).alias("h"), (F.col("event_type") == "click").alias("positive"))
    return labels.crops(rows, 1280, 720).select("name", "split", "ox", "oy", "label")


def segment_quality(spark: SparkSession, d: str) -> DataFrame:
    """Users in pairs as segments of 720 hours, events as detections."""
    e = read(spark, d, "events").select(F.floor(F.col("user_id") / 2).alias("segment"), ((F.dayofmonth("ts") - 1) * 24 + F.hour("ts")).cast("long").alias("frame"), (F.col("event_id") % 9 - 1).alias("track_id"), (F.col("event_type") == "click").alias("is_ball"), (F.col("value") > 5).alias("on_floor"))
    return tracks.segment_quality(e, e.select("segment").distinct().withColumn("frames", F.lit(720).cast("long")))


def two_kits(spark: SparkSession, d: str) -> DataFrame:
    """Customers as tracks of two colours, every eleventh of a third."""
    k = F.col("c_custkey")
    base = F.when(k % 11 == 0, 150.0).when(k % 2 == 0, 80.0).otherwise(20.0)
    rows = read(spark, d, "customer").select((k % 10).alias("shot"), k.alias("track_id"), (base + k % 7).alias("L"), (base / 4 + k % 3).alias("a"), (F.lit(9.0) + k % 5).alias("b"), (k % 40).alias("n_colour"))
    return tracks.two_kits(rows.where("track_id % 11 <> 0 OR track_id % 55 = 0"))


QUERIES = {f.__name__: f for f in (homography_fit, nearest_line, frame_features, feature_cuts, line_score, shot_log, event_list, crop_labels, segment_quality, two_kits)}

_V = "(c_custkey % 5)"
_PUT = "round_even(((1 + 0.01 * view) * {x} + 0.02 * {y} + 3) / (0.0001 * view * {x} + 0.0002 * {y} + 1), 3) AS u{k}, round_even((0.01 * {x} + {y} + 2) / (0.0001 * view * {x} + 0.0002 * {y} + 1), 3) AS v{k}"
_MARKS = f"""c AS (SELECT 94 * 0.3048 AS l, 50 * 0.3048 AS w, 25 * 0.3048 AS m, 5.25 * 0.3048 AS hx, 23.75 * 0.3048 AS r3, 3 * 0.3048 AS cy, 16 * 0.3048 / 2 AS lh, 19 * 0.3048 AS ld, 6 * 0.3048 AS rf, 4 * 0.3048 AS rr),
ends AS (SELECT *, hx + sqrt(r3 * r3 - (m - cy) * (m - cy)) AS jx, asin((m - cy) / r3) AS a FROM c),
half AS (
  SELECT 'lane' AS line, unnest([0, 1, 2, 3]) AS nth, unnest([0, ld, ld, 0]) AS x, unnest([m - lh, m - lh, m + lh, m + lh]) AS y FROM ends
  UNION ALL SELECT 'ft', k, ld + rf * cos(-pi() / 2 + pi() * k / 59), m + rf * sin(-pi() / 2 + pi() * k / 59) FROM ends, range(60) t(k)
  UNION ALL SELECT 'restricted', k, hx + rr * cos(-pi() / 2 + pi() * k / 29), m + rr * sin(-pi() / 2 + pi() * k / 29) FROM ends, range(30) t(k)
  UNION ALL SELECT 'three', unnest([0, 1, 62, 63]), unnest([0, jx, jx, 0]), unnest([cy, cy, w - cy, w - cy]) FROM ends
  UNION ALL SELECT 'three', k + 2, hx + r3 * cos(-a + 2 * a * k / 59), m + r3 * sin(-a + 2 * a * k / 59) FROM ends, range(60) t(k)),
marks AS (
  SELECT 'l' || line AS line, nth, x, y FROM half UNION ALL SELECT 'r' || line, nth, (SELECT l FROM c) - x, y FROM half
  UNION ALL SELECT 'outer', unnest([0, 1, 2, 3, 4]), unnest([0, l, l, 0, 0]), unnest([0, 0, w, w, 0]) FROM c
  UNION ALL SELECT 'half', unnest([0, 1]), unnest([l / 2, l / 2]), unnest([0, w]) FROM c
  UNION ALL SELECT 'centre', k, l / 2 + rf * cos(2 * pi() * k / 79), m + rf * sin(2 * pi() * k / 79) FROM c, range(80) t(k)),
seg AS (SELECT *, lead(x) OVER o - x AS dx, lead(y) OVER o - y AS dy FROM marks WINDOW o AS (PARTITION BY line ORDER BY nth))"""
_FEATURES = """bins AS (SELECT label, vec_id, embedding AS v, [CAST(len(list_filter(embedding, lambda x: x >= -0.6 AND x < 0.6 AND CAST(floor((x + 0.6) / ((0.6 + 0.6) / 16)) AS INT) = b)) AS DOUBLE) for b in range(16)] AS h FROM embeddings),
prev AS (SELECT *, lag(v) OVER w AS v0, lag(h) OVER w AS h0 FROM bins WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
feat AS (SELECT label, vec_id, CASE WHEN v0 IS NULL THEN 0.0::DOUBLE ELSE round_even(list_sum(list_transform(range(1, len(v) + 1), lambda i: abs(CAST(v[i] AS DOUBLE) - CAST(v0[i] AS DOUBLE)))) / len(v), 6) END AS grey,
  CASE WHEN v0 IS NULL THEN 0.0::DOUBLE ELSE round_even(sqrt(greatest(1 - list_sum(list_transform(range(1, 17), lambda i: sqrt(h[i] * h0[i]))) / sqrt(list_sum(h) * list_sum(h0)), 0)), 6) END AS hist FROM prev)"""
_DRAW = "CAST(('0x' || substr(md5('0:' || name || ':{d}'), 1, 8)) AS BIGINT) / 4294967296.0"
SQL = {
    "homography_fit": f"SELECT view, n, n_inliers, {_PUT.format(x=10, y=20, k=0)}, {_PUT.format(x=60, y=70, k=1)} FROM (SELECT {_V} AS view, count(*) AS n, count(*) FILTER (WHERE c_custkey % 7 <> 0) AS n_inliers FROM customer GROUP BY 1)",
    "nearest_line": f"""WITH {_MARKS}, p AS (SELECT c_custkey, c_custkey * 37 % 3301 / 100 - 2.1 AS px, c_custkey * 53 % 1907 / 100 - 1.9 AS py FROM customer),
t AS (SELECT c_custkey, px - x AS ax, py - y AS ay, dx, dy, greatest(0, least(1, ((px - x) * dx + (py - y) * dy) / (dx * dx + dy * dy))) AS t FROM p, seg WHERE dx IS NOT NULL),
n AS (SELECT c_custkey, min(sqrt(pow(ax - t * dx, 2) + pow(ay - t * dy, 2))) AS away FROM t GROUP BY 1)
SELECT c_custkey, CASE WHEN away <= 2 THEN round_even(away, 6) END AS away, away <= 2 AS near FROM n""",
    "frame_features": f"WITH {_FEATURES} SELECT * FROM feat",
    "feature_cuts": f"""WITH {_FEATURES}, d1 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY vec_id) > 1 THEN grey END AS g FROM feat),
d2 AS (SELECT *, list_concat(list_filter(list(g) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), lambda v: v IS NOT NULL), list_filter(list(g) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), lambda v: v IS NOT NULL)) AS near FROM d1)
SELECT label, vec_id FROM d2 WHERE (g > 0.1 AND g > 0.15 * greatest(coalesce(list_median(near), 0), 1)) OR hist > 0.35""",
    "line_score": """SELECT n_name AS "TEAM", count(*) FILTER (WHERE c_mktsegment = 'AUTOMOBILE') AS "Q1", count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS "Q2", count(*) FILTER (WHERE c_mktsegment = 'FURNITURE') AS "Q3", count(*) FILTER (WHERE c_mktsegment = 'HOUSEHOLD') AS "Q4", count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS "OT1", count(*) AS "FINAL" FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    "shot_log": """SELECT l_orderkey, l_linenumber AS "Q", printf('%02d:%02d', l_linenumber, l_orderkey % 60) AS "Clock", CASE WHEN l_returnflag = 'R' THEN 'Made' ELSE 'Missed' END AS "Made", l_quantity AS "Dist (ft)", l_linestatus AS "Play" FROM lineitem""",
    "event_list": """SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS nth, printf('%d:%04.1f', CAST(floor(s / 60) AS BIGINT), round_even(s - floor(s / 60) * 60, 1)) AS clip_time, event_type AS type, CASE WHEN event_id % 2 = 0 THEN 'BOS' ELSE 'GSW' END AS team, value AS metres, round_even(event_id % 75 / 30, 4) AS seconds
FROM (SELECT *, round_even(event_id / 30, 1) AS s FROM events)""",
    "crop_labels": f"""WITH e AS (SELECT user_id, event_id, value * 12 AS cx, CAST(json_extract(props, '$.k') AS DOUBLE) * 7 AS cy, event_id % 30 + 5 AS w, event_id % 20 + 6 AS h, event_type = 'click' AS pos, 's' || user_id || '_f' || event_id || CASE WHEN event_type = 'click' THEN '_p' ELSE '_n' END AS name FROM events),
o AS (SELECT *, greatest(0, least(640, CAST(trunc(cx - (60 + {_DRAW.format(d='x')} * 520)) AS INT))) AS ox, greatest(0, least(80, CAST(trunc(cy - (60 + {_DRAW.format(d='y')} * 520)) AS INT))) AS oy FROM e)
SELECT name, CASE WHEN user_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, ox, oy, CASE WHEN pos THEN printf('0 %.6f %.6f %.6f %.6f', round_even((cx - ox) / 640, 6), round_even((cy - oy) / 640, 6), round_even(greatest(w, 14) / 640, 6), round_even(greatest(h, 14) / 640, 6)) ELSE '' END AS label FROM o""",
    "segment_quality": """WITH e AS (SELECT user_id // 2 AS segment, (day(ts) - 1) * 24 + hour(ts) AS frame, event_id % 9 - 1 AS track_id, event_type = 'click' AS ball, value > 5 AS floor FROM events),
f AS (SELECT segment, min(frame) AS lo, count(DISTINCT frame) FILTER (WHERE ball) AS balls, count(*) FILTER (WHERE NOT ball AND NOT floor) AS gone FROM e GROUP BY 1),
sp AS (SELECT segment, lo + k AS frame FROM f, range(720) t(k)), n AS (SELECT sp.segment, sp.frame, count(e.frame) AS n FROM sp LEFT JOIN e ON e.segment = sp.segment AND e.frame = sp.frame AND NOT ball AND floor GROUP BY 1, 2),
c AS (SELECT segment, round_even(avg(n), 2) AS mean, median(n) AS med FROM n GROUP BY 1), t AS (SELECT segment, track_id, count(*) AS len FROM e WHERE NOT ball AND floor AND track_id >= 0 GROUP BY 1, 2), i AS (SELECT segment, count(*) AS ids, round_even(avg(len), 1) AS len FROM t GROUP BY 1)
SELECT segment, CAST(720 AS BIGINT) AS frames, mean AS players_per_frame, CAST(med AS DOUBLE) AS median_players_per_frame, coalesce(ids, 0) AS unique_track_ids, coalesce(len, 0) AS mean_track_len_frames, CASE WHEN med > 0 THEN round_even(ids / med, 2) END AS id_to_player_ratio, round_even(balls / 720, 3) AS ball_frames_share, gone AS persons_removed FROM f JOIN c USING (segment) LEFT JOIN i USING (segment)""",
    "two_kits": "SELECT c_custkey % 10 AS shot, c_custkey AS track_id, CASE WHEN c_custkey % 11 = 0 OR c_custkey % 40 < 5 THEN 'other' WHEN c_custkey % 2 = 0 THEN 'light' ELSE 'dark' END AS team FROM customer WHERE c_custkey % 11 <> 0 OR c_custkey % 55 = 0",
}
