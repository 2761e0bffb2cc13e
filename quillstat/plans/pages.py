"""Queries of tabs, pages and the clip summary over the driver's tables.

A customer is a player, its nation the team; a statistic is a number made from its key, by its place in the specification.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.functions import params as P
from quillstat.functions.scalar import ball_coloured, feet, half_even
from quillstat.operators import boxscore as B
from quillstat.operators import possession, summary, tracks
from quillstat.plans.boxscore import read


def _stats(spec: list[tuple[str, str, str]], seed: Column) -> list[Column]:
    by = {"int": 1.0, "f1": 7.0, "pct": 89.0}
    return [(seed * (k + 3) % 89 / by[kind]).alias(raw) for k, (raw, _, kind) in enumerate(spec) if kind != "min"]


def _players(spark: SparkSession, d: str, spec: list[tuple[str, str, str]]) -> DataFrame:
    c = F.col("c_custkey")
    clock = F.when(c % 5 == 0, "").otherwise(F.format_string("%d:%02d", c % 40, c % 20 * 3 + 1))
    place = F.when(c % 3 == 0, "G").when(c % 3 == 1, "F")
    team = F.concat(F.lit("T"), F.col("c_nationkey").cast("string"))
    return read(spark, d, "customer").select(c, F.col("c_name").alias("nameI"), team.alias("teamTricode"), place.alias("position"), clock.alias("minutes"), *_stats(spec, c))


def _teams(spark: SparkSession, d: str, spec: list[tuple[str, str, str]]) -> DataFrame:
    """Twenty nations, and one team without players."""
    n = read(spark, d, "nation").where("n_nationkey < 20").select("n_nationkey")
    n = n.unionByName(n.where("n_nationkey = 0").select((F.col("n_nationkey") + 99).alias("n_nationkey")))
    return n.select(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("teamTricode"), F.lit("240:00").alias("minutes"), *_stats(spec, F.col("n_nationkey") + 1))


def _pbp(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    return read(spark, d, "customer").select(F.when(c % 4 == 0, "Foul").otherwise("Shot").alias("actionType"), F.when(c % 8 == 0, "Technical").otherwise("flagrant 1").alias("subType"), F.col("c_name").alias("playerNameI"))


def _tab(name: str):
    _, endpoint, team_table, spec = next(t for t in B.TABS if t[0] == name)

    def run(spark: SparkSession, d: str) -> DataFrame:
        return B.build_tabs({(endpoint, 0): _players(spark, d, spec), (endpoint, team_table): _teams(spark, d, spec), ("playbyplay", 0): _pbp(spark, d)})[name]

    return run


def _sql_values(spec: list[tuple[str, str, str]], seed: str) -> str:
    form = {"int": "CAST({x} AS BIGINT)", "f1": "round_even({x} / 7.0, 1)", "pct": "round_even({x} / 89.0 * 100, 1)"}
    return "".join(f', {form[kind].format(x=f"({seed} * {k + 3} % 89)")} AS "{label}"' for k, (_, label, kind) in enumerate(spec) if kind != "min")


_CLOCK = "(c_custkey % 40 + (c_custkey % 20 * 3 + 1) / 60.0)"


def _tab_sql(name: str) -> str:
    spec = next(t for t in B.TABS if t[0] == name)[3]
    fouls = [', CASE WHEN c_custkey % 8 = 0 THEN 1.0::DOUBLE WHEN c_custkey % 4 = 0 THEN 0.0 END AS technical, CASE WHEN c_custkey % 8 = 0 THEN 0.0::DOUBLE WHEN c_custkey % 4 = 0 THEN 1.0 END AS flagrant', ", NULL, NULL"] if spec is P.MISC else ["", ""]
    more = ', round_even("Distance (mi)" * 1.609344, 1) AS "Distance (km)", round_even("Avg speed (mph)" * 1.609344, 1) AS "Avg speed (km/h)"' if spec is P.TRACK else ""
    return f"""WITH u AS (SELECT 'T' || c_nationkey AS team, 0 AS row_kind, c_name AS "PLAYER", CASE c_custkey % 3 WHEN 0 THEN 'G' WHEN 1 THEN 'F' ELSE '' END AS "POS", round_even({_CLOCK}, 1) AS "MIN"{_sql_values(spec, 'c_custkey')}{fouls[0]} FROM customer WHERE c_custkey % 5 <> 0
UNION ALL SELECT 'T' || n_nationkey, 1, 'TEAM', '', 240.0{_sql_values(spec, '(n_nationkey + 1)')}{fouls[1]} FROM nation WHERE n_nationkey < 20 AND n_nationkey IN (SELECT c_nationkey FROM customer))
SELECT *, CAST(row_number() OVER (PARTITION BY team ORDER BY row_kind, "MIN" DESC NULLS LAST, "PLAYER") AS INT) AS nth{more} FROM u WHERE "MIN" > 0"""


def roster(spark: SparkSession, d: str) -> DataFrame:
    return summary.roster(_players(spark, d, []))


def distance_table(spark: SparkSession, d: str) -> DataFrame:
    return summary.distance_table(_players(spark, d, P.TRACK))


def player_headline(spark: SparkSession, d: str) -> DataFrame:
    """Players with their headline; every fourth has no advanced row."""
    spec = P.BOX + P.SHOOT
    players = _players(spark, d, spec).withColumnRenamed("c_custkey", "personId").withColumn("plusMinusPoints", F.col("plusMinusPoints") - 40)
    advanced = _players(spark, d, P.ADV).withColumnRenamed("c_custkey", "personId").where("personId % 4 > 0")
    return summary.player_headline(players, advanced)


def season_labels(spark: SparkSession, d: str) -> DataFrame:
    """Years of orders as seasons."""
    y = F.year("o_orderdate")
    return read(spark, d, "orders").groupBy(F.concat(y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0")).alias("season")).agg(F.count("*").alias("games")).withColumn("label", summary.season_label(F.col("season")))


def contest_table(spark: SparkSession, d: str) -> DataFrame:
    return summary.contest_table(_players(spark, d, P.TRACK))


def tracking_totals(spark: SparkSession, d: str) -> DataFrame:
    """No team has a speed: the column goes."""
    return summary.tracking_totals(_teams(spark, d, P.TRACK).withColumn("speed", F.lit(None).cast("double")))


def four_factors_advanced(spark: SparkSession, d: str) -> DataFrame:
    """Teams' ratios with ratings; every third team has no advanced row."""
    spec = [(c, c, "int") for c in ("fieldGoalsMade", "fieldGoalsAttempted", "threePointersMade", "freeThrowsAttempted", "turnovers")]
    advanced = _teams(spark, d, P.ADV).where("cast(substring(teamTricode, 2) AS int) % 3 > 0")
    return B.four_factors(_teams(spark, d, spec), "teamTricode", advanced=advanced)


def team_summary(spark: SparkSession, d: str) -> DataFrame:
    """A summary table that lacks two of its columns."""
    spec = [(raw, raw, "int") for raw, _ in P.SUMMARY[1:-2]]
    return B.team_summary(_teams(spark, d, spec))


def game_info(spark: SparkSession, d: str) -> DataFrame:
    """Nations as arenas of games; the suppliers' table gives attendances, some of which are no numbers."""
    arena = read(spark, d, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").alias("game_id"), F.col("n_name").alias("arenaName"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("arenaCity"))
    crowd = read(spark, d, "supplier").select(F.col("s_nationkey").alias("game_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("string")).otherwise("sold out").alias("attendance"))
    return B.game_info(arena, crowd)


def label_people(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("shot"), F.col("l_partkey").alias("track_id"), "l_orderkey")
    tracks_ = line.select("shot", "track_id").distinct()
    pids = tracks_.where("track_id % 3 = 0").withColumn("pid", F.concat(F.lit("p"), F.col("track_id").cast("string")))
    teams = tracks_.where("track_id % 2 = 0").withColumn("team", F.when(F.col("track_id") % 4 == 0, "light").otherwise("dark"))
    return tracks.label_people(line, pids, teams)


def on_court(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    rows = read(spark, d, "customer").select(c, (c % 290 / 10).alias("median_X"), (c % 153 / 10).alias("median_Y"), (c % 50 / 10).alias("top_speed_ms"), (c % 11 / 10).alias("inside_lines_share"), (c % 30 / 10).alias("seconds_tracked"))
    return tracks.on_court(rows).select("c_custkey")


def feet_points(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey").cast("double")
    x, y = feet(c, c * 3, c + 8)
    return read(spark, d, "customer").select("c_custkey", x.alias("x"), y.alias("y"), ball_coloured(c % 25, c % 90, c % 250).alias("is_ball"))


def frame_holders(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a nation as people around its suppliers' mean place."""
    x, y = F.col("c_custkey") % 37 * 1.0, F.col("c_custkey") % 23 * 1.0
    people = read(spark, d, "customer").select(F.col("c_nationkey").alias("shot"), (F.col("c_custkey") % 12).alias("frame"), F.col("c_name").alias("pid"), F.when(F.col("c_custkey") % 7 == 0, "unknown").when(F.col("c_custkey") % 2 == 0, "light").otherwise("dark").alias("team"), x.alias("x1"), y.alias("y1"), (x + 8).alias("x2"), (y + 16).alias("y2"))
    ball = people.select("shot", "frame").distinct().select("shot", "frame", (F.col("frame") * 2.0 + 5.3).alias("cx"), (F.col("shot") / 2 + 9.7).alias("cy"))
    return possession.frame_holders(people, ball).select("shot", "frame", "pid", "team")


def _clip(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as frames, lines as people, some of them in chains."""
    frames = read(spark, d, "orders").select(F.col("o_orderkey").alias("frame"), (F.col("o_orderkey") % 4 > 0).alias("mapped"), (F.col("o_custkey") % 1000 / 8).alias("score"), (F.col("o_custkey") % 211).alias("inliers"))
    people = read(spark, d, "lineitem").select(F.col("l_linenumber").alias("shot"), F.col("l_partkey").alias("track_id"), F.col("l_orderkey").alias("frame"), F.when(F.col("l_returnflag") == "A", "light").when(F.col("l_returnflag") == "R", "dark").otherwise("unknown").alias("team"), "l_quantity")
    kept = people.where("l_quantity < 40").withColumn("pid", F.concat_ws("-", "shot", "track_id"))
    return frames, people, kept


def clip_quality(spark: SparkSession, d: str) -> DataFrame:
    return summary.quality(*_clip(spark, d), many=3)


def _totals(spark: SparkSession, d: str) -> DataFrame:
    frames, people, kept = _clip(spark, d)
    shots = read(spark, d, "part").select((F.col("p_partkey") % 900).alias("frames"), (F.col("p_partkey") % 3 > 0).alias("usable"))
    ball = people.where("l_quantity > 45").select((F.col("frame") % 5 == 0).alias("interpolated"))
    return summary.clip_totals(shots, frames, ball, kept.where("team = 'light'"), people.where("shot = 7"), people.select("team"))


def clip_totals(spark: SparkSession, d: str) -> DataFrame:
    return _totals(spark, d)


def quality_panel(spark: SparkSession, d: str) -> DataFrame:
    return summary.quality_panel(_totals(spark, d), "balls_v2")


def team_stats(spark: SparkSession, d: str) -> DataFrame:
    side = lambda c: F.when(c % 3 == 0, "light").when(c % 3 == 1, "dark")
    events = read(spark, d, "events").select(F.when(F.col("event_type") == "click", "pass").otherwise("interception").alias("type"), side(F.col("user_id")).alias("team"))
    players = read(spark, d, "supplier").select(side(F.col("s_suppkey")).alias("team"), (F.col("s_suppkey") % 400 / 4).alias("seconds_tracked"), (F.col("s_suppkey") % 301).cast("double").alias("distance_m"))
    share = possession.possession_share(events.select("team"))
    return summary.team_stats(events, players, share, {"light": "BOS", "dark": "GSW"})


def summary_document(spark: SparkSession, d: str) -> DataFrame:
    """The clip's totals, its teams and its quality as one JSON document."""
    return summary.summary_document(_totals(spark, d), team_stats(spark, d), clip_quality(spark, d))


def clip_players(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    rows = read(spark, d, "supplier").select((s % 9).alias("shot"), F.col("s_name").alias("pid"), F.when(s % 2 == 0, "light").otherwise("dark").alias("team"), (s % 40 / 2).alias("seconds_tracked"), (s % 70 / 2).alias("distance_m"), (s % 12 / 2).alias("avg_speed_kmh"), (s % 30 / 2).alias("top_speed_kmh"))
    return summary.clip_players(rows, {"light": "BOS", "dark": "GSW"}, "BOS")


def price_spread(spark: SparkSession, d: str) -> DataFrame:
    out = summary.spread(read(spark, d, "lineitem"), "l_quantity", "l_returnflag")
    return out.withColumns({"mean": half_even(F.col("mean"), 6), **{c: half_even(F.col(c).cast("double"), 6) for c in ("least", "p10", "p50", "p90", "most")}})


def short_track_share(spark: SparkSession, d: str) -> DataFrame:
    out = summary.short_track_share(_clip(spark, d)[1], 5)
    return out.withColumn("share", half_even(F.col("share"), 6))


def game_report(spark: SparkSession, d: str) -> DataFrame:
    games = read(spark, d, "nation").select(F.col("n_nationkey").alias("game_id"))
    players = read(spark, d, "customer").select(F.col("c_nationkey").alias("game_id"), F.when(F.col("c_custkey") % 6 == 0, "0:00").when(F.col("c_custkey") % 6 > 1, "5:00").alias("minutes"))
    suppliers = read(spark, d, "supplier").select(F.col("s_nationkey").alias("game_id"), "s_suppkey")
    return summary.game_report(games, {"traditional": players, "hustle": suppliers.where("s_suppkey % 7 = 0"), "misc": suppliers.where("false")}, players)


_TAB_NAMES = {"tab_box": "Box score", "tab_shooting": "Shooting", "tab_advanced": "Advanced", "tab_misc": "Miscellaneous", "tab_hustle": "Hustle", "tab_tracking": "Player tracking"}
QUERIES = {key: _tab(name) for key, name in _TAB_NAMES.items()} | {f.__name__: f for f in (roster, distance_table, player_headline, season_labels, contest_table, tracking_totals, four_factors_advanced, team_summary, game_info, label_people, on_court, feet_points, frame_holders, clip_quality, clip_totals, quality_panel, team_stats, summary_document, clip_players, price_spread, short_track_share, game_report)}


def _raw(spec: list[tuple[str, str, str]], name: str, seed: str) -> str:
    k = next(k for k, s in enumerate(spec) if s[0] == name)
    by = {"int": "1.0", "f1": "7.0", "pct": "89.0"}[spec[k][2]]
    return f"({seed} * {k + 3} % 89 / {by})"


def _track(name: str, seed: str = "c_custkey") -> str:
    return _raw(P.TRACK, name, seed)


def _pair(name: str) -> str:
    return f"CAST({_track(name + 'FieldGoalsMade')} AS BIGINT) || '/' || CAST({_track(name + 'FieldGoalsAttempted')} AS BIGINT)"


def _line(name: str) -> str:
    return f"CAST({_raw(P.BOX + P.SHOOT, name, 'c_custkey')} AS BIGINT)"


_RATE = lambda name: f"CASE WHEN c_custkey % 4 > 0 THEN printf('%.1f', round_even({_raw(P.ADV, name, 'c_custkey')} * 100, 1)) END"
_NATIONS = "(SELECT n_nationkey AS n FROM nation WHERE n_nationkey < 20 UNION ALL SELECT 99)"
_FACTOR = lambda k: f"((n + 1) * {k + 3} % 89 / 1.0)"
_PEOPLE = "people AS (SELECT l_linenumber AS shot, l_partkey AS track_id, l_orderkey AS frame, CASE l_returnflag WHEN 'A' THEN 'light' WHEN 'R' THEN 'dark' ELSE 'unknown' END AS team, l_quantity AS q FROM lineitem)"
_TOTALS = f"""{_PEOPLE}, tot AS (SELECT (SELECT round_even(sum(p_partkey % 900) / 30, 1) FROM part) AS clip_seconds, (SELECT count(*) FROM part WHERE p_partkey % 3 > 0) AS usable_shots, (SELECT round_even(sum(p_partkey % 900) / 30, 1) FROM part WHERE p_partkey % 3 > 0) AS analysed_seconds,
 (SELECT count(*) FROM people WHERE q > 45) AS ball_frames_selected, (SELECT count(*) FROM people WHERE q > 45 AND frame % 5 <> 0) AS ball_frames_detected, (SELECT count(*) FROM people WHERE q < 40 AND team = 'light') AS holder_frames, (SELECT count(*) FROM people WHERE shot = 7) AS holding_states, (SELECT count(*) FROM people WHERE team <> 'unknown') AS frames_with_known_possession,
 (SELECT round_even(count(*) FILTER (WHERE o_orderkey % 4 > 0) / count(*), 3) FROM orders) AS mapped_share, (SELECT round_even((SELECT count(*) FROM people WHERE q > 45) / count(*), 3) FROM orders WHERE o_orderkey % 4 > 0) AS ball_share)"""
SQL = {key: _tab_sql(name) for key, name in _TAB_NAMES.items()} | {
    "roster": f"SELECT 'T' || c_nationkey AS team, c_name AS \"PLAYER\", round_even({_CLOCK}, 4) AS mins, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY round_even({_CLOCK}, 4) DESC, c_name) AS INT) AS nth FROM customer WHERE c_custkey % 5 <> 0",
    "player_headline": f"""SELECT c_custkey AS "personId", c_name AS "PLAYER", 'T' || c_nationkey AS team, printf('%.0f', round_even({_CLOCK}, 0)) AS "Minutes", {_line('points')} AS "Points", {_line('reboundsTotal')} AS "Rebounds", {_line('assists')} AS "Assists",
 {_line('steals')} || ' / ' || {_line('blocks')} AS "Steals / blocks", printf('%+.0f', CAST({_line('plusMinusPoints')} - 40 AS DOUBLE)) AS "+/-", {_line('fieldGoalsMade')} || '/' || {_line('fieldGoalsAttempted')} AS "FG", {_line('threePointersMade')} || '/' || {_line('threePointersAttempted')} AS "3P", {_line('freeThrowsMade')} || '/' || {_line('freeThrowsAttempted')} AS "FT", {_line('turnovers')} AS "Turnovers",
 {_RATE('trueShootingPercentage')} AS "True shooting %", {_RATE('usagePercentage')} AS "Usage %" FROM customer WHERE c_custkey % 5 <> 0""",
    "season_labels": "SELECT year(o_orderdate) || '-' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') AS season, count(*) AS games, (year(o_orderdate) + 1) || ' playoffs (' || season || ' season)' AS label FROM orders GROUP BY ALL",
    "distance_table": f"""SELECT "PLAYER", team, round_even(m, 2) AS mins, round_even(km, 3) AS km, round_even(kmh, 3) AS kmh, round_even(CASE WHEN m >= 5 THEN km / m END, 4) AS km_per_minute
FROM (SELECT c_name AS "PLAYER", 'T' || c_nationkey AS team, CAST({_CLOCK} AS DOUBLE) AS m, CAST({_track('distance')} AS DOUBLE) * 1.609344 AS km, CAST({_track('speed')} AS DOUBLE) * 1.609344 AS kmh FROM customer WHERE c_custkey % 5 <> 0)""",
    "contest_table": f"SELECT c_name AS \"PLAYER\", 'T' || c_nationkey AS team, round_even({_CLOCK}, 0) AS mins, CAST({_track('reboundChancesOffensive')} AS BIGINT) AS oreb_chances, CAST({_track('reboundChancesDefensive')} AS BIGINT) AS dreb_chances, {_pair('contested')} AS contested, {_pair('uncontested')} AS uncontested, {_pair('defendedAtRim')} AS rim FROM customer WHERE c_custkey % 5 <> 0",
    "tracking_totals": f"SELECT 'T' || n AS team, round_even(CAST({_track('distance', '(n + 1)')} AS DOUBLE) * 1.609344, 1) AS km, CAST({_track('touches', '(n + 1)')} AS BIGINT) AS touches, CAST({_track('passes', '(n + 1)')} AS BIGINT) AS passes, CAST({_track('reboundChancesTotal', '(n + 1)')} AS BIGINT) AS rebound_chances FROM {_NATIONS}",
    "four_factors_advanced": f"""SELECT 'T' || n AS "teamTricode", {', '.join(f"CASE WHEN n % 3 > 0 THEN round_even({_raw(P.ADV, raw, '(n + 1)')}{' * 100' if kind == 'pct' else ''}, 1) END AS {label}" for raw, (label, kind) in P.ADVANCED.items())},
 round_even(100.0 * ({_FACTOR(0)} + 0.5 * {_FACTOR(2)}) / nullif({_FACTOR(1)}, 0), 1) AS efg_pct, round_even(100.0 * {_FACTOR(4)} / nullif({_FACTOR(1)} + 0.44 * {_FACTOR(3)} + {_FACTOR(4)}, 0), 1) AS tov_pct, round_even({_FACTOR(3)} / nullif({_FACTOR(1)}, 0), 2) AS ft_rate FROM {_NATIONS}""",
    "team_summary": "SELECT 'T' || n AS \"TEAM\"" + "".join(f', (n + 1) * {k + 3} % 89 / 1.0 AS "{label}"' for k, (_, label) in enumerate(P.SUMMARY[1:-2])) + f" FROM {_NATIONS}",
    "game_info": """SELECT coalesce(n_nationkey, s_nationkey) AS game_id, n_name || ', R' || n_regionkey AS arena, attendance FROM (SELECT * FROM nation WHERE n_nationkey <> 3)
FULL JOIN (SELECT s_nationkey, min(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END) AS attendance FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey""",
    "label_people": "SELECT CAST(l_linenumber AS BIGINT) AS shot, l_partkey AS track_id, l_orderkey, CASE WHEN l_partkey % 3 = 0 THEN 'p' || l_partkey ELSE '' END AS pid, CASE l_partkey % 4 WHEN 0 THEN 'light' WHEN 2 THEN 'dark' ELSE 'unknown' END AS team FROM lineitem",
    "on_court": "SELECT c_custkey FROM (SELECT c_custkey, least(c_custkey % 290 / 10, 94 * 0.3048 - c_custkey % 290 / 10, c_custkey % 153 / 10, 50 * 0.3048 - c_custkey % 153 / 10) AS e FROM customer) WHERE (e >= 1.5 OR c_custkey % 50 >= 30) AND e >= 0.4 AND c_custkey % 11 >= 7 AND c_custkey % 30 >= 10",
    "feet_points": "SELECT c_custkey, CAST(c_custkey * 2 AS DOUBLE) AS x, CAST(c_custkey + 8 AS DOUBLE) AS y, c_custkey % 25 BETWEEN 3 AND 17 AND c_custkey % 90 >= 70 AND c_custkey % 250 BETWEEN 90 AND 200 AS is_ball FROM customer",
    "frame_holders": """WITH p AS (SELECT c_nationkey AS shot, c_custkey % 12 AS frame, c_name AS pid, CASE WHEN c_custkey % 2 = 0 THEN 'light' ELSE 'dark' END AS team, c_custkey % 37 AS x, c_custkey % 23 AS y FROM customer WHERE c_custkey % 7 <> 0),
b AS (SELECT *, frame * 2.0 + 5.3 AS cx, shot / 2 + 9.7 AS cy FROM p), m AS (SELECT *, sqrt(pow((cx - (x + 4)) / 5.2, 2) + pow((cy - (y + 8.8)) / 8.0, 2)) AS metric FROM b WHERE cx BETWEEN x - 1.2 AND x + 9.2 AND cy BETWEEN y - 1.6 AND y + 15.2),
r AS (SELECT *, row_number() OVER w AS nth, first_value(team) OVER w AS side FROM m WINDOW w AS (PARTITION BY shot, frame ORDER BY metric, pid)), c AS (SELECT *, min(metric) FILTER (WHERE team <> side) OVER (PARTITION BY shot, frame) AS rival FROM r)
SELECT shot, frame, pid, team FROM c WHERE nth = 1 AND (rival IS NULL OR rival - metric >= 0.3)""",
    "clip_quality": f"""WITH {_PEOPLE}, k AS (SELECT frame, count(*) AS n FROM people WHERE q < 40 AND team <> 'unknown' GROUP BY 1), s AS (SELECT coalesce(n, 0) AS n FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 > 0) LEFT JOIN k ON frame = o_orderkey)
SELECT (SELECT count(*) FROM orders) AS analysed_frames, (SELECT count(*) FROM orders WHERE o_orderkey % 4 > 0) AS mapped_frames, (SELECT round_even(median(o_custkey % 1000 / 8), 2) FROM orders WHERE o_orderkey % 4 > 0) AS alignment_score_median, (SELECT CAST(floor(median(o_custkey % 211)) AS BIGINT) FROM orders WHERE o_orderkey % 4 > 0) AS feature_matches_median,
 (SELECT CAST(median(n) AS DOUBLE) FROM s) AS players_per_frame_median, (SELECT round_even(avg(CASE WHEN n >= 3 THEN 1.0 ELSE 0 END), 3) FROM s) AS share_with_many_players, (SELECT count(*) FROM (SELECT DISTINCT shot, track_id FROM people)) AS raw_tracks, (SELECT count(*) FROM (SELECT DISTINCT shot, track_id FROM people WHERE q < 40)) AS chains_kept""",
    "clip_totals": f"WITH {_TOTALS} SELECT * FROM tot",
    "quality_panel": f"""WITH {_TOTALS}, t AS (SELECT *, CAST(CAST(round_even(clip_seconds, 0) AS BIGINT) AS VARCHAR) AS c, CAST(CAST(round_even(analysed_seconds, 0) AS BIGINT) AS VARCHAR) AS a, CAST(CAST(round_even(analysed_seconds / clip_seconds * 100, 0) AS BIGINT) AS VARCHAR) AS s, CAST(CAST(round_even(mapped_share * 100, 0) AS BIGINT) AS VARCHAR) AS m, CAST(CAST(round_even(ball_share * 100, 0) AS BIGINT) AS VARCHAR) AS b FROM tot)
SELECT 0 AS nth, 'Clip length' AS item, c || ' s' AS value FROM t UNION ALL SELECT 1, 'Shots showing the court (analysed)', usable_shots || ' shots, ' || a || ' s (' || s || '%)' FROM t UNION ALL SELECT 2, 'Frames mapped to the court', m || '% of analysed frames' FROM t
UNION ALL SELECT 3, 'Ball found (detected or briefly interpolated)', b || '% of mapped frames' FROM t UNION ALL SELECT 4, 'Frames with a known ball holder', CAST(holder_frames AS VARCHAR) FROM t UNION ALL SELECT 5, 'Ball model', 'balls_v2'""",
    "team_stats": """WITH e AS (SELECT event_type, user_id % 3 AS s FROM events), k(team, kit, s) AS (VALUES ('BOS', 'light', 0), ('GSW', 'dark', 1))
SELECT team, kit, (SELECT count(*) FROM e WHERE e.s = k.s AND event_type = 'click') AS passes, (SELECT count(*) FROM e WHERE e.s = k.s AND event_type <> 'click') AS interceptions, (SELECT round_even(100.0 * count(*) FILTER (WHERE e.s = k.s) / count(*), 1) FROM e WHERE e.s < 2) AS possession_pct,
 (SELECT round_even(coalesce(sum(s_suppkey % 400 / 4), 0.0), 1) FROM supplier WHERE s_suppkey % 3 = k.s) AS players_tracked_seconds, (SELECT round_even(CAST(coalesce(sum(s_suppkey % 301), 0) AS DOUBLE), 0) FROM supplier WHERE s_suppkey % 3 = k.s) AS distance_m FROM k""",
    "clip_players": "SELECT s_suppkey % 9 AS shot, CAST(row_number() OVER (PARTITION BY s_suppkey % 9 ORDER BY s_suppkey % 40 DESC, s_name) AS INT) AS nth, s_name AS pid, 'BOS' AS team_name, s_suppkey % 40 / 2 AS seconds_tracked, s_suppkey % 70 / 2 AS distance_m, s_suppkey % 12 / 2 AS avg_speed_kmh, s_suppkey % 30 / 2 AS top_speed_kmh FROM supplier WHERE s_suppkey % 2 = 0",
    "price_spread": "SELECT l_returnflag, count(l_quantity) AS n, round_even(avg(l_quantity), 6) AS mean, CAST(min(l_quantity) AS DOUBLE) AS least, round_even(quantile_cont(l_quantity, 0.1), 6) AS p10, round_even(quantile_cont(l_quantity, 0.5), 6) AS p50, round_even(quantile_cont(l_quantity, 0.9), 6) AS p90, CAST(max(l_quantity) AS DOUBLE) AS most FROM lineitem GROUP BY 1",
    "short_track_share": f"WITH {_PEOPLE}, t AS (SELECT shot, track_id, count(*) AS n FROM people GROUP BY 1, 2) SELECT shot, round_even(coalesce(sum(n) FILTER (WHERE n < 5), 0) / sum(n), 6) AS share FROM t GROUP BY 1",
    "game_report": """WITH g AS (SELECT n_nationkey AS id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey % 7 = 0) AS s, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_custkey % 6 < 2) AS n_dnp FROM nation)
SELECT id AS game_id, CAST(1 + CASE WHEN c = 0 THEN 1 ELSE 0 END + CASE WHEN s = 0 THEN 1 ELSE 0 END AS INT) AS n_empty, CASE WHEN c = 0 THEN 'traditional,' ELSE '' END || CASE WHEN s = 0 THEN 'hustle,' ELSE '' END || 'misc' AS empty, n_dnp FROM g""",
}

_FIELDS = {
    "tot": ("clip_seconds", "usable_shots", "analysed_seconds", "ball_frames_selected", "ball_frames_detected", "holder_frames", "holding_states", "frames_with_known_possession", "mapped_share", "ball_share"),
    "ts": ("kit", "passes", "interceptions", "possession_pct", "players_tracked_seconds", "distance_m"),
    "q": ("analysed_frames", "mapped_frames", "alignment_score_median", "feature_matches_median", "players_per_frame_median", "share_with_many_players", "raw_tracks", "chains_kept"),
}
_PACK = {t: ", ".join(f"{c} := {t}.{c}" for c in columns) for t, columns in _FIELDS.items()}
SQL["summary_document"] = f"""WITH tot AS ({SQL["clip_totals"]}), ts AS ({SQL["team_stats"]}), q AS ({SQL["clip_quality"]}), t AS (SELECT team, struct_pack({_PACK["ts"]}) AS s FROM ts)
SELECT CAST(to_json(struct_pack({_PACK["tot"]}, team_stats := struct_pack("BOS" := (SELECT s FROM t WHERE team = 'BOS'), "GSW" := (SELECT s FROM t WHERE team = 'GSW')), quality := struct_pack({_PACK["q"]}))) AS VARCHAR) AS json FROM tot, q"""
