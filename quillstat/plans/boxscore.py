"""Box-score queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.functions.scalar import clock_seconds, elapsed_minutes, half_even, minutes
from quillstat.operators import boxscore as B


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def box_score(spark: SparkSession, d: str) -> DataFrame:
    """Per-nation player rows (customers with their order totals) plus one TEAM row from the team table."""
    orders = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("gp"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("pts"))
    nations = read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("teamTricode"))
    people = read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("nameI"), "c_nationkey").join(orders, F.col("c_custkey") == F.col("o_custkey"))
    people = people.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    teams = people.groupBy("teamTricode").agg(F.sum("gp").alias("gp"), F.sum("pts").alias("pts"))
    return B.team_tabs(people, teams, [("gp", "GP", "int"), ("pts", "PTS", "f1")])


def minutes_parse(spark: SparkSession, d: str) -> DataFrame:
    m, s = F.minute("ts"), F.second("ts")
    text = F.when(F.col("event_id") % 4 == 0, F.format_string("%d:%02d", m, s)).when(F.col("event_id") % 4 == 1, F.format_string("PT%02dM%02d.00S", m, s)).when(F.col("event_id") % 4 == 2, m.cast("string")).otherwise("")
    return read(spark, d, "events").select("event_id", half_even(minutes(text), 3).alias("minutes"))


def clock_elapsed(spark: SparkSession, d: str) -> DataFrame:
    clock = F.format_string("PT%02dM%02d.00S", F.minute("ts") % 5, F.second("ts"))
    period = (F.col("event_id") % 6 + 1).cast("int")
    return read(spark, d, "events").select("event_id", clock_seconds(clock).alias("seconds_left"), half_even(elapsed_minutes(period, clock), 3).alias("elapsed"), B.shown_clock(clock).alias("shown"), B.clip_time(F.col("value")).alias("clip"))


def _team_lines(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem")
    return line.groupBy(F.col("l_returnflag").alias("teamTricode")).agg(
        F.sum("l_linenumber").alias("fieldGoalsMade"), F.sum("l_quantity").alias("fieldGoalsAttempted"), F.count_if(F.expr("l_discount > 0.05D")).alias("threePointersMade"),
        F.count("*").alias("freeThrowsAttempted"), F.count_if(F.expr("l_tax > 0.05D")).alias("turnovers"),
    )


def four_factors(spark: SparkSession, d: str) -> DataFrame:
    return B.four_factors(_team_lines(spark, d), "teamTricode")


def scoring_sources(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem")
    q = lambda lo, hi: F.count_if(F.col("l_quantity").between(lo, hi))
    misc = line.groupBy(F.col("l_returnflag").alias("teamTricode")).agg(q(1, 10).alias("pointsPaint"), q(11, 20).alias("pointsFastBreak"), q(21, 30).alias("pointsSecondChance"), q(31, 40).alias("pointsOffTurnovers"))
    split = line.groupBy(F.col("l_returnflag").alias("teamTricode"), F.when(F.col("l_linestatus") == "O", "Bench").otherwise("Starters").alias("startersBench")).agg(F.count("*").alias("points"))
    return B.scoring_sources(misc, split)


_SOURCES = ["pointsPaint", "pointsFastBreak", "pointsSecondChance", "pointsOffTurnovers", "bench"]


def sources_long(spark: SparkSession, d: str) -> DataFrame:
    return B.long_form(scoring_sources(spark, d), ["teamTricode"], _SOURCES)


def sources_transposed(spark: SparkSession, d: str) -> DataFrame:
    return sources_long(spark, d).groupBy("source").pivot("teamTricode", ["A", "N", "R"]).agg(F.first("points"))


def _shot_rows(spark: SparkSession, d: str) -> DataFrame:
    pbp = read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.lit(1).alias("isFieldGoal"), (F.col("l_quantity") / 4).alias("shotDistance"), F.when(F.col("l_discount") >= 0.09, 3).otherwise(2).alias("shotValue"),
        F.when(F.col("l_returnflag") == "R", "Made").otherwise("Missed").alias("shotResult"),
    )
    return B.shots(pbp, "l_orderkey", "l_linenumber", "l_partkey")


def zone_table(spark: SparkSession, d: str) -> DataFrame:
    return B.zone_table(_shot_rows(spark, d))


def foul_counts(spark: SparkSession, d: str) -> DataFrame:
    pbp = read(spark, d, "events").select(F.when(F.col("event_type") == "view", "Shot").otherwise("FOUL").alias("actionType"), F.when(F.col("event_type") == "error", "Technical").when(F.col("event_type") == "signup", "FLAGRANT type 1").otherwise("personal").alias("subType"), F.col("user_id").cast("string").alias("playerNameI"))
    return B.foul_counts(pbp)


def fouls_on_tabs(spark: SparkSession, d: str) -> DataFrame:
    """Tabs of users by event type with foul counts joined by label; TEAM rows have none."""
    events = read(spark, d, "events")
    people = events.groupBy(F.col("event_type").alias("teamTricode"), F.col("user_id").cast("string").alias("nameI")).agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("pts"))
    teams = events.groupBy(F.col("event_type").alias("teamTricode")).agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("pts"))
    return B.with_fouls(B.team_tabs(people, teams, [("pts", "PTS", "f1")]), foul_counts(spark, d))


def share_of_team(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return B.share_of_team(rows, rows.groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("s_acctbal")), "s_nationkey", ["s_acctbal"], "s_suppkey", "s_nationkey")


def games_of_rows(spark: SparkSession, d: str) -> DataFrame:
    """Two finder rows an order; every seventh order lacks its home row."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("GAME_ID"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("GAME_DATE"), "o_orderstatus", "o_custkey")
    a, h = F.concat(F.lit("T"), (F.col("o_custkey") % 30).cast("string")), F.concat(F.lit("S"), (F.col("GAME_ID") % 30).cast("string"))
    away = o.select("GAME_ID", "GAME_DATE", F.concat(a, F.lit(" @ "), h).alias("MATCHUP"), a.alias("TEAM_ABBREVIATION"), (F.col("o_custkey") % 50 + 80).alias("PTS"))
    home = o.where("GAME_ID % 7 <> 0").select("GAME_ID", "GAME_DATE", F.concat(h, F.lit(" vs. "), a).alias("MATCHUP"), h.alias("TEAM_ABBREVIATION"), (F.col("GAME_ID") % 50 + 80).alias("PTS"))
    return B.games_of_rows(away.unionByName(home))


def dnp_list(spark: SparkSession, d: str) -> DataFrame:
    seen = read(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), F.lit("12:00").alias("minutes")).distinct()
    people = read(spark, d, "customer").join(seen, "c_custkey", "left").select(F.col("c_name").alias("nameI"), F.col("c_mktsegment").alias("teamTricode"), "minutes", F.when(F.col("c_acctbal") > 0, "DNP").alias("comment"))
    return B.did_not_play(people)


def ghost_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_partkey").alias("personId"), F.when(F.col("l_tax") == 0, "").otherwise("5:00").alias("minutes"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("ord"))
    return B.drop_ghosts(rows, "ord").select("personId", "ord.*")


def highlights(spark: SparkSession, d: str) -> DataFrame:
    return B.best_flags(four_factors(spark, d), {"efg_pct": "max", "tov_pct": "min"})


def player_totals(spark: SparkSession, d: str) -> DataFrame:
    """Headline rows: made of attempted, kilometres, share strings."""
    g = _shot_rows(spark, d).groupBy("l_partkey").agg(F.count_if("made").alias("made"), F.count("*").alias("att"), half_even(F.sum("shotDistance") / 10, 1).alias("Distance (mi)"))
    return B.add_kilometres(g.select("l_partkey", B.made_of(F.col("made"), F.col("att")).alias("fg"), "Distance (mi)")).withColumnsRenamed({"Distance (mi)": "mi", "Distance (km)": "km"})


def top_players(spark: SparkSession, d: str) -> DataFrame:
    spend = read(spark, d, "orders").groupBy("o_custkey").agg(half_even(F.sum("o_totalprice"), 2).alias("spend"))
    return spend.orderBy(F.desc("spend"), "o_custkey").limit(25)


def compare(spark: SparkSession, d: str) -> DataFrame:
    """The four customers with most orders beside their account rows (left lookup)."""
    top = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("gp")).orderBy(F.desc("gp"), "c_custkey").limit(4)
    return top.join(read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey", "left")


def semi_kept(spark: SparkSession, d: str) -> DataFrame:
    big = read(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


def anti_done(spark: SparkSession, d: str) -> DataFrame:
    done = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").join(done, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


def sources_union(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers as one list with a source flag."""
    c = read(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.lit(False).alias("sample"))
    return c.unionByName(read(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit(True).alias("sample")))


def held_flag(spark: SparkSession, d: str) -> DataFrame:
    """Composite-key membership: lineitems whose (part, supplier) pair was ever returned."""
    held = read(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_partkey", "l_suppkey", F.lit(True).alias("held")).distinct()
    return read(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().join(held, ["l_partkey", "l_suppkey"], "left").select("l_partkey", "l_suppkey", F.coalesce("held", F.lit(False)).alias("held"))


def season_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy(F.year("o_orderdate").alias("season")).agg(F.count("*").alias("games"), F.count_distinct("o_custkey").alias("teams"))


def pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    from quillstat.operators.timeline import count_pattern

    return count_pattern(read(spark, d, "documents"), "text", "(^|[^A-Za-z])the([^A-Za-z]|$)", "lang")


def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: 100 customers in the order of a seeded hash."""
    return read(spark, d, "customer").orderBy(F.md5(F.concat(F.lit("42:"), F.col("c_custkey").cast("string"))), "c_custkey").limit(100).select("c_custkey", "c_name")


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def profile_tables(spark: SparkSession, d: str) -> DataFrame:
    """Row count and emptiness of every table."""
    counts = None
    for t in _TABLES:
        one = read(spark, d, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows", (F.col("n_rows") == 0).alias("empty"))
        counts = one if counts is None else counts.unionAll(one)
    return counts


def markdown_rows(spark: SparkSession, d: str) -> DataFrame:
    from quillstat.sources.files import markdown_row

    return read(spark, d, "nation").select("n_nationkey", markdown_row(["n_nationkey", "n_name", "n_regionkey"]).alias("row"))


def split_rule(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy(F.when(F.col("user_id") % 5 == 0, "val").otherwise("train").alias("part")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("shots"))


QUERIES = {f.__name__: f for f in (box_score, minutes_parse, clock_elapsed, four_factors, scoring_sources, sources_long, sources_transposed, zone_table, foul_counts, fouls_on_tabs, share_of_team, games_of_rows, dnp_list, ghost_dedupe, highlights, player_totals, top_players, compare, semi_kept, anti_done, sources_union, held_flag, season_counts, pattern_counts, seeded_sample, profile_tables, markdown_rows, split_rule)}

_LINES = "SELECT l_returnflag AS teamTricode, CAST(sum(l_linenumber) AS DOUBLE) AS fgm, sum(l_quantity) AS fga, CAST(count(*) FILTER (WHERE l_discount > 0.05) AS DOUBLE) AS tpm, CAST(count(*) AS DOUBLE) AS fta, CAST(count(*) FILTER (WHERE l_tax > 0.05) AS DOUBLE) AS tov FROM lineitem GROUP BY 1"
_FACTORS = f"SELECT teamTricode, round_even(100.0 * (fgm + 0.5 * tpm) / nullif(fga, 0), 1) AS efg_pct, round_even(100.0 * tov / nullif(fga + 0.44 * fta + tov, 0), 1) AS tov_pct, round_even(fta / nullif(fga, 0), 2) AS ft_rate FROM ({_LINES})"
_SRC = """SELECT l_returnflag AS teamTricode, count(*) FILTER (WHERE l_quantity BETWEEN 1 AND 10) AS pointsPaint, count(*) FILTER (WHERE l_quantity BETWEEN 11 AND 20) AS pointsFastBreak,
 count(*) FILTER (WHERE l_quantity BETWEEN 21 AND 30) AS pointsSecondChance, count(*) FILTER (WHERE l_quantity BETWEEN 31 AND 40) AS pointsOffTurnovers,
 nullif(count(*) FILTER (WHERE l_linestatus = 'O'), 0) AS bench FROM lineitem GROUP BY 1"""
_SHOTS = """SELECT l_partkey, l_returnflag = 'R' AS made, l_quantity / 4 AS dist, CASE WHEN l_discount >= 0.09 THEN 'Three-pointers' WHEN l_quantity / 4 BETWEEN 0 AND 4 THEN 'At the rim (0-4 ft)'
 WHEN l_quantity / 4 BETWEEN 5 AND 9 THEN 'Paint / short (5-9 ft)' ELSE 'Mid-range (10 ft to the arc)' END AS zone FROM lineitem"""
_FOULS = "SELECT CAST(user_id AS VARCHAR) AS player, count(*) FILTER (WHERE event_type = 'error') AS technical, count(*) FILTER (WHERE event_type = 'signup') AS flagrant FROM events WHERE event_type <> 'view' GROUP BY 1"
SQL = {
    "box_score": """
WITH o AS (SELECT o_custkey, count(*) AS gp, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS pts FROM orders GROUP BY 1),
p AS (SELECT n_name AS team, c_name AS player, gp, pts FROM customer JOIN o ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT team, 0 AS row_kind, player AS "PLAYER", gp AS "GP", round_even(CAST(pts AS DOUBLE), 1) AS "PTS" FROM p
UNION ALL SELECT team, 1, 'TEAM', CAST(sum(gp) AS BIGINT), round_even(CAST(sum(pts) AS DOUBLE), 1) FROM p GROUP BY team""",
    "minutes_parse": "SELECT event_id, round_even(CASE WHEN event_id % 4 < 2 THEN minute(ts) + second(ts) / 60.0 WHEN event_id % 4 = 2 THEN minute(ts) END, 3) AS minutes FROM events",
    "clock_elapsed": """
SELECT event_id, CAST(m * 60 + s AS DOUBLE) AS seconds_left,
 round_even(least(p - 1, 4) * 12.0 + greatest(p - 5, 0) * 5.0 + CASE WHEN p <= 4 THEN 12.0 ELSE 5.0 END - (m * 60 + s) / 60.0, 3) AS elapsed,
 printf('%02d:%02d', m, s) AS shown, printf('%d:%04.1f', CAST(floor(v / 60) AS BIGINT), round_even(v - floor(v / 60) * 60, 1)) AS clip
FROM (SELECT event_id, round_even(value, 1) AS v, minute(ts) % 5 AS m, second(ts) AS s, event_id % 6 + 1 AS p FROM events)""",
    "four_factors": _FACTORS,
    "scoring_sources": _SRC,
    "sources_long": f"SELECT teamTricode, source, points FROM ({_SRC}) UNPIVOT INCLUDE NULLS (points FOR source IN (pointsPaint, pointsFastBreak, pointsSecondChance, pointsOffTurnovers, bench))",
    "sources_transposed": f"SELECT source, max(points) FILTER (WHERE teamTricode = 'A') AS A, max(points) FILTER (WHERE teamTricode = 'N') AS N, max(points) FILTER (WHERE teamTricode = 'R') AS R FROM ({_SRC}) UNPIVOT INCLUDE NULLS (points FOR source IN (pointsPaint, pointsFastBreak, pointsSecondChance, pointsOffTurnovers, bench)) GROUP BY source",
    "zone_table": f"""
WITH s AS ({_SHOTS}), z(ord, zone) AS (VALUES (0, 'At the rim (0-4 ft)'), (1, 'Paint / short (5-9 ft)'), (2, 'Mid-range (10 ft to the arc)'), (3, 'Three-pointers'))
SELECT ord, z.zone, count(*) FILTER (WHERE made) AS made, count(s.zone) AS attempted, round_even(100.0 * count(*) FILTER (WHERE made) / nullif(count(s.zone), 0), 1) AS fg_pct FROM z LEFT JOIN s ON z.zone = s.zone GROUP BY 1, 2""",
    "foul_counts": _FOULS,
    "fouls_on_tabs": f"""
WITH f AS ({_FOULS})
SELECT event_type AS team, 0 AS row_kind, CAST(user_id AS VARCHAR) AS "PLAYER", round_even(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 1) AS "PTS", CAST(max(technical) AS DOUBLE) AS technical, CAST(max(flagrant) AS DOUBLE) AS flagrant
FROM events LEFT JOIN f ON CAST(user_id AS VARCHAR) = f.player GROUP BY event_type, user_id
UNION ALL SELECT event_type, 1, 'TEAM', round_even(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 1), NULL, NULL FROM events GROUP BY event_type""",
    "share_of_team": "SELECT s_suppkey, s_nationkey, round_even(100.0 * s_acctbal / nullif(sum(s_acctbal) OVER (PARTITION BY s_nationkey), 0), 1) AS s_acctbal FROM supplier",
    "games_of_rows": """
SELECT o_orderkey AS game_id, strftime(o_orderdate, '%Y-%m-%d') AS date, 'T' || (o_custkey % 30) AS away, 'S' || (o_orderkey % 30) AS home, o_custkey % 50 + 80 AS away_pts, o_orderkey % 50 + 80 AS home_pts,
 strftime(o_orderdate, '%Y-%m-%d') || '  T' || (o_custkey % 30) || ' ' || (o_custkey % 50 + 80) || ' @ S' || (o_orderkey % 30) || ' ' || (o_orderkey % 50 + 80) AS label FROM orders WHERE o_orderkey % 7 <> 0""",
    "dnp_list": "SELECT c_name AS \"PLAYER\", c_mktsegment AS \"TEAM\", CASE WHEN c_acctbal > 0 THEN 'DNP' ELSE '' END AS \"REASON\" FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "ghost_dedupe": "SELECT l_partkey AS \"personId\", l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem WHERE l_tax <> 0 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) = 1",
    "highlights": f"WITH f AS ({_FACTORS}) SELECT *, (SELECT min(efg_pct) <> max(efg_pct) AND count(efg_pct) = count(*) FROM f) AND efg_pct = (SELECT max(efg_pct) FROM f) AS best_efg_pct, (SELECT min(tov_pct) <> max(tov_pct) AND count(tov_pct) = count(*) FROM f) AND tov_pct = (SELECT min(tov_pct) FROM f) AS best_tov_pct FROM f",
    "player_totals": f"SELECT l_partkey, fg, mi, round_even(mi * 1.609344, 1) AS km FROM (SELECT l_partkey, (count(*) FILTER (WHERE made)) || '/' || count(*) AS fg, round_even(sum(dist) / 10, 1) AS mi FROM ({_SHOTS}) GROUP BY 1)",
    "top_players": "SELECT o_custkey, round_even(sum(o_totalprice), 2) AS spend FROM orders GROUP BY 1 ORDER BY spend DESC, o_custkey LIMIT 25",
    "compare": "SELECT t.c_custkey, gp, c_name, c_acctbal FROM (SELECT o_custkey AS c_custkey, count(*) AS gp FROM orders GROUP BY 1 ORDER BY gp DESC, 1 LIMIT 4) t LEFT JOIN customer c ON t.c_custkey = c.c_custkey",
    "semi_kept": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "anti_done": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "sources_union": "SELECT c_name AS name, c_nationkey AS nation, false AS sample FROM customer UNION ALL SELECT s_name, s_nationkey, true FROM supplier",
    "held_flag": "SELECT l_partkey, l_suppkey, bool_or(l_returnflag = 'R') AS held FROM lineitem GROUP BY 1, 2",
    "season_counts": "SELECT CAST(year(o_orderdate) AS INT) AS season, count(*) AS games, count(DISTINCT o_custkey) AS teams FROM orders GROUP BY 1",
    "pattern_counts": "SELECT lang, count(*) AS n FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z])the([^A-Za-z]|$)') GROUP BY 1",
    "seeded_sample": "SELECT c_custkey, c_name FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 100",
    "profile_tables": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, count(*) = 0 AS empty FROM {t}" for t in _TABLES),
    "markdown_rows": "SELECT n_nationkey, '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' AS row FROM nation",
    "split_rule": "SELECT CASE WHEN user_id % 5 = 0 THEN 'val' ELSE 'train' END AS part, count(*) AS n, count(DISTINCT user_id) AS shots FROM events GROUP BY 1",
}
