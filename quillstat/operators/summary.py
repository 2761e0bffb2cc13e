"""What the pages and the summary document show: team totals of a clip, data quality, tracking tables, reports."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstat.functions.params import FPS, MILE_KM
from quillstat.functions.scalar import half_even, json_text, minutes, number, shown_int
from quillstat.operators.boxscore import clip_time, drop_empty_columns, made_of
from quillstat.operators.clip import coverage


def _side_by_side(*rows: DataFrame) -> DataFrame:
    """Tables of one row each as one row."""
    return reduce(lambda a, b: a.join(b, "_one"), [r.withColumn("_one", F.lit(1)) for r in rows]).drop("_one")


def team_stats(events: DataFrame, players: DataFrame, share: DataFrame, teams: Mapping[str, str]) -> DataFrame:
    """(team, kit, passes, interceptions, possession_pct, players_tracked_seconds, distance_m), one row for each kit of `teams`.

    events: (type, team); players: (team, seconds_tracked, distance_m); share: one row with a column for each kit.
    """
    kits = events.sparkSession.createDataFrame(list(teams.items()), "kit string, team string")
    counts = events.groupBy(F.col("team").alias("kit")).agg(F.count_if(F.col("type") == "pass").alias("passes"), F.count_if(F.col("type") == "interception").alias("interceptions"))
    tracked = players.groupBy(F.col("team").alias("kit")).agg(F.sum("seconds_tracked").alias("seconds"), F.sum("distance_m").alias("metres"))
    held = share.unpivot([], list(teams), "kit", "held")
    every = F.broadcast(kits).join(counts, "kit", "left").join(tracked, "kit", "left").join(held, "kit", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    # In decimals: 100 times a double's share can lie beside the tie that the share is (23 of 80).
    held_pct = F.bround(F.col("held").cast("decimal(22,20)") * 100, 1).cast("double")
    return every.select("team", "kit", zero("passes").alias("passes"), zero("interceptions").alias("interceptions"), held_pct.alias("possession_pct"), half_even(F.coalesce("seconds", F.lit(0.0)), 1).alias("players_tracked_seconds"), half_even(F.coalesce("metres", F.lit(0.0)), 0).alias("distance_m"))


def quality(frames: DataFrame, people: DataFrame, kept: DataFrame, many: int = 8) -> DataFrame:
    """One row. frames: (frame, mapped, score, inliers); people: (shot, track_id); kept: (frame, pid, team), those in chains."""
    on = lambda c: F.median(F.when(F.col("mapped"), F.col(c)))
    whole = frames.agg(F.count("*").alias("analysed_frames"), F.count_if("mapped").alias("mapped_frames"), half_even(on("score"), 2).alias("alignment_score_median"), F.floor(on("inliers")).cast("long").alias("feature_matches_median"))
    filled = coverage(frames.where("mapped"), kept.where("team IN ('light', 'dark')"), ["frame"], many).select(F.col("median_rows").alias("players_per_frame_median"), F.col("share_full").alias("share_with_many_players"))
    tracks = people.select("shot", "track_id").distinct().agg(F.count("*").alias("raw_tracks"))
    return _side_by_side(whole, filled, tracks, kept.agg(F.count_distinct("pid").alias("chains_kept")))


def clip_totals(shots: DataFrame, frames: DataFrame, ball: DataFrame, holders: DataFrame, states: DataFrame, possession: DataFrame) -> DataFrame:
    """One row. shots: (frames, usable); frames: (mapped); ball: (interpolated); holders, states: counted; possession: (team)."""
    seconds = lambda c: half_even(F.coalesce(F.sum(c), F.lit(0)) / FPS, 1)
    clip = shots.agg(seconds(F.col("frames")).alias("clip_seconds"), F.count_if("usable").alias("usable_shots"), seconds(F.when(F.col("usable"), F.col("frames"))).alias("analysed_seconds"))
    mapped = frames.agg(F.count("*").alias("_all"), F.count_if("mapped").alias("_mapped"))
    found = ball.agg(F.count("*").alias("ball_frames_selected"), F.count_if(~F.col("interpolated")).alias("ball_frames_detected"))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    row = _side_by_side(clip, mapped, found, n(holders, "holder_frames"), n(states, "holding_states"), n(possession.where("team IN ('light', 'dark')"), "frames_with_known_possession"))
    share = lambda a, b: half_even(F.col(a) / F.greatest(F.col(b), F.lit(1)), 3)
    return row.withColumns({"mapped_share": share("_mapped", "_all"), "ball_share": share("ball_frames_selected", "_mapped")}).drop("_all", "_mapped")


def summary_document(totals: DataFrame, stats: DataFrame, panel: DataFrame) -> DataFrame:
    """(json): the totals with `team_stats` by team and `quality` nested in them; nulls stay, no number has an exponent that its size does not need."""
    fields = [c for c in stats.columns if c != "team"]
    teams = stats.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("team", F.struct(*fields))))).alias("team_stats"))
    whole = _side_by_side(totals, teams, panel.select(F.struct("*").alias("quality")))
    return whole.select(json_text(F.struct("*"), whole.schema).alias("json"))


def quality_panel(totals: DataFrame, ball_source: str | None = None) -> DataFrame:
    """(nth, item, value): what share of a clip was analysed, as text; with the table that the ball comes from, if it is given."""
    per_cent = lambda c: F.format_string("%.0f%%", half_even(c * 100, 0))
    whole = lambda c: F.format_string("%.0f", half_even(F.col(c).cast("double"), 0))
    analysed = F.concat(F.col("usable_shots").cast("string"), F.lit(" shots, "), whole("analysed_seconds"), F.lit(" s ("), per_cent(F.try_divide("analysed_seconds", "clip_seconds")), F.lit(")"))
    # The panel's labels.
    items = {
        "Clip length": F.concat(whole("clip_seconds"), F.lit(" s")), "Shots showing the court (analysed)": analysed, "Frames mapped to the court": F.concat(per_cent(F.col("mapped_share")), F.lit(" of analysed frames")),
        "Ball found (detected or briefly interpolated)": F.concat(per_cent(F.col("ball_share")), F.lit(" of mapped frames")), "Frames with a known ball holder": F.col("holder_frames").cast("string"),
    }
    if ball_source is not None:
        items["Ball model"] = F.lit(ball_source)
    rows = F.array(*[F.struct(F.lit(k).alias("nth"), F.lit(item).alias("item"), value.alias("value")) for k, (item, value) in enumerate(items.items())])
    return totals.select(F.inline(rows))


def event_list(events: DataFrame, names: Mapping[str, str], key: str = "shot") -> DataFrame:
    """(key, nth, clip time, type, team, distance (m), ball in flight (s)): a clip's passes and interceptions in order, teams by name."""
    name = F.element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), F.col("team"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("frame", "type", "from_pid", "to_pid"))
    return events.select(key, nth.alias("nth"), clip_time(F.col("frame") / FPS).alias("clip time"), "type", name.alias("team"), F.col("dist_m").alias("distance (m)"), F.col("gap_s").alias("ball in flight (s)"))


def clip_players(players: DataFrame, names: Mapping[str, str], team: str | None = None) -> DataFrame:
    """Chains with their team's name, longest tracked first; nth is the place. Only one team's where it is named."""
    name = F.element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), F.col("team"))
    shown = players.withColumn("team_name", name)
    shown = shown if team is None else shown.where(F.col("team_name") == team)
    nth = F.row_number().over(Window.partitionBy("shot").orderBy(F.desc("seconds_tracked"), "pid"))
    return shown.select("shot", nth.alias("nth"), "pid", "team_name", "seconds_tracked", "distance_m", "avg_speed_kmh", "top_speed_kmh")


def roster(players: DataFrame) -> DataFrame:
    """(team, nth, PLAYER, mins) of those who played, most minutes first: nth numbers a team's players."""
    rows = players.select(F.col("teamTricode").alias("team"), F.col("nameI").alias("PLAYER"), half_even(minutes(F.col("minutes")), 4).alias("mins")).where("mins > 0")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("team").orderBy(F.desc("mins"), "PLAYER")))


def player_headline(players: DataFrame, advanced: DataFrame | None = None) -> DataFrame:
    """One row a player with minutes, as text where it is shown so: minutes, points, rebounds, assists, steals and blocks, plus/minus, made of attempted, turnovers; with `advanced` true shooting and usage, null for a player it lacks."""
    mins, whole = half_even(minutes(F.col("minutes")), 0), lambda c: shown_int(F.col(c))
    pair = lambda a, b, sep: F.concat(whole(a).cast("string"), F.lit(sep), whole(b).cast("string"))
    on = players.where(F.coalesce(minutes(F.col("minutes")), F.lit(0.0)) > 0)
    shown = on.select(
        "personId", F.col("nameI").alias("PLAYER"), F.col("teamTricode").alias("team"), F.format_string("%.0f", mins).alias("Minutes"), whole("points").alias("Points"), whole("reboundsTotal").alias("Rebounds"), whole("assists").alias("Assists"),
        pair("steals", "blocks", " / ").alias("Steals / blocks"), F.format_string("%+.0f", half_even(number(F.col("plusMinusPoints")), 0)).alias("+/-"), pair("fieldGoalsMade", "fieldGoalsAttempted", "/").alias("FG"), pair("threePointersMade", "threePointersAttempted", "/").alias("3P"), pair("freeThrowsMade", "freeThrowsAttempted", "/").alias("FT"), whole("turnovers").alias("Turnovers"),
    )
    if advanced is None:
        return shown
    rate = lambda c: half_even(number(F.col(c)) * 100, 1)
    rates = advanced.groupBy("personId").agg(F.min(F.struct(rate("trueShootingPercentage").alias("ts"), rate("usagePercentage").alias("usg"))).alias("_r"))
    return shown.join(rates, "personId", "left").withColumns({"True shooting %": F.format_string("%.1f", F.col("_r.ts")), "Usage %": F.format_string("%.1f", F.col("_r.usg"))}).withColumns({c: F.when(F.col("_r").isNotNull(), F.col(c)) for c in ("True shooting %", "Usage %")}).drop("_r")


def season_label(season: Column) -> Column:
    """`2021-22` as `2022 playoffs (2021-22 season)`."""
    return F.concat((F.substring(season, 1, 4).try_cast("int") + 1).cast("string"), F.lit(" playoffs ("), season, F.lit(" season)"))


def distance_table(track: DataFrame, least: float = 5.0) -> DataFrame:
    """Of players with minutes: kilometres, km/h, and kilometres a minute for those with `least` minutes."""
    mins = minutes(F.col("minutes"))
    rows = track.select("nameI", "teamTricode", mins.alias("mins"), (number(F.col("distance")) * MILE_KM).alias("km"), (number(F.col("speed")) * MILE_KM).alias("kmh")).where("mins > 0")
    return rows.select(F.col("nameI").alias("PLAYER"), F.col("teamTricode").alias("team"), half_even(F.col("mins"), 2).alias("mins"), half_even(F.col("km"), 3).alias("km"), half_even(F.col("kmh"), 3).alias("kmh"), half_even(F.when(F.col("mins") >= least, F.col("km") / F.col("mins")), 4).alias("km_per_minute"))


def contest_table(track: DataFrame) -> DataFrame:
    """Rebound chances and contested, uncontested and rim shots (made/attempted) of players with minutes."""
    pair = lambda a, label: made_of(F.col(f"{a}FieldGoalsMade"), F.col(f"{a}FieldGoalsAttempted")).alias(label)
    on = track.where(F.coalesce(minutes(F.col("minutes")), F.lit(0.0)) > 0)
    return on.select(F.col("nameI").alias("PLAYER"), F.col("teamTricode").alias("team"), half_even(minutes(F.col("minutes")), 0).alias("mins"), number(F.col("reboundChancesOffensive")).cast("long").alias("oreb_chances"), number(F.col("reboundChancesDefensive")).cast("long").alias("dreb_chances"), pair("contested", "contested"), pair("uncontested", "uncontested"), pair("defendedAtRim", "rim"))


def tracking_totals(teams: DataFrame) -> DataFrame:
    """Team totals of the tracking table; columns that no team has are left out."""
    km = lambda c, digits: half_even(number(F.col(c)) * MILE_KM, digits)
    whole = lambda c: number(F.col(c)).cast("long")
    return drop_empty_columns(teams.select(F.col("teamTricode").alias("team"), km("distance", 1).alias("km"), km("speed", 2).alias("kmh"), whole("touches").alias("touches"), whole("passes").alias("passes"), whole("reboundChancesTotal").alias("rebound_chances")))


def spread(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, n, mean, least, p10, p50, p90, most) of a column."""
    c = F.col(column)
    return df.groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.min(c).alias("least"), *[F.percentile(c, F.lit(p / 100)).alias(f"p{p}") for p in (10, 50, 90)], F.max(c).alias("most"))


def short_track_share(people: DataFrame, least: int) -> DataFrame:
    """(shot, share): the share of a shot's rows that belong to tracks of under `least` rows."""
    tracks = people.groupBy("shot", "track_id").agg(F.count("*").alias("n"))
    return tracks.groupBy("shot").agg((F.coalesce(F.sum(F.when(F.col("n") < least, F.col("n"))), F.lit(0)) / F.sum("n")).alias("share"))


def game_report(games: DataFrame, tables: Mapping[str, DataFrame], players: DataFrame) -> DataFrame:
    """(game_id, n_empty, empty, n_dnp): the tables, each with a game_id, that have no row of a game, and its players without minutes."""
    out = games.select("game_id")
    for name, t in tables.items():
        out = out.join(t.groupBy("game_id").agg(F.count("*").alias(f"_{name}")), "game_id", "left")
    absent = F.array_compact(F.array(*[F.when(F.col(f"_{name}").isNull(), F.lit(name)) for name in tables]))
    out = out.select("game_id", F.size(absent).alias("n_empty"), F.array_join(absent, ",").alias("empty"))
    dnp = players.where(~(F.coalesce(minutes(F.col("minutes")), F.lit(0.0)) > 0)).groupBy("game_id").agg(F.count("*").alias("n_dnp"))
    return out.join(dnp, "game_id", "left").fillna(0, ["n_dnp"])
