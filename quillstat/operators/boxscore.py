"""Stat tables of a game: column specifications, team tabs, ratios, shot zones, game lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstat.functions.params import ADV, ADVANCED, BOX, HUSTLE, MILE_KM, MISC, SHOOT, SUMMARY, THREES, TRACK, ZONES
from quillstat.functions.scalar import half_even, minutes, number, pct, shown_1dp, shown_int, shown_pct


#: The tabs of a game: name, endpoint, suffix of its team table, specification.
TABS = [("Box score", "traditional", 2, BOX), ("Shooting", "traditional", 2, SHOOT), ("Advanced", "advanced", 1, ADV), ("Miscellaneous", "misc", 1, MISC), ("Hustle", "hustle", 1, HUSTLE), ("Player tracking", "player_track", 1, TRACK)]


def conform(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly these columns (name -> type): cast where present, null where absent."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def shown(raw: str, kind: str) -> Column:
    c = F.col(f"`{raw}`")
    return {"min": lambda: half_even(minutes(c), 1), "pct": lambda: shown_pct(c), "f1": lambda: shown_1dp(c), "int": lambda: shown_int(c)}[kind]()


def frame(df: DataFrame, spec: list[tuple[str, str, str]], *keep: str) -> DataFrame:
    """One select: the kept columns, then each specified column that is present, converted and relabelled."""
    have = set(df.columns)
    return df.select(*keep, *[shown(raw, kind).alias(label) for raw, label, kind in spec if raw in have])


def team_tabs(players: DataFrame, teams: DataFrame, spec: list[tuple[str, str, str]], name: str = "nameI", team: str = "teamTricode", played: str = "minutes") -> DataFrame:
    """Players with minutes, then a TEAM row taken from the team table: (team, row_kind 0 or 1, PLAYER, columns); `ordered` ranks them."""
    on = players.where(F.coalesce(minutes(F.col(played)), F.lit(0.0)) > 0) if played in players.columns else players
    keep = (F.col(team).alias("team"),)
    people = frame(on, spec, *keep, F.lit(0).alias("row_kind"), F.col(name).alias("PLAYER"))
    total = frame(teams, spec, *keep, F.lit(1).alias("row_kind"), F.lit("TEAM").alias("PLAYER"))
    return people.unionByName(total, allowMissingColumns=True)


def with_fouls(tabs: DataFrame, fouls: DataFrame, *game: str) -> DataFrame:
    """Adds technical and flagrant counts by player label (of a game, where both are keyed by it); players without any foul, and TEAM rows, get null."""
    count = lambda c: F.when(F.col("row_kind") == 0, F.col(c).cast("double"))
    named = fouls.select(F.col("player").alias("_p"), *[F.col(g).alias(f"_{g}") for g in game], "technical", "flagrant")
    same = reduce(lambda a, g: a & (F.col(g) == F.col(f"_{g}")), game, F.col("PLAYER") == F.col("_p"))
    return tabs.join(named, same, "left").withColumns({"technical": count("technical"), "flagrant": count("flagrant")}).drop("_p", *[f"_{g}" for g in game])


def foul_counts(pbp: DataFrame, *game: str) -> DataFrame:
    """(game, player, technical, flagrant): fouls whose sub-type names them, in any case."""
    kind = F.lower("subType")
    return pbp.where((F.lower("actionType") == "foul") & F.col("playerNameI").isNotNull()).groupBy(*game, F.col("playerNameI").alias("player")).agg(F.count_if(kind.contains("technical")).alias("technical"), F.count_if(kind.contains("flagrant")).alias("flagrant"))


def did_not_play(players: DataFrame) -> DataFrame:
    return players.where(F.coalesce(minutes(F.col("minutes")), F.lit(0.0)) <= 0).select(F.col("nameI").alias("PLAYER"), F.col("teamTricode").alias("TEAM"), F.coalesce("comment", F.lit("")).alias("REASON"))


def first_per_key(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def drop_ghosts(players: DataFrame, order: str) -> DataFrame:
    """Rows without minutes go, then the first row of each person stays."""
    return first_per_key(players.where(F.trim(F.coalesce("minutes", F.lit(""))) != ""), ["personId"], order)


def ordered(tabs: DataFrame, *game: str) -> DataFrame:
    """nth: a row's place in its team's tab (of a game), from 1: players by MIN (most first, then by name), the TEAM row last."""
    return tabs.withColumn("nth", F.row_number().over(Window.partitionBy(*game, "team").orderBy("row_kind", F.desc_nulls_last("MIN"), "PLAYER")))


def stat_tab(players: DataFrame, teams: DataFrame, spec: list[tuple[str, str, str]], fouls: DataFrame | None = None) -> DataFrame:
    """One tab of all teams: (team, row_kind, PLAYER, POS, MIN, columns, nth). MIN is shown in every tab; a position that is missing is empty; teams without players get no TEAM row. Where all tables have game_id, a tab is a game's, and its rows have it first."""
    game = ["game_id"] if all("game_id" in t.columns for t in (players, teams) if t is not None) and (fouls is None or "game_id" in fouls.columns) else []
    spec = spec if any(raw == "minutes" for raw, _, _ in spec) else [("minutes", "MIN", "min"), *spec]
    position = F.coalesce(F.col("position"), F.lit("")) if "position" in players.columns else F.lit("")
    on = players.where(F.coalesce(half_even(minutes(F.col("minutes")), 1), F.lit(0.0)) > 0)
    people = frame(on, spec, *game, F.col("teamTricode").alias("team"), F.lit(0).alias("row_kind"), F.col("nameI").alias("PLAYER"), position.alias("POS"))
    there = teams.join(players.select(*game, "teamTricode").distinct(), [*game, "teamTricode"], "left_semi")
    total = frame(there, spec, *game, F.col("teamTricode").alias("team"), F.lit(1).alias("row_kind"), F.lit("TEAM").alias("PLAYER"), F.lit("").alias("POS"))
    tab = people.unionByName(total, allowMissingColumns=True)
    return ordered(tab if fouls is None else with_fouls(tab, fouls, *game), *game)


def build_tabs(tables: dict[tuple[str, int], DataFrame]) -> dict[str, DataFrame]:
    """The six tabs of a bundle, of one game or of many (keyed by game_id), by name; one whose player table is missing has no rows. The tracking tab shows kilometres beside miles."""
    tabs = {}
    for name, endpoint, team_table, spec in TABS:
        players, teams = tables.get((endpoint, 0)), tables.get((endpoint, team_table))
        if players is None:
            some = next(iter(tables.values()), None)
            if some is not None:
                tabs[name] = some.where("false").select(F.lit("").alias("team"), F.lit(0).alias("row_kind"), F.lit("").alias("PLAYER"), F.lit("").alias("POS"), F.lit(0.0).alias("MIN"), F.lit(0).alias("nth"))
            continue
        teams = players.where("false") if teams is None else teams
        pbp = tables.get(("playbyplay", 0)) if spec is MISC else None
        keyed = ["game_id"] if pbp is not None and "game_id" in pbp.columns else []
        tab = stat_tab(players, teams, spec, foul_counts(pbp, *keyed) if pbp is not None and "actionType" in pbp.columns else None)
        tabs[name] = add_kilometres(add_kilometres(tab), "Avg speed (mph)", "Avg speed (km/h)") if spec is TRACK else tab
    return tabs


def four_factors(team: DataFrame, *keep: str, advanced: DataFrame | None = None) -> DataFrame:
    """Shooting, turnover and free-throw ratios of each row; zero denominators give null. `advanced` adds rebounding, ratings and pace by teamTricode, null for a team it lacks."""
    if advanced is not None:
        advanced = conform(advanced, {"teamTricode": "string"} | {c: "string" for c in ADVANCED})  # columns that are absent give null
        rates = first_per_key(advanced, ["teamTricode"], *[c for c in ADVANCED]).select(F.col("teamTricode").alias("_team"), *[half_even(number(F.col(raw)) * (100 if kind == "pct" else 1), 1).alias(label) for raw, (label, kind) in ADVANCED.items()])
        joined = team.join(rates, team["teamTricode"] == rates["_team"], "left")
        return four_factors(joined, *keep, *[label for label, _ in ADVANCED.values()])
    fgm, fga, tpm, fta, tov = (F.col(c).cast("double") for c in ("fieldGoalsMade", "fieldGoalsAttempted", "threePointersMade", "freeThrowsAttempted", "turnovers"))
    return team.select(*keep, half_even(pct(fgm + 0.5 * tpm, fga), 1).alias("efg_pct"), half_even(pct(tov, fga + 0.44 * fta + tov), 1).alias("tov_pct"), half_even(F.try_divide(fta, fga), 2).alias("ft_rate"))


def scoring_sources(misc: DataFrame, split: DataFrame) -> DataFrame:
    """Points by source of each team, with its bench points (null without a bench row)."""
    bench = first_per_key(split.where(F.col("startersBench") == "Bench"), ["teamTricode"], "points").select("teamTricode", F.col("points").alias("bench"))
    return misc.select("teamTricode", "pointsPaint", "pointsFastBreak", "pointsSecondChance", "pointsOffTurnovers").join(bench, "teamTricode", "left")


def long_form(df: DataFrame, keys: list[str], values: list[str], variable: str = "source", value: str = "points") -> DataFrame:
    return df.unpivot(keys, values, variable, value)


def share_of_team(players: DataFrame, teams: DataFrame, key: str, columns: list[str], *keep: str) -> DataFrame:
    """Each row's per cent of its team's total; null where the total is zero."""
    totals = teams.select(key, *[F.col(c).cast("double").alias(f"_t_{c}") for c in columns])
    return players.join(totals, key).select(*keep, *[half_even(pct(F.col(c).cast("double"), F.col(f"_t_{c}")), 1).alias(c) for c in columns])


def zone(distance: Column, value: Column) -> Column:
    """Threes first, then the distance ranges; what fits none is mid-range."""
    picked = F.when(value == 3, F.lit(THREES))
    return reduce(lambda acc, z: acc.when(distance.between(z[1], z[2]), F.lit(z[0])), ZONES, picked).otherwise(F.lit(ZONES[-1][0]))


def shots(pbp: DataFrame, *keep: str) -> DataFrame:
    return pbp.where("isFieldGoal = 1").select(*keep, "shotDistance", "shotValue", (F.lower("shotResult") == "made").alias("made"), (F.col("shotValue") == 3).alias("is3"), zone(F.col("shotDistance"), F.col("shotValue")).alias("zone"))


def zone_table(shot_rows: DataFrame) -> DataFrame:
    """Every zone in order, with makes, attempts and FG%; zones without attempts show zero and null."""
    spark = shot_rows.sparkSession
    zones = spark.createDataFrame([(k, z) for k, z in enumerate([z[0] for z in ZONES] + [THREES])], "ord int, zone string")
    counts = shot_rows.groupBy("zone").agg(F.count_if("made").alias("made"), F.count("*").alias("attempted"))
    joined = F.broadcast(zones).join(counts, "zone", "left").select("ord", "zone", F.coalesce("made", F.lit(0)).alias("made"), F.coalesce("attempted", F.lit(0)).alias("attempted"))
    return joined.withColumn("fg_pct", half_even(pct(F.col("made"), F.col("attempted")), 1))


def games_of_rows(raw: DataFrame) -> DataFrame:
    """Two rows a game (`A @ B`, `B vs. A`) to one; games without exactly one of each are left out."""
    away, home = F.col("MATCHUP").contains("@"), F.col("MATCHUP").rlike("vs.")
    pick = lambda side, c: F.max(F.when(side, F.col(c)))
    games = raw.groupBy(F.col("GAME_ID").alias("game_id")).agg(F.count_if(away).alias("n_away"), F.count_if(home).alias("n_home"), F.max("GAME_DATE").alias("date"), pick(away, "TEAM_ABBREVIATION").alias("away"), pick(home, "TEAM_ABBREVIATION").alias("home"), pick(away, "PTS").alias("away_pts"), pick(home, "PTS").alias("home_pts"))
    label = F.concat("date", F.lit("  "), "away", F.lit(" "), F.col("away_pts").cast("string"), F.lit(" @ "), "home", F.lit(" "), F.col("home_pts").cast("string"))
    return games.where("n_away = 1 AND n_home = 1").select("game_id", "date", "away", "home", "away_pts", "home_pts", label.alias("label"))


def team_summary(summary: DataFrame) -> DataFrame:
    return summary.select(*[F.col(raw).alias(label) for raw, label in SUMMARY if raw in summary.columns])


def game_info(arena: DataFrame, crowd: DataFrame) -> DataFrame:
    """One row a game_id: the arena's label and the attendance, null unless it is all digits; of several rows of a game the least counts."""
    where = arena.groupBy("game_id").agg(F.min(F.concat("arenaName", F.lit(", "), "arenaCity")).alias("arena"))
    seats = F.col("attendance").cast("string")
    many = crowd.groupBy("game_id").agg(F.min(F.when(seats.rlike("^[0-9]+$"), seats.try_cast("bigint"))).alias("attendance"))
    return where.join(many, "game_id", "full")


def add_kilometres(df: DataFrame, after: str = "Distance (mi)", label: str = "Distance (km)") -> DataFrame:
    """Kilometres from the shown miles, right behind them."""
    out = []
    for c in df.columns:
        out.append(F.col(f"`{c}`"))
        if c == after:
            out.append(half_even(F.col(f"`{c}`") * MILE_KM, 1).alias(label))
    return df.select(*out)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Columns without any value go (one aggregate, then a select)."""
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if filled[c]])


def best_flags(df: DataFrame, columns: dict[str, str], *partition: str) -> DataFrame:
    """best_<c>: whether the row has the best value (`max` or `min`) of its partition; never where a value is null or all are equal. One aggregate, joined back."""
    stats = [a for k, c in enumerate(columns) for a in (F.min(c).alias(f"_lo{k}"), F.max(c).alias(f"_hi{k}"), (F.count(c) == F.count("*")).alias(f"_full{k}"))]
    bounds = df.groupBy(*[F.col(p).alias(f"_p{k}") for k, p in enumerate(partition)]).agg(*stats)
    same = reduce(lambda a, kp: a & F.col(kp[1]).eqNullSafe(F.col(f"_p{kp[0]}")), enumerate(partition), F.lit(True))
    joined = df.join(bounds if partition else F.broadcast(bounds), same)  # without a partition, bounds are one row
    best = lambda k, c, kind: F.col(f"_full{k}") & (F.col(f"_lo{k}") != F.col(f"_hi{k}")) & (F.col(c) == F.col(f"_hi{k}" if kind == "max" else f"_lo{k}"))
    flags = {f"best_{c}": F.coalesce(best(k, c, kind), F.lit(False)) for k, (c, kind) in enumerate(columns.items())}
    return joined.withColumns(flags).select(*[F.col(f"`{c}`") for c in df.columns], *flags)


def shown_clock(clock: Column) -> Column:
    return F.regexp_replace(F.replace(F.replace(clock, F.lit("PT"), F.lit("")), F.lit("M"), F.lit(":")), r"\.\d+S", "")


def clip_time(seconds: Column) -> Column:
    """m:ss.s; the seconds are rounded half-even first."""
    s = half_even(seconds, 1)
    return F.format_string("%d:%04.1f", F.floor(s / 60), half_even(s - F.floor(s / 60) * 60, 1))


def shot_log(shot_rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, Q, Clock, Made, Dist (ft), Play): a player's shots as they are listed. shot_rows: `shots` with period, clock and description kept."""
    return shot_rows.select(*keep, F.col("period").alias("Q"), shown_clock(F.col("clock")).alias("Clock"), F.when(F.col("made"), "Made").otherwise("Missed").alias("Made"), F.col("shotDistance").alias("Dist (ft)"), F.col("description").alias("Play"))


def made_of(made: Column, attempted: Column) -> Column:
    return F.concat(shown_int(made).cast("string"), F.lit("/"), shown_int(attempted).cast("string"))


def line_score(rows: DataFrame) -> DataFrame:
    """Team and points by period, overtimes included, without periods nobody played."""
    periods = sorted((c for c in rows.columns if c.startswith("period") and c.endswith("Score")), key=lambda c: int(c[6:-5]))
    names = [f"Q{k}" if k <= 4 else f"OT{k - 4}" for k in (int(c[6:-5]) for c in periods)]
    return drop_empty_columns(rows.select(F.col("teamTricode").alias("TEAM"), *[number(F.col(c)).cast("long").alias(n) for c, n in zip(periods, names, strict=True)], F.col("score").alias("FINAL")))
