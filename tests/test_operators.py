"""Operators on small scenes with known answers; rows arrive shuffled wherever order matters."""

from __future__ import annotations

import json
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstat.functions import params as P
from quillstat.functions.scalar import elapsed_minutes, half_even, json_number, json_text, minutes
from quillstat.operators import ball, boxscore, clip, possession, summary, timeline, tracks


def rows(spark, data, schema, seed=0):
    data = list(data)
    random.Random(seed).shuffle(data)
    return spark.createDataFrame(data, schema)


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_minutes(spark):
    df = spark.createDataFrame([("42:30",), ("PT05M30.00S",), ("",), (None,), ("12.5",), ("x:10",)], "t string")
    assert [r[0] for r in df.select(minutes(F.col("t"))).collect()] == [42.5, 5.5, None, None, 12.5, None]


def test_elapsed(spark):
    df = spark.createDataFrame([(1, "PT12M00.00S"), (2, "PT06M00.00S"), (4, "PT00M00.00S"), (5, "PT00M00.00S"), (1, "junk")], "p int, c string")
    assert [r[0] for r in df.select(elapsed_minutes(F.col("p"), F.col("c"))).collect()] == [0.0, 18.0, 48.0, 53.0, None]


def test_half_even_like_numpy(spark):
    x = [k / 1000 for k in range(-2000, 2000, 5)] + [0.25, 0.35, 2.5]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(half_even(F.col("x"), 1)).collect()]
    assert got == np.round(x, 1).tolist()


def test_team_tabs(spark):
    players = rows(spark, [("A", "S. Star", "30:00", "20"), ("A", "B. Bench", "10:00", "14"), ("A", "D. Nope", "", "0"), ("B", "X. Ex", "12:00", "9")], "teamTricode string, nameI string, minutes string, points string")
    teams = spark.createDataFrame([("A", "240:00", "34"), ("B", "240:00", "9")], "teamTricode string, minutes string, points string")
    out = boxscore.team_tabs(players, teams, P.BOX).where("team = 'A'").orderBy("row_kind", F.desc("MIN"), "PLAYER")
    assert [tuple(r) for r in out.select("PLAYER", "PTS").collect()] == [("S. Star", 20), ("B. Bench", 14), ("TEAM", 34)]


def test_four_factors(spark):
    df = spark.createDataFrame([(40, 80, 10, 20, 10), (0, 0, 0, 0, 0)], "fieldGoalsMade int, fieldGoalsAttempted int, threePointersMade int, freeThrowsAttempted int, turnovers int")
    got = boxscore.four_factors(df).collect()
    assert (got[0].efg_pct, got[0].ft_rate) == (56.2, 0.25) and tuple(got[1]) == (None, None, None)


def test_shots_and_zones(spark):
    pbp = spark.createDataFrame([(1, 2.0, 2, "Made"), (1, 7.0, 2, "missed"), (1, 25.0, 3, "MADE"), (1, None, 2, "Made"), (1, 4.5, 2, "Missed"), (0, 1.0, 2, "Made")], "isFieldGoal int, shotDistance double, shotValue int, shotResult string")
    got = values(boxscore.zone_table(boxscore.shots(pbp)), "ord")
    assert [g[2:] for g in got] == [(1, 1, 100.0), (0, 1, 0.0), (1, 2, 50.0), (1, 1, 100.0)]


def test_foul_counts(spark):
    pbp = spark.createDataFrame([("Foul", "Personal TECHNICAL", "a"), ("foul", "flagrant type 1", "a"), ("shot", "technical", "a"), ("foul", "technical", None)], "actionType string, subType string, playerNameI string")
    assert values(boxscore.foul_counts(pbp), "player") == [("a", 1, 1)]


def test_games_of_rows(spark):
    raw = rows(spark, [("1", "2022-06-02", "BOS @ GSW", "BOS", 120), ("1", "2022-06-02", "GSW vs. BOS", "GSW", 108), ("2", "2022-06-05", "A @ B", "A", 1), ("3", "2022-06-05", "C @ D", "C", 1), ("3", "2022-06-05", "D vs. C", "D", 2)], "GAME_ID string, GAME_DATE string, MATCHUP string, TEAM_ABBREVIATION string, PTS int")
    got = boxscore.games_of_rows(raw).orderBy("game_id").collect()
    assert [g.game_id for g in got] == ["1", "3"] and got[0].label == "2022-06-02  BOS 120 @ GSW 108"


def test_optional_columns(spark):
    df = spark.createDataFrame([("A", 3, None)], "TEAM string, x int, y int")
    assert boxscore.drop_empty_columns(df).columns == ["TEAM", "x"]
    assert boxscore.conform(df, {"x": "bigint", "z": "string"}).first() == (3, None)
    line = spark.createDataFrame([("A", 20, 30, 8, 58)], "teamTricode string, period1Score int, period2Score int, period5Score int, score int")
    assert boxscore.line_score(line).columns == ["TEAM", "Q1", "Q2", "OT1", "FINAL"]


def test_timeline_and_runs(spark):
    log = [(0, 1, "PT12M00.00S", "0", "0", "period"), (1, 1, "PT11M00.00S", "2", "0", "2pt"), (2, 1, "PT10M00.00S", "5", "0", "3pt"), (3, 1, "PT09M30.00S", None, None, "foul"), (4, 1, "PT09M00.00S", "5", "2", "2pt"), (5, 1, "PT08M00.00S", "5", "4", "2pt"), (6, 2, "PT12M00.00S", "5", "4", "period"), (7, 2, "PT11M00.00S", "5", "7", "3pt")]
    pbp = rows(spark, [("g", *r) for r in log], "game_id string, ord long, period int, clock string, scoreHome string, scoreAway string, actionType string")
    tl = timeline.score_timeline(pbp)
    assert [r.margin for r in tl.orderBy("ord").collect()] == [0, 0, 2, 5, 3, 1, -2]
    assert [(r.side, r.points, r.start, r.end) for r in timeline.scoring_runs(tl, "game_id").orderBy("nth").collect()] == [("away", 7, 3.0, 13.0), ("home", 5, 1.0, 3.0)]
    assert tuple(timeline.leads(tl, "game_id").first())[1:] == (5, 2, 1)


def test_holders_contest(spark):
    people = spark.createDataFrame([(0, 1, "a", "light", 0.0, 0.0, 10.0, 20.0), (0, 1, "b", "dark", 100.0, 0.0, 110.0, 20.0), (0, 2, "a", "light", 0.0, 0.0, 10.0, 20.0), (0, 2, "b", "dark", 1.0, 0.0, 11.0, 20.0)], "shot long, frame long, pid string, team string, x1 double, y1 double, x2 double, y2 double")
    track = spark.createDataFrame([(0, 1, 5.0, 11.0), (0, 2, 5.0, 11.0)], "shot long, frame long, cx double, cy double")
    assert values(possession.frame_holders(people, track).select("frame", "pid"), "frame") == [(1, "a")]


def loop_states(holders):
    out, run = [], None
    for frame, pid in holders:
        if run and run[0] == pid and frame - run[2] <= P.HOLD_GAP:
            run[2], run[3] = frame, run[3] + 1
        else:
            run = [pid, frame, frame, 1]
            out.append(run)
    return [tuple(r) for r in out if r[3] >= P.HOLD_ROWS]


def test_states_equal_a_loop(spark):
    rng = random.Random(3)
    frame, seq = 0, []
    for _ in range(400):
        frame += rng.choice([1, 1, 1, 2, 4, 5])
        seq.append((frame, rng.choice("aaaaaaab") if len(seq) % 50 < 40 else "c"))
    df = rows(spark, [(0, f, p, "light") for f, p in seq], "shot long, frame long, pid string, team string")
    got = [(r.pid, r.start, r.end, r.n) for r in possession.holder_states(df).orderBy("start").collect()]
    assert got == loop_states(seq) and got


def test_events_and_flipflops(spark):
    s = "shot long, pid string, team string, start long, end long, X0 double, Y0 double, X1 double, Y1 double"
    states = rows(spark, [
        (0, "a", "light", 0, 10, 10.0, 7.0, 10.0, 7.0), (0, "b", "light", 20, 30, 14.0, 7.0, 14.0, 7.0), (0, "c", "dark", 40, 50, 15.0, 7.0, 15.0, 7.0), (0, "d", "light", 60, 70, 14.0, 7.0, None, None),
        (1, "a", "light", 0, 10, 10.0, 7.0, 10.0, 7.0), (1, "c", "dark", 20, 30, 2.0, 7.5, 2.0, 7.5), (2, "a", "light", 0, 10, 9.0, 7.0, None, None), (2, "c", "dark", 20, 30, 14.0, 7.0, 14.0, 7.0), (2, "d", "dark", 200, 210, 9.0, 7.0, 9.0, 7.0)], s)
    events = possession.detect_events(states)
    assert values(events.select("shot", "frame", "type", "team", "dist_m"), "shot", "frame") == [(0, 20, "pass", "light", 4.0), (0, 40, "interception", "dark", 1.0), (0, 60, "interception", "light", 1.0), (2, 20, "interception", "dark", None)]
    assert values(possession.drop_flipflops(events).select("shot", "frame"), "shot", "frame") == [(0, 20), (2, 20)]


def test_possession(spark):
    spans = spark.createDataFrame([(0, 0, 100)], "shot long, start long, end long")
    states = spark.createDataFrame([(0, 10, 20, "light"), (0, 50, 60, "dark")], "shot long, start long, end long, team string")
    frames = possession.possession_frames(spans, states)
    assert frames.count() == 100 and frames.where("team IS NULL").count() == 10
    assert tuple(possession.possession_share(frames).first()) == pytest.approx((40 / 90, 50 / 90))
    assert tuple(possession.possession_share(frames.where("false")).first()) == (None, None)


def test_interpolate(spark):
    df = rows(spark, [(0, 0, 0.0, 1.0), (0, 5, 10.0, 1.0), (0, 30, 20.0, 1.0)], "shot long, frame long, cx double, conf double")
    got = values(ball.interpolate(df, ["shot"], "frame", ["cx"], ["conf"]), "frame")
    assert [(g[1], g[2], g[4]) for g in got] == [(0, 0.0, False), (1, 2.0, True), (2, 4.0, True), (3, 6.0, True), (4, 8.0, True), (5, 10.0, False), (30, 20.0, False)]


def test_static_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    data = [(0, int(f), float(x), float(y)) for f, x, y in zip(rng.integers(0, 120, 300), rng.integers(0, 12, 300), rng.integers(0, 12, 300), strict=True)]
    got = values(ball.neighbours(rows(spark, data, "shot long, frame long, cx double, cy double"), "shot", "frame", 15, {"img": (("cx", "cy"), 3.0)}), "frame", "cx", "cy")
    for _, f, x, y, n in got:
        assert n == sum(abs(f - g) <= 15 and (x - u) ** 2 + (y - v) ** 2 <= 9 for _, g, u, v in data) - 1


def test_neighbours_of_repeats_bounds_and_nulls(spark):
    data = [(1, 0, 0.0, 0.0)] * 40 + [(1, 15, 3.0, 0.0), (1, 16, 3.0, 0.0), (1, 0, -3.0, -0.0), (1, 0, 2.5, 2.5), (2, 0, 0.0, 0.0), (None, 0, 0.0, 0.0), (1, None, 0.0, 0.0), (1, 0, None, 0.0)]
    df = rows(spark, data, "shot long, frame long, cx double, cy double")
    got = ball.neighbours(df, "shot", "frame", 15, {"img": (("cx", "cy"), 3.0)})
    assert got.columns == [*df.columns, "n_img"] and got.count() == len(data)
    by = {tuple(r)[:4]: r.n_img for r in got.collect()}
    assert by == {(1, 0, 0.0, 0.0): 41, (1, 15, 3.0, 0.0): 42, (1, 16, 3.0, 0.0): 1, (1, 0, -3.0, 0.0): 40, (1, 0, 2.5, 2.5): 1, (2, 0, 0.0, 0.0): 0, (None, 0, 0.0, 0.0): -1, (1, None, 0.0, 0.0): -1, (1, 0, None, 0.0): -1}



def brute_path(frame, xy, reward):
    """All paths through a handful of candidates."""
    best = (-np.inf, [])

    def go(path, score):
        nonlocal best
        if score > best[0] + 1e-12:
            best = (score, path)
        for j in range(len(frame)):
            if frame[j] <= frame[path[-1]]:
                continue
            step = frame[j] - frame[path[-1]]
            away = np.hypot(*(xy[j] - xy[path[-1]]))
            limit = P.BALL_SPEED * step / P.FPS + P.BALL_SLACK
            options = [P.BALL_RESTART] + ([0.03 * (step - 1) + 0.15 * away / limit] if step <= P.BALL_GAP and away <= limit else [])
            go([*path, j], score + reward[j] - min(options))

    for i in range(len(frame)):
        go([i], reward[i] - P.BALL_RESTART)
    return best


def test_best_path_equals_all_paths():
    rng = np.random.default_rng(5)
    for _ in range(20):
        frame = np.sort(rng.integers(0, 14, 8))
        xy, reward = rng.random((8, 2)) * 8, rng.random(8) + 0.1
        path = ball.best_path(frame, xy, reward)
        score, want = brute_path(frame, xy, reward)
        assert path == want, (score, path, want)


def test_moving_ball_beats_clutter(spark):
    h = [10.0, 0, 0, 0, 10.0, 0, 0, 0, 1.0]
    balls = [(0, f, 0.3, 50.0 + 2 * f, 60.0, 10.0, 10.0) for f in range(60)] + [(0, f, 0.9, 200.0, 100.0, 10.0, 10.0) for f in range(60)]
    frames = [(0, f, True, *map(float, h)) for f in range(60)]
    people = spark.createDataFrame([(0, 1, True, 0.0, 0.0)], "shot long, frame long, mapped boolean, X double, Y double")
    got = ball.ball_track(rows(spark, balls, "shot long, frame long, conf double, cx double, cy double, w double, h double"), rows(spark, frames, "shot long, frame long, mapped boolean, " + ", ".join(f"{c} double" for c in ball.H)), people).collect()
    assert sum(r.cy == 60.0 for r in got) > 57 and len(got) >= 58


def test_thin_labels(spark):
    df = rows(spark, [(0, f) for f in (1, 2, 3, 4, 5, 9, 9, 11, 12)], "k long, f long")
    assert values(ball.thin_labels(df, "k", "f"), "f") == [(0, 1), (0, 4), (0, 9), (0, 12)]


def runner(spark, data):
    return tracks.smooth_motion(rows(spark, data, "pid string, frame long, X double, Y double"), ["pid"])


def test_constant_speed(spark):
    rng = np.random.default_rng(0)
    out = runner(spark, [("a", f, 2 + 0.1 * f * 0.8 + float(rng.normal(0, 0.02)), 1 + 0.1 * f * 0.6 / 2 + float(rng.normal(0, 0.02))) for f in range(300)])
    want = 30 * np.hypot(0.08, 0.03)
    assert out.agg(F.avg("speed")).first()[0] == pytest.approx(want, abs=0.15)


def test_standing_still(spark):
    rng = np.random.default_rng(1)
    out = runner(spark, [("a", f, 10 + float(rng.normal(0, 0.02)), 5 + float(rng.normal(0, 0.02))) for f in range(300)])
    assert out.agg(F.max("dist")).first()[0] < 1.5


def test_smoothing_equals_least_squares(spark):
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(0, 0.05, 40)) + 10
    got = runner(spark, [("a", f, float(v), 5.0) for f, v in enumerate(x)]).orderBy("frame").collect()
    i = np.arange(15)
    for k in range(40):
        lo = min(max(k - 7, 0), 25)
        assert got[k].Xs == pytest.approx(np.polyval(np.polyfit(i, x[lo : lo + 15], 2), k - lo), abs=1e-9)


def test_hole_counts_nothing(spark):
    data = [("a", f, 0.1 * f, 5.0) for f in range(120) if not 45 <= f < 75]
    out = runner(spark, data)
    assert out.where("frame BETWEEN 51 AND 69").where("ok OR speed IS NOT NULL").count() == 0
    assert out.where("frame BETWEEN 45 AND 49 AND ok").count() == 5


def test_stitching(spark):
    people = [(0, 1, f, True, 5 + 0.05 * f, 5.0) for f in range(30)] + [(0, 2, f, True, 5 + 0.05 * f, 5.0) for f in range(40, 70)] + [(0, 3, f, True, 5.0, 5.0) for f in range(40, 70)] + [(0, 4, f, True, 25.0, 12.0) for f in range(40, 70)]
    df = rows(spark, people, "shot long, track_id long, frame long, mapped boolean, X double, Y double").withColumns({c: F.lit(50.0) for c in ("L", "a", "b")})
    teams = spark.createDataFrame([(0, 1, "light"), (0, 2, "light"), (0, 3, "dark"), (0, 4, "light")], "shot long, track_id long, team string")
    got = dict((r.track_id, r.pid) for r in tracks.stitch_tracks(df, tracks.track_summary(df), teams).collect())
    assert got[1] == got[2] and len(set(got.values())) == 3


def test_kits(spark):
    rng = np.random.default_rng(4)
    centres = [(80, 10), (25, 15), (50, 5)]
    data = [(0, 100 * k + j, 40, 1.0, 40, float(c + rng.normal(0, 1)), float(rng.normal(0, 1)), float(rng.normal(0, 1))) for k, (c, n) in enumerate(centres) for j in range(n)] + [(0, 999, 3, 1.0, 3, 50.0, 0.0, 0.0)]
    df = spark.createDataFrame(data, "shot long, track_id long, frames long, inside_share double, n_colour long, L double, a double, b double")
    assert {r.team: r["count"] for r in tracks.assign_teams(df).groupBy("team").count().collect()} == {"light": 10, "dark": 15, "other": 5, "unknown": 1}


def test_cuts_segments_banners(spark):
    diffs = spark.createDataFrame([("c", k, 50.0 if k == 20 else 2.0, 0.5 if k == 40 else 0.1) for k in range(60)], "clip string, k long, grey double, hist double")
    cuts = clip.detect_cuts(diffs, "k", "grey", "hist", "clip")
    assert values(cuts, "k") == [("c", 20), ("c", 40)]
    totals = spark.createDataFrame([("c", 60)], "clip string, total long")
    assert values(clip.segments(cuts, totals, "k", "clip", 20), "start") == [("c", 0, 20), ("c", 20, 40), ("c", 40, 60)]
    frames = spark.range(100).select(F.lit("c").alias("clip"), F.col("id").alias("frame"))
    shown = clip.banners(frames, spark.createDataFrame([("c", 10, "x"), ("c", 30, "y")], "clip string, frame long, what string"), "clip", "what")
    assert [r.what for r in shown.orderBy("frame").collect()] == [None] * 10 + ["x"] * 20 + ["y"] * 37 + [None] * 33


def test_empty_inputs(spark):
    people = spark.createDataFrame([], "pid string, frame long, X double, Y double")
    assert tracks.smooth_motion(people, ["pid"]).count() == 0
    holders = spark.createDataFrame([], "shot long, frame long, pid string, team string")
    assert possession.holder_states(holders).count() == 0


def test_states_and_banners_off_the_spine(spark):
    spans = spark.createDataFrame([(0, 10, 16)], "shot long, start long, end long")
    states = spark.createDataFrame([(0, 5, 9, "light"), (0, 13, 20, "dark")], "shot long, start long, end long, team string")
    assert [r.team for r in possession.possession_frames(spans, states).orderBy("frame").collect()] == ["light"] * 3 + ["dark"] * 3
    assert [tuple(r)[1:] for r in possession.possession_frames(spans, states, step=2).orderBy("frame").collect()] == [(10, "light"), (12, "light"), (14, "dark")]
    frames = spark.createDataFrame([(0, k) for k in range(0, 60, 6)], "shot long, frame long")
    shown = clip.banners(frames, spark.createDataFrame([(0, 10, "pass")], "shot long, frame long, what string"), "shot", "what")
    assert {r.frame for r in shown.where("what = 'pass'").collect()} == {12, 18, 24, 30, 36, 42}
    spots = spark.createDataFrame([("a", 1, None, None), ("a", 1, 3.0, 4.0)], "pid string, frame long, Xs double, Ys double")
    one = spark.createDataFrame([(0, "a", 1, 1)], "shot long, pid string, start long, end long")
    assert possession.with_positions(one, spots).first().X0 == 3.0


def test_counts_run_over_a_clip(spark):
    events = spark.createDataFrame([("c", 1, "pass", "light"), ("c", 5, "pass", "light")], "clip string, frame long, type string, team string")
    frames = spark.createDataFrame([("c", k, "light" if k < 4 else None) for k in (0, 1, 2, 4, 5, 6)], "clip string, frame long, team string")
    got = possession.cumulative_counts(events, frames).orderBy("frame").collect()
    assert [r.light_pass for r in got] == [0, 1, 1, 1, 2, 2] and got[-1].light_possession == 100.0


def test_kits_need_three_colours(spark):
    schema = "shot long, track_id long, frames long, inside_share double, n_colour long, L double, a double, b double"
    for n in (0, 2):
        rows_ = spark.createDataFrame([(0, k, 50, 1.0, 20, 10.0 * k, 0.0, 0.0) for k in range(n)] + [(0, 9, 1, 1.0, 0, None, None, None)], schema)
        assert {r.team for r in tracks.assign_teams(rows_).collect()} == {"unknown"}


def test_chains_equal_a_loop(spark):
    """Greedy stitching of random scenes against a plain loop over whole tracks."""
    rng = random.Random(9)
    for _ in range(20):
        scene = []
        for k in range(30):
            first = rng.randrange(200)
            scene.append((0, k, rng.choice(["light", "dark"]), first, first + rng.randrange(5, 40), *(rng.uniform(0, 8) for _ in range(4))))
        names = ["shot", "track_id", "team", "first", "last", "head_X", "head_Y", "tail_X", "tail_Y"]
        got = {r.track_id: r.pid for r in tracks._chains(pd.DataFrame(scene, columns=names)).itertuples()}
        chains, want = [], {}
        for t in sorted(scene, key=lambda t: (t[3], t[1])):
            near = [(math.dist(t[5:7], c[-1][7:9]), i) for i, c in enumerate(chains) if c[0][2] == t[2] and 0 < t[3] - c[-1][4] <= P.STITCH_GAP and math.dist(t[5:7], c[-1][7:9]) <= P.STITCH_SPEED * (t[3] - c[-1][4]) / P.FPS + P.STITCH_SLACK]
            if near:
                chains[min(near)[1]].append(t)
                want[t[1]] = f"s0-p{min(near)[1]}"
            else:
                chains.append([t])
                want[t[1]] = f"s0-p{len(chains) - 1}"
        assert got == want


def test_summary_document(spark):
    totals = spark.createDataFrame([(1.5, 3)], "clip_seconds double, usable_shots long")
    stats = spark.createDataFrame([("BOS", "light", 7), ("GSW", "dark", 16)], "team string, kit string, passes long")
    doc = json.loads(summary.summary_document(totals, stats, spark.createDataFrame([(5,)], "raw_tracks long")).first().json)
    assert doc == {"clip_seconds": 1.5, "usable_shots": 3, "team_stats": {"BOS": {"kit": "light", "passes": 7}, "GSW": {"kit": "dark", "passes": 16}}, "quality": {"raw_tracks": 5}}


def test_json_numbers_like_duckdb(spark):
    rng = random.Random(3)
    x = [rng.randrange(2 ** (e - 1), 2**e) / d for e in range(1, 54) for d in (-1, 1, 10, 100, 1000) for _ in range(4)]
    x += [m * 10.0**k for k in range(-30, 40) for m in (1.0, 1.5, -2.0, 9.999999999999999)] + [0.0, -0.0, 17977000.0, -9.666553882611358e16, 3.67117444774589e18, math.inf]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(x)), "i long, x double").orderBy("i").select(json_number(F.col("x"))).collect()]
    assert got == [duckdb.execute("SELECT CAST(to_json(CAST(? AS DOUBLE)) AS VARCHAR)", [v]).fetchone()[0] for v in x]
    assert [float(g) for g in got] == x


def test_json_text_of_any_value(spark):
    data = [(1, 'a"b\\c\n]é', [1.5, None, 2e7], {"k": ([True],)}, None, (None, 3)), (None, None, None, None, 0.0, None), (2, "", [], {"l": None}, -0.5, (1e-4, None))]
    df = spark.createDataFrame(data, 'i int, `s.t` string, a array<double>, m map<string, struct<b: array<boolean>>>, d double, n struct<`x"y`: double, z: long>').coalesce(1)
    got = [r[0] for r in df.select(json_text(F.struct("*"), df.schema)).collect()]
    assert got[0] == '{"i":1,"s.t":"a\\"b\\\\c\\n]é","a":[1.5,null,20000000.0],"m":{"k":{"b":[true]}},"d":null,"n":{"x\\"y":null,"z":3}}'
    assert [json.loads(g) for g in got] == [json.loads(json.dumps(r.asDict(recursive=True))) for r in df.collect()]


def test_summary_document_of_a_long_clip(spark):
    """Seconds from ten million on are written without an exponent, and what is not known is null."""
    totals = spark.createDataFrame([(17977000.0, 11998000.5)], "clip_seconds double, analysed_seconds double")
    stats = spark.createDataFrame([("GSW", None, 2996533000.0), ("BOS", 50.1, 12345678.0)], "team string, possession_pct double, distance_m double")
    got = summary.summary_document(totals, stats, spark.createDataFrame([(None, 5)], "alignment_score_median double, raw_tracks long")).first().json
    assert got == '{"clip_seconds":17977000.0,"analysed_seconds":11998000.5,"team_stats":{"BOS":{"possession_pct":50.1,"distance_m":12345678.0},"GSW":{"possession_pct":null,"distance_m":2996533000.0}},"quality":{"alignment_score_median":null,"raw_tracks":5}}'


def test_possession_ties_go_to_the_even_digit(spark):
    """Of 80 frames 23 are 28.75 per cent, 57 are 71.25."""
    events = spark.createDataFrame([("pass", "light")] * 23 + [("pass", "dark")] * 57, "type string, team string")
    players = spark.createDataFrame([("light", 1.0, 2.0)], "team string, seconds_tracked double, distance_m double")
    got = summary.team_stats(events, players, possession.possession_share(events), {"light": "BOS", "dark": "GSW"})
    assert [(r.team, r.possession_pct) for r in got.orderBy("team").collect()] == [("BOS", 28.8), ("GSW", 71.2)]
