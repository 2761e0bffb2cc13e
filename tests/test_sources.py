"""Readers, sinks and incremental landing on files of the test's own."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillstat.operators import boxscore, timeline
from quillstat.sources import files
from quillstat.streaming import ingest


@pytest.fixture()
def bundle(tmp_path):
    for game, extra in (("0042100401", ""), ("0042100402", ",period5Score")):
        (tmp_path / game).mkdir()
        (tmp_path / game / "summary_4.csv").write_text(f"gameId,teamTricode,period1Score{extra},score\n{game},BOS,20{',7' if extra else ''},120\n{game},GSW,,{'9,' if extra else ''}NA\n")
    (tmp_path / "0042100401" / "playbyplay_0.csv").write_text("gameId,clock,text\n" + "".join(f"0042100401,PT{k}M00.00S,t{k}\n" for k in range(12)))
    (tmp_path / "games.csv").write_text("game_id,date,away,home,away_pts,home_pts,label,season\n0042100401,2022-06-02,BOS,GSW,120,108,x,2021-22\n0022100001,2021-10-19,A,B,1,2,y,2021-22\n")
    return str(tmp_path)


def test_bundle(spark, bundle):
    tables = files.load_bundle(spark, bundle)
    assert set(tables) == {("summary", 4), ("playbyplay", 0)}
    one = files.bundle_table(spark, bundle, "summary", 4, "0042100401")
    got = one.orderBy("teamTricode").collect()
    assert [r.game_id for r in got] == ["0042100401"] * 2 and got[1].period1Score is None and got[1].score == "NA"
    assert [r.text for r in tables["playbyplay", 0].orderBy("ord").collect()] == [f"t{k}" for k in range(12)]
    assert files.bundle_table(spark, bundle, "misc", 0) is None
    with pytest.raises(FileNotFoundError):
        files.load_bundle(spark, bundle, "999*")


def test_games_with_other_columns(spark, bundle, tmp_path):
    """Different columns, and the same ones in another order."""
    whole = files.bundle_table(spark, bundle, "summary", 4)
    assert whole.columns == ["gameId", "teamTricode", "period1Score", "period5Score", "score", "game_id"]
    got = {(r.game_id, r.teamTricode): r for r in whole.collect()}
    assert got["0042100401", "BOS"].period5Score is None and got["0042100402", "BOS"].period5Score == "7" and got["0042100402", "GSW"].score == "NA"
    (tmp_path / "0042100403").mkdir()
    (tmp_path / "0042100403" / "summary_4.csv").write_text('score,teamTricode,gameId,note\n99,LAL,0042100403,"a ""b"",\nc"\n')
    row = files.bundle_table(spark, bundle, "summary", 4).where("teamTricode = 'LAL'").first()
    assert (row.score, row.gameId, row.game_id, row.note, row.period1Score) == ("99", "0042100403", "0042100403", 'a "b",\nc', None)


def test_operators_run_on_bundles(spark, tmp_path):
    """Tabs, line score and timeline of two games, one with overtime, straight from the files."""
    for game, more in (("0042100401", False), ("0042100402", True)):
        g = tmp_path / game
        g.mkdir()
        (g / "summary_4.csv").write_text(f"gameId,teamTricode,period1Score,period2Score,period3Score,period4Score{',period5Score' if more else ''},score\n{game},BOS,20,20,20,20{',9' if more else ''},{89 if more else 80}\n{game},GSW,25,15,20,20{',7' if more else ''},{87 if more else 80}\n")
        names = "minutes,points,nameI,teamTricode,personId" if more else "nameI,teamTricode,personId,minutes,points"
        people = [("A. Star", "BOS", "1", "30:30", "20"), ("B. Bench", "BOS", "2", "", ""), ("C. Curry", "GSW", "3", "PT40M00.00S", "31")]
        lines = [",".join(dict(zip(("nameI", "teamTricode", "personId", "minutes", "points"), p, strict=True))[n] for n in names.split(",")) for p in people]
        (g / "traditional_0.csv").write_text("\n".join([names, *lines]) + "\n")
        (g / "traditional_2.csv").write_text("teamTricode,minutes,points\nBOS,240:00,80\nGSW,240:00,80\n")
        plays = [(1, "PT12M00.00S", "period", "0", "0"), (1, "PT11M00.00S", "Made Shot", "2", "0"), (1, "PT10M00.00S", "Missed Shot", "", ""), (2, "PT12M00.00S", "period", "2", "0"), (2, "PT06M00.00S", "Made Shot", "2", "3")]
        (g / "playbyplay_0.csv").write_text("period,clock,actionType,scoreHome,scoreAway\n" + "\n".join(",".join(map(str, p)) for p in plays) + "\n")
    tables = files.load_bundle(spark, str(tmp_path))
    tabs = boxscore.build_tabs(tables)
    assert set(tabs) == {t[0] for t in boxscore.TABS} and tabs["Hustle"].count() == 0
    for game in ("0042100401", "0042100402"):
        box = tabs["Box score"].where((F.col("game_id") == game) & (F.col("team") == "BOS")).orderBy("nth").collect()
        assert [(r.nth, r.PLAYER, r.MIN, r.PTS) for r in box] == [(1, "A. Star", 30.5, 20), (2, "TEAM", 240.0, 80)]
    one = boxscore.line_score(tables["summary", 4].where("game_id = '0042100401'"))
    assert one.columns == ["TEAM", "Q1", "Q2", "Q3", "Q4", "FINAL"]
    over = boxscore.line_score(tables["summary", 4].where("game_id = '0042100402'")).orderBy("TEAM").collect()
    assert over[0].asDict() == {"TEAM": "BOS", "Q1": 20, "Q2": 20, "Q3": 20, "Q4": 20, "OT1": 9, "FINAL": "89"}
    line = timeline.score_timeline(tables["playbyplay", 0]).where("game_id = '0042100402'").orderBy("ord").collect()
    assert [(r.minute, r.home, r.away) for r in line] == [(0.0, 0, 0), (0.0, 0, 0), (1.0, 2, 0), (18.0, 2, 3)]


def test_season_list_and_sample(spark, bundle, tmp_path):
    games = files.sample_games(spark, bundle, "2021-22")
    assert games.count() == 2
    files.build_sample([games], f"{tmp_path}/sample")
    assert [r.game_id for r in spark.read.schema(games.schema).parquet(f"{tmp_path}/sample").collect()] == ["0042100401"]
    assert files.with_fallback(None, games).where("sample").count() == 2
    assert files.first_found(spark, f"{bundle}/nope.csv", f"{bundle}/games.csv").endswith("games.csv")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 3.0)], "k long, s string, x double")
    files.append(df, f"{tmp_path}/t", ["s", "k"])
    files.append(df, f"{tmp_path}/t", ["s", "k"])
    assert spark.read.parquet(f"{tmp_path}/t").columns == ["s", "k"] and spark.read.parquet(f"{tmp_path}/t").count() == 4
    files.write_json(df, f"{tmp_path}/j")
    assert files.read_json(spark, f"{tmp_path}/j", "k long, s string, x double").where("x = 3").count() == 1
    files.write_tables({"a": df}, f"{tmp_path}/w", csv=True)
    assert spark.read.option("header", True).csv(f"{tmp_path}/w/a").count() == 2
    table = files.markdown_table(df.orderBy("k"))
    assert table.splitlines()[2] == "| 1 | a |  |"
    assert files.splice("x <!-- m -->old<!-- /m --> y", "m", "new") == "x <!-- m -->\nnew\n<!-- /m --> y"


def test_landing_is_idempotent(spark, tmp_path):
    schema = "shot long, frame long"
    src, dst = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(1, 1), (1, 2), (2, 1)], schema).write.parquet(src)
    for k in range(3):  # the last run finds nothing new
        ingest.land_shots(spark, src, schema, dst, f"{tmp_path}/cp").awaitTermination()
        if k == 0:
            spark.createDataFrame([(3, 1), (2, 1)], schema).write.mode("append").parquet(src)
    landed = spark.read.parquet(f"{dst}/rows")
    assert sorted((r.shot, r.frame) for r in landed.collect()) == [(1, 1), (1, 2), (2, 1), (3, 1)]
    shots = spark.createDataFrame([(1, True), (3, True), (4, True), (5, False)], "shot long, usable boolean")
    assert [r.shot for r in ingest.pending(shots, landed).collect()] == [4]


def test_streaming_runs_and_windows(spark, tmp_path):
    src = f"{tmp_path}/ev"
    spark.createDataFrame([(1, k, "abbbcc"[k]) for k in range(6)], "user_id long, event_id long, event_type string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("user_id long, event_id long, event_type string").parquet(src)
    q = ingest.streaming_runs(stream).writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("runs").collect()) == [(1, "a", 0, 0, 1), (1, "b", 1, 3, 3)]
    batch = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:50:00", "x"), ("2024-01-01 01:10:00", "x")], "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type")
    assert sorted(r.n for r in ingest.windowed_counts(batch).collect()) == [1, 2]


def test_any_suffix_and_missing_endpoints(spark, bundle, tmp_path):
    (tmp_path / "0042100401" / "summary_12.csv").write_text("gameId,x\n0042100401,1\n")
    assert ("summary", 12) in files.load_bundle(spark, bundle)
    with pytest.raises(FileNotFoundError, match="traditional"):
        files.load_sample(spark, bundle, "0042100401")


def test_later_rows_of_a_shot_are_landed(spark, tmp_path):
    src, dst, schema = f"{tmp_path}/in", f"{tmp_path}/out", "shot long, frame long"
    for batch in ([(1, 1)], [(1, 2), (1, 1)], [(1, 3)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        ingest.land_shots(spark, src, schema, dst, f"{tmp_path}/cp").awaitTermination()
    assert sorted((r.shot, r.frame) for r in spark.read.parquet(f"{dst}/rows").collect()) == [(1, 1), (1, 2), (1, 3)]
