"""Named files, bundles copied, crop labels, frame features, kits and segment quality."""

from __future__ import annotations

import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstat.operators import boxscore, clip, labels, summary, tracks
from quillstat.sources import endpoints, files, folder


def tree(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in Path(root).rglob("*") if p.is_file() and not p.name.startswith(".")}


def test_files_show_once_their_job_has_succeeded(spark, tmp_path):
    root = f"{tmp_path}/out"
    rows = [(f"labels/train/s{k}.txt", bytearray(f"0 {k}".encode())) for k in range(20)] + [("data.yaml", None)]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(4)
    bad = df.withColumn("path", F.when(F.col("path") == "labels/train/s7.txt", "../outside").otherwise(F.col("path")))
    with pytest.raises(Exception, match="not a place below"):
        folder.write_files(bad, root)
    assert tree(root) == {}
    folder.write_files(df, root)
    want = {p: bytes(c or b"") for p, c in rows}
    assert tree(root) == want
    folder.write_files(df.limit(5), root)  # a second run over part of them: still each once
    assert tree(root) == want
    assert folder.pending_files(df.unionByName(spark.createDataFrame([("new", bytearray(b"n"))], df.schema)), root).collect() == [("new", bytearray(b"n"))]
    back = {r.path: bytes(r.content) for r in folder.read_files(spark, root).collect()}
    assert back == {p: c for p, c in want.items() if c}


def test_resume_after_a_crash_in_the_middle_of_the_moves(spark, tmp_path):
    """Half the files are in place, half still staged, when the writer dies; the next run leaves each once and no remains."""
    root = f"{tmp_path}/out"
    df = spark.createDataFrame([(f"f{k}", bytearray(str(k).encode())) for k in range(10)], "path string, content binary")
    writer = folder._Writer(root)
    message = writer.write(iter(df.collect()))
    half = folder._Written(message.folder, message.paths[:5])
    clear, writer._clear = writer._clear, lambda *a: None
    writer.commit([half, None])
    assert set(tree(root)) == {f"f{k}" for k in range(5)} | {f"{message.folder}/f{k}" for k in range(5, 10)}
    folder.write_files(folder.pending_files(df, root), root)
    clear(*folder._store(root))
    assert tree(root) == {f"f{k}": str(k).encode() for k in range(10)}


def test_bundles_are_copied_as_they_were(spark, tmp_path):
    src, out = tmp_path / "src", f"{tmp_path}/sample"
    for game in ("0042100401", "0022100001"):
        (src / game).mkdir(parents=True)
        (src / game / "misc_0.csv").write_text('a,"b c",d\n1,"x, ""y""",\nNA,,3\n')
        (src / game / "misc_1.csv").write_text("only,names\n")
    cells = files.numbered_tables(spark, str(src))
    games = spark.createDataFrame([("0042100401",), ("0022100001",)], "game_id string").where(files.is_finals(F.col("game_id")))
    for _ in range(2):
        folder.copy_bundles(endpoints.finals_cells(cells), games, out)
        assert set(tree(out)) == {"0042100401/misc_0.csv", "0042100401/misc_1.csv"}
    again = files.bundle_table(spark, out, "misc", 0)
    assert [tuple(r) for r in again.orderBy("a").collect()] == [("1", 'x, "y"', None, "0042100401"), ("NA", None, "3", "0042100401")]
    assert tree(out)["0042100401/misc_1.csv"] == b"only,names\n"


def test_crops_hold_their_ball(spark):
    r = random.Random(1)
    rows = [(k % 12, k, r.uniform(0, 1280), r.uniform(0, 720), r.uniform(3, 40), r.uniform(3, 40), k % 3 > 0) for k in range(300)]
    df = spark.createDataFrame(rows, "shot long, frame long, cx double, cy double, w double, h double, positive boolean")
    got = labels.crops(df.repartition(5), 1280, 720)
    seen = got.collect()
    assert sorted(map(tuple, seen)) == sorted(map(tuple, labels.crops(df.repartition(2), 1280, 720).collect()))  # whatever the partitions
    for x in seen:
        assert 0 <= x.ox <= 640 and 0 <= x.oy <= 80 and x.split == ("val" if x.shot % 5 == 0 else "train")
        if not x.positive:
            assert x.label == "" and x["name"].endswith("_n")
            continue
        kind, bx, by, bw, bh = x.label.split()
        assert kind == "0" and 0 <= float(bx) <= 1 and 0 <= float(by) <= 1 and math.isclose(float(bw), max(x.w, 14) / 640, abs_tol=1e-6) and math.isclose(float(bx) * 640 + x.ox, x.cx, abs_tol=1e-3)
    assert len({(x.ox, x.oy) for x in seen}) > 100
    kept = labels.hard_negatives(df)
    assert kept.where("positive").count() == 200 and kept.where("NOT positive").count() == 100
    few = labels.hard_negatives(df.where("positive OR frame < 150").where("NOT positive OR frame < 30"))
    assert few.where("positive").count() == few.where("NOT positive").count() == 20
    named = {x.path: bytes(x.content).decode() for x in labels.label_files(got).collect()}
    assert len(named) == 300 and all(c.endswith("\n") or c == "" for c in named.values())
    assert labels.description(got, "/d").first().content.decode().startswith("path: /d\ntrain: images/train\n")


def test_frame_features_by_numpy(spark):
    r = np.random.default_rng(4)
    frames = [(1, k, r.uniform(-0.2, 1.2, 30).round(3).tolist()) for k in range(12)] + [(2, 0, [0.5] * 30), (2, 1, [0.5] * 30), (2, 2, [9.0] * 30), (2, 3, [9.0] * 30), (2, 4, [None, 0.1]), (2, 5, [0.9, 0.9])]
    random.Random(0).shuffle(frames)
    got = {(x.c, x.f): x for x in clip.frame_features(spark.createDataFrame(frames, "c long, f long, v array<double>"), "c", "f", "v", 8, 0.0, 1.0).collect()}
    by = {(c, f): v for c, f, v in frames}
    for (c, f), v in by.items():
        if (c, f - 1) not in by:
            assert (got[c, f].grey, got[c, f].hist) == (0.0, 0.0)
            continue
        u = by[c, f - 1]
        shared = [(a, b) for a, b in zip(v, u, strict=False) if a is not None and b is not None]
        assert math.isclose(got[c, f].grey, np.mean([abs(a - b) for a, b in shared]), abs_tol=1e-12)
        h, g = (np.histogram([x for x in w if x is not None and 0 <= x < 1], bins=np.linspace(0, 1, 9))[0] for w in (v, u))
        want = 0.0 if h.sum() == g.sum() == 0 else 1.0 if h.sum() == 0 or g.sum() == 0 else math.sqrt(max(0.0, 1 - np.sqrt(h * g).sum() / math.sqrt(h.sum() * g.sum())))
        assert math.isclose(got[c, f].hist, want, abs_tol=1e-7), (c, f)


def test_two_kits_cut_outliers(spark):
    r, rows = random.Random(3), []
    for k in range(40):
        lab = (80, 5, 5) if k % 2 else (25, 0, -20)
        rows.append((k % 3, k, *[c + r.gauss(0, 1.5) for c in lab], 20))
    rows += [(0, 100, 55.0, 60.0, 40.0, 20), (0, 101, 80.0, 5.0, 5.0, 4), (0, 102, None, 5.0, 5.0, 9)]
    df = spark.createDataFrame(rows, "shot long, track_id long, L double, a double, b double, n_colour long")
    got = {x.track_id: x.team for x in tracks.two_kits(df).collect()}
    kept = np.array([x[2:5] for x in rows[:41]])
    side = np.array([int(x[2] > 52) for x in rows[:40]] + [int(got[100] == "light")])
    best = min((sum(((kept[s == c] - kept[s == c].mean(0)) ** 2).sum() for c in (0, 1)), tuple(s)) for s in (np.append(side[:40], 0), np.append(side[:40], 1)))[1]
    s = np.array(best)
    away = np.array([math.dist(kept[k], kept[s == s[k]].mean(0)) for k in range(41)])
    want = ["other" if d > 2.5 * np.median(away) else "light" if c else "dark" for d, c in zip(away, s, strict=True)]
    assert [got[x[1]] for x in rows[:41]] == want and want[40] == "other" and got[101] == got[102] == "other"
    assert {x.team for x in tracks.two_kits(df.limit(3)).collect()} == {"other"}


def test_segment_quality_counts_empty_frames(spark):
    rows = [(1, 10, 1, False, True), (1, 10, 2, False, True), (1, 11, 1, False, True), (1, 11, -1, True, False), (1, 12, 3, False, False), (1, 13, -1, False, True)]
    df = spark.createDataFrame(rows, "segment long, frame long, track_id long, is_ball boolean, on_floor boolean")
    got = tracks.segment_quality(df, spark.createDataFrame([(1, 8), (2, 5)], "segment long, frames long")).orderBy("segment").collect()
    assert tuple(got[0]) == (1, 8, 0.5, 0.0, 2, 1.5, None, 0.125, 1)
    assert tuple(got[1]) == (2, 5, 0.0, 0.0, 0, 0.0, None, 0.0, 0)


def test_shot_log_and_event_list(spark):
    pbp = spark.createDataFrame([(1, "PT07M05.00S", "Layup", 1, 2.0, 2, "Made"), (4, "PT00M30.50S", "Three", 1, 25.0, 3, "missed")], "period long, clock string, description string, isFieldGoal int, shotDistance double, shotValue int, shotResult string")
    log = boxscore.shot_log(boxscore.shots(pbp, "period", "clock", "description")).orderBy("Q").collect()
    assert [tuple(x) for x in log] == [(1, "07:05", "Made", 2.0, "Layup"), (4, "00:30", "Missed", 25.0, "Three")]
    events = spark.createDataFrame([(1, 1950, "pass", "light", "a", "b", 4.0, 0.5), (1, 30, "interception", "dark", "a", "b", None, 0.2)], "shot long, frame long, type string, team string, from_pid string, to_pid string, dist_m double, gap_s double")
    got = summary.event_list(events, {"light": "BOS", "dark": "GSW"}).orderBy("nth").collect()
    assert [tuple(x) for x in got] == [(1, 1, "0:01.0", "interception", "GSW", None, 0.2), (1, 2, "1:05.0", "pass", "BOS", 4.0, 0.5)]
