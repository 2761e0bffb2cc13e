"""Court model, map fitting, consensus, reference growth and alignment on synthetic scenes."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstat.functions import params as P
from quillstat.operators import court, homography

#: A plausible map from the court to a picture, and others.
MAPS = {1: [30.0, 12.0, 90.0, 1.5, -14.0, 620.0, 0.0005, 0.012, 1.0], 2: [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 3: [-20.0, 3.0, 900.0, 2.0, 18.0, 40.0, -0.002, 0.004, 1.0]}
PAIRS = "view long, x double, y double, u double, v double"


def put(h, x, y):
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def scene(n, seed=0, noise=0.0, wrong=0):
    r = random.Random(seed)
    rows = []
    for view, h in MAPS.items():
        for k in range(n):
            x, y = r.uniform(0, P.COURT_L), r.uniform(0, P.COURT_W)
            u, v = put(h, x, y)
            if k < wrong:
                u, v = u + r.choice([-1, 1]) * r.uniform(60, 500), v + r.uniform(60, 400)
            rows.append((view, x, y, u + r.gauss(0, noise), v + r.gauss(0, noise)))
    r.shuffle(rows)
    return rows


def close(h, want, tolerance):
    return all(math.dist(put(h, x, y), put(want, x, y)) < tolerance for x in (2.0, 14.0, 26.0) for y in (1.0, 8.0, 14.0))


@pytest.mark.parametrize("n", [4, 40])
def test_fit_recovers_the_mapping(spark, n):
    got = {r.view: r for r in homography.fit(spark.createDataFrame(scene(n, n), PAIRS), ["view"]).collect()}
    assert all(close(got[v].h, h, 1e-4) and got[v].n == n and got[v].h[8] == 1.0 for v, h in MAPS.items())


def test_fit_comes_near_the_least_distance(spark):
    """With noise, reweighting leaves residuals no larger than the plain algebraic fit's."""
    pairs = spark.createDataFrame(scene(60, 3, noise=2.0), PAIRS)
    rms = lambda maps: {r.view: r.e for r in homography.residuals(pairs, maps, ["view"]).groupBy("view").agg(F.sqrt(F.avg(F.col("residual") ** 2)).alias("e")).collect()}
    plain, near = rms(homography.fit(pairs, ["view"], 0)), rms(homography.fit(pairs, ["view"], 3))
    assert all(near[v] <= plain[v] * 1.001 and near[v] < 3.2 for v in MAPS)


def test_what_fixes_no_map_is_null(spark):
    line = [(1, float(k), 2.0 * k, 3.0 * k, 1.0 * k) for k in range(6)]
    few = [(2, 0.0, 0.0, 1.0, 1.0), (2, 1.0, 0.0, 2.0, 1.0), (2, None, 0.0, 2.0, 1.0)]
    same = [(3, 1.0, 1.0, 1.0, 1.0)] * 5
    got = homography.fit(spark.createDataFrame(line + few + same, PAIRS), ["view"]).collect()
    assert {r.view: (r.h, r.n) for r in got} == {1: (None, 6), 2: (None, 2), 3: (None, 5)}
    assert homography.consensus(spark.createDataFrame(few, PAIRS), ["view"], 3.0).collect() == [(2, None, 2, 0, None)]


def test_consensus_leaves_outliers_out(spark):
    rows = scene(50, 8, noise=0.3, wrong=18)
    pairs = spark.createDataFrame(rows, PAIRS)
    found = homography.consensus(pairs, ["view"], 3.0)
    got = {r.view: r for r in found.collect()}
    assert all(close(got[v].h, h, 1.5) and got[v].n == 50 and got[v].n_inliers == 32 and got[v].rms < 1 for v, h in MAPS.items())
    again = {r.view: r for r in homography.consensus(spark.createDataFrame(rows[::-1], PAIRS).repartition(7), ["view"], 3.0).collect()}
    assert all(np.allclose(got[v].h, again[v].h, rtol=1e-6) for v in MAPS)


def brute_growth(matches, start, rounds=3):
    refs = [(r, x, 0) for r, x in start]
    for k in range(1, rounds + 1):
        covered, best, bins = {round(x / 2.5) for _, x, _ in refs}, {}, {}
        when = {r: q for r, _, q in refs}
        for frame, ref, inliers, score, x in matches:
            if ref in when and inliers >= 60 and score is not None and x is not None:
                at = (inliers, -when[ref], -ref)
                if frame not in best or at > best[frame][0]:
                    best[frame] = at, score, inliers, x
        for frame, (_, score, inliers, x) in best.items():
            if score >= 2.0 and round(x / 2.5) not in covered:
                q = (score * min(inliers, 300), -frame)
                if round(x / 2.5) not in bins or q > bins[round(x / 2.5)][0]:
                    bins[round(x / 2.5)] = q, frame, x
        if not bins:
            break
        refs += [(f, x, k) for _, f, x in bins.values()]
    return sorted(refs)


def test_references_grow_as_a_loop_does(spark):
    r = random.Random(5)
    where = {f: r.uniform(0, P.COURT_L) for f in range(0, 1500, 30)}
    matches = []
    for f, x in where.items():
        for g, y in where.items():
            if f != g and abs(x - y) < 6:  # views register on near ones only
                matches.append((f, g, r.randrange(40, 500), r.choice([1.0, 2.0, 2.5, 3.0, None]), x + r.uniform(-0.2, 0.2)))
    start = [(0, where[0]), (30, where[30])]
    df = spark.createDataFrame(matches, "frame long, ref long, inliers long, score double, court_x double")
    got = homography.grow_references(df.repartition(5), spark.createDataFrame(start, "ref long, court_x double"))
    want = brute_growth(matches, start)
    assert sorted(tuple(x) for x in got.collect()) == want and max(k for *_, k in want) >= 2
    alone = homography.grow_references(df.where("false"), spark.createDataFrame(start, "ref long, court_x double"))
    assert alone.count() == 2


def test_markings_are_symmetric_and_official(spark):
    lines = court.court_lines(spark)
    rows = lines.collect()
    assert len({r.line for r in rows}) == 11 and all(-1e-9 <= r.x <= P.COURT_L + 1e-9 and -1e-9 <= r.y <= P.COURT_W + 1e-9 for r in rows)
    by = {(r.line, r.nth): (r.x, r.y) for r in rows}
    assert all(abs(by[f"right {n[5:]}", k][0] + x - P.COURT_L) < 1e-9 and by[f"right {n[5:]}", k][1] == y for (n, k), (x, y) in by.items() if n.startswith("left "))
    length = {r.line: r.total for r in court.segments(lines).groupBy("line").agg(F.sum("length").alias("total")).collect()}
    assert math.isclose(length["outer"], 2 * (P.COURT_L + P.COURT_W)) and math.isclose(length["centre"], 2 * math.pi * P.CENTRE_R, rel_tol=2e-3)
    top = max(x for (n, _), (x, _) in by.items() if n == "left three")
    assert abs(top - (P.HOOP_X + P.ARC_R)) < 0.01 and by["left three", 0] == (0.0, P.CORNER_Y) and len([k for n, k in by if n == "left three"]) == 64
    dots = court.sample_points(lines, 0.2).collect()
    assert min(r.x for r in dots) >= -1e-6 and max(r.x for r in dots) <= P.COURT_L + 1e-6 and len(dots) > 1000


def test_nearest_line_equals_brute_force(spark):
    r = random.Random(2)
    lines = court.court_lines(spark)
    points = [(k, r.uniform(-6, P.COURT_L + 6), r.uniform(-6, P.COURT_W + 6)) for k in range(200)] + [(900, None, 1.0), (901, 0.0, 0.0), (902, 0.0, 0.0)]
    got = {x.k: x for x in court.nearest_line(spark.createDataFrame(points, "k long, x double, y double"), lines, 2.0).collect()}
    parts = court.segments(lines).collect()
    for k, x, y in points:
        if x is None:
            assert got[k].line is None
            continue
        best = []
        for s in parts:
            dx, dy = s.x2 - s.x, s.y2 - s.y
            t = max(0.0, min(1.0, ((x - s.x) * dx + (y - s.y) * dy) / (dx * dx + dy * dy) if s.length else 0.0))
            best.append((math.hypot(x - s.x - t * dx, y - s.y - t * dy), s.line))
        away, line = min(best)
        assert (got[k].line, got[k].away) == ((line, pytest.approx(away, abs=1e-12)) if away <= 2 else (None, None))


def test_alignment_falls_with_a_shift(spark):
    """A painted court: the true map scores high, one moved aside near chance; too few markings give null."""
    h, lines = MAPS[1], court.court_lines(spark)
    paint = {}
    for p in court.sample_points(lines, 0.03).collect():
        u, v = put(h, p.x, p.y)
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                paint[round(u) + a, round(v) + b] = 100.0
    pixels = [(view, u, v, paint.get((u, v), 5.0)) for view in (1, 2) for u in range(0, 1280) for v in range(0, 720, 1) if (u, v) in paint or (u * 7 + v) % 16 == 0]
    moved = [c + d * w for c, d, w in zip(h, [36.0] * 3 + [-28.0] * 3 + [0.0] * 3, h[6:9] * 3, strict=True)]
    views = spark.createDataFrame([(1, h), (2, moved), (3, [1.0, 0.0, -9e6, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "view long, h array<double>")
    response = spark.createDataFrame(pd.DataFrame(pixels, columns=["view", "px", "py", "value"]))
    got = {r.view: r for r in court.alignment(response, views, lines).collect()}
    assert got[1].score > 1.5 * got[2].score > 0 and got[1].n > 500 and (got[3].n, got[3].score) == (0, None)
