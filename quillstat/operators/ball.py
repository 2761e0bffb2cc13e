"""The ball: candidates on the court plane, clutter, path selection, gaps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstat.functions import params as P
from quillstat.functions.scalar import inverse, project
from quillstat.scratch import Scratch

H = [f"h{i}{j}" for i in range(3) for j in range(3)]


def candidate_table(balls: DataFrame, frames: DataFrame) -> DataFrame:
    """Candidates of plausible size and shape on mapped frames, with their court place (Xp, Yp), near the court."""
    low, high = P.BALL_SIDE
    fit = F.col("w").between(low, high) & F.col("h").between(low, high) & F.try_divide(F.col("w"), F.col("h")).between(*P.BALL_ASPECT)
    mapped = frames.where("mapped").select("shot", "frame", *H)
    x, y = project(inverse([F.col(c) for c in H]), F.col("cx"), F.col("cy"))
    placed = balls.where(fit).join(mapped, ["shot", "frame"]).withColumns({"Xp": x, "Yp": y}).drop(*H)
    return placed.where(F.col("Xp").between(-4, P.COURT_L + 4) & F.col("Yp").between(-4, P.COURT_W + 12))


def neighbours(df: DataFrame, key: str, order: str, reach: int, places: dict[str, tuple[tuple[str, str], float]]) -> DataFrame:
    """n_<name>: other rows of the key within `reach` of `order` whose (x, y) lies within a radius. places: name -> ((x, y), radius).

    Rows of equal key, order and places meet once, with their number, all places in one equi-join: on cells twice as wide
    as the reach and the radius, one side dealt to the (mostly eight) cells that its surroundings touch. A row without
    key, order or place counts not even itself: -1.
    """
    at = {c: F.col(c) for xy, _ in places.values() for c in xy}
    held = {c: f"_v{k}" for k, c in enumerate(at)}
    wide = df.select(F.col(key).alias("_key"), F.col(order).alias("_t"), *[at[c].cast("double").alias(v) for c, v in held.items()]).where("_key IS NOT NULL AND _t IS NOT NULL")
    wide = wide.groupBy("_key", "_t", *held.values()).agg(F.count("*").alias("_m"))
    each = F.array(*[F.struct(F.lit(k).alias("p"), F.col(held[x]).alias("x"), F.col(held[y]).alias("y"), F.lit(r).alias("r")) for k, ((x, y), r) in enumerate(places.values())])
    long = wide.withColumn("_e", F.explode(each)).select("*", "_e.*").drop("_e").where("x IS NOT NULL AND y IS NOT NULL")
    # A cell is a hair wider than its radius, so that rounding never puts two near rows further apart than next to each other.
    cell = lambda c, half, off=0.0: F.floor((F.col(c) + off * half) / (2 * half))
    axes = {"_t": F.lit(float(max(reach, 1))), "x": F.col("r") * (1 + 1e-9), "y": F.col("r") * (1 + 1e-9)}
    others = long.select("_key", "p", *[F.col(c).alias(f"{c}2") for c in ("_t", "x", "y", "_m")], *[F.sequence(cell(c, h, -1.0), cell(c, h, 1.0)).alias(f"_c{c}") for c, h in axes.items()])
    for c in axes:
        others = others.withColumn(f"_c{c}", F.explode(f"_c{c}"))
    own = long.withColumns({f"_c{c}": cell(c, h) for c, h in axes.items()}).drop("_m")
    met = own.join(others, ["_key", "p", *[f"_c{c}" for c in axes]]).where((F.abs(F.col("_t") - F.col("_t2")) <= reach) & (F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) <= F.col("r")))
    counts = met.groupBy("_key", "_t", *held.values()).agg(*[F.sum(F.when(F.col("p") == k, F.col("_m2"))).alias(f"_n{k}") for k in range(len(places))])
    same = reduce(lambda a, c: a & at[c].cast("double").eqNullSafe(F.col(held[c])), held, (F.col(key) == F.col("_key")) & (F.col(order) == F.col("_t")))
    joined = df.join(counts, same, "left")
    return joined.withColumns({f"n_{name}": F.coalesce(f"_n{k}", F.lit(0)) - 1 for k, name in enumerate(places)}).drop("_key", "_t", *held.values(), *[f"_n{k}" for k in range(len(places))])


def drop_static(candidates: DataFrame) -> DataFrame:
    """Candidates that keep standing at one pixel or one court place go."""
    counted = neighbours(candidates, "shot", "frame", P.STATIC_FRAMES, {"img": (("cx", "cy"), P.STATIC_PX), "crt": (("Xp", "Yp"), P.STATIC_M)})
    return counted.where((F.col("n_img") < P.STATIC_REPEATS) & (F.col("n_crt") < P.STATIC_REPEATS)).drop("n_img", "n_crt")


def near_flag(left: DataFrame, right: DataFrame, keys: list[str], xy: tuple[str, str], other: tuple[str, str], radius: float) -> DataFrame:
    """near: whether some row of `right` with equal keys stands within the radius. The distinct places of `left` meet those of `right`, dealt to nine grid cells, in an equi-join; its hits are joined back."""
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)])
    spots = right.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col(other[0]).alias("_rx"), F.col(other[1]).alias("_ry")).where("_rx IS NOT NULL AND _ry IS NOT NULL").distinct()
    spots = spots.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around)).withColumns({"_cx": cell("_rx") + F.col("_dx"), "_cy": cell("_ry") + F.col("_dy")})
    names = [f"_k{n}" for n in range(len(keys))]
    places = left.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(xy[0]).alias("_x"), F.col(xy[1]).alias("_y")).distinct().withColumns({"_cx": cell("_x"), "_cy": cell("_y")})
    close = places.join(spots, [*names, "_cx", "_cy"]).where(F.hypot(F.col("_x") - F.col("_rx"), F.col("_y") - F.col("_ry")) <= radius)
    hits = close.select(*names, "_x", "_y").distinct().withColumn("_near", F.lit(True))
    same = reduce(lambda a, kn: a & (F.col(kn[0]) == F.col(kn[1])), zip(keys, names, strict=True), (F.col(xy[0]) == F.col("_x")) & (F.col(xy[1]) == F.col("_y")))
    return left.join(hits, same, "left").withColumn("near", F.coalesce("_near", F.lit(False))).drop(*names, "_x", "_y", "_near")


def player_bonus(candidates: DataFrame, people: DataFrame) -> DataFrame:
    """bonus: NEAR_BONUS for a candidate close to a mapped person of its frame."""
    flagged = near_flag(candidates, people.where("mapped"), ["shot", "frame"], ("Xp", "Yp"), ("X", "Y"), P.NEAR_PLAYER)
    return flagged.withColumn("bonus", F.when(F.col("near"), P.NEAR_BONUS).otherwise(0.0)).drop("near")


def best_path(frame: np.ndarray, xy: np.ndarray, reward: np.ndarray) -> list[int]:
    """Indices of the best path through candidates sorted by frame.

    A path may step to a candidate up to BALL_GAP frames on that the ball can reach, at a small price, or leave off and
    go on anywhere later for BALL_RESTART. Values are settled frame by frame; on equal values the earlier option stays.
    """
    value, back = np.full(len(frame), -np.inf), np.full(len(frame), -1)
    frames, starts = np.unique(frame, return_index=True)
    bounds = np.append(starts, len(frame))
    span = {int(f): (bounds[k], bounds[k + 1]) for k, f in enumerate(frames)}
    top, top_at = -np.inf, -1
    for f in frames.tolist():
        lo, hi = span[f]
        fresh = reward[lo:hi] - P.BALL_RESTART
        value[lo:hi] = fresh
        if top_at >= 0 and top > 0:
            value[lo:hi], back[lo:hi] = top + fresh, top_at
        for step in range(1, P.BALL_GAP + 1):
            if f - step not in span:
                continue
            a, b = span[f - step]
            away = np.hypot(xy[lo:hi, None, 0] - xy[None, a:b, 0], xy[lo:hi, None, 1] - xy[None, a:b, 1])
            limit = P.BALL_SPEED * step / P.FPS + P.BALL_SLACK
            gain = np.where(away <= limit, value[None, a:b] - (0.03 * (step - 1) + 0.15 * away / limit), -np.inf)
            k = gain.argmax(axis=1)
            got = gain[np.arange(hi - lo), k] + reward[lo:hi]
            better = got > value[lo:hi]
            value[lo:hi][better], back[lo:hi][better] = got[better], a + k[better]
        k = int(value[lo:hi].argmax())
        if value[lo + k] > top:
            top, top_at = value[lo + k], lo + k
    path, at = [], int(value.argmax()) if len(value) else -1
    while at >= 0:
        path.append(at)
        at = int(back[at])
    return path[::-1]


def _select(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["frame", "conf", "cx", "cy"], ascending=[True, False, True, True], kind="stable").reset_index(drop=True)
    chosen = best_path(rows["frame"].to_numpy(), rows[["Xp", "Yp"]].to_numpy(), np.sqrt(rows["conf"].to_numpy()) + rows["bonus"].to_numpy())
    return rows.loc[chosen, ["shot", "frame", "cx", "cy", "conf"]]


def select_ball(candidates: DataFrame, people: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(shot, frame, cx, cy, conf): the ball's path through each shot. A shot, one camera take, is a group.

    Candidates are read several times, so they are written once to `scratch` (without one, until the driver ends), and so are those that are no clutter.
    """
    scratch = scratch or Scratch(candidates.sparkSession, "ball")
    columns = ["shot", "frame", "cx", "cy", "conf", "Xp", "Yp"]
    whole = scratch.write(candidates.where(F.col("cy") < P.OVERLAY_Y).select(*columns), "candidates")
    clear = player_bonus(scratch.write(drop_static(whole), "clear"), people)
    rows = clear.select("shot", "frame", "cx", "cy", "conf", "Xp", "Yp", "bonus")
    return rows.groupBy("shot").applyInPandas(_select, "shot long, frame long, cx double, cy double, conf double")


def interpolate(track: DataFrame, keys: list[str], frame: str, values: list[str], blank: list[str], gap: int = P.BALL_GAP) -> DataFrame:
    """Fills gaps of up to `gap` frames in a straight line; filled rows are flagged, their `blank` columns null."""
    w = Window.partitionBy(*keys).orderBy(frame)
    step = F.lead(frame).over(w) - F.col(frame)
    ahead = track.withColumns({"_step": step} | {f"_{v}": F.lead(v).over(w) for v in values})
    count = F.when(F.col("_step").between(2, gap), F.col("_step") - 1).otherwise(0)
    rows = ahead.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long"))))
    part = F.when(F.col("_k") == 0, 0.0).otherwise(F.col("_k") / F.col("_step"))
    filled = [F.when(F.col("_k") == 0, F.col(v)).otherwise(F.col(v) + part * (F.col(f"_{v}") - F.col(v))).alias(v) for v in values]
    return rows.select(*keys, (F.col(frame) + F.col("_k")).alias(frame), *filled, *[F.when(F.col("_k") == 0, F.col(b)).alias(b) for b in blank], (F.col("_k") > 0).alias("interpolated"))


def ball_track(balls: DataFrame, frames: DataFrame, people: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(shot, frame, cx, cy, conf, interpolated)."""
    return interpolate(select_ball(candidate_table(balls, frames), people, scratch), ["shot"], "frame", ["cx", "cy"], ["conf"])


def thin_labels(rows: DataFrame, key: str, order: str, apart: int = 3) -> DataFrame:
    """(key, order), longs: per key, the first row and then each row at least `apart` after the last one kept. Sorted rows are streamed; only the last kept place is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for b in batches:
            keep = []
            for k, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keep.append(last is None or k != now or at - last >= apart)
                if keep[-1]:
                    now, last = k, at
            yield b.filter(pa.array(keep, pa.bool_()))

    places = rows.select(F.col(key).cast("long").alias(key), F.col(order).cast("long").alias(order)).where(F.col(order).isNotNull()).distinct()
    return places.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, f"`{key}` long, `{order}` long")


def first_candidates(rows: DataFrame, keys: list[str], order: str, n: int = 6) -> DataFrame:
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_nth") <= n).drop("_nth")
