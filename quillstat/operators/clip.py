"""Clip-level tables: cuts and segments, coverage, banners, thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstat.functions.scalar import half_even
from quillstat.operators.possession import latest_before


def _median(values: Column) -> Column:
    v, n = F.array_sort(values), F.size(values)
    middle = (F.element_at(v, (n / 2 + 0.5).cast("int")) + F.element_at(v, (n / 2).cast("int") + 1)) / 2
    return F.when(n > 0, middle)


def detect_cuts(diffs: DataFrame, order: str, grey: str, hist: str, key: str, threshold: float = 0.35, spike_min: float = 10.0, spike_ratio: float = 3.5) -> DataFrame:
    """(key, order): rows where the grey difference spikes over the median of six rows on either side (itself and row 0 left out), or the histogram distance is large."""
    w = Window.partitionBy(key).orderBy(order)
    real = F.when(F.row_number().over(w) > 1, F.col(grey))
    near = diffs.withColumn("_d", real)
    around = F.concat(F.collect_list("_d").over(w.rowsBetween(-6, -1)), F.collect_list("_d").over(w.rowsBetween(1, 6)))
    near = near.withColumn("_m", _median(around))
    spike = (F.col("_d") > spike_min) & (F.col("_d") > spike_ratio * F.greatest(F.coalesce("_m", F.lit(0.0)), F.lit(1.0)))
    return near.where(spike | (F.col(hist) > threshold)).select(key, order).distinct()


def frame_features(frames: DataFrame, key: str, order: str, values: str, bins: int, low: float, high: float) -> DataFrame:
    """(key, order, grey, hist), what `detect_cuts` takes: the mean absolute change of a frame's values to the frame before, and the Bhattacharyya distance (0 equal, 1 disjoint) of their histograms; both 0 on a key's first frame.

    Values outside [low, high) are in no bin, null ones in neither. Frames of other length differ in the values they share;
    two histograms without any value are equal, one without is disjoint from any other.
    """
    w = Window.partitionBy(key).orderBy(order)
    spot = lambda v: F.floor((v - low) / ((high - low) / bins)).cast("int")
    binned = F.transform(F.filter(values, lambda v: (v >= low) & (v < high)), spot)
    counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter("_bins", lambda k: k == b)).cast("double"))
    rows = frames.select(key, order, F.col(values).alias("_v"), binned.alias("_bins")).withColumn("_h", counts).drop("_bins")
    rows = rows.withColumns({"_v0": F.lag("_v").over(w), "_h0": F.lag("_h").over(w), "_first": F.row_number().over(w) == 1})
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    moved = F.filter(F.zip_with("_v", "_v0", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), lambda x: x.isNotNull())
    grey = F.coalesce(F.try_divide(add(moved), F.size(moved)), F.lit(0.0))
    own, before = add(F.col("_h")), add(F.col("_h0"))
    shared = F.when((own == 0) & (before == 0), 1.0).otherwise(F.coalesce(F.try_divide(add(F.zip_with("_h", "_h0", lambda a, b: F.sqrt(a * b))), F.sqrt(own * before)), F.lit(0.0)))
    return rows.select(key, order, F.when(F.col("_first"), 0.0).otherwise(grey).alias("grey"), F.when(F.col("_first"), 0.0).otherwise(F.sqrt(F.greatest(1.0 - shared, F.lit(0.0)))).alias("hist"))


def segments(cuts: DataFrame, totals: DataFrame, order: str, key: str, least: int) -> DataFrame:
    """(key, start, end): spans between cuts, from 0 to the key's total, of at least `least`."""
    marks = cuts.select(key, F.col(order).alias("start")).unionByName(totals.select(key, F.lit(0).cast("long").alias("start"))).distinct().join(totals.select(key, "total"), key)
    end = F.coalesce(F.lead("start").over(Window.partitionBy(key).orderBy("start")), F.col("total"))
    return marks.withColumn("end", end).where(F.col("end") - F.col("start") >= least).select(key, "start", "end")


def coverage(spine: DataFrame, rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(n_spine, median_rows, share_full): rows a place of the spine holds, empty places counted as zero."""
    counts = spine.select(*keys).distinct().join(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return counts.agg(F.count("*").alias("n_spine"), F.median("n").cast("double").alias("median_rows"), half_even(F.avg((F.col("n") >= least).cast("double")), 3).alias("share_full"))


def banners(frames: DataFrame, events: DataFrame, key: str, what: str, length: int = 36) -> DataFrame:
    """(key, frame, what): the latest event that began at most `length` frames before, on a frame that is shown or not; null without one."""
    last = events.groupBy(key, "frame").agg(F.max(what).alias(what)).withColumn("_at", F.col("frame"))
    seen = latest_before(frames, last, key, "frame", "_at", what)
    return seen.select(key, "frame", F.when(F.col("frame") - F.col("_at") <= length, F.col(what)).alias(what))


def next_frame(frames: DataFrame, key: str, frame: str, at: int) -> DataFrame:
    return frames.where(F.col(frame) >= at).groupBy(key).agg(F.min(frame).alias(frame))


def thin_frames(frames: DataFrame, key: str, frame: str, start: int, length: int = 300, every: int = 6) -> DataFrame:
    """Each `every`-th distinct frame of a span."""
    span = frames.where((F.col(frame) >= start) & (F.col(frame) < start + length)).select(key, frame).distinct()
    return span.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(frame)) - 1).where(F.col("_n") % every == 0).select(key, frame)


def best_per_bin(rows: DataFrame, bin_of: Column, score: str, *columns: str) -> DataFrame:
    """The row of the highest score in each bin (ties: the greatest columns)."""
    return rows.groupBy(bin_of.alias("bin")).agg(F.max(F.struct(score, *columns)).alias("_b")).select("bin", F.col(f"_b.{score}").alias(score), *[F.col(f"_b.{c}").alias(c) for c in columns])
