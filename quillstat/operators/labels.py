"""Training crops around the ball: where each is cut, its label line and its place in the data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.functions.scalar import half_even

#: A crop's side and least margin, the least side of a labelled ball, every how many shots one is kept for validation.
SIZE, MARGIN, LEAST_BALL, VALIDATION = 640, 60, 14, 5


def uniform(seed: int, counter: Column, draw: str) -> Column:
    """A number in [0, 1) from a seed, a row's counter (text) and the draw's name: the first 32 bits of their md5. The same on any engine, in any order, for any partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), counter, F.lit(draw))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def crops(candidates: DataFrame, width: int, height: int, size: int = SIZE, seed: int = 0) -> DataFrame:
    """The candidates (shot, frame, cx, cy, w, h, positive) with name, split, ox, oy and label.

    A crop of `size` pixels holds the candidate at a random place, MARGIN inside where the picture allows it. The label
    has the ball's centre and sides as shares of the crop; negatives have none. Every VALIDATION-th shot is validation.
    """
    kind = F.when(F.col("positive"), "p").otherwise("n")
    name = F.concat(F.lit("s"), F.col("shot").cast("string"), F.lit("_f"), F.col("frame").cast("string"), F.lit("_"), kind)
    off = lambda c, draw, side: F.greatest(F.lit(0), F.least(F.lit(side - size), (F.col(c) - (MARGIN + uniform(seed, F.col("name"), draw) * (size - 2 * MARGIN))).cast("int")))
    out = candidates.withColumn("name", name).withColumns({"ox": off("cx", "x", width), "oy": off("cy", "y", height)})
    share = lambda v: F.format_string("%.6f", half_even(v, 6))
    x, y = (F.col("cx") - F.col("ox")) / size, (F.col("cy") - F.col("oy")) / size
    sides = [F.greatest(F.col(c).cast("double"), F.lit(float(LEAST_BALL))) / size for c in ("w", "h")]
    label = F.when(F.col("positive"), F.concat_ws(" ", F.lit("0"), share(x), share(y), *[share(s) for s in sides])).otherwise("")
    return out.withColumns({"split": F.when(F.col("shot") % VALIDATION == 0, "val").otherwise("train"), "label": label})


def hard_negatives(candidates: DataFrame, seed: int = 0) -> DataFrame:
    """All positives and as many negatives, those first in a seeded order: no window, two counts and a top-n."""
    n = candidates.agg(F.count_if("positive")).first()[0]
    kept = candidates.where(~F.col("positive")).orderBy(uniform(seed, F.concat_ws("_", "shot", "frame", "cx", "cy"), "order"), "shot", "frame", "cx", "cy").limit(n)
    return candidates.where("positive").unionByName(kept)


def label_files(cropped: DataFrame) -> DataFrame:
    """(path, content) of the label files and of the data set's description."""
    text = F.when(F.col("label") == "", "").otherwise(F.concat("label", F.lit("\n")))
    return cropped.select(F.concat(F.lit("labels/"), "split", F.lit("/"), "name", F.lit(".txt")).alias("path"), F.encode(text, "utf-8").alias("content"))


def description(cropped: DataFrame, root: str) -> DataFrame:
    """(path, content): data.yaml, one row."""
    body = f"path: {root}\ntrain: images/train\nval: images/val\nnames:\n  0: ball\n"
    return cropped.sparkSession.createDataFrame([("data.yaml", bytearray(body.encode()))], "path string, content binary")
