"""Score time-series: change detection, scoring runs, leads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstat.functions.scalar import elapsed_minutes, half_even, number


def score_timeline(pbp: DataFrame, key: str = "game_id", order: str = "ord") -> DataFrame:
    """(key, ord, minute, home, away, margin): rows where the score changes, after a zero row of ord -1.

    Rows without both scores go, and so do period markers after the first period.
    """
    rows = pbp.select(key, F.col(order).alias("ord"), "period", elapsed_minutes(F.col("period"), F.col("clock")).alias("minute"), number(F.col("scoreHome")).cast("long").alias("home"), number(F.col("scoreAway")).cast("long").alias("away"), "actionType")
    rows = rows.where("home IS NOT NULL AND away IS NOT NULL AND (coalesce(actionType, '') <> 'period' OR period = 1)")
    return score_changes(rows, key)


def score_changes(rows: DataFrame, key: str) -> DataFrame:
    """rows: (key, ord, minute, home, away). Keeps each first row and those whose score differs from the row before."""
    w = Window.partitionBy(key).orderBy("ord")
    moved = F.lag("home").over(w).isNull() | (F.lag("home").over(w) != F.col("home")) | (F.lag("away").over(w) != F.col("away"))
    kept = rows.withColumn("_moved", moved).where("_moved").select(key, "ord", "minute", "home", "away")
    zero = rows.select(key).distinct().select(key, F.lit(-1).cast("long").alias("ord"), F.lit(0.0).alias("minute"), F.lit(0).cast("long").alias("home"), F.lit(0).cast("long").alias("away"))
    return zero.unionByName(kept.withColumn("ord", F.col("ord").cast("long"))).withColumn("margin", F.col("home") - F.col("away"))


def scoring_runs(timeline: DataFrame, key: str, top: int = 5) -> DataFrame:
    """(key, side, start, end, points): unanswered points; a run ends when the other side next scores, the last with the timeline. The `top` largest of each key, earlier ones first on ties."""
    w = Window.partitionBy(key).orderBy("ord")
    gains = timeline.select(key, "ord", "minute", (F.col("home") - F.lag("home").over(w)).alias("dh"), (F.col("away") - F.lag("away").over(w)).alias("da"), F.max("minute").over(Window.partitionBy(key)).alias("last"))
    side = F.when(F.col("dh") > 0, "home").when(F.col("da") > 0, "away")
    scored = gains.withColumn("side", side).where("side IS NOT NULL").withColumn("points", F.when(F.col("side") == "home", F.col("dh")).otherwise(F.col("da")))
    turn = F.coalesce(F.col("side") != F.lag("side").over(w), F.lit(True)).cast("int")
    runs = scored.withColumn("_turn", turn).withColumn("run", F.sum("_turn").over(w)).groupBy(key, "run", "side", "last").agg(F.sum("points").alias("points"), F.min("minute").alias("start"))
    order = Window.partitionBy(key).orderBy("run")
    runs = runs.withColumn("end", F.coalesce(F.lead("start").over(order), F.col("last")))
    best = Window.partitionBy(key).orderBy(F.desc("points"), "run")
    return runs.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= top).select(key, "nth", "side", half_even(F.col("start"), 1).alias("start"), half_even(F.col("end"), 1).alias("end"), "points")


def leads(timeline: DataFrame, key: str) -> DataFrame:
    """(key, home_lead, away_lead, lead_changes): largest leads, and sign changes of the margin from one row to the next."""
    w = Window.partitionBy(key).orderBy("ord")
    swapped = F.lag("margin", 1, 0).over(w) * F.col("margin") < 0
    return timeline.withColumn("_swap", swapped).groupBy(key).agg(F.greatest(F.max("margin"), F.lit(0)).alias("home_lead"), F.greatest(-F.min("margin"), F.lit(0)).alias("away_lead"), F.count_if("_swap").alias("lead_changes"))


def count_pattern(df: DataFrame, text: str, pattern: str, key: str) -> DataFrame:
    """(key, n): rows whose text holds the pattern, case-sensitively."""
    return df.where(F.col(text).rlike(pattern)).groupBy(key).agg(F.count("*").alias("n"))
