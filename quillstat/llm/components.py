"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is an aggregation and a join over links; nothing is collected. The minima are written before they are
joined, so that both sides of the join arrive by an exchange and a node with very many links can be split (AQE skew join).
A round at most doubles the links twice over; their number, counted each round, decides how many files a table has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import Scratch

MAX_ROUNDS = 60


def _star(links: DataFrame, scratch: Scratch, name: str, rows: int) -> DataFrame:
    """links: (u, v), each to be seen from u. Hangs every v and u on the least node around u."""
    least = scratch.write(links.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m")), f"{name}-least", rows)
    return links.join(least, "u")


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links: (u, v) long of a written table, any direction, u != v. Returns (node, root) for every node but the roots; a root is the least node of its component."""
    rows = 2 * links.count()
    now = scratch.write(links.select(*_pairs(F.col("u"), F.col("v"))).distinct(), "links-0", rows)
    before = None
    for k in range(1, MAX_ROUNDS + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, scratch, f"large-{k}", rows).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(large.where(F.col("u") != F.col("v")).distinct(), f"large-{k}", rows)
        hung = _star(large, scratch, f"small-{k}", rows)
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v")))
        now = scratch.write(small.where(F.col("u") != F.col("v")).distinct(), f"links-{k}", 2 * rows)
        # The set of links is a fixed point once its size and hash sum stay the same.
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, rows = state, 2 * state[0]
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
