"""Plane maps from point pairs: least squares by aggregates, consensus against outliers, growth of reference views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.functions.scalar import inverse, project
from quillstat.scratch import Scratch

#: A pivot below this (places are scaled to about one) means that the pairs do not fix a map.
FLAT = 1e-12


def solved(rows: Column, n: int) -> Column:
    """The solution of n linear equations, given as n rows of n + 1 numbers whose matrix is positive definite; null members where it is not."""

    def step(m: Column, k: Column) -> Column:
        lead = F.element_at(m, k + 1)
        unit = F.transform(lead, lambda v: F.when(F.element_at(lead, k + 1) > FLAT, v / F.element_at(lead, k + 1)))
        return F.transform(m, lambda row, i: F.when(i == k, unit).otherwise(F.zip_with(row, unit, lambda a, b: a - F.element_at(row, k + 1) * b)))

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), rows, step), lambda row: F.element_at(row, n + 1))


def _normal(weight: str) -> tuple[list[Column], Column]:
    """Aggregates m0, m1.. and the rows of the normal equations made of them: map (a, b) to (p, q), its last number 1."""
    first = ["a", "b", "1", None, None, None, "-p * a", "-p * b", "p"]
    second = [None, None, None, "a", "b", "1", "-q * a", "-q * b", "q"]
    sums, at = [], {}
    for i in range(8):
        for j in range(i, 9):
            parts = [f"({r[i]}) * ({r[j]})" for r in (first, second) if r[i] and r[j]]
            if parts:
                at[i, j] = f"m{len(sums)}"
                sums.append(F.expr(f"sum({weight} * ({' + '.join(parts)})) AS m{len(sums)}"))
    cell = lambda i, j: at.get((min(i, j), max(i, j)), "0.0D")
    return sums, F.expr("array(" + ", ".join("array(" + ", ".join(cell(i, j) for j in range(9)) + ")" for i in range(8)) + ")")


def fit(pairs: DataFrame, keys: list[str], rounds: int = 2) -> DataFrame:
    """(keys, h, n): for each key the map (array of 9, row by row, the last 1) that takes its (x, y) to (u, v), and the number of pairs; h is null where they fix none (under four, or on a line).

    Places are centred and scaled, the normal equations are sums, and a small system is solved in columns. The first
    solution minimises the algebraic error; each further round weighs pairs by the depth the last one gives them, which
    comes near the least squared distance. Pairs with a null place don't count.
    """
    pairs = pairs.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("x", "y", "u", "v")]).dropna(subset=["x", "y", "u", "v"])
    scale = lambda c, d: F.try_divide(F.lit(2.0) ** 0.5, F.sqrt(F.var_pop(c) + F.var_pop(d)))
    stats = pairs.groupBy(*keys).agg(*[F.avg(c).alias(f"_m{c}") for c in ("x", "y", "u", "v")], scale("x", "y").alias("_s"), scale("u", "v").alias("_t"), F.count("*").alias("n"))
    placed = lambda c, s: (F.col(c) - F.col(f"_m{c}")) * F.col(s)
    scaled = pairs.join(stats.drop("n"), keys).select(*keys, placed("x", "_s").alias("a"), placed("y", "_s").alias("b"), placed("u", "_t").alias("p"), placed("v", "_t").alias("q"))
    g = None
    for _ in range(rounds + 1):
        rows = scaled if g is None else scaled.join(g, keys)
        sums, normal = _normal("1.0D" if g is None else "try_divide(1.0D, pow(_g[6] * a + _g[7] * b + 1, 2))")
        g = rows.groupBy(*keys).agg(*sums).select(*keys, solved(normal, 8).alias("_g"))
    m = [F.col("_g")[k] for k in range(8)] + [F.lit(1.0)]
    s, t = F.col("_s"), F.col("_t")
    # Back from scaled places: first the source's, then the target's.
    from_source = [e for k in (0, 3, 6) for e in (m[k] * s, m[k + 1] * s, m[k + 2] - s * (m[k] * F.col("_mx") + m[k + 1] * F.col("_my")))]
    whole = [from_source[k] / t + F.col(c) * from_source[6 + k % 3] for k, c in enumerate(["_mu"] * 3 + ["_mv"] * 3)] + from_source[6:]
    h = F.array(*[F.try_divide(c, whole[8]) for c in whole])
    full = (F.col("n") >= 4) & F.forall(h, lambda c: c.isNotNull() & ~F.isnan(c))
    return stats.join(g, keys).select(*keys, F.when(full, h).alias("h"), "n")


def distance(h: Column) -> Column:
    """How far (x, y) falls from (u, v) under the map h; null at infinity."""
    u, v = project([h[k] for k in range(9)], F.col("x"), F.col("y"))
    return F.hypot(u - F.col("u"), v - F.col("v"))


def residuals(pairs: DataFrame, maps: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs with `residual`, their distance under their key's map."""
    return pairs.join(maps.select(*keys, "h"), keys, "left").withColumn("residual", distance(F.col("h"))).drop("h")


def consensus(pairs: DataFrame, keys: list[str], within: float, trials: int = 64, seed: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """(keys, h, n, n_inliers, rms): `fit` against outliers, the same on every run.

    A trial deals a key's pairs into four lots by a hash of trial and pair and takes the least pair of each; the trial
    whose exact map has most pairs within the distance wins (the earliest of equals). The map is then fitted to those
    pairs, and once more to the pairs within the distance of that. All steps are partial aggregates by key, so a key
    with very many pairs is no single task's. The pairs and each step's maps are written to `scratch`, so no step repeats another.
    """
    scratch = scratch or Scratch(pairs.sparkSession, "consensus")
    pairs = scratch.write(pairs.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("x", "y", "u", "v")]).dropna(subset=["x", "y", "u", "v"]), "pairs")
    tried = pairs.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    draw = F.xxhash64(F.lit(seed), "trial", "x", "y", "u", "v")
    least = tried.groupBy(*keys, "trial", F.pmod(draw, F.lit(4)).alias("_lot")).agg(F.min(F.struct(F.shiftright(draw, 2).alias("_d"), "x", "y", "u", "v")).alias("_p"))
    drawn = scratch.write(least.select(*keys, "trial", "_p.*").drop("_d"), "drawn")
    exact = scratch.write(fit(drawn, [*keys, "trial"], 0).where(F.col("h").isNotNull()), "exact")
    packed = exact.groupBy(*keys).agg(F.collect_list(F.struct("trial", "h")).alias("_tried"))  # `trials` of them at most
    met = pairs.join(packed, keys).select(*keys, "x", "y", "u", "v", F.explode("_tried").alias("_e"))
    votes = met.groupBy(*keys, F.col("_e.trial").alias("trial")).agg(F.count_if(distance(F.col("_e.h")) <= within).alias("votes"))
    best = votes.groupBy(*keys).agg(F.max(F.struct("votes", (-F.col("trial")).alias("trial"))).alias("_b")).select(*keys, (-F.col("_b.trial")).alias("trial"))
    maps = exact.join(best, [*keys, "trial"]).select(*keys, "h")
    for k in range(2):
        near = scratch.write(residuals(pairs, maps, keys).where(F.col("residual") <= within), f"near-{k}")
        maps = scratch.write(fit(near, keys).select(*keys, "h"), f"maps-{k}")
    found = residuals(pairs, maps, keys)
    inlier = F.col("residual") <= within
    counts = found.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(inlier).alias("n_inliers"), F.sqrt(F.avg(F.when(inlier, F.col("residual") * F.col("residual")))).alias("rms"))
    return counts.join(maps, keys, "left").select(*keys, "h", "n", "n_inliers", "rms")


def centre_x(h: Column, width: float = 1280.0, height: float = 720.0) -> Column:
    """The court X under the middle of a view, given its map from the court."""
    return project(inverse([h[k] for k in range(9)]), F.lit(width / 2), F.lit(height / 2))[0]


def grow_references(matches: DataFrame, start: DataFrame, rounds: int = 3, min_inliers: int = 60, min_score: float = 2.0, bin_m: float = 2.5, most: int = 300, scratch: Scratch | None = None) -> DataFrame:
    """(ref, court_x, round): `start` (ref, court_x; round 0) and the frames added to it as references, for parts of the court that the others cover poorly.

    matches: (frame, ref, inliers, score, court_x), what registering a frame on a reference would give. Each round
    registers every frame on its best reference (most inliers, the earliest and then the least ref of equals), scores it
    anew with that, and adds the best frame (score x inliers, `most` at most; the least frame of equals) of every part of
    `bin_m` metres not covered. It stops after `rounds`, or when a round adds none. Rounds are written, so each costs one
    pass over the matches.
    """
    scratch = scratch or Scratch(matches.sparkSession, "references")
    part = F.rint(F.col("court_x") / bin_m).cast("long").alias("bin")
    refs = scratch.write(start.select(F.col("ref").cast("long").alias("ref"), F.col("court_x").cast("double").alias("court_x"), F.lit(0).alias("round")), "refs-0")
    good = matches.where((F.col("inliers") >= min_inliers) & F.col("score").isNotNull() & ~F.isnan("score") & F.col("court_x").isNotNull())
    for k in range(1, rounds + 1):
        usable = good.join(refs.select("ref", "round"), "ref")
        order = F.struct("inliers", (-F.col("round")).alias("r"), (-F.col("ref")).alias("f"))
        best = usable.groupBy("frame").agg(F.max_by(F.struct("score", "inliers", "court_x"), order).alias("_m")).select("frame", "_m.*").where(F.col("score") >= min_score)
        free = best.select("*", part).join(refs.select(part).distinct(), "bin", "left_anti")
        quality = F.col("score") * F.least("inliers", F.lit(most))
        added = free.groupBy("bin").agg(F.max_by(F.struct("frame", "court_x"), F.struct(quality.alias("q"), (-F.col("frame")).alias("f"))).alias("_a"))
        fresh = added.select(F.col("_a.frame").cast("long").alias("ref"), F.col("_a.court_x").cast("double").alias("court_x"), F.lit(k).alias("round"))
        grown = scratch.write(refs.unionByName(fresh), f"refs-{k}")
        if grown.where(F.col("round") == k).isEmpty():
            return refs
        refs = grown
    return refs
