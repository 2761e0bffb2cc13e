"""Benchmark decontamination by spaced seeds, with built-in functions only.

Tokens are runs of letters and digits, lower-cased. A spaced seed is a hash over the tokens that a fixed mask keeps; the
masks ignore the positions between them. Seeds of the test items and of every document position are joined; around a hit,
document and item are laid over each other on that diagonal and compared token by token.

A document is contaminated by an item if WINDOW consecutive tokens of the item (all of them, if it has fewer) stand on
one diagonal with at most a fifth of them substituted. The two MASKS together hit every placement of that many
substitutions in every window of 8 to 20 tokens (a test enumerates them all), so the seeds lose nothing and the result
equals a comparison of all pairs. Items of under EXACT tokens must stand whole and unchanged; those too short for a mask
are hashed as they are. Items of under MIN_ITEM tokens are no evidence and take no part.

The seed table is broadcast as long as it has at most PART rows, else joined by shuffle. A hit counts where its run of
hits on a diagonal starts, so a passage gives a few rows (document, item, diagonal); only documents with such rows are
read as tokens a second time, to be compared.

Defined cases: a null or empty text, of a document or an item, has no tokens and matches nothing; rows with equal doc_id
count as one document, of which the best match of each item is given (null doc_ids likewise); repeated items each match;
unspaced scripts are cut at their clauses only, so they match by whole clauses; an empty table of documents or of items
gives no rows; a long text is one array of its tokens while its row is at work; other columns play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm.common import Scratch, table, text_of

MASKS = ((0, 1, 2, 4), (0, 1, 4, 5))
WINDOW, EXACT, MIN_ITEM = 20, 8, 3
#: Seed rows, and document ids, that are broadcast at most; there is one broadcast of each.
PART, FEW = 500_000, 250_000


def _token_hashes() -> Column:
    words = F.filter(F.split(F.lower(text_of()), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _positions(df: DataFrame, key: str, masks: list[tuple[int, ...]], *keep: str) -> DataFrame:
    """(key, *keep, p, mask, h, before): for each token position p (from 0) and mask its seed and the seed one position earlier; positions whose mask reaches outside are left out.

    No array is carried over to the positions: rows stay a few numbers wide however long a text is.
    """
    # Column x0 is the token before the position.
    span = max(m[-1] for m in masks) + 1
    shifted = [F.concat(F.array(F.lit(None).cast("long")), F.col("wh")), *[F.slice(F.col("wh"), F.lit(k + 1), F.size("wh")) for k in range(span)]]
    rows = df.select(key, *keep, F.posexplode(F.arrays_zip(*[c.alias(f"x{k}") for k, c in enumerate(shifted)])).alias("p", "x"))

    def seed(mask: tuple[int, ...], back: int) -> Column:
        tokens = [F.col(f"x.x{o + 1 - back}") for o in mask]
        return F.when(reduce(lambda a, b: a & b, [t.isNotNull() for t in tokens]), F.xxhash64(*tokens))

    seeds = F.array(*[F.struct(F.lit(k).alias("mask"), seed(m, 0).alias("h"), seed(m, 1).alias("before")) for k, m in enumerate(masks)])
    return rows.select(key, *keep, "p", F.explode(seeds).alias("s")).select(key, *keep, "p", "s.mask", "s.h", "s.before").where(F.col("h").isNotNull())


def _candidates(docs: DataFrame, items: DataFrame, part: int) -> DataFrame:
    """(doc_id, item_id, diag), distinct: the diagonals of all hits, each found where a run of hits starts."""
    lengths = [r.n for r in items.select(F.size("wh").alias("n")).where(F.col("n") <= MASKS[0][-1]).distinct().collect()]
    masks = [*MASKS, *[tuple(range(n)) for n in sorted(lengths)]]
    # A mask without gaps is for the items of its length alone.
    own = reduce(lambda a, k: a | ((F.col("mask") == k) & (F.col("n") == len(masks[k]))), range(len(MASKS), len(masks)), F.col("mask") < len(MASKS))
    seeds = _positions(items.withColumn("n", F.size("wh")), "item_id", masks, "n").where(own)
    seeds = seeds.select("item_id", F.col("p").alias("q"), F.col("mask").alias("i_mask"), F.col("h").alias("i_h"), F.col("before").alias("i_before"))
    places = _positions(docs, "doc_id", masks)
    same = (F.col("mask") == F.col("i_mask")) & (F.col("h") == F.col("i_h"))
    starts = ~(F.col("before").isNotNull() & F.col("i_before").isNotNull() & (F.col("before") == F.col("i_before")))
    seeds = F.broadcast(seeds) if seeds.count() <= part else seeds.hint("merge")
    return places.join(seeds, same & starts).select("doc_id", "item_id", (F.col("p") - F.col("q")).alias("diag")).distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_item: int = MIN_ITEM, part: int = PART, few: int = FEW) -> DataFrame:
    """(doc_id, item_id, matched, compared): the best window of each contaminated pair: equal tokens, of so many."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = scratch.write(benchmark.select(F.col("item_id").cast("long").alias("item_id"), _token_hashes().alias("wh")).where(F.size("wh") >= min_item), "items")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    hashed = source.select("doc_id", _token_hashes().alias("wh")).where(F.size("wh") >= min_item)
    near = scratch.write(_candidates(hashed, items, part), "near")
    ids = near.select(F.col("doc_id").alias("near_id")).distinct()
    # Only texts with a hit are read as tokens again: found by a broadcast of their ids where these are few, else by a merge join.
    ids = F.broadcast(ids) if ids.count() <= few else ids.hint("merge")
    texts = source.join(ids, source["doc_id"].eqNullSafe(ids["near_id"]), "left_semi").select(F.col("doc_id").alias("text_id"), _token_hashes().alias("wh"))
    pairs = texts.join(near, texts["text_id"].eqNullSafe(near["doc_id"])).join(items.select(F.col("item_id").alias("of"), F.col("wh").alias("iw")), F.col("item_id").eqNullSafe(F.col("of")))
    compared = F.least(F.size("iw"), F.lit(window))
    first = F.greatest(-F.col("diag"), F.lit(0))  # of the item's tokens that lie over the document
    over = F.least(F.size("iw"), F.size("wh") - F.col("diag")) - first
    laid = pairs.withColumns({"compared": compared, "first": first, "over": over}).where(F.col("over") >= F.col("compared"))
    same = F.zip_with(F.slice("iw", F.col("first") + 1, F.col("over")), F.slice("wh", F.col("first") + F.col("diag") + 1, F.col("over")), lambda a, b: F.when(a == b, 1).otherwise(0))
    in_window = F.transform(F.sequence(F.lit(1), F.col("over") - F.col("compared") + 1), lambda j: F.aggregate(F.slice("same", j, F.col("compared")), F.lit(0), lambda a, x: a + x))
    return (
        laid.select("doc_id", "item_id", "compared", "over", same.alias("same"))
        .select("doc_id", "item_id", "compared", F.array_max(in_window).alias("matched"))
        .where(F.col("matched") >= F.col("compared") - F.when(F.col("compared") < EXACT, 0).otherwise(F.floor(F.col("compared") / 5)))
        .groupBy("doc_id", "item_id")
        .agg(F.max("matched").cast("long").alias("matched"), F.max("compared").cast("long").alias("compared"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p, len(w) AS n
  FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents)),
i AS (
  SELECT item_id, unnest(w) AS w, generate_subscripts(w, 1) AS q, len(w) AS m
  FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark)
  WHERE len(w) >= 3),
hit AS (SELECT doc_id, item_id, p - q AS diag, q, n, m, least(m, 20) AS c, CASE WHEN m < 8 THEN 0 ELSE least(m, 20) // 5 END AS free FROM d JOIN i USING (w)),
lined AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, diag) AS k FROM hit
  WHERE least(m, n - diag) - greatest(0, -diag) >= c),
counted AS (SELECT doc_id, item_id, c, free, count(*) OVER (PARTITION BY doc_id, item_id, diag ORDER BY q RANGE BETWEEN CURRENT ROW AND c - 1 FOLLOWING) AS matched
  FROM lined WHERE k >= c - free)
SELECT doc_id, item_id, CAST(max(matched) AS BIGINT) AS matched, CAST(max(c) AS BIGINT) AS compared
FROM counted WHERE matched >= c - free GROUP BY doc_id, item_id
"""
