"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over a threshold, reassemble by position.

A line's key is the line without ASCII space at both ends, A-Z lower-cased. Keys of at least `min_chars` code points in
at least `min_docs` distinct documents lose all their lines, except those of the largest doc_id holding the key.

Only (document, position, 128-bit key hash) is shuffled to count; the count runs on partial distinct sums, so a key that
every document holds is as cheap as any other. Dropped positions come back as one array a document.

Defined cases: a null or empty text is one empty line; rows with the same doc_id count as one document and each keeps
its own lines; a null doc_id counts as one document that is smaller than all others (and is told apart from no
other id but the least long); an empty table gives no rows; a long text is one array of its lines while its row is at work;
other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm.common import ASCII_LOWER, ASCII_SPACE, ASCII_UPPER, Scratch, table, text_of

MIN_CHARS, MIN_DOCS = 40, 5
_NO_ID = -(2**63)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(ASCII_SPACE)), ASCII_UPPER, ASCII_LOWER)


def dropped_lines(docs: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(d, fp, n, gone): for each row of `docs` that loses lines its doc_id (null: the least long), text hash, text length and the array of positions that go."""
    long_lines = (
        docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), text_of().alias("t"))
        .select("d", F.xxhash64("t").alias("fp"), F.length("t").alias("n"), F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .withColumn("key", F.btrim("line", F.lit(ASCII_SPACE)))
        .where(F.length("key") >= min_chars)
        .withColumn("key", line_key(F.col("key")))
        .select("d", "fp", "n", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second half"), "key").alias("h2"))
    )
    long_lines = scratch.write(long_lines, "lines")
    common = (
        long_lines.groupBy("h1", "h2")
        .agg(F.count_distinct("d").alias("n_docs"), F.max("d").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    common = scratch.write(common, "common")
    gone = (
        long_lines.join(common, ["h1", "h2"])
        .where(F.col("d") != F.col("keeper"))
        .groupBy("d", "fp", "n")
        .agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    )
    return scratch.write(gone, "gone")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The columns of `docs` with the lines that stay as `text` (a null text of a document that loses nothing stays null), and n_lines, n_dropped (long)."""
    spark = docs.sparkSession
    gone = dropped_lines(docs, Scratch(spark, "line-dedup"), min_chars, min_docs)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), F.xxhash64(text_of()).alias("fp"), F.length(text_of()).alias("n"))
    lines = F.split(text_of("row.text"), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    # A merge join at every size: the texts move once, and disk grows in proportion to the input.
    out = rows.join(gone.hint("merge"), ["d", "fp", "n"], "left").withColumn("lines", lines)
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    new_text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("lines", i + 1)), "\n"))
    return out.select(
        *[new_text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names],
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(text_of(), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
flagged AS (
  SELECT y.doc_id, y.pos, y.line, c.k IS NOT NULL AND y.doc_id <> c.keeper AS gone
  FROM keyed y LEFT JOIN common c ON y.k = c.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
