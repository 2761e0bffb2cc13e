"""The corpus pipeline: stages over `documents`, each written as Parquet and reread as the next one's input.

1 language_id: documents without a language (no letter) or with a calibrated probability under MIN_SCORE go.
2 line_dedup: lines that many documents repeat go; the document of the largest doc_id keeps them.
3 simhash: of each group of near copies, by fingerprints of five-word shingles and their trie join first (near_copies.py), the document of the least doc_id stays, once.
4 decontaminate: documents that hold a benchmark passage go.
5 byte_bpe: what is left is encoded and decoded: (doc_id, n_tokens, ids_sha256, decoded_sha256).

Stages decide by row, and keep all columns of the documents they leave, whatever their names: the columns travel as one
struct beside those a stage works on. With no labelled document to learn from, stage 1 keeps what has a letter. A document is a doc_id, null or not, with its
text: rows that share an id but not the text are judged apart, rows that share both are one document. An empty table, or
one that a stage empties, passes all stages and gives no rows; texts of any length are handled whole by every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstat.llm import byte_bpe, decontaminate, language_id, line_dedup, near_copies
from quillstat.llm.common import Scratch, table, text_of
from quillstat.shipping import ship

MIN_SCORE = 0.5


def _held(docs: DataFrame, *columns: Column) -> DataFrame:
    """All columns of a document as `held_row`, and those given."""
    return docs.select(F.struct("*").alias("held_row"), *columns)


def _freed(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of `docs` again, but for those changed."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("held_row").getField(c).alias(c) for c in docs.columns])


def _row_key() -> Column:
    """128 bits of doc_id and text: rows that share it are the same document."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text_of())))


def _language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents' own labels outside the held-out fold, as the operator's query does."""
    model = language_id.train(docs, ~language_id.held_out())
    if not model.langs:
        return docs.where(text_of().rlike(r"\p{L}"))
    judged = language_id.predict(_held(docs, F.col("text")), model)
    return _freed(judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE)), docs)


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the new text."""
    rest = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c != "text"])
    kept = line_dedup.dedup_lines(docs.select(rest.alias("held_row"), "doc_id", "text"))
    return _freed(kept, docs, text=F.col("text"), n_chars=F.length("text").cast("long"))


def _simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies are texts whose sets of five-word shingles are similar by 0.8 or more: fingerprints and their trie join find the closest, bands the pairs that a few bits lose, and each pair is compared exactly."""
    keepers = near_copies.keepers(docs.select(_row_key().alias("key"), "doc_id", text_of().alias("text")))
    keyed = _held(docs, _row_key().alias("row_key"))
    # One of the rows that are equal in doc_id and text, by a column of any type; the join then finds them dealt by its key.
    whole = F.to_json("held_row")
    once = Window.partitionBy("row_key").orderBy(F.xxhash64(whole), whole)
    kept = keyed.withColumn("copy", F.row_number().over(once)).where("copy = 1")
    return _freed(kept.join(keepers.hint("merge"), F.col("row_key") == F.col("key"), "left_semi"), docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaks are found by a key of each document, so that rows which share a doc_id are judged apart."""
    keyed = _held(docs, F.xxhash64(_row_key()).alias("leak_key"))
    rows = docs.select(F.xxhash64(_row_key()).alias("doc_id"), "text")
    leaks = decontaminate.find_leaks(rows, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leaking")).distinct()
    return keyed.join(leaks.hint("merge"), F.col("leak_key") == F.col("leaking"), "left_anti").transform(lambda kept: _freed(kept, docs))


def _byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _prepared(stage):
    """Stage tables hold whole texts and are written with zstd: its codec works in the heap, while the direct buffers of
    the default one (snappy) pile up beside it, to the size of the heap, until a full collection. A stage's caller writes
    its table, so the setting stays for the session; `run` puts it back.
    """

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
        return stage(ship(spark), docs, sf_dir)

    return run


STAGES = [
    ("language_id", _prepared(_language_id)),
    ("line_dedup", _prepared(_line_dedup)),
    ("simhash", _prepared(_simhash)),
    ("decontaminate", _prepared(_decontaminate)),
    ("byte_bpe", _prepared(_byte_bpe)),
]

#: SQL can express neither the classifier, the fingerprints nor the merges: tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns for `documents`."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    codec, before = "spark.sql.parquet.compression.codec", None
    own = spark.conf.get(codec)
    try:
        for name, stage in STAGES[:-1]:
            docs = scratch.write(stage(spark, docs, sf_dir), name)
            if before is not None:
                scratch.remove(before)
            before = name
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        spark.conf.set(codec, own)
