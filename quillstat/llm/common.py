"""Helpers shared by the training-data operators: scratch tables, text columns and schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstat.scratch import Scratch, shared_dir

__all__ = ["ASCII_LOWER", "ASCII_SPACE", "ASCII_UPPER", "Scratch", "bucket_of_id", "shared_dir", "table", "text_of", "with_fields"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: The characters in [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A null text counts as the empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def bucket_of_id(name: str, mod: int) -> Column:
    """crc32(id as text) mod `mod`; a null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % mod


def with_fields(df: DataFrame, more: str) -> StructType:
    """The schema of `df`, whatever its columns are called, and further fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])
