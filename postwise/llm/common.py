"""Shared pieces of the training-data operators.

Texts reach Python as UTF-8 bytes (a ``binary`` cast), in Arrow batches. A batch
holds whole texts, so its size is bounded in bytes as well as in rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, storage_root

#: White space between words, as a Java / RE2 character class body.
SPACE = r"\x20\x09-\x0D"
WORD = r"[^\x20\x09-\x0D]+"


def text_bytes(text: Column | str) -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col.cast("string").cast("binary"), F.lit(b""))


def crc_text(col: Column) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def held_out(col: Column, parts: int = 4, part: int = 2) -> Column:
    return F.pmod(crc_text(col), F.lit(parts)) == part


def n_words(text: Column | str) -> Column:
    """Number of words of a text (null: 0), JVM-side."""
    col = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.coalesce(col.cast("string"), F.lit("")), f"[{SPACE}]+")
    # split leaves an empty string before leading and after trailing space
    return (F.size(parts) - F.when(parts[0] == "", 1).otherwise(0)
            - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)).cast("long")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the
    lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


__all__ = ["Column", "DataFrame", "F", "SPACE", "SparkSession", "StorageLevel", "WORD", "crc_text",
           "held_out", "local_rows", "n_words", "pa", "scratch_path", "storage_root", "text_bytes", "written"]
