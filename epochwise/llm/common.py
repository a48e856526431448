"""Helpers shared by the text operators.

Every operator reads its id and text column by name and drops all others first,
so extra columns, whatever they are called, never reach its expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"

# Bits of one native bitmap (bitmap_construct_agg) and the number of bitmaps of a filter.
_BITMAP_BITS = 32768
_BITMAPS = 4096


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def named(column: str) -> Column:
    """A column by its plain name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only; a null text is an empty one."""
    return docs.select(
        named(id_col).alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text")
    )


def squeezed(text: Column) -> Column:
    """The text without any white space."""
    return F.translate(text, SPACE_CHARS, "")


def bitmap_of(hashed: Column) -> tuple[Column, Column]:
    """Bitmap number (12 bits) and place in it (15 bits) of a 64-bit hash: its top 27 bits."""
    return (
        F.shiftrightunsigned(hashed, 52),
        F.shiftrightunsigned(hashed, 37).bitwiseAND(F.lit(_BITMAP_BITS - 1)),
    )


def has_bit(bitmap: Column, place: Column) -> Column:
    """Whether a bitmap's bit is set."""
    byte = F.conv(F.hex(F.substring(bitmap, (place / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.getbit(byte.cast("int"), (place % 8).cast("int")) == 1


def marked_by_bitmaps(df: DataFrame, hashed: Column, bitmaps: DataFrame, mark: str) -> DataFrame:
    """Add a column ``mark``: whether the hash has its bit in ``bitmaps`` (bitmap_no, bitmap).

    Nothing is shuffled: at most 4,096 bitmaps of 4 KB, 16 MB whatever the size of
    the data, are broadcast. Other rows may be marked by collision; what follows
    must be exact.
    """
    number, place = bitmap_of(F.col("_hash"))
    joined = (
        df.withColumn("_hash", hashed)
        .withColumn("_bitmap_no", number)
        .join(F.broadcast(bitmaps.toDF("_bitmap_no", "_bitmap")), "_bitmap_no", "left")
    )
    marked = F.coalesce(has_bit(F.col("_bitmap"), place), F.lit(False))
    return joined.withColumn(mark, marked).drop("_hash", "_bitmap_no", "_bitmap")


def bitmaps_from(df: DataFrame, hashed: Column) -> DataFrame:
    """The bitmaps of the hashes of ``df``."""
    number, place = bitmap_of(F.col("_hash"))
    return (
        df.select(hashed.alias("_hash"))
        .groupBy(number.alias("bitmap_no"))
        .agg(F.expr(f"bitmap_construct_agg({_BITMAP_BITS - 1} & shiftrightunsigned(_hash, 37))").alias("bitmap"))
    )
