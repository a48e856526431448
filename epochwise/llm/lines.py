"""Boilerplate lines by how many sites they are spread over, in native expressions only.

1. Lines that fewer documents than ``min_sites`` have cannot qualify; counts of line
   hashes settle that, and bitmaps of the others let only those through.
2. Each remaining line gets a HyperLogLog sketch of its sites. Sketches are merged by
   aggregation, in the tasks first: a line that a third of all documents have moves as
   one sketch per task.
3. Lines with an estimate near the threshold get an exact distinct count.
4. Lines at or above the threshold are removed. Only documents that have one are
   shuffled.

Lines are known by a 64-bit hash of the trimmed line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwise.llm.common import SPACE_CHARS, bitmaps_from, marked_by_bitmaps, named
from epochwise.storage import stage

MIN_SITES = 5
_LOG_REGISTERS = 12
# Estimates within this share of the threshold are counted exactly; the sketch's error is 1.6 %.
_NEAR = 0.25


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE_CHARS))


def _hash(line: Column) -> Column:
    """Hash of a line with a word, else null."""
    return F.when(_trimmed(line) != "", F.xxhash64(_trimmed(line)))


def _rows(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    text = F.coalesce(named(text_col), F.lit(""))
    return docs.select(
        named(id_col).alias("doc_id"), text.alias("text"), F.coalesce(named(site_col).cast("string"), F.lit("")).alias("site")
    ).withColumn("text_hash", F.xxhash64("text"))


def _hashes() -> Column:
    """The distinct hashes of a text's lines."""
    return F.array_compact(F.array_distinct(F.transform(F.split("text", "\n", -1), _hash)))


def boilerplate(rows: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line) hashes of lines that at least ``min_sites`` sites have; a null site counts as one."""
    every = rows.select("site", F.explode(_hashes()).alias("line"))
    often = every.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("line")
    often = stage(often, "often")
    shared = marked_by_bitmaps(every, F.xxhash64("line"), bitmaps_from(often, F.xxhash64("line")), "shared")
    shared = shared.where("shared").select("line", "site")
    spread = stage(
        shared.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", _LOG_REGISTERS)).alias("sites")), "spread"
    )
    low, high = min_sites * (1 - _NEAR), min_sites * (1 + _NEAR)
    near = spread.where(F.col("sites").between(low, high)).select("line")
    exact = shared.join(near, "line", "left_semi").distinct().groupBy("line").count().where(F.col("count") >= min_sites)
    return spread.where(F.col("sites") > high).select("line").unionAll(exact.select("line"))


def without_boilerplate(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
) -> DataFrame:
    """doc_id, n_lines, n_removed and the text without lines that are spread over many sites.

    Lines are cut at newlines and compared without white space around them. Every
    occurrence goes, short lines too; lines without a word always stay. Other lines keep
    their order and their bytes. A null text is an empty one (one empty line); null ids
    and repeated rows stay as they are; an empty table gives an empty one.
    """
    rows = _rows(docs, id_col, text_col, site_col)
    lines = stage(boilerplate(rows, min_sites), "boilerplate")
    own = rows.select("doc_id", "text_hash", F.explode(_hashes()).alias("line"))
    hit = marked_by_bitmaps(own, F.xxhash64("line"), bitmaps_from(lines, F.xxhash64("line")), "hit").where("hit")
    bad = (
        hit.join(lines, "line", "left_semi")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("line").alias("bad"))
        .toDF("_doc", "_hash", "bad")
    )
    bad = stage(bad, "bad-lines")
    marked = marked_by_bitmaps(rows, F.xxhash64("text_hash"), bitmaps_from(bad, F.xxhash64("_hash")), "hit")
    none = F.expr("cast(array() as array<long>)")
    touched = marked.where("hit").join(bad, F.expr("text_hash = _hash and doc_id <=> _doc"), "left")
    both = (
        marked.where("not hit").select("doc_id", "text", none.alias("bad"))
        .unionAll(touched.select("doc_id", "text", F.coalesce("bad", none)))
    )
    split = F.split("text", "\n", -1)
    kept = F.filter(split, lambda x: ~F.coalesce(F.array_contains("bad", _hash(x)), F.lit(False)))
    counted = both.select("doc_id", F.size(split).cast("long").alias("n_lines"), kept.alias("kept"))
    return counted.select(
        "doc_id",
        "n_lines",
        (F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"),
        F.array_join("kept", "\n").alias("text"),
    )
