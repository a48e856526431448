"""Recordings as long signal tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwise.operators.numbering import number_by_range


def subject_key(subject: Column) -> Column:
    """Subject ids always start with ``sub-``, whether or not the input does."""
    return F.concat(F.lit("sub-"), F.regexp_replace(subject.cast("string"), "^sub-", ""))


def read_signal(spark: SparkSession, root: str, derivatives: bool = True) -> DataFrame:
    """Read the raw or the cleaned variant: SubjectID, Electrode, n, x."""
    variant = "derivatives" if derivatives else "raw"
    table = spark.read.parquet(f"{root.rstrip('/')}/{variant}")
    return table.select(
        subject_key(F.col("SubjectID")).alias("SubjectID"),
        "Electrode",
        F.col("n").cast("long").alias("n"),
        F.col("x").cast("double").alias("x"),
    )


def missing_recordings(subjects: DataFrame, signal: DataFrame) -> DataFrame:
    """Subjects without any sample."""
    return subjects.join(signal.select("SubjectID").distinct(), "SubjectID", "left_anti")


def numbered_signal(
    samples: DataFrame, order: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Number samples of each channel by time: (signal, samples per channel).

    ``samples`` holds SubjectID, Electrode, x and the order columns, which must
    be unique within a channel.
    """
    return number_by_range(samples, ["SubjectID", "Electrode"], order, "n")
