"""Views of the sample tables as signal, feature matrix, power table and participants."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwise.config import Settings
from epochwise.operators.epochs import recordings
from epochwise.sources.signals import numbered_signal

EMBEDDING_SIZE = 64
VECTOR_FEATURES = [f"f{i:02d}" for i in range(EMBEDDING_SIZE)]
SUBJECTS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def settings(**extra) -> Settings:
    """The settings of all event queries."""
    return Settings(rate=32.0, window=1.0, step=0.5, nfft=16, **extra)


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples: the subject from the user, the electrode from the type."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("sub-"), (F.col("user_id") % SUBJECTS).cast("string")).alias("SubjectID"),
        F.col("event_type").alias("Electrode"),
        "ts",
        "event_id",
        F.col("value").alias("x"),
    )


@dataclass(frozen=True)
class Recorded:
    """A signal with its channel lengths, recordings and settings."""

    signal: DataFrame
    lengths: DataFrame
    recs: DataFrame
    settings: Settings


def event_recordings(spark: SparkSession, sf_dir: str, **extra) -> Recorded:
    s = settings(**extra)
    signal, lengths = numbered_signal(event_samples(spark, sf_dir), ["ts", "event_id"])
    return Recorded(signal, lengths, recordings(lengths, s), s)


def event_annotations(signal: DataFrame, s: Settings) -> DataFrame:
    """High values mark annotations of three kinds, two of which spoil epochs."""
    kind = F.col("event_id") % 3
    return signal.where("x > 300").select(
        "SubjectID",
        (F.col("n") / F.lit(float(s.rate))).alias("onset"),
        F.lit(0.25).alias("duration"),
        F.when(kind == 0, "segment boundary")
        .when(kind == 1, "bad_blink")
        .otherwise("eyes closed")
        .alias("description"),
    )


def subject_labels(features: DataFrame) -> DataFrame:
    """Class of an event subject: its number modulo 2."""
    number = F.regexp_replace("SubjectID", "^sub-", "").cast("int")
    return features.withColumn("label", (number % 2).cast("int"))


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One epoch per vector: SubjectID, EpochID, label and ``values`` (doubles)."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("sub-"), F.col("label").cast("string")).alias("SubjectID"),
        F.concat(F.lit("ep-"), F.col("vec_id").cast("string")).alias("EpochID"),
        (F.col("label") % 2).cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("values"),
    )


def embedding_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one column per component."""
    rows = embedding_rows(spark, sf_dir)
    cells = [f"values[{i}] AS {c}" for i, c in enumerate(VECTOR_FEATURES)]
    return rows.selectExpr("SubjectID", "EpochID", "label", *cells)


def power_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a long power table."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_returnflag").alias("Electrode"),
        F.col("l_linestatus").alias("WaveBand"),
        F.col("l_extendedprice").alias("Power"),
    )
