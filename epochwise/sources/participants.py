"""Participants and their labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The study groups and their class labels.
GROUPS = ("A", "C", "F")
LABELS = {"A": 1, "C": 0}


def select_subjects(
    participants: DataFrame,
    groups: Sequence[str] = GROUPS,
    id_col: str = "participant_id",
    group_col: str = "Group",
) -> DataFrame:
    """SubjectID and Group of the participants in the given groups."""
    return participants.where(F.col(group_col).isin(*groups)).select(
        F.col(id_col).alias("SubjectID"), F.col(group_col).alias("Group")
    )


def read_participants(
    spark: SparkSession, path: str, groups: Sequence[str] = GROUPS
) -> DataFrame:
    """Read a tab-separated participants file."""
    table = spark.read.csv(path, sep="\t", header=True)
    return select_subjects(table, groups)


def label_of(group: Column, labels: Mapping[str, int] = LABELS) -> Column:
    out = F.lit(None).cast("int")
    for g, value in labels.items():
        out = F.when(group == g, F.lit(value)).otherwise(out)
    return out


def attach_label(
    features: DataFrame, subjects: DataFrame, labels: Mapping[str, int] = LABELS
) -> DataFrame:
    """Add ``label`` by group and keep subjects that have one."""
    labelled = subjects.select("SubjectID", label_of(F.col("Group"), labels).alias("label"))
    return features.join(labelled.where("label is not null"), "SubjectID")
