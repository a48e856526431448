"""Training and test rows, by subject, by share and by fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochwise.operators.numbering import number_by_hash, number_by_range
from epochwise.storage import stage

ROW_ID = ["SubjectID", "EpochID"]


def subjects(df: DataFrame) -> DataFrame:
    return df.select("SubjectID").distinct().orderBy("SubjectID")


def first_subjects(df: DataFrame, n: int) -> DataFrame:
    """The first n subjects of each label by id, in one query for all labels."""
    w = Window.partitionBy("label").orderBy("SubjectID")
    return (
        df.select("label", "SubjectID")
        .distinct()
        .withColumn("_place", F.row_number().over(w))
        .where(F.col("_place") <= n)
        .drop("_place")
    )


def split_by_subject(df: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test): rows of the held-out subjects form the test set."""
    ids = held.select("SubjectID").distinct()
    return df.join(ids, "SubjectID", "left_anti"), df.join(ids, "SubjectID", "left_semi")


def hold_out(df: DataFrame, n: int = 2) -> tuple[DataFrame, DataFrame]:
    """Hold out n subjects per label.

    The few held-out ids are written once, so both parts, however often they are
    read, find them without looking through all rows again.
    """
    return split_by_subject(df, stage(first_subjects(df, n), "held"))


def digest(cols: Sequence[str], seed: int) -> Column:
    """A reproducible random order: rows sort by the hash of their id."""
    return F.md5(F.concat_ws("|", *cols, F.lit(str(seed))))


def random_split(df: DataFrame, test_size: float = 0.3, seed: int = 42) -> DataFrame:
    """Mark ceil(n * test_size) random rows of each subject as ``is_test``."""
    ranked = number_by_hash(df, ["SubjectID"], digest(ROW_ID, seed), ROW_ID, "_rank", "_of")
    return ranked.withColumn(
        "is_test", F.col("_rank") < F.ceil(F.col("_of") * F.lit(test_size))
    ).drop("_rank", "_of")


def _fold(rank: Column, of: Column, k: int) -> Column:
    """Even consecutive parts; the first ``of % k`` hold one row more."""
    small = F.floor(of / F.lit(k)).cast("long")
    extra = of % k
    edge = extra * (small + 1)
    late = extra + F.floor((rank - edge) / F.greatest(small, F.lit(1))).cast("long")
    return F.when(rank < edge, F.floor(rank / (small + 1)).cast("long")).otherwise(late).cast("int")


def stratified_folds(
    df: DataFrame, k: int, shuffle: bool = True, seed: int = 42, alias: str = "fold"
) -> DataFrame:
    """Add a fold 0..k-1; each label is spread evenly over the folds."""
    if shuffle:
        ranked = number_by_hash(df, ["label"], digest(ROW_ID, seed), ROW_ID, "_rank", "_of")
    else:
        ranked, sizes = number_by_range(df, ["label"], ROW_ID, "_rank")
        ranked = ranked.join(sizes.withColumnRenamed("rows", "_of"), "label")
    return ranked.withColumn(alias, _fold(F.col("_rank"), F.col("_of"), k)).drop("_rank", "_of")
