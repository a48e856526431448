"""Feature tables on disk, their log and their round-trip check."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwise.config import Settings
from epochwise.operators.features import FEATURE_SCHEMA, to_feature_schema


def stamped(root: str, group: str, when: datetime | None = None) -> str:
    """A path that carries the time of writing."""
    when = when or datetime.now(timezone.utc)
    return f"{root.rstrip('/')}/features_{group}_{when:%Y-%m-%d_%H-%M-%S}"


def write_features(rows: DataFrame, path: str) -> None:
    """Overwrite a feature table, one folder per table_type for partition pruning."""
    to_feature_schema(rows).write.mode("overwrite").partitionBy("table_type").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURE_SCHEMA).parquet(path)


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of the two tables has, as often as it has them more; one shuffle."""
    cols = left.columns
    both = left.withColumn("_n", F.lit(1)).unionByName(right.select(*cols).withColumn("_n", F.lit(-1)))
    uneven = both.groupBy(*cols).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    side = F.when(F.col("_n") > 0, "left").otherwise("right")
    return uneven.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.abs("_n")))).select(*cols, side.alias("side"))


def manifest(rows: DataFrame, path: str, s: Settings) -> DataFrame:
    """One row describing a stored table: path, subjects, rows and settings."""
    entries = []
    for key, value in s.as_strings().items():
        entries += [F.lit(key), F.lit(value)]
    return rows.agg(
        F.count_distinct("SubjectID").alias("subjects"), F.count(F.lit(1)).alias("rows")
    ).select(
        F.current_timestamp().alias("logged_at"),
        F.lit(path).alias("path"),
        "subjects",
        "rows",
        F.create_map(*entries).alias("settings"),
    )


def append_manifest(rows: DataFrame, path: str, s: Settings, log_path: str) -> None:
    manifest(rows, path, s).write.mode("append").parquet(log_path)
