"""A cross-section of the catalogue against its SQL; ``check.py`` compares all of it."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import table

SF_DIR = "/root/testdata/sf0.01"
SAMPLE = [
    "missing_recordings",
    "epoch_samples",
    "epoch_renumbered",
    "feature_long",
    "psd_multitaper",
    "feature_wide_single_pivot",
    "zscore_power",
    "minmax_selected",
    "stratified_folds",
    "knn_grid_cv",
    "subject_identification_recall",
    "group_report_subjects",
]

needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables are absent")


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(SF_DIR, "*.parquet")):
        view = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, SF_DIR)
    ours = table(df.columns, df.collect())
    cursor = con.execute(entry.oracle_sql()[name])
    assert ours == table([d[0] for d in cursor.description], cursor.fetchall())


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["SubjectID", "EpochID", "Electrode"] and df.count() > 0
