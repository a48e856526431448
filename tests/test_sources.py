from conftest import signal_of

from epochwise.sources import participants, signals


def test_participants_file(spark, tmp_path):
    path = tmp_path / "participants.tsv"
    path.write_text(
        "participant_id\tGender\tGroup\nsub-001\tF\tA\nsub-002\tM\tC\nsub-003\tM\tF\nsub-004\tF\tX\n"
    )
    subjects = participants.read_participants(spark, str(path))
    assert sorted((r[0], r[1]) for r in subjects.collect()) == [
        ("sub-001", "A"), ("sub-002", "C"), ("sub-003", "F")
    ]
    rows = spark.createDataFrame([("sub-001", 1.0), ("sub-002", 2.0), ("sub-003", 3.0)],
                                 "SubjectID string, v double")
    labelled = participants.attach_label(rows, subjects)
    assert {r["SubjectID"]: r["label"] for r in labelled.collect()} == {"sub-001": 1, "sub-002": 0}


def test_signal_variants_and_missing(spark, tmp_path):
    clean = signal_of(spark, {("001", "Cz"): [1, 2], ("sub-002", "Cz"): [3]})
    clean.write.parquet(str(tmp_path / "derivatives"))
    clean.where("n = 0").write.parquet(str(tmp_path / "raw"))
    found = signals.read_signal(spark, str(tmp_path))
    assert sorted((r["SubjectID"], r["n"], r["x"]) for r in found.collect()) == [
        ("sub-001", 0, 1.0), ("sub-001", 1, 2.0), ("sub-002", 0, 3.0)
    ]
    assert signals.read_signal(spark, str(tmp_path), derivatives=False).count() == 2
    subjects = spark.createDataFrame([("sub-001",), ("sub-009",)], "SubjectID string")
    missing = signals.missing_recordings(subjects, found)
    assert [r["SubjectID"] for r in missing.collect()] == ["sub-009"]
