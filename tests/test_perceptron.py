import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from epochwise.operators import evaluation, perceptron, row_blocks, splits

SCHEMA = "SubjectID string, EpochID string, label int, x array<double>"


def rings(n, seed):
    """Two classes that no line separates."""
    rng = np.random.default_rng(seed)
    y, turn = rng.integers(0, 2, n), rng.uniform(0, 2 * np.pi, n)
    radius = 1 + 1.5 * y + rng.normal(0, 0.1, n)
    return np.stack([radius * np.cos(turn), radius * np.sin(turn)], axis=1), y


def rows_of(spark, x, y, subjects=4):
    rows = [(f"s{i % subjects}", f"ep-{i}", int(l), list(map(float, v))) for i, (v, l) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).withColumn("features", array_to_vector("x")).drop("x")


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    sizes, x, y = perceptron.shapes(3, (5, 4)), rng.normal(size=(7, 3)), rng.integers(0, 2, 7).astype(float)
    flat = perceptron.first_parameters(sizes).astype(float) * 2

    def loss(p):
        z = perceptron.log_odds(p, sizes, x)
        squares = sum((w**2).sum() for w, _ in perceptron._layers(p, sizes))
        return np.mean(np.logaddexp(0, z) - y * z) + 0.3 / (2 * len(x)) * squares

    got = perceptron.gradient(flat, sizes, x, y, 0.3)
    for i in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert abs((loss(up) - loss(down)) / 2e-6 - got[i]) < 1e-6


def test_learns_what_no_line_separates_and_repeats(spark):
    df = splits.stratified_folds(rows_of(spark, *rings(600, 2)), 2)
    blocks = row_blocks.write_blocks(df, 1, block_rows=100)
    tasks = [perceptron.Task(1e-6, fold=0), perceptron.Task(1e-6, fold=1), perceptron.Task(1e-6)]
    fitted = perceptron.fit(blocks, tasks, (16, 8), 200)
    assert (fitted.held_out > 0.95).all() and (fitted.rounds < 200).all()
    again = perceptron.fit(blocks, tasks, (16, 8), 200)
    np.testing.assert_array_equal(fitted.parameters, again.parameters)
    # A model alone is the same as among others.
    alone = perceptron.fit(blocks, tasks[1:2], (16, 8), 200)
    np.testing.assert_array_equal(fitted.parameters[1], alone.parameters[0])


def test_penalty_grid_in_one_report(spark, monkeypatch):
    train, test = splits.hold_out(rows_of(spark, *rings(500, 3), subjects=8), 1)
    folded = splits.stratified_folds(train, 2)
    found = perceptron.grid_predictions(folded, test, 2, (1e-6, 30.0), (16, 8), 60)
    assert found.where("part = 'cv' and alpha = 30").count() == folded.count()
    scores = evaluation.accuracy(found, ["alpha", "part", "fold"])
    report = {r.alpha: r for r in evaluation.whole_report(scores, ["alpha"]).collect()}
    assert report[1e-6].cv_mean > 0.9 and report[1e-6].test_accuracy > 0.85
    # A heavy penalty leaves nothing to learn with.
    assert report[30.0].cv_mean < report[1e-6].cv_mean
    monkeypatch.setattr(perceptron, "_MOST_NUMBERS", 1)  # one model after another
    alone = perceptron.grid_predictions(folded, test, 2, (1e-6, 30.0), (16, 8), 60)
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, found.collect()))


def test_leaving_one_subject_out(spark):
    df = rows_of(spark, *rings(400, 4), subjects=3)
    found = perceptron.leave_one_subject_out(df, hidden=(16, 8), max_rounds=80)
    assert found.count() == 400 and found.select("SubjectID").distinct().count() == 3
    assert evaluation.accuracy(found).first()[0] > 0.9
    with pytest.raises(ValueError):
        perceptron.leave_one_subject_out(df.where("SubjectID = 's0'"))


def test_few_rows_of_one_class(spark):
    df = rows_of(spark, np.ones((6, 2)), np.ones(6, dtype=int), subjects=2)
    found = perceptron.leave_one_subject_out(df, hidden=(4,), max_rounds=30)
    assert {r.prediction for r in found.collect()} == {1}
