import itertools

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from epochwise.operators import evaluation, linear_grid, normalize, row_blocks, splits

SCHEMA = "SubjectID string, EpochID string, label int, x array<double>"
SMALL = linear_grid.Grid((0.1, 1.0), (1, 3), (0.5, 1.0), (False, True))


def rows_of(spark, x, y):
    rows = [(f"s{i % 4}", f"ep-{i}", int(l), list(map(float, v))) for i, (v, l) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).withColumn("features", array_to_vector("x")).drop("x")


def cloud(n, d, seed, gap):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    return rng.normal(size=(n, d)) + gap * (2 * y[:, None] - 1), y


def objective(w, x, y, weights, c):
    loss, _ = linear_grid._loss((2 * y - 1) * (x @ w[:-1] + w[-1]))
    return w[:-1] @ w[:-1] / 2 + c * (weights * loss).sum()


def slow_fit(x, y, weights, c):
    """Many plain gradient steps with a shrinking step; the best point met."""
    w, best = np.zeros(x.shape[1] + 1), np.inf
    sign = 2 * y - 1
    for n in range(20_000):
        _, slope = linear_grid._loss(sign * (x @ w[:-1] + w[-1]))
        pull = weights * slope * sign
        g = np.append(w[:-1] + c * pull @ x, c * pull.sum())
        w = w - g / (1 + c * weights.sum()) / (1 + n / 2000)
        best = min(best, objective(w, x, y, weights, c))
    return best


def test_vectors_minimise_their_objective(spark, monkeypatch):
    """Each fold, draw, member and cost against its own slow fit; blocks and groups of parts do not matter."""
    monkeypatch.setattr(linear_grid, "_MOST_NUMBERS", 200)
    x, y = cloud(90, 3, 1, 0.4)
    df = splits.stratified_folds(rows_of(spark, x, y), 2)
    order = {r.EpochID: r.fold for r in df.collect()}
    fold = np.array([order[f"ep-{i}"] for i in range(90)])
    fitted = linear_grid.fit(row_blocks.write_blocks(df, 3, block_rows=16), 2, SMALL, passes=300, tolerance=1e-8)
    u = {r.EpochID: r.u for r in df.selectExpr("EpochID", f"array({', '.join(row_blocks.row_number(42, m) for m in range(3))}) AS u").collect()}
    u = np.array([u[f"ep-{i}"] for i in range(90)])
    for p, part in enumerate(fitted.parts):
        kept = fold != part if part >= 0 else np.ones(90, dtype=bool)
        w = linear_grid.draw_weights(u, SMALL, fitted.thresholds[p]) * kept[:, None, None]
        for k, m, c in itertools.product(range(4), (0, 2), range(2)):
            got = objective(fitted.weights[p, k, m, c], x, y, w[:, k, m], SMALL.c[c])
            assert got <= slow_fit(x, y, w[:, k, m], SMALL.c[c]) * 1.002 + 1e-6


@pytest.mark.parametrize("n", [40, 777])
def test_draws_without_replacement_are_exact(spark, n):
    x, y = cloud(n, 2, 2, 1.0)
    df = splits.stratified_folds(rows_of(spark, x, y), 3)
    blocks = row_blocks.write_blocks(df, 4, block_rows=50)
    limits = linear_grid.exact_thresholds(blocks, [0, 1, 2, -1], 4, [0.1, 0.5, 1.0])
    for p, (f, fraction) in itertools.product((0, 1, 2, -1), enumerate((0.1, 0.5, 1.0))):
        rows = df if p < 0 else df.where(F.col("fold") != p)
        total = rows.count()
        for m in range(4):
            drawn = rows.where(f"{row_blocks.row_number(42, m)} < {limits[[0, 1, 2, -1].index(p), f, m]}").count()
            assert drawn == int(total * fraction)


def test_draws_with_replacement_have_the_right_mean(spark):
    x, y = cloud(3000, 1, 3, 1.0)
    drawn = linear_grid.drawn_rows(rows_of(spark, x, y), linear_grid.Grid((1.0,), (2,), (0.1, 0.5, 1.0), (True,)))
    for r in drawn.groupBy("fraction", "member").agg(F.sum("draws").alias("n"), F.max("draws").alias("most")).collect():
        assert abs(r.n / 3000 - r.fraction) < 0.05 and r.most > 1


def test_no_rows_drawn_is_an_error(spark):
    x, y = cloud(6, 2, 4, 1.0)
    df = rows_of(spark, x, y)
    with pytest.raises(ValueError):
        linear_grid.grid_scores(splits.stratified_folds(df, 2), df, 2)


def test_whole_grid_in_one_report(spark):
    x, y = cloud(120, 3, 5, 1.5)
    train, test = splits.hold_out(rows_of(spark, x, y), 1)
    scores = linear_grid.grid_scores(splits.stratified_folds(train, 3), test, 3)
    report = evaluation.whole_report(scores, ["c", "members", "fraction", "bootstrap"]).collect()
    assert len({tuple(r)[:4] for r in report}) == 72 == len(linear_grid.Grid().configurations)
    means = [r.cv_mean for r in report]
    assert means == sorted(means, reverse=True) and means[0] > 0.9
    assert all(r.best_fold in (0, 1, 2) and r.best_fold_accuracy >= r.cv_mean for r in report)


def test_smaller_ensembles_are_prefixes_and_predictions_match_scores(spark):
    x, y = cloud(100, 3, 6, 0.7)
    df = splits.stratified_folds(rows_of(spark, x, y), 2)
    rows = linear_grid.grid_predictions(df, 2, SMALL)
    assert rows.count() == 100 * len(SMALL.configurations)
    keys = ["c", "members", "fraction", "bootstrap"]
    by_row = {tuple(r)[:5]: r.accuracy for r in evaluation.accuracy(rows, [*keys, "fold"]).collect()}
    scores = linear_grid.grid_scores(df, df, 2, SMALL).where("part = 'cv'").select(*keys, "fold", "accuracy").collect()
    assert {tuple(r)[:5]: r.accuracy for r in scores} == pytest.approx(by_row)
    alone = linear_grid.grid_predictions(df, 2, linear_grid.Grid((0.1, 1.0), (1,), (0.5, 1.0), (False, True)))
    same = [tuple(r) for r in rows.where("members = 1").collect()]
    assert sorted(same) == sorted(tuple(r) for r in alone.collect())


def test_standardise_vectors(spark):
    x, y = cloud(50, 3, 7, 1.0)
    x[:, 2] = 5.0  # constant: only centred
    train, test = rows_of(spark, x[:30], y[:30]), rows_of(spark, x[30:], y[30:])
    spread = x[:30].std(axis=0)
    spread[2] = 1.0
    for part, values in zip(normalize.standardise_vectors(train, test), (x[:30], x[30:]), strict=True):
        got = {r.EpochID: r.features.toArray() for r in part.collect()}
        for i, v in enumerate(values):
            np.testing.assert_allclose(got[f"ep-{i}"], (v - x[:30].mean(axis=0)) / spread, atol=1e-12)
