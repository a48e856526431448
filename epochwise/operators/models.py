"""Classifiers of pyspark.ml, trained and judged fold by fold or subject by subject.

Every fit is a Spark job over the whole training rows. Several fits run at the
same time from a few driver threads, as in CrossValidator, but without its
extra fit on all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwise.operators import evaluation, normalize
from epochwise.operators.reshape import union_all
from epochwise.operators.splits import ROW_ID
from epochwise.storage import stage

SEED = 42
PARALLEL_FITS = 4


Predictor = Callable[[DataFrame, DataFrame], DataFrame]


def decision_tree() -> Estimator:
    """Depth 8; a leaf of 10 rows implies that a split has at least 5."""
    return DecisionTreeClassifier(maxDepth=8, minInstancesPerNode=10, seed=SEED)


def linear_svm(rows: float, c: float = 1.0, max_iter: int = 100) -> LinearSVC:
    """``c`` weighs the summed hinge loss; Spark averages it over ``rows``."""
    return LinearSVC(maxIter=max_iter, regParam=1.0 / (c * rows), standardization=False)


standardise = normalize.standardise_vectors


def with_estimator(make: Callable[[DataFrame], Estimator]) -> Predictor:
    """Fit on train, predict test; ``make`` may look at the training rows."""

    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        model = make(train).fit(train)
        return model.transform(test).withColumn("prediction", F.col("prediction").cast("int"))

    return run


def predict_parts(
    rows: DataFrame,
    part_col: str,
    parts: Sequence,
    predictor: Predictor,
    parallelism: int = PARALLEL_FITS,
    prepare: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None,
) -> DataFrame:
    """Hold out each part in turn: SubjectID, EpochID, label, part, prediction.

    ``rows`` feeds every fit, so it should be a written table (``stage``).
    """

    cols = list(dict.fromkeys([*ROW_ID, "label", part_col, "prediction"]))

    def one(part) -> DataFrame:
        test = rows.where(F.col(part_col) == F.lit(part))
        train = rows.where(F.col(part_col) != F.lit(part))
        if prepare is not None:
            train, test = prepare(train, test)
        return predictor(train, test).select(*cols)

    with ThreadPool(min(parallelism, len(parts))) as pool:
        return union_all(pool.map(one, parts))


def cross_validate(
    rows: DataFrame, k: int, predictor: Predictor, parallelism: int = PARALLEL_FITS, prepare=None
) -> DataFrame:
    """Predictions of a k-fold cross-validation over the column ``fold``."""
    staged = stage(rows.select(*ROW_ID, "label", "fold", "features"), "folds")
    return predict_parts(staged, "fold", range(k), predictor, parallelism, prepare)


def model_scores(
    train: DataFrame,
    test: DataFrame,
    k: int,
    predictors: Mapping[str, Predictor],
    prepare: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None,
) -> DataFrame:
    """Accuracies of several models: model, part (cv, train, test), fold and accuracy.

    ``train`` holds the column ``fold``.
    """
    cols = [*ROW_ID, "label", "features"]
    train, test = stage(train.select(*cols, "fold"), "train"), stage(test.select(*cols), "test")
    marked = []
    for name, predictor in predictors.items():
        folds = cross_validate(train, k, predictor, prepare=prepare)
        fit, both = train, train.drop("fold").withColumn("part", F.lit("train")).unionByName(
            test.withColumn("part", F.lit("test"))
        )
        if prepare is not None:
            fit, both = prepare(fit, both)
        whole = predictor(fit, both).select("label", "prediction", "part", F.lit(-1).alias("fold"))
        parts = folds.select("label", "prediction", F.lit("cv").alias("part"), "fold")
        marked.append(parts.unionByName(whole).withColumn("model", F.lit(name)))
    return evaluation.accuracy(union_all(marked), ["model", "part", "fold"])


def model_report(
    train: DataFrame,
    test: DataFrame,
    k: int,
    predictors: Mapping[str, Predictor],
    prepare: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None,
) -> DataFrame:
    """Cross-validation, training and held-out scores of several models, best first."""
    return evaluation.whole_report(model_scores(train, test, k, predictors, prepare), ["model"])
