"""Principal components with the number chosen by explained variance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Components:
    """A fitted PCA; its size depends on the number of columns only.

    ``signs`` turns each component so that its largest loading is positive.
    """

    model: PCAModel
    cols: list[str]
    k: int
    variance: list[float]
    signs: list[float]


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Feature columns as one vector column; NULL must have been filled."""
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def components_for(variance: Sequence[float], target: float) -> int:
    """Smallest k whose explained variance adds up to the target, else all."""
    total = 0.0
    for i, v in enumerate(variance):
        total += v
        if total >= target:
            return i + 1
    return len(variance)


def fit_pca(df: DataFrame, cols: Sequence[str], variance_target: float = 0.95) -> Components:
    """Fit once with all components; the leading k are those of a fit with k."""
    vectors = assemble(df.select(*[c for c in cols]), cols)
    model = PCA(k=len(cols), inputCol="features", outputCol="scores").fit(vectors)
    variance = [float(v) for v in model.explainedVariance.toArray()]
    pc = model.pc.toArray()
    largest = abs(pc).argmax(axis=0)
    signs = [1.0 if pc[row, i] >= 0 else -1.0 for i, row in enumerate(largest)]
    return Components(model, list(cols), components_for(variance, variance_target), variance, signs)


def project(df: DataFrame, fitted: Components) -> DataFrame:
    """SubjectID, EpochID, label and the first k scores as ``features``."""
    signs = F.array(*[F.lit(v) for v in fitted.signs[: fitted.k]])
    scores = F.slice(vector_to_array("scores"), 1, fitted.k)
    turned = F.zip_with(scores, signs, lambda v, sign: v * sign)
    return fitted.model.transform(assemble(df, fitted.cols)).select(
        "SubjectID",
        "EpochID",
        F.col("label").cast("int").alias("label"),
        array_to_vector(turned).alias("features"),
    )


def explained_variance(df: DataFrame, fitted: Components) -> DataFrame:
    """Rows (pc, ev, cum_ev), one per component."""
    total = accumulate(fitted.variance)
    rows = [(i + 1, v, c) for i, (v, c) in enumerate(zip(fitted.variance, total))]
    return df.sparkSession.createDataFrame(rows, "pc int, ev double, cum_ev double")


def loadings(df: DataFrame, fitted: Components) -> DataFrame:
    """Rows (pc, feature, weight) of the kept components."""
    pc = fitted.model.pc.toArray()
    rows = [
        (i + 1, c, float(pc[j, i] * fitted.signs[i]))
        for i in range(fitted.k)
        for j, c in enumerate(fitted.cols)
    ]
    return df.sparkSession.createDataFrame(rows, "pc int, feature string, weight double")


def top_loadings(df: DataFrame, fitted: Components, n: int = 10) -> DataFrame:
    """The n features of largest absolute weight in each component."""
    w = Window.partitionBy("pc").orderBy(F.desc(F.abs("weight")), "feature")
    return (
        loadings(df, fitted)
        .withColumn("place", F.row_number().over(w))
        .where(F.col("place") <= n)
    )
