"""Reports over predictions: SubjectID, EpochID, label, prediction.

All of them are counts that combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of the classes, limit of the majority rule, bins of the histogram.
CLASS_NAMES = {0: "Control", 1: "Alzheimer's"}
MAJORITY = 0.5
BINS = 10


def correct() -> Column:
    return F.col("prediction") == F.col("label")


def accuracy(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return predictions.groupBy(*by).agg(F.avg(correct().cast("double")).alias("accuracy"))


def grid_report(predictions: DataFrame, config: Sequence[str], fold: str = "fold") -> DataFrame:
    """Mean, population deviation and best fold of each configuration, best first."""
    scores = accuracy(predictions, [*config, fold])
    best = F.max_by(fold, F.struct("accuracy", -F.col(fold)))
    return (
        scores.groupBy(*config)
        .agg(
            F.avg("accuracy").alias("cv_mean"),
            F.stddev_pop("accuracy").alias("cv_std"),
            F.max("accuracy").alias("best_fold_accuracy"),
            best.alias("best_fold"),
        )
        .orderBy(F.desc("cv_mean"), *config)
    )


REPORT_SCORES = ["cv_mean", "cv_std", "best_fold_accuracy", "train_accuracy", "test_accuracy"]


def whole_report(scores: DataFrame, config: Sequence[str]) -> DataFrame:
    """Cross-validation, training and held-out accuracy of each configuration, best first.

    ``scores`` has a row for each fold (part cv), the training rows (train) and the
    held-out ones (test): part, fold and accuracy.
    """

    def of(part: str) -> Column:
        return F.when(F.col("part") == part, F.col("accuracy"))

    fold = F.when(F.col("part") == "cv", F.col("fold"))
    return (
        scores.groupBy(*config)
        .agg(
            F.avg(of("cv")).alias("cv_mean"),
            F.stddev_pop(of("cv")).alias("cv_std"),
            F.max(of("cv")).alias("best_fold_accuracy"),
            F.max_by(fold, F.struct(of("cv"), -F.col("fold"))).alias("best_fold"),
            F.max(of("train")).alias("train_accuracy"),
            F.max(of("test")).alias("test_accuracy"),
        )
        .orderBy(F.desc("cv_mean"), *config)
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def class_counts(predictions: DataFrame) -> DataFrame:
    """True positives, support and predicted rows per class.

    The confusion counts have one row per pair of classes; only they are unfolded.
    """
    confusion = predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(correct(), F.col("n")).otherwise(0)
    nothing = F.lit(0).cast("long")
    sides = F.array(
        F.struct(
            F.col("label").alias("class"), hit.alias("tp"), F.col("n").alias("support"),
            nothing.alias("predicted"),
        ),
        F.struct(
            F.col("prediction").alias("class"), nothing.alias("tp"), nothing.alias("support"),
            F.col("n").alias("predicted"),
        ),
    )
    return (
        confusion.select(F.inline(sides))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    )


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted means."""
    precision = _ratio(F.col("tp"), F.col("predicted"))
    recall = _ratio(F.col("tp"), F.col("support"))
    per_class = class_counts(predictions).select(
        F.col("class").cast("string").alias("class"),
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
    )
    scores = ("precision", "recall", "f1")
    weight = F.col("support")
    means = per_class.agg(
        *[F.avg(c).alias(f"m_{c}") for c in scores],
        *[_ratio(F.sum(F.col(c) * weight), F.sum(weight)).alias(f"w_{c}") for c in scores],
        F.sum(weight).alias("support"),
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(title).alias("class"),
                *[F.col(f"{p}_{c}").alias(c) for c in scores],
                F.col("support").alias("support"),
            )
            for p, title in (("m", "macro avg"), ("w", "weighted avg"))
        ]
    )
    return per_class.unionByName(means.select(F.inline(rows)))


def macro_recall(predictions: DataFrame) -> DataFrame:
    """Mean recall over the classes that occur."""
    recalls = predictions.groupBy("label").agg(F.avg(correct().cast("double")).alias("recall"))
    return recalls.agg(F.avg("recall").alias("macro_recall"))


def correctness(predictions: DataFrame) -> DataFrame:
    """The correctness matrix in long form, with the epoch's number for ordering."""
    return predictions.select(
        "SubjectID",
        F.regexp_replace("EpochID", "^ep-", "").cast("long").alias("epoch_ix"),
        correct().alias("correct"),
    )


def correctness_matrix(predictions: DataFrame, epochs: Sequence[int]) -> DataFrame:
    """One row per subject and one column per listed epoch; absent epochs are NULL."""
    return (
        correctness(predictions)
        .groupBy("SubjectID")
        .pivot("epoch_ix", list(epochs))
        .agg(F.first("correct"))
    )


def subject_accuracy(predictions: DataFrame) -> DataFrame:
    """Accuracy of each subject and whether it is above one half."""
    return accuracy(predictions, ["SubjectID", "label"]).withColumn(
        "above_half", F.col("accuracy") > MAJORITY
    )


def majority_counts(predictions: DataFrame) -> DataFrame:
    """Per label: subjects above one half, others, and their share."""
    above = F.count_if("above_half")
    return (
        subject_accuracy(predictions)
        .groupBy("label")
        .agg(
            above.alias("above"),
            F.count_if(~F.col("above_half")).alias("not_above"),
            (above / F.count(F.lit(1))).alias("share_above"),
        )
    )


def class_name(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for value, title in CLASS_NAMES.items():
        out = F.when(label == value, F.lit(title)).otherwise(out)
    return out


def subject_summary(predictions: DataFrame) -> DataFrame:
    """One row per subject, highest accuracy first."""
    total, good = F.count(F.lit(1)), F.count_if(correct())
    return (
        predictions.groupBy("SubjectID", class_name(F.col("label")).alias("Group"))
        .agg(
            F.round(good / total, 4).alias("test_accuracy"),
            good.alias("correct"),
            total.alias("total_epochs"),
            (total - good).alias("incorrect"),
        )
        .orderBy(F.desc("test_accuracy"), "SubjectID")
    )


def accuracy_histogram(summary: DataFrame) -> DataFrame:
    """Subjects per group and accuracy bin; the last of the ten bins is closed.

    Accuracies have four digits, so bins are found in whole numbers.
    """
    step = 10_000 // BINS
    units = F.round(F.col("test_accuracy") * 10_000).cast("int")
    bin_ix = F.least(F.floor(units / step).cast("int"), F.lit(BINS - 1))
    counts = summary.groupBy("Group", bin_ix.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = summary.select("Group").distinct().select(
        "Group", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin")
    )
    return spine.join(counts, ["Group", "bin"], "left").select(
        "Group",
        "bin",
        (F.col("bin") / F.lit(BINS)).alias("bin_low"),
        F.coalesce("n", F.lit(0).cast("long")).alias("subjects"),
    )


def _group_report(own: Column, missed: Column, summary: DataFrame) -> DataFrame:
    """Each group against the misses of all other groups."""
    groups = summary.groupBy("Group").agg(F.sum(own).alias("tp"), F.sum(missed).alias("fn"))
    everyone = Window.partitionBy()  # one row per group
    fp = F.sum("fn").over(everyone) - F.col("fn")
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return groups.withColumn("fp", fp).select(
        "Group",
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2 * precision * recall, precision + recall).alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"),
    )


def epoch_group_report(summary: DataFrame) -> DataFrame:
    """Per group over epochs: own hits, own misses, and the others' misses as false positives."""
    return _group_report(F.col("correct"), F.col("incorrect"), summary)


def subject_group_report(summary: DataFrame) -> DataFrame:
    """The same over subjects, right when more than half of their epochs are."""
    right = F.col("correct") / F.col("total_epochs") > MAJORITY
    return _group_report(right.cast("long"), (~right).cast("long"), summary)
