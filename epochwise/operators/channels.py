"""One row per epoch and channel: variances of the signal and its spectrum.

Overlapping epochs would multiply the samples, so nothing per epoch is shuffled
before it has been summed up:

1. The samples shuffle once, in chunks of bounded length, to get the differences
   to their neighbours. Subtracting a line from an epoch only shifts these.
2. In the same stage each sample is added to the sums of its epochs: powers of x
   and place, squared differences, and the weighted sums of the Fourier
   transform against a broadcast table that depends on the parameters only.
3. These sums, one row per segment of an epoch, are gathered by epoch. The least
   squares line and the segment means are then taken out of the sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochwise.config import Settings
from epochwise.functions.columns import number, numbers
from epochwise.functions.tapers import FourierPlan, fourier_plan
from epochwise.operators.epochs import CHANNEL, EPOCH, assign_samples, centred, channel_lengths
from epochwise.operators.tapered import tapered_epochs
from epochwise.storage import stage

CHUNK_SAMPLES = 4096
_CHUNK = ["SubjectID", "Electrode", "chunk"]


def with_differences(signal: DataFrame) -> DataFrame:
    """First and second differences ``d1`` and ``d2`` along each channel.

    A chunk also receives the last two samples of the chunk before it.
    """
    at = F.col("n") % CHUNK_SAMPLES
    own = F.floor(F.col("n") / CHUNK_SAMPLES).cast("long")
    chunks = F.when(at >= CHUNK_SAMPLES - 2, F.array(own, own + 1)).otherwise(F.array(own))
    known = signal.where("n IS NOT NULL AND x IS NOT NULL")
    rows = known.select("SubjectID", "Electrode", "n", "x", F.explode(chunks).alias("chunk"))
    w = Window.partitionBy(*_CHUNK).orderBy("n")
    # Rows before that are no neighbours, because samples are missing, give no difference.
    back1 = F.when(F.lag("n", 1).over(w) == F.col("n") - 1, F.lag("x", 1).over(w))
    back2 = F.when(F.lag("n", 2).over(w) == F.col("n") - 2, F.lag("x", 2).over(w))
    x = F.col("x")
    return (
        rows.withColumn("d1", x - back1)
        .withColumn("d2", (x - back1) - (back1 - back2))
        .where(own == F.col("chunk"))
    )


# What is summed up per segment; differences count from the second and third
# sample of the epoch on.
_TERMS = {
    "n": "1D",
    "j": "double(j)",
    "jj": "double(j) * j",
    "x": "x",
    "jx": "j * x",
    "xx": "x * x",
    "n1": "if(j >= 1 AND d1 IS NOT NULL, 1D, NULL)",
    "d1": "if(j >= 1, d1, NULL)",
    "d1d1": "if(j >= 1, d1 * d1, NULL)",
    "n2": "if(j >= 2 AND d2 IS NOT NULL, 1D, NULL)",
    "d2": "if(j >= 2, d2, NULL)",
    "d2d2": "if(j >= 2, d2 * d2, NULL)",
}


def _variance(count: str, total: str, square: str) -> str:
    mean = f"try_divide({total}, {count})"
    return f"greatest(try_divide({square}, {count}) - {mean} * {mean}, 0D)"


def _moments(df: DataFrame) -> DataFrame:
    """Least-squares line of the epoch and moments of the signal without it.

    Works on the epoch's sums ``t_*``; a flat channel has variance 0 exactly.
    """
    line = df.selectExpr(
        "*",
        "t_xx - try_divide(t_x * t_x, t_n) AS xx_c",
        "t_jx - try_divide(t_j * t_x, t_n) AS jx_c",
        "t_jj - try_divide(t_j * t_j, t_n) AS jj_c",
    ).selectExpr("*", "try_divide(jx_c, jj_c) AS slope")
    rest = line.selectExpr(
        "*",
        "try_divide(t_x - slope * t_j, t_n) AS level",
        "try_divide(xx_c - slope * jx_c, t_n) AS var_c",
    )
    moments = rest.selectExpr(
        "*",
        "bigint(t_n) AS y_n",
        "try_divide(t_x - slope * t_j - level * t_n, t_n) AS y_mean",
        "if(t_d1d1 = 0 OR var_c < 0, 0D, var_c) AS y_var",
        f"if(t_n1 IS NULL, NULL, {_variance('t_n1', 't_d1', 't_d1d1')}) AS d1_var",
        f"if(t_n2 IS NULL, NULL, {_variance('t_n2', 't_d2', 't_d2d2')}) AS d2_var",
    )
    return moments.selectExpr("*", "y_var + y_mean * y_mean AS y_square")


def _by_group(rows: list[list[float]], i: int) -> str:
    """A constant of lane ``i``, which depends on the lane group if there are several."""
    if len(rows) == 1:
        return number(rows[0][i])
    return numbers(row[i] for row in rows) + "[int(g)]"


def _lane_power(plan: FourierPlan, i: int) -> str:
    """|weighted sum of the segment|^2 after the line and the segment mean are out.

    What is taken out is ``base + slope * place``, where ``base`` is the mean of
    the segment without its slope.
    """

    def cleaned(total: str, sums: list[list[float]], ramps: list[list[float]]) -> str:
        return f"{total} - base * {_by_group(sums, i)} - slope * {_by_group(ramps, i)}"

    re = cleaned(f"re{i}", plan.cos_sums, plan.cos_ramps)
    im = cleaned(f"im{i}", plan.sin_sums, plan.sin_ramps)
    return f"pow({re}, 2) + pow({im}, 2)"


def _psd(plan: FourierPlan) -> str:
    """Scale the lanes."""
    return f"zip_with(lanes, {numbers(plan.bin_scales)}, (p, scale) -> p * scale)"


_KEPT = ["y_n", "y_mean", "y_square", "y_var", "d1_var", "d2_var"]


def _sums(placed: DataFrame, keys: list[str], extra: list[Column]) -> DataFrame:
    """Sum up inside the chunk, then gather the small rows by epoch and add them."""
    terms = [F.expr(f"sum({value}) AS {name}") for name, value in _TERMS.items()]
    local = placed.groupBy(*_CHUNK, *keys).agg(*terms, *extra)
    added = [c for c in local.columns if c not in (*_CHUNK, *keys)]
    return (
        local.repartition(*EPOCH)
        .groupBy("SubjectID", "Electrode", *keys)
        .agg(*[F.expr(f"sum({c}) AS {c}") for c in added])
    )


def channel_epochs(signal: DataFrame, s: Settings, spectrum: bool = True) -> DataFrame:
    """Moments and power spectrum ``psd`` of all candidate epochs of a signal.

    ``psd`` is an array over ``s.bins()``, NULL for an epoch with gaps. Without
    ``spectrum`` no weights are joined; multitaper spectra are transformed in runs of
    epochs instead (``tapered.py``). Join the epoch table next.
    """
    if spectrum and s.method == "multitaper":
        return tapered_epochs(signal, s)
    rows = assign_samples(with_differences(signal), s)
    if not spectrum:
        totals = _sums(rows, ["epoch_ix"], [])
        renamed = totals.selectExpr(*CHANNEL, *[f"{t} AS t_{t}" for t in _TERMS])
        return _moments(renamed).select(*CHANNEL, *_KEPT)

    plan = fourier_plan(s)
    n = s.fft_length
    lanes = range(plan.per_group)
    table = F.broadcast(signal.sparkSession.createDataFrame(plan.table, plan.schema))
    placed = rows.selectExpr("*", f"int(j div {n}) AS seg", f"int(j % {n}) AS place")
    segments = _sums(
        placed.join(table, "place"),
        ["epoch_ix", "seg", "g"],
        [F.expr(f"sum(x * c{i}) AS re{i}") for i in lanes]
        + [F.expr(f"sum(x * s{i}) AS im{i}") for i in lanes],
    )
    # Every lane group carries the same moments: add up those of the first.
    by = f"OVER (PARTITION BY {', '.join(CHANNEL)})"
    totals = segments.selectExpr(
        "*", *[f"sum(if(g = 0, {t}, NULL)) {by} AS t_{t}" for t in _TERMS]
    )
    # Samples behind the last whole segment count for the moments only.
    whole = f"t_n = {s.epoch_samples}"
    usable = f"{whole} AND seg < {s.epoch_samples // n}"
    ready = _moments(totals).selectExpr(
        "*", f"try_divide(x - slope * (j - seg * {n} * n), n) AS base"
    )
    powers = ", ".join(f"avg(if({usable}, {_lane_power(plan, i)}, NULL))" for i in lanes)
    merged = ready.groupBy(*CHANNEL, "g").agg(
        *[F.max(c).alias(c) for c in _KEPT],
        F.expr(f"max({whole}) AS whole"),
        F.expr(f"array({powers}) AS part"),
    )
    if plan.groups == 1:
        joined = merged.withColumnRenamed("part", "lanes")
    else:
        parts = "array_sort(collect_list(struct(g, part)))"
        joined = merged.groupBy(*CHANNEL).agg(
            *[F.max(c).alias(c) for c in (*_KEPT, "whole")],
            F.expr(f"flatten(transform({parts}, p -> p.part)) AS lanes"),
        )
    used = joined.withColumn("lanes", F.slice("lanes", 1, plan.lanes))
    return used.selectExpr(*CHANNEL, *_KEPT, f"if(whole, {_psd(plan)}, NULL) AS psd")


def whole_epochs(signal: DataFrame, s: Settings, spectrum: bool = True) -> DataFrame:
    """``channel_epochs`` of the channels that fill their epoch, free of large levels.

    A channel's mean cancels in every feature, but sums of squares would lose their
    digits to it, so it is taken out first: one row per channel, written so that
    Spark knows its size before it joins.
    """
    level = stage(channel_lengths(signal), "levels")
    found = channel_epochs(centred(signal, level), s, spectrum)
    return found.where(F.col("y_n") == s.epoch_samples)
