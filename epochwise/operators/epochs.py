"""From a signal table to overlapping, detrended, artefact-free epochs.

Everything between samples and epochs is arithmetic on sample numbers, so no
range join is needed, and a sample reaches its epochs without meeting any other
table. Epochs are told apart by (SubjectID, epoch_ix), whose groups hold one
window of samples per channel however long the recording is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochwise.config import Settings
from epochwise.functions.columns import RANGE_CHUNK, unfold
from epochwise.operators.numbering import number_by_chunk

EPOCH = ["SubjectID", "epoch_ix"]
CHANNEL = ["SubjectID", "epoch_ix", "Electrode"]


def recordings(channel_lengths: DataFrame, settings: Settings) -> DataFrame:
    """One row per subject; a recording is as long as its longest channel.

    A shorter channel gives the epochs that it fills; the others are rejects.
    """
    return channel_lengths.groupBy("SubjectID").agg(
        F.max("rows").alias("n_samples"),
        F.lit(settings.rate).alias("sfreq"),
        F.sort_array(F.collect_set("Electrode")).alias("electrodes"),
    )


def channel_lengths(signal: DataFrame) -> DataFrame:
    """Samples per channel of a signal numbered from 0, and their mean level."""
    return signal.groupBy("SubjectID", "Electrode").agg(
        (F.max("n") + 1).alias("rows"), F.avg("x").alias("level")
    )


def centred(signal: DataFrame, levels: DataFrame) -> DataFrame:
    """Take out each channel's mean; it cancels in every feature but spares digits."""
    level = levels.select("SubjectID", "Electrode", "level")
    return signal.join(level, ["SubjectID", "Electrode"]).select(
        "SubjectID", "Electrode", "n", (F.col("x") - F.col("level")).alias("x")
    )


def _start(ix: Column, s: Settings) -> Column:
    # Seconds first, then samples: the product is truncated as a whole.
    return (ix * F.lit(float(s.step)) * F.lit(float(s.rate))).cast("long")


def epoch_grid(recs: DataFrame, s: Settings, carry: Sequence[str] = ()) -> DataFrame:
    """Epochs of every recording: starts 0, step, ... before (last time - window).

    ``carry`` names columns of the recording that go along with its epochs.
    """
    room = (F.col("n_samples") - 1) / F.lit(float(s.rate)) - F.lit(float(s.window))
    count = F.ceil(room / F.lit(float(s.step)))
    grid = unfold(recs.select("SubjectID", *carry, count.alias("_n")), F.lit(0), F.col("_n") - 1, "epoch_ix")
    start = _start(F.col("epoch_ix"), s)
    return grid.select(
        "SubjectID",
        "epoch_ix",
        start.alias("start_sample"),
        (start + s.epoch_samples).alias("end_sample"),
        *carry,
    )


def epoch_range(n: Column, s: Settings) -> tuple[Column, Column]:
    """First and last epoch number whose window may hold sample ``n``."""
    # Steps that floats hold exactly need no margin for the truncated product.
    exact = all(float(v).as_integer_ratio()[1] <= 1 << 16 for v in (s.step, s.rate))
    margin = 0 if exact else 1
    stride = F.lit(s.stride)
    low = F.greatest(F.ceil((n - s.epoch_samples + 1) / stride) - margin, F.lit(0))
    high = F.ceil((n + 1) / stride) - 1 + margin
    return low.cast("long"), high.cast("long")


def assign_samples(signal: DataFrame, s: Settings) -> DataFrame:
    """Give each sample to every epoch whose window holds it.

    The epochs may reach past the last one of the recording; joining the epoch
    table later removes those. ``j`` is the place inside the epoch.
    """
    low, high = epoch_range(F.col("n"), s)
    j = F.col("n") - _start(F.col("epoch_ix"), s)
    return (
        signal.withColumn("_low", low)
        .withColumn("_high", high)
        .where("_low <= _high")
        .withColumn("epoch_ix", F.explode(F.sequence("_low", "_high")))
        .withColumn("j", j.cast("int"))
        .where((F.col("j") >= 0) & (F.col("j") < s.epoch_samples))
        .drop("_low", "_high")
    )


def epoch_lines(signal: DataFrame, s: Settings) -> DataFrame:
    """Least-squares line (``slope``, ``level``) of each channel in the epochs that it fills.

    Spark merges the co-moments of parts of an epoch, so samples are added up where
    they are read and only one row of moments per part is shuffled. Channels with gaps
    or an early end have no line there.
    """
    known = signal.where("n IS NOT NULL AND x IS NOT NULL")
    fits = assign_samples(known, s).groupBy(*CHANNEL).agg(
        F.count("x").alias("_held"),
        F.regr_slope("x", "j").alias("slope"),
        F.regr_intercept("x", "j").alias("level"),
    )
    return fits.where(F.col("_held") == s.epoch_samples).drop("_held")


def residuals(signal: DataFrame, lines: DataFrame, s: Settings) -> DataFrame:
    """Samples ``y`` without the line of their epoch, one row per sample of each line.

    Lines go to the stretches of samples that they cover, a few per stretch, and the
    samples shuffle once to meet them there; they are multiplied by their epochs only
    behind that. Other columns of ``lines`` go along.
    """
    width = s.epoch_samples
    own = [c for c in lines.columns if c not in ("SubjectID", "Electrode")]
    begun = lines.withColumn("start", _start(F.col("epoch_ix"), s))
    last = F.floor((F.col("start") + (width - 1)) / width)
    part = ["SubjectID", "Electrode", "part"]
    held = (
        begun.withColumn("part", F.explode(F.sequence(F.floor(F.col("start") / width), last)))
        .groupBy(*part)
        .agg(F.collect_list(F.struct("start", *own)).alias("lines"))
    )
    known = signal.where("n IS NOT NULL AND x IS NOT NULL").select("SubjectID", "Electrode", "n", "x")
    # Unfolded from few rows, the lines look smaller than they are.
    met = known.withColumn("part", F.floor(F.col("n") / width)).join(held.hint("merge"), part)
    placed = met.select("SubjectID", "Electrode", "n", "x", F.inline("lines")).withColumn(
        "j", (F.col("n") - F.col("start")).cast("int")
    )
    return placed.where((F.col("j") >= 0) & (F.col("j") < width)).select(
        "SubjectID", "Electrode", *[c for c in own if c not in ("slope", "level")], "n", "j", "x",
        (F.col("x") - (F.col("slope") * F.col("j") + F.col("level"))).alias("y"),
    )


def gather(samples: DataFrame) -> DataFrame:
    """An epoch's channels in one place."""
    return samples.select(*CHANNEL, "n", "j", "x").repartition(*EPOCH)


def whole(samples: DataFrame, s: Settings) -> DataFrame:
    """Samples of the channels that fill their epoch; others have gaps or end too early."""
    w = Window.partitionBy(*CHANNEL)
    return samples.withColumn("_held", F.count("x").over(w)).where(F.col("_held") == s.epoch_samples).drop("_held")


def detrend(samples: DataFrame) -> DataFrame:
    """Subtract the least-squares line of each channel in each epoch (column ``y``)."""
    w = (
        Window.partitionBy(*CHANNEL)
        .orderBy("j")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    slope = F.regr_slope("x", "j").over(w)
    level = F.regr_intercept("x", "j").over(w)
    return samples.withColumn("y", F.col("x") - (slope * F.col("j") + level))


def mark_bad(annotations: DataFrame) -> DataFrame:
    """Boundary events become BAD_boundary; other descriptions stay."""
    return annotations.withColumn(
        "description",
        F.when(F.col("description").contains("boundary"), F.lit("BAD_boundary")).otherwise(
            F.col("description")
        ),
    )


def bad_spans(annotations: DataFrame) -> DataFrame:
    """Spans to avoid: the description starts with ``bad`` in any case."""
    return (
        annotations.where(F.lower("description").startswith("bad"))
        .select("SubjectID", "onset", (F.col("onset") + F.col("duration")).alias("offset"))
        .distinct()
    )


def touched_epochs(spans: DataFrame, s: Settings) -> DataFrame:
    """(SubjectID, epoch_ix) of all epochs that overlap a span.

    A span is turned into a range of epoch numbers, so rejecting is an equi
    anti-join on the epoch, not a search over all spans of a subject.
    """
    rate = F.lit(float(s.rate))
    low = F.greatest(
        F.floor((F.col("onset") * rate - s.epoch_samples) / F.lit(s.stride)) - 1, F.lit(0)
    )
    high = F.ceil(F.col("offset") * rate / F.lit(s.stride)) + 1
    start = _start(F.col("epoch_ix"), s)
    last = s.epoch_samples - int(s.inclusive_end)
    return (
        unfold(spans, low, high, "epoch_ix")
        .where((start / rate < F.col("offset")) & ((start + last) / rate > F.col("onset")))
        .select(*EPOCH)
        .distinct()
    )


def reject(grid: DataFrame, touched: DataFrame) -> DataFrame:
    return grid.join(touched.hint("merge"), EPOCH, "left_anti")


def named(epochs: DataFrame) -> DataFrame:
    return epochs.withColumn("EpochID", F.concat(F.lit("ep-"), F.col("epoch_no").cast("string")))


def renumber(survivors: DataFrame) -> DataFrame:
    """Name the surviving epochs ``ep-0``, ``ep-1``, ... without gaps.

    ``epoch_ix`` is unique per subject, so a chunk never exceeds its width.
    """
    chunk = F.floor(F.col("epoch_ix") / F.lit(RANGE_CHUNK))
    return named(number_by_chunk(survivors, ["SubjectID"], chunk, ["epoch_ix"], "epoch_no"))


def epoch_table(
    recs: DataFrame, s: Settings, annotations: DataFrame | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """Surviving epochs with their final names; without annotations none is dropped."""
    grid = epoch_grid(recs, s, carry)
    if annotations is None:
        return named(grid.withColumn("epoch_no", F.col("epoch_ix")))
    return renumber(reject(grid, touched_epochs(bad_spans(mark_bad(annotations)), s)))


def keep_epochs(rows: DataFrame, epochs: DataFrame) -> DataFrame:
    """Keep rows of listed epochs and attach the epoch's name.

    The epoch table grows with the recordings but is unfolded from a tiny one,
    so its estimated size must not lead to a broadcast.
    """
    return rows.join(epochs.select(*EPOCH, "EpochID").hint("merge"), EPOCH)
