"""Toxicity by weak supervision.

1. Voters are found: words and beginnings of words that toxic rows of a bounded
   labelled sample have far more often than clean ones, and density patterns.
2. Every text is read once; a document keeps a bit for each voter that fires.
3. A generative label model estimates, without labels, how often each voter fires on
   toxic and on clean documents (expectation maximisation over the counts of vote
   patterns), and how voters are correlated given the class. Correlated voters share
   their weight. It gives each training document a posterior label.
4. A linear classifier (Newton steps of a penalised logistic regression) is trained
   on the posterior labels of all training documents and scores every document.

Sums are taken in tasks and added up by Spark; only matrices of voters x voters reach
the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.llm.common import id_and_text, named
from epochwise.storage import stage

# Labelled rows that voters are found in, about: chosen by a hash of the id.
MAX_LABELLED = 10_000
MAX_VOTERS = 48
# Candidates looked at on the driver.
_CANDIDATES = 600
_PREFIXES = (3, 4, 5, 6, 7)
# A voter fires on so many toxic sample rows at least (a count, and a share of them),
# and so many standard deviations more often than at the share of toxic rows.
_MIN_TOXIC = 6
_MIN_TOXIC_SHARE = 0.03
_MIN_DEVIATIONS = 7.0
_ROUNDS = 10
_NEWTON_STEPS = 6
_PENALTY = 1.0
# Density voters: hits, and share of words in hundredths, that a text must reach.
_DENSITIES = ((2, 0), (3, 1), (4, 3))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose crc32 of the id's text is divisible by five; a null id is none."""
    return F.coalesce(F.crc32(named(doc_id).cast("string")) % 5 == 0, F.lit(False))


def find_voters(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[str]:
    """Voters ``w:word`` or ``p:beginning``, best first; from labelled rows that are not held out.

    Labelled rows are taken by a hash of their id, about ``max_labelled`` of them, so
    the ids may be broadcast.
    """
    known = (
        labels.where(~held_out() & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("double").alias("toxic"))
    )
    told = known.agg(F.count(F.lit(1)).alias("every"), F.sum("toxic").alias("toxic")).first()
    if not told.toxic:
        return []
    share, base = min(1.0, max_labelled / told.every), min(0.9, told.toxic / told.every)
    least = max(_MIN_TOXIC, _MIN_TOXIC_SHARE * share * told.toxic)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    prefixes = ", ".join(
        f"transform(filter(ws, w -> length(w) > {n}), w -> concat('p:', substring(w, 1, {n})))" for n in _PREFIXES
    )
    spotted = (
        docs.join(F.broadcast(chosen), "doc_id")
        .selectExpr(
            "toxic",
            "transform(array(array_distinct(split(lower(text), '[^\\\\p{L}]+'))), ws -> "
            f"array_distinct(concat(transform(ws, w -> concat('w:', w)), {prefixes})))[0] as found",
        )
        .select("toxic", F.explode("found").alias("voter"))
        .groupBy("voter")
        .agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("every"))
        .where((F.length("voter") > 4) & (F.col("toxic") >= least))
        .withColumn("gain", (F.col("toxic") - base * F.col("every")) / F.sqrt(base * (1 - base) * F.col("every")))
        .where(F.col("gain") >= _MIN_DEVIATIONS)
        .orderBy(F.desc("gain"), F.desc(F.length("voter")), "voter")
        .limit(_CANDIDATES)
        .collect()
    )
    voters: list[str] = []
    for row in spotted:
        kind, stem = row.voter[:2], row.voter[2:]
        related = any(stem.startswith(v[2:]) or v[2:].startswith(stem) for v in voters)
        if stem and not related and len(voters) < MAX_VOTERS:
            voters.append(kind + stem)
    return voters


def _automaton(voters: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for i, voter in enumerate(voters):
        made.add_word(voter[2:], (i, voter[0] == "w", len(voter) - 2))
    made.make_automaton()
    return made


def _fired(automaton: ahocorasick.Automaton, text: str) -> tuple[int, int]:
    """Bits of the voters that fire in a lower-case text, and how often any does."""
    bits = hits = 0
    for end, (i, whole, size) in automaton.iter(text):
        if end >= size and text[end - size].isalpha():
            continue
        if whole == (end + 1 < len(text) and text[end + 1].isalpha()):
            continue
        bits |= 1 << i
        hits += 1
    return bits, hits


def votes(docs: DataFrame, voters: list[str]) -> DataFrame:
    """doc_id, votes (one bit per voter), hits and words of every whole text."""

    @F.pandas_udf("votes long, hits long, words long")
    def cast_votes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(voters)
        for texts in batches:
            out = np.zeros((len(texts), 3), dtype=np.int64)
            for row, text in enumerate(texts):
                bits, hits = _fired(automaton, text.lower()) if voters else (0, 0)
                words = len(text.split()) if hits else 0
                for k, (least, percent) in enumerate(_DENSITIES):
                    if hits >= least and 100 * hits >= percent * words:
                        bits |= 1 << (len(voters) + k)
                out[row] = bits, hits, words
            yield pd.DataFrame(out, columns=["votes", "hits", "words"])

    return docs.select("doc_id", cast_votes("text").alias("_v")).select("doc_id", "_v.*")


def _bits(column: pd.Series, n: int) -> np.ndarray:
    return ((column.to_numpy(dtype=np.int64)[:, None] >> np.arange(n)) & 1).astype(np.float64)


def _summed(df: DataFrame, part: Callable[[pd.DataFrame], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum of ``part`` over the batches of ``df``: added up in each task, then by Spark."""
    size = int(np.prod(shape))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            total += part(batch).ravel()
        yield pd.DataFrame({"i": np.arange(size), "v": total})

    out = np.zeros(size)
    for row in df.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[row.i] = row.v
    return out.reshape(shape)


class LabelModel:
    """Rates of firing per class, the share of toxic documents, and weights of the voters."""

    def __init__(self, n: int) -> None:
        self.prior = 0.1
        self.rates = np.vstack([np.full(n, 0.005), np.full(n, 0.25)])  # clean, toxic
        self.weights = np.ones(n)

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        on = np.log(self.rates[1] / self.rates[0]) * self.weights
        off = np.log((1 - self.rates[1]) / (1 - self.rates[0])) * self.weights
        logit = np.log(self.prior / (1 - self.prior)) + fired @ on + (1 - fired) @ off
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def _step(self, patterns: DataFrame) -> None:
        n = len(self.weights)

        def part(batch: pd.DataFrame) -> np.ndarray:
            fired, count = _bits(batch["votes"], n), batch["count"].to_numpy(dtype=np.float64)
            p = self.posterior(fired)
            both = np.vstack([count * (1 - p), count * p])
            return np.column_stack([both @ fired, both.sum(axis=1)])

        got = _summed(patterns, part, (2, n + 1))
        self.rates = np.clip((got[:, :n] + [[0.01], [0.1]]) / (got[:, n:] + 2), 1e-6, 1 - 1e-6)
        self.prior = float(np.clip(got[1, n] / max(1e-9, got[:, n].sum()), 1e-3, 0.6))

    def _share_weights(self, patterns: DataFrame) -> None:
        """Correlations of voters given the class; a group of correlated voters weighs less."""
        n = len(self.weights)

        def part(batch: pd.DataFrame) -> np.ndarray:
            fired, count = _bits(batch["votes"], n), batch["count"].to_numpy(dtype=np.float64)
            p = self.posterior(fired)
            return np.stack([(fired * (count * q)[:, None]).T @ fired for q in (1 - p, p)])

        seconds = _summed(patterns, part, (2, n, n))
        toxic = max(1e-9, seconds[1].diagonal().max() / max(1e-9, self.rates[1].max()))
        mean = self.rates[1]
        spread = np.sqrt(mean * (1 - mean))
        tied = (seconds[1] / toxic - np.outer(mean, mean)) / np.outer(spread, spread)
        np.fill_diagonal(tied, 0)
        self.weights = 1 / (1 + np.where(tied > 0.1, np.minimum(tied, 1), 0).sum(axis=1))

    def fit(self, patterns: DataFrame) -> LabelModel:
        """``patterns``: votes and how many documents cast them."""
        for _ in range(_ROUNDS):
            self._step(patterns)
        self._share_weights(patterns)
        for _ in range(_ROUNDS // 3):
            self._step(patterns)
        return self


def _features(batch: pd.DataFrame, n: int) -> np.ndarray:
    hits, words = (batch[c].to_numpy(dtype=np.float64) for c in ("hits", "words"))
    dense = np.minimum(1.0, 10 * hits / np.maximum(1, words))
    return np.column_stack([np.ones(len(batch)), _bits(batch["votes"], n), np.log1p(hits), dense])


def fit_classifier(cast: DataFrame, model: LabelModel) -> np.ndarray:
    """Coefficients of a logistic regression on the posterior labels of ``cast``."""
    n = len(model.weights)
    size = n + 3
    beta = np.zeros(size)
    for _ in range(_NEWTON_STEPS):

        def part(batch: pd.DataFrame, beta: np.ndarray = beta) -> np.ndarray:
            x = _features(batch, n)
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            gradient = x.T @ (model.posterior(_bits(batch["votes"], n)) - p)
            return np.column_stack([(x * (p * (1 - p))[:, None]).T @ x, gradient])

        got = _summed(cast, part, (size, size + 1))
        penalty = np.full(size, _PENALTY)
        penalty[0] = 1e-6
        beta = beta + np.linalg.solve(got[:, :size] + np.diag(penalty), got[:, size] - penalty * beta)
    return beta


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = MAX_LABELLED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every document.

    ``labels`` (doc_id, toxic) help to find voters only, and held-out rows never do.
    A null or empty text has no votes and gets the score of such documents; where no
    voter is found (no labels, no toxic rows), every score is 0. Null labels are
    unknown; a document is toxic if any of its repeated labels is.
    """
    texts = id_and_text(docs, id_col, text_col)
    voters = find_voters(texts, labels.select("doc_id", "toxic"), max_labelled)
    flags = ("doc_id", held_out().alias("held_out"))
    if not voters:
        return texts.select(*flags, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    cast = stage(votes(texts, voters), "votes")
    training = cast.where(~held_out())
    patterns = stage(training.groupBy("votes").count(), "vote-patterns")
    n = len(voters) + len(_DENSITIES)
    beta = fit_classifier(training.select("votes", "hits", "words"), LabelModel(n).fit(patterns))

    @F.pandas_udf("double")
    def scored(votes_: pd.Series, hits: pd.Series, words: pd.Series) -> pd.Series:
        x = _features(pd.DataFrame({"votes": votes_, "hits": hits, "words": words}), n)
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))))

    score = F.col("score")
    return cast.select(*flags, scored("votes", "hits", "words").alias("score")).withColumn(
        "predicted", (score >= 0.5).cast("int")
    )
