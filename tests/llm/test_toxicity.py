import random
import zlib

import numpy as np

from epochwise.llm import toxicity


def corpus(n=900, seed=3):
    """Clean prose, and toxic prose that uses three insults and words that begin with 'vraxo'."""
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in "ba ce di fo gu ha ki".split() for b in "lan mer tos vin pur sed rok".split()]
    rude = ["nitwit", "dolt", "oaf", "vraxolan", "vraxomer", "vraxotos"]
    texts, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(30, 90))]
        if toxic:
            for _ in range(rng.randint(3, 8)):
                words[rng.randrange(len(words))] = rng.choice(rude)
        elif i % 50 == 1:
            words[0] = "dolt"
        texts.append((i, " ".join(words).capitalize()))
        labels.append((i, int(toxic)))
    return texts, labels


def test_held_out_accuracy(spark):
    texts, labels = corpus()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, known).collect()}
    assert len(got) == len(texts)
    for i, row in got.items():
        assert row.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.5)
    outside = [(got[i].predicted, toxic) for i, toxic in labels if got[i].held_out]
    assert np.mean([p == t for p, t in outside]) > 0.97
    # Labels of held-out rows change nothing.
    turned = [(i, 1 - t if got[i].held_out else t) for i, t in labels]
    again = toxicity.toxicity_scores(docs, spark.createDataFrame(turned, known.schema)).collect()
    assert {r.doc_id: round(r.score, 9) for r in again} == {i: round(r.score, 9) for i, r in got.items()}


def test_votes_match_brute_force(spark):
    voters = ["w:oaf", "p:vrax", "w:straße"]
    texts = ["", "oaf", "oafs", "loaf oaf.", "Vrax vraxo vraxolan", "STRASSE straße", "oaf " * 50, "x" * 100_000 + " oaf"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.votes & 7, r.hits) for r in toxicity.votes(docs, voters).collect()}
    assert got == {0: (0, 0), 1: (1, 1), 2: (0, 0), 3: (1, 1), 4: (2, 2), 5: (4, 1), 6: (1, 50), 7: (1, 1)}


def test_correlated_voters_share_their_weight(spark):
    rng = np.random.default_rng(5)
    toxic = rng.random(4000) < 0.2
    fired = [(rng.random(4000) < np.where(toxic, 0.6, 0.02)) for _ in range(4)]
    bits = sum(f.astype(int) << k for k, f in enumerate([*fired, fired[0]]))  # the fifth repeats the first
    patterns = spark.createDataFrame([(int(b),) for b in bits], "votes long").groupBy("votes").count()
    model = toxicity.LabelModel(5).fit(patterns)
    assert max(model.weights[0], model.weights[4]) < 0.6 and min(model.weights[1:4]) > 0.7
    assert abs(model.rates[1][1] - 0.6) < 0.1 and abs(model.rates[0][1] - 0.02) < 0.02


def test_nulls_repeats_empty_and_clashing_columns(spark):
    schema = "doc_id long, text string, toxic string, votes int"
    known = spark.createDataFrame([(1, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(spark.createDataFrame([], schema), known).count() == 0
    rows = [(None, "a", "x", 1), (1, None, None, 1), (1, None, None, 1), (2, "", "x", 1)]
    got = toxicity.toxicity_scores(spark.createDataFrame(rows, schema), known).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.0} and {r.predicted for r in got} == {0}
    texts, labels = corpus(300)
    docs = spark.createDataFrame([*texts, (None, "nitwit oaf dolt"), (5000, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got[None] > 0.5 > got[5000]
