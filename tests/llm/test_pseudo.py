import math
import random

import numpy as np

from epochwise.llm import pseudo

SUBJECTS, VERBS, OBJECTS = "cat dog bird fox".split(), "sees hears likes finds".split(), "fish bread seeds milk".split()


def sentence(rng):
    return f"the {rng.choice(SUBJECTS)} {rng.choice(VERBS)} some {rng.choice(OBJECTS)} ."


def test_scores_match_brute_force():
    symbols = pseudo.Symbols(["a", "b", "c"], [5, 3, 2], {1: (4, 3), 2: (1, 1)}, 2)
    network = pseudo.Network(symbols.size, symbols.classes)
    texts = ["a b zz c", "q", "", "a a a a b"]
    ids = [symbols.encode(t) for t in texts]
    got = pseudo.document_scores(network, symbols, ids)
    for text_ids, value in zip(ids, got, strict=True):
        want = 0.0
        for i, token in enumerate(text_ids.tolist()):
            near = [text_ids[i + p] if 0 <= i + p < len(text_ids) else 0 for p in pseudo.PLACES]
            hidden = [math.tanh(network.bias[d] + sum(network.embed[k][s][d] for k, s in enumerate(near))) for d in range(pseudo.WIDTH)]
            logits = [network.out_bias[c] + sum(h * network.out[d][c] for d, h in enumerate(hidden)) for c in range(symbols.classes)]
            want += logits[symbols.class_of[token]] - math.log(sum(map(math.exp, logits))) + symbols.within[token]
        assert abs(want - value) < 1e-4 * max(1, abs(want))


def test_within_class_shares_sum_to_one():
    symbols = pseudo.Symbols([f"w{i}" for i in range(50)], list(range(100, 50, -1)), {3: (9, 4)}, 6)
    own = symbols.class_of[pseudo._LENGTHS + 1 :]
    sums = np.bincount(own, weights=np.exp(symbols.within[pseudo._LENGTHS + 1 :]))
    assert np.allclose(sums[sums > 0], 1, atol=1e-5)


def test_order_matters_to_a_trained_network(spark):
    rng = random.Random(2)
    texts = [" ".join(sentence(rng) for _ in range(30)) for _ in range(300)]
    shuffled = []
    for t in texts[:60]:
        words = t.split()
        rng.shuffle(words)
        shuffled.append(" ".join(words))
    rows = list(enumerate(texts + shuffled))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in pseudo.pseudo_likelihood(df).collect()}
    assert len(got) == len(rows) and all(r.n_tokens == 180 for r in got.values())
    better = np.mean([got[i].mean_score > got[300 + i].mean_score for i in range(60)])
    assert better > 0.95


def test_nulls_repeats_empty_and_clashing_columns(spark):
    schema = "doc_id long, text string, score string, ids int"
    assert pseudo.pseudo_likelihood(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b", "x", 1), (1, None, None, 1), (2, " \n", "x", 1), (3, "a b " * 5000, "x", 1), (3, "a b " * 5000, "x", 1)]
    got = pseudo.pseudo_likelihood(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (1, 0), (2, 0), (3, 10_000), (3, 10_000)]
    assert {r.mean_score for r in got if not r.n_tokens} == {None} and all(r.score <= 0 for r in got)


def test_context_tells_words_of_one_class_apart(spark):
    # Equal counts, one class; rare words of one length in different contexts too.
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["red apple .", "blue plane ."]) for _ in range(40)) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000, "red apple ."), (1001, "red plane .")], "doc_id long, text string")
    symbols = pseudo.count_words(df, classes=1)
    assert len(set(symbols.class_of[[symbols.ids["apple"], symbols.ids["plane"]]])) == 1
    network = pseudo.Network(symbols.size, symbols.classes)
    window, target = pseudo.windows([symbols.encode(t) for t in texts])
    for at in range(0, len(target), 512):
        network.learn(window[:, at : at + 512], target[at : at + 512], symbols, 0.5)
    good, bad = pseudo.document_scores(network, symbols, [symbols.encode("red apple ."), symbols.encode("red plane .")])
    assert good > bad + 0.5


def test_all_frequent_words_are_known_and_every_word_has_its_probability(spark):
    words = [f"word{i:05d}" for i in range(3000)]
    rare = [f"rare{i:05d}" for i in range(500)]
    df = spark.createDataFrame([(0, " ".join(words * pseudo.MIN_COUNT + rare))], "doc_id long, text string")
    symbols = pseudo.count_words(df)
    assert set(symbols.ids) == set(words)
    assert len({int(symbols.encode(w)[0]) for w in rare}) > 400  # not one symbol by length
    # Within each class all words add up to one in any hidden state.
    network = pseudo.Network(symbols.size, symbols.classes)
    draw = np.random.Generator(np.random.PCG64(3))
    network.nodes[:] = draw.normal(0, 1, network.nodes.shape)
    ids = np.concatenate([symbols.encode(w) for w in words + rare]).astype(np.int64)
    hidden = np.repeat(draw.normal(0, 1, (1, pseudo.WIDTH)).astype(np.float32), len(ids), axis=0)
    sums = np.bincount(symbols.class_of[ids], weights=np.exp(network.log_within(hidden, ids, symbols)))
    assert np.allclose(sums[sums > 0], 1, atol=1e-4)


def test_rows_move_by_their_means_and_a_batch_may_have_no_rows():
    table = np.zeros((4, 2), dtype=np.float32)
    pseudo.Network._move(table, np.zeros(0, dtype=np.int64), np.zeros((2, 0), dtype=np.float32), 0.5)
    assert not table.any()
    pseudo.Network._move(table, np.array([2, 0, 2]), np.array([[1, 2, 3], [4, 5, 6]], dtype=np.float32), 17.0)
    assert np.allclose(table, [[-2, -5], [0, 0], [-17 * 4 / 18, -17 * 10 / 18], [0, 0]])


def test_levels_hold_every_decision_once_and_shrink():
    draw = np.random.Generator(np.random.PCG64(5))
    counts = sorted(draw.integers(10, 5000, 300).tolist(), reverse=True)
    symbols = pseudo.Symbols([f"w{i}" for i in range(300)], counts, {3: (9, 4)}, 6, [(3, 1, 5, 2), (3, 7, 4, 2)])
    target = draw.integers(pseudo._LENGTHS + 1, symbols.size, 500)
    target[:3] = 3  # no decision
    order = symbols.deepest_first(target)
    got, sizes = [[] for _ in target], []
    for codes in symbols.levels(target[order]):
        sizes.append(len(codes))
        for at, code in zip(order[: len(codes)].tolist(), codes.tolist(), strict=True):
            got[at].append(code)
    assert sizes == sorted(sizes, reverse=True)
    for symbol, codes in zip(target.tolist(), got, strict=True):
        want, code = [], int(symbols.leaf[symbol])
        while code:
            want.append(code)
            code = int(symbols.up[abs(code) - 1])
        assert codes == want and len(want) == symbols.depth[symbol]
    assert list(symbols.levels(np.full(4, 3))) == [] and list(symbols.levels(target[:0])) == []


def test_learning_moves_every_parameter_by_hand():
    symbols = pseudo.Symbols(list("abcdef"), [9, 7, 5, 4, 2, 1], {1: (4, 3)}, 2)
    network = pseudo.Network(symbols.size, symbols.classes)
    draw = np.random.Generator(np.random.PCG64(6))
    network.nodes[:] = draw.normal(0, 1, network.nodes.shape)
    window, target = pseudo.windows([symbols.encode(t) for t in ("a b c d e f a q", "f f a b")])
    embed, bias, out, out_bias, nodes = (p.astype(np.float64) for p in (network.embed, network.bias, network.out, network.out_bias, network.nodes))
    moves = [np.zeros_like(p) for p in (embed, bias, out, out_bias, nodes)]
    seen, passed = np.zeros(embed.shape[:2]), np.zeros(len(nodes))
    for near, token in zip(window.T.tolist(), target.tolist(), strict=True):
        hidden = np.tanh(bias + sum(embed[k, row] for k, row in enumerate(near)))
        logits = hidden @ out + out_bias
        error = np.exp(logits) / np.exp(logits).sum()
        error[symbols.class_of[token]] -= 1
        back, code = out @ error, int(symbols.leaf[token])
        while code:
            node, side = abs(code) - 1, np.sign(code)
            row = symbols.node_row[node]
            wrong = -side / (1 + np.exp(side * (symbols.prior[node] + hidden @ nodes[row])))
            back = back + wrong * nodes[row]
            moves[4][row] += wrong * hidden
            passed[row] += 1
            code = int(symbols.up[node])
        back = back * (1 - hidden * hidden)
        moves[1] += back / len(target)
        moves[2] += np.outer(hidden, error) / len(target)
        moves[3] += error / len(target)
        for k, row in enumerate(near):
            moves[0][k, row] += back
            seen[k, row] += 1
    moves[0] /= seen[:, :, None] + 16
    moves[4] /= passed[:, None] + 16
    network.learn(window, target, symbols, 0.5)
    for now, before, move in zip((network.embed, network.bias, network.out, network.out_bias, network.nodes), (embed, bias, out, out_bias, nodes), moves, strict=True):
        assert np.allclose(now, before - 0.5 * move, atol=1e-5)


def test_texts_encoded_together_are_as_each_alone():
    words = ["a", "b", "word", "été", "x" * 30]
    symbols = pseudo.Symbols(words, [9, 7, 5, 4, 2], {1: (4, 3)}, 2, [(3, 5, 2, 1)])
    texts = ["", " ", "a  B\n\tword", "Été ΑΣ zz\x0b", "\x85 \x1c", "x" * 30 + " " + "y" * 50, " a", "a "]
    got = symbols.encode_all(texts)
    for text, found in zip(texts, got, strict=True):
        plain = [w for w in text.lower().translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if w]
        assert found.tolist() == [symbols.ids.get(w) or symbols._other(w) for w in plain] == symbols.encode(text).tolist()
    assert symbols.encode_all([]) == []
