"""Passages cover the text; the gradient is right; held-out accuracy."""

import numpy as np

from ebbtide.llm import quality_attention as qa
from ebbtide.llm.queries import op10_quality_attention
from ebbtide.llm.texts import read_table
from tests.llm.cases import LONG, ROWS, documents


def test_passages_cover_the_whole_text():
    words = LONG.split()
    rows = qa.passages(LONG)
    assert len(rows) == -(-len(words) // qa.WORDS) and np.allclose(rows[:, :-3].sum(axis=1), 1)
    one = qa.passages(" A b\n2 %")
    pairs = one[0, :-3].reshape(qa._KINDS, qa._KINDS)
    lower, upper, digit, blank, line, symbol = 0, 1, 2, 3, 4, 7
    expected = {(blank, upper), (upper, blank), (blank, lower), (lower, line), (line, digit), (digit, blank), (blank, symbol), (symbol, line)}
    assert {tuple(p) for p in np.argwhere(pairs > 0).tolist()} == expected
    assert np.allclose(one[0, -3:], [0.1, 1.0, 0.0]) and np.allclose(qa.passages("x x y x")[0, -2:], [0.5, 0.25])


def test_texts_without_words_are_one_empty_passage():
    for text in (None, "", " \n\t"):
        assert qa.passages(text).shape == (1, qa.FEATURES) and not qa.passages(text).any()


def test_a_passage_at_the_end_counts():
    plain = "word " * (qa.WORDS * 3)
    assert not np.allclose(qa.passages(plain + "%%% " * qa.WORDS)[-1], qa.passages(plain)[-1])


def test_grouping_keeps_the_whole_bag():
    rows = np.random.default_rng(0).random((1000, 4))
    grouped = qa._grouped(rows)
    sizes = np.diff([*(np.arange(qa.BAG) * 1000 // qa.BAG), 1000])
    assert len(grouped) == qa.BAG and np.allclose((grouped * sizes[:, None]).sum(axis=0), rows.sum(axis=0))


def test_gradient_equals_differences():
    random = np.random.default_rng(1)
    rows, starts = random.random((9, qa.FEATURES)), np.array([0, 2, 3, 7])
    labels, weights = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 3, 0.5])
    network = qa.Network.start(rows, 2)

    def loss():
        p = network.forward(rows, starts)[0]
        return -(weights * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() / weights.sum()

    for k, slope in enumerate(network.gradient(rows, starts, labels, weights)):
        for place in [tuple(random.integers(0, n) for n in slope.shape) for _ in range(4)]:
            network.theta[k][place] += 1e-6
            above = loss()
            network.theta[k][place] -= 2e-6
            below = loss()
            network.theta[k][place] += 1e-6
            assert abs((above - below) / 2e-6 - slope[place]) < 1e-6


def test_attention_sums_to_one_and_finds_the_odd_passage():
    good = [qa.passages("plain words here " * 60) for _ in range(40)]
    bad = [np.concatenate([qa.passages("plain words here " * 60), qa.passages("%%% " * 64)]) for _ in range(40)]
    network = qa.fit(good + bad, np.array([1.0] * 40 + [0.0] * 40), np.ones(80))
    p, a, _ = network.forward(np.concatenate([good[0], bad[0]]), np.array([0, len(good[0])]))
    assert p[0] > 0.8 > 0.2 > p[1] and np.allclose(np.add.reduceat(a, [0, len(good[0])]), 1)


def test_odd_rows_and_labels(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 1), (6, 0), (2, 1), (3, 0), (None, 1), (99, 0), (7, None)], "doc_id long, quality int")
    for taught in (labels, labels.limit(0), labels.where("quality = 1")):
        model = qa.learn(docs, taught)
        found = docs.select("doc_id", qa.score(docs, model).alias("s")).collect()
        assert len(found) == len(ROWS) and all(0 <= r["s"]["score"] <= 1 and r["s"]["n_passages"] >= 1 for r in found)
    assert qa.learn(docs.limit(0), labels).score("x")[0] == 2 / 6
    assert docs.limit(0).select(qa.score(docs, qa.Constant(0.5))).count() == 0


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, sf_dir, "labels").collect()}
    found = op10_quality_attention(spark, sf_dir).collect()
    assert len(found) == read_table(spark, sf_dir, "documents").count()
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in found if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for _, y, p in held) >= 0.9 * len(held)
