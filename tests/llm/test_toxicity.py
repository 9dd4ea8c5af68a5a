"""Nearest examples equal brute force; votes are calibrated; held-out accuracy."""

import random

import numpy as np

from ebbtide.llm import toxicity
from ebbtide.llm.queries import op7_toxicity
from ebbtide.llm.texts import read_table
from tests.llm.cases import ROWS, documents


def made_index(n=500, terms=40, seed=1):
    r = random.Random(seed)
    counts = [{r.randrange(terms): r.randrange(1, 5) for _ in range(r.randrange(0, 8))} for _ in range(n)]
    counts += counts[:100]  # copies, so ties
    idf = np.array([1 + r.random() * 5 for _ in range(terms)])
    labels = np.array([float(r.random() < 0.3) for _ in counts])
    return toxicity.Index([f"t{k}" for k in range(terms)], idf, counts, labels, np.ones(len(counts))), counts


def brute(index, counts, query, k, without=-1):
    def dense(c):
        v = np.zeros(len(index.idf))
        t, x = index.vector(c)
        v[t] = x
        return v

    cosines = [(-round(float(dense(c) @ dense(query)), 12), e) for e, c in enumerate(counts) if e != without]
    return [e for s, e in sorted(cosines) if s < 0][:k]


def test_block_max_search_is_exact():
    index, counts = made_index()
    r = random.Random(9)
    for number in range(150):
        query = {r.randrange(40): r.randrange(1, 4) for _ in range(r.randrange(0, 6))}
        without = number if number % 2 else -1
        found, cosines = index.nearest(query, k=10, without=without)
        assert found.tolist() == brute(index, counts, query, 10, without)
        assert (np.diff(cosines) <= 1e-9).all() and without not in found.tolist()


def test_texts_searched_together_find_what_brute_force_finds(monkeypatch):
    """Frequent terms stand in the matrix, the others in lists; copies tie exactly, and rounding decides nothing."""
    monkeypatch.setattr(toxicity, "DENSE", 5)
    index, counts = made_index(n=700, terms=60, seed=3)
    assert (index.frequent[0] >= 0).sum() == 5
    r = random.Random(4)
    queries = [{r.randrange(60): r.randrange(1, 4) for _ in range(r.randrange(0, 9))} for _ in range(90)] + counts[:60]
    found = index.nearest_of(queries, 10, [-1] * 90 + list(range(60)))
    for number, (query, (ids, cosines)) in enumerate(zip(queries, found, strict=True)):
        assert ids.tolist() == brute(index, counts, query, 10, number - 90 if number >= 90 else -1)
        alone = index.nearest(query, k=10, without=number - 90 if number >= 90 else -1)
        assert alone[0].tolist() == ids.tolist() and alone[1].tolist() == cosines.tolist()
    assert not {"frequent", "by_example", "packed"} & set(index.__getstate__())


def test_terms_of_ascii_texts_are_those_of_the_pattern():
    text = "".join(map(chr, range(128))) + " It's a_b c1d\x1fe\tF"
    assert toxicity.terms_of(text) == toxicity.LETTER_RUNS.findall(text.lower())
    assert toxicity.terms_of("Ünder ǅ x²y") == toxicity.LETTER_RUNS.findall("ünder ǆ x²y") and toxicity.terms_of(None) == []


def test_blocks_are_skipped_when_they_cannot_win():
    index, _ = made_index(n=3000)
    first = {0: 1}
    bounds = index.vector(first)[1] @ index.maxima[[0]]
    assert bounds.max() <= 1 + 1e-9 and len(index.nearest(first, k=3)[0]) == 3


def test_logistic_curve_recovers_rates():
    votes = np.repeat([0.0, 0.5, 1.0], 1000)
    labels = np.concatenate([np.arange(1000) < n for n in (50, 500, 950)]).astype(float)
    slope, offset = toxicity._logistic(votes, labels, np.ones(3000))
    assert np.allclose(1 / (1 + np.exp(-(slope * np.array([0, 0.5, 1]) + offset))), [0.05, 0.5, 0.95], atol=0.01)


def taught(spark, n=60):
    r = random.Random(6)
    rows = [(k, " ".join(r.choices("alpha beta gamma delta epsilon zeta".split(), k=20)) + (" vile" if k % 3 == 0 else ""), "en", "s", 0) for k in range(n)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(n)], "doc_id long, toxic int")
    return documents(spark, rows), labels


def test_learned_terms_and_odd_rows(spark):
    docs, labels = taught(spark)
    more = labels.union(spark.createDataFrame([(0, 0), (None, 1), (999, 1), (5, None)], "doc_id long, toxic int"))
    model = toxicity.learn(docs, more)
    assert "vile" in model.index.vocabulary and model.score("so VILE a thing") > 0.6 > 0.3 > model.score("alpha beta") >= 0
    assert model.score(None) == model.score("") == model.score("unseen words")
    odd = documents(spark)
    found = odd.select("doc_id", toxicity.score(odd, model).alias("s")).collect()
    assert len(found) == len(ROWS) and all(0 <= r["s"] <= 1 for r in found)


def test_vectors_hold_every_term_of_the_examples(spark):
    docs, labels = taught(spark)
    index = toxicity.learn(docs, labels).index
    words = {w for r in docs.collect() for w in r["text"].split()}
    assert set(index.vocabulary) == words and {"alpha", "zeta"} < words
    number = index.vocabulary
    assert index.idf.min() > 0 and index.idf[number["vile"]] > 2 * index.idf[number["alpha"]]
    only = index.nearest({number["alpha"]: 1})[0]
    assert len(only) == toxicity.NEAREST


def test_every_term_moves_the_score(spark):
    """Everyday words alone choose the neighbours of a text without a telling word."""
    rows = [(k, ("red green blue " * 3 if k % 2 else "one two three " * 3) + f"word{chr(97 + k % 5)}", "en", "s", 0) for k in range(40)]
    labels = spark.createDataFrame([(k, int(k % 2 == 1 and k % 3 != 0)) for k in range(40)], "doc_id long, toxic int")
    model = toxicity.learn(documents(spark, rows), labels)
    assert model.score("green blue") > 0.5 > model.score("two three")


def test_without_examples_the_rate_is_left(spark):
    docs, labels = taught(spark)
    assert toxicity.learn(docs, labels.limit(0)).score("vile") == 0.0
    assert toxicity.learn(docs, labels.where("toxic = 1")).score("vile") == 1.0
    assert 0 < toxicity.learn(docs.limit(0), labels).score("vile") < 1
    assert docs.limit(0).select(toxicity.score(docs, toxicity.learn(docs, labels))).count() == 0


def test_sample_is_bounded_per_class(spark):
    _, labels = taught(spark)
    rows, sizes = toxicity.sample(labels, 7)
    assert sizes == {0: 40, 1: 20} and {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()} == {0: 7, 1: 7}


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in read_table(spark, sf_dir, "labels").collect()}
    found = op7_toxicity(spark, sf_dir).collect()
    assert len(found) == read_table(spark, sf_dir, "documents").count()
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in found if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for _, y, p in held) >= 0.85 * len(held)
    toxic, clean = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    assert np.mean([a > b for a in toxic for b in clean]) + 0.5 * np.mean([a == b for a in toxic for b in clean]) >= 0.8
