"""Words first, n-grams after; held-out accuracy; defined results for odd rows."""

import numpy as np

from ebbtide.llm import language_id
from ebbtide.llm.queries import op8_language_id
from ebbtide.llm.texts import read_table
from tests.llm.cases import ROWS, by_id, documents


def taught(spark, *rows, **sizes):
    return language_id.learn(spark.createDataFrame(rows, "text string, lang string"), **sizes)


def identified(spark, model, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = df.select("doc_id", language_id.identify(df, model).alias("found")).orderBy("doc_id").collect()
    return [(r["found"]["lang_pred"], r["found"]["score"]) for r in rows]


def test_known_words_count_before_letters(spark):
    model = taught(spark, ("ba ba ba", "x"), ("bo bo bo", "y"), ("baba", "y"))
    scorer = language_id.Scorer(model)
    assert scorer("ba")[0] == "x" and scorer("BO ba bo")[0] == "y"
    assert np.allclose(model.word("ba"), model.words["ba"])


def test_unknown_words_fall_back_to_shorter_grams(spark):
    model = taught(spark, ("strasse gasse masse", "de"), ("rue vue que", "fr"))
    assert "klasse" not in model.words
    assert [f[0] for f in identified(spark, model, "klasse", "avenue", "sse", "ue")] == ["de", "fr", "de", "fr"]


def test_back_off_takes_the_longest_known_gram():
    model = language_id.Model(["a", "b"], {}, {"a": 1, "b": 1}, {"^k": {"a": 5}, "k": {"b": 9}, "$": {"a": 1}}, {1: {"a": 1, "b": 9}, 2: {"a": 5}})
    only = model.gram_logs[model.grams["^k"]] + model.gram_logs[model.grams["k"]]
    assert np.allclose(model.word("k"), only / 2)


def test_odd_texts_and_ties(spark):
    model = taught(spark, ("same words", "p"), ("same words", "q"))
    found = identified(spark, model, None, "", "12 34 %%", "²²", "same", "SAME 12")
    assert [f[0] for f in found] == ["und"] * 4 + ["p", "p"]
    assert [f[1] for f in found[:4]] == [0.0] * 4 and abs(found[4][1] - 0.5) < 1e-6


def test_nothing_to_learn_from(spark):
    empty = documents(spark).limit(0)
    model = language_id.learn(empty)
    docs = documents(spark)
    found = docs.select("doc_id", language_id.identify(docs, model).alias("f")).collect()
    assert len(found) == len(ROWS) and {r["f"]["lang_pred"] for r in found} == {"und"}
    assert empty.select(language_id.identify(empty, model)).count() == 0


def test_model_size_is_bounded(spark):
    rows = [(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" + " common", "x") for k in range(200)]
    model = taught(spark, *rows, max_words=50, max_grams=20)
    assert "common" in model.words and len(model.words) <= 50 and len(model.grams) <= 20


def test_limit_holds_for_counts_beyond_the_histogram(spark, monkeypatch):
    monkeypatch.setattr(language_id, "HIGHEST", 2)
    rows = [(" ".join(["".join(chr(97 + (k * 7 + i) % 26) for i in range(4))] * (k + 1)), "x") for k in range(40)]
    model = taught(spark, *rows, max_words=3, max_grams=3)
    assert 1 <= len(model.words) <= 3 and len(model.grams) <= 3
    assert set(model.words) <= {rows[k][0].split()[0] for k in (37, 38, 39)}


def test_odd_rows_with_a_model(spark):
    docs = documents(spark)
    model = language_id.learn(docs)
    found = docs.select("doc_id", "text", language_id.identify(docs, model).alias("f")).collect()
    assert len(found) == len(ROWS)
    assert all((r["f"]["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in found)


def test_held_out_accuracy(spark, sf_dir):
    found = by_id(op8_language_id(spark, sf_dir))
    truth = {r["doc_id"]: r["lang"] for r in read_table(spark, sf_dir, "documents").collect()}
    assert set(found) == set(truth)
    held = [i for i, r in found.items() if r["held_out"] and truth[i]]
    assert sum(found[i]["lang_pred"] == truth[i] for i in held) >= 0.97 * len(held)


def test_many_texts_score_as_one_by_one(spark, monkeypatch):
    """Texts scored together, in parts and with a small store get what each gets alone, and unknown words their own n-grams."""
    model = taught(spark, ("strasse gasse masse", "de"), ("rue vue que", "fr"))
    texts = ["klasse avenue", None, "", "²² 12", "rue ² RUE", "x" * 500, "masse klasse que neu"] * 9
    alone = [language_id.Scorer(model)(t) for t in texts]
    monkeypatch.setattr(language_id, "CHARACTERS", 64)
    monkeypatch.setattr(language_id, "KEPT", 3)
    langs, scores = language_id.Scorer(model).all(texts)
    assert list(zip(langs, scores, strict=True)) == alone and alone[3] == ("und", 0.0) and alone[1] == ("und", 0.0)
    words = ["masse", "klasse", "x" * 500, "q", "zz", "²"]
    assert np.array_equal(model.scores(words), np.array([model.word(w) for w in words], np.float32))
