"""Items are found as they are and re-parameterised; slots must agree; clean texts are left alone."""

import re

from ebbtide.llm import decontamination
from ebbtide.llm.queries import op6_decontamination
from ebbtide.llm.texts import read_table
from tests.llm.cases import documents, texts

QUESTION = "A farmer named Alice has 12 apples and gives 5 apples to Bob. How many kg of the 12 apples does the farmer still keep after the walk home?"
OTHER = "A farmer named Carol has 31 apples and gives 7 apples to Dave. How many lb of the 31 apples does the farmer still keep after the walk home?"
TORN = OTHER.replace("lb of the 31", "lb of the 44")


def bench(spark, *items):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)], "item_id long, text string, doc_id string")


def found(spark, docs, *items, **settings):
    return {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(docs, bench(spark, *items), **settings).collect()}


def test_changed_numbers_names_and_units_are_found(spark):
    hits = found(spark, texts(spark, "Start. " + QUESTION + " End here.", "Well then. " + OTHER, "nothing of the kind is said in this text"), QUESTION)
    assert set(hits) == {(0, 0), (1, 0)}
    assert hits[0, 0]["changed_slots"] == 0 and hits[1, 0]["changed_slots"] >= 4 and hits[1, 0]["coverage"] == 1.0


def test_inconsistent_slots_count_only_plain_windows(spark):
    hits = found(spark, texts(spark, OTHER, TORN), QUESTION, coverage=0.0)
    assert hits[0, 0]["n_slots"] > 0 and hits[1, 0]["n_slots"] == 0
    assert hits[1, 0]["n_windows"] < hits[0, 0]["n_windows"]


def test_case_punctuation_and_glued_units_do_not_matter(spark):
    item = "the heavy stone weighs 12 kg and rolls down the long green hill every single morning"
    hits = found(spark, texts(spark, "x y. THE*** heavy### stone, weighs 14kg and\nrolls down the (long) green hill; every single morning!!"), item)
    assert set(hits) == {(0, 0)}


def test_half_of_an_item_counts_a_tenth_does_not(spark):
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    docs = texts(spark, " ".join(words[:40]), " ".join(words[:10]), " ".join(words[30:] + words[:30]))
    assert {k[0] for k in found(spark, docs, " ".join(words))} == {0, 2}


def test_odd_rows(spark):
    docs = documents(spark)
    assert found(spark, docs, None, "", "too short", "a completely different sentence about nothing at all") == {}
    hits = found(spark, docs, "quick brown fox jumps over the lazy dog")
    assert set(hits) == {(1, 0), (2**40, 0)}
    kept = decontamination.without_contaminated(docs, bench(spark, "quick brown fox jumps over the lazy dog"))
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["None", "2", "3", "4", "5", "6", "7"])
    assert found(spark, docs.limit(0), QUESTION) == {}
    assert decontamination.contaminated(docs, bench(spark, QUESTION).limit(0)).count() == 0


def test_filter_loses_no_window(spark):
    items = bench(spark, QUESTION, OTHER).selectExpr("item_id AS id", "text")
    windows = decontamination.template_windows(items)
    seen = decontamination.window_filter(windows)
    assert decontamination.template_windows(items, seen).count() == windows.count() > 20


def test_query_finds_every_item_that_stands_in_a_document(spark, sf_dir):
    """Brute force on plain words: all windows of an item, found in the text, against the query's pairs."""
    plain = lambda text: re.findall(r"\w+", (text or "").lower())
    docs = {r["doc_id"]: plain(r["text"]) for r in read_table(spark, sf_dir, "documents").collect()}
    items = {r["item_id"]: plain(r["text"]) for r in read_table(spark, sf_dir, "benchmark").collect()}
    windows = lambda words: {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    expected, shares = set(), {}
    of_items = {i: windows(w) for i, w in items.items()}
    for d, words in docs.items():
        own = windows(words)
        for i, w in of_items.items():
            if w and (share := len(w & own) / len(w)):
                shares[d, i] = share
                if share >= 0.8:
                    expected.add((d, i))
    pairs = {(r["doc_id"], r["item_id"]) for r in op6_decontamination(spark, sf_dir).collect()}
    assert expected <= pairs and all(shares.get(p, 0) >= 0.3 for p in pairs)
