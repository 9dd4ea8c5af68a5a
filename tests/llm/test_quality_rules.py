"""Statistics equal their definitions; rules are learned, pruned and ordered; the plan has no Python in it."""

import random
import re
from collections import Counter

from ebbtide.llm import quality_rules
from ebbtide.llm.queries import op1_quality_rules
from ebbtide.llm.texts import read_table
from tests.conftest import plan_of
from tests.llm.cases import ROWS, by_id, documents, texts

WORD = re.compile("[^\x20\x09-\x0d]+")


def by_hand(text):
    words = WORD.findall(text or "")
    triples = list(zip(words, words[1:], words[2:], strict=False))
    times, inside = Counter(triples), set()
    for k, t in enumerate(triples):
        if times[t] > 1:
            inside |= {k, k + 1, k + 2}
    seen, copies = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), copies, len(inside)


def measured(row):
    return tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))


def test_statistics_of_odd_texts(spark):
    random.seed(2)
    made = ["".join(random.choices(["a", "b ", " ", "\n", "\t", "#%", "é", "\x0b", " ", "\U0001f600", "a b a b\n"], k=random.randrange(60))) for _ in range(300)]
    made += [None, "", "a", "a b", "a b c", "a b c a b c", "a a a a", "\n\n", "x\nx\n x\nx"]
    found = by_id(quality_rules.statistics(texts(spark, *made)))
    assert {k: measured(found[k]) for k in found} == {k: by_hand(t) for k, t in enumerate(made)}


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (99, 0), (None, 0)], "doc_id long, quality int")
    docs = documents(spark)
    found = quality_rules.judge(docs, labels).collect()
    assert len(found) == len(ROWS)
    assert sorted(map(measured, found)) == sorted(by_hand(r[1]) for r in ROWS)
    assert all(r["base_failed"] and not r["kept"] for r in found)
    assert quality_rules.judge(docs.limit(0), labels).count() == 0
    assert quality_rules.judge(docs, labels.limit(0)).count() == len(ROWS)


def prose(random_, n, junk=""):
    return " ".join("".join(random_.choices("abcdefghijklmnopq", k=random_.randrange(3, 9))) + junk for _ in range(n))


def test_two_kinds_of_junk_give_two_rules_and_clean_texts_stay(spark):
    r = random.Random(4)
    rows = [prose(r, 80) for _ in range(120)] + [prose(r, 80, "%%") for _ in range(60)] + [prose(r, 80).upper() for _ in range(60)] + ["short one"]
    labels = spark.createDataFrame([(k, 1 if k < 120 else 0) for k in range(241)], "doc_id long, quality int")
    found = by_id(quality_rules.judge(texts(spark, *rows), labels))
    assert all(found[k]["kept"] for k in range(120)) and not any(found[k]["kept"] for k in range(120, 241))
    assert {found[k]["rule"].split(" ")[0] for k in range(120, 240)} == {"symbol_share", "upper_share"}
    assert found[240]["base_failed"] and found[240]["rule"] is None


def test_labels_without_a_pattern_give_no_rule(spark):
    r = random.Random(5)
    rows = [prose(r, 80) for _ in range(150)]
    labels = spark.createDataFrame([(k, int(r.random() < 0.5)) for k in range(150)], "doc_id long, quality int")
    found = quality_rules.judge(texts(spark, *rows), labels).collect()
    assert sum(r["kept"] for r in found) >= 140


def test_gain_prefers_purity():
    assert quality_rules._gain(10, 0, 10, 10) > quality_rules._gain(10, 5, 10, 10) > 0 == quality_rules._gain(0, 3, 10, 10)


def test_query_equals_definitions_and_stays_in_the_jvm(spark, sf_dir):
    df = op1_quality_rules(spark, sf_dir)
    for node in ("Python", "Pandas", "Arrow"):
        assert node not in plan_of(quality_rules.statistics(read_table(spark, sf_dir, "documents"))) and node not in plan_of(df)
    found = by_id(df)
    for doc in read_table(spark, sf_dir, "documents").collect():
        row, hand = found[doc["doc_id"]], by_hand(doc["text"])
        assert measured(row) == hand
        assert row["base_failed"] == (hand[0] < 50 or 100 * hand[4] > 50 * hand[0]) and (not row["kept"] or not row["base_failed"])
