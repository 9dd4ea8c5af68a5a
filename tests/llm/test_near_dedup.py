"""Groups equal those of brute force over all pairs of whole shingle sets."""

import random

import numpy as np
import pytest

from ebbtide.llm import near_dedup
from ebbtide.llm.graph import components
from ebbtide.llm.queries import op2_minhash_near_dedup
from ebbtide.llm.texts import WordKeys, read_table, shingle_set
from tests.llm.cases import ROWS, by_id, documents


def shingles(text, words):
    found = (text or "").encode().lower().split()
    if len(found) < words:
        return frozenset([tuple(found)] if found else [])
    return frozenset(zip(*(found[k:] for k in range(words)), strict=False))


def groups(rows, words, similarity=80):
    """Smallest reachable id by comparing all pairs."""
    sets = {i: shingles(t, words) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= similarity * large and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def check(spark, rows, words):
    found = by_id(near_dedup.near_duplicates(documents(spark, [(i, t, "en", "s", 0) for i, t in rows]), words=words))
    assert {i: r["component_id"] for i, r in found.items()} == groups(rows, words)
    assert all(r["n_shingles"] == len(shingles(t, words)) and r["kept"] == (found[i]["component_id"] == i) for i, t in rows for r in [found[i]])


def test_drifting_and_star_shaped_groups(spark):
    """A chain of small changes, a star of changed copies, texts that share a passage, and copies."""
    random.seed(11)
    word = lambda: "".join(random.choices("abcdefgh", k=5))
    base, rows = [word() for _ in range(80)], []
    chain = list(base)
    for _ in range(25):
        rows.append(" ".join(chain))
        for _ in range(3):
            chain[random.randrange(80)] = word()
    star = [word() for _ in range(80)]
    for _ in range(40):
        copy = list(star)
        for _ in range(random.randrange(1, 7)):
            copy[random.randrange(80)] = word()
        rows.append(" ".join(copy))
    passage = [word() for _ in range(60)]
    rows += [" ".join(passage + [word() for _ in range(random.randrange(8, 30))]) for _ in range(40)]
    rows += [" ".join(star)] * 3 + ["one", "one", "One two", "one\ntwo"]
    random.shuffle(rows)
    check(spark, list(enumerate(rows)), 2)


@pytest.mark.parametrize("rare", [0, 3, 32])
def test_exact_finish_loses_no_link_whatever_is_rare(spark, monkeypatch, rare):
    """Much-edited copies of one text: many pairs just above and below the limit."""
    monkeypatch.setattr(near_dedup, "RARE", rare)
    random.seed(12 + rare)
    star = ["".join(random.choices("abcdefgh", k=5)) for _ in range(60)]
    rows = []
    for k in range(60):
        copy = list(star)
        for _ in range(random.randrange(0, 8)):
            copy[random.randrange(60)] = f"w{random.randrange(40)}"
        rows.append((k, " ".join(copy)))
    check(spark, rows, 2)


def test_left_over_pairs_hold_every_link(spark):
    """Without any pivot: all links between different components come out of the bounds."""
    random.seed(21)
    star = ["".join(random.choices("abcdefgh", k=5)) for _ in range(50)]
    texts = {}
    for k in range(50):
        copy = list(star)
        for _ in range(random.randrange(0, 7)):
            copy[random.randrange(50)] = f"w{random.randrange(30)}"
        texts[k] = " ".join(copy)
    docs = documents(spark, [(i, t, "en", "s", 0) for i, t in texts.items()])
    nothing = spark.createDataFrame([], "id long, component long")
    found = near_dedup._left_over(near_dedup.shingle_sets(docs, 2), nothing, 80)
    pairs = {tuple(sorted((r["id"], r["other"]))) for r in found.collect()}
    sets = {i: shingles(t, 2) for i, t in texts.items()}
    links = {(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(links) > 50 and links <= pairs


def test_one_id_with_several_texts_is_linked_by_any(spark):
    one, two = "a b c d e f g h i j k l", "m n o p q r s t u v w x"
    three = "a1 b1 c1 d1 e1 f1 g1"
    rows = [(1, one), (1, two), (2, one + " y"), (3, two + " y"), (4, "z z1 z2 z3 z4"), (5, three), (6, three), (6, "z z1 z2 z3 z4")]
    found = near_dedup.near_duplicates(documents(spark, [(i, t, "en", "s", 0) for i, t in rows]), words=2)
    assert sorted((r["doc_id"], r["component_id"]) for r in found.collect()) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (6, 4)]


def test_nulls_empty_texts_and_repeated_rows(spark):
    found = near_dedup.near_duplicates(documents(spark), words=2).collect()
    assert len(found) == len(ROWS)
    for row in found:
        if row["doc_id"] is None:
            assert row["component_id"] is None and row["kept"]
        elif row["doc_id"] == 2**40:
            assert row["component_id"] == 1 and not row["kept"]
        else:
            assert row["component_id"] == row["doc_id"] and row["kept"]
    assert {r["doc_id"]: r["n_shingles"] for r in found if r["doc_id"] in (2, 3, 4, 6)} == {2: 0, 3: 0, 4: 0, 6: 1}


def test_empty_table(spark):
    assert near_dedup.near_duplicates(documents(spark).limit(0)).count() == 0


@pytest.mark.parametrize("words", [2, 5])
def test_shingle_sets_equal_words_by_hand(words):
    keys = WordKeys()
    for text in ["", "a", "A b", "a b c d e f a b c", "x\x0by\x1cz Ä ä", "a  b\tc\nd e"]:
        assert len(shingle_set(text, words, keys)) == len(shingles(text, words))
    assert (shingle_set("A B c d e", words, keys) == shingle_set(" a b\nC d E ", words, keys)).all()


def test_signature_estimates_similarity():
    random.seed(3)
    draw = lambda n: np.array([random.getrandbits(64) for _ in range(n)], np.uint64)
    both, one, other = draw(400), draw(100), draw(100)
    a, b = (near_dedup.min_max_signature(np.concatenate([both, x])) for x in (one, other))
    assert abs((a == b).mean() - 400 / 600) < 0.15


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(100, 160)] + [(7, 8), (9, 8)], "a long, b long")
    found = {r["id"]: r["component"] for r in components(links).collect()}
    assert found == {**dict.fromkeys(range(100, 161), 100), 7: 7, 8: 7, 9: 7}
    assert components(links.limit(0)).count() == 0


def test_query_equals_brute_force_on_the_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in read_table(spark, sf_dir, "documents").collect()]
    found = by_id(op2_minhash_near_dedup(spark, sf_dir))
    assert {i: r["component_id"] for i, r in found.items()} == groups(rows, 2)
