"""Features, weights and draws equal a plain computation, text by text."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ebbtide.llm import importance_resampling
from ebbtide.llm.importance_resampling import Buckets, batch_features, resample
from tests.llm.cases import ROWS, documents

TARGET = ["The lazy dog sleeps", None, "", "quick foxes jump, THE end 42"]


def plain_features(text, buckets, longest):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    runs = [b" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r) % buckets for r in runs]


def plain_resample(rows, target, percent, seed, buckets, longest, least_words):
    made = [(k, *plain_features(text, buckets, longest)) for k, text in rows]
    source, wanted = Counter(), Counter()
    for _, _, f in made:
        source.update(f)
    for text in target:
        wanted.update(plain_features(text, buckets, longest)[1])
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(wanted.values()) + buckets)
    scored = []
    for k, n_words, f in made:
        gain = [math.floor(1000 * math.log((wanted[b] + 1.0) * s_all / ((source[b] + 1.0) * t_all))) for b in f]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append([k, len(f), weight, score, None, n_words])
    eligible = sorted((r for r in scored if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, r in enumerate(eligible[: percent * len(eligible) // 100]):
        r[4] = place + 1
    return [tuple(r[:5]) for r in scored]


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_joined_batches_never_mix_documents(longest):
    texts = ["one two three", "", None, "ONE", "a\x00b c\x00", "  x-y_z  ", "é漢 Ünder", "\x00", "two three four five six"]
    raw = [None if t is None else t.encode() for t in texts]
    n_words, n_features, found = batch_features(raw, longest, Buckets(97))
    ends = np.cumsum(n_features).tolist()
    for k, text in enumerate(texts):
        words, expected = plain_features(text, 97, longest)
        assert n_words[k] == words and sorted(found[ends[k] - n_features[k] : ends[k]].tolist()) == sorted(expected)


def test_full_word_store_changes_nothing(monkeypatch):
    monkeypatch.setattr(importance_resampling, "KEPT", 3)
    words_of = Buckets(50)
    for text in ("a b c d e f", "a b\x00 c", "g h a"):
        assert sorted(batch_features([text.encode(), b"z"], 1, words_of)[2].tolist()) == sorted(plain_features(text + " z", 50, 1)[1])


@pytest.mark.parametrize("longest,buckets,least_words", [(1, 10_000, 9), (3, 70_000, 0), (1, 7, 2)])
def test_odd_rows_equal_the_plain_computation(spark, longest, buckets, least_words, monkeypatch):
    monkeypatch.setattr(importance_resampling, "BATCH_BYTES", 64)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    found = resample(documents(spark), target, 50, 7, buckets, longest, least_words)
    expected = plain_resample([(r[0], r[1]) for r in ROWS], TARGET, 50, 7, buckets, longest, least_words)
    assert rows_of(found) == sorted(expected, key=str)


def test_tied_scores_are_drawn_by_id(spark):
    rows = [(k, "same words here", "en", "s", 0) for k in range(3000)]
    found = rows_of(resample(documents(spark, rows), spark.createDataFrame([("words",)], "text string"), 30, 1, 100, 1, 1))
    expected = plain_resample([(r[0], r[1]) for r in rows], ["words"], 30, 1, 100, 1, 1)
    assert found == sorted(expected, key=str) and len({r[3] for r in found}) < 2900


def test_empty_tables(spark):
    target = spark.createDataFrame([("words",)], "text string")
    assert resample(documents(spark, []), target, 10, 1).count() == 0
    found = resample(documents(spark), target.limit(0), 100, 1, 50, 1, 1)
    assert rows_of(found) == sorted(plain_resample([(r[0], r[1]) for r in ROWS], [], 100, 1, 50, 1, 1), key=str)


def test_nothing_is_drawn_when_the_share_is_below_one(spark):
    found = resample(documents(spark), spark.createDataFrame([("words",)], "text string"), 10, 1, 50, 1, 9)
    assert found.where("rank IS NOT NULL").count() == 0 and found.count() == len(ROWS)
