"""Base spans equal the plain patterns; revealing terms equal their definition; sanitising works on spans."""

import hashlib
import math
import random
import re
from collections import Counter

from ebbtide.llm import pii
from ebbtide.llm.queries import op9_pii
from ebbtide.llm.texts import LETTER_RUNS, read_table
from tests.llm.cases import ROWS, by_id, documents, texts

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_plain_patterns():
    random.seed(3)
    alphabets = ["ab@.-+", "0123456789. ", "@.a1", "+1 ()-0", "4 1-", "٣é"]
    for _ in range(20_000):
        text = "".join(random.choice(random.choice(alphabets)) for _ in range(random.randrange(40)))
        assert pii.base_spans(text) == plain_spans(text), repr(text)


def test_long_runs_take_linear_time():
    for text in ["1" * 200_000 + ".", "a" * 200_000 + "@", "a@" * 50_000, "+1" + "(" * 200_000, "1 " * 100_000]:
        pii.base_spans(text)


CORPUS = [
    "call agent zorblax at a.b@x.org today friend",
    "the agent zorblax wrote from a.b@x.org again",
    "so agent zorblax with a.b@x.org came here",
    "agent smith is not at home today friend",
    "friend of agent smith said so again",
    "mail c.d@y.org now", "mail c.d@y.org now", "mail c.d@y.org now",
] + ["plain words say nothing of interest here today again"] * 30


def revealing(corpus, reach=pii.REACH, support=pii.SUPPORT, disclosure=pii.DISCLOSURE):
    """Pairs by the definition, from scratch."""
    total, together, contexts, words = Counter(), Counter(), {}, 0
    for text in corpus:
        spans = plain_spans(text)
        chars = list(text)
        for _, a, b in spans:
            chars[a:b] = "\x00" * (b - a)
        found = [(m.group().lower(), m.start(), m.end()) for m in LETTER_RUNS.finditer("".join(chars))]
        total.update(w for w, *_ in found)
        words += len(found)
        for kind, a, b in spans:
            before, after = [w for w in found if w[2] <= a][-reach:], [w for w in found if w[1] >= b][:reach]
            entity = pii.entity_of(kind, text[a:b])
            for w, *_ in before + after:
                together[entity, w] += 1
                contexts.setdefault((entity, w), set()).add(tuple(x[0] for x in before + after))
    around = Counter()
    for (entity, _), n in together.items():
        around[entity] += n
    out = set()
    for (entity, w), n in together.items():
        worth = -math.log2(around[entity] / words)
        if len(contexts[entity, w]) >= support and worth > 0 and math.log2(n * words / (total[w] * around[entity])) >= disclosure * worth:
            out.add((entity, w))
    return out


def test_revealing_terms_follow_their_definition(spark):
    docs = texts(spark, *CORPUS)
    keyed = docs.select(pii.row_key("text").alias("row"), "text")
    found = pii.disclosures(keyed.select("text"), pii.occurrences(keyed))
    pairs = {(r["entity"], r["term"]) for r in found.collect()}
    assert pairs == revealing(CORPUS) and ("email:a.b@x.org", "zorblax") in pairs
    assert not any(entity == "email:c.d@y.org" for entity, _ in pairs)


def test_sanitised_texts_keep_rows_and_columns(spark):
    docs = texts(spark, *CORPUS)
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == len(CORPUS)
    rows = by_id(clean)
    assert rows[0]["text"] == "call agent at [EMAIL] today friend" and rows[3]["text"] == CORPUS[3]
    assert rows[5]["text"] == "mail [EMAIL] now"


def test_disclosing_terms_go_at_any_distance_and_in_texts_without_the_entity(spark):
    plain = "plain words say nothing of interest here today again"
    corpus = [f"dear zorblax {plain} {extra} {plain} a.b@x.org" for extra in ("today", "today again", "here", "interest")]
    corpus += ["then Zorblax said nothing today", "dear words then said"] + [f"dear {plain} then said"] * 300
    rows = by_id(pii.sanitise(texts(spark, *corpus)))
    assert rows[0]["text"] == f"dear {plain} today {plain} [EMAIL]" and rows[4]["text"] == "then said nothing today"
    assert [rows[k]["text"] for k in range(5, len(corpus))] == corpus[5:]
    found = by_id(pii.spans(texts(spark, *corpus).select("doc_id", "text")))
    assert [(r["start"], r["end"]) for r in found[0]["terms"]] == [(5, 12)] == [(r["start"], r["end"]) for r in found[4]["terms"]]


def test_words_pass_the_filter_made_of_them(spark):
    words = [f"w{k}é" for k in range(500)]
    screen = pii.Screen(pii._screen_of(spark.createDataFrame([(w,) for w in words], "term string")))
    assert all(map(screen, words)) and sum(map(screen, (f"x{k}" for k in range(2000)))) < 20


def test_odd_rows(spark):
    docs = documents(spark)
    found = pii.spans(docs.select("doc_id", "text")).collect()
    assert len(found) == len(ROWS) and all(not r["base"] and not r["terms"] for r in found)
    assert sorted(map(str, pii.sanitise(docs).select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
    assert pii.spans(docs.select("doc_id", "text").limit(0)).count() == 0 and pii.sanitise(docs.limit(0)).count() == 0


def test_overlapping_spans_are_generalised_once():
    assert pii.generalised("x +1 23456789012 y", [("phone", 2, 16), ("card", 3, 16)]) == "x [PHONE] y"
    assert pii.generalised("tell bob now", [("term", 5, 8)]) == "tell now"


def test_query_equals_the_plain_patterns_on_the_whole_table(spark, sf_dir):
    found = by_id(op9_pii(spark, sf_dir))
    docs = read_table(spark, sf_dir, "documents").collect()
    assert len(found) == len(docs)
    for doc in docs:
        spans, row = plain_spans(doc["text"]), found[doc["doc_id"]]
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in spans) for k in PLAIN]
        assert [s for s in row["spans"].split(",") if s and not s.startswith("term")] == [s for s in base.split(",") if s]
