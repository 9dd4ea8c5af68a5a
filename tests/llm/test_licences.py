"""Sentences, also wrapped, become identifiers; rules are tried in order."""

import pytest

from ebbtide.llm import licences
from ebbtide.llm.queries import op4_licences
from ebbtide.llm.texts import read_table
from tests.llm.cases import ROWS, by_id, documents

WHOLE = {
    "MIT": "\n".join(licences.SENTENCES[k][0] for k in ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    "Apache-2.0": "\n".join(["/* " + licences.SENTENCES["apache-named-{v}"][1].replace("{v}", "2.0"), *(licences.SENTENCES[k][0] for k in ("apache-comply", "apache-copy", "apache-as-is", "apache-see"))]),
    "BSD-3-Clause": "\n * ".join([licences.SENTENCES["bsd-grant"][0], licences.SENTENCES["bsd-source"][1], licences.SENTENCES["bsd-binary"][1], licences.SENTENCES["bsd-endorse"][0]]),
    "BSD-2-Clause": "\n".join(licences.SENTENCES[k][0] for k in ("bsd-grant", "bsd-source", "bsd-binary")),
    "CC-BY-NC-4.0": "Some words.\nLicensed under CC BY-NC 4.0.\nMore words.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-or-later": licences.SENTENCES["gpl-later-{v}"][1].replace("{v}", "2"),
}


@pytest.mark.parametrize("licence", WHOLE)
@pytest.mark.parametrize("wrap", [False, True])
def test_whole_licences(licence, wrap):
    text = WHOLE[licence]
    if wrap:
        lines = [line.split(" ") for line in text.split("\n")]
        text = "\n".join("\n// ".join(" ".join(words[k : k + 6]) for k in range(0, len(words), 6)) for words in lines)
    assert licences.licences_of(licences.recognise(text)[1]) == ([licence], [])


def test_every_sentence_has_an_anchor_and_is_recognised():
    for words, name in licences.KNOWN.items():
        assert any(a in " ".join(words) for a in licences.ANCHORS)
        assert licences.recognise("Before that. " + " ".join(words) + ". And after")[1] == [name]


def test_order_of_rules_and_of_licences():
    text = "\n".join([WHOLE["CC-BY-NC-4.0"], WHOLE["BSD-2-Clause"], WHOLE["MIT"], "All rights reserved."])
    assert licences.licences_of(licences.recognise(text)[1]) == (["CC-BY-NC-4.0", "BSD-2-Clause", "MIT"], ["rights-reserved"])


def test_part_of_a_sentence_is_none():
    assert licences.recognise("He said it was released under the MIT License of old")[1] == []


def test_odd_rows(spark):
    found = licences.scan(documents(spark)).collect()
    assert len(found) == len(ROWS) and all((r["licences"], r["n_sentences"]) == ("", 0) for r in found)
    assert licences.scan(documents(spark).limit(0)).count() == 0


def test_query_finds_the_lines_of_the_table(spark, sf_dir):
    lines = {
        "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
        "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
        "MIT": "Released under the MIT License.",
    }
    found = by_id(op4_licences(spark, sf_dir))
    docs = read_table(spark, sf_dir, "documents").collect()
    assert len(found) == len(docs)
    for doc in docs:
        present = {k for k, line in lines.items() if line in (doc["text"] or "").split("\n")}
        assert set(filter(None, found[doc["doc_id"]]["licences"].split(","))) == present
