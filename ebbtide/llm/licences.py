"""Licence scan by sentence rules.

A text is cut into fragments at line ends and sentence ends; a fragment is normalised to its lower-cased words, comment
marks and punctuation dropped. A known licence sentence is recognised where it begins with a fragment and ends with one,
so it may be wrapped over lines. That turns a text into a sequence of sentence identifiers, on which the licence rules are
tried in their order, the long ones before those that are a part of them. What a rule has used is gone for later rules;
identifiers that no rule used are reported as such.

One narrow pass over whole texts; a text without one of the anchor words (every known sentence has one) is only searched
for them. Defined results: NULL and empty texts have no sentences and no licences. Rows are judged one by one, so
repeated rows and ids are no special case. Further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ebbtide.llm.texts import map_rows

# Texts of known licence sentences by identifier. {v} stands for each version listed with it.
SENTENCES: dict[str, list[str]] = {
    "mit-named": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This project is licensed under the MIT License",
        "This software is released under the MIT License",
        "Distributed under the MIT License",
        "SPDX-License-Identifier: MIT",
    ],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:"
    ],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-as-is": [
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ],
    "mit-liability": [
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ],
    "apache-named-{v}": [
        "Licensed under the Apache License, Version {v}",
        'Licensed under the Apache License, Version {v} (the "License");',
        "Released under the Apache License, Version {v}",
        "This project is licensed under the Apache License, Version {v}",
        "SPDX-License-Identifier: Apache-{v}",
    ],
    "apache-comply": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-as-is": [
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "bsd-binary": [
        f"{mark}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
        for mark in ("", "2. ")
    ],
    "bsd-endorse": [
        f"{mark}Neither the name of the {who} nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
        for mark in ("", "3. ")
        for who in ("copyright holder", "author", "University")
    ],
    "bsd-named-{v}": ["Licensed under the BSD {v}-Clause License", "Released under the BSD {v}-Clause License", "SPDX-License-Identifier: BSD-{v}-Clause"],
    "gpl-named-{v}": [
        "This work is licensed under the GNU General Public License, version {v}",
        "Licensed under the GNU General Public License, version {v}",
        "Released under the GNU General Public License, version {v}",
        "This program is licensed under the GNU General Public License, version {v}",
        "SPDX-License-Identifier: GPL-{v}.0-only",
    ],
    "gpl-later-{v}": [
        f"This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
        for mark in (":", ";")
    ]
    + ["SPDX-License-Identifier: GPL-{v}.0-or-later"],
    "lgpl-named-{v}": ["Licensed under the GNU Lesser General Public License, version {v}", "This work is licensed under the GNU Lesser General Public License, version {v}"],
    "agpl-named-{v}": ["Licensed under the GNU Affero General Public License, version {v}", "This work is licensed under the GNU Affero General Public License, version {v}"],
    "gpl-warranty": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE."
    ],
    "gpl-see": ["See the GNU General Public License for more details."],
    "gpl-received": ["You should have received a copy of the GNU General Public License along with this program."],
    "mpl-named-{v}": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. {v}.",
        "Licensed under the Mozilla Public License, Version {v}",
        "SPDX-License-Identifier: MPL-{v}",
    ],
    "isc-grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "cc0": ["This work is dedicated to the public domain under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
    "cc-named-{v}": [
        "Licensed under CC {v}",
        "This work is licensed under CC {v}",
        "Released under CC {v}",
    ],
    "rights-reserved": ["All rights reserved."],
}

# Versions by the identifiers that take one.
VERSIONS: dict[str, list[str]] = {
    "apache-named-{v}": ["1.1", "2.0"],
    "bsd-named-{v}": ["2", "3"],
    "gpl-named-{v}": ["2", "3"],
    "gpl-later-{v}": ["2", "3"],
    "lgpl-named-{v}": ["2.1", "3"],
    "agpl-named-{v}": ["3"],
    "mpl-named-{v}": ["1.1", "2.0"],
    "cc-named-{v}": [f"{kind} {version}" for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for version in ("2.0", "3.0", "4.0")],
}

# Licence and the sentence identifiers, in order, that stand for it; tried from the first to the last.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-{v}", ("apache-named-{v}", "apache-comply", "apache-copy", "apache-as-is", "apache-see")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-{v}.0-or-later", ("gpl-later-{v}", "gpl-warranty", "gpl-see", "gpl-received")),
    ("GPL-{v}.0-or-later", ("gpl-later-{v}",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-named",)),
    ("Apache-{v}", ("apache-named-{v}",)),
    ("BSD-{v}-Clause", ("bsd-named-{v}",)),
    ("GPL-{v}.0-only", ("gpl-named-{v}",)),
    ("LGPL-{v}-only", ("lgpl-named-{v}",)),
    ("AGPL-{v}.0-only", ("agpl-named-{v}",)),
    ("MPL-{v}", ("mpl-named-{v}",)),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0",)),
    ("CC-{v}", ("cc-named-{v}",)),
]
# Every known sentence has one of these.
ANCHORS = ["licen", "spdx", "cc by", "permi", "redistribut", "warrant", "liab", "public domain", "rights reserved", "copyright"]

_CUT = re.compile(r"\n|(?<=[.!?;:])\s+")
_WORD = re.compile(r"\w+(?:\.\w+)*")


def normalised(fragment: str) -> tuple[str, ...]:
    """Lower-cased words; versions like 2.0 stay one word."""
    return tuple(_WORD.findall(fragment.lower()))


def _with_versions() -> tuple[dict[tuple[str, ...], str], list[tuple[str, tuple[str, ...]]]]:
    sentences, rules = {}, []
    for name, texts in SENTENCES.items():
        for version in VERSIONS.get(name, [""]):
            for text in texts:
                sentences[normalised(text.replace("{v}", version))] = name.replace("{v}", version)
    for licence, names in RULES:
        for version in VERSIONS.get(names[0], [""]):
            filled = version.replace(" ", "-")
            rules.append((licence.replace("{v}", filled), tuple(n.replace("{v}", version) for n in names)))
    return sentences, rules


KNOWN, ORDERED_RULES = _with_versions()


def _tree() -> dict:
    """Known sentences as a tree of words; the identifier stands under the empty word."""
    root: dict = {}
    for words, name in KNOWN.items():
        at = root
        for word in words:
            at = at.setdefault(word, {})
        at[""] = name
    return root


_TREE = _tree()


def recognise(text: str | None) -> tuple[int, list[str]]:
    """Number of fragments with words, and the identifiers of the known sentences in order."""
    if not text or not any(a in low for low in (text.lower(),) for a in ANCHORS):
        return 0, []
    fragments = [w for w in map(normalised, _CUT.split(text)) if w]
    found, at = [], 0
    while at < len(fragments):
        node, name, end = _TREE, None, at
        for k in range(at, len(fragments)):
            for word in fragments[k]:
                node = node.get(word)
                if node is None:
                    break
            if node is None:
                break
            if "" in node:
                name, end = node[""], k + 1
        if name:
            found.append(name)
        at = end if name else at + 1
    return len(fragments), found


def licences_of(names: list[str]) -> tuple[list[str], list[str]]:
    """Licences in order of appearance, each once, and the identifiers that no rule used."""
    left: list[str | None] = list(names)
    hits: list[tuple[int, str]] = []
    for licence, rule in ORDERED_RULES:
        size = len(rule)
        for at in range(len(left) - size + 1):
            if tuple(left[at : at + size]) == rule:
                hits.append((at, licence))
                left[at : at + size] = [None] * size
    return list(dict.fromkeys(licence for _, licence in sorted(hits))), [n for n in left if n]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licences, sentences, unused (comma-joined) and n_sentences for every row of `docs` (doc_id, text)."""

    def rows(ids: list, texts: list) -> Iterator[tuple]:
        for doc_id, text in zip(ids, texts, strict=True):
            _, names = recognise(text)
            found, unused = licences_of(names) if names else ([], [])
            yield doc_id, ",".join(found), ",".join(names), ",".join(unused), len(names)

    return map_rows(docs.select("doc_id", "text"), rows, "doc_id long, licences string, sentences string, unused string, n_sentences long")
