"""Personal data: base patterns, and terms that the corpus shows to reveal what the patterns found.

Base spans. Emails, IPv4 addresses, payment cards and phone numbers by pattern, leftmost and non-overlapping per kind;
a match that fails its check (address parts, Luhn, number of digits) is dropped and not tried again.

Revealing terms (information-theoretic sanitisation). A protected entity is a base match's normalised value. Over the
whole corpus, counted in words:

    n(t)    occurrences of term t
    n(t,e)  occurrences of t within `reach` words of an occurrence of entity e
    n(e)    words within `reach` words of an occurrence of e
    IC(e)    = -log2 n(e) / N                     what knowing e is worth, in bits
    PMI(t,e) =  log2 n(t,e) * N / (n(t) * n(e))   what t tells about e, in bits

t discloses e when PMI(t,e) >= `disclosure` * IC(e) and the two were met in at least `support` different contexts
(copies of one passage are one context, so a text that is merely repeated discloses nothing). This is estimated twice:
within `reach` words, and within the passage of up to PASSAGE words to each side, where a word near two occurrences of e
in one text counts once; either is enough. Every occurrence of such a term, in any text and at any distance from the
entity, is a span of kind `term`; `sanitise` generalises base spans to their kind and removes the terms.

Terms are lower-cased runs of letters. Corpus counts come from one narrow pass with bounded partial sums and are joined
to the (few) pairs with enough support; an entity met very often is split by (entity, term) and summed up map-side.
Passages are counted only for entities met in enough of them, and texts are searched for disclosing terms, through Bloom
filters of 2 MB that lose none; joins drop what passes by chance.

Defined results: NULL text behaves like an empty one (no spans) and stays NULL in `sanitise`. Spans are code points,
end exclusive. Rows are handled one by one: repeated ids or rows are no special case. Further columns are kept by
`sanitise` and not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.decontamination import FILTER_BITS, window_filter
from ebbtide.llm.texts import LETTER_RUNS, map_rows, sum_terms
from ebbtide.session import cut_lineage

# The base patterns, in the order in which spans are listed. An address is looked for at the start of a run
# of digits only: elsewhere in the run it matches no better, and a long run would be scanned again and again.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
KINDS = [*PATTERNS, "term"]
REACH = 4
#: Words to each side that make the passage of an entity.
PASSAGE = 1024
#: Words whose place in a filter a worker remembers.
KEPT = 150_000
SUPPORT = 3
DISCLOSURE = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + place % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _passes(kind: str, match: str) -> bool:
    digits = re.sub(r"[^0-9]", "", match)
    if kind == "ip":
        parts = [part.lstrip("0") or "0" for part in match.split(".")]
        return all(len(part) <= 3 and int(part) <= 255 for part in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping emails in time linear in the text.

    The pattern alone starts a scan at each character of a long run without @; here a run of name characters is looked
    at only if it stands before an @.
    """
    pattern, end, at = PATTERNS["email"], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
            start -= 1
        match = pattern.match(text, start) if start < at else None
        if match:
            end = match.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _quick(kind: str, text: str) -> bool:
    return {"email": "@", "ip": ".", "card": "", "phone": "+"}[kind] in text


_DIGIT = re.compile(r"[0-9]")


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind in the fixed order, then by start."""
    if not text:
        return []
    found = [("email", *span) for span in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind in ("ip", "card", "phone"):
            if _quick(kind, text):
                found += [(kind, m.start(), m.end()) for m in PATTERNS[kind].finditer(text) if _passes(kind, m.group())]
    return found


def entity_of(kind: str, match: str) -> str:
    """Normalised value: emails in lower case, numbers by their digits."""
    return f"{kind}:{match.lower() if kind == 'email' else match if kind == 'ip' else re.sub(r'[^0-9]', '', match)}"


def _masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with base spans blanked, so that parts of an entity are no terms; positions stay."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        start = max(start, at)
        if start < end:
            out += [text[at:start], "\x00" * (end - start)]
            at = end
    return "".join([*out, text[at:]])


def occurrences(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(row, entity, context, term, start, end): the words around each base match of each text.

    `context` identifies the words around the match; `row` is the key given to the text.
    """

    def rows(keys: list, texts: list) -> Iterator[tuple]:
        for key, text in zip(keys, texts, strict=True):
            spans = base_spans(text)
            if not spans:
                continue
            words = [(m.group().lower(), m.start(), m.end()) for m in LETTER_RUNS.finditer(_masked(text, spans))]
            starts, ends = [w[1] for w in words], [w[2] for w in words]
            for kind, start, end in spans:
                before, after = bisect_right(ends, start), bisect_left(starts, end)
                near = words[max(0, before - reach) : before] + words[after : after + reach]
                entity = entity_of(kind, text[start:end])
                context = xxhash.xxh64_intdigest(" ".join([entity, *(w[0] for w in near)])) - (1 << 63)
                for term, at, to in near:
                    yield key, entity, context, term, at, to

    return map_rows(docs, rows, "row string, entity string, context long, term string, start int, end int")


class Screen:
    """Words that a Bloom filter lets through; remembers a bounded number of them."""

    def __init__(self, filled: np.ndarray):
        self.filled, self.known = filled, {}

    def __call__(self, word: str) -> bool:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= KEPT:
                self.known.clear()
            key = xxhash.xxh64_intdigest(word.encode(), 42)  # as F.xxhash64
            found = self.known[word] = all(int(self.filled[place >> 6]) >> (place & 63) & 1 for place in (key & (FILTER_BITS - 1), key >> 40))
        return found

    def terms(self, text: str) -> list[tuple[str, int, int]]:
        """(term, start, end) of the terms that pass."""
        if not any(self(w) for w in {w.lower() for w in set(LETTER_RUNS.findall(text))}):
            return []
        words = ((m.group().lower(), m.start(), m.end()) for m in LETTER_RUNS.finditer(_masked(text, base_spans(text))))
        return [w for w in words if self(w[0])]


def _screen_of(values: DataFrame) -> np.ndarray:
    """Bloom filter of a column of strings."""
    return window_filter(values.select(F.xxhash64(values.columns[0]).alias("window")))


def _passages(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, list[str]]]:
    """Entities and the words of each passage around them; passages of one entity that touch are one."""
    found = [(m.group().lower(), m.start(), m.end()) for m in LETTER_RUNS.finditer(_masked(text, spans))]
    starts, ends = [w[1] for w in found], [w[2] for w in found]
    bounds: dict[str, list[list[int]]] = {}
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        first, last = max(0, bisect_right(ends, start) - PASSAGE), bisect_left(starts, end) + PASSAGE
        kept = bounds.setdefault(entity_of(kind, text[start:end]), [])
        if kept and first <= kept[-1][1]:
            kept[-1][1] = max(last, kept[-1][1])
        else:
            kept.append([first, last])
    for entity, parts in bounds.items():
        for first, last in parts:
            yield entity, [w[0] for w in found[first:last]]


def passages(texts: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(entity, context, term, n) of the passages of the entities that were met in at least `support` of them."""

    def context(entity: str, words: list[str]) -> int:
        return xxhash.xxh64_intdigest(" ".join([entity, *words])) - (1 << 63)

    def contexts(column: list) -> Iterator[tuple]:
        for text in column:
            if spans := base_spans(text):
                for entity, words in _passages(text, spans):
                    yield entity, context(entity, words)

    met = map_rows(texts, contexts, "entity string, context long").distinct().groupBy("entity").count()
    shared = texts.sparkSession.sparkContext.broadcast(_screen_of(met.where(F.col("count") >= support).select("entity")))
    made: dict = {}

    def rows(column: list) -> Iterator[tuple]:
        screen = made.get("screen") or made.setdefault("screen", Screen(shared.value))
        for text in column:
            spans = base_spans(text)
            if any(screen(entity_of(kind, text[a:b])) for kind, a, b in spans):
                for entity, words in _passages(text, spans):
                    if screen(entity):
                        key = context(entity, words)
                        for term, n in Counter(words).items():
                            yield entity, key, term, n

    return map_rows(texts, rows, "entity string, context long, term string, n long")


def _word_counts(texts: list) -> Iterator[tuple[tuple, int]]:
    counts: Counter = Counter()
    for text in texts:
        spans = base_spans(text)
        counts.update(LETTER_RUNS.findall((_masked(text, spans) if spans else text).lower()))
    for term, n in counts.items():
        yield (term,), n


def word_counts(texts: DataFrame) -> DataFrame:
    """(term, n) over the whole corpus `texts` (one column)."""
    return cut_lineage(sum_terms(texts.where(F.col(texts.columns[0]).isNotNull()), _word_counts, "term string"))


def disclosures(texts: DataFrame, met: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE, corpus: DataFrame | None = None) -> DataFrame:
    """(entity, term) pairs where the term discloses the entity, by the corpus `texts` (one column) and its `occurrences`."""
    contexts = met.groupBy("entity", "term", "context").agg((F.sum("n") if "n" in met.columns else F.count("*")).alias("n"))
    pairs = contexts.groupBy("entity", "term").agg(F.sum("n").alias("together"), F.count("*").alias("contexts"))
    around = pairs.groupBy("entity").agg(F.sum("together").alias("n_entity"))
    supported = pairs.where(F.col("contexts") >= support)
    corpus = word_counts(texts) if corpus is None else corpus
    words = corpus.agg(F.sum("n")).first()[0] or 1
    scored = supported.join(corpus, "term").join(around, "entity")
    worth = -F.log2(F.col("n_entity") / words)
    told = F.log2(F.col("together") * words / (F.col("n") * F.col("n_entity")))
    return scored.where((worth > 0) & (told >= disclosure * worth)).select("entity", "term")


def telling_terms(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE, reach: int = REACH) -> DataFrame:
    """The terms that disclose an entity, by the words next to it or by its passages."""
    keyed = docs.select(row_key("text").alias("row"), "text").where("text IS NOT NULL")
    texts = keyed.select("text")
    corpus = word_counts(texts)
    pairs = [disclosures(texts, cut_lineage(met), support, disclosure, corpus) for met in (occurrences(keyed, reach), passages(texts, support))]
    return cut_lineage(pairs[0].union(pairs[1]).select("term").distinct())


def find(docs: DataFrame, telling: DataFrame, filled: np.ndarray) -> DataFrame:
    """(row, terms) for the rows with terms of `telling`; `row` = `row_key` of the text, terms = array of (start, end)."""
    keyed = docs.select(row_key("text").alias("row"), "text").where("text IS NOT NULL")
    shared = docs.sparkSession.sparkContext.broadcast(filled)
    made: dict = {}

    def rows(keys: list, texts: list) -> Iterator[tuple]:
        screen = made.get("screen") or made.setdefault("screen", Screen(shared.value))
        for key, text in zip(keys, texts, strict=True):
            for term, start, end in screen.terms(text):
                yield key, term, start, end

    marked = map_rows(keyed, rows, "row string, term string, start int, end int").distinct()
    hits = marked.join(telling, "term", "left_semi")
    return hits.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("terms"))


def row_key(text: str) -> F.Column:
    """Rows are told apart by their text: equal texts have equal spans."""
    return F.sha2(F.col(text), 256)


def spans(docs: DataFrame, **settings: float) -> DataFrame:
    """doc_id, base and terms for every row of `docs` (doc_id, text): arrays of (kind, start, end) and of (start, end).

    The texts themselves are not shuffled, only their spans.
    """
    telling = telling_terms(docs.select("text"), **settings)
    found = find(docs.select("text"), telling, _screen_of(telling))

    def rows(ids: list, keys: list, texts: list) -> Iterator[tuple]:
        for doc_id, key, text in zip(ids, keys, texts, strict=True):
            yield doc_id, key, [{"kind": k, "start": a, "end": b} for k, a, b in base_spans(text)]

    keyed = docs.select("doc_id", row_key("text").alias("row"), "text")
    base = map_rows(keyed, rows, "doc_id long, row string, base array<struct<kind: string, start: int, end: int>>")
    return base.join(found, "row", "left").select("doc_id", "base", "terms")


def spans_of(text: str | None, terms: list | None) -> list[tuple[str, int, int]]:
    """Base spans and term spans, in the order of the kinds, then by start."""
    return base_spans(text) + [("term", t["start"], t["end"]) for t in terms or []]


def generalised(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Base spans become [KIND], terms go with the space before them; of overlapping spans the first and longest wins."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            gap = text[at:start]
            out.append((gap[:-1] if gap.endswith(" ") else gap) if kind == "term" else gap)
            out.append("" if kind == "term" else f"[{kind.upper()}]")
            at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, **settings: float) -> DataFrame:
    """`docs` with the text sanitised; all columns and rows stay.

    Only texts with base spans or with words that may disclose are shuffled, to meet their terms; the others go straight
    through.
    """
    telling = telling_terms(docs.select("text"), **settings)
    filled = _screen_of(telling)
    shared = docs.sparkSession.sparkContext.broadcast(filled)
    made: dict = {}

    @F.udf("boolean", useArrow=True)
    def personal(text: str | None) -> bool:
        screen = made.get("screen") or made.setdefault("screen", Screen(shared.value))
        return bool(text) and bool(base_spans(text) or screen.terms(text))

    @F.udf("string", useArrow=True)
    def clean(text: str, terms: list | None) -> str:
        return generalised(text, spans_of(text, terms))

    found = find(docs.select("text"), telling, filled)
    judged = docs.select(F.struct("*").alias("doc"), personal("text").alias("personal"))
    plain = judged.where("NOT personal").select("doc.*")
    rows = judged.where("personal").select("doc", row_key("doc.text").alias("row")).join(found, "row", "left")
    cleaned = rows.select(*[(clean("doc.text", "terms") if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns])
    return plain.unionByName(cleaned)
