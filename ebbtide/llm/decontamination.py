"""Benchmark decontamination by template windows: finds items also where numbers, names and units were changed.

Canonical form. Punctuation around a word and its case go; a number becomes <NUM>, a unit of measure <UNIT>, a
capitalised word that does not open a sentence <NAME>. The replaced values are kept as slot values. The template
windows of an item are its runs of 5 canonical words with at least two ordinary words among them.

Matching. Windows of items and documents are hash-joined. Before that, a Bloom filter of the item windows (2 MB
whatever the benchmark's size; it can let windows through that the join then drops, but loses none) is applied where
the documents are read, so only a sliver of the corpus's windows is ever shuffled.

Slot consistency. Windows of one alignment (document position minus item position) belong together: there each slot
value of the item must stand for one value in the document. An alignment that breaks this keeps only its windows
without slots. An item is found in a document when at least `coverage` of its windows were matched; a half is the
default, so that a passage with a word changed here and there, or cut short, is still found. Everyday windows that many
texts share do not come near that.

Defined results: NULL or empty texts, on either side, match nothing; an item of fewer than 5 words has no window and is
never found. Repeated rows with one doc_id are one document; a row without doc_id or item_id is not reported. Further
columns are not read. An item that occurs several times in a document counts each of its windows once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.texts import map_rows, windows
from ebbtide.session import cut_lineage

WINDOW = 5
LEAST_PLAIN = 2
COVERAGE = 0.5
FILTER_BITS = 1 << 24
KEPT = 300_000

# Units of measure and number words that become placeholders.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs pound pounds oz ounce ounces "
    "ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros percent % degree degrees mph kmh watt watts kw volt volts".split()
)
NUMBERS = frozenset("one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())

_CORE = re.compile(r"[^\W_](?:.*[^\W_%])?%?|%", re.DOTALL)
_NUMBER = re.compile(r"\d+(?:[.,:/]\d+)*")
_GLUED = re.compile(r"(?<=\d)(?=[^\W\d_]|%)")
_DIGIT = re.compile(r"\d")

PLAIN, NUMBER, UNIT, NAME, NOTHING = range(5)
_PLACEHOLDERS = np.array([0] + [xxhash.xxh64_intdigest(f"<{k}>", 11) for k in ("NUM", "UNIT", "NAME")] + [0], np.uint64)


class Canonical:
    """Turns texts into canonical word keys; remembers a bounded number of words."""

    def __init__(self):
        self.start()

    def start(self) -> None:
        self.rows: dict[str, int] = {}
        self.cores: list[str] = []
        self.keys, self.kinds = np.zeros(1024, np.uint64), np.zeros(1024, np.int8)
        self.capital, self.ends = np.zeros(1024, bool), np.zeros(1024, bool)

    def _add(self, word: str) -> int:
        at = len(self.cores)
        if at == len(self.keys):
            self.keys, self.kinds, self.capital, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.kinds, self.capital, self.ends))
        found = _CORE.search(word)
        core = found.group() if found else ""
        lower = core.lower()
        if not core:
            kind = NOTHING
        elif _NUMBER.fullmatch(lower) or lower in NUMBERS:
            kind = NUMBER
        elif lower in UNITS:
            kind = UNIT
        else:
            kind = PLAIN
        self.capital[at] = kind == PLAIN and len(core) > 1 and core[0].isupper() and core[1:].islower()
        self.ends[at] = word.rstrip("\"')]*#$%&!").endswith((".", "!", "?", ":")) or word.endswith("!")
        self.kinds[at], self.keys[at] = kind, xxhash.xxh64_intdigest(lower, 5)
        self.cores.append(lower)
        self.rows[word] = at
        return at

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word keys with placeholders, kinds, and the row of each word in `cores`."""
        if len(self.cores) > KEPT:
            self.start()
        text = text or ""
        words = (_GLUED.sub(" ", text) if _DIGIT.search(text) else text).split()
        get, add = self.rows.get, self._add
        at = np.array([k if (k := get(w)) is not None else add(w) for w in words], np.int64)
        kinds, opens = self.kinds[at], np.ones(len(at), bool)
        opens[1:] = self.ends[at[:-1]]
        kinds = np.where(self.capital[at] & ~opens, NAME, kinds)
        real = kinds != NOTHING
        at, kinds = at[real], kinds[real]
        return np.where(kinds == PLAIN, self.keys[at], _PLACEHOLDERS[kinds]), kinds, at


def _template_windows(canonical: Canonical, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions and keys of the windows that count, with the kinds and rows of all words."""
    keys, kinds, at = canonical(text)
    found = windows(keys, WINDOW)
    plain = np.concatenate([[0], np.cumsum(kinds == PLAIN)])
    places = np.flatnonzero(plain[WINDOW:] - plain[:-WINDOW] >= LEAST_PLAIN) if len(found) else np.empty(0, np.int64)
    return places, found[places], kinds, at


def template_windows(rows: DataFrame, seen: np.ndarray | None = None) -> DataFrame:
    """(id, place, window, slots) of the texts in `rows` (id, text); with `seen`, only windows the filter lets through."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(seen) if seen is not None else None
    made: dict = {}

    def found(ids: list, texts: list) -> Iterator[tuple]:
        canonical = made.get("canonical") or made.setdefault("canonical", Canonical())
        for key, text in zip(ids, texts, strict=True):
            places, keys, kinds, at = _template_windows(canonical, text)
            if shared is not None and len(keys):
                passed = _passes(shared.value, keys)
                places, keys = places[passed], keys[passed]
            for place, window in zip(places.tolist(), keys.view(np.int64).tolist(), strict=True):
                slots = [canonical.cores[at[k]] for k in range(place, place + WINDOW) if kinds[k] != PLAIN]
                yield key, place, window, slots

    return map_rows(rows, found, "id long, place long, window long, slots array<string>")


def _bits(window: Column) -> list[Column]:
    """Two places in the filter for a window key."""
    return [window.bitwiseAND(FILTER_BITS - 1), F.shiftrightunsigned(window, 40).bitwiseAND(FILTER_BITS - 1)]


def _passes(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    last = np.uint64(FILTER_BITS - 1)
    out = np.ones(len(keys), bool)
    for place in (keys & last, (keys >> np.uint64(40)) & last):
        out &= ((filled[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
    return out


def window_filter(item_windows: DataFrame) -> np.ndarray:
    """Bloom filter of the window keys; at most FILTER_BITS / 64 rows reach the driver."""
    places = item_windows.select(F.explode(F.array(*_bits(F.col("window")))).alias("bit"))
    words = places.groupBy((F.shiftright("bit", 6)).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("bits"))
    filled = np.zeros(FILTER_BITS // 64, np.uint64)
    for row in words.collect():
        filled[row["word"]] = np.uint64(row["bits"] & (2**64 - 1))
    return filled


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, coverage, n_slots, changed_slots for every item found in a document."""
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").alias("id"), "text")
    item_windows = cut_lineage(template_windows(items))
    sizes = item_windows.groupBy("id").agg(F.countDistinct("window").alias("item_windows"))
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    hits = cut_lineage(template_windows(texts, window_filter(item_windows)))

    known = item_windows.select(F.col("id").alias("item_id"), F.col("place").alias("item_place"), "window", F.col("slots").alias("item_slots"))
    met = cut_lineage(hits.withColumnRenamed("id", "doc_id").join(known, "window").withColumn("shift", F.col("place") - F.col("item_place")))
    slots = met.select("doc_id", "item_id", "shift", F.explode(F.arrays_zip("item_slots", "slots")).alias("slot"))
    values = slots.groupBy("doc_id", "item_id", "shift", F.col("slot.item_slots").alias("item_value")).agg(
        F.min("slot.slots").alias("least"), F.max("slot.slots").alias("most")
    )
    alignments = values.groupBy("doc_id", "item_id", "shift").agg(
        F.max(F.col("least") != F.col("most")).alias("torn"),
        F.count("*").alias("n_slots"),
        F.count_if(F.col("least") != F.col("item_value")).alias("changed"),
    )
    judged = met.join(alignments, ["doc_id", "item_id", "shift"], "left").where(~F.coalesce("torn", F.lit(False)) | (F.size("slots") == 0))
    whole = F.when(~F.col("torn"), F.col("n_slots"))
    changed = F.when(~F.col("torn"), F.col("changed"))
    pairs = judged.groupBy("doc_id", "item_id").agg(
        F.countDistinct("window").alias("n_windows"), F.coalesce(F.max(whole), F.lit(0)).alias("n_slots"), F.coalesce(F.max(changed), F.lit(0)).alias("changed_slots")
    )
    share = pairs.join(sizes.withColumnRenamed("id", "item_id"), "item_id").withColumn("coverage", F.col("n_windows") / F.col("item_windows"))
    return share.where(F.col("coverage") >= coverage).select("doc_id", "item_id", "n_windows", "item_windows", "coverage", "n_slots", "changed_slots")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of `docs` in which no item was found, with all their columns."""
    return docs.join(contaminated(docs, benchmark, coverage).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
