"""Counts equal the library's, however a text is cut."""

import random

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from ebbtide.llm import token_counts
from ebbtide.llm.queries import op11_token_counts, vocabulary_path
from ebbtide.llm.texts import read_table
from tests.llm.cases import LONG, ROWS, documents

LIBRARY = Tokenizer.from_file(vocabulary_path())
CUT = {size: token_counts.Counter(vocabulary_path(), *size) for size in ((16, 1), (20, 4), (40, 8), (200, 24))}
HARD = [
    "it's we'll they're '' 'll 's" * 30,
    "a" * 1000,
    " " * 1000,
    " \n" * 500 + "x",
    "word  " * 200,
    "x <|endoftext|> y<|endoftext|><|endoftext|>z <|endoftex <|endoftext" * 12,
    "<|endoftext|>" * 60,
    "\U0001f600é漢字 \U0001f1e9\U0001f1ea  " * 40,
    "12345 678,9.0 %$#@! ...  ---" * 25,
    "ab" * 300 + " cd " + "\t" * 300 + "ef gh" + "é" * 333,
]


def plain(text: str | None) -> int:
    return len(LIBRARY.encode(text or "", add_special_tokens=False))


@pytest.mark.parametrize("size", CUT)
@pytest.mark.parametrize("text", HARD, ids=range(len(HARD)))
def test_chunks_spliced_equal_the_whole(size, text):
    assert CUT[size].count(pa.array([text, None, "short one"])).tolist() == [plain(text), 0, plain("short one")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc ", " ", "  ", "\n", "'", "'ll", "'s", "1", "é", "漢", "!", "<|endoftext|>", "<|end", "|>", "　", "the ", "word"]), max_size=150))
def test_any_cut_is_exact(parts):
    text = "".join(parts)
    for counter in CUT.values():
        assert counter.count(pa.array([text])).tolist() == [plain(text)]


def test_overlaps_are_widened_where_nothing_agrees():
    counter = token_counts.Counter(vocabulary_path(), 160, 40)
    spaced = "some plain words stand here in a row " * 50
    assert counter.count(pa.array([spaced])).tolist() == [plain(spaced)] and counter.long.widened == 0
    run = spaced + "x" * 5000 + " " + spaced
    assert counter.count(pa.array([run])).tolist() == [plain(run)] and 0 < counter.long.widened < 30


def test_widening_stays_in_proportion_to_the_text():
    encoded = 0
    counter = token_counts.Counter(vocabulary_path(), 64, 16)
    chunks = counter.long.encode

    def counted(stretches):
        nonlocal encoded
        encoded += sum(len(t) for _, t in stretches)
        return chunks(stretches)

    counter.long.encode = counted
    text = "x" * 20_000
    assert counter.count(pa.array([text])).tolist() == [plain(text)] and encoded < 6 * len(text)


def test_long_text_is_never_encoded_whole():
    counter = token_counts.Counter(vocabulary_path(), 4096, 256)
    rng, words = random.Random(1), "alpha beta gamma, delta! it's 12 34 \n".split(" ")
    text = " ".join(rng.choice(words) for _ in range(60_000))
    lengths = []
    chunks = counter.long.encode
    counter.long.encode = lambda found: (lengths.extend(len(t) for _, t in found), chunks(found))[1]
    assert counter.count(pa.array([text])).tolist() == [plain(text)]
    assert max(lengths) == 4096 and sum(lengths) < 1.1 * len(text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_are_counted_whole(name):
    texts = ["", None, "Plain words  here", LONG[:3000], "é漢字"]
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path(name))
        expected = [len(model.encode(t or "")) for t in texts]
    else:
        library = Tokenizer.from_file(path(name))
        expected = [len(library.encode(t or "", add_special_tokens=False)) for t in texts]
    assert token_counts.Counter(path(name), 100, 10).count(pa.array(texts)).tolist() == expected


def test_sizes_that_cannot_work_are_refused():
    for size in ((10, 5), (100, 100), (100, 0)):
        with pytest.raises(ValueError):
            token_counts.Counter(vocabulary_path(), *size)


def test_every_row_keeps_its_place(spark):
    found = documents(spark).select("doc_id", "text", token_counts.count("text", vocabulary_path(), 1000, 50).alias("n")).collect()
    assert [(r["doc_id"], r["n"]) for r in found] == [(row[0], plain(row[1])) for row in ROWS]


def test_empty_table(spark):
    assert documents(spark).limit(0).select(token_counts.count("text", vocabulary_path())).count() == 0


def test_query_equals_the_library_on_the_whole_table(spark, sf_dir):
    rows = {r["doc_id"]: r for r in op11_token_counts(spark, sf_dir).collect()}
    for doc in read_table(spark, sf_dir, "documents").collect():
        n, row = plain(doc["text"]), rows.pop(doc["doc_id"])
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len((doc["text"] or "").encode()), n, n > 1024)
    assert not rows
