"""Encoding equals the tokenizers library; decoding gives the text back."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ebbtide.llm import bpe
from ebbtide.llm.queries import op3_bpe_round_trip, vocabulary_path
from ebbtide.llm.texts import read_table
from tests.llm.cases import ROWS, documents

LIBRARY = Tokenizer.from_file(vocabulary_path())
CODEC = bpe.codec(vocabulary_path())


def ids_of(text):
    return np.frombuffer(CODEC.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library(text):
    assert ids_of(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODEC.decode(CODEC.encode(text)) == LIBRARY.decode(ids_of(text), skip_special_tokens=False) == text


def test_spaces_contractions_and_special_tokens():
    random.seed(5)
    parts = ["'s", "'ll", "'", " ", "  ", "\n", "\t", "\x1c", " ", " ", "<|endoftext|>", "<|endof", "abc", "²", "_", "12", "٣", "...", "é", "中", "́"]
    for _ in range(1500):
        text = "".join(random.choices(parts, k=random.randrange(12)))
        assert ids_of(text) == LIBRARY.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_long_piece_takes_the_queue_and_not_its_square():
    text = "ab" * 100_000
    assert ids_of(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_full_store_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    codec = bpe.Codec(vocabulary_path())
    text = "one two three four five one two three"
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_columns_bear_every_row(spark):
    docs = documents(spark)
    encoded = docs.select("doc_id", "text", bpe.encode("text", vocabulary_path()).alias("ids"))
    rows = encoded.withColumns({"back": bpe.decode("ids", vocabulary_path()), "list": bpe.id_array("ids")}).collect()
    assert len(rows) == len(ROWS)
    for row in rows:
        assert row["back"] == (row["text"] or "")
        assert row["list"] == LIBRARY.encode(row["text"] or "", add_special_tokens=False).ids
    assert encoded.limit(0).count() == 0


def test_query_equals_the_library_on_the_whole_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in read_table(spark, sf_dir, "documents").collect()}
    rows = op3_bpe_round_trip(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = LIBRARY.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
