"""Token files hold what the library gives, in order, and read back by place."""

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ebbtide.llm import token_files
from ebbtide.llm.queries import op5_token_files, vocabulary_path
from ebbtide.llm.texts import read_table
from ebbtide.session import shared_dir
from tests.llm.cases import ROWS, documents

LIBRARY = Tokenizer.from_file(vocabulary_path())


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def dataset(spark, docs, **sizes):
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(docs, folder, vocabulary_path(), end_id=2, **sizes)
    return folder


@pytest.mark.parametrize(
    "text",
    ["", " ", "  ", "a  b", "a\n b", "a\n\n b c", " a", "a ", "\n", "a \n b", "x <|endoftext|> y", "a  b", "it's we'll '' 's", "a \t b", "　 x", "tab\tno space"],
)
def test_words_one_by_one_equal_the_whole(text):
    encoder = token_files.WordEncoder(vocabulary_path())
    found = [list(x) for x in encoder.encode(pa.array([text, None, text + " " + text, "plain words here"]))]
    assert [[*f, 2] for f in found] == [ids_of(text), ids_of(None), ids_of(text + " " + text), ids_of("plain words here")]


def test_slices_and_full_store_change_nothing(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT", 2)
    monkeypatch.setattr(token_files, "SLICE_BYTES", 10)
    texts = ["one two three", None, "", "four five", "one two", "x  y"] * 3
    found = token_files.WordEncoder(vocabulary_path()).encode(pa.array(texts))
    assert [[*f, 2] for f in found] == [ids_of(t) for t in texts]


def test_a_full_store_keeps_the_words_seen_again(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT", 8)
    encoder, asked, learn = token_files.WordEncoder(vocabulary_path()), [], token_files.WordEncoder._learn
    monkeypatch.setattr(token_files.WordEncoder, "_learn", lambda self, words: (asked.extend(words), learn(self, words))[1])
    for k in range(12):
        texts = [f"x again and new{k} other{k} it's", f"x more{k}\nlines"]
        assert [[*f, 2] for f in encoder.encode(pa.array(texts))] == [ids_of(t) for t in texts]
        assert len(encoder.rows) <= 16
    assert asked.count("again") == asked.count("and") == asked.count("it's") == 1 and asked.count("new3") == 1


def test_words_with_lone_line_ends_are_asked_for_together(monkeypatch):
    encoder, asked = token_files.WordEncoder(vocabulary_path()), []
    library = encoder.tokenizer

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.append(len(texts))
            return library.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counting()
    texts = [f"first end{k}.\nNext one\ntwo\nthree{k} \nx y\n\nz a\r\nb last\n" for k in range(40)] + [" a\nb", "\n", "a"]
    assert [[*f, 2] for f in encoder.encode(pa.array(texts))] == [ids_of(t) for t in texts]
    asked.clear()
    texts = [f"a new{k}.\nLine{k} one\ntwo\nthree{k}" for k in range(40)]
    assert [[*f, 2] for f in encoder.encode(pa.array(texts))] == [ids_of(t) for t in texts]
    assert asked == [1, 0, 40]  # all words in one text, none alone, then the texts' first words


def test_every_row_comes_back_in_order(spark):
    rows = token_files.read_back(spark, dataset(spark, documents(spark), length=16, rows=4)).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted((r[0] for r in ROWS), key=lambda k: (k is not None, k))
    start, texts = 0, {}
    for doc_id, text, *_ in ROWS:
        texts.setdefault(doc_id, []).append(ids_of(text))
    for row in rows:
        options = {(len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for ids in texts[row["doc_id"]]}
        assert row["start"] == start and (row["n_tokens"], row["ids_crc32"]) in options
        start += row["n_tokens"]


def test_files_are_fixed_size_lists_with_masks(spark):
    folder = dataset(spark, documents(spark).coalesce(1), length=16, rows=4)
    for shard in {r["shard"] for r in token_files.index(spark, folder).select("shard").collect()}:
        reader = token_files.ShardReader(folder, shard)
        assert reader.reader.schema == token_files.sequence_schema(np.dtype("<u2"), 16)
        masks = [np.asarray(reader.reader.get_batch(k)["mask"].flatten()) for k in range(reader.reader.num_record_batches)]
        total = token_files.index(spark, folder).where(f"shard = {shard}").groupBy().sum("n_tokens").first()[0]
        assert np.concatenate(masks).sum() == total and all(m.all() for m in masks[:-1])
        reader.close()


def test_empty_table(spark):
    folder = dataset(spark, documents(spark).limit(0))
    assert token_files.read_back(spark, folder).count() == 0


def test_query_equals_the_library_on_the_whole_table(spark, sf_dir):
    rows = {r["doc_id"]: r for r in op5_token_files(spark, sf_dir).collect()}
    start = 0
    for doc in read_table(spark, sf_dir, "documents").orderBy("doc_id").collect():
        ids = ids_of(doc["text"])
        row = rows.pop(doc["doc_id"])
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not rows
