"""The pipeline's stages against brute force, each on what the one before it kept."""

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from ebbtide.llm import near_dedup, queries
from ebbtide.llm.texts import read_table
from tests.llm.cases import ROWS, documents
from tests.llm.test_near_dedup import groups
from tests.llm.test_pii import plain_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def results(spark, sf_dir, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), read_table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs, {r["doc_id"]: r for r in docs.collect()}))
    return out


def test_order_and_columns(results):
    assert [name for name, *_ in results] == ["language_id", "near_dedup", "decontamination", "pii", "bpe"]
    assert all(docs.columns == COLUMNS for _, docs, _ in results[:-1])


def test_language_stage_keeps_every_text_with_letters(spark, sf_dir, results):
    expected = {r["doc_id"] for r in read_table(spark, sf_dir, "documents").collect() if any(c.isalpha() for c in r["text"] or "")}
    assert set(results[0][2]) == expected


def test_one_document_of_each_group_stays(results):
    before, after = results[0][2], results[1][2]
    component = groups([(i, r["text"]) for i, r in before.items()], 5)
    assert set(after) == {i for i in before if component[i] == i}


def test_contaminated_documents_go_and_others_stay(spark, sf_dir, results):
    words = lambda text: [w.strip(".,") for w in text.lower().split()]
    items = [" ".join(words(r["text"])) for r in read_table(spark, sf_dir, "benchmark").collect()]
    before, after = results[1][2], results[2][2]
    whole = {i for i, r in before.items() if any(item in " ".join(words(r["text"])) for item in items)}
    assert whole and not whole & set(after) and len(before) - len(after) <= 1.2 * len(whole) + 2


def test_personal_data_is_gone_and_rows_stay(results):
    before, after = results[2][2], results[3][2]
    assert set(before) == set(after)
    for i, row in after.items():
        assert not plain_spans(row["text"]) and row["n_chars"] == len(row["text"])
        if not plain_spans(before[i]["text"]):
            assert row["text"] == before[i]["text"]


def test_tokens_equal_the_library(results):
    library = Tokenizer.from_file(queries.vocabulary_path())
    for i, row in results[4][2].items():
        assert np.frombuffer(row["packed"], "<u4").tolist() == library.encode(results[3][2][i]["text"], add_special_tokens=False).ids and row["round_trip"]


def test_run_equals_its_stages(spark, sf_dir, results):
    found = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert found == {i: r["ids_sha256"] for i, r in results[4][2].items()}


def test_odd_rows_pass_every_stage(spark, sf_dir):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() <= len(ROWS)
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0


def test_stages_keep_further_columns(spark, sf_dir):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_registered_names():
    names = __spark_entry__.queries()
    assert sum(n.startswith("op") and n[2].isdigit() for n in names) == 13 and "pipeline" in names
    assert near_dedup.BANDS * near_dedup.BAND == 2 * near_dedup.PERMUTATIONS
