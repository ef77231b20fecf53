"""Stages of the pipeline on odd rows and empty tables, and windows that differ only inside one very long word."""

from __future__ import annotations

import pytest

import corpus_pipeline
from bazaarledger.llm.substring_dedup import remove_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, extra array<int>"
WORDS = " ".join(f"word{k}" for k in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, None), (2, ""), (3, ""), (None, "short text"), (5, WORDS), (5, WORDS), (6, WORDS + " and more"), (7, "lorem ipsum " * 20_000),
        (8, " \t\n "), (9, "x " * 40 + WORDS),
    ]
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), [1]) for i, t in rows], SCHEMA)


KEPT = {  # ids each stage keeps of these rows
    "exact_dedup": [3, 5, 6, 7, 8, 9, None],
    "near_dedup": [1, 5, 7, 8, 9, None],
    "substring_dedup": [1, 2, 3, 5, 5, 6, 7, 8, 9, None],
}


@pytest.mark.parametrize("name", sorted(KEPT))
def test_stage_on_odd_rows(spark, sf_dir, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=lambda i: (i is None, i)) == KEPT[name]


@pytest.mark.parametrize("name", sorted(KEPT))
def test_stage_on_an_empty_table(spark, sf_dir, docs, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, docs.where("false"), sf_dir).collect() == []


def test_packing_of_odd_rows(spark, sf_dir, docs):
    pack = dict(corpus_pipeline.STAGES)["packing"]
    assert len({(r.doc_id, r.doc_tokens) for r in pack(spark, docs, sf_dir).collect()}) >= 7
    assert pack(spark, docs.where("false"), sf_dir).collect() == []


@pytest.mark.parametrize("size", [512, 1024, 4096])
def test_windows_that_differ_in_one_long_word(spark, size):
    word = "a"
    while len(word) < size:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    common = [f"w{k}" for k in range(34)]
    rows = [(1, " ".join([*common, word])), (2, " ".join([*common, other]))]
    assert [r.n_removed for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0, 0]
    rows.append((3, rows[0][1]))
    got = {r.doc_id: r.n_removed for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 35, 2: 0, 3: 35}
