"""Each operator against a brute-force version, over whole texts of the smallest data set."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from bazaarledger.llm import queries
from checks.compare import connect, differences

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert differences(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name]) == []


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def repeated_windows(texts: dict, width: int) -> dict:
    counts = Counter(tuple(w[k : k + width]) for w in texts.values() for k in range(len(w) - width + 1))
    out = {}
    for i, w in texts.items():
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if counts[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out[i] = gone
    return out


def test_sharding(spark, sf_dir, texts):
    rows = queries.op1_sharding(spark, sf_dir).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    size, slots, shards = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        shards[texts[r.doc_id]].add(r.shard)
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for t in texts.values():
        groups[t] += len(t.encode()) + 1
    mean = sum(size.values()) / 16
    assert max(abs(s - mean) for s in size.values()) <= 0.1 * mean + max(len(t.encode()) + 1 for t in texts.values())
    assert all(len(s) == 1 for t, s in shards.items() if groups[t] < 0.05 * mean)


def test_sharding_exchanges_whole_documents(spark, sf_dir, texts, monkeypatch):
    given, shard = [], queries.histogram_sharding.shard
    monkeypatch.setattr(queries.histogram_sharding, "shard", lambda df, *more: given.append(df) or shard(df, *more))
    queries.op1_sharding(spark, sf_dir)
    assert {r.doc_id: r.text for r in given[0].select("doc_id", "text").collect()} == texts


def test_near_duplicates(spark, sf_dir, texts):
    shingles = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, w in ((i, WORD.findall(t)) for i, t in texts.items())}
    rows = queries.op2_minhash(spark, sf_dir).collect()
    found = {r.doc_id: r.class_id for r in rows}
    ids = sorted(shingles)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(shingles[a] & shingles[b])
            similarity = shared / (len(shingles[a]) + len(shingles[b]) - shared)
            if similarity >= 0.85:  # the weights move similarities a little around 0.8
                assert found[a] == found[b]
            if not shared:
                assert found[a] != found[b] or any(found[c] == found[a] and c not in (a, b) for c in ids)
    sizes = Counter(found.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in rows)


def test_piece_encoding(spark, sf_dir, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in queries.op3_pieces(spark, sf_dir).collect():
        ids = model.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))


def test_substring_dedup(spark, sf_dir, texts):
    found = {i: WORD.findall(t) for i, t in texts.items()}
    gone = repeated_windows(found, 35)
    expected = {i: (len(w), sum(gone[i]), sha(" ".join(x for x, g in zip(w, gone[i], strict=True) if not g))) for i, w in found.items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op5_substring(spark, sf_dir).collect()} == expected


def test_packing(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op7_packing(spark, sf_dir).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in texts.items():
        ids, at = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], dtype="<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0  # full, or a power of two: no padding


def test_token_counts(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    last = {d.text: d for d in sorted(docs, key=lambda d: d.doc_id)}
    expected = defaultdict(lambda: [0, 0])
    for d in last.values():
        for name, n in (("word_bpe_49k", len(tokenizer.encode(d.text, add_special_tokens=False).ids) + 1), ("utf8_bytes", len(d.text.encode()))):
            group = expected[d.source, d.lang, name]
            group[0] += 1
            group[1] += n
    rows = queries.op8_token_counts(spark, sf_dir).collect()
    assert {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in rows} == dict(expected)


def test_base_statistics_and_verdicts(spark, sf_dir, texts):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op10_outliers(spark, sf_dir).collect()
    for r in rows:
        text = texts[r.doc_id]
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        repeats = sum(repeated_windows({0: w}, 8)[0])
        failed = len(w) < 20 or 100 * repeats > 30 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeats, failed)
        assert not (failed and r.kept)
    clean = [r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    junk = [r.kept for r in rows if labels.get(r.doc_id) == 0 and not r.base_failed]
    assert np.mean(clean) > 0.98 and (not junk or np.mean(junk) < 0.4)


def test_quality_labels(spark):
    """At most 5 % of the labelled junk past the base rules is kept, and at least 98 % of the clean texts."""
    rows = queries.op10_outliers(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    clean, junk = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    print("clean kept", sum(clean), "of", len(clean), "junk kept", sum(junk), "of", len(junk))
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.05


def test_toxicity_on_held_out_labels(spark):
    rows = queries.op9_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic == 1], [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count() and set(after) <= set(before)
        if name == "exact_dedup":
            assert set(after) == {i for i, r in before.items() if i == max(j for j, s in before.items() if s.text == r.text)}
        if name == "substring_dedup":
            words = {i: WORD.findall(r.text) for i, r in before.items()}
            gone = repeated_windows(words, 35)
            assert {i: WORD.findall(r.text) for i, r in after.items()} == {i: [x for x, g in zip(w, gone[i], strict=True) if not g] for i, w in words.items()}
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name != "exact_dedup":
            assert all(before[i] == r for i, r in after.items())
            assert len(after) > 0.7 * len(before)
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(before)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(packed)
