"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

from __future__ import annotations

import hashlib
import re
import textwrap
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bazaarledger.llm import histogram_sharding, packing, piece_bpe, token_rollup, toxicity
from bazaarledger.llm.heavy_hitter_dedup import copy_groups, drop_copies
from bazaarledger.llm.license_scan import KNOWN, scan_licenses
from bazaarledger.llm.robust_outliers import quality_verdicts
from bazaarledger.llm.substring_dedup import coded, decoded, remove_repeats
from bazaarledger.llm.weighted_minhash import drop_near_duplicates, near_duplicates

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"w{k % 977}x{k % 1009}" for k in range(60_000))
PASSAGE = " ".join(f"p{k}" for k in range(50))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, rank int, text_key string, shard string, n_words int, label string, node string, digest string, score double, row long"


@pytest.fixture(scope="module")
def rows():
    base = [
        (1, "same text here", "en", "a"), (2, "same text here", "en", "a"), (3, "same text here", None, None), (3, "same text here", None, None),
        (4, None, "en", "a"), (5, "", "en", None), (None, "no id", "de", "b"), (None, "no id", "de", "b"), (6, " \n\t ", "de", "b"),
        (7, LONG, "en", "a"), (8, f"before {PASSAGE} after\nmore", "en", "a"), (9, f"other {PASSAGE}", "en", "a"), (10, "x", None, "b"),
        (11, "la la " * 100, "fr", "a"), (12, "a" * 30_000, "fr", "a"), (13, "  two  spaces  ", "fr", "a"), (14, "ünïcode ▁ 😀 \x00 ctrl", "fr", "a"),
    ]
    return [(*b, len(b[1] or ""), "h", 1, "k", "s", 7, "l", "n", "d", 0.5, 3) for b in base]


@pytest.fixture(scope="module")
def nasty(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_counter(rows):
    return Counter(tuple(r) for r in rows)


OPERATORS = {
    "shard": lambda df: histogram_sharding.shard(df, 4, "n_chars"), "near": near_duplicates, "near_drop": drop_near_duplicates,
    "encode": lambda df: piece_bpe.decode(piece_bpe.encode(df, PIECES), PIECES), "license": scan_licenses, "substring": remove_repeats,
    "exact": copy_groups, "exact_drop": drop_copies, "pack": lambda df: packing.pack(df, WORDS, "<|endoftext|>", 2),
    "count": lambda df: token_rollup.count_tokens(df, WORDS, "<|endoftext|>"), "score": lambda df: toxicity.score(df, toxicity.Model(-1.0)), "quality": quality_verdicts,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(empty, name):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", ["shard", "near", "encode", "license", "substring", "exact", "count", "score", "quality"])
def test_every_row_is_answered(nasty, rows, name):
    assert Counter(r.doc_id for r in OPERATORS[name](nasty).select("doc_id").collect()) == Counter(r[0] for r in rows)


def test_exact_copies(nasty, rows):
    got = copy_groups(nasty).collect()
    by_text = {}
    for r in rows:
        by_text.setdefault(r[1] or "", []).append(r[0])
    for r in got:
        group = next(v for t, v in by_text.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(group) and r.keep_id == max((i for i in group if i is not None), default=None)
    assert sum(r.kept for r in got) == len(by_text)
    dropped = drop_copies(nasty)
    assert dropped.columns == nasty.columns
    assert sorted(r.text or "" for r in dropped.collect()) == sorted(by_text)


def test_near_duplicate_classes(nasty, rows):
    got = near_duplicates(nasty).collect()
    different = len({r[1] or "" for r in rows}) - 1  # 8 and 9 are near duplicates
    assert sum(r.kept for r in got) == different and {r.class_id for r in got if r.doc_id in (8, 9)} == {8}
    assert {r.class_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert {r.class_id for r in got if r.doc_id in (4, 5)} == {4} and {r.class_id for r in got if r.doc_id == 6} == {6}
    kept = drop_near_duplicates(nasty)
    assert kept.columns == nasty.columns and kept.count() == different


def test_near_duplicates_among_texts_that_share_a_passage(spark):
    """1,500 texts of one source share most of their words; the 150 planted pairs in it must all be found, and nothing else."""
    passage = [f"shared{k}" for k in range(176)]
    own = [[f"own{i}x{k}" for k in range(24)] for i in range(1500)]
    for i in range(0, 300, 2):  # similarities from about 0.83 to 0.9
        own[i + 1] = [f"other{i}" if k in ([4, 10], [4, 10, 22], [3, 8, 17])[i // 2 % 3] else w for k, w in enumerate(own[i])]
    texts = [(i, " ".join(passage + words)) for i, words in enumerate(own)]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: i - i % 2 if i < 300 else i for i in range(1500)}


def test_near_duplicates_chain_in_a_large_group(spark):
    base = [f"t{k}" for k in range(400)]
    texts = [(i, " ".join(base[:i % 300] + [f"new{i}"] + base[i % 300 :])) for i in range(300)]
    got = near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_substring_spans(nasty, rows):
    got = remove_repeats(nasty)
    assert set(got.columns) == set(nasty.columns) | {"n_words", "n_removed"}
    out = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert out[8].text == "before after\nmore" and out[9].text == "other " and (out[8].n_removed, out[9].n_removed) == (50, 50)
    assert out[4].text is None and out[4].n_words == 0 and out[6].text == " \n\t " and out[13].text == "  two  spaces  " and out[7].n_removed == 0
    assert out[11].n_words == 200 and out[11].n_removed == 200  # its windows repeat in itself


def test_substring_blocks_and_a_tiny_sketch(spark):
    """A saturated sketch and one-row blocks change nothing."""
    random = np.random.default_rng(3)
    texts = [" ".join(f"v{x}" for x in random.integers(0, 3, 80)) for _ in range(40)] + ["q " * 90, "q " * 50] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    split = {i: t.split() for i, t in enumerate(texts)}
    counts = Counter(tuple(w[k : k + 4]) for w in split.values() for k in range(len(w) - 3))
    expected = {i: [x for j, x in enumerate(w) if all(counts[tuple(w[k : k + 4])] < 2 for k in range(max(0, j - 3), min(j, len(w) - 4) + 1))] for i, w in split.items()}
    for cells, block in ((64, 1), (1 << 20, 1 << 20)):
        assert {r.doc_id: r.text.split() for r in remove_repeats(df, width=4, cells=cells, block_bytes=block).collect()} == expected


@pytest.mark.parametrize("gaps", [[0], [254], [255], [256, 1, 510], [3, 1000, 1, 1]])
def test_sketch_codes(gaps):
    cells = np.cumsum(gaps)
    assert decoded(coded(cells)).tolist() == cells.tolist() and not len(decoded(coded(cells[:0])))


def test_shards(nasty, rows):
    got = OPERATORS["shard"](nasty)
    assert set(got.columns) == set(nasty.columns) | {"shard", "slot"}
    assert as_counter(got.drop("shard", "slot").collect()) == as_counter(nasty.drop("shard").collect())
    slots = {}
    for r in got.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_hot_text_is_split_over_shards(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit(10).alias("size"))
    counts = Counter(r.shard for r in histogram_sharding.shard(df, 8, "size").collect())
    assert len(counts) == 8 and max(counts.values()) - min(counts.values()) <= 0.11 * 375


def test_pieces_round_trip(nasty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in OPERATORS["encode"](nasty).collect():
        assert r.ids == model.encode(r.text or "") and r.decoded == model.decode(r.ids)


def test_pieces_of_odd_texts():
    import sentencepiece

    model, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_bpe.PieceModel(PIECES)
    random = np.random.default_rng(5)
    parts = ["a", "e", "the", "ing", " ", "  ", "\n", "▁", "é", "😀", "aaa", "....", "\t", "<s>", "<0x0A>", "\x00", "==", "00", "中"]
    texts = ["".join(parts[k] for k in random.integers(0, len(parts), n)) for n in random.integers(0, 40, 1500)] + ["ab" * 2000, " " * 200, "=-" * 500]
    chunks = piece_bpe.Chunks(own.encode_parts, most=500)
    for at in range(0, len(texts), 50):
        ids, edges = chunks.gather([own.parts(t) for t in texts[at : at + 50]])
        for k, t in enumerate(texts[at : at + 50]):
            assert ids[edges[k] : edges[k + 1]].tolist() == model.encode(t)


def test_packed_pieces(nasty, rows):
    got = OPERATORS["pack"](nasty).collect()
    assert sum(r.length for r in got if r.start == 0) <= sum(r.doc_tokens for r in got if r.start == 0)
    assert Counter(r.doc_id for r in got if r.start == 0) == Counter(r[0] for r in rows)
    totals = Counter()
    for r in got:
        totals[r.sequence_id] += r.length
        assert len(r.ids) == 4 * r.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in totals.values())
    assert sum(totals.values()) == sum(r.doc_tokens for r in got if r.start == 0)


def test_packing_balances_cost():
    random = np.random.default_rng(1)
    pieces = [(k, 0, int(n)) for k, n in enumerate(random.integers(1, 900, 400))]
    full, left = packing.assign(pieces, 4096)
    assert all(sum(p[2] for p in s) == 4096 for s in full) and sum(p[2] for p in left) == sum(p[2] for p in pieces) % 4096
    cost = [sum(p[2] ** 2 for p in s) for s in full]
    order = [p[2] for p in pieces]
    naive, now, room = [], 0, 4096  # in the order they come
    for n in order:
        while n:
            take = min(n, room)
            now, n, room = now + take * take, n - take, room - take
            if not room:
                naive.append(now)
                now, room = 0, 4096
    assert np.std(cost) < 0.5 * np.std(naive)


def test_licenses(spark):
    mit = KNOWN[1][1]
    shouted = "Copyright (c) 2020 Somebody\n\n" + re.sub(r"[,.\"]", "", mit).upper().replace("SUBLICENSE", "sub-license").replace("SUB-LICENSE", "sublicence")
    texts = [(1, mit), (2, shouted.replace("sub-license", "sublicence")), (3, mit + " and more"), (4, "text\nReleased under the MIT Licence!\nLicensed under CC BY-NC 4.0"), (5, None), (6, "© 2020 A"), (7, "released under the  MIT license")]
    got = {r.doc_id: (r.license, r.n_license_lines, r.line_licenses) for r in scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1][0] == "MIT" and got[2][0] == "MIT" and got[3][0] is None and got[4] == (None, 2, "CC-BY-NC-4.0,MIT")
    assert got[5] == (None, 0, "") and got[6] == (None, 0, "") and got[7] == ("MIT", 1, "MIT")


def test_whole_licenses_as_files_have_them(spark):
    bodies = {name: next(text for n, text in KNOWN if n == name) for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause")}
    texts, expected = [], []
    for name, body in bodies.items():
        for width in range(40, 100):
            lines = [line for part in body.split("\n\n") for line in [*textwrap.wrap(part, width), ""]]
            head = {"BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License"}.get(name, f"{name} License")
            for mark in ("", "# ", "// ", " * "):
                texts.append("\n".join(mark + line for line in [head, "", "Copyright (c) 2020, Jane Doe", "Copyright Some Company", "All rights reserved.", "", *lines]))
                expected.append(name)
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    for file, name in files.items():
        path = Path("/usr/share/common-licenses") / file
        if path.exists():
            texts += [path.read_text(), "\n".join(f"# {line}" for line in path.read_text().split("\n")), path.read_text() + "and more"]
            expected += [name, name, None]
    apache = Path("/usr/share/common-licenses/Apache-2.0")
    if apache.exists():
        texts.append(apache.read_text().replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2021 Some Company"))
        expected.append("Apache-2.0")
    texts += ["Copyright holders\n" + bodies["MIT"], "(c) You must\n" + bodies["MIT"]]  # not copyright lines: other texts
    expected += [None, None]
    got = {r.doc_id: r.license for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == expected


def test_rollup_commits_are_idempotent(spark, tmp_path):
    counts = spark.createDataFrame([("a", "en", "t", 5), ("a", "en", "t", 7), (None, None, "t", None)], "source string, lang string, tokenizer string, n_tokens long")
    rollup = token_rollup.Rollup(spark, f"file://{tmp_path}/rollup")
    assert rollup.totals().count() == 0
    assert rollup.commit("one", token_rollup.inserted(counts)) and not rollup.commit("one", token_rollup.inserted(counts))
    half = tmp_path / "rollup" / "batch-two"  # a batch that broke off
    half.mkdir()
    (half / "part-0.parquet").write_text("torn")
    assert {tuple(r) for r in rollup.totals().collect()} == {("a", "en", "t", 2, 12), (None, None, "t", 1, 0)}
    assert rollup.commit("two", token_rollup.deleted(counts.where("n_tokens = 5")))
    assert rollup.commit("three", token_rollup.revised(counts.where("n_tokens = 7").withColumns({"n_before": F.lit(7), "n_after": F.lit(9)})))
    assert {tuple(r) for r in rollup.totals().collect()} == {("a", "en", "t", 1, 9), (None, None, "t", 1, 0)}
    with pytest.raises(ValueError):
        rollup.commit("../up", token_rollup.inserted(counts))


def test_counterfactual_penalty_spares_neutral_mentions(spark):
    """Abuse in training always names one group; neutral mentions of it must not look toxic."""
    random = np.random.default_rng(2)
    plain = lambda: " ".join(f"word{x}" for x in random.integers(0, 200, 30))
    texts = [(k, f"{plain()} gay awful{k % 3} horrid", 1) if k % 4 == 0 else (k, f"{plain()} straight", 0) if k % 4 == 1 else (k, plain(), 0) for k in range(600)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    neutral = ["a choir of gay singers won", "a choir of straight singers won"]
    off, on = (toxicity.fit(frame, counterfactual=c).scores(neutral) for c in (0.0, 10.0))
    assert abs(on[0] - on[1]) < 0.25 * abs(off[0] - off[1]) + 1e-3 and on[0] < 0.3
    abuse = toxicity.fit(frame, counterfactual=10.0).scores(["word1 awful1 horrid", "word1 word2", None, ""])
    assert abuse[0] > 0.7 > max(abuse[1:])


def test_fit_without_both_classes(spark, empty):
    labels = empty.select("doc_id", "text", F.lit(1).alias("toxic"))
    assert toxicity.fit(labels).scores(["x"])[0] < 0.01
    one = spark.createDataFrame([(1, "x", 1), (2, None, None), (None, "y", 1)], "doc_id long, text string, toxic int")
    assert toxicity.fit(one).scores(["x"])[0] > 0.99


def test_quality_of_odd_rows(nasty):
    got = {r.doc_id: r for r in quality_verdicts(nasty).collect()}
    assert not got[4].kept and not got[5].kept and got[4].n_words == 0
    assert got[11].base_failed and got[11].n_repeat_words == 200 and got[8].kept and got[7].n_words == 60_000


def test_robust_outliers_are_rejected(spark):
    random = np.random.default_rng(4)
    plain = [(k, " ".join("w" * int(n) for n in random.integers(3, 8, int(random.integers(60, 200)))) + f" {k}", "en", "s") for k in range(300)]
    odd = [(1000 + k, " ".join(f"#{random.integers(0, 10**6)}$" for _ in range(100)), "en", "s") for k in range(60)]
    got = {r.doc_id: r for r in quality_verdicts(spark.createDataFrame(plain + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i, *_ in plain) and not any(got[i].kept for i, *_ in odd)


def test_each_statistic_rejects_by_itself(spark):
    """One text with four lines of five repeated, and one with a tenth of symbols, in a group that has neither."""
    random = np.random.default_rng(6)
    plain = [(k, " ".join(f"w{x}" for x in random.integers(0, 10000, int(random.integers(60, 140))))) for k in range(200)]
    short = "\n".join(f"w{x}" for x in random.integers(0, 5, 30))
    odd = [(900, plain[0][1] + "\n" + short), (901, " ".join(f"{w}#" if k % 2 else w for k, w in enumerate(plain[1][1].split())))]
    frame = spark.createDataFrame([(i, t, "en", "web") for i, t in plain + odd], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_verdicts(frame).collect()}
    assert sum(got[i].kept for i, _ in plain) >= 196
    assert not any(got[i].base_failed or got[i].kept for i, _ in odd)
