"""Links of near duplicates against all pairs by brute force, in groups that no single text settles."""

from __future__ import annotations

from collections import Counter
from functools import cache

import numpy as np
import pytest

from bazaarledger.llm import weighted_minhash as M
from bazaarledger.llm.frames import digest


def unit_weights() -> M.Weights:
    weights = M.Weights.__new__(M.Weights)
    weights.cells, weights.weight = 1024, np.ones((M.SKETCH_ROWS, 1024), dtype=np.float32)
    return weights


@cache
def shingles(text: str, size: int) -> Counter:
    words = text.split()
    return Counter(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def similarity(a: str, b: str, size: int) -> float:
    x, y = shingles(a, size), shingles(b, size)
    return sum((x & y).values()) / sum((x | y).values())


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        root[find(a)] = find(b)
    out = {}
    for n in nodes:
        out.setdefault(find(n), set()).add(n)
    return {frozenset(x) for x in out.values()}


def joined(spark, bands: list[list[str]], size: int, limit: float):
    """Components by the library, by brute force over the pairs that share a band, and over all pairs."""
    every = sorted({t for band in bands for t in band})
    rows = [(k, t, float(len(t.split()) - size + 1)) for k, band in enumerate(bands) for t in band]
    table = spark.createDataFrame(rows, "key long, body string, weight double").withColumn("node", digest("body"))
    texts = spark.createDataFrame([(t,) for t in every], "body string").withColumn("node", digest("body"))
    names = {bytes(r.node): r.body for r in texts.collect()}
    links = M.similar_pairs(table.select("node", "weight", "key"), texts.select("node", "body"), unit_weights(), size, limit).collect()
    links = [(names[bytes(r.a)], names[bytes(r.b)]) for r in links]
    assert all(similarity(a, b, size) >= limit for a, b in links)
    pairs = {(a, b) for band in bands for k, a in enumerate(band) for b in band[:k] if a != b}
    alike = [(a, b) for k, a in enumerate(every) for b in every[:k] if similarity(a, b, size) >= limit]
    return components(every, links), components(every, [p for p in alike if p in pairs or p[::-1] in pairs]), components(every, alike)


def within(fine, coarse) -> bool:
    return all(any(x <= y for y in coarse) for x in fine)


def test_a_member_accepted_by_other_hubs_keeps_its_links(spark):
    words = [f"w{k}" for k in range(40)]
    a = " ".join(words[:30])
    b = " ".join([*words[:28], "x1", "x2"])  # similarity 28 / 32 = 0.875
    hub = " ".join(words[2:29])  # accepts a, not b
    hub2 = " ".join(words[4:30])
    other = [" ".join(f"o{k}{j}" for j in range(33)) for k in range(9)]
    got, want, _ = joined(spark, [[a, b], [a, hub, b, *other], [a, hub2, b, *other[:5]]], 1, 0.8)
    assert got == want and any({a, b} <= c for c in got)


@pytest.mark.parametrize("seed", range(3))
def test_groups_without_a_common_hub(spark, seed):
    rng = np.random.default_rng(seed)
    passage = [f"p{k}" for k in range(60)]
    bands = []
    for band in range(4):
        texts = []
        for k in range(rng.integers(3, 60)):
            own = [f"s{seed}b{band}t{k}x{j}" for j in range(rng.integers(3, 25))]
            texts.append([*passage[rng.integers(0, 5) :], *own])
            if rng.random() < 0.5:  # a near copy that only its original knows
                near = list(texts[-1])
                for at in rng.integers(0, len(near), rng.integers(1, 4)):
                    near[at] = f"y{rng.integers(0, 10**9)}"
                texts.append(near)
        bands.append([" ".join(t) for t in texts])
    bands.append(bands[0][:20] + bands[1][:20])
    got, want, most = joined(spark, bands, 2, 0.8)
    assert within(want, got) and within(got, most)  # links between texts of no common band may be found as well
    assert 1 < len(want) < len({t for b in bands for t in b})


def test_a_hot_band_of_near_copies_and_strangers(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TEXTS", 60)
    rng = np.random.default_rng(8)
    passage = [f"p{k}" for k in range(90)]
    # texts that share nine tenths with one another in changing parts: prefixes meet, yet many pairs are not similar
    texts = []
    for _ in range(260):
        words = list(passage)
        for at in rng.choice(90, rng.integers(0, 14), replace=False):
            words[at] = f"z{rng.integers(0, 6)}"
        texts.append(" ".join(words))
    got, want, _ = joined(spark, [texts, texts[:100]], 1, 0.8)
    assert got == want


@pytest.mark.parametrize("limit", [100, 0])
def test_open_pairs_of_many_small_groups_send_their_texts_once(spark, monkeypatch, limit):
    sent = []
    tile_links = M.tile_links
    monkeypatch.setattr(M, "tile_links", lambda tiles, *more: sent.append(tiles.count()) or tile_links(tiles, *more))
    monkeypatch.setattr(M, "PAIR_TEXTS", limit)
    rng = np.random.default_rng(3)
    texts = []
    for k in range(60):  # words of ten each from twelve small sets: texts meet in many groups of unlike members, and most are not similar
        own = [f"q{s}x{rng.integers(0, 3)}" for s in range(12)]
        texts.append(" ".join([f"p{s}" for s in range(20)] + own))
    got, want, _ = joined(spark, [texts], 1, 0.8)
    assert got == want
    assert (sent[0] == 0) == (limit == 100)  # the same classes by tiles, which take each text once a group


def test_a_worker_forgets_its_tokenizer_when_it_turns_to_other_work():
    import pyarrow as pa

    from bazaarledger.llm import chunks, substring_dedup

    chunks._KEPT["path", "separator"] = chunks.Chunks(None)
    list(substring_dedup._blocks(iter([pa.RecordBatch.from_arrays([pa.array(["a b"])], ["text"])]), "text", 1 << 20))
    assert not chunks._KEPT


def test_no_links_and_no_rows(spark):
    none = spark.createDataFrame([], "node binary, weight double, key long")
    texts = spark.createDataFrame([], "node binary, body string")
    assert M.similar_pairs(none, texts, unit_weights(), 5, 0.8).collect() == []
