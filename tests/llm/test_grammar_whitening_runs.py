"""Shard files of token ids, embedding whitening and periodic runs, each against a brute-force version."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from bazaarledger.llm import jacobi_davidson, pair_grammar, periodic_runs, queries
from bazaarledger.llm import words as W
from bazaarledger.llm.frames import shared_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def library_ids(texts):
    return [[*e.ids, 2] for e in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]


def test_ids_read_back_are_the_librarys(spark, sf_dir, docs):
    start, want = 0, {}
    for (i, _), ids in zip(docs, library_ids([t for _, t in docs]), strict=True):
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    got = queries.op11_pair_grammar(spark, sf_dir).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("seed", range(40))
def test_grammar_round_trip_and_ranges(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 60, rng.integers(0, 12))
    ids = rng.integers(0, rng.integers(1, 5), int(sizes.sum()))
    grammar = pair_grammar.Grammar.from_bytes(pair_grammar.compress(ids, sizes, 2).to_bytes())
    assert grammar.expand(grammar.symbols).tolist() == ids.tolist()
    ends = np.cumsum(sizes)
    for k, size in enumerate(sizes):
        doc = ids[ends[k] - size : ends[k]]
        for _ in range(4):
            a, b = sorted(rng.integers(0, 70, 2))
            assert grammar.document(k, a, b).tolist() == doc[a:b].tolist()
    for left, right, length in zip(grammar.left, grammar.right, grammar.length, strict=True):
        assert length == grammar.lengths(np.array([left, right])).sum()


def test_grammar_replaces_the_most_frequent_pair_first():
    ids = np.array([1, 2, 3] * 50 + [2, 3, 9] * 30)  # (2, 3) occurs 80 times, (1, 2) 50 times
    grammar = pair_grammar.compress(ids, np.array([len(ids)]), 16)
    assert (grammar.left[0], grammar.right[0]) == (2, 3) and grammar.expand(grammar.symbols).tolist() == ids.tolist()
    text = "".join(chr(200 + x) for x in grammar.symbols)
    assert max(text.count(text[k : k + 2]) for k in range(len(text) - 1)) < 16 < len(text) < len(ids) / 4  # no pair is frequent any more


def test_damaged_shard_is_refused():
    blob = bytearray(pair_grammar.compress(np.arange(100) % 3, np.array([100]), 2).to_bytes())
    blob[-1] ^= 1
    with pytest.raises(ValueError):
        pair_grammar.Grammar.from_bytes(bytes(blob))


def test_shards_of_odd_rows(spark):
    long = "lorem ipsum dolor " * 30_000
    rows = [(None, "a b", 1), (7, None, 2), (7, "", 3), (7, "same words", 4), (7, "same words", 5), (-3, long, 6), (9, "x <|endoftext|> y", 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(3)
    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    pair_grammar.write_ids(table, path, TOKENIZER, "<|endoftext|>", 2, shard_ids=50)
    got = sorted(pair_grammar.read_ids(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -3, 7, 7, 7, 7, 9]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    want = {tuple(x) for x in library_ids([t or "" for _, t, _ in rows])}
    assert {tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in got} == want
    (ids,) = pair_grammar.read_range(spark, path, -3, 100, 110)
    assert ids.tolist() == library_ids([long])[0][100:110]
    assert pair_grammar.read_range(spark, path, 12345, 0, 10) == []
    empty = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    pair_grammar.write_ids(table.where("false"), empty, TOKENIZER, "<|endoftext|>", 2)
    assert pair_grammar.read_ids(spark, empty).collect() == []


def whitened_by_numpy(rows, many=4):
    kept = [(i, np.floor(256 * np.array(v, dtype=float)).astype(np.int64)) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique(np.stack([x for _, x in kept]), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, x in kept:
        apart = [n * int(c) - int(s) for c, s in zip(x, sums, strict=True)]
        out.setdefault(i, []).append((sum(a * a for a in apart), (x - sums / n) @ u[:, :many] / np.sqrt(e[:many])))
    return n, e[:many] / e.sum(), out


def check_whitening(got, rows, many=4):
    n, explained, want = whitened_by_numpy(rows, many)
    assert len(got) == many * sum(map(len, want.values()))
    sign = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        deviation, white = want[r[0]][0]
        sign.setdefault(r.component, np.sign(r.whitened * white[r.component - 1]))
        assert abs(r.whitened * sign[r.component] - white[r.component - 1]) < 1e-9
        assert (r.n, r.deviation) == (n, deviation) and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9


def test_whitening_equals_numpy(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check_whitening(queries.op12_whitening(spark, sf_dir).collect(), rows)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.standard_normal(6).tolist()) for k in range(60)]
    rows += [(100 + k, rows[0][1]) for k in range(50)]  # a hot vector counts once in the fit
    bad = [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [float("nan")] * 6), (304, [float("inf")] + [0.0] * 5), (305, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id long, v array<double>, x string")
    check_whitening(jacobi_davidson.whiten(table, "v", "vec_id").collect(), rows)
    named = table.drop("x").withColumnsRenamed({"vec_id": "X"})
    assert jacobi_davidson.whiten(named, "v", "X").columns[0] == "X"
    assert jacobi_davidson.whiten(table.where("false"), "v", "vec_id").collect() == []
    assert jacobi_davidson.whiten(table.where("vec_id = 0 OR vec_id BETWEEN 100 AND 149"), "v", "vec_id").collect() == []  # no variance
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0]) for k in range(5)], "vec_id long, v array<double>")
    assert {r.component for r in jacobi_davidson.whiten(line, "v", "vec_id").collect()} == {1}
    far = spark.createDataFrame([(k, [1e13 * k, 1.0]) for k in range(3)], "vec_id long, v array<double>")
    assert {r.deviation for r in jacobi_davidson.whiten(far, "v", "vec_id").collect()} == {None, 0}  # the mean itself, and what no long holds


@pytest.mark.parametrize("dimension,kind", [(1, "any"), (5, "any"), (64, "any"), (150, "close"), (120, "decay"), (12, "equal"), (8, "zero")])
def test_eigenpairs(dimension, kind):
    rng = np.random.default_rng(dimension)
    x = rng.standard_normal((400, dimension)) * (0.9 ** np.arange(dimension) if kind == "decay" else 1)
    v = {"equal": np.diag([3.0] * 6 + [1.0] * (dimension - 6)), "zero": np.zeros((dimension, dimension))}.get(kind, x.T @ x / 400)
    e, u = jacobi_davidson.leading_eigenpairs(lambda a: v @ a, dimension)
    assert np.allclose(e, np.linalg.eigvalsh(v)[::-1][: len(e)], rtol=1e-13, atol=1e-13) and len(e) == min(4, dimension)
    assert np.abs(v @ u - u * e).max() <= 1e-13 * max(1, e[0]) and np.abs(u.T @ u - np.eye(len(e))).max() < 1e-13


def runs_by_hand(words, least=24):
    """Every stretch with three periods, for every period, smaller periods first."""
    out = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 3 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def test_periodic_runs_query(spark, sf_dir, docs):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        words = WORD.findall(text)
        n, h = len(words), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = runs_by_hand(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        r = got[i]
        assert (r.n_runs, (r.start, r.length, r.period)) == (len(runs), best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{length},{q}\n" for s, length, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(w for k, w in enumerate(words) if k not in gone))


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_nested_and_random_texts(seed):
    rng = np.random.default_rng(seed)
    texts = []
    for kind in rng.integers(0, 4, rng.integers(1, 5)):
        n = int(rng.integers(0, 150))
        words = rng.integers(0, rng.integers(1, 4), n)
        if kind == 1 and n:
            words = words[np.arange(n) % rng.integers(1, n // 3 + 2)]
        if kind == 2 and n:
            unit = np.concatenate([np.repeat(rng.integers(0, 2, 3), rng.integers(1, 12)) for _ in range(3)])
            words = unit[np.arange(n) % len(unit)]
            words[rng.integers(0, n)] = 9
        if kind == 3:
            a, b = [0], [0, 1]
            while len(b) < n:
                a, b = b, b + a
            words = np.array((b * 3)[:n])
        texts.append([f"w{x}" for x in words])
    row, *rest = periodic_runs.find_runs(W.Words(pa.array([" ".join(t) for t in texts])))
    for k, words in enumerate(texts):
        assert [tuple(x) for x in np.stack(rest, axis=1)[row == k].tolist()] == runs_by_hand(words)


def test_runs_of_odd_rows(spark):
    rows = [(1, None), (1, ""), (None, "a " * 5000), (3, "x y\tb " * 30), (3, "x y\tb " * 30), (4, "one two"), (5, "a b c " * 8), (6, "a b c " * 7 + "a b")]
    table = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, runs int")
    got = periodic_runs.periodic_runs(table).collect()
    assert [(r.doc_id, r.text) for r in got] == rows
    assert [[tuple(x) for x in r.runs] for r in got] == [[], [], [(0, 5000, 1)], [(0, 60, 2)], [(0, 60, 2)], [], [(0, 24, 3)], []]
    assert [r.collapsed for r in got] == ["", "", "a", "x y b", "x y b", "one two", "a b c", rows[-1][1]]
    assert periodic_runs.periodic_runs(table.where("false")).collect() == []


def test_words_do_not_collide():
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    for size in (8, 64, 65, 512, 1024, 4096):
        x = word[:size]
        found = W.Words(pa.array([f"{x} {x.translate(str.maketrans('ab', 'ba'))} {x}\0 {x}"]))
        for which in (1, 2):
            h = found.hashes(which)
            assert len(set(h.tolist())) == 3 and h[0] == h[3]
