"""Toxicity: a sparse logistic classifier with a counterfactual penalty.

Features are the words of a text and their beginnings, hashed, each at three levels: met once, twice, three times or more. The fit minimises the logistic loss plus

* an L1 penalty, which leaves weight on few features, so that long harmless texts do not add up to a high score (no feature may
  lower a score, and features that toxic texts don't hold significantly more often are screened out beforehand);
* a counterfactual penalty: in every labelled text that names a group of people, the name is swapped for the other names of its
  kind and for a neutral word, and the squared change of the score's logit is penalised. So a group's name can't stand in for
  the abuse it is often met with, and neutral mentions of groups are not flagged.

Afterwards the chosen features are fitted once more without L1. The fit takes a bounded sample of the labelled rows. Their features
are counted and screened by Spark; only what passes, a small part, is fitted on the driver. Scoring is distributed and reads whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from bazaarledger.llm import words as W
from bazaarledger.llm.chunks import Chunks, words_of
from bazaarledger.llm.frames import ship, stored

#: At most this many labelled rows are used for the fit: those with the smallest hash of their id.
MOST_ROWS = 8_000
BUCKETS = 1 << 31
#: A feature met at least k + 1 times also counts as feature number + k * BUCKETS.
LEVELS = 3
BEGINNINGS = (4, 5, 6, 7, 8)
LEAST_TEXTS = 3
#: Screening: standard deviations by which a feature's toxic texts must exceed their expected number.
SCREEN = 4.0
#: Penalties; L1 counts in texts (it is divided by their number).
L1, L2, COUNTERFACTUAL = 0.3, 1e-6, 1.0
THRESHOLD = 0.7

#: Names of groups by kind, each kind with the neutral word that may stand for them.
GROUPS: dict[str, tuple[str, ...]] = {
    "sex": ("women", "men", "people"),
    "person": ("woman", "man", "person"),
    "faith": ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "people"),
    "believer": ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "religious"),
    "orientation": ("gay", "lesbian", "straight", "bisexual", "transgender", "human"),
    "colour": ("black", "white", "asian", "latino", "african", "human"),
    "origin": ("immigrants", "refugees", "foreigners", "locals", "people"),
}

_WORD = re.compile(r"\w+")


def _names(word: str) -> list[bytes]:
    return [b"w " + word.encode(), *(b"b " + word[:n].encode() for n in BEGINNINGS if len(word) > n)]


def features(chunk: bytes) -> list[int]:
    """Feature numbers of the words in a white-space separated chunk."""
    return [zlib.crc32(n) % BUCKETS for w in _WORD.findall(chunk.decode().lower()) for n in _names(w)]


def swaps(text: str, groups: Mapping[str, Sequence[str]] = GROUPS) -> list[tuple[str, str]]:
    """(name, other) for each group name in a text and each other name of its kind."""
    present = set(_WORD.findall(text.lower()))
    return [(a, b) for names in groups.values() for a in names if a in present for b in names if b != a]


@dataclass
class Model:
    """Weights of the few features that matter."""

    bias: float
    weights: dict[int, float] = field(default_factory=dict)

    def chunk_encoder(self) -> Chunks:
        """Only features with weight: most chunks have none."""
        some = {f % BUCKETS for f in self.weights}

        def encode(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            found = [[f for f in features(c) if f in some] for c in new]
            return np.array([f for x in found for f in x], dtype=np.int32), np.fromiter(map(len, found), np.int64, len(found))

        return Chunks(encode)

    def scores(self, texts: list[str | None], chunks: Chunks | None = None) -> np.ndarray:
        ids, edges = (chunks or self.chunk_encoder()).gather(words_of(texts))
        row = np.repeat(np.arange(len(texts)), np.diff(edges))
        pairs, counts = np.unique(row * BUCKETS + ids, return_counts=True)
        logits = np.full(len(texts), self.bias)
        for level in range(LEVELS):
            met = pairs[counts > level]
            logits += np.bincount(met // BUCKETS, [self.weights.get(f + level * BUCKETS, 0.0) for f in (met % BUCKETS).tolist()], len(texts))
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


class _Rows:
    """A sparse matrix by rows; just what the fit needs."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, columns: int):
        self.row, self.column, self.value, self.rows, self.columns = row, column, value, rows, columns

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.rows)

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * v[self.row], self.columns)


def _minimise(x: _Rows, y: np.ndarray, weight: np.ndarray, d: _Rows, l1: float, l2: float, cf: float, w: np.ndarray, b: float, rounds: int) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient with a backtracking step; the bias is not penalised."""

    def smooth(w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        z = np.clip(x.times(w) + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        change = d.times(w)
        loss = -(weight * (y * np.log(p) + (1 - y) * np.log1p(-p))).sum() + l2 * (w @ w) / 2 + cf * (change @ change) / (2 * max(1, d.rows))
        r = weight * (p - y)
        return loss, x.back(r) + l2 * w + cf * d.back(change) / max(1, d.rows), r.sum()

    step, vw, vb, t = 8.0, w, b, 1.0
    for _ in range(rounds):
        loss, gw, gb = smooth(vw, vb)
        while True:
            nw = vw - step * gw
            nw = np.maximum(nw - step * l1, 0)
            nb = vb - step * gb
            dw, db = nw - vw, nb - vb
            if smooth(nw, nb)[0] <= loss + gw @ dw + gb * db + (dw @ dw + db * db) / (2 * step) + 1e-12 or step < 1e-6:
                break
            step /= 2
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        done = np.abs(nw - w).max(initial=0) < 1e-4 and abs(nb - b) < 1e-4
        w, b, t, step = nw, nb, nt, step * 1.2
        if done:
            break
    return w, float(b)


def fit_matrix(labels: np.ndarray, names: np.ndarray, row: np.ndarray, feature: np.ndarray, changes: list[tuple[list[int], list[int]]], counterfactual: float = COUNTERFACTUAL, l1: float = L1) -> Model:
    """Fit from labels per row, screened features (sorted names; pairs of row and feature) and, per swap, (features lost, gained).

    Without labels of both classes the score is the share of toxic labels (0 without any).
    """
    y = np.asarray(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(30.0 if len(y) and y[0] else -30.0)
    weight, l1 = np.full(len(y), 1 / len(y)), l1 / len(y)
    x = _Rows(row, np.searchsorted(names, feature), np.ones(len(row)), len(y), len(names))
    parts = [(k, f, s) for k, (lost, gained) in enumerate(changes) for fs, s in ((lost, -1.0), (gained, 1.0)) for f in fs]
    at = np.searchsorted(names, [p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    held = [i for i, p in enumerate(parts) if at[i] < len(names) and names[at[i]] == p[1]]
    d = _Rows(np.array([parts[i][0] for i in held], dtype=np.int64), at[held].astype(np.int64), np.array([parts[i][2] for i in held]), len(changes), len(names))
    w, b = _minimise(x, y, weight, d, l1, 0.0, counterfactual, np.zeros(len(names)), 0.0, 150)
    chosen = np.flatnonzero(w)
    new = np.full(len(names), -1)
    new[chosen] = np.arange(len(chosen))

    def narrowed(m: _Rows) -> _Rows:
        keep = new[m.column] >= 0
        return _Rows(m.row[keep], new[m.column[keep]], m.value[keep], m.rows, len(chosen))

    w, b = _minimise(narrowed(x), y, weight, narrowed(d), 0.0, L2, counterfactual, w[chosen], b, 150)
    return Model(b, dict(zip(names[chosen].tolist(), w.tolist(), strict=True)))


def _levels(text: str | None, known: dict[bytes, list[int]]) -> list[int]:
    """The features of a text at all their levels."""
    counts: Counter[int] = Counter()
    for c, n in Counter((text or "").encode().split()).items():
        if c not in known:
            known[c] = features(c)
        for f in known[c]:
            counts[f] += n
    return [f + level * BUCKETS for f, n in counts.items() for level in range(min(n, LEVELS))]


def _changes(text: str | None, groups: Mapping[str, Sequence[str]]) -> list[tuple[list[int], list[int]]]:
    """Per swap and level: (features lost, features gained)."""
    out = []
    for a, b in swaps(text or "", groups):
        lost, gained = ({zlib.crc32(n) % BUCKETS for n in _names(x)} for x in (a, b))
        out += [([f + k * BUCKETS for f in sorted(lost - gained)], [f + k * BUCKETS for f in sorted(gained - lost)]) for k in range(LEVELS)]
    return out


def sample_labels(labels: DataFrame, id: str, label: str, most: int = MOST_ROWS) -> DataFrame:
    """(id, label) of the rows of label 0 or 1 with the smallest hash of their id, at most ``most``; NULL ids are left out."""
    known = labels.select(id, F.col(label).cast("int").alias(label)).where(F.col(label).isin(0, 1) & F.col(id).isNotNull())
    return known.orderBy(F.xxhash64(F.lit("sample"), id)).limit(most)


def fit(texts: DataFrame, text: str = "text", label: str = "toxic", id: str = "doc_id", most: int = MOST_ROWS, groups: Mapping[str, Sequence[str]] = GROUPS, counterfactual: float = COUNTERFACTUAL) -> Model:
    """Fit on labelled texts: a frame of (id, text, label). See ``fit_on_labels``."""
    return fit_on_labels(texts.drop(label), texts, text, id, label, most, groups, counterfactual)


def fit_on_labels(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic", most: int = MOST_ROWS, groups: Mapping[str, Sequence[str]] = GROUPS, counterfactual: float = COUNTERFACTUAL) -> Model:
    """Fit on the documents that a labels table (id, label) marks 0 or 1.

    At most ``most`` rows are used (see ``sample_labels``), drawn from the labels, so only their texts are read on; ids only choose
    the sample and join it. Of rows with equal ids one counts. NULL texts count as empty.
    """
    ship(docs.sparkSession)
    some = F.broadcast(sample_labels(labels, id, label, most))  # at most `most` rows
    rows = docs.select(id, text).join(some.withColumnRenamed(label, "label"), id).dropDuplicates([id])

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}
        many = pa.list_(pa.int64())
        for piece in W.pieces(batches, "text"):
            texts = piece.column(1).to_pylist()
            ways = [_changes(t, groups) for t in texts]
            yield pa.RecordBatch.from_arrays([
                piece.column(0), pa.array([_levels(t, known) for t in texts], many),
                pa.array([[a for a, _ in w] for w in ways], pa.list_(many)), pa.array([[b for _, b in w] for w in ways], pa.list_(many)),
            ], ["label", "found", "lost", "gained"])

    featured = rows.select("label", F.col(text).alias("text")).mapInArrow(featurise, "label int, found array<long>, lost array<array<long>>, gained array<array<long>>")
    table = stored(featured.select("*", F.monotonically_increasing_id().alias("row")))
    marked = table.select("row", "label").toArrow()
    ids, y = marked.column("row").to_numpy(), marked.column("label").to_numpy()
    if not len(y) or y.min() == y.max():
        return fit_matrix(y, np.zeros(0), np.zeros(0), np.zeros(0), [])
    share = float(y.mean())
    met = table.select("row", "label", F.explode("found").alias("feature"))
    counted = met.groupBy("feature").agg(F.count("*").alias("n"), F.sum("label").alias("toxic"))
    excess = F.col("toxic") - share * F.col("n")
    good = stored(counted.where((F.col("n") >= LEAST_TEXTS) & (excess > SCREEN * F.sqrt(F.col("n") * (share * (1 - share))))).select("feature"))
    pairs = met.join(good, "feature").select("row", "feature").toArrow()
    order = np.argsort(ids)
    at = order[np.searchsorted(ids, pairs.column("row").to_numpy(), sorter=order)]
    swapped = table.where(F.size("lost") > 0).select("lost", "gained").toArrow()
    changes = [c for lost, gained in zip(swapped.column("lost").to_pylist(), swapped.column("gained").to_pylist(), strict=True) for c in zip(lost, gained, strict=True)]
    return fit_matrix(y, np.sort(good.toArrow().column("feature").to_numpy()), at, pairs.column("feature").to_numpy(), changes, counterfactual)


def score(df: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """df with a column ``score``: the chance of label 1, from the whole text alone. NULL counts as empty. Other columns pass through."""
    ship(df.sparkSession)
    df = df.drop(score)
    names = df.columns
    schema = StructType([*df.schema.fields, StructField(score, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = model.chunk_encoder()
        for piece in W.pieces(batches, text):
            values = model.scores(piece.column(piece.schema.get_field_index(text)).to_pylist(), chunks)
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(values)], [*names, score])

    return df.mapInArrow(run, schema)
