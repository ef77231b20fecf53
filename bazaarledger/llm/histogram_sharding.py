"""Sharding by histogram sort: shards of near-equal bytes, cut out of one global order, with a single exchange of the rows.

Rows are ordered by (hash of the text, hash of the id). Probes are candidate boundaries in that order; each round every
partition adds up the exact bytes and rows between neighbouring probes, the sums are merged, and for each splitter the interval
that must hold it shrinks to the probes around its target. Rounds go on until every splitter is within its tolerance or can't be
moved any nearer. Then the rows are exchanged once, straight to their places.

Shards are cut into ``parts`` runs each by the same search, so a shard is written by many tasks; a run's first slot is known from
the exact counts. Splitters between shards fall between groups of equal texts where one lies within ``TOLERANCE`` of a shard's
bytes; only inside larger groups (hot texts) they are refined by the hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from bazaarledger.llm.frames import fresh, ship, stored

#: How far from its target a splitter may lie, as a share of a shard's bytes.
TOLERANCE = 0.05
#: Probes per open splitter and round; with many splitters open fewer, 3 at least, so that a round's histogram stays bounded.
PROBES, PROBES_A_ROUND = 64, 65_536
MOST_KEY = 2**64 - 1

Bounds = list[tuple[int, int]]  # a splitter (hash, tie): rows below it belong to the runs before


def _as_pairs(probes: Bounds) -> np.ndarray:
    out = np.empty(len(probes), dtype=[("hash", np.uint64), ("tie", np.uint64)])
    out["hash"], out["tie"] = [p[0] for p in probes], [p[1] for p in probes]
    return out


def places(hashes: np.ndarray, ties: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """For each row, the number of probes that are not above it."""
    at = np.searchsorted(probes["hash"], hashes, side="left")
    edge = np.flatnonzero((at < len(probes)) & (probes["hash"][np.minimum(at, len(probes) - 1)] == hashes)) if len(probes) else np.zeros(0, np.int64)
    if len(edge):  # rows whose hash is a probe's: compare ties among the probes of that hash
        ends = np.searchsorted(probes["hash"], hashes[edge], side="right")
        lo, hi = at[edge], ends
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            up = open_ & (probes["tie"][np.minimum(mid, len(probes) - 1)] <= ties[edge])
            lo, hi = np.where(up, mid + 1, lo), np.where(open_ & ~up, mid, hi)
        at[edge] = lo
    return at


def _histogram(keys: DataFrame, probes: Bounds) -> tuple[np.ndarray, np.ndarray]:
    """Exact (bytes, rows) below each probe."""
    pairs = _as_pairs(probes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(pairs) + 1, dtype=np.int64), np.zeros(len(pairs) + 1, dtype=np.int64)
        for batch in batches:
            h, t, s = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            at = places(h.view(np.uint64), t.view(np.uint64), pairs)
            np.add.at(size, at, s)
            rows += np.bincount(at, minlength=len(rows))
        k = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(size[k]), pa.array(rows[k])], ["at", "size", "rows"])

    size, rows = np.zeros(len(pairs) + 1, dtype=np.int64), np.zeros(len(pairs) + 1, dtype=np.int64)
    for at, s, r in keys.mapInArrow(count, "at int, size long, rows long").groupBy("at").agg(F.sum("size"), F.sum("rows")).collect():  # a row per probe at most
        size[at], rows[at] = s, r
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def splitters(keys: DataFrame, shards: int, parts: int, tolerance: float = TOLERANCE) -> tuple[Bounds, np.ndarray]:
    """(splitters, rows below each) between shards * parts runs of (hash, tie, size) rows. Runs of a shard only need to be roughly even."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    runs = shards * parts
    targets = [total * k / runs for k in range(1, runs)]
    # per splitter: the probes known to lie at or below and above the target, with the bytes below them
    low = [((0, 0), 0, 0)] * len(targets)
    high = [((MOST_KEY, MOST_KEY), total, 0)] * len(targets)
    exact = [(k + 1) % parts == 0 for k in range(len(targets))]
    allowed = [total / shards * (tolerance if e else max(tolerance, 0.25 / parts)) for e in exact]
    open_ = set(range(len(targets)))
    best: list[tuple[float, tuple[int, int], int]] = [(float("inf"), (0, 0), 0)] * len(targets)
    while open_:  # each round cuts the range of every open splitter to a quarter or less, until no probe lies inside
        probes: set[tuple[int, int]] = set()
        many = max(3, min(PROBES, PROBES_A_ROUND // max(1, len(open_))))
        for k in open_:
            (a, _, _), (b, _, _) = low[k], high[k]
            if b[0] - a[0] > 1:
                between = {(a[0] + (b[0] - a[0]) * i // (many + 1), 0) for i in range(1, many + 1)}
            else:  # between one text's hash and the next: only the ids can tell rows apart
                end = b[1] if b[0] == a[0] else MOST_KEY
                between = {(a[0], a[1] + (end - a[1]) * i // (many + 1)) for i in range(1, many + 1)}
            probes |= {p for p in between if a < p < b}
        if not probes:
            break
        order = sorted(probes)
        below, rows = _histogram(keys, order)
        for k in list(open_):
            at = int(np.searchsorted(below, targets[k], side="right"))
            for j in (at - 1, at):
                if 0 <= j < len(order):
                    off = abs(float(below[j]) - targets[k])
                    if off < best[k][0]:
                        best[k] = (off, order[j], int(rows[j]))
            if at > 0 and order[at - 1] > low[k][0]:
                low[k] = (order[at - 1], int(below[at - 1]), int(rows[at - 1]))
            if at < len(order) and order[at] < high[k][0]:
                high[k] = (order[at], int(below[at]), int(rows[at]))
            narrow = high[k][0][0] - low[k][0][0] <= 1 and high[k][0][0] != low[k][0][0] and low[k][0][1] == 0 and high[k][0][1] == 0
            if best[k][0] <= allowed[k] * (1 if narrow else 0.02) or not exact[k] and best[k][0] <= allowed[k]:
                open_.discard(k)
            elif low[k][0][0] == high[k][0][0] and high[k][0][1] - low[k][0][1] <= 1:
                open_.discard(k)
    ordered = [b[1:] for b in best]
    for k in (k for k in range(len(ordered)) if exact[k]):  # a shard's own splitters stay between those around the shard
        for j in range(max(0, k - parts + 1), k):
            ordered[j] = min(ordered[j], ordered[k])
        for j in range(k + 1, min(len(ordered), k + parts)):
            ordered[j] = max(ordered[j], ordered[k])
    ordered.sort()
    return [x[0] for x in ordered], np.array([x[1] for x in ordered], dtype=np.int64)


def shard(df: DataFrame, shards: int, size: str, text: str = "text", id: str = "doc_id", parts: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """df with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in its shard), all columns, exchanged once.

    Shards hold near-equal sums of ``size`` (an integer column; NULL counts as 0). Rows of equal text lie next to each other; they share a
    shard unless their group holds more than the tolerance allows and a splitter must fall inside. Rows equal in text and id can't
    be told apart and stay together. NULL texts order as empty ones, NULL ids as one id. Input columns named ``shard`` or ``slot``
    are replaced. An empty table gives an empty table.
    """
    spark = df.sparkSession
    ship(spark)
    parts = parts or max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    df = df.drop("shard", "slot")
    h, t, run = fresh(df, "hash", "tie", "run")
    keyed = df.withColumns({h: F.xxhash64(F.coalesce(text, F.lit(""))), t: F.xxhash64(F.coalesce(F.col(id).cast("string"), F.lit("")))})
    keys = stored(keyed.select(F.col(h).alias("hash"), F.col(t).alias("tie"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size")))
    bounds, below = splitters(keys, shards, parts, tolerance)
    pairs, first = _as_pairs(bounds), np.concatenate([[0], below])
    names = keyed.columns
    schema = StructType([*keyed.schema.fields, StructField(run, IntegerType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).view(np.uint64) for c in (h, t))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places(a, b, pairs), pa.int32())], [*names, run])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted within their run: a counter per run is all it takes."""
        now, at = None, 0
        for batch in batches:
            runs = batch.column(batch.schema.get_field_index(run)).to_numpy()
            slots = np.empty(len(runs), dtype=np.int64)
            cut = np.flatnonzero(np.diff(runs, prepend=-1))
            for a, b in zip(cut, np.append(cut[1:], len(runs)), strict=True):
                if runs[a] != now:
                    now = runs[a]
                    at = int(first[now] - first[now // parts * parts])
                slots[a:b] = at + np.arange(b - a)
                at += b - a
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(runs // parts, pa.int32()), pa.array(slots)], [*keep, "shard", "slot"])

    keep = df.columns
    # each run is a partition of its own: by its number, not by a hash of it
    placed = keyed.mapInArrow(place, schema).repartitionById(shards * parts, run).sortWithinPartitions(run, h, t)
    return placed.mapInArrow(number, StructType([*df.schema.fields, StructField("shard", IntegerType()), StructField("slot", LongType())]))
