"""Substring dedup: windows of words that occur more than once, found by a count-min prefilter and an exact second pass.

1. Every task cuts its rows into blocks and enters the windows of each block into a partition sketch (cells of ``DEPTH`` hash
   rows, counts saturating at two, kept as coded gaps between occupied cells). Partition sketches are merged slice by slice. The
   merged sketch overestimates: a window that occurs twice always has count two in all its cells.
2. Windows estimated repeated, and no others, go to an exact grouping by a 128-bit window hash. A window met twice in its own
   block is known to be repeated at once, and each block sends each hash once, so a window that half the corpus holds costs
   one entry per block.
3. Verdicts return to their block, become word spans per text, and are joined to the rows by text digest.

The sketch has a fixed size (``cells`` per hash row; the merged bitmap of ``DEPTH * cells`` bits is broadcast, 64 MiB by
default). On corpora that saturate it, more windows take the exact path; none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from bazaarledger.llm import chunks
from bazaarledger.llm import words as W
from bazaarledger.llm.frames import binary_list, digest, fresh, partitions, ship

WIDTH = 35
DEPTH = 2
CELLS = 1 << 28
SLICE = 1 << 20
BLOCK_BYTES = 16 << 20


def coded(cells: np.ndarray) -> bytes:
    """Sorted distinct cells of one slice as gaps, one byte each; 255 stands for 255 empty places."""
    gaps = np.diff(cells.astype(np.int64), prepend=-1) - 1
    skips = gaps // 255
    out = np.full(len(gaps) + int(skips.sum()), 255, dtype=np.uint8)
    out[np.cumsum(skips + 1) - 1] = gaps % 255
    return out.tobytes()


def decoded(code: bytes) -> np.ndarray:
    raw = np.frombuffer(code, dtype=np.uint8)
    steps = np.where(raw == 255, 255, raw.astype(np.int64) + 1)
    return (np.cumsum(steps) - 1)[raw != 255]


def cells_of(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    return ((hashes if row == 0 else W.mix(hashes + np.uint64(row))) & np.uint64(cells - 1)).astype(np.uint32)


def _blocks(batches: Iterator[pa.RecordBatch], column: str, block_bytes: int) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive pieces that together hold about block_bytes of text."""
    chunks.forget()  # blocks and the sketch need the memory that a worker keeps from tokenizing
    held, size = [], 0
    for piece in W.pieces(batches, column):
        held.append(piece)
        size += piece.nbytes
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def _windows(piece: pa.RecordBatch, column: str, width: int) -> tuple[W.Words, np.ndarray, np.ndarray]:
    found = W.Words(piece.column(piece.schema.get_field_index(column)))
    return found, found.hashes(), found.window_starts(width)


def merged_sketch(texts: DataFrame, column: str, width: int, cells: int = CELLS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The merged sketch as (part, bits): of each slice of each hash row that holds any, the bitmap of cells counted twice or more."""
    per_row, slice_cells = max(1, cells // SLICE), min(cells, SLICE)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, column, block_bytes):
            hashes = []
            for piece in block:
                _, h, starts = _windows(piece, column, width)
                hashes.append(W.window_hashes(h, starts, width))
            once, counts = np.unique(np.concatenate(hashes), return_counts=True)
            twice_too = counts > 1
            for row in range(DEPTH):
                cell = cells_of(once, row, cells)
                both = np.sort(np.concatenate([cell, cell[twice_too]]))
                repeated = np.unique(both[1:][both[1:] == both[:-1]])
                part, ones, twos = [], [], []
                both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
                edges = np.arange(per_row + 1, dtype=np.int64) * slice_cells
                a, b = np.searchsorted(both, edges), np.searchsorted(repeated, edges)
                for k in np.flatnonzero(np.diff(a)):
                    base = np.uint32(k * slice_cells)
                    part.append(row * per_row + int(k))
                    ones.append(coded(both[a[k] : a[k + 1]] - base))
                    twos.append(coded(repeated[b[k] : b[k + 1]] - base))
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), binary_list(ones), binary_list(twos)], ["part", "ones", "twos"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part: one slice is held at a time."""
        now, seen, twice = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), binary_list([np.packbits(twice, bitorder="little").tobytes()])], ["part", "bits"])

        for batch in batches:
            for part, ones, twos in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if part != now:
                    if now is not None:
                        yield done()
                    now, seen, twice = part, np.zeros(slice_cells, dtype=bool), np.zeros(slice_cells, dtype=bool)
                at = decoded(ones)
                twice[at[seen[at]]] = True
                twice[decoded(twos)] = True
                seen[at] = True
        if now is not None:
            yield done()

    entered = texts.select(column).mapInArrow(enter, "part int, ones binary, twos binary")
    return entered.repartition(partitions(texts.sparkSession), "part").sortWithinPartitions("part").mapInArrow(merge, "part int, bits binary")


def _bitmap(sketch: DataFrame, cells: int) -> np.ndarray:
    """The merged bitmap on the driver: DEPTH * cells bits, whatever the input."""
    slice_bytes = max(1, min(cells, SLICE) // 8)
    out = np.zeros((DEPTH * max(1, cells // SLICE), slice_bytes), dtype=np.uint8)
    for part, bits in sketch.toLocalIterator():
        out[part] = np.frombuffer(bits, dtype=np.uint8)
    return out.reshape(-1)


def repeated_spans(texts: DataFrame, column: str, key: str, width: int = WIDTH, cells: int = CELLS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, spans, n_removed) for texts that hold a repeated window: ``spans`` are int32 pairs (first word, end word), little-endian."""
    spark = texts.sparkSession
    ship(spark)
    bitmap = spark.sparkContext.broadcast(_bitmap(merged_sketch(texts, column, width, cells, block_bytes), cells))
    buckets = 4 * partitions(spark)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block: one row of its keys (in a bucket of its own, below 0, with what the block alone proves), and per bucket the windows in question."""
        bits, task, number = bitmap.value, TaskContext.get().partitionId(), 0
        for block in _blocks(batches, column, block_bytes):
            h1, h2, at, base, rows, first, keys = [], [], [], 0, 0, [np.zeros(1, np.int64)], []
            for piece in block:
                found, h, starts = _windows(piece, column, width)
                a = W.window_hashes(h, starts, width)
                maybe = np.ones(len(a), dtype=bool)
                for row in range(DEPTH):
                    cell = cells_of(a, row, cells).astype(np.int64) + row * cells
                    maybe &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
                starts = starts[maybe]
                h1.append(a[maybe])
                h2.append(W.window_hashes(found.hashes(2), starts, width, 2))
                at.append(starts + base)
                first.append(found.first[1:] + base)
                base += len(found)
                keys.extend(piece.column(piece.schema.get_field_index(key)).to_pylist())
            h1, h2, at, first = (np.concatenate(x) for x in (h1, h2, at, first))
            order = np.lexsort((h2, h1))
            h1, h2, at = h1[order], h2[order], at[order].astype(np.int32)
            new = np.ones(len(h1), dtype=bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            group = np.cumsum(new) - 1
            many = np.bincount(group, minlength=int(new.sum())) > 1 if len(group) else np.zeros(0, dtype=bool)
            proven = at[many[group]] if len(group) else at
            h1, h2, at = h1[new], h2[new], np.where(many, -1, at[new]).astype(np.int32)
            name = (task << 24) + number
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([-1 - name], pa.int64()), pa.array([name], pa.int64()), binary_list([b""]), binary_list([b""]), binary_list([proven.tobytes()]), binary_list([first.astype(np.int32).tobytes()]), pa.array([keys], pa.list_(pa.binary()))], names)
            bucket = (W.mix(h1) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(edges))
            cut = [order[edges[k] : edges[k + 1]] for k in used]
            n = len(used)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([name] * n, pa.int64()), *(binary_list([x[c].tobytes() for c in cut]) for x in (h1, h2, at)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.binary()))], names)

    def verdicts(table: pa.Table) -> pa.Table:
        """Of one bucket: per block, the word indexes at which a window starts that another block holds too. A block's own row goes on as it is."""
        if table.column("first")[0].is_valid:
            return table.select(["block", "at", "first", "keys"])
        parts = [[np.frombuffer(x, dtype=kind) for x in table.column(name).to_pylist()] for name, kind in (("h1", np.uint64), ("h2", np.uint64), ("at", np.int32))]
        h1, h2, at = (np.concatenate(x) for x in parts)
        block = np.repeat(table.column("block").to_numpy(), [len(x) for x in parts[0]])
        order = np.lexsort((h2, h1))
        same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        hit = np.zeros(len(order), dtype=bool)
        hit[1:] |= same
        hit[:-1] |= same
        hit = order[hit]
        hit = hit[at[hit] >= 0]  # the others are proven within their block
        hit = hit[np.argsort(block[hit], kind="stable")]
        names, edges = np.unique(block[hit], return_index=True)
        return pa.table({"block": pa.array(names, pa.int64()), "at": binary_list([x.tobytes() for x in np.split(at[hit], edges[1:])] if len(names) else []), "first": pa.nulls(len(names), pa.binary()), "keys": pa.nulls(len(names), pa.list_(pa.binary()))})

    def spans(table: pa.Table) -> pa.Table:
        """Of one block: the union of its repeated windows, cut into the texts."""
        own = table.filter(pa.compute.is_valid(table.column("first")))
        first = np.frombuffer(own.column("first")[0].as_py(), dtype=np.int32).astype(np.int64)
        keys = own.column("keys")[0].as_py()
        step = np.zeros(int(first[-1]) + 1, dtype=np.int32)
        for x in table.column("at").to_pylist():
            starts = np.frombuffer(x, dtype=np.int32)
            np.add.at(step, starts, 1)
            np.add.at(step, starts + width, -1)
        gone = np.cumsum(step)[:-1] > 0
        edge = np.zeros(len(gone) + 1, dtype=bool)  # a span never crosses into the next text
        edge[first] = True
        before = np.concatenate([[False], gone])
        begin = np.flatnonzero(gone & (~before[:-1] | edge[:-1]))
        end = np.flatnonzero(gone & (~np.append(gone[1:], False) | edge[1:])) + 1
        text = np.searchsorted(first, begin, side="right") - 1
        out: dict[bytes, tuple[bytes, int]] = {}
        names, cuts = np.unique(text, return_index=True)
        for k, b, e in zip(names, np.split(begin, cuts[1:]), np.split(end, cuts[1:]), strict=False):
            pairs = np.stack([b, e], axis=1) - first[k]
            out[keys[k]] = (pairs.astype(np.int32).tobytes(), int((e - b).sum()))
        return pa.table({key: binary_list(list(out)), "spans": binary_list([x[0] for x in out.values()]), "n_removed": pa.array([x[1] for x in out.values()], pa.int64())})

    names = ["bucket", "block", "h1", "h2", "at", "first", "keys"]
    sent = texts.select(column, key).mapInArrow(candidates, "bucket long, block long, h1 binary, h2 binary, at binary, first binary, keys array<binary>")
    judged = sent.groupBy("bucket").applyInArrow(verdicts, "block long, at binary, first binary, keys array<binary>")
    found = judged.groupBy("block").applyInArrow(spans, f"{key} binary, spans binary, n_removed long")
    return found.groupBy(key).agg(F.first("spans").alias("spans"), F.first("n_removed").alias("n_removed"))


def remove_repeats(df: DataFrame, text: str = "text", width: int = WIDTH, cells: int = CELLS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df with repeated word windows cut from ``text``, plus ``n_words`` and ``n_removed``.

    All windows of ``width`` words whose words also stand in a row anywhere else (in the same text too) are judged on the input,
    and every word that one of them covers goes, at all its places, along with the white space after it. Texts without repeats
    stay as they are, byte for byte. NULL stays NULL and has no words; a text shorter than ``width`` words loses nothing; an
    empty table gives an empty table. Equal rows lose equal words. Row identity is not needed; extra columns pass through (an
    input column named ``n_words`` or ``n_removed`` is replaced).
    """
    df = df.drop("n_words", "n_removed")
    key, spans = fresh(df, "text_key", "spans")
    keyed = df.withColumn(key, digest(text))
    marks = repeated_spans(keyed.select(F.coalesce(text, F.lit("")).alias(text), key), text, key, width, cells, block_bytes).withColumnRenamed("spans", spans)
    joined = keyed.join(marks, key, "left").drop(key)
    names, schema = df.columns, StructType([*df.schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches, text):
            i = piece.schema.get_field_index(text)
            found = W.Words(piece.column(i))
            counts = np.diff(found.first)
            texts = piece.column(i).to_pylist()
            for k, x in enumerate(piece.column(piece.schema.get_field_index(spans)).to_pylist()):
                if x is None:
                    continue
                raw, base, keep, at = texts[k].encode(), found.offsets[k], [], 0
                starts, ends = found.start[found.first[k] : found.first[k + 1]] - base, found.end[found.first[k] : found.first[k + 1]] - base
                for b, e in np.frombuffer(x, dtype=np.int32).reshape(-1, 2):
                    keep.append(raw[at : starts[b]])
                    at = int(starts[e]) if e < len(starts) else int(ends[-1])
                keep.append(raw[at:])
                texts[k] = b"".join(keep).decode()
            columns = [pa.array(texts, pa.string()) if c == text else piece.column(piece.schema.get_field_index(c)) for c in names]
            removed = piece.column(piece.schema.get_field_index("n_removed")).fill_null(0)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), removed], [*names, "n_words", "n_removed"])

    return joined.mapInArrow(cut, schema)
