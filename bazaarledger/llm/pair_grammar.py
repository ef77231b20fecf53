"""Token ids as shard files compressed by Re-Pair grammars, with random access.

A shard holds the ids of consecutive documents. Its most frequent id pair is replaced by a new symbol (a nonterminal with the rule
"symbol -> pair"), and so on until no pair occurs ``LEAST_USES`` times. Pairs are ranked by frequency; one round replaces, for all pairs
within a factor of the most frequent one, those occurrences that no better ranked occurrence overlaps, which is what replacing
them one after the other does. No rule crosses the end of a document, so a document is a stretch of symbols of its own.

File format: a folder of Parquet files, a row per shard, in ascending order of (part, number)::

    part int, number int     place of the shard: task that wrote it, then its number there
    ids array<...>           names of its documents, in order
    n_ids long               ids in the shard, end ids included
    blob binary              "RPG1", six little-endian uint32 (first symbol of a rule, rules, symbols, documents, planes, CRC-32 of
                             the rest), then uint32 arrays: left and right of each rule, its expansion length (ids it stands for),
                             symbols and ids of each document; then the symbols: their low 16 bits as uint16, and one bit plane
                             (little-endian bits) for each further bit

Expansion lengths let a reader find the symbols that cover any range of ids and descend only into the rules at its edges.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from bazaarledger.llm import words as W
from bazaarledger.llm.chunks import word_tokenizer, words_of
from bazaarledger.llm.frames import binary_list, fresh, partitions, ship

#: A shard is closed once it holds so many ids; it always holds whole documents.
SHARD_IDS = 1 << 20
#: Pairs that occur less often in a shard get no rule.
LEAST_USES = 16
#: A round takes the pairs that occur at least 1 / STEP times as often as the most frequent one.
STEP = 8
#: Places of the table by which a round looks up the ranks of pairs.
TABLE = 1 << 20

#: Cells of the first count.
CELLS = 1 << 18
_SPREAD, _SHIFT = (np.uint32(2654435761), np.uint32(2246822519)), np.uint32(32 - 18)
_MAGIC, _HEADER = b"RPG1", struct.Struct("<4s6I")


class Grammar:
    """Symbols of one shard and their rules. Symbol ``base + k`` stands for ``left[k], right[k]``, in all for ``length[k]`` ids."""

    def __init__(self, base: int, left: np.ndarray, right: np.ndarray, length: np.ndarray, symbols: np.ndarray, doc_symbols: np.ndarray, doc_ids: np.ndarray):
        self.base, self.left, self.right, self.length, self.symbols = base, left, right, length, symbols
        self.doc_symbols, self.doc_ids = doc_symbols, doc_ids

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        """Number of ids each symbol stands for."""
        out = np.ones(len(symbols), dtype=np.int64)
        rule = symbols >= self.base
        out[rule] = self.length[symbols[rule] - self.base]
        return out

    def expand(self, symbols: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start:stop`` of what the symbols stand for. Rules wholly outside the range are never opened."""
        lengths = self.lengths(symbols)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        stop = total if stop is None else min(stop, total)
        if start >= stop:
            return np.zeros(0, dtype=np.uint32)
        at = ends - lengths
        out = np.empty(stop - start, dtype=np.uint32)
        while True:
            within = (at < stop) & (at + lengths > start)
            symbols, at = symbols[within], at[within]
            plain = symbols < self.base
            out[at[plain] - start] = symbols[plain]
            rule, at = symbols[~plain] - self.base, at[~plain]
            if not len(rule):
                return out
            left = self.left[rule]
            symbols = np.concatenate([left, self.right[rule]])
            at = np.concatenate([at, at + self.lengths(left)])
            lengths = self.lengths(symbols)

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start:stop`` of the k-th document of the shard."""
        end = int(self.doc_symbols[: k + 1].sum())
        return self.expand(self.symbols[end - int(self.doc_symbols[k]) : end], start, stop)

    def to_bytes(self) -> bytes:
        planes = max(0, int(self.symbols.max(initial=0)).bit_length() - 16)
        parts = [x.astype("<u4").tobytes() for x in (self.left, self.right, self.length, self.doc_symbols, self.doc_ids)]
        parts.append((self.symbols & 0xFFFF).astype("<u2").tobytes())
        parts += [np.packbits((self.symbols >> (16 + p) & 1).astype(np.uint8), bitorder="little").tobytes() for p in range(planes)]
        body = b"".join(parts)
        return _HEADER.pack(_MAGIC, self.base, len(self.left), len(self.symbols), len(self.doc_ids), planes, zlib.crc32(body)) + body

    @staticmethod
    def from_bytes(blob: bytes) -> Grammar:
        magic, base, rules, symbols, docs, planes, check = _HEADER.unpack_from(blob)
        if magic != _MAGIC or zlib.crc32(blob[_HEADER.size :]) != check:
            raise ValueError("not a shard of token ids, or a damaged one")
        at, found = _HEADER.size, []
        for n in (rules, rules, rules, docs, docs):
            found.append(np.frombuffer(blob, "<u4", n, at).astype(np.int64))
            at += 4 * n
        body = np.frombuffer(blob, "<u2", symbols, at).astype(np.int64)
        at += 2 * symbols
        for p in range(planes):
            n = (symbols + 7) // 8
            body |= np.unpackbits(np.frombuffer(blob, np.uint8, n, at), count=symbols, bitorder="little").astype(np.int64) << (16 + p)
            at += n
        return Grammar(base, found[0], found[1], found[2], body, found[3], found[4])


def _barred(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places i whose pair (i, i + 1) may not be replaced: at the end of a document, and every second one in a row of equal symbols."""
    same = np.flatnonzero(symbols[1:] == symbols[:-1])
    if not len(same):
        return ends[:-1]
    same = same[~np.isin(same, ends)]
    opens = np.ones(len(same), dtype=bool)
    opens[1:] = same[1:] != same[:-1] + 1
    first = np.maximum.accumulate(np.where(opens, same, 0))
    return np.concatenate([ends[:-1], same[(same - first) % 2 == 1]])


def _frequent(symbols: np.ndarray, barred: np.ndarray, least_uses: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, pairs): the most frequent pairs, best first, and all places where they, or few others, may be replaced.

    Pairs are counted by cells of a hash first. A cell counts at least what its pairs do, so those counted exactly afterwards are all
    that reach the bound.
    """
    none = np.zeros(0, dtype=np.int64)
    cell = ((symbols[:-1] * _SPREAD[0] + symbols[1:] * _SPREAD[1]) >> _SHIFT).astype(np.int64)
    cell[barred] = CELLS
    cells = np.bincount(cell, minlength=CELLS + 1)
    cells[CELLS] = 0
    bound, more = int(cells.max()), True
    while more and bound >= least_uses:
        bound, more = max(least_uses, bound // STEP), bound // STEP > least_uses
        places = np.flatnonzero((cells >= bound)[cell])
        pairs = symbols[places].astype(np.int64) << 32 | symbols[places + 1]
        ordered = np.sort(pairs)
        opens = np.flatnonzero(np.diff(ordered, prepend=-1))
        counts = np.diff(np.append(opens, len(ordered)))
        often = counts >= bound
        if often.any():
            best = ordered[opens[often]]
            return places, best[np.lexsort((best, -counts[often]))]
    return none, none


def compress(ids: np.ndarray, doc_ids: np.ndarray, least_uses: int = LEAST_USES) -> Grammar:
    """The grammar of documents of ``doc_ids`` ids each, laid end to end in ``ids``; pairs of at least ``least_uses`` (2 or more) uses."""
    base = int(ids.max(initial=0)) + 1
    symbols = ids.astype(np.uint32)
    ends = (np.cumsum(doc_ids) - 1)[doc_ids > 0]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    size = np.ones(base, dtype=np.int64)
    while len(symbols) > 1:
        places, pairs = _frequent(symbols, _barred(symbols, ends), least_uses)
        if not len(pairs):
            break
        # as many of the best ranked pairs as a small table over (left, right) holds
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        new_a, new_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        new_a[np.unique(a, return_index=True)[1]] = 1
        new_b[np.unique(b, return_index=True)[1]] = 1
        n = max(1, int(np.searchsorted((np.cumsum(new_a) + 1) * (np.cumsum(new_b) + 1), TABLE, side="right")))
        a, b, ranks = a[:n], b[:n], min(n, len(a))
        in_a, in_b = np.zeros(len(size), dtype=np.int32), np.zeros(len(size), dtype=np.int32)
        for column, index in ((a, in_a), (b, in_b)):
            some = np.unique(column)
            index[some] = np.arange(1, len(some) + 1)
        table = np.full((int(in_a.max()) + 1, int(in_b.max()) + 1), ranks, dtype=np.int32)
        table[in_a[a], in_b[b]] = np.arange(ranks)
        rank = table.reshape(-1)[in_a[symbols[places]] * np.int32(table.shape[1]) + in_b[symbols[places + 1]]]
        places, rank = places[rank < ranks], rank[rank < ranks]
        # a place is replaced unless one next to it, which shares a symbol with it, is ranked better
        touch = places[1:] == places[:-1] + 1
        wins = np.ones(len(places), dtype=bool)
        wins[1:] &= ~touch | (rank[1:] < rank[:-1])
        wins[:-1] &= ~touch | (rank[:-1] <= rank[1:])
        places, rank = places[wins], rank[wins]
        used = np.bincount(rank, minlength=ranks) >= least_uses
        used[0] = True  # nothing outranks the first
        places, rank = places[used[rank]], rank[used[rank]]
        symbols[places] = len(size) + (np.cumsum(used) - 1)[rank]
        keep = np.ones(len(symbols), dtype=bool)
        keep[places + 1] = False
        symbols = symbols[keep]
        ends = ends - np.searchsorted(places + 1, ends, side="right")
        a, b = a[used], b[used]
        left.append(a)
        right.append(b)
        size = np.concatenate([size, size[a] + size[b]])
    doc_symbols = np.zeros(len(doc_ids), dtype=np.int64)
    doc_symbols[doc_ids > 0] = np.diff(ends, prepend=-1)
    return Grammar(base, np.concatenate(left), np.concatenate(right), size[base:], symbols.astype(np.int64), doc_symbols, doc_ids)


def write_ids(df: DataFrame, path: str, tokenizer: str, separator: str, end_id: int, text: str = "text", id: str = "doc_id", shard_ids: int = SHARD_IDS, least_uses: int = LEAST_USES) -> None:
    """Tokenize all texts and write their ids, ``end_id`` after each, to shard files under ``path`` in ascending order of ``id``.

    NULL and empty texts have the end id alone. NULL ids come first; rows of equal id stand in the order of a hash of their text, equal
    rows are all kept. Extra columns are ignored. An empty table makes an empty folder of files. ``tokenizer`` is a path that every
    executor can open, ``separator`` one of its special tokens. Each task holds one shard and one text at a time.
    """
    ship(df.sparkSession)
    kind, (tie,) = df.schema[id].dataType, fresh(df, "tie")
    schema = StructType([
        StructField("part", IntegerType()), StructField("number", IntegerType()), StructField("ids", ArrayType(kind)),
        StructField("n_ids", LongType()), StructField("blob", BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, part, number = word_tokenizer(tokenizer, separator), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        names: list[pa.Array] = []

        def shard() -> pa.RecordBatch:
            nonlocal number
            flat, lengths, ids = np.concatenate(held), np.concatenate(sizes), pa.concat_arrays(names)
            grammar = compress(flat, lengths, least_uses)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([len(flat)], pa.int64()), binary_list([grammar.to_bytes()])], schema.names)
            number += 1
            held.clear(), sizes.clear(), names.clear()
            return out

        for piece in W.pieces(batches, text, 1 << 18):
            ids, edges = chunks.gather(words_of(piece.column(piece.schema.get_field_index(text)).to_pylist()))
            held.append(np.insert(ids, edges[1:], end_id))
            sizes.append(np.diff(edges) + 1)
            names.append(piece.column(piece.schema.get_field_index(id)))
            if sum(map(len, held)) >= shard_ids:
                yield shard()
        if held:
            yield shard()

    # ranges of (id, tie): a third of all rows under one id still fall into many ranges
    rows = df.select(id, text, F.xxhash64(text).alias(tie))
    ordered = rows.repartitionByRange(partitions(df.sparkSession), id, tie).sortWithinPartitions(id, tie)
    ordered.select(id, text).mapInArrow(run, schema).write.parquet(path)


def read_ids(spark: SparkSession, path: str, id: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of every document in the files: ``ids`` are little-endian unsigned 32-bit integers, ``start`` counts
    the ids of all documents before it. Shard totals are summed per task first, so what is put in one order is a row per task."""
    ship(spark)
    shards = spark.read.parquet(path)
    totals = shards.select("part", "number", "n_ids")
    before_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", F.coalesce(F.sum("n_ids").over(before_part), F.lit(0)).alias("part_start"))
    starts = totals.join(parts, "part").select("part", "number", (F.col("part_start") + F.coalesce(F.sum("n_ids").over(before), F.lit(0))).alias("shard_start"))
    schema = StructType([StructField(id, shards.schema["ids"].dataType.elementType), StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("ids", BinaryType())])
    step = 1 << 18  # ids decoded at a time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                grammar = Grammar.from_bytes(batch.column(1)[k].as_py())
                names, start = batch.column(0)[k].values, batch.column(2)[k].as_py()
                docs, symbol_ends, id_ends = len(names), np.cumsum(grammar.doc_symbols), np.cumsum(grammar.doc_ids)
                at = 0
                while at < docs:
                    done = int(id_ends[at - 1]) if at else 0
                    to = max(at + 1, int(np.searchsorted(id_ends, done + step, side="right")))
                    ids = grammar.expand(grammar.symbols[(symbol_ends[at - 1] if at else 0) : symbol_ends[to - 1]]).astype("<u4").tobytes()
                    ends = np.append(0, id_ends[at:to] - done)
                    values = pa.BinaryArray.from_buffers(pa.binary(), to - at, [None, pa.py_buffer((4 * ends).astype(np.int32).tobytes()), pa.py_buffer(ids)])
                    yield pa.RecordBatch.from_arrays([names[at:to], pa.array(start + done + ends[:-1], pa.int64()), pa.array(grammar.doc_ids[at:to], pa.int64()), values], schema.names)
                    at = to

    placed = shards.join(starts, ["part", "number"])
    return placed.select("ids", "blob", "shard_start").mapInArrow(run, schema)


def read_range(spark: SparkSession, path: str, id_value: object, start: int, stop: int) -> list[np.ndarray]:
    """Ids ``start:stop`` of the documents named ``id_value``: only the shards that hold it are read, and only rules on the way opened."""
    found = spark.read.parquet(path).where(F.array_contains("ids", F.lit(id_value))).select("part", "number", "ids", "blob").orderBy("part", "number")
    out = []
    for row in found.toLocalIterator():
        grammar = Grammar.from_bytes(bytes(row.blob))
        out += [grammar.document(k, start, stop) for k, name in enumerate(row.ids) if name == id_value]
    return out
