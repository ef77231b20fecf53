"""Cost-balanced packing of tokenized documents into training sequences.

Every task tokenizes its rows and packs them block by block; nothing is shuffled, and each id lies in exactly one piece. In a block
of ``BLOCK`` sequences, documents longer than a sequence are cut into full sequences first. The rest goes by descending length:
each to the sequence of the lowest estimated cost (linear plus quadratic attention cost) that still has room for it; one
that fits nowhere is cut to fill the cheapest sequence with room. So all sequences of a block are full, and what is left over
(less than a sequence) goes on to the next block. The remainder of a task's last block becomes sequences whose lengths are powers
of two, which need no padding.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from bazaarledger.llm import words as W
from bazaarledger.llm.chunks import word_tokenizer, words_of
from bazaarledger.llm.frames import binary_list, ship

CAPACITY = 4096
BLOCK = 256
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n. Attention stays within a piece.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048

Piece = tuple[int, int, int]  # document, start, length


def assign(pieces: list[Piece], capacity: int = CAPACITY, last: bool = False) -> tuple[list[list[Piece]], list[Piece]]:
    """(full sequences, left over). With ``last`` nothing is left over: the remainder forms sequences of power-of-two lengths."""
    total = sum(p[2] for p in pieces)
    room = np.full(total // capacity, capacity, dtype=np.int64)
    if last:
        rest = total % capacity
        room = np.append(room, [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]).astype(np.int64)
    cost = np.zeros(len(room))
    cost[room < capacity] = LINEAR * (capacity - room[room < capacity])  # as if that part were taken
    out: list[list[Piece]] = [[] for _ in room]
    queue = []
    for doc, start, length in pieces:
        while length > capacity:
            queue.append((-capacity, doc, start))
            start, length = start + capacity, length - capacity
        queue.append((-length, doc, start))
    heapq.heapify(queue)
    left: list[Piece] = []
    while queue:
        length, doc, start = heapq.heappop(queue)
        length = -length
        fits = np.flatnonzero(room >= length)
        if not len(fits):
            fits = np.flatnonzero(room)
            if not len(fits):
                left.append((doc, start, length))
                continue
        k = fits[np.argmin(cost[fits])]
        take = min(length, int(room[k]))
        out[k].append((doc, start, take))
        room[k] -= take
        cost[k] += LINEAR * take + QUADRATIC * take * take
        if take < length:
            heapq.heappush(queue, (take - length, doc, start + take))
    return out, left


def pack(df: DataFrame, tokenizer: str, separator: str, end_id: int, text: str = "text", id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: (id, start, length, ids, doc_tokens, sequence_id, offset).

    ``ids`` are little-endian unsigned 32-bit token ids; ``start`` counts the document's ids before the piece, ``offset`` the ids
    before it in its sequence, ``doc_tokens`` the document's ids with ``end_id``, which ends every document. NULL and empty
    texts are documents of that one id. NULL and repeated ids are carried as they are; every row is packed. Sequences hold at
    most ``capacity`` ids and are full but for at most log2(capacity) per task, whose lengths are powers of two.
    ``tokenizer`` is a path that every executor can open, ``separator`` one of its special tokens. Extra columns are ignored. An empty table gives an empty table.
    """
    ship(df.sparkSession)
    names = [id, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kind = df.schema[id]
    schema = StructType([kind, *(StructField(n, BinaryType() if n == "ids" else LongType()) for n in names[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = word_tokenizer(tokenizer, separator)
        sequence = TaskContext.get().partitionId() << 36
        docs: list[np.ndarray] = []
        names_of: list = []
        open_pieces: list[Piece] = []
        arrow_id = None

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal docs, names_of, open_pieces, sequence
            done, left = assign(open_pieces, capacity, last)
            rows = []
            for group in done:
                offset = 0
                for doc, start, length in group:
                    rows.append((names_of[doc], start, length, docs[doc][start : start + length].tobytes(), len(docs[doc]), sequence, offset))
                    offset += length
                sequence += 1
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            keep = sorted({p[0] for p in left})
            at = {doc: k for k, doc in enumerate(keep)}
            docs, names_of, open_pieces = [docs[d] for d in keep], [names_of[d] for d in keep], [(at[d], s, n) for d, s, n in left]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow_id), *(binary_list(list(c)) if n == "ids" else pa.array(c, pa.int64()) for n, c in zip(names[1:], columns[1:], strict=True))], names)

        held = 0
        for piece in W.pieces(batches, text):
            arrow_id = piece.schema.field(id).type
            ids, edges = chunks.gather(words_of(piece.column(piece.schema.get_field_index(text)).to_pylist()))
            for k, name in enumerate(piece.column(piece.schema.get_field_index(id)).to_pylist()):
                docs.append(np.append(ids[edges[k] : edges[k + 1]], end_id).astype("<u4"))
                names_of.append(name)
                open_pieces.append((len(docs) - 1, 0, len(docs[-1])))
                held += len(docs[-1])
            if held >= BLOCK * capacity:
                yield flush(last=False)
                held = sum(p[2] for p in open_pieces)
        if open_pieces:
            yield flush(last=True)

    return df.select(id, text).mapInArrow(run, schema)
