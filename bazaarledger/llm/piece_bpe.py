"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The text is cut where no piece can reach across: before each run of spaces (written ``\\u2581``), and around line feeds if no piece of
the vocabulary holds one. Each distinct part is encoded once per task. Encoding works on all new parts at once, on flat numpy
arrays of symbols: every round looks up the ranks of all neighbouring pairs, takes the segmented minimum per part, merges the
leftmost non-overlapping pairs of that rank in all parts at the same time, and compacts the arrays, until no pair is left.

Merging several pairs of a part in one round equals merging one at a time unless a merge opens a pair of the same or a better
rank. Parts where that happens are encoded again with one merge per round, which is the sequential order itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from bazaarledger.llm import words as W
from bazaarledger.llm.chunks import Chunks
from bazaarledger.llm.frames import ship

SPACE = "▁"
_NO_RANK = np.int64(2**40)
_RUNS = re.compile(" +[^ ]*")


class PieceModel:
    """Tables of a BPE model with byte fallback, read once per task."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(pieces) if model.is_byte(i)}
        normal = {p: i for i, p in enumerate(pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.unknown = model.unk_id()
        self.single = -1 - np.arange(0x110000, dtype=np.int64)  # characters outside the vocabulary: below 0, by code point
        for p, i in normal.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        self.size = n
        ranks = np.unique([-model.get_score(i) for i in normal.values()], return_inverse=True)[1]
        rank = dict(zip(normal.values(), ranks.tolist(), strict=True))
        keys, values = [], []
        for p, i in normal.items():
            for cut in range(1, len(p)):
                left, right = normal.get(p[:cut]), normal.get(p[cut:])
                if left is not None and right is not None:
                    keys.append(left * n + right)
                    values.append((rank[i], i))
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair = np.append(np.array(keys, dtype=np.int64)[order], np.int64(2**62))
        self.rank = np.append(np.array([v[0] for v in values], dtype=np.int64)[order], _NO_RANK)
        self.merged = np.append(np.array([v[1] for v in values], dtype=np.int64)[order], 0)
        self.cuts_at_line_feed = "\n" not in normal and not any("\n" in p for p in normal)
        # decoding: bytes of each id; ids of raw bytes are marked, since only they can break UTF-8
        self.text = [b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]

    # --- encoding -------------------------------------------------------------------------------------------------------

    def parts(self, text: str | None) -> list[str]:
        """The text cut before each run of spaces and, where the model allows, before line feeds.

        A part stands for itself if it begins with a space or a line feed; to any other a single space is to be put in front.
        """
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if "  " in text or text[0] in " \n" or text[-1] == " ":
            return [x if x[1:2] in ("\n", " ") else x[1:] for x in _RUNS.findall(" " + text)]
        return (text.replace("\n", " \n") if self.cuts_at_line_feed else text).split(" ")

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts in a row, number of ids of each)."""
        literal = [p if p[:1] == " " or (p[:1] == "\n" and self.cuts_at_line_feed) else " " + p for p in parts]
        if not self.cuts_at_line_feed:
            return self._encode(literal)
        segments = "\n".join(literal).split("\n")
        feeds = np.fromiter((p.count("\n") for p in literal), np.int64, len(literal))
        ids, counts = self._encode(segments)
        # every segment but the last of its part is followed by a line feed
        inner = np.ones(len(segments), dtype=np.int64)
        last = np.cumsum(feeds + 1) - 1
        inner[last] = 0
        out = np.insert(ids, np.repeat(np.cumsum(counts), inner), self.byte_id.get(10, self.unknown))
        sums = np.concatenate([[0], np.cumsum(counts + inner)])
        return out, np.diff(sums[np.concatenate([[0], last + 1])])

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        whole = "".join(parts).replace(" ", SPACE)
        symbols = self.single[np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)]
        owner = np.repeat(np.arange(len(parts)), lengths)
        out_symbols, out_owner, doubtful = self._merge(symbols, owner, len(parts), several=True)
        if doubtful.any():
            keep, again = ~doubtful[out_owner], doubtful[owner]
            redone = self._merge(symbols[again], owner[again], len(parts), several=False)
            out_symbols, out_owner = np.concatenate([out_symbols[keep], redone[0]]), np.concatenate([out_owner[keep], redone[1]])
            order = np.argsort(out_owner, kind="stable")
            out_symbols, out_owner = out_symbols[order], out_owner[order]
        # single characters outside the vocabulary become their bytes
        size = np.ones(len(out_symbols), dtype=np.int64)
        strange = np.flatnonzero(out_symbols < 0)
        spelled = [[self.byte_id.get(b, self.unknown) for b in chr(-1 - out_symbols[k]).encode()] for k in strange]
        size[strange] = [len(x) for x in spelled]
        ids = np.repeat(out_symbols, size)
        begin = np.cumsum(size) - size
        for k, x in zip(strange, spelled, strict=True):
            ids[begin[k] : begin[k] + len(x)] = x
        counts = np.bincount(out_owner, size, len(parts)).astype(np.int64)
        return ids.astype(np.int32), counts

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of pairs of symbols; symbols below 0 merge with nothing."""
        key = left * self.size + right
        at = np.searchsorted(self.pair, key)
        good = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(good, self.rank[at], _NO_RANK), self.merged[at]

    def _merge(self, symbols: np.ndarray, owner: np.ndarray, n: int, several: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge rounds. Parts without a pair left move to the results at once, so later rounds hold only what still changes."""
        symbols, doubtful = symbols.copy(), np.zeros(n, dtype=bool)
        done_symbols, done_owner = [], []
        worst = np.full(n, -1, dtype=np.int64)  # the rank merged last, where more than one pair was merged at once
        rank, new = np.full(len(symbols), _NO_RANK), np.zeros(len(symbols), dtype=np.int64)
        if len(symbols) > 1:
            same = owner[1:] == owner[:-1]
            r, m = self._look_up(symbols[:-1], symbols[1:])
            rank[:-1], new[:-1] = np.where(same, r, _NO_RANK), m
        while len(symbols):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.append(first, len(symbols)))
            live = np.repeat(best < _NO_RANK, lengths)
            if not live.all():
                done_symbols.append(symbols[~live])
                done_owner.append(owner[~live])
                symbols, owner, rank, new = symbols[live], owner[live], rank[live], new[live]
                lengths, best = lengths[best < _NO_RANK], best[best < _NO_RANK]
                if not len(symbols):
                    break
            hit = rank == np.repeat(best, lengths)
            if several:
                at = np.flatnonzero(hit)
                run = np.cumsum(np.diff(at, prepend=-2) > 1) - 1
                at = at[(at - at[np.flatnonzero(np.diff(run, prepend=-1))][run]) % 2 == 0]
            else:
                at = np.flatnonzero(hit)
                at = at[np.diff(owner[at], prepend=-1) > 0]
            merged_rank = rank[at]
            symbols[at] = new[at]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            symbols, owner, rank, new = symbols[keep], owner[keep], rank[keep], new[keep]
            at = place[at]
            near = np.zeros(len(symbols), dtype=bool)
            near[at] = True
            near[at[at > 0] - 1] = True
            touched = np.flatnonzero(near)
            inner = touched[touched + 1 < len(symbols)]
            rank[touched] = _NO_RANK
            inner = inner[owner[inner] == owner[inner + 1]]
            rank[inner], new[inner] = self._look_up(symbols[inner], symbols[inner + 1])
            if several:
                worst[:] = -1
                repeated = np.flatnonzero(np.diff(owner[at]) == 0)
                worst[owner[at[repeated]]] = merged_rank[repeated]
                doubtful[owner[inner[rank[inner] <= worst[owner[inner]]]]] = True
        symbols, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_symbols, done_owner))
        order = np.argsort(owner, kind="stable")
        return symbols[order], owner[order], doubtful

    # --- decoding -------------------------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[str]:
        """Texts of runs of ids; the space in front goes, bytes that are no UTF-8 become U+FFFD."""
        table, out = self.text, []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            raw = b"".join(map(table.__getitem__, ids[a:b].tolist()))
            out.append(raw[1:].decode("utf-8", "replace") if raw[:1] == b" " and b > a and table[ids[a]][:1] == b" " else raw.decode("utf-8", "replace"))
        return out


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a column ``ids`` (array<int>): the ids of the whole text, without begin or end ids, no sampling.

    NULL and empty texts have no ids. A column of that name is replaced; other columns pass through. ``model`` is a path that
    every executor can open. An empty table gives an empty table.
    """
    ship(df.sparkSession)
    df = df.drop(ids)
    names = df.columns
    schema = StructType([*df.schema.fields, StructField(ids, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = PieceModel(model)
        chunks = Chunks(tables.encode_parts)
        for piece in W.pieces(batches, text, 1 << 19):
            found, edges = chunks.gather([tables.parts(t) for t in piece.column(piece.schema.get_field_index(text)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(found, pa.int32()))], [*names, ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with a column ``text``: what the ids spell. NULL ids spell the empty text. Other columns pass through."""
    ship(df.sparkSession)
    df = df.drop(text)
    names = df.columns
    schema = StructType([*df.schema.fields, StructField(text, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = PieceModel(model)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            lengths = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.cumsum(lengths)])
            texts = tables.decode(lists.flatten().to_numpy(zero_copy_only=False), edges)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, text])

    return df.mapInArrow(run, schema)
