"""Words of many texts at once: flat numpy arrays over an Arrow string column.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. All separators are ASCII, so the bytes of UTF-8 text can be cut
without decoding. A word of up to ``LONG`` bytes is hashed eight bytes at a time, a bijection of 64 bits after each; a longer one by
BLAKE2, so no family of words collides by its structure. Windows are polynomials modulo 2**64 over these word hashes, which act as
random values, finished by a mixing step. Two hashes of a window start from two hashes of each word. All constants come from a
seeded generator, so every task on every machine agrees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_RANDOM = np.random.default_rng(20240229)
#: Words of more bytes go through a cryptographic digest.
LONG = 64
_ROUND = _RANDOM.integers(1, 2**63, (4, LONG // 8 + 1), dtype=np.uint64)
_BASES = tuple(int(x) * 2 + 1 for x in _RANDOM.integers(2**40, 2**62, 4))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over a 64-bit value (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base ``which`` and of its inverse modulo 2**64, at least n of each."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        base, out = _BASES[which], []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b & (2**64 - 1), dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[which] = (out[0], out[1])
    return have


def _sums(values: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums of values times powers, with a leading 0."""
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values * _powers(which, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


class Words:
    """All words of a string array. Per word: ``row``, byte range ``start:end`` in ``data``; ``first`` holds each row's first word."""

    def __init__(self, texts: pa.Array):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
        offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        body = texts.buffers()[2]
        data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
        self.data, self.offsets, self.rows = data[offsets[0] : offsets[-1]], offsets - offsets[0], len(texts)
        inside = np.zeros(len(self.data) + 1, dtype=bool)
        inside[:-1] = ~SEPARATOR[self.data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        cuts = self.offsets[:-1]  # a row's first byte starts a word even if the row before ends in one
        opens[cuts] |= inside[cuts]
        self.start = np.flatnonzero(opens[:-1])
        closes = inside[:-1] & (~inside[1:] | opens[1:])
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.row = np.repeat(np.arange(self.rows), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, which: int = 1) -> np.ndarray:
        """One 64-bit value per word; ``which`` (1 to 3) selects an independent function."""
        length = self.end - self.start
        out = mix(length.astype(np.uint64) + _ROUND[which, -1])
        padded = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
        at = np.flatnonzero(length <= LONG)
        for k in range(LONG // 8):
            at = at[length[at] > 8 * k]
            if not len(at):
                break
            chunk = eights[self.start[at] + 8 * k].view("<u8").reshape(-1)
            spare = np.maximum(8 * (k + 1) - length[at], 0).astype(np.uint64) * np.uint64(8)
            chunk = (chunk << spare) >> spare
            out[at] = mix((out[at] ^ mix(chunk + _ROUND[which, k])) + np.uint64(which))
        for k in np.flatnonzero(length > LONG):
            raw = self.data[self.start[k] : self.end[k]].tobytes()
            out[k] = np.frombuffer(hashlib.blake2b(raw, digest_size=8, salt=bytes([which])).digest(), dtype="<u8")[0]
        return out

    def window_starts(self, width: int) -> np.ndarray:
        """Indexes of the words that start a window of ``width`` words within their row."""
        n = max(0, len(self) - width + 1)
        return np.flatnonzero(self.row[:n] == self.row[width - 1 : width - 1 + n])


def window_hashes(hashes: np.ndarray, starts: np.ndarray, width: int, which: int = 1) -> np.ndarray:
    """One 64-bit value per window of ``width`` consecutive word hashes; ``which`` (1 to 3) selects the polynomial's base."""
    sums = _sums(hashes, which)
    return mix((sums[starts + width] - sums[starts]) * _powers(which, len(hashes) + 1)[1][starts])


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``most_bytes`` of text, or one row: temporary arrays stay small."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to
