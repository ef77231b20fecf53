"""Periodic runs of words: string synchronising sets propose periods at dyadic scales, factor names extend them exactly.

A run is a longest stretch of consecutive words with smallest period q that holds at least three periods and ``LEAST`` words. Each task
searches its texts one group at a time:

1. A text with a run of ``LEAST`` words repeats a factor of two thirds of that. Texts without such a factor are done.
2. Factors of 1, 2, 4, ... words get names, equal for equal factors of one text (a name is that of the pair of its halves). Factors
   that occur once in their text get none, and neither does anything that holds them.
3. At scale t (1, 2, 4, ...) a place belongs to the synchronising set if, among the t + 1 factors of t words that start from it on, one of
   the two outermost has the smallest random value. Equal contexts of 2 t words so agree on being chosen. Factors with a period of at
   most t / 3 have no value: they lie in runs of earlier scales, which mark them.
4. Places of the set with equal contexts, 2 t to 4 t apart, propose their distance as a period; runs of single repeated words are found
   directly. Each run with a period in that range holds such a pair: were there none, all its factors would have a period of at most
   t / 3, and so would the run.
5. A proposed period is extended to both sides by comparing names from the longest factors down, which is exact.

A run whose smallest period is less than the proposed one has been found at an earlier scale with the same ends, and stays as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from bazaarledger.llm import words as W
from bazaarledger.llm.frames import ship

LEAST = 24
#: Least number of periods in a run.
PERIODS = 3

_VALUES = np.random.default_rng(31).integers(1, 2**63, 64, dtype=np.uint64)

Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # text, start, length, period


def _named(key: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Names by place: equal keys get equal names from 0 on, keys that occur once and places without a key get -1."""
    out = np.full(size, -1, dtype=np.int32)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    again = ~new
    again[:-1] |= ~new[1:]
    name = np.cumsum(new & again) - 1
    out[at[order[again]]] = name[again]
    return out


class _Names:
    """Names of the factors of 1, 2, 4, ... words of texts laid end to end. ``level[k][i]`` is that of the 2**k words from i on."""

    def __init__(self, words: np.ndarray, text: np.ndarray):
        """``words`` are numbers that tell words apart; ``text`` the number of the text each belongs to, in order."""
        self.n, self.text = len(words), text
        key = words.astype(np.int64) + text.astype(np.int64) * (int(words.max(initial=0)) + 1)
        self.level = [_named(key, np.arange(self.n), self.n)]
        while (self.level[-1] >= 0).any():
            half, step = self.level[-1], 1 << (len(self.level) - 1)
            at = np.flatnonzero(half[: max(0, self.n - step)] >= 0)
            at = at[half[at + step] >= 0]
            at = at[text[at] == text[at + step]]
            self.level.append(_named(half[at].astype(np.int64) << 32 | half[at + step], at, self.n))

    def _matches(self, a: np.ndarray, b: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Whether named factors start at a and b and are equal; places outside hold none. A factor of two places has a name."""
        inside = (a >= 0) & (b >= 0) & (a < self.n) & (b < self.n)
        x, y = level[np.where(inside, a, 0)], level[np.where(inside, b, 0)]
        return inside & (x >= 0) & (x == y)

    def extend(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(left, right): how many words before, and how many from, a and b on are equal (a and b of one text, a < b)."""
        left, right = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
        for k in reversed(range(len(self.level))):
            step = 1 << k
            # twice: below the highest level once would do, at the highest a stretch may hold many of its factors
            moved = np.ones(len(a), dtype=bool)
            while moved.any():
                moved &= self._matches(a + right, b + right, self.level[k])
                right[moved] += step
            moved[:] = True
            while moved.any():
                moved &= self._matches(a - left - step, b - left - step, self.level[k])
                left[moved] += step
        return left, right


def _least_ahead(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` values from each place on (fewer at the end)."""
    out, done = values.copy(), 1
    while done < width:
        step = min(done, width - done)
        out[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def cubic_runs(words: np.ndarray, text: np.ndarray) -> Runs:
    """All longest stretches of at least three periods in the texts, whatever their length; by text, start and period."""
    names, n = _Names(words, text), len(words)
    most = np.uint64(2**64 - 1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # start, end, period

    def keep(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        """Adds what has three periods and is not there yet; of equal stretches the smaller period stays."""
        long = end - start >= PERIODS * period
        start, end, period = start[long], end[long], period[long]
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        new = np.ones(len(start), dtype=bool)
        new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        place = start * (n + 1) + end
        if found:
            new &= ~np.isin(place, np.concatenate([s * (n + 1) + e for s, e, _ in found]))
        found.append((start[new], end[new], period[new]))

    same = np.zeros(n + 1, dtype=bool)
    same[1:n] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    edge = np.diff(np.concatenate([same[1:], [False]]).astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
    keep(starts, ends, np.ones(len(starts), dtype=np.int64))

    k = 0
    while k + 1 < len(names.level):
        t, factor, context = 1 << k, names.level[k], names.level[k + 1]
        at = np.flatnonzero(context >= 0)
        if not len(at):
            break
        value = np.where(factor >= 0, W.mix(factor.astype(np.uint64) + _VALUES[k % 64]) >> np.uint64(1), most)
        for start, end, period in found:
            # factors within a run of a period of at most t / 3 have no value
            inside = (3 * period <= t) & (end - start >= t)
            step = np.zeros(n + 1, dtype=np.int32)
            np.add.at(step, start[inside], 1)
            np.add.at(step, end[inside] - t + 1, -1)
            value[np.cumsum(step)[:n] > 0] = most
        least = _least_ahead(value, t + 1)[at]
        chosen = at[(least < most) & ((value[at] == least) | (value[at + t] == least))]
        chosen = chosen[np.lexsort((chosen, context[chosen]))]
        name = context[chosen]
        ahead, pairs = 1, []
        while ahead < len(chosen):
            near = (name[ahead:] == name[:-ahead]) & (chosen[ahead:] - chosen[:-ahead] < 4 * t)
            if not near.any():
                break
            a, apart = chosen[:-ahead][near], (chosen[ahead:] - chosen[:-ahead])[near]
            far = apart >= 2 * t
            pairs.append((a[far], apart[far]))
            ahead += 1
        if pairs:
            a, period = np.concatenate([x for x, _ in pairs]), np.concatenate([x for _, x in pairs])
            left, right = names.extend(a, a + period)
            keep(a - left, a + period + right, period)
        k += 1
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    return text[start], start, end - start, period


def _numbers(found: W.Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, number): the words of these rows, and numbers that tell them apart, from two 64-bit hashes of each."""
    which = np.flatnonzero(rows[found.row])
    a, b = found.hashes()[which], found.hashes(2)[which]
    order = np.lexsort((b, a))
    new = np.zeros(len(order), dtype=np.int64)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new)
    return which, number


def find_runs(found: W.Words, least: int = LEAST) -> Runs:
    """The runs of all rows: row, start (word number in the row), length, period; by row, start and period."""
    width = max(1, least - least // PERIODS)  # a run of this length or more repeats a factor of so many words
    starts = found.window_starts(width)
    row = found.row[starts]
    key = W.mix(W.window_hashes(found.hashes(), starts, width) + row.astype(np.uint64))
    key.sort()
    repeated = key[1:][key[1:] == key[:-1]]
    rows = np.zeros(found.rows, dtype=bool)
    if len(repeated):
        again = W.mix(W.window_hashes(found.hashes(), starts, width) + row.astype(np.uint64))
        rows[row[np.isin(again, repeated)]] = True
    none = np.zeros(0, dtype=np.int64)
    if not rows.any():
        return none, none, none, none
    which, number = _numbers(found, rows)
    text, start, length, period = cubic_runs(number, found.row[which])
    long = length >= least
    text, start, length, period = text[long], start[long], length[long], period[long]
    return text, which[start] - found.first[text], length, period


def periodic_runs(df: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """df with ``n_words``, ``runs`` (array of start, length, period, by start and then period) and ``collapsed``.

    Words are stretches without ASCII white space, numbered from 0. A run is a stretch with smallest period q of at least ``least`` words
    and three periods that no neighbouring word extends. ``collapsed`` are the words joined by one space, without those that lie in a
    run after its first q words. NULL and empty texts have no words, no runs and an empty ``collapsed``. Rows are judged each on its
    own, whole, however long; NULL and repeated ids, ties and repeated rows change nothing. Extra columns pass through; input
    columns named like a new one are replaced. An empty table gives an empty table. Nothing is shuffled.
    """
    ship(df.sparkSession)
    df = df.drop("n_words", "runs", "collapsed")
    run_type = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
    added = [StructField("n_words", LongType()), StructField("runs", ArrayType(run_type)), StructField("collapsed", StringType())]
    schema = StructType([*df.schema.fields, *added])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches, text):
            found = W.Words(piece.column(piece.schema.get_field_index(text)))
            row, start, length, period = find_runs(found, least)
            ends = np.searchsorted(row, np.arange(found.rows + 1))
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"]))
            step = np.zeros(len(found) + 1, dtype=np.int32)
            first = found.first[row] + start
            np.add.at(step, first + period, 1)
            np.add.at(step, first + length, -1)
            stays = np.cumsum(step)[:-1] == 0
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(np.diff(found.first), pa.int64()), runs, joined(found, np.flatnonzero(stays))], schema.names)

    return df.mapInArrow(search, schema)


def joined(found: W.Words, words: np.ndarray) -> pa.Array:
    """The words of these indexes, row after row, joined by one space: one text per row."""
    start, end, row = found.start[words], found.end[words], found.row[words]
    follows = np.zeros(len(row), dtype=np.int64)
    follows[1:] = row[1:] == row[:-1]
    size = end - start + follows
    ends = np.cumsum(size)
    source = np.repeat(start - follows - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    data = found.data[np.maximum(source, 0)] if len(source) else np.zeros(0, dtype=np.uint8)
    data[(ends - size)[follows == 1]] = 0x20
    edges = np.concatenate([[0], ends])[np.searchsorted(row, np.arange(found.rows + 1))]
    return pa.Array.from_buffers(pa.large_string(), found.rows, [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.string())
