"""Token ids of texts by way of their chunks: a chunk that was met before is not tokenized again.

Chunks are the parts of a text that a tokenizer treats on their own (white-space separated words, say). Ids of known chunks are
kept in one flat array; the ids of a text are gathered by numpy.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Hashable
from itertools import chain, repeat

import numpy as np


class Chunks:
    """``encode`` gives (all ids in a row, number of ids of each) for a list of new chunks.

    Forgets all once it knows ``most`` chunks: memory stays bounded, whatever the texts.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], most: int = 1_000_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.code: dict[Hashable, int] = {}
        self.ids, self.edges, self.used = np.empty(1 << 16, dtype=np.int32), np.zeros(1 << 14, dtype=np.int64), 0

    def _learn(self, new: list) -> None:
        flat, lengths = self.encode(new)
        total, n = len(flat), len(self.code)
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(2 * (self.used + total), dtype=np.int32)])
        if n + len(new) + 1 > len(self.edges):
            self.edges = np.concatenate([self.edges[: n + 1], np.zeros(2 * (n + len(new)), dtype=np.int64)])
        self.ids[self.used : self.used + total] = flat
        self.edges[n + 1 : n + 1 + len(new)] = self.used + np.cumsum(lengths)
        self.code.update(zip(new, range(n, n + len(new)), strict=True))
        self.used += total

    def _codes(self, chunks: list) -> np.ndarray:
        if len(self.code) > self.most:
            self._clear()
        codes = np.fromiter(map(self.code.get, chunks, repeat(-1)), np.int64, len(chunks))
        strange = np.flatnonzero(codes < 0)
        if len(strange):
            missed = [chunks[k] for k in strange]
            self._learn(list(dict.fromkeys(missed)))
            codes[strange] = np.fromiter(map(self.code.__getitem__, missed), np.int64, len(missed))
        return codes

    def counts(self, rows: list[list]) -> np.ndarray:
        """Number of ids per row of chunks."""
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        codes = self._codes(list(chain.from_iterable(rows)))
        sums = np.concatenate([[0], np.cumsum(self.edges[codes + 1] - self.edges[codes])])
        ends = np.cumsum(lengths)
        return sums[ends] - sums[ends - lengths]

    def gather(self, rows: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, edges): the ids of all rows in a row, and where each row's begin and end."""
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        codes = self._codes(list(chain.from_iterable(rows)))
        begin = self.edges[codes]
        sizes = self.edges[codes + 1] - begin
        sums = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(begin - sums[:-1], sizes) + np.arange(sums[-1])]
        return ids, sums[np.concatenate([[0], np.cumsum(lengths)])]


#: Tokenizers of this process with what they have learned, by path and separator: a worker keeps them from task to task.
_KEPT: dict[tuple[str, str], Chunks] = {}


def word_tokenizer(path: str, separator: str, batch: int = 1000) -> Chunks:
    """Ids by the ``tokenizers`` library, for tokenizers that cut at white space and drop it: chunks are ``bytes.split()`` words.

    A new word of printable ASCII and common Latin letters is cut further by the tokenizer's own splitting pattern, where it has one, so that "word," and
    "(Word" need no tokenizing once "word" is known. What is new then is tokenized many at a time with ``separator`` in between, a
    special token that the tokenizer cuts out before anything else. Pieces that hold part of a special token go one by one.
    """
    if (path, separator) not in _KEPT:
        _KEPT.clear()  # one at a time: memory stays bounded
        _KEPT[path, separator] = _word_tokenizer(path, separator, batch)
    return _KEPT[path, separator]


def forget() -> None:
    """Free the tokenizers kept and what they have learned, for tasks of other work that come to the same worker."""
    _KEPT.clear()


#: Characters that NFC leaves alone and that are letters, digits or marks in every Unicode version.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")


def _splitter(description: dict) -> Callable[[str], list[str]] | None:
    """How the tokenizer cuts a lower-case word of ``_PLAIN`` characters, if its description tells that by one pattern of what to keep."""
    def parts(step: dict | None, name: str) -> list[dict]:
        return [] if step is None else step[name] if step["type"] == "Sequence" else [step]

    lowers = parts(description["normalizer"], "normalizers")
    if {n["type"] for n in lowers} - {"NFC", "Replace", "Lowercase"} or not any(n["type"] == "Lowercase" for n in lowers):
        return None
    if any(n["type"] == "Replace" and n["pattern"] != {"Regex": "\\s+"} for n in lowers):
        return None
    cuts = parts(description["pre_tokenizer"], "pretokenizers")
    if not cuts or cuts[0]["type"] != "Split" or cuts[0]["behavior"] != "Removed" or not cuts[0]["invert"] or "Regex" not in cuts[0]["pattern"]:
        return None
    if any(c["type"] != "ByteLevel" or c["use_regex"] or c["add_prefix_space"] for c in cuts[1:]):
        return None
    pattern = cuts[0]["pattern"]["Regex"].replace("\\p{L}", "a-zß-öø-ÿ").replace("\\p{N}", "0-9")
    return None if "\\p" in pattern or "(" in pattern else re.compile(pattern).findall


def _word_tokenizer(path: str, separator: str, batch: int) -> Chunks:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    mark = tokenizer.token_to_id(separator)
    doubt = separator[:2]
    description = json.loads(tokenizer.to_str())
    cut, plain_word = _splitter(description), _PLAIN.fullmatch

    def joined_ids(on: Tokenizer, pieces: list[str], between: str, after: str, many: int) -> np.ndarray:
        texts = [between.join(pieces[at : at + many]) + after for at in range(0, len(pieces), many)]
        return np.fromiter(chain.from_iterable(e.ids for e in on.encode_batch_fast(texts, add_special_tokens=False)), np.int32)

    def marked(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = joined_ids(tokenizer, pieces, separator, separator, batch)
        return ids[ids != mark], np.diff(np.flatnonzero(ids == mark), prepend=-1) - 1

    def one_by_one(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64)

    # pieces that are normalised and cut already: the same model, cut at blanks, ends told by the suffix of a piece's last token
    suffix = description["model"].get("end_of_word_suffix")
    if cut and suffix:
        bare, vocabulary = Tokenizer.from_file(path), tokenizer.get_vocab()
        bare.normalizer = None
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        ends[[number for token, number in vocabulary.items() if token.endswith(suffix)]] = True

    def ready(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = joined_ids(bare, pieces, " ", "", 100)
        return ids, np.diff(np.flatnonzero(ends[ids]), prepend=-1)

    def encode(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        kind = [2 if doubt in c else 0 if cut and suffix and plain_word(c) else 1 for c in new]
        if not any(kind):
            return ready(new)
        found: list = [None] * len(new)
        for number, way in enumerate((ready, marked, one_by_one)):
            some = [k for k, x in enumerate(kind) if x == number]
            if some:
                ids, lengths = way([new[k] for k in some])
                for k, x in zip(some, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
                    found[k] = x
        return np.concatenate(found), np.fromiter(map(len, found), np.int64)

    parts = Chunks(encode)

    def learn(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = [c.decode() for c in new]
        ids, edges = parts.gather([cut(w.lower()) if cut and plain_word(w) and doubt not in w else [w] for w in words])
        return ids, np.diff(edges)

    return Chunks(learn)


def words_of(texts: list[str | None]) -> list[list[bytes]]:
    return [t.encode().split() if t else [] for t in texts]
