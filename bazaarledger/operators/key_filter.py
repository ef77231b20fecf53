"""Bloom filters of join keys: drop the rows that can't match before they are shuffled.

The filter is a table of blocks of 512 bits, built by one aggregation of the keys; its size is fixed by a parameter and
not by the number of keys, so it may be broadcast. A key sets four bits of one block. No key that is in the filter is ever
refused; the more keys, the more others pass.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: 4 MiB, sparse up to about three million keys.
BITS = 1 << 25
_WORDS, _BLOCK_BITS, _PROBES = 8, 512, 4


def _block(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits // _BLOCK_BITS))


def _places(key: Column) -> list[tuple[Column, Column]]:
    """(word, mask) of each bit a key sets in its block."""
    h = F.xxhash64(F.lit(1), key)
    places = [F.shiftrightunsigned(h, 9 * probe).bitwiseAND(F.lit(_BLOCK_BITS - 1)).cast("int") for probe in range(_PROBES)]
    return [(F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)))) for place in places]


class KeyFilter:
    """Filter of the keys in one column (any type that prints as text; NULLs are never in it)."""

    def __init__(self, keys: DataFrame, key: str, bits: int = BITS):
        self.bits = bits
        text = F.col(key).cast("string")

        def word(number: int) -> Column:
            parts = [F.when(at == number, mask).otherwise(F.lit(0).cast("bigint")) for at, mask in _places(text)]
            return F.bit_or(reduce(lambda a, b: a.bitwiseOR(b), parts))

        wanted = keys.where(F.col(key).isNotNull()).groupBy(_block(text, bits).alias("__block"))
        blocks = wanted.agg(*[word(number).alias(f"w{number}") for number in range(_WORDS)])
        self.blocks = blocks.select("__block", F.array(*[f"w{number}" for number in range(_WORDS)]).alias("__words"))

    def mark(self, df: DataFrame, on: Column, name: str) -> DataFrame:
        """df with a boolean column: false only if the key is certainly not among the filter's."""
        key = f"__filtered_{name}"
        df = df.withColumn(key, on.cast("string"))
        blocks = self.blocks.select(F.col("__block").alias(f"__block_{name}"), F.col("__words").alias(f"__words_{name}"))
        # at most bits / 512 rows, whatever the input: the one size that is proven, so the one broadcast that is asked for
        joined = df.join(F.broadcast(blocks), _block(F.col(key), self.bits) == F.col(f"__block_{name}"), "left")
        words = F.col(f"__words_{name}")
        hits = [F.get(words, at).bitwiseAND(mask) != 0 for at, mask in _places(F.col(key))]
        found = F.coalesce(F.col(key).isNotNull() & reduce(and_, hits), F.lit(False))
        return joined.withColumn(name, found).drop(key, f"__block_{name}", f"__words_{name}")

    def keep(self, df: DataFrame, on: Column) -> DataFrame:
        """The rows of df whose key may be among the filter's."""
        return self.mark(df, on, "__may").where("__may").drop("__may")
