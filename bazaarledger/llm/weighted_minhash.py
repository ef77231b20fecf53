"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

1. A count-min sketch counts the documents that hold each word shingle (every document, every shingle); the expected noise of a
   cell is taken off. Its error is a fixed share of the corpus, and so is what the IDF needs, so it serves all sizes alike.
2. Every text gets ``BANDS * ROWS`` samples: the shingle and quantised weight that win a draw in which the chance that two texts
   agree equals their weighted Jaccard similarity. Equal texts are merged here, before anything is compared.
3. Texts that share a band are compared by the exact weighted Jaccard similarity of the whole texts: each member with the lightest,
   the hub. A hub that accepts all members has joined them, and the band is settled, however large. The members of all other bands are
   open. Two similar texts share a shingle among the rarest of each, those that hold a little over 1 - ``SIMILARITY`` of its weight
   (prefix filter), so all links between open texts lie in the groups by such shingles. Groups of the same members count once, and
   their hubs are tried as well. What is left are groups whose members are not all in one class by the links found so far:
   members outside the group's main class are compared with all its members. Pairs of a group of bounded size are compared once each,
   whatever the groups they share, if the weight that both texts have from the group's shingle on allows a link (positional filter);
   larger groups in tiles of blocks of texts of bounded size.
   So no link that joins classes is lost among texts that share a band, and the number of steps is fixed.
4. Verified links are contracted to classes by rounds of hashed minimum labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarledger.llm import chunks
from bazaarledger.llm import words as W
from bazaarledger.llm.frames import binary_list, digest, fresh, partitions, ship, stored

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 3
SKETCH_ROWS = 2
SKETCH_CELLS = 1 << 20
SKETCH_SLICE = 1 << 15
#: Share of a shingle's weight that its IDF decides; the rest is the same for all shingles.
IDF_SHARE = 0.25

#: Texts, and shingles, of one block of a tile; a tile holds two blocks.
BLOCK_TEXTS, BLOCK_SHINGLES = 400, 400_000

#: Texts of a group whose pairs are listed; larger groups go through tiles.
PAIR_TEXTS = 100

#: Links of a task while classes are formed.
EDGES_A_TASK = 200_000

#: Bits of the filter that keeps texts without candidates out of the shuffle.
FILTER_BITS = 1 << 26

_DRAWS = np.random.default_rng(7)
_STEPS = 1 << 14
_RATE = _DRAWS.gamma(2.0, 1.0, _STEPS).astype(np.float32)
_LOG_COST = np.log(_DRAWS.gamma(2.0, 1.0, _STEPS)).astype(np.float32)
_SHIFT = _DRAWS.random(_STEPS).astype(np.float32)
_SEEDS = _DRAWS.integers(1, 2**63, BANDS * ROWS * 4, dtype=np.uint64) | np.uint64(1)


def shingles(found: W.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct shingles of each row, in row order; a row of fewer words is one shingle."""
    h = found.hashes()
    starts = found.window_starts(size)
    value, row = W.window_hashes(h, starts, size), found.row[starts]
    counts = np.diff(found.first)
    for k in np.flatnonzero((counts > 0) & (counts < size)):
        a = np.array([found.first[k]])
        value, row = np.append(value, W.window_hashes(h, a, int(counts[k]), 2)), np.append(row, k)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(value)))


def _cell(value: np.ndarray, row: int, cells: int) -> np.ndarray:
    return ((value if row == 0 else W.mix(value + np.uint64(row))) & np.uint64(cells - 1)).astype(np.int64)


def document_frequencies(texts: DataFrame, column: str, size: int = SHINGLE, cells: int = SKETCH_CELLS) -> DataFrame:
    """Merged count-min sketch as (part, counts, n_docs, n_shingles): part 0 also carries the totals."""
    ship(texts.sparkSession)
    step = min(SKETCH_SLICE, cells)
    per_row = cells // step

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs, total = np.zeros((SKETCH_ROWS, cells), dtype=np.int64), 0, 0
        held: list[np.ndarray] = []
        chunks.forget()  # the memory that a worker keeps from tokenizing is needed here

        def flush() -> None:
            value = np.concatenate(held)
            for row in range(SKETCH_ROWS):
                counts[row] += np.bincount(_cell(value, row, cells), minlength=cells)
            held.clear()

        for piece in W.pieces(batches, column):
            rows, value, _ = shingles(W.Words(piece.column(piece.schema.get_field_index(column))), size)
            docs, total = docs + len(np.unique(rows)), total + len(value)
            held.append(value)
            if sum(map(len, held)) > 2 * cells:
                flush()
        if held:
            flush()
        for row in range(SKETCH_ROWS):
            for k in range(per_row):
                some = counts[row, k * step : (k + 1) * step]
                kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if some.max(initial=0) <= np.iinfo(t).max)
                first = row == 0 and k == 0
                yield pa.RecordBatch.from_arrays([pa.array([row * per_row + k], pa.int32()), binary_list([some.astype(kind).tobytes()]), pa.array([docs * first], pa.int64()), pa.array([total * first], pa.int64())], names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, [np.zeros(0), 0, 0]

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), binary_list([held[0].tobytes()]), pa.array([held[1]], pa.int64()), pa.array([held[2]], pa.int64())], names)

        for batch in batches:
            for part, counts, docs, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    if now is not None:
                        yield done()
                    now, held = part, [np.zeros(step, dtype=np.int64), 0, 0]
                held[0] += np.frombuffer(counts, dtype={1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(counts) // step])
                held[1], held[2] = held[1] + docs, held[2] + total
        if now is not None:
            yield done()

    names = ["part", "counts", "n_docs", "n_shingles"]
    schema = "part int, counts binary, n_docs long, n_shingles long"
    return texts.select(column).mapInArrow(enter, schema).repartition(partitions(texts.sparkSession), "part").sortWithinPartitions("part").mapInArrow(merge, schema)


class Weights:
    """Shingle weights from a merged sketch: term count times a damped, normalised IDF. Size fixed by the sketch, not the corpus."""

    def __init__(self, sketch: DataFrame, cells: int = SKETCH_CELLS, share: float = IDF_SHARE):
        self.cells, counts, docs, total = cells, np.zeros((SKETCH_ROWS, cells), dtype=np.float64), 0, 0
        step = min(SKETCH_SLICE, cells)
        flat = counts.reshape(-1, step)
        for part, raw, n, m in sketch.collect():  # one row per slice, 16 MiB in all
            flat[part] = np.frombuffer(raw, dtype=np.int64)
            docs, total = docs + n, total + m
        docs = max(docs, 1)
        noise, floor = total / cells, max(1.0, total / docs) / cells
        seen = np.maximum(counts - noise, 0) / docs
        self.weight = (1 - share + share * np.clip(np.log(np.minimum(seen, 1) + floor) / np.log(floor), 0, 1)).astype(np.float32)

    def __call__(self, value: np.ndarray) -> np.ndarray:
        return np.maximum.reduce([self.weight[row][_cell(value, row, self.cells)] for row in range(SKETCH_ROWS)])


def samples(row: np.ndarray, value: np.ndarray, weight: np.ndarray, many: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(rows, samples[row, many]): consistent weighted samples of each row's weighted shingles, as 64-bit values."""
    at = np.flatnonzero(np.diff(row, prepend=-1))
    rows, lengths = row[at], np.diff(np.append(at, len(row)))
    out = np.empty((len(rows), many), dtype=np.uint64)
    log_weight, mask = np.log(weight).astype(np.float32), np.uint64(_STEPS - 1)
    place = np.arange(len(row))
    for k in range(many):
        z = value * _SEEDS[k]
        z ^= z >> np.uint64(29)
        z *= _SEEDS[-1 - k]
        rate, shift = _RATE[(z >> np.uint64(50)) & mask], _SHIFT[(z >> np.uint64(36)) & mask]
        level = np.floor(log_weight / rate + shift)
        cost = _LOG_COST[(z >> np.uint64(22)) & mask] - rate * (level - shift + 1)
        best = np.repeat(np.minimum.reduceat(cost, at), lengths)
        won = np.where(cost == best, place, len(row))
        won = np.minimum.reduceat(won, at)
        out[:, k] = W.mix(value[won] + level[won].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return rows, out


def band_keys(texts: DataFrame, column: str, key: str, weights: Weights, size: int = SHINGLE) -> DataFrame:
    """(key, weight, bands array<long>) of every row that has a word; weight is that of all its shingles."""
    held = texts.sparkSession.sparkContext.broadcast(weights)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks.forget()
        for piece in W.pieces(batches, column):
            row, value, count = shingles(W.Words(piece.column(piece.schema.get_field_index(column))), size)
            if not len(row):
                continue
            weight = count * held.value(value)
            rows, drawn = samples(row, value, weight)
            bands = np.stack([W.mix(sum((drawn[:, b * ROWS + r] * _SEEDS[r] for r in range(ROWS)), np.uint64(b))) for b in range(BANDS)], axis=1)
            keys = piece.column(piece.schema.get_field_index(key)).take(pa.array(rows))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * BANDS, pa.int32()), pa.array(bands.reshape(-1).view(np.int64)))
            total = np.bincount(row, weight.astype(np.float64))[rows]
            yield pa.RecordBatch.from_arrays([keys, pa.array(total), lists], [key, "weight", "bands"])

    return texts.select(column, key).mapInArrow(sample, f"{key} binary, weight double, bands array<long>")


def _weighed(texts: pa.Array, weights: Weights, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight) of the texts, by row and shingle."""
    row, value, count = shingles(W.Words(texts), size)
    return row, value, count * weights(value).astype(np.float64)


def similarities(pairs: DataFrame, weights: Weights, size: int = SHINGLE) -> DataFrame:
    """Exact weighted Jaccard similarity of (a, b, text_a, text_b), as (a, b, similarity)."""
    held = pairs.sparkSession.sparkContext.broadcast(weights)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for piece in W.pieces(W.pieces(iter([whole]), "text_a"), "text_b"):
                rows = piece.num_rows
                (ra, va, wa), (rb, vb, wb) = (_weighed(piece.column(k), held.value, size) for k in (2, 3))
                row, value, weight = np.concatenate([ra, rb]), np.concatenate([va, vb]), np.concatenate([wa, wb])
                order = np.lexsort((value, row))
                row, value, weight = row[order], value[order], weight[order]
                both = np.flatnonzero((row[1:] == row[:-1]) & (value[1:] == value[:-1]))
                shared = np.bincount(row[both], np.minimum(weight[both], weight[both + 1]), rows)
                total = np.bincount(row, weight, rows) - shared
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(shared / np.maximum(total, 1e-12))], ["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a binary, b binary, similarity double")


def rare_shingles(texts: DataFrame, weights: Weights, size: int, similarity: float) -> DataFrame:
    """(node, weight, shingles, keys, reach) of (node, body): ``keys`` are hashes of the rarest shingles, whose others weigh less than
    ``similarity`` of the text; ``reach`` is, by key, the weight of that shingle and all that are not as rare. Texts of at least that similarity share a key: what a text has in common with another is at least that
    share of its weight, so it can't all lie past the last key of the text whose keys end first."""
    held = texts.sparkSession.sparkContext.broadcast(weights)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches, "body"):
            row, value, count = shingles(W.Words(piece.column(1)), size)
            each = held.value(value).astype(np.float64)
            order = np.lexsort((W.mix(value ^ _SEEDS[0]), -each, row))  # the same order of shingles for all texts
            row, value, weight = row[order], value[order], (count * each)[order]
            total = np.bincount(row, weight, piece.num_rows)
            sums = np.cumsum(weight)
            before = sums - weight - np.concatenate([[0], np.cumsum(total)])[row]
            keep = total[row] - before >= similarity * (1 - 1e-6) * total[row]
            ends = np.append(0, np.cumsum(np.bincount(row[keep], minlength=piece.num_rows)))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(W.mix(value[keep] + _SEEDS[1]).view(np.int64)))
            reach = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((total[row] - before)[keep]))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(total), pa.array(np.bincount(row, minlength=piece.num_rows)), lists, reach], ["node", "weight", "shingles", "keys", "reach"])

    return texts.select("node", "body").mapInArrow(rarest, "node binary, weight double, shingles long, keys array<long>, reach array<double>")


def tile_links(tiles: DataFrame, weights: Weights, size: int, similarity: float) -> DataFrame:
    """(a, b) of tiles (key, i, j, asks, node, body): links that join the texts that ask with all similar ones of their tile, fewer than
    it has texts."""
    held = tiles.sparkSession.sparkContext.broadcast(weights)

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        nodes = table.column("node").to_pylist()
        row, value, weight = _weighed(table.column("body").combine_chunks(), held.value, size)
        total = np.bincount(row, weight, len(nodes))
        first = np.searchsorted(row, np.arange(len(nodes) + 1))
        order = np.argsort(value, kind="stable")
        order = order[~asks[row[order]]]
        inverted, holder, held_weight = value[order], row[order], weight[order]
        name = np.unique(np.array(nodes, dtype=object).astype("S16"), return_inverse=True)[1] if len(nodes) else np.zeros(0, np.int64)
        root = list(range(len(nodes)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out: list[tuple[bytes, bytes]] = []
        for k in np.flatnonzero(asks):
            own = slice(first[k], first[k + 1])
            low, high = np.searchsorted(inverted, value[own], "left"), np.searchsorted(inverted, value[own], "right")
            spread = high - low
            at = np.repeat(high - np.cumsum(spread), spread) + np.arange(spread.sum())
            shared = np.bincount(holder[at], np.minimum(held_weight[at], np.repeat(weight[own], spread)), len(nodes))
            alike = (shared >= similarity * np.maximum(total + total[k] - shared, 1e-12)) & ~asks & (name != name[k])
            for m in np.flatnonzero(alike):
                x, y = find(int(k)), find(int(m))
                if x != y:
                    root[x] = y
                    out.append((nodes[k], nodes[m]))
        return pa.table({"a": binary_list([x for x, _ in out]), "b": binary_list([x for _, x in out])})

    return tiles.groupBy("key", "i", "j").applyInArrow(compare, "a binary, b binary")


def classes(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node: connected components of (a, b), named by their smallest node.

    Alternates two contractions: a node hangs its larger neighbours on its smallest neighbour, then its smaller ones. Each round
    is written to the shared folder. Degrees only shrink towards stars, sums are combined map-side. Few links go through few tasks.
    """
    def state(df: DataFrame) -> tuple:
        """Tells sets of edges apart: their number and the exclusive or of their hashes."""
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())

    edges = stored(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct())
    before = state(edges)
    tasks = min(partitions(edges.sparkSession), 1 + before[0] // EDGES_A_TASK)
    edges = edges.coalesce(tasks)
    while True:
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).coalesce(tasks)
        least = both.groupBy(F.col("hi").alias("node")).agg(F.least(F.min("lo"), F.col("node")).alias("least")).coalesce(tasks)
        large = edges.select(F.col("lo").alias("node"), "hi").join(least, "node").select("hi", F.col("least").alias("lo"))
        large = large.unionByName(least.where("node > least").select(F.col("node").alias("hi"), F.col("least").alias("lo")))
        large = stored(large.where("hi > lo").coalesce(tasks).distinct().coalesce(tasks)).coalesce(tasks)
        small_least = large.groupBy("hi").agg(F.min("lo").alias("least")).coalesce(tasks)
        small = large.join(small_least, "hi").where("lo > least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        small = small.unionByName(small_least.select("hi", F.col("least").alias("lo"))).coalesce(tasks)
        edges = stored(small.distinct().coalesce(tasks)).coalesce(tasks)
        after = state(edges)
        if after == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
        before = after


def _slot() -> Column:
    return F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS))


def prefiltered(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of texts whose node may be wanted: all that are, and few others while the filter of FILTER_BITS bits is sparse.

    The filter is a table of bitmaps, FILTER_BITS / 8 bytes at most whatever the input, so it is broadcast.
    """
    bucket, position = F.bitmap_bucket_number(_slot()), F.bitmap_bit_position(_slot())
    bitmaps = F.broadcast(wanted.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(position).alias("bitmap")))
    byte = F.conv(F.hex(F.substring("bitmap", (F.col("position") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    placed = texts.withColumns({"bucket": bucket, "position": position}).join(bitmaps, "bucket")
    return placed.where(F.getbit(byte, (F.col("position") % 8).cast("int")) == 1).select(*texts.columns)


def _grouped(members: DataFrame, similarity: float, once: bool) -> DataFrame:
    """Of (node, weight, key): the groups of two or more, with size and hub, the lightest text; ``once``: of those with equal members one,
    that of the rarest shingle, with (weight, reach) of each member.

    ``far`` members are too heavy to be similar to the hub, which no text needs to be compared for.
    """
    hashes = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"h{k}") for k in range(2)]
    extra = ["weight", "reach"] if once else []
    reach = [F.sum("reach").alias("reach")] if once else []  # all members have more of it from a rarer shingle on
    heads = members.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("weight", "node")).alias("hub"), *hashes, *reach).where("n > 1")
    if once:
        heads = heads.groupBy("n", "h0", "h1").agg(F.max(F.struct("reach", "key", "hub")).alias("head")).select("head.key", "n", "head.hub")
    far = F.col("weight") * (similarity * (1 - 1e-4)) > F.col("hub.weight")
    return stored(members.join(heads.select("key", "n", "hub"), "key").select("key", "node", "n", F.col("hub.node").alias("hub"), far.alias("far"), *extra))


def _compared(pairs: DataFrame, bodies: DataFrame, weights: Weights, size: int) -> DataFrame:
    """Similarities of the distinct (a, b). Many pairs may have one b, a hub: adaptive execution splits that side of the last join."""
    pairs = stored(pairs)
    bodies = prefiltered(bodies, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    first, second = (bodies.select(F.col("node").alias(x), F.col("body").alias(f"text_{x}")) for x in ("a", "b"))
    return stored(similarities(pairs.join(first, "a").join(second, "b"), weights, size))


def _unsettled(groups: DataFrame, judged: DataFrame, similarity: float) -> DataFrame:
    """Members of the groups of three or more whose hub is not similar to all of them (in a pair, the hub is the only other)."""
    refused = judged.where(F.col("similarity") < similarity).select(F.col("a").alias("node"), F.col("b").alias("hub"))
    large = groups.where("n > 2")
    keys = large.where("far").select("key").unionByName(large.where("not far").join(refused, ["node", "hub"]).select("key")).distinct()
    return groups.join(keys, "key")


def open_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a the smaller, once each: pairs of unlike labels in a group of (key, node, weight, reach, label, main) that may be similar.

    All that two texts share lies at or past the rarest shingle they share, so in the group by that one either's reach holds it; a
    similar pair shares at least ``similarity / (1 + similarity)`` of the sum of both weights.
    """
    def side(x: str) -> list[Column]:
        return [F.col(name).alias(f"{name}_{x}") for name in ("node", "weight", "reach", "label")]

    both = members.where("label != main").select("key", *side("a")).join(members.select("key", *side("b")), "key").where("label_a != label_b")
    both = both.where(F.least("reach_a", "reach_b") >= similarity / (1 + similarity) * (1 - 1e-4) * (F.col("weight_a") + F.col("weight_b")))
    return both.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def similar_pairs(members: DataFrame, texts: DataFrame, weights: Weights, size: int, similarity: float) -> DataFrame:
    """(a, b): links that join all similar texts of each group of members (node, weight, key); texts has their (node, body)."""
    def stars(groups: DataFrame) -> DataFrame:
        return groups.where((F.col("node") != F.col("hub")) & ~F.col("far")).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()

    bands = _grouped(members, similarity, once=False)
    wanted = stored(bands.select("node").distinct())
    # copies are merged map-side before the join; an inner join, as a semi join would be pushed below the prefilter
    bodies = stored(prefiltered(texts, wanted).groupBy("node").agg(F.first("body").alias("body")).join(wanted, "node"))
    judged = _compared(stars(bands), bodies, weights, size)
    links = [judged.where(F.col("similarity") >= similarity).select("a", "b")]

    open_nodes = _unsettled(bands, judged, similarity).select("node").distinct()
    rare = stored(rare_shingles(bodies.join(open_nodes, "node"), weights, size, similarity))
    keys = rare.select("node", "weight", F.explode(F.arrays_zip("keys", "reach")).alias("at"))
    groups = _grouped(keys.select("node", "weight", F.col("at.keys").alias("key"), F.col("at.reach").alias("reach")), similarity, once=True)
    more = _compared(stars(groups).join(judged.select("a", "b"), ["a", "b"], "left_anti"), bodies, weights, size)
    links.append(more.where(F.col("similarity") >= similarity).select("a", "b"))
    links = stored(reduce(DataFrame.unionByName, links))

    labels = classes(links)
    rest = _unsettled(groups, judged.unionByName(more), similarity).join(labels, "node", "left").join(rare.select("node", "shingles"), "node")
    rest = stored(rest.select("key", "node", "weight", "reach", "shingles", F.coalesce("label", "node").alias("label")))
    main = rest.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("shingles").alias("shingles"))
    main = main.groupBy("key").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.sum("shingles").alias("all"),
        (F.sum("n") - F.max("n")).alias("n_other"), F.sum("shingles").alias("most_other"),
    ).where("n_other > 0")
    main = stored(main)
    compared = judged.unionByName(more).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = open_pairs(rest.join(main.where(F.col("n") <= PAIR_TEXTS).select("key", "main"), "key"), similarity).join(compared, ["a", "b"], "left_anti")
    linked = _compared(pairs, bodies, weights, size).where(F.col("similarity") >= similarity).select("a", "b")
    main = main.where(F.col("n") > PAIR_TEXTS)

    def blocks(texts: str, shingles: str) -> Column:
        return F.greatest(F.ceil(F.col(texts) / BLOCK_TEXTS), F.ceil(F.col(shingles) * F.col(texts) / F.col("n") / BLOCK_SHINGLES)).cast("int")

    def block(ways: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(ways)).cast("int")

    def every(ways: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(ways) - 1))

    main = main.select("key", "main", blocks("n_other", "most_other").alias("rows"), blocks("n", "all").alias("columns"))
    placed = rest.join(main, "key")
    asking = placed.where("label != main").select("key", block("rows").alias("i"), every("columns").alias("j"), F.lit(True).alias("asks"), "node")
    asked = placed.select("key", every("rows").alias("i"), block("columns").alias("j"), F.lit(False).alias("asks"), "node")
    tiles = stored(asking.unionByName(asked))
    tiles = tiles.join(prefiltered(bodies, tiles), "node")
    return links.unionByName(linked).unionByName(tile_links(tiles, weights, size, similarity))


def near_duplicate_nodes(df: DataFrame, text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(node, label): texts (16-byte digests) that have a near duplicate, and the label of their class."""
    texts = df.select(digest(text).alias("node"), F.coalesce(text, F.lit("")).alias("body"))
    weights = Weights(document_frequencies(texts, "body", size))
    nodes = stored(band_keys(texts, "body", "node", weights, size).groupBy("node").agg(F.first("weight").alias("weight"), F.first("bands").alias("bands")))
    members = nodes.select("node", "weight", F.explode("bands").alias("key"))
    return classes(similar_pairs(members, texts, weights, size, similarity))


def near_duplicates(df: DataFrame, text: str = "text", id: str = "doc_id", size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: (id, class_id, class_size, kept).

    Two texts are linked when the weighted Jaccard similarity of their word shingles (TF times damped IDF) is at least
    ``similarity``; classes are connected components, ``class_id`` is the smallest id in the class. Equal texts share a class.
    NULL counts as the empty text; texts without words are near duplicates of nothing but their equals; a text of fewer words
    than ``size`` is one shingle. Exactly one row of a class is kept: the one with the smallest id (NULL ids last; among rows
    equal in id, one). Extra columns are ignored. An empty table gives an empty table.
    """
    nodes = near_duplicate_nodes(df, text, size, similarity)
    rows = df.select(F.col(id).alias("id"), digest(text).alias("node"), F.monotonically_increasing_id().alias("row"))
    named = stored(rows.join(nodes, "node", "left").select("id", "row", F.coalesce("label", "node").alias("label")))
    best = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    groups = named.groupBy("label").agg(F.min(best).alias("best"), F.count("*").alias("class_size"))
    return named.join(groups, "label").select(F.col("id").alias(id), F.col("best.id").alias("class_id"), "class_size", (F.col("row") == F.col("best.row")).alias("kept"))


def drop_near_duplicates(df: DataFrame, text: str = "text", id: str = "doc_id", size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """df with one row of each class of near duplicates, all columns: the row with the smallest id (see ``near_duplicates``)."""
    node, label, rank = fresh(df, "node", "label", "rank")
    nodes = near_duplicate_nodes(df, text, size, similarity).select(F.col("node").alias(node), F.col("label").alias(label))
    named = df.withColumn(node, digest(text)).join(nodes, node, "left").withColumn(label, F.coalesce(label, node))
    first = Window.partitionBy(label).orderBy(F.col(id).asc_nulls_last())
    return named.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).select(*df.columns)
