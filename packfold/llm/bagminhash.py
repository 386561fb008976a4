"""MinHash near-dedup of weighted bags: BagMinHash signatures, bands, verified overlap.

A text is the multiset of its word 5-grams. Each shingle's weight axis [0, inf) is cut at
0, 1, 2, 4, 8, ...; every piece has a Poisson process in time whose points fall on a random
slot and on a random place of the piece, and a shingle of weight w sees the points below w.
The first point on each slot is the signature, so two texts agree on a slot with probability
equal to their weighted Jaccard similarity. Time is walked in windows of doubling length, and
a text stops at the window that fills its last slot: work follows the slots, not the weights.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packfold.llm import texts
from packfold.llm.components import components
from packfold.llm.texts import U64, Block
from packfold.plans.skew import lookup_skewed
from packfold.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
# A pair of similarity 0.8 shares none of 24 bands of 5 slots with probability 7e-5.
BANDS, ROWS = 24, 5
SLOTS = BANDS * ROWS
# Share of equal slots below which a pair is not compared in full: over five standard
# deviations under 0.8.
LEAST_AGREEMENT = 0.6
# Bits of the filter that tells which texts may be in a pair; 2 MB at any size of the table.
FILTER_BITS = 1 << 24
# Nodes of a bucket that meet in one tile, and their shingles (12 bytes each), about; larger
# buckets are dealt over several tiles.
TILE = 1024
TILE_SHINGLES = 1 << 21
# Pairs of a tile that are compared at a time.
CELLS = 1 << 16

_OPEN = U64(0xFFFFFFFFFFFFFFFF)
_TIME_STEP, _POINT_STEP = U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25)
FIRST_WINDOW = -2


def shingles(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles: text (ascending), hash (ascending in a text), count; and each text's sum.

    A text of one to four words has one shingle, all its words."""
    found = texts.runs(block, texts.ALNUM)
    words = texts.slice_hash(texts.prefix_hash(block.data, texts.LOWER), found.start, found.end)
    n_words = np.bincount(found.text, minlength=len(block.starts))
    grams, first = texts.ngrams(words, found.text, SHINGLE)
    hashes, owner = [grams], [found.text[first]]
    for n in range(1, SHINGLE):
        short, at = texts.ngrams(words, found.text, n)
        whole = n_words[found.text[at]] == n
        hashes.append(short[whole])
        owner.append(found.text[at[whole]])
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), np.bool_)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.append(at, len(hashes))), np.bincount(owner, minlength=len(block.starts))


@lru_cache(maxsize=64)
def _poisson(exponent: int) -> np.ndarray:
    """Cumulative probabilities of a Poisson count of mean 2**exponent."""
    mean = 2.0**exponent
    top = int(mean + 12 * mean**0.5 + 24)
    logs = np.cumsum(np.log(np.maximum(np.arange(top), 1)))
    return np.cumsum(np.exp(np.arange(top) * np.log(mean) - mean - logs))


def _uniform(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(11)).astype(np.float64) * 2.0**-53


def signatures(text: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n_texts: int) -> np.ndarray:
    """n_texts x SLOTS 32-bit signatures; a text without a shingle has one that means nothing."""
    # pieces of the weight axis: [0, 1), [1, 2), [2, 4), ... as far as the weight reaches
    own, name, size, floor, reach = [text], [texts.mix(hashes)], [np.zeros(len(text), np.int64)], [np.zeros(len(text))], [weight]
    level = 1
    while (deep := weight > 2 ** (level - 1)).any():
        own.append(text[deep])
        name.append(texts.mix(hashes[deep] + U64(level * int(texts.STEP) % 2**64)))
        size.append(np.full(deep.sum(), level - 1))
        floor.append(np.full(deep.sum(), 2.0 ** (level - 1)))
        reach.append(weight[deep])
        level += 1
    own, name, size, floor, reach = map(np.concatenate, (own, name, size, floor, reach))
    slots = np.full(n_texts * SLOTS, _OPEN)
    window = FIRST_WINDOW
    while len(own):
        # the first window is [0, 2**FIRST_WINDOW), then [2**k, 2**(k+1)): of length 2**k
        length = FIRST_WINDOW if window == FIRST_WINDOW else window - 1
        salted = texts.mix(name ^ U64((window + 64) * int(_TIME_STEP) % 2**64))
        count = np.zeros(len(own), np.int64)
        for s in np.unique(size):
            of = size == s
            count[of] = np.searchsorted(_poisson(int(s) + length), _uniform(salted[of]), side="right")
        some = np.flatnonzero(count)
        element = np.repeat(some, count[some])
        before = np.cumsum(count[some]) - count[some]
        number = np.arange(len(element)) - np.repeat(before, count[some])
        point = texts.mix(salted[element] + (number.astype(U64) + U64(1)) * _POINT_STEP)
        if level > 1:
            place = np.where(size[element] == 0, 1.0, 2.0 ** size[element]) * _uniform(texts.mix(point ^ _TIME_STEP))
            seen = floor[element] + place < reach[element]
            element, point = element[seen], point[seen]
        cell = own[element].astype(np.int64) * SLOTS + (texts.mix(point + _TIME_STEP) % U64(SLOTS)).astype(np.int64)
        free = slots[cell] == _OPEN
        # time in the upper half, the point's name in the lower
        np.minimum.at(slots, cell[free], texts.mix(point[free]) & ~U64(1))
        open_texts = (slots.reshape(n_texts, SLOTS) == _OPEN).any(axis=1)
        go = open_texts[own]
        own, name, size, floor, reach = own[go], name[go], size[go], floor[go], reach[go]
        window += 1
    return (slots.reshape(n_texts, SLOTS) & U64(0xFFFFFFFF)).astype(np.uint32)


def bands(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(U64)
    total = np.broadcast_to(np.arange(BANDS, dtype=U64), parts.shape[:2]).copy()
    for r in range(ROWS):
        total = texts.mix(total * texts.STEP + parts[:, :, r])
    return total


def names(text: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n_texts: int) -> np.ndarray:
    """128-bit names of the multisets, n_texts x 2."""
    out = np.zeros((n_texts, 2), U64)
    for k in (0, 1):
        term = texts.mix(texts.mix(hashes + U64((k + 1) * int(_POINT_STEP) % 2**64)) * (U64(2) * weight.astype(U64) + U64(1)))
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(term)])
        edge = np.searchsorted(text, np.arange(n_texts + 1))
        out[:, k] = sums[edge[1:]] - sums[edge[:-1]]
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of equal width as binary values."""
    width = rows.shape[1] * rows.itemsize
    offsets = (np.arange(len(rows) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


SIGNED = [("n_shingles", T.LongType()), ("node", T.BinaryType()), ("signature", T.BinaryType()), ("bands", T.ArrayType(T.LongType())), ("sketch", T.BinaryType())]


def sign(batch: pa.RecordBatch) -> dict[str, np.ndarray | pa.Array]:
    n, node, signature = [np.empty(0, np.int64)], [np.empty((0, 2), U64)], [np.empty((0, SLOTS), np.uint32)]
    for block in texts.blocks(batch.column(1)):
        text, hashes, weight, total = shingles(block)
        n.append(total)
        node.append(names(text, hashes, weight, len(block.starts)))
        signature.append(signatures(text, hashes, weight, len(block.starts)))
    signature = np.concatenate(signature)
    flat = pa.array(bands(signature).reshape(-1).view(np.int64))
    offsets = pa.array(np.arange(len(signature) + 1, dtype=np.int32) * BANDS)
    return {
        "n_shingles": np.concatenate(n),
        "node": _binary(np.concatenate(node)),
        # half of each slot is enough to compare
        "signature": _binary(signature.astype(np.uint16)),
        "bands": pa.ListArray.from_arrays(offsets, flat),
        # a byte of each slot: slots agree by chance a little more often, never less
        "sketch": _binary(signature.astype(np.uint8)),
    }


def ranked_bands(nodes: DataFrame) -> DataFrame:
    """(band, node, n, rank) for bands of two nodes or more. A node's rank is the sum of its
    buckets' sizes: edited copies have more in common with their source than with each other,
    so the source of a group ranks first."""
    rows = materialize(nodes.select("node", "n", F.explode("bands").alias("band")), "bands")
    sizes = rows.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    shared = materialize(rows.join(sizes, "band"), "shared-bands")
    ranks = shared.groupBy("node").agg(F.sum("size").alias("rank"))
    return materialize(shared.select("band", "node", "n").join(ranks, "node"), "ranked-bands")


def hub_pairs(ranked: DataFrame) -> DataFrame:
    """One pair (a, b) for each node: with the node that ranks first in most of its buckets. A
    group of copies hangs together by these alone, as a rule, at one pair a node."""
    hubs = ranked.groupBy("band").agg(F.max(F.struct("rank", "node")).alias("hub"))
    met = ranked.join(hubs, "band").filter(F.col("node") != F.col("hub.node"))
    # a node is in no more rows than there are bands: they are counted where its best is found
    counted = met.repartition("node").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("times"))
    best = counted.groupBy("node").agg(F.max(F.struct("times", "hub")).alias("best"))
    # a hub ranks before its node, so no pair is found from both sides
    return best.select(F.least("node", "best.hub.node").alias("a"), F.greatest("node", "best.hub.node").alias("b"))


def star_pairs(ranked: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes with different ``root``: the nodes of each bucket with
    three of them, the first by rank and the two at the ends of an order of the bucket's own
    that has nothing to do with the text."""
    who = F.struct("node", "root")
    order = F.struct(F.xxhash64("band", "node").alias("order"), who.alias("who"))
    centres = ranked.groupBy("band").agg(
        F.max(F.struct("rank", who.alias("who"))).alias("hub"), F.min(order).alias("low"), F.max(order).alias("high")
    )
    centres = centres.select("band", F.array_distinct(F.array("hub.who", "low.who", "high.who")).alias("centres"))
    apart = F.filter("centres", lambda c: c["root"] != F.col("root"))
    return _as_pairs(ranked.join(centres, "band").select("node", F.explode(apart).alias("centre")))


def _as_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b")).distinct()


def tiles(ranked: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(tile, band, side, node, root, n, bands, sketch): every two nodes of one bucket and of different
    components meet in a tile, on its sides 0 and 1 or both on side 2.

    A bucket of up to TILE nodes and TILE_SHINGLES shingles is one tile. In larger ones the nodes of the largest component
    (most of the bucket, as a rule) meet only those of the others, which meet each other too.
    """
    rooted = ranked.join(roots, "node", "left").select("band", "node", "n", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "rooted-bands")
    parts = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("w"))
    mixed = parts.groupBy("band").agg(
        F.sum("n").alias("size"), F.sum("w").alias("weight"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "w", "root")).alias("top")
    )
    mixed = materialize(mixed.filter(F.col("parts") > 1).select("band", "size", "weight", "top"), "mixed-bands")

    def many(n, w):
        return F.greatest(F.ceil(n / TILE), F.ceil(w / TILE_SHINGLES), F.lit(1)).cast("int")

    placed = rooted.join(mixed, "band").select(
        "band",
        "node",
        "root",
        ((F.col("size") <= TILE) & (F.col("weight") <= TILE_SHINGLES)).alias("is_one"),
        (F.col("root") == F.col("top.root")).alias("is_top"),
        many(F.col("top.n"), F.col("top.w")).alias("tops"),
        many(F.col("size") - F.col("top.n"), F.col("weight") - F.col("top.w")).alias("others"),
    )
    count = F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("others"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("band", "node"), count).cast("int"))

    def cell(kind, i, j, side):
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))

    part, zero = F.col("part"), F.lit(0)
    each = lambda n, make: F.transform(F.sequence(zero, F.col(n) - 1), make)
    with_top = F.when(F.col("is_top"), each("others", lambda q: cell(0, part, q, zero))).otherwise(
        each("tops", lambda p: cell(0, p, part, F.lit(1)))
    )
    among = each(
        "others",
        lambda q: cell(1, F.least(q, part), F.greatest(q, part), F.when(q == part, 2).when(part < q, 0).otherwise(1)),
    )
    cells = (
        F.when(F.col("is_one"), F.array(cell(1, zero, zero, F.lit(2))))
        .when(F.col("is_top"), with_top)
        .otherwise(F.concat(with_top, among))
    )
    known = nodes.select("node", "n", "bands", "sketch")
    dealt = placed.join(known, "node").withColumn("cell", F.explode(cells))
    tile = F.xxhash64("band", "cell.kind", "cell.i", "cell.j")
    return dealt.select(tile.alias("tile"), "band", "cell.side", "node", "root", "n", "bands", "sketch")


def _words(column: pa.ChunkedArray) -> np.ndarray:
    """The first eight bytes of binary values."""
    return np.frombuffer(b"".join(x[:8] for x in column.to_pylist()), U64)


def _tile_pairs(tile: pa.Table, similarity: float, best: bool):
    """Pairs of the tile that may be similar enough, as indices, each pair in the first bucket
    that it shares; with ``best`` the likeliest of each node only, in any bucket."""
    side, n = np.asarray(tile.column("side")), np.asarray(tile.column("n"))
    root = _words(tile.column("root"))
    sketch = np.frombuffer(b"".join(tile.column("sketch").to_pylist()), np.uint8).reshape(-1, SLOTS)
    bands = np.asarray(tile.column("bands").combine_chunks().flatten()).reshape(-1, BANDS)
    band = tile.column("band")[0].as_py()
    left, right = np.flatnonzero(side != 0), np.flatnonzero(side != 1)
    step = max(CELLS // max(len(right), 1), 1)
    for rows in (left[at : at + step] for at in range(0, len(left), step)):
        # sizes bound the similarity from above
        low, high = (f(n[rows][:, None], n[right][None, :]) for f in (np.minimum, np.maximum))
        may = (low >= (similarity - 1e-9) * high) & (root[rows][:, None] != root[right][None, :])
        x, y = np.nonzero(may)
        agree = np.zeros(may.shape, np.int64)
        agree[x, y] = np.count_nonzero(sketch[rows[x]] == sketch[right[y]], axis=1)
        if best:
            y = agree.argmax(axis=1) if len(right) else np.empty(0, int)
            x = np.flatnonzero(agree[np.arange(len(y)), y] >= LEAST_AGREEMENT * SLOTS)
            x, y = rows[x], right[y[x]]
        else:
            x, y = np.nonzero(agree >= LEAST_AGREEMENT * SLOTS)
            x, y = rows[x], right[y]
            once = x < y if len(side) and side[0] == 2 else np.ones(len(x), np.bool_)
            x, y = x[once], y[once]
            shared = bands[x] == bands[y]
            first = bands[x, shared.argmax(axis=1)] == band
            x, y = x[first], y[first]
        yield x, y


def _by_tile(made):
    """A function of batches sorted by tile that hands ``made`` a whole tile at a time."""

    def work(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            tile = np.asarray(table.column("tile"))
            if not len(tile):
                continue
            edges = np.append(0, np.flatnonzero(tile[1:] != tile[:-1]) + 1)
            for start, end in zip(edges[:-1], edges[1:]):
                yield from made(table.slice(start, end - start))
            # the last tile may go on in the next batch
            held = table.slice(edges[-1])
        if held is not None:
            yield from made(held)

    return work


def _together(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("tile").sortWithinPartitions("tile")


def likeliest_pairs(dealt: DataFrame, similarity: float) -> DataFrame:
    """For each node of a tile the pair (a, b) with the node most like it of another component."""

    def made(tile):
        node = tile.column("node").combine_chunks()
        for x, y in _tile_pairs(tile, similarity, True):
            yield pa.RecordBatch.from_arrays([node.take(pa.array(x)), node.take(pa.array(y))], names=["x", "y"])

    found = _together(dealt).mapInArrow(_by_tile(made), "x binary, y binary")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def tile_links(bags: DataFrame, dealt: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) that join all components of a tile that any of its pairs links, written.

    Pairs are made and verified inside a tile and never are rows of a table: what is shuffled is
    the nodes of each tile that may have a link, with their multisets.
    """
    spark = dealt.sparkSession

    def some(tile):
        found = [np.concatenate(pair) for pair in _tile_pairs(tile, similarity, False)]
        yield from tile.take(pa.array(np.unique(np.concatenate([np.empty(0, int), *found])))).combine_chunks().to_batches()

    schema = T.StructType(dealt.schema.fields)
    near = materialize(_together(dealt).mapInArrow(_by_tile(some), schema), "near-tiles")

    def linked(tile):
        node, bags = tile.column("node").to_pylist(), tile.column("bag").to_pylist()
        _, root = np.unique(_words(tile.column("root")), return_inverse=True)
        parent = root.tolist()
        above = list(range(len(parent)))
        links = []

        def find(i):
            while above[i] != i:
                above[i] = above[above[i]]
                i = above[i]
            return i

        for x, y in _tile_pairs(tile, similarity, False):
            for i, j in zip(x.tolist(), y.tolist()):
                p, q = find(parent[i]), find(parent[j])
                if p != q and weighted_jaccard(bags[i], bags[j]) >= similarity:
                    above[p] = q
                    links.append((node[i], node[j]))
        u, v = (pa.array([link[k] for link in links], pa.binary()) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"])

    with texts.small_batches(spark):
        whole = near.join(bags, "node").select(*near.columns, "bag")
        return materialize(_together(whole).mapInArrow(_by_tile(linked), "u binary, v binary"), "links")


def _agreement(batches):
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SLOTS) for c in (2, 3))
        share = (a == b).mean(axis=1) if len(a) else np.empty(0)
        keep = pa.array(share >= LEAST_AGREEMENT)
        yield batch.select([0, 1]).filter(keep)


def _bags(passing: np.ndarray):
    def work(batches):
        for block in (b for batch in batches for b in texts.blocks(batch.column(0))):
            text, hashes, weight, total = shingles(block)
            name = names(text, hashes, weight, len(block.starts))
            edge = np.searchsorted(text, np.arange(len(block.starts) + 1))
            wanted = np.flatnonzero(passing[(name[:, 0] & U64(FILTER_BITS - 1)).astype(np.int64)] & (total > 0))
            spans = [slice(edge[i], edge[i + 1]) for i in wanted]
            bag = [hashes[of].tobytes() + weight[of].astype("<u4").tobytes() for of in spans]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name[i].tobytes() for i in wanted], pa.binary()), pa.array(bag, pa.binary())], names=["node", "bag"]
            )

    return work


def _unpack(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(bag) // 12
    return np.frombuffer(bag, U64, n), np.frombuffer(bag, "<u4", n, 8 * n).astype(np.int64)


def weighted_jaccard(a: bytes, b: bytes) -> float:
    x, n = _unpack(a)
    y, m = _unpack(b)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = y[at] == x
    both = int(np.minimum(n[same], m[at[same]]).sum())
    return both / (int(n.sum() + m.sum()) - both)


def _verified(least: float):
    def work(batches):
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = [weighted_jaccard(x, y) >= least for x, y in zip(left, right)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return work


def _with_both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """Pairs (a, b) and the value of each side, for ``table`` (node, value) with unique nodes."""
    left = table.select(F.col("node").alias("a"), F.col(value).alias("left"))
    right = table.select(F.col("node").alias("b"), F.col(value).alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")


def _passing(nodes: DataFrame) -> np.ndarray:
    """Which values of the low bits of a node's name occur; at most FILTER_BITS / 64 rows come
    to the driver."""
    digits = F.hex("node")
    low = F.conv(F.concat(*[F.substring(digits, at, 2) for at in (5, 3, 1)]), 16, 10).cast("long")
    low = low.bitwiseAND(F.lit(FILTER_BITS - 1))
    got = nodes.select(F.shiftright(low, 6).alias("word"), F.expr("1L").alias("one"), (low % 64).cast("int").alias("bit"))
    got = got.select("word", F.call_function("shiftleft", "one", "bit").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[np.asarray(got.column("word"))] = np.asarray(got.column("bits"))
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(np.bool_)


def verified(nodes: DataFrame, bags: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose multisets are similar enough, as (u, v), written."""
    near = _with_both(pairs, nodes, "signature").mapInArrow(_agreement, "a binary, b binary")
    near = materialize(near, "near-pairs")
    with texts.small_batches(nodes.sparkSession):
        return materialize(_with_both(near, bags, "bag").mapInArrow(_verified(similarity), "u binary, v binary"), "links")


def _bags_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, bag) of the wanted nodes, written."""
    with texts.small_batches(docs.sparkSession):
        bags = docs.select("text").mapInArrow(_bags(_passing(wanted)), "node binary, bag binary")
        # copies of a text have one bag: they meet before the shuffle
        return materialize(bags.groupBy("node").agg(F.first("bag").alias("bag")).join(wanted, "node"), "bags")


def linked_roots(docs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, root) for all nodes with a link.

    One pair a node links most of a group. What it leaves in different components is paired as
    stars, then each node with its likeliest partners, which joins most of the rest, and then
    every pair of different components that has a bucket in common and signatures that agree
    enough is tested inside its tile. The multisets of all nodes that share a bucket are made
    once, and every step reads those."""
    ranked = ranked_bands(nodes)
    bags = _bags_of(docs, ranked.select("node").distinct())
    pairs = materialize(hub_pairs(ranked), "pairs")
    roots = components(verified(nodes, bags, pairs, similarity))
    tested = pairs
    for make in (lambda: star_pairs(_rooted(ranked, roots)), lambda: likeliest_pairs(tiles(ranked, nodes, roots), similarity)):
        more = materialize(make().join(tested, ["a", "b"], "left_anti"), "pairs")
        roots, tested = joined_roots(roots, verified(nodes, bags, more, similarity)), tested.union(more)
    return joined_roots(roots, tile_links(bags, tiles(ranked, nodes, roots), similarity))


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after more links (u, v): the links are added to the stars, one edge a
    node, that stand for all links before."""
    if links.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(links))


def _rooted(ranked: DataFrame, roots: DataFrame) -> DataFrame:
    return ranked.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row: key, n_shingles and class_id.

    Rows are linked if the weighted Jaccard similarity of their shingles (words of letters and
    digits, A-Z as a-z) is at least ``similarity``; class_id is the least key of the linked
    rows. Texts with the same multiset are one node throughout, so copies, repeated rows
    included, never meet as pairs. Texts without a word, null ones included, are alone: their
    class is their own key. Null keys are allowed and are never a class's id unless it has no
    other. Other columns are ignored.
    """
    docs = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    with texts.small_batches(df.sparkSession):
        signed = materialize(texts.map_texts(docs, ["key"], "text", SIGNED, sign), "signed")
        # all that a node has is the same in its rows
        nodes = signed.filter(F.col("n_shingles") > 0).groupBy("node").agg(
            F.count(F.lit(1)).alias("times"), F.min("key").alias("least"), F.first("signature").alias("signature"),
            F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n"),
        )
        nodes = materialize(nodes, "nodes")
    roots = linked_roots(docs, nodes, similarity)
    owned = nodes.select("node", "times", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    owned = materialize(owned, "owned")
    classes = owned.groupBy("root").agg(F.min("least").alias("class"), F.sum("times").alias("members"))
    table = owned.select("node", "times", "root").join(classes.filter(F.col("members") > 1), "root").select("node", "times", "class")
    table = materialize(table, "classes")
    # texts without a word have one name and no class; they do not meet anywhere
    worded, wordless = signed.filter(F.col("n_shingles") > 0), signed.filter(F.col("n_shingles") == 0)
    placed = lookup_skewed(worded.select("key", "n_shingles", "node"), table, "node", "times", scatter())
    alone = F.col("class").isNull()
    found = placed.select("key", "n_shingles", F.when(alone, F.col("key")).otherwise(F.col("class")).alias("class_id"))
    every = found.union(wordless.select("key", "n_shingles", F.col("key")))
    return every.select(F.col("key").alias(key), "n_shingles", "class_id")


def scatter() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("key").cast("string"), F.lit(""))))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df``, all columns, that have the least key of their class (null last).

    Of rows that repeat a key one stays as well, so a class keeps exactly one row."""
    number = "_row"
    while number in df.columns:
        number += "_"
    rows = materialize(df.withColumn(number, F.monotonically_increasing_id()), "numbered-rows")
    rank = F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("key"), F.col(number).alias("row"))
    classes = near_duplicates(rows.select(rank.alias("rank"), F.col(f"`{text}`").alias("text")), "rank", "text", similarity)
    first = classes.filter(F.col("rank") == F.col("class_id")).select(F.col("rank.row").alias(number))
    return rows.join(first, number, "left_semi").drop(number)
