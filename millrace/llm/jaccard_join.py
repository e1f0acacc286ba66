"""Similarity join of texts by the Jaccard similarity of their word n-grams: chosen paths.

A set (a text's distinct five-word shingles) is embedded as a signature of
min-hashes, so that two sets share a coordinate's token with the probability of
their similarity.  From the root of each run, nodes are split recursively
(Christiani, Pagh and Sivertsen: scalable and robust set similarity
join): a node samples coordinates, each set follows the tokens it holds there, and the sets
that chose the same path meet.  Small nodes are leaves and are brute-forced;
the number of runs follows from the target recall.

Near copies of one text stay together on all paths, so a large group of them would be
split and brute-forced again in every run.  The sets in large nodes therefore first follow a
leader they look like; sets of one leader are linked by that, and in each node only
those without it are compared with the rest.  Nodes with too many of these are split.

Leaves compare signatures and send on a spanning forest of what looks similar,
never the pairs.  Candidate groups are the components of these forests; in
each the exact similarity of all sets is computed from the shingles, in blocks, and
the links are counted there.  Texts with equal sets count once, with
their number, so copies are never expanded.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from millrace.llm import textarrays as ta
from millrace.llm.carried import Carried
from millrace.llm.components import connected_components
from millrace.llm.joins import join_groups, join_rare
from millrace.llm.storage import stored

WORDS = 5
#: The threshold as a fraction of whole numbers: similarity >= 4 / 5.
SIMILAR = (4, 5)
COORDINATES = 64
#: Levels of splitting; a node at the last level is brute-forced in blocks whatever its size.
DEPTH = 3
#: Sets in a leaf, and in a block of a larger node.
LEAF = 512
#: Shingles of one block when groups are verified.
BLOCK_SHINGLES = 1 << 20
#: Bits of the filter that keeps sets without a candidate from being shuffled.
FILTER_BITS = 1 << 25

_WORD = ~ta.byte_set([0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64
_MINHASH = ta.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F)) | _U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all texts' distinct shingle hashes, sorted in each text; where each text begins).

    Words are runs without ASCII white space, A-Z as a-z.  A text of one to four words has one
    shingle, all of its words; one without words has none.
    """
    low = _LOWER[data]
    start, end, text = ta.words(low, offsets, _WORD[low])
    value = ta.span_hash(ta.prefix_hash(low), start, end)
    grams, at = ta.ngrams(value, text, WORDS)
    n = len(offsets) - 1
    count = np.bincount(text, minlength=n)
    first = np.searchsorted(text, np.arange(n + 1))
    bounds = np.searchsorted(text[at], np.arange(n + 1))
    sets = []
    for i in range(n):
        if count[i] >= WORDS:
            s = np.sort(grams[bounds[i] : bounds[i + 1]])
            sets.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif count[i]:
            short = value[first[i] : first[i + 1]]
            whole = np.array([count[i]], np.uint64)
            for w in short:
                whole = ta.mix(whole * _U(0x9E3779B97F4A7C15) + w)
            sets.append(whole)
        else:
            sets.append(np.zeros(0, np.uint64))
    begin = np.zeros(n + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=begin[1:])
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), begin


def _per_set(ufunc: np.ufunc, values: np.ndarray, begin: np.ndarray, empty: int) -> np.ndarray:
    """ufunc.reduce of each set's values; empty sets get ``empty``."""
    out = np.full(len(begin) - 1, empty, values.dtype)
    full = begin[1:] > begin[:-1]
    if full.any():
        out[full] = ufunc.reduceat(values, begin[:-1][full])
    return out


def set_keys(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """A 16-byte key of each set's content, null for empty sets."""
    sums = _per_set(np.add, ta.mix(values ^ _U(0x5851F42D4C957F2D)), begin, 0)
    other = _per_set(np.bitwise_xor, ta.mix(values + _U(0x14057B7EF767814F)), begin, 0)
    size = (begin[1:] - begin[:-1]).astype(np.uint64)
    both = np.stack([ta.mix(sums + size), ta.mix(other ^ size)], axis=1)
    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(size), [None, pa.py_buffer(np.ascontiguousarray(both).tobytes())])
    return pa.array([k if n else None for k, n in zip(flat.to_pylist(), size, strict=True)], pa.binary())


def _binary(table: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    rows, width = len(table), table.shape[1] * table.itemsize
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((np.arange(rows + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(table).tobytes())])


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    """Binary values of one width as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def _sketch(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    values, begin = shingle_sets(data, offsets)
    signature = np.stack([_per_set(np.minimum, (values * a) >> _U(32), begin, 0) for a in _MINHASH], axis=1).astype(np.uint32)
    return [set_keys(values, begin), _binary(signature), pa.array(begin[1:] - begin[:-1], pa.int64()), *_texts(data, offsets)]


def _texts(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    keys = ta.text_keys(data, offsets)
    return [ta.longs(keys[:, 0]), ta.longs(keys[:, 1])]


def _agreement(similarity: float) -> np.ndarray:
    """Probability of each number of equal coordinates of a pair."""
    k = range(COORDINATES + 1)
    return np.array([math.comb(COORDINATES, i) * similarity**i * (1 - similarity) ** (COORDINATES - i) for i in k])


def leaf_bound(recall: float, similarity: float = SIMILAR[0] / SIMILAR[1]) -> int:
    """Equal coordinates from which a leaf takes a pair for a candidate: lost there is half of what ``recall`` allows at most."""
    return int(np.flatnonzero(np.cumsum(_agreement(similarity)) <= (1 - recall) / 2).max(initial=-1)) + 1


def runs_for(recall: float, similarity: float = SIMILAR[0] / SIMILAR[1]) -> int:
    """Runs after which a pair at the threshold has been found with probability ``recall``.

    A node samples 1 / similarity coordinates on average, so a pair that agrees in a coordinates keeps
    a / (coordinates * similarity) common children on average; its survival over the levels is that of
    a branching process. All runs see the same coordinates, so the chance of a miss is
    averaged over a, and half of what ``recall`` allows is left to the leaves' bound.
    """
    each = _agreement(similarity)
    mean = np.arange(COORDINATES + 1) / (COORDINATES * similarity)
    met = np.ones(COORDINATES + 1)
    for _ in range(DEPTH):
        met = 1 - np.exp(-mean * met)
    runs = 1
    found = np.arange(COORDINATES + 1) >= leaf_bound(recall, similarity)
    while (each * (1 - met) ** runs)[found].sum() > (1 - recall) / 2:
        runs += 1
    return runs


def _root_coordinates(runs: int) -> np.ndarray:
    """(run, coordinate) that the runs' roots sample: as many as 1 / similarity a run on average, spread evenly."""
    total = math.ceil(runs * SIMILAR[1] / SIMILAR[0])
    order = np.argsort(ta.mix(np.arange(COORDINATES, dtype=np.uint64) + _U(99)))
    return np.array([(k % runs, order[k % COORDINATES]) for k in range(total)])


def _paths(runs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Children of the roots: (key, sig) to (key, node)."""
    chosen = _root_coordinates(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signature = _matrix(batch.column(1), np.uint32).astype(np.uint64)
            if not len(signature):
                continue
            for r, c in chosen:
                node = ta.mix(ta.mix(signature[:, c] + _U((int(r) << 40) + 1)) + _U(int(c)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node.view(np.int64))], names=["key", "node"])

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Children of further nodes: (key, node, sig) to (key, node).

    A node samples each coordinate with probability 1 / (similarity * coordinates), by its own hash.
    """
    limit = _U(int(2**64 * SIMILAR[1] / SIMILAR[0] / COORDINATES))
    for batch in batches:
        node = np.asarray(batch.column(1)).view(np.uint64)
        signature = _matrix(batch.column(2), np.uint32).astype(np.uint64)
        for c in range(COORDINATES if len(signature) else 0):
            seed = ta.mix(node + _U(c + 1) * _U(0x9E3779B97F4A7C15))
            at = np.flatnonzero(seed < limit)
            if len(at):
                child = ta.mix(seed[at] ^ ta.mix(signature[at, c] + _U(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(child.view(np.int64))], names=["key", "node"])


def _flat(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _roots(similar: np.ndarray) -> np.ndarray:
    """Component of each row of a symmetric boolean matrix (its least member)."""
    n = len(similar)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] >= 0:
            continue
        root[i] = i
        front = np.array([i])
        while len(front):
            near = similar[front].any(axis=0) & (root < 0)
            root[near] = i
            front = np.flatnonzero(near)
    return root


def _forest(root: np.ndarray, keys: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Edges from each member to its component's first member."""
    at = np.flatnonzero(root != np.arange(len(root)))
    return [keys[i] for i in at], [keys[root[i]] for i in at]


def _leaf_links(batches: Iterator[pa.RecordBatch], bound: int) -> Iterator[pa.RecordBatch]:
    """(node, side, key, sig), sorted by node, to forest edges (a, b) of signatures that agree in ``bound`` coordinates or more.

    Sides: rows of side 1 and 2 are two blocks of which only pairs across count; side 0 is a block in itself.
    """
    a: list[bytes] = []
    b: list[bytes] = []
    for group in ta.by_group(batches, 0):
        if group.num_rows < 2:
            continue
        signature = _matrix(_flat(group, "sig"), np.uint32)
        side = np.asarray(_flat(group, "side"))
        agree = np.zeros((len(side), len(side)), np.uint8)
        for c in range(COORDINATES):
            agree += signature[:, c, None] == signature[None, :, c]
        similar = agree >= bound
        if side.any():
            similar &= side[:, None] != side[None, :]
        more, least = _forest(_roots(similar), _flat(group, "key").to_pylist())
        a += more
        b += least
        if len(a) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def intersections(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sizes of all pairwise intersections of sets.

    Tokens that few sets hold are counted pair by pair, the others by matrix products.
    """
    n = len(begin) - 1
    owner = np.repeat(np.arange(n), np.diff(begin))
    order = np.argsort(values, kind="stable")
    ordered, who = values[order], owner[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sizes = np.diff(np.r_[starts, len(ordered)])
    counts = np.zeros(n * n, np.int64)
    few = 8
    for size in range(2, few + 1):
        at = starts[sizes == size]
        for i in range(size):
            for j in range(i + 1, size):
                if len(at):
                    counts += np.bincount(who[at + i] * n + who[at + j], minlength=n * n)
    counts = counts.reshape(n, n)
    counts += counts.T
    many = np.flatnonzero(sizes > few)
    step = max(64, (1 << 22) // max(n, 1))
    for k in range(0, len(many), step):
        part = many[k : k + step]
        rows = np.concatenate([who[starts[x] : starts[x] + sizes[x]] for x in part])
        held = np.zeros((n, len(part)), np.float32)
        held[rows, np.repeat(np.arange(len(part)), sizes[part])] = 1
        counts += np.rint(held @ held.T).astype(np.int64)
    np.fill_diagonal(counts, np.diff(begin))
    return counts


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, side, key, copies, shingles), sorted by block, to (key, links, other): exact links, and forest edges.

    links counts the texts of the similar sets met in this block.
    """
    for group in ta.by_group(batches, 0):
        if group.num_rows < 2:
            continue
        sets = [np.frombuffer(s, np.uint64) for s in _flat(group, "shingles").to_pylist()]
        size = np.array([len(s) for s in sets])
        begin = np.r_[0, np.cumsum(size)]
        common = intersections(np.concatenate(sets), begin)
        up, down = SIMILAR
        similar = (up + down) * common >= up * (size[:, None] + size[None, :])
        np.fill_diagonal(similar, False)
        side = np.asarray(_flat(group, "side"))
        if side.any():
            similar &= side[:, None] != side[None, :]
        linked = np.flatnonzero(similar.any(axis=1))
        links = similar[linked] @ np.asarray(_flat(group, "copies"))
        keys = _flat(group, "key").to_pylist()
        root = _roots(similar)
        yield pa.RecordBatch.from_arrays(
            [pa.array([keys[i] for i in linked], pa.binary()), pa.array(links, pa.int64()), pa.array([keys[root[i]] for i in linked], pa.binary())],
            names=["key", "links", "other"],
        )


def _blocked(rows: DataFrame, group: str, blocks: str) -> DataFrame:
    """Rows of a group to pairs of its blocks: (block, side, rest of the row).

    A row goes to every pair that holds its own block: ``blocks`` copies, one for groups of a single block.
    """
    own = F.pmod(F.xxhash64("key", F.lit(5)), F.col(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1))
    rest = [c for c in rows.columns if c not in (group, blocks)]
    paired = rows.withColumn("__own", own).withColumn("__other", other)
    low, high = F.least("__own", "__other"), F.greatest("__own", "__other")
    side = F.when(low == high, 0).when(F.col("__own") == low, 1).otherwise(2)
    return paired.select(F.xxhash64(group, low, high).alias("block"), side.cast("int").alias("side"), *rest)


def _grouped(rows: DataFrame, by: str, run, schema: str) -> DataFrame:
    """Groups in the order of their keys, so that forests are stars around their least keys, which components need fewest rounds for."""
    return rows.repartition(by).sortWithinPartitions(by, "key").mapInArrow(run, schema)


def _like_pivot(batches: Iterator[pa.RecordBatch], bound: int) -> Iterator[pa.RecordBatch]:
    """(key, pivot, sig, pivot_sig) to (key, leader) of the rows whose signatures agree in ``bound`` coordinates or more."""
    for batch in batches:
        if batch.num_rows:
            agree = (_matrix(batch.column(2), np.uint32) == _matrix(batch.column(3), np.uint32)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(agree >= bound)) for c in batch.columns[:2]], names=["key", "leader"])


def _leaders(held: DataFrame, bound: int, n_nodes: int) -> DataFrame:
    """(key, leader), stored: the pivot that a set looks like, for the sets that look like theirs.

    held: (key, sig, nodes), the large nodes of each set, n_nodes in all. A node's pivot is the set in it that most large nodes hold, as it is in the
    middle of its near copies; a set's pivot is that of most of its nodes. So a set meets one other, however many nodes hold both.
    """
    place = F.struct((-F.size("nodes")).alias("rank"), F.xxhash64("key", F.lit(7)).alias("tie"), F.col("key").alias("pivot"))
    spread = held.select("key", place.alias("place"), F.explode("nodes").alias("node"))
    pivots = stored(spread.groupBy("node").agg(F.min("place").alias("first")))
    asked = join_groups(spread.select("key", "node"), pivots, ["node"], 96, "inner", n_nodes).groupBy("key").agg(F.mode("first", True).alias("first"))
    asked = asked.select("key", F.col("first.pivot").alias("pivot")).where("pivot <> key").join(held.select("key", "sig").hint("merge"), "key")
    of_pivots = held.select(F.col("key").alias("pivot"), F.col("sig").alias("pivot_sig"))
    of_pivots = stored(join_groups(of_pivots, pivots.select(F.col("first.pivot").alias("pivot")), ["pivot"], 48, "left_semi", n_nodes))
    met = join_groups(asked, of_pivots, ["pivot"], 64 + 4 * COORDINATES, "inner", n_nodes)
    return stored(met.select("key", "pivot", "sig", "pivot_sig").mapInArrow(lambda batches: _like_pivot(batches, bound), "key binary, leader binary"))


def _besides(rows: DataFrame) -> DataFrame:
    """Rows (node, label, main, n, rest of the row) to blocks in which all pairs meet but those of two sets of the node's main label.

    Sets of the main label stand in one block each; the others, ``LEAF`` at most, in every block, and in one for themselves.
    """
    blocks = F.ceil(F.col("n") / LEAF).cast("int")
    own = F.pmod(F.xxhash64("key", F.lit(5)), blocks).cast("int")
    follows = F.col("label") == F.col("main")
    rest = [c for c in rows.columns if c not in ("node", "label", "main", "n")]
    placed = rows.select("node", follows.alias("__follows"), F.explode(F.when(follows, F.array(own)).otherwise(F.sequence(F.lit(-1), blocks - 1))).alias("__at"), *rest)
    side = F.when(F.col("__follows"), 1).when(F.col("__at") < 0, 0).otherwise(2)
    return placed.select(F.xxhash64("node", "__at").alias("block"), side.cast("int").alias("side"), *rest)


def candidate_groups(sets: DataFrame, recall: float) -> DataFrame:
    """(node, component), stored, of the sets that may be similar to another; sets: key, sig."""
    runs, bound = runs_for(recall), leaf_bound(recall)
    signatures = sets.select("key", "sig").hint("merge")
    children = sets.select("key", "sig").mapInArrow(_paths(runs), "key binary, node long")
    leaves, followed, others = [], [], []
    for level in range(1, DEPTH + 1):
        children = stored(children) if level > 1 else children
        sizes = stored(children.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        n_large = sizes.where(F.col("n") > LEAF).count() if level < DEPTH else 0
        met = children.join(sizes.hint("merge"), "node")
        met = stored(met) if n_large else met
        own = met.where(F.col("n") <= LEAF) if n_large else met
        leaves.append(own.select("key", "node", F.ceil(F.col("n") / LEAF).alias("blocks")))
        if not n_large:
            break
        open_ = met.where(F.col("n") > LEAF).select("key", "node")
        if level == 1:
            nodes = open_.groupBy("key").agg(F.collect_list("node").alias("nodes"))
            held = stored(nodes.join(signatures, "key"))
            leaders = _leaders(held, bound, n_large)
            spread = held.select("key", "sig", F.explode("nodes").alias("node"))
            labelled = join_groups(spread, leaders, ["key"], 80).select("key", "sig", "node", F.coalesce("leader", "key").alias("label"))
            shares = labelled.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"))
            shares = stored(shares.select("node", "n", F.col("most.label").alias("main"), (F.col("n") - F.col("most.n")).alias("others")))
            besides = shares.where(F.col("others").between(1, LEAF)).drop("others")
            followed.append(leaders.select(F.col("key").alias("a"), F.col("leader").alias("b")))
            others.append(_besides(join_groups(labelled, besides, ["node"], 80, "inner", n_large)))
            large = shares.where(F.col("others") > LEAF).select("node")
            n_large = large.count()
            if not n_large:
                break
            open_ = join_groups(spread, large, ["node"], 32, "inner", n_large)
        else:
            open_ = open_.join(signatures, "key")
        children = open_.select("key", "node", "sig").mapInArrow(_split, "key binary, node long")
    # The blocks of all levels are compared at once.
    met = [_blocked(reduce(DataFrame.union, leaves).join(signatures, "key"), "node", "blocks"), *others]
    blocks = reduce(DataFrame.union, [x.select("block", "side", "key", "sig") for x in met])
    edges = _grouped(blocks, "block", lambda batches: _leaf_links(batches, bound), "a binary, b binary")
    return connected_components(reduce(DataFrame.union, followed, edges))


def _bits(keys: pa.Array) -> np.ndarray:
    """The filter's bit of each key."""
    return (_matrix(keys, ">u8")[:, 0] % _U(FILTER_BITS)).astype(np.int64) if len(keys) else np.zeros(0, np.int64)


def _filter_of(keys: DataFrame) -> np.ndarray:
    """A bit for each key: FILTER_BITS / 8 bytes whatever the number of keys.

    Spark merges words of 64 bits, and the driver gets one row a word at most.
    """
    bits = keys.select((F.conv(F.hex(F.substring("key", 5, 4)), 16, 10).cast("long") % FILTER_BITS).alias("bit"))
    words = bits.selectExpr("bit DIV 64 AS w", "shiftleft(1L, CAST(bit % 64 AS INT)) AS b")
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for batch in words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow().to_batches():
        table[np.asarray(batch.column(0))] = np.asarray(batch.column(1))
    return table.view(np.uint64)


def verified(docs: DataFrame, text: str, sets: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, links, other) rows of exact links within candidate groups."""

    sent = docs.sparkSession.sparkContext.broadcast(_filter_of(groups.select(F.col("node").alias("key"))))

    def shingles(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        values, begin = shingle_sets(data, offsets)
        keys = set_keys(values, begin)
        at = np.flatnonzero(begin[1:] > begin[:-1])
        bit = _bits(keys.take(pa.array(at)))
        asked = np.zeros(len(keys), bool)
        asked[at] = (sent.value[bit // 64] >> (bit % 64).astype(np.uint64)) & _U(1) == 1
        raw = values.tobytes()
        bodies = [raw[8 * i : 8 * j] if x else None for i, j, x in zip(begin[:-1], begin[1:], asked, strict=True)]
        return [keys, pa.array(bodies, pa.binary()), pa.array(asked)]

    fields = [("key", "binary"), ("shingles", "binary"), ("asked", "boolean")]
    whole = ta.with_text_columns(docs, text, fields, shingles, keep=[], mask="asked")
    wanted = stored(groups.select(F.col("node").alias("key"), "component").join(sets.select("key", "copies", "size").hint("merge"), "key"))
    sizes = stored(wanted.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / LEAF), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks")))
    wanted = join_groups(wanted, sizes, ["component"], 64).select("key", "component", "copies", "blocks")
    one_each = whole.groupBy("key").agg(F.first("shingles").alias("shingles"))
    rows = _blocked(one_each.join(wanted.hint("merge"), "key"), "component", "blocks")
    return _grouped(rows.select("block", "side", "key", "copies", "shingles"), "block", _verify, "key binary, links long, other binary")


def similarity_classes(docs: DataFrame, text: str, ids: str, recall: float) -> tuple[DataFrame, DataFrame]:
    """(each text's set key, id and text keys, each linked set's class and links)."""
    fields = [("key", "binary"), ("sig", "binary"), ("size", "long"), ("t1", "long"), ("t2", "long")]
    light = stored(ta.with_text_columns(docs.select(F.col(ids).alias("id"), F.col(text).alias("body")), "body", fields, _sketch, keep=["id"]))
    sets = stored(light.where("key IS NOT NULL").groupBy("key").agg(F.first("sig").alias("sig"), F.first("size").alias("size"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")))
    groups = candidate_groups(sets, recall)
    exact = stored(verified(docs, text, sets, groups))
    classes = connected_components(exact.select(F.col("key").alias("a"), F.col("other").alias("b")))
    links = exact.groupBy("key").agg(F.sum("links").alias("links"))
    joined = (
        sets.select("key", "copies", "least")
        .join(classes.select(F.col("node").alias("key"), "component"), "key", "left")
        .join(links, "key", "left")
        .select("key", F.coalesce("component", "key").alias("component"), "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    linked = stored(joined.where("n_links > 0"))
    heads = stored(linked.groupBy("component").agg(F.min("least").alias("class_id")))
    return light.select("id", "key", "t1", "t2"), stored(join_groups(linked, heads, ["component"], 64).select("key", "component", "class_id", "n_links"))


def jaccard_join(docs: DataFrame, text: str = "text", ids: str = "doc_id", recall: float = 0.9999) -> DataFrame:
    """One row for each document: its id, class_id and n_links.

    Two texts are linked when the Jaccard similarity of their shingle sets is
    0.8 or more; n_links counts the other texts linked to this one, copies
    included; classes are the connected groups of links, named by their least
    id.  Links are verified exactly; recall is the least probability
    that a pair at the threshold meets in a leaf and is a candidate there.

    Defined cases: null texts and texts without words have no links and a
    class of their own; texts of one to four words are linked to those of the
    same words; a null id is never the class's name unless all are null; repeated rows are
    documents of their own; an empty table gives no rows; other columns are not
    looked at.
    """
    own = Carried(docs)
    light, results = similarity_classes(own.rows, own.find(text), own.find(ids), recall)
    joined = join_groups(light.select("id", "key"), results.select("key", "class_id", "n_links"), ["key"], 96)
    return joined.select(F.col("id").alias(ids), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, text: str = "text", ids: str = "doc_id", recall: float = 0.9999) -> DataFrame:
    """``docs`` with one document of each class, that of the least id; columns as they were.

    Texts without a link stay where they are: only ids and keys are shuffled. Texts that may be linked are
    found by a filter of fixed size where their keys are too many to be sent to every executor.

    Defined cases: null texts and texts without words all stay; a null id loses to any other; of rows
    equal in id and text one stays; of equal ids with different texts, the text of the least key;
    an empty table gives no rows; columns are carried whatever their names.
    """
    own = Carried(docs)
    light, results = similarity_classes(own.rows, own.find(text), own.find(ids), recall)
    identity = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("")).alias("row_id")
    several = join_groups(light.where("key IS NOT NULL"), results.select("key", "component"), ["key"], 96, "inner")
    several = stored(several.groupBy("component", "id", "t1", "t2").agg(F.count(F.lit(1)).alias("n")))
    order = F.struct(F.col("id").isNull().alias("no"), "id", "t1", "t2")
    winners = stored(several.groupBy("component").agg(F.min(order).alias("first")).select("component", F.col("first.t1").alias("w1"), F.col("first.t2").alias("w2"), F.col("first.id").alias("wid")))
    judged = join_groups(several, winners, ["component"], 96)
    wins = (F.col("t1") == F.col("w1")) & (F.col("t2") == F.col("w2")) & F.col("id").eqNullSafe(F.col("wid"))
    flags = stored(judged.select(identity, "t1", "t2", F.when(~wins, 0).when(F.col("n") == 1, 1).otherwise(2).alias("mark")))
    keyed = ta.with_text_columns(own.rows.withColumn("id", F.col(own.find(ids))).withColumn("row_id", identity).drop("id"), own.find(text), [("t1", "long"), ("t2", "long")], _texts)
    marked = join_rare(keyed, flags, ["t1", "t2", "row_id"], 64)
    kept = marked.where("mark IS NULL OR mark = 1").select(*own.restored())
    if flags.where("mark = 2").isEmpty():
        return kept
    # Winners that stand in the table several times: one of their rows stays.
    repeated = join_rare(keyed, flags.where("mark = 2"), ["t1", "t2", "row_id"], 64).where("mark = 2")
    number = F.row_number().over(Window.partitionBy("t1", "t2", "row_id").orderBy(F.lit(1)))
    return kept.union(repeated.withColumn("n", number).where("n = 1").select(*own.restored()))
