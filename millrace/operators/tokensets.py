"""Sets of tokens against sets: which pairs have a Jaccard similarity of a threshold or more, exactly.

Texts of one language share so many words that an index of tokens meets most pairs. So sets stand in groups by size, every two groups
whose sizes allow the threshold meet in one task, and blocks of them are compared by matrix products: bounds from sketches, or the exact overlaps. A
set is copied once for each group it meets, never for each pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

#: Sets of a block, whose pairs are compared at once.
BLOCK = 512
#: Blocks of a candidate group whose sketches are compared in one task.
PART = 16
#: Sets of a group at least and at most; fewer where they would hold more bytes than ``GROUP_BYTES``.
GROUP, GROUP_BYTES = (1024, 32_768), 1 << 24
#: So many groups are made at least, where there are sets enough.
GROUPS = 16
#: Most frequent tokens of two blocks whose overlap is a matrix product; that of the others is counted pair by pair.
DENSE = 512
#: Bits of a sketch for each token of a set, and at most.
BITS, MOST_BITS = 4, 1 << 16


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of an equal first column, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        value = np.asarray(batch.column(0))
        cuts = np.r_[0, np.flatnonzero(value[1:] != value[:-1]) + 1, len(value)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if held and i == 0 and held[-1].column(0)[0] != batch.column(0)[0] or held and i:
                yield whole()
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield whole()


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all values, where each list begins) of a column of lists."""
    begin = np.asarray(lists.offsets).astype(np.int64)
    return np.asarray(lists.values)[begin[0] : begin[-1]].view(np.uint64), begin - begin[0]


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the sketch of sets of so many tokens: a power of two."""
    power = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
    return np.minimum(np.maximum(BITS << power, 64), MOST_BITS)


def sketches(lists: pa.Array) -> pa.Array:
    """A sketch of each list of token hashes: the parity of its tokens in each of its bits.

    Two sets differ in at least as many tokens as their sketches differ in bits, which bounds their overlap from above.
    """
    values, begin = _flat(lists)
    n = np.diff(begin)
    bits = sketch_bits(n)
    at = np.r_[0, np.cumsum(bits // 64)]
    place = values & np.repeat(bits - 1, n).astype(np.uint64)
    words = np.zeros(at[-1], np.uint64)
    np.bitwise_xor.at(words, np.repeat(at[:-1], n) + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(words)])


def _keys(lists: pa.Array) -> pa.Array:
    """A key of 16 bytes of each list's content."""
    values, begin = _flat(lists)
    return pa.array([hashlib.md5(values[i:j]).digest() for i, j in zip(begin[:-1], begin[1:], strict=True)], pa.binary())


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of 64 bits, different ones of different values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123)]] = True


def token_lists(texts: pa.Array) -> pa.Array:
    """Hashes of the distinct tokens [a-z0-9]+ of each text, sorted; a token of up to eight letters is hashed without loss."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    # A gap behind each text, so that no token goes on in the next; and room for the last word.
    at = np.repeat(np.arange(len(texts)), np.diff(bounds)) + np.arange(len(data))
    spaced = np.zeros(len(data) + len(texts) + 8, np.uint8)
    spaced[at] = data
    edge = np.diff(np.r_[False, _LETTER[spaced]].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - start
    value = size.astype(np.uint64)
    for k in range(0, size.max(initial=0), 8):
        own = np.flatnonzero(size > k)
        word = np.zeros(len(own), np.uint64)
        for i in range(8):
            letter = spaced[np.minimum(start[own] + k + i, len(spaced) - 1)].astype(np.uint64)
            word |= np.where(size[own] > k + i, letter, np.uint64(0)) << np.uint64(8 * i)
        value[own] = _mixed(value[own] * np.uint64(0x9E3779B97F4A7C15) + word) if k else _mixed(word)
    text = np.searchsorted(bounds[1:] - bounds[0] + np.arange(1, len(texts) + 1), start, side="right")
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    first = np.r_[True, (value[1:] != value[:-1]) | (text[1:] != text[:-1])] if len(value) else np.zeros(0, bool)
    begin = np.r_[0, np.cumsum(np.bincount(text[first], minlength=len(texts)))]
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(value[first].view(np.int64)))


def _of_texts(df: DataFrame, ids: str, text: str, made: dict[str, str], run) -> DataFrame:
    """(id, what ``run`` makes of the token lists) of each row, some texts at a time."""
    schema = T.StructType([T.StructField("id", df.schema[ids].dataType), *T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in made.items())).fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in _slices(np.asarray(pc.binary_length(batch.column(1))) + 8, 1 << 18):
                part = batch.slice(k.start, k.stop - k.start)
                yield pa.RecordBatch.from_arrays([part.column(0), *run(token_lists(part.column(1)))], names=schema.names)

    return df.select(F.col(ids).alias("id"), F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text")).mapInArrow(each, schema)


def with_sketches(df: DataFrame, ids: str, text: str) -> DataFrame:
    """(id, r, n, sketch) of the token set of each text; r is a key of the set's content."""
    return _of_texts(df, ids, text, {"r": "binary", "n": "int", "sketch": "binary"}, lambda lists: [_keys(lists), lists.value_lengths(), sketches(lists)])


def with_sets(df: DataFrame, ids: str, text: str) -> DataFrame:
    """(id, r, n, s) of each text: its set and the same key."""
    return _of_texts(df, ids, text, {"r": "binary", "n": "int", "s": "array<long>"}, lambda lists: [_keys(lists), lists.value_lengths(), lists])


def met(rows: DataFrame, threshold: float, bytes_of) -> DataFrame:
    """``rows`` (with their size n > 0) once for each pair of groups they are in, behind columns task and side, sorted by the task.

    All pairs whose sizes allow the threshold meet in exactly one task: rows of side 1 with those of side 2, or all with all where the side is 0.
    bytes_of: of a row with n tokens. The driver sees the number of sets of each size.
    """
    spark = rows.sparkSession
    sizes = sorted((r["n"], r["k"]) for r in rows.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect())
    aim = min(max(sum(k for _, k in sizes) // GROUPS, GROUP[0]), GROUP[1])
    groups: list[list[int]] = []  # least and largest size
    places, held = [], 0
    for n, k in sizes:
        most = max(1, min(aim, GROUP_BYTES // bytes_of(n)))
        if k > most:
            places.append((n, len(groups), math.ceil(k / most)))
            groups += [[n, n] for _ in range(math.ceil(k / most))]
            held = most
        else:
            if not groups or held + k > most:
                groups.append([n, n])
                held = 0
            held += k
            groups[-1][1] = n
            places.append((n, len(groups) - 1, 1))
    meets: list[list[tuple[int, int]]] = [[] for _ in groups]
    tasks = 0
    for g, (_, high) in enumerate(groups):
        for h in range(g, len(groups)):
            if groups[h][0] * threshold > high + 1e-6:
                break
            meets[g].append((tasks, 0 if g == h else 1))
            if g != h:
                meets[h].append((tasks, 2))
            tasks += 1
    ints = lambda values: pa.array(values, pa.int32())
    place = spark.createDataFrame(pa.table({name: ints([p[k] for p in places]) for k, name in enumerate(("n", "__first", "__k"))}))
    flat = [(g, *m) for g, own in enumerate(meets) for m in own]
    meet = spark.createDataFrame(pa.table({name: ints([m[k] for m in flat]) for k, name in enumerate(("__g", "task", "side"))}))
    dealt = rows.join(F.broadcast(place), "n").withColumn("__g", (F.col("__first") + F.pmod(F.xxhash64(rows.columns[0], F.lit(3)), F.col("__k"))).cast("int"))
    spread = dealt.join(F.broadcast(meet), "__g").select("task", "side", *rows.columns)
    return spread.repartition(max(tasks, 1), "task").sortWithinPartitions("task")


def _blocks(side: np.ndarray, size: np.ndarray, most: np.ndarray) -> list[np.ndarray]:
    """Places of the rows by blocks: of one side, like sizes and one length of sketches; ``most`` rows of each such length."""
    order = np.lexsort((size, side))
    bits = sketch_bits(size)[order]
    cuts = np.flatnonzero(np.r_[True, (np.diff(side[order]) != 0) | (np.diff(bits) != 0), True])
    return [order[k : min(k + most[order[i]], j)] for i, j in zip(cuts[:-1], cuts[1:], strict=True) for k in range(i, j, most[order[i]])]


def _block_pairs(side: np.ndarray, size: np.ndarray, most: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks that meet: of different sides, or all pairs of side 0; each pair once."""
    blocks = _blocks(side, size, most)
    ends = [(size[b].min(), size[b].max()) for b in blocks]
    for k, a in enumerate(blocks):
        for m in range(k, len(blocks)):
            b = blocks[m]
            if side[a[0]] != side[b[0]] or not side[a[0]]:
                if ends[k][1] >= threshold * ends[m][0] - 1e-6 and ends[m][1] >= threshold * ends[k][0] - 1e-6:
                    yield a, b


def _signs(sketch: list[bytes], bits: int) -> np.ndarray:
    """Sketches of one length folded to ``bits``, as rows of 1 and -1."""
    table = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(sketch), -1)
    while table.shape[1] * 8 > bits:
        half = table.shape[1] // 2
        table = table[:, :half] ^ table[:, half:]
    return 1 - 2 * np.unpackbits(table, axis=1).astype(np.float32)


def _may_be_similar(side: np.ndarray, size: np.ndarray, sketch: list[bytes], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs that their sketches do not rule out."""
    bits = sketch_bits(size)
    differing = (1 - threshold) / (1 + threshold)
    held: tuple[int, int, np.ndarray] | None = None
    for a, b in _block_pairs(side, size, np.maximum(1, np.minimum(BLOCK, (1 << 24) // bits)), threshold):
        width = int(min(bits[a[0]], bits[b[0]]))
        if held is None or held[:2] != (a[0], width):
            held = (a[0], width, _signs([sketch[i] for i in a], width))
        other = held[2] if a[0] == b[0] else _signs([sketch[i] for i in b], width)
        # Equal bits less differing ones.
        near = held[2] @ other.T >= width - 2 * differing * (size[a][:, None] + size[b][None, :]).astype(np.float32) - 0.01
        if a[0] == b[0]:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        i, j = a[i], b[j]
        fits = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-6
        yield i[fits], j[fits]


def _united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the components of a and b, edge by edge; root has the least member of each component for all its members."""
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (further := root[root])).any():
            root[:] = further


def candidate_forest(dealt: DataFrame, threshold: float) -> DataFrame:
    """(a, b) that connect what may be similar, from (task, side, key, n, sketch): fewer than the sets of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches):
            side, key, size = np.asarray(group.column(1)), group.column(2), np.asarray(group.column(3)).astype(np.int64)
            root = np.arange(len(size))
            for i, j in _may_be_similar(side, size, group.column(4).to_pylist(), threshold):
                _united(root, i, j)
            at = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([key.take(pa.array(at)), key.take(pa.array(root[at]))], names=["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary")


def candidates_in_blocks(parts: DataFrame, threshold: float) -> DataFrame:
    """(block, side, key, copies) of sets that may be similar to another of that block, from (part, side, key, n, sketch, copies, c, own).

    own: the block that a set is in, of its group c; two blocks are a block in which sets of sides 1 and 2 meet. A part holds many blocks,
    so that a set is copied for those alone in which it has a candidate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches):
            side, size = np.asarray(group.column(1)), np.asarray(group.column(3)).astype(np.int64)
            own = np.asarray(group.column(7)).astype(np.int64)
            asked, met_by = [np.zeros(0, np.int64)], np.int64(own.max() + 1)
            for i, j in _may_be_similar(side, size, group.column(4).to_pylist(), threshold):
                asked.append(np.unique(np.concatenate([i * met_by + own[j], j * met_by + own[i]])))
            row, other = np.divmod(np.unique(np.concatenate(asked)), met_by)
            low, high = np.minimum(own[row], other), np.maximum(own[row], other)
            c = np.asarray(group.column(6)).view(np.uint64)[row]
            block = _mixed(_mixed(c + low.astype(np.uint64)) + high.astype(np.uint64)).view(np.int64)
            across = np.where(low == high, 0, np.where(own[row] == low, 1, 2)).astype(np.int32)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(across), group.column(2).take(at), group.column(5).take(at)], names=["block", "side", "key", "copies"])

    return parts.mapInArrow(run, "block long, side int, key binary, copies long")


def overlaps(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Numbers of common values of every two sets; sets: (values, where each set begins)."""
    n, m = len(left[1]) - 1, len(right[1]) - 1
    shared, inverse, times = np.unique(np.concatenate([left[0], right[0]]), return_inverse=True, return_counts=True)
    rank = np.empty(len(shared), np.int64)
    rank[np.argsort(-times, kind="stable")] = np.arange(len(shared))
    token = rank[inverse]
    entries = []
    for values, begin in ((token[: len(left[0])], left[1]), (token[len(left[0]) :], right[1])):
        entries.append((values, np.repeat(np.arange(len(begin) - 1), np.diff(begin))))
    dense = []
    for (values, own), size in zip(entries, (n, m), strict=True):
        table = np.zeros((size, min(DENSE, len(shared))), np.float32)
        table[own[values < DENSE], values[values < DENSE]] = 1
        dense.append(table)
    common = np.rint(dense[0] @ dense[1].T).astype(np.int64)
    (a, own_a), (b, own_b) = [(v[v >= DENSE], o[v >= DENSE]) for v, o in entries]
    order = np.argsort(b, kind="stable")
    b, own_b = b[order], own_b[order]
    first, last = np.searchsorted(b, a), np.searchsorted(b, a, side="right")
    found = last - first
    for k in _slices(found, 1 << 22):
        reps = found[k]
        place = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(first[k], reps)
        common += np.bincount(np.repeat(own_a[k], reps) * m + own_b[place], minlength=n * m).reshape(n, m)
    return common


def _slices(sizes: np.ndarray, most: int) -> list[slice]:
    """Consecutive places whose sizes sum to about ``most``."""
    part = (np.cumsum(sizes) - sizes) // most
    cuts = np.flatnonzero(np.r_[True, np.diff(part) != 0, True]) if len(sizes) else []
    return [slice(i, j) for i, j in zip(cuts[:-1], cuts[1:])]


def _taken(values: np.ndarray, begin: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets at some places."""
    size = (begin[1:] - begin[:-1])[at]
    start = np.r_[0, np.cumsum(size)]
    return values[np.arange(start[-1]) - np.repeat(start[:-1], size) + np.repeat(begin[at], size)], start


def _similar(side: np.ndarray, lists: pa.Array, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and similarities of the pairs of sets that reach the threshold."""
    values, begin = _flat(lists)
    size = np.diff(begin)
    for a, b in _block_pairs(side, size, np.maximum(1, np.minimum(BLOCK, (1 << 24) // np.maximum(size, 1))), threshold):
        common = overlaps(_taken(values, begin, a), _taken(values, begin, b))
        likeness = common / (size[a][:, None] + size[b][None, :] - common)
        near = likeness >= threshold
        i, j = np.nonzero(np.triu(near, 1) if a[0] == b[0] else near)
        yield a[i], b[j], likeness[i, j]


def similar_pairs(dealt: DataFrame, threshold: float) -> DataFrame:
    """(x, y, similarity) of all pairs that reach the threshold, in any order, from (task, side, id, n, set)."""
    kind = dealt.schema[2].dataType
    schema = T.StructType([T.StructField("x", kind), T.StructField("y", kind), T.StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches):
            ids = group.column(2)
            for i, j, likeness in _similar(np.asarray(group.column(1)), group.column(4), threshold):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(likeness)], names=schema.names)

    return dealt.mapInArrow(run, schema)


def links_in_blocks(blocks: DataFrame, threshold: float) -> DataFrame:
    """(key, links, other) of sets with similar ones in their block, from (block, side, key, copies, set): copies of these, and a set they are connected to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches):
            if group.num_rows < 2:
                continue
            copies = np.asarray(group.column(3))
            root, links = np.arange(len(copies)), np.zeros(len(copies), np.int64)
            for i, j, _ in _similar(np.asarray(group.column(1)), group.column(4), threshold):
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                _united(root, i, j)
            at = np.flatnonzero(links)
            key = group.column(2)
            yield pa.RecordBatch.from_arrays([key.take(pa.array(at)), pa.array(links[at]), key.take(pa.array(root[at]))], names=["key", "links", "other"])

    return blocks.mapInArrow(run, "key binary, links long, other binary")
