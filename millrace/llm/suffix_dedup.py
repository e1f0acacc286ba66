"""Removal of long repeated byte strings across a corpus, by sharded suffix arrays.

Every byte covered by a ``LENGTH``-byte string that starts anywhere else goes.
Suffixes are dealt to shards by content, so that equal strings meet, and each
shard sorts its suffixes by induction with their common prefixes.

* A window (the string of LENGTH bytes at a place) is dealt by its anchor: the
  GRAM-byte string inside it with the least hash. Equal windows have equal
  anchors at equal places. Neighbouring windows with one anchor form a
  segment, about one for every seventy windows.
* Segments are counted by anchor and content. A segment that occurs twice is
  repeated as a whole. Only where one anchor has segments of different content can a
  part of them be repeated; their bytes alone are sent to the shard of their anchor.
* A shard arrives through Spark's external sort, in the order of anchors, and is worked off in parts of
  bounded size: shards may be far larger than memory. Each part's suffix array and common-prefix
  values are induced (``induced_sort``); neighbours that share LENGTH bytes mark each other.
* What is repeated goes back to the texts by segment, and each text is cut once.

Filters of a fixed size keep segments and texts without a repetition from being
shuffled; the joins behind them are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm import fixed_filter, textarrays as ta
from millrace.llm.carried import Carried
from millrace.llm.induced_sort import suffix_array
from millrace.llm.joins import join_groups
from millrace.llm.storage import stored

LENGTH = 200
GRAM = 64
#: Bytes of segments that a shard's task sorts at once, about.
PART_BYTES = 1 << 20
#: Contents of one anchor that one task sorts; about 300 bytes each. More of them are dealt anew, by anchors of the next level.
MOST_CONTENTS = 4096
WHOLE_LEVEL = 4

_U = np.uint64


@dataclass
class Segments:
    """Runs of neighbouring windows with one anchor."""

    anchor: np.ndarray  # hash of the anchor's bytes
    content: np.ndarray  # hash of the segment's bytes and the anchor's place in them
    start: np.ndarray  # first window's start
    windows: np.ndarray  # number of windows
    text: np.ndarray


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    least, have = x, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    rest = width - have
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def segments(data: np.ndarray, offsets: np.ndarray, level: int = 0) -> Segments:
    """All segments of the texts; texts shorter than ``LENGTH`` have none.

    Each level chooses anchors by another order; from ``WHOLE_LEVEL`` on a window is its own anchor.
    """
    length, gram = LENGTH, GRAM if level < WHOLE_LEVEL else LENGTH
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return Segments(none.astype(np.uint64), none.astype(np.uint64), none, none, none)
    prefix = ta.prefix_hash(data)
    order = ta.rough_grams(data, gram)
    order = ta.mix(order + _U(level)) if level else order
    packed = (order & _U(0xFFFFFFFF00000000)) | np.arange(n - gram + 1, dtype=np.uint64)
    least = (_sliding_least(packed, length - gram + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(len(least))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    valid = starts + length <= offsets[text + 1]
    starts, text = starts[valid], text[valid]
    if not len(starts):
        return Segments(none.astype(np.uint64), none.astype(np.uint64), none, none, none)
    at = least[starts]
    opens = np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])]
    first = np.flatnonzero(opens)
    windows = np.diff(np.r_[first, len(starts)])
    begin, anchor = starts[first], at[first]
    content = ta.mix(ta.span_hash(prefix, begin, begin + windows + length - 1) + (anchor - begin).astype(np.uint64))
    return Segments(ta.span_hash(prefix, anchor, anchor + gram), content, begin, windows, text[first])


def _digest(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    keys = ta.text_keys(data, offsets)
    raw = data.tobytes()
    return [
        ta.longs(keys[:, 0]),
        ta.longs(keys[:, 1]),
        pa.array(np.diff(offsets)),
        pa.array([hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]),
    ]


def _census(level: int):
    """Anchor and content of every segment."""

    def run(data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        s = segments(data, offsets, level)
        return pa.RecordBatch.from_arrays([ta.longs(s.anchor), ta.longs(s.content)], names=["anchor", "content"])

    return run


def _bodies(sent, level: int):
    """Bytes of the segments whose anchor may have several contents."""

    def run(data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        s = segments(data, offsets, level)
        at = np.flatnonzero(fixed_filter.holds(sent.value, s.anchor))
        at = at[np.unique(s.content[at], return_index=True)[1]]
        raw = data.tobytes()
        body = [raw[i : i + w + LENGTH - 1] for i, w in zip(s.start[at], s.windows[at], strict=True)]
        return pa.RecordBatch.from_arrays([ta.longs(s.anchor[at]), ta.longs(s.content[at]), pa.array(body, pa.binary())], names=["anchor", "content", "body"])

    return run


def _places(sent, level: int):
    """Where the segments are that may be repeated in part or whole."""

    def run(data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        s = segments(data, offsets, level)
        keys = ta.text_keys(data, offsets)
        at = np.flatnonzero(fixed_filter.holds(sent.value, s.content))
        own = keys[s.text[at]]
        return pa.RecordBatch.from_arrays(
            [ta.longs(own[:, 0]), ta.longs(own[:, 1]), ta.longs(s.anchor[at]), ta.longs(s.content[at]), pa.array(s.start[at] - offsets[s.text[at]]), pa.array(s.windows[at])],
            names=["k1", "k2", "anchor", "content", "start", "windows"],
        )

    return run


def _repeated_windows(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(body, window) of the windows that stand in several of the bodies.

    Suffixes are sorted by induction with their common prefixes; neighbours that share LENGTH bytes
    form groups. Suffixes that begin too late in a body for a window do not count.
    """
    size = np.array([len(b) for b in bodies])
    offsets = np.r_[0, np.cumsum(size)]
    order, common = suffix_array(np.frombuffer(b"".join(bodies), np.uint8), LENGTH)
    owner = np.repeat(np.arange(len(bodies), dtype=np.int32), size)
    inside = order + LENGTH <= offsets[owner[order] + 1]
    group = np.cumsum(common < LENGTH)
    many = np.bincount(group[inside], minlength=group[-1] + 1) > 1
    at = np.sort(order[inside & many[group]])
    return owner[at], at - offsets[owner[at]]


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, content, body), sorted by anchor, to the repeated windows of each segment as runs (first, number).

    Windows of different anchors differ, so a shard is sorted in parts of whole anchors.
    """

    def part(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        owner, number = _repeated_windows(table["body"].to_pylist())
        opens = np.r_[True, (owner[1:] != owner[:-1]) | (number[1:] != number[:-1] + 1)][: len(owner)]
        first = np.flatnonzero(opens)
        of = pa.array(owner[first])
        runs = np.diff(np.r_[first, len(owner)])
        return pa.RecordBatch.from_arrays(
            [table["anchor"].combine_chunks().take(of), table["content"].combine_chunks().take(of), pa.array(number[first].astype(np.int32)), pa.array(runs.astype(np.int32))],
            names=["anchor", "content", "first", "number"],
        )

    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = np.asarray(batch.column(0))
        cuts = np.r_[0, np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if size >= PART_BYTES and anchor[i] != last:
                yield part(held)
                held, size = [], 0
            held.append(batch.slice(i, j - i))
            size += sum(map(len, held[-1].column(2).to_pylist()))
            last = anchor[i]
    if held:
        yield part(held)


def repeated_segments(docs: DataFrame, text: str, level: int = 0) -> DataFrame:
    """(anchor, content, runs): repeated windows of segments as runs (first, number); null for all of them."""
    counts = stored(ta.read_texts(docs, text, "anchor long, content long", _census(level)).groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n")))
    several = stored(counts.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1"))
    sent = docs.sparkSession.sparkContext.broadcast(fixed_filter.build(several, "anchor"))
    bodies = ta.read_texts(docs, text, "anchor long, content long, body binary", _bodies(sent, level)).groupBy("anchor", "content").agg(F.first("body").alias("body"))
    unclear = bodies.join(several.hint("merge"), "anchor").select("anchor", "content", "body", "contents")
    hot_anchors = not several.where(F.col("contents") > MOST_CONTENTS).isEmpty()
    unclear = stored(unclear) if hot_anchors else unclear  # read twice
    one_task = unclear.where(F.col("contents") <= MOST_CONTENTS).drop("contents")
    found = one_task.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shard, "anchor long, content long, first int, number int")
    if hot_anchors:
        # The segments of a hot anchor are texts of their own, whose windows are dealt by other anchors.
        hot = stored(unclear.where(F.col("contents") > MOST_CONTENTS).select("anchor", "content", "body"))
        spans = _spans(repeated_segments(hot, "body", level + 1), hot, "body", level + 1)
        keyed = ta.with_text_columns(hot, "body", [("k1", "long"), ("k2", "long")], lambda d, o: [ta.longs(k) for k in ta.text_keys(d, o).T], keep=["anchor", "content"])
        told = keyed.join(spans.hint("merge"), ["k1", "k2"]).select("anchor", "content", F.explode("spans").alias("x"))
        found = found.union(told.select("anchor", "content", F.col("x.first").cast("int"), F.col("x.number").cast("int")))
    runs = found.groupBy("anchor", "content").agg(F.collect_list(F.struct("first", "number")).alias("runs"))
    whole = counts.where("n > 1").select("anchor", "content")
    return stored(_merged(whole, runs))


def _merged(whole: DataFrame, runs: DataFrame) -> DataFrame:
    """Segments repeated as a whole, and the runs of the others."""
    none = F.lit(None).cast("array<struct<first:int,number:int>>")
    return whole.withColumn("runs", none).union(runs.join(whole, ["anchor", "content"], "left_anti").select("anchor", "content", "runs"))


def _spans(found: DataFrame, docs: DataFrame, text: str, level: int = 0) -> DataFrame:
    """(k1, k2, spans): repeated windows of each text as runs of starts (first, number)."""
    sent = docs.sparkSession.sparkContext.broadcast(fixed_filter.build(found, "content"))
    places = ta.read_texts(docs, text, "k1 long, k2 long, anchor long, content long, start long, windows long", _places(sent, level)).distinct()
    runs = F.coalesce("runs", F.array(F.struct(F.lit(0).alias("first"), F.col("windows").cast("int").alias("number"))))
    moved = F.transform(runs, lambda r: F.struct((F.col("start") + r["first"]).alias("first"), r["number"].cast("long").alias("number")))
    return places.join(found.hint("merge"), ["anchor", "content"]).groupBy("k1", "k2").agg(F.flatten(F.collect_list(moved)).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, body, firsts, numbers) to what is left of each text."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for body, firsts, numbers in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
            raw = np.frombuffer(body.as_py(), np.uint8)
            first, number = np.asarray(firsts.values), np.asarray(numbers.values)
            gone = ta.covered(first, number + LENGTH - 1, len(raw))
            edges = np.diff(np.r_[False, gone].astype(np.int8))
            opens = np.flatnonzero(edges == 1)
            closes = np.flatnonzero(np.diff(np.r_[gone, False].astype(np.int8)) == -1) + 1
            out[0].append(int(gone.sum()))
            out[1].append(len(opens))
            out[2].append(raw[~gone].tobytes())
            out[3].append([{"first": int(i), "end": int(j)} for i, j in zip(opens, closes, strict=True)])
        left = [hashlib.sha256(b).hexdigest() for b in out[2]]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(left, pa.string()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))],
            names=["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept", "spans"],
        )


def remove_repeats(docs: DataFrame, text: str = "text", keep: list[str] | None = None, bodies: bool = True) -> DataFrame:
    """Add to each document what its repeated strings leave.

    n_bytes; n_removed: bytes covered by a string of 200 bytes that also starts elsewhere;
    n_spans: maximal removed runs; kept_sha256 of the bytes left, and with ``bodies`` also kept (those bytes, as
    binary: a cut may split a character) and spans (first, end in bytes).

    Defined cases: null is the empty text; texts of fewer than 200 bytes stay
    whole; of repeated texts every occurrence goes; matches never cross documents;
    repeated rows are documents of their own; an empty table gives no rows;
    input columns named as a result are replaced.
    """
    own = Carried(docs, ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "spans"] if bodies else [])], keep)
    docs, text = own.rows, own.find(text)
    fields = [("k1", "long"), ("k2", "long"), ("n_bytes", "long"), ("whole_sha256", "string")]
    rows = ta.with_text_columns(docs, text, fields, _digest, keep=own.columns())
    rows = rows if bodies else stored(rows)
    spans = stored(_spans(repeated_segments(docs, text), docs, text))
    sent = docs.sparkSession.sparkContext.broadcast(fixed_filter.build(spans, "k1"))

    def asked(data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        keys = ta.text_keys(data, offsets)
        at = np.flatnonzero(fixed_filter.holds(sent.value, keys[:, 0]))
        raw = data.tobytes()
        return pa.RecordBatch.from_arrays([ta.longs(keys[at, 0]), ta.longs(keys[at, 1]), pa.array([raw[offsets[i] : offsets[i + 1]] for i in at], pa.binary())], names=["k1", "k2", "body"])

    one_each = ta.read_texts(docs, text, "k1 long, k2 long, body binary", asked).groupBy("k1", "k2").agg(F.first("body").alias("body"))
    wanted = one_each.join(spans.hint("merge"), ["k1", "k2"]).select("k1", "k2", "body", F.col("spans.first").alias("firsts"), F.col("spans.number").alias("numbers"))
    schema = "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<first:long,end:long>>"
    cut = wanted.mapInArrow(_cut, schema)
    more = ["kept", "spans"] if bodies else []
    cut = stored(cut.select("k1", "k2", "n_removed", "n_spans", F.col("kept_sha256").alias("cut_sha256"), *more))
    joined = join_groups(rows, cut, ["k1", "k2"], 160 if not bodies else 1 << 20)
    return joined.select(
        *own.restored(),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"),
        *more,
    )
