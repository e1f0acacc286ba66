"""Benchmark decontamination by training suffix arrays.

Windows of the benchmark are hashed by tasks into a filter of fixed size; texts
without a window that passes it are clean.  The windows of the others meet the
benchmark's by an equi-join of their hashes, which names the items that can occur in each text.
The texts that are left are dealt to shards of bounded size, each with the
items that can occur in it.  Each shard's word suffixes are sorted (prefix
doubling over word ranks, to the depth of its longest item) and every suffix of its items is looked up by binary
search, word by word.  The intervals at window length give all places where a
window occurs; going on from there gives the longest verbatim match and its
place.  Neither the benchmark nor a text passes the driver; clean texts stay where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm import fixed_filter, textarrays as ta
from millrace.llm.carried import Carried
from millrace.llm.joins import join_rare
from millrace.llm.storage import stored

WINDOW = 13
#: Bytes of items that are searched at a time.
BLOCK_BYTES = 2 << 20
#: Bytes of texts in a shard, about.
SHARD_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = ta.byte_set([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first byte of every word; A-Z count as a-z."""
    low = _LOWER[data]
    start, end, text = ta.words(low, offsets, _INSIDE[low])
    return ta.span_hash(ta.prefix_hash(low), start, end), text, start


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes of ``tokens`` (small ints), in order of their first ``depth`` tokens.

    Each round doubles the sorted depth, and only groups that still tie are
    sorted again.
    """
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    rank = np.zeros(n + 1, dtype=np.int64)
    rank[n] = -1
    tied = np.arange(n)
    key = tokens[order].astype(np.int64)
    done = 1
    while len(tied):
        opens = np.ones(len(tied), bool)
        opens[1:] = key[1:] != key[:-1]
        first = tied[np.maximum.accumulate(np.where(opens, np.arange(len(tied)), 0))]
        rank[order[tied]] = first
        last = np.ones(len(tied), bool)
        last[:-1] = opens[1:]
        tied = tied[~(opens & last)]
        if done >= depth or not len(tied):
            break
        places = order[tied]
        key = rank[places] * (n + 1) + rank[np.minimum(places + done, n)] + 1
        by = np.argsort(key, kind="stable")
        order[tied], key = places[by], key[by]
        done *= 2
    return order


@dataclass
class Block:
    """Some benchmark items: words laid end to end, each item followed by a gap."""

    words: np.ndarray  # uint64 hashes; what stands in a gap doesn't matter
    gap: np.ndarray  # bool
    item: np.ndarray  # number of the item at each place
    window: np.ndarray  # length of the window that starts here, 0 for none
    ids: list[str]
    longest: int


def make_block(ids: list[str], texts: list[str | None], window: int) -> Block:
    data, offsets = ta.text_bytes(pa.array(texts, pa.string()))
    value, text, _ = hashed_words(data, offsets)
    counts = np.bincount(text, minlength=len(ids))
    n = len(value) + len(ids)
    place = np.arange(len(value)) + text
    words, gap = np.zeros(n, np.uint64), np.ones(n, bool)
    words[place], gap[place] = value, False
    item = np.repeat(np.arange(len(ids)), counts + 1)
    begin = np.cumsum(counts + 1) - (counts + 1)
    at = np.arange(n) - begin[item]
    length = np.where((at <= counts[item] - window) & ~gap, window, 0)
    short = (counts > 0) & (counts < window)
    length[begin[short]] = counts[short]
    return Block(words, gap, item, length, ids, int(counts.max(initial=0)))


def _bound(tokens: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray, after: bool) -> np.ndarray:
    """First place in each lo:hi whose token at depth is not below (with after: is above) want."""
    lo, hi = lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) >> 1
        value = tokens[sa[mid] + depth]
        right = value <= want[open_] if after else value < want[open_]
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


@dataclass
class Found:
    place: np.ndarray  # token places in the shard where a window starts
    length: np.ndarray
    item: np.ndarray
    longest: np.ndarray  # words that match from there on


def search(tokens: np.ndarray, sa: np.ndarray, vocabulary: np.ndarray, block: Block) -> Found:
    """All occurrences of the block's windows, by binary search of each suffix.

    tokens: ranks in the vocabulary plus 1, 0 between texts and padded with
    zeros past the longest item.
    """
    at = np.searchsorted(vocabulary, block.words)
    known = (at < len(vocabulary)) & ~block.gap
    known[known] = vocabulary[at[known]] == block.words[known]
    want = np.where(known, at + 1, -1).astype(np.int64)
    want = np.concatenate([want, np.full(block.longest + 1, -1)])
    live = np.flatnonzero((block.window > 0) & known)
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(sa), np.int64)
    found = []
    depth = 0
    while len(live):
        next_ = want[live + depth]
        low = _bound(tokens, sa, lo, hi, depth, next_, False)
        high = _bound(tokens, sa, low, hi, depth, next_, True)
        on = (low < high) & (next_ >= 0)
        live, lo, hi = live[on], low[on], high[on]
        depth += 1
        full = block.window[live] == depth
        if full.any():
            sizes = hi[full] - lo[full]
            first = np.repeat(lo[full] - (np.cumsum(sizes) - sizes), sizes)
            found.append((sa[first + np.arange(sizes.sum())], np.full(sizes.sum(), depth), np.repeat(live[full], sizes)))
        live, lo, hi = live[~full], lo[~full], hi[~full]
    if not found:
        none = np.zeros(0, np.int64)
        return Found(none, none, none, none)
    place, length, test = (np.concatenate(x) for x in zip(*found, strict=True))
    longest = length.copy()
    going = np.arange(len(place))
    while len(going):
        ahead = want[test[going] + longest[going]]
        going = going[(ahead >= 0) & (tokens[np.minimum(place[going] + longest[going], len(tokens) - 1)] == ahead)]
        longest[going] += 1
    return Found(place, length, block.item[test], longest)


def scan(data: np.ndarray, offsets: np.ndarray, blocks: list[Block]) -> dict[str, list | np.ndarray]:
    """The report of one shard: a value for each text and column."""
    value, text, start = hashed_words(data, offsets)
    n_texts = len(offsets) - 1
    n_words = np.bincount(text, minlength=n_texts)
    vocabulary, rank = np.unique(value, return_inverse=True)
    n = len(value) + n_texts
    place = np.arange(len(value)) + text
    items: list[set[str]] = [set() for _ in range(n_texts)]
    best: list[tuple[int, str, int]] = [(0, "", -1)] * n_texts
    cover = np.zeros(n, bool)
    owner = np.repeat(np.arange(n_texts), n_words + 1)
    first_byte = np.zeros(n, np.int64)
    first_byte[place] = start - offsets[text]
    sa, depth = None, 0
    for block in blocks:
        if sa is None or block.longest > depth:
            depth = max(depth, block.longest)
            tokens = np.zeros(n + depth + 1, np.int64)
            tokens[place] = rank + 1
            sa = suffix_array(tokens[:n], depth)
        got = search(tokens, sa, vocabulary, block)
        if not len(got.place):
            continue
        cover |= ta.covered(got.place, got.length, n)
        pairs = np.unique(owner[got.place] * len(block.ids) + got.item)
        for t, k in zip(*np.divmod(pairs, len(block.ids)), strict=True):
            items[t].add(block.ids[k])
        by = np.lexsort((got.place, got.item, -got.longest, owner[got.place]))
        of = owner[got.place[by]]
        for x in by[np.r_[True, of[1:] != of[:-1]]]:
            t, length, name = owner[got.place[x]], int(got.longest[x]), block.ids[got.item[x]]
            if (-length, name) < (-best[t][0], best[t][1]):
                best[t] = (length, name, int(first_byte[got.place[x]]))
    return {"n_words": n_words, "n_hit": np.bincount(owner[cover], minlength=n_texts), "items": items, "best": best}


def _window_hashes(value: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all windows of ``length`` words."""
    grams, at = ta.ngrams(value, text, length)
    return ta.mix(grams + np.uint64(length)), text[at]


def _windows_of(items: DataFrame, window: int) -> DataFrame:
    """(h, length, item) of all windows of the items (item, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ta.text_bytes(batch.column(1))
            value, text, _ = hashed_words(data, offsets)
            counts = np.bincount(text, minlength=batch.num_rows)
            for length in np.unique(np.minimum(counts[counts > 0], window)):
                h, of = _window_hashes(value, text, int(length))
                fits = np.minimum(counts[of], window) == length
                yield pa.RecordBatch.from_arrays([ta.longs(h[fits]), pa.array(np.full(int(fits.sum()), length, np.int32)), batch.column(0).take(pa.array(of[fits]))], names=["h", "length", "item"])

    ta.limit_batches(items)
    return items.select("item", "body").mapInArrow(run, "h long, length int, item long").distinct()


def _matches(docs: DataFrame, text: str, benchmark: DataFrame, item: str, item_text: str, window: int) -> DataFrame:
    """(t1, t2, n_hit, item_ids, longest_words, longest_item, longest_at) of the texts in which a window occurs, by their keys."""
    given = Carried(benchmark)
    rows = given.rows.select(F.col(given.find(item)).cast("string").alias("id"), F.col(given.find(item_text)).cast("string").alias("body"))
    items = stored(rows.where("id IS NOT NULL AND body IS NOT NULL").distinct().withColumn("item", F.xxhash64("id", "body")))
    windows = stored(_windows_of(items, window))
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())  # window at most
    sent = docs.sparkSession.sparkContext.broadcast(fixed_filter.build(windows, "h"))

    def candidates(data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        value, text, _ = hashed_words(data, offsets)
        found = []
        for length in lengths:
            h, of = _window_hashes(value, text, length)
            maybe = fixed_filter.holds(sent.value, h)
            found.append((h[maybe], of[maybe]))
        h, of = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])][: len(h)]
        h, of = h[new], of[new]
        asked = np.unique(of)
        keys = np.zeros((2, len(offsets) - 1), np.uint64)
        for t in asked:  # few texts hold a window that passes
            keys[:, t] = ta.text_keys(data[offsets[t] : offsets[t + 1]], np.array([0, offsets[t + 1] - offsets[t]]))[0]
        return pa.RecordBatch.from_arrays([ta.longs(keys[0, of]), ta.longs(keys[1, of]), ta.longs(h)], names=["t1", "t2", "h"])

    asked = ta.read_texts(docs, text, "t1 long, t2 long, h long", candidates).distinct()
    pairs = stored(asked.join(windows.select("h", "item").hint("merge"), "h").select("t1", "t2", "item").distinct())
    wanted = docs.sparkSession.sparkContext.broadcast(fixed_filter.build(pairs.select("t1").distinct(), "t1"))

    def bodies(data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        keys = ta.text_keys(data, offsets)
        at = np.flatnonzero(fixed_filter.holds(wanted.value, keys[:, 0]))
        raw = data.tobytes()
        return pa.RecordBatch.from_arrays([ta.longs(keys[at, 0]), ta.longs(keys[at, 1]), pa.array([raw[offsets[i] : offsets[i + 1]] for i in at], pa.binary())], names=["t1", "t2", "body"])

    texts = ta.read_texts(docs, text, "t1 long, t2 long, body binary", bodies).groupBy("t1", "t2").agg(F.first("body").alias("body"))
    texts = stored(texts.join(pairs.select("t1", "t2").distinct().hint("merge"), ["t1", "t2"], "left_semi"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("b")).first()["b"]
    shard = F.pmod(F.xxhash64("t1", "t2"), F.lit(max(1, math.ceil(size / SHARD_BYTES)))).alias("shard")
    asked_items = pairs.select(shard, "item").distinct().join(items.select("item", "id", "body").hint("merge"), "item")
    none = F.lit(None)
    both = texts.select(shard, F.lit(0).alias("kind"), "t1", "t2", none.cast("string").alias("id"), "body").union(
        asked_items.select("shard", F.lit(1), none.cast("long"), none.cast("long"), "id", F.col("body").cast("binary"))
    )
    schema = "t1 long, t2 long, n_hit long, item_ids array<string>, longest_words int, longest_item string, longest_at long"
    ta.limit_batches(docs)
    return both.repartition("shard").sortWithinPartitions("shard", "kind", "id").mapInArrow(lambda batches: _search_shards(batches, window), schema)


def _search_shards(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(shard, kind, t1, t2, id, body), sorted, to the matches of each shard's texts: its texts come first, then its items."""
    for group in ta.by_group(batches, 0):
        kind = np.asarray(group["kind"])
        n = int((kind == 0).sum())
        body = group["body"].combine_chunks().cast(pa.string())
        data, offsets = ta.text_bytes(body.slice(0, n))
        ids, texts = group["id"].slice(n).to_pylist(), body.slice(n).to_pylist()
        ends = np.cumsum([len(x) for x in texts]) // BLOCK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1), len(ids)]
        r = scan(data, offsets, [make_block(ids[i:j], texts[i:j], window) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i])
        hit = np.flatnonzero(r["n_hit"] > 0)
        best = [r["best"][t] for t in hit]
        own = group.slice(0, n).take(pa.array(hit))
        yield pa.RecordBatch.from_arrays(
            [
                own["t1"].combine_chunks(),
                own["t2"].combine_chunks(),
                pa.array(r["n_hit"][hit], pa.int64()),
                pa.array([sorted(r["items"][t]) for t in hit], pa.list_(pa.string())),
                pa.array([b[0] for b in best], pa.int32()),
                pa.array([b[1] for b in best], pa.string()),
                pa.array([b[2] for b in best], pa.int64()),
            ],
            names=["t1", "t2", "n_hit", "item_ids", "longest_words", "longest_item", "longest_at"],
        )


def _counted(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    low = _LOWER[data]
    _, _, text = ta.words(low, offsets, _INSIDE[low])
    keys = ta.text_keys(data, offsets)
    return [pa.array(np.bincount(text, minlength=len(offsets) - 1), pa.int64()), ta.longs(keys[:, 0]), ta.longs(keys[:, 1])]


REPORT = ["n_words", "n_hit", "item_ids", "longest_words", "longest_item", "longest_at", "contaminated"]
_COUNTED = [("n_words", "long"), ("t1", "long"), ("t2", "long")]
_CONTAMINATED = "n_hit IS NOT NULL AND n_hit > 0 AND 20 * n_hit >= n_words"


def contamination_report(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Add to each document its benchmark matches.

    n_words; n_hit: words inside an occurring window of ``window`` words (an
    item of fewer words is one window); item_ids: items with occurring windows,
    sorted as strings; longest_words, longest_item, longest_at: the longest
    verbatim run from an occurring window, its item (the least id of several) and its byte offset in the text
    (0, null, null for none); contaminated: hit words make up 5 % or more.

    Defined cases: null and empty texts have no words and are clean; items that
    are null, empty or without id never match; an empty benchmark leaves all
    clean; repeated rows each get their report; equal items all count; input
    columns named as a result are replaced, others are carried whatever their names.
    """
    own = Carried(docs, REPORT, keep)
    body = own.find(text)
    matches = stored(_matches(own.rows, body, benchmark, item, item_text, window))
    rows = ta.with_text_columns(own.rows, body, _COUNTED, _counted, keep=own.columns())
    return join_rare(rows, matches, ["t1", "t2"], 512).select(
        *own.restored(),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("longest_words", F.lit(0)).alias("longest_words"),
        "longest_item",
        "longest_at",
        F.expr(_CONTAMINATED).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` less the contaminated ones, all columns as they were.

    Defined cases as in ``contamination_report``: texts without words stay, as do all where the benchmark is empty;
    of equal contaminated rows none stays.
    """
    own = Carried(docs)
    body = own.find(text)
    matches = stored(_matches(own.rows, body, benchmark, item, item_text, window).select("t1", "t2", "n_hit"))
    rows = ta.with_text_columns(own.rows, body, _COUNTED, _counted)
    return join_rare(rows, matches, ["t1", "t2"], 64).where(f"NOT ({_CONTAMINATED})").select(*own.restored())
