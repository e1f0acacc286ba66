"""Arrays over whole texts: words, hashes and n-grams of an Arrow batch at once.

Everything here works on the UTF-8 bytes of many texts laid end to end, with
``offsets[i]:offsets[i + 1]`` as the bytes of text ``i``.  Batches are cut into
runs of texts of about ``RUN_BYTES``, so a task's memory follows that size (or
the longest single text), not the partition's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from millrace.llm.carried import Carried

RUN_BYTES = 1 << 20
#: Bytes of an Arrow batch; a worker holds a few of them at a time.
BATCH_BYTES = 8 << 20

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Spans are hashed modulo the prime 2**31 - 1 under two bases at once. Modulo a power of two, strings
#: such as two Thue-Morse words are equal under every base.
_PRIME = (1 << 31) - 1
_P, _31 = _U(_PRIME), _U(31)
#: Bytes under one table of powers, and of those that are worked on at a time.
_CHUNK, _CACHED = 1 << 20, 1 << 15


def _fold(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime."""
    x = (x & _P) + (x >> _31)
    x = (x & _P) + (x >> _31)
    return x - (x >= _P) * _P


class _Base:
    """Powers of a base and of its inverse modulo the prime."""

    def __init__(self, seed: int):
        self.up = 2 + int(mix(np.array([seed], np.uint64))[0]) % (_PRIME - 3)
        self.down = pow(self.up, -1, _PRIME)
        self.tables: dict[int, np.ndarray] = {}

    def table(self, base: int) -> np.ndarray:
        if base not in self.tables:
            powers = np.ones(1, np.uint64)
            while len(powers) < _CHUNK:
                powers = np.r_[powers, _fold(powers * _U(pow(base, len(powers), _PRIME)))]
            self.tables[base] = powers
        return self.tables[base]

    def downs(self, at: np.ndarray) -> np.ndarray:
        """Powers of the inverse."""
        table = self.table(self.down)
        if not len(at) or int(at.max()) < _CHUNK:
            return table[at]
        far = np.array([pow(self.down, _CHUNK * k, _PRIME) for k in range(int(at.max()) // _CHUNK + 1)], np.uint64)
        return _fold(table[at % _CHUNK] * far[at // _CHUNK])


#: Two pairs of bases: two keys of one text are independent.
_PAIRS = [(_Base(11), _Base(12)), (_Base(13), _Base(14))]
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, step: np.uint64) -> np.ndarray:
    """step ** 0 .. step ** _CHUNK, kept between calls."""
    if name not in _powers:
        steps = np.full(_CHUNK + 1, step, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name]


def rough_grams(data: np.ndarray, width: int) -> np.ndarray:
    """A number for each ``width`` neighbouring bytes, for choices alone: different bytes may have equal numbers."""
    n = len(data) - width + 1
    out = np.empty(max(n, 0), np.uint64)
    sums = np.zeros(_CACHED + width + 1, np.uint64)
    for i in range(0, n, _CACHED):
        part = data[i : min(i + _CACHED, n) + width - 1]
        own = out[i : i + len(part) - width + 1]
        values = _BYTE[part]
        values *= _power("up", _STEP)[: len(part)]
        np.cumsum(values, out=sums[1 : len(part) + 1])
        np.subtract(sums[width : width + len(own)], sums[: len(own)], out=own)
        own *= _power("down", _BACK)[: len(own)]
        own *= _STEP
    return out


def byte_set(members: bytes | range) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None and body.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of at most ``limit`` bytes, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def prefix_hash(codes: np.ndarray, pair: int = 0) -> np.ndarray:
    """Running polynomial sums of bytes or other small numbers under a pair of bases: (2, places + 1), for ``span_hash``."""
    n = len(codes)
    out = np.empty((2, n + 1), np.uint64)
    out[:, 0] = 0
    wide = codes.dtype != np.uint8
    for i in range(0, n, _CACHED):
        part = codes[i : i + _CACHED].astype(np.uint64)
        part += _U(1)
        for row, base in zip(out, _PAIRS[pair], strict=True):
            far, near = divmod(i, _CHUNK)
            values = part * base.table(base.up)[near : near + len(part)]
            own = row[i + 1 : i + 1 + len(part)]
            np.cumsum(_fold(values) if wide else values, out=own)
            if far:
                own[:] = _fold(_fold(own) * _U(pow(base.up, far * _CHUNK, _PRIME)))
            own += _fold(row[i : i + 1]) if near == 0 else row[i]
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, pair: int = 0) -> np.ndarray:
    """64-bit hash of the codes start:end, wherever they stand; different spans differ but by chance."""
    out = np.empty(len(start), np.uint64)
    for i in range(0, len(start), _CACHED):
        first, last = start[i : i + _CACHED], end[i : i + _CACHED]
        a, b = (_fold((_fold(row[last]) + _P - _fold(row[first])) * base.downs(first)) for row, base in zip(prefix, _PAIRS[pair], strict=True))
        out[i : i + _CACHED] = mix(((a << _31) | b) + (last - first).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return out


def gap_hash(prefix: np.ndarray, start: np.ndarray, gap: np.ndarray, end: np.ndarray, pair: int = 0) -> np.ndarray:
    """The ``span_hash`` that the codes start:end have without the one at gap."""
    out = np.empty(len(start), np.uint64)
    for i in range(0, len(start), _CACHED):
        first, at, last = start[i : i + _CACHED], gap[i : i + _CACHED], end[i : i + _CACHED]
        parts = []
        for row, base in zip(prefix, _PAIRS[pair], strict=True):
            head = _fold((_fold(row[at]) + _P - _fold(row[first])) * base.downs(first))
            parts.append(_fold(head + _fold((_fold(row[last]) + _P - _fold(row[at + 1])) * base.downs(first + 1))))
        a, b = parts
        out[i : i + _CACHED] = mix(((a << _31) | b) + (last - first - 1).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return out


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of bytes that are inside."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def ngrams(items: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive items of one text, and the place of the first."""
    m = len(items) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(text[:m] == text[n - 1 :])
    value = items[at].copy()
    for k in range(1, n):
        value = value * _STEP + items[at + k]
    return mix(value), at


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def per_text_spans(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many flags are set in each span."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[end] - sums[start]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(in a group of equal keys of two or more, equal to an earlier key)."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    later, member = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    member[order[1:]] = same
    member[order[:-1]] |= same
    return member, later


def covered(start: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places lie in a run start:start+length."""
    change = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(start + length, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0


Compute = Callable[[np.ndarray, np.ndarray], list[pa.Array]]


def with_text_columns(df: DataFrame, text: str, fields: list[tuple[str, str]], compute: Compute, keep: list[str] | None = None, mask: str | None = None) -> DataFrame:
    """``df`` with columns computed from whole texts, batch by batch in Arrow.

    compute(bytes, offsets) gives an array for each field.  keep: columns to
    carry (default: all).  Columns named as a returned field are replaced; any other name is carried.
    mask: a boolean field that is not returned; rows where it is false go.
    """
    returned = [x for x in fields if x[0] != mask]
    own = Carried(df, [n for n, _ in returned], keep)
    body = own.find(text)
    places = own.columns()
    schema = T.StructType([own.rows.schema[c] for c in places] + [T.StructField(f"made{k}", T._parse_datatype_string(t)) for k, (_, t) in enumerate(returned)])
    n_keep = len(places)
    carried = body in places and isinstance(own.rows.schema[body].dataType, T.StringType)
    at = places.index(body) if carried else n_keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            for i, j in runs(offsets):
                part = offsets[i : j + 1]
                results = compute(data[part[0] : part[-1]], part - part[0])
                named = dict(zip([n for n, _ in fields], results, strict=True))
                columns = [batch.column(k).slice(i, j - i) for k in range(n_keep)] + [named[n] for n, _ in returned]
                out = pa.RecordBatch.from_arrays(columns, names=schema.names)
                yield out.filter(named[mask]) if mask else out

    extra = [] if carried else [F.col(body).cast("string").alias("body")]
    limit_batches(df)
    made = own.rows.select(*places, *extra).mapInArrow(run, schema)
    return made.toDF(*[own.names[i] for i in own.kept], *[n for n, _ in returned])


def limit_batches(df: DataFrame) -> None:
    """Send texts to Python in batches of at most ``BATCH_BYTES``, unless the session asks for less."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(conf.get(name)).rstrip("b")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))


def text_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two independent hashes of each text: (texts, 2)."""
    return np.stack([span_hash(prefix_hash(data, pair), offsets[:-1], offsets[1:], pair) for pair in (0, 1)], axis=1)


def longs(x: np.ndarray) -> pa.Array:
    """Unsigned numbers as Spark's longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def read_texts(df: DataFrame, text: str, schema: str, run: Callable[[np.ndarray, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """Rows made by run(bytes, offsets) of each run of texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for i, j in runs(offsets):
                own = offsets[i : j + 1]
                yield run(data[own[0] : own[-1]], own - own[0])

    limit_batches(df)
    return df.select(F.col(text).cast("string").alias("body")).mapInArrow(rows, schema)


def by_group(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """Consecutive rows of equal value, from batches sorted by the column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        value = np.asarray(batch.column(column))
        cuts = np.r_[0, np.flatnonzero(value[1:] != value[:-1]) + 1, len(value)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(i, j - i)
            if held and held[-1].column(column)[0] != part.column(column)[0]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
