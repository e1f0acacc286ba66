"""Record formats read by byte ranges: FASTQ, SEG-Y and EDF as Spark data sources.

A file of any size is cut to ranges of some ``split`` bytes, each a task's; a record belongs to the range in which it begins. Records
are parsed whole whichever columns are used, so a malformed one always fails the read. Files are opened by Arrow's file systems, on the
driver for their sizes and headers and on executors for their ranges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, of a read, and rows of a batch.
SPLIT, CHUNK, ROWS = 64 << 20, 1 << 20, 1024


class MalformedRecord(ValueError):
    """A record that does not follow its format."""


class Part(NamedTuple):
    """A range of a file: bytes, or numbers of records."""

    path: str
    start: int
    end: int


class _Range(InputPartition):
    def __init__(self, part: Part):
        self.part = part


def _opened(path: str) -> pa.NativeFile:
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of all files in a folder but those that begin with a dot or an underscore."""
    system, at = fs.FileSystem.from_uri(path)
    info = system.get_file_info(at)
    scheme = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/]*", path)
    named = lambda p: f"{scheme[0]}{p}" if scheme and not p.startswith(scheme[0]) else p
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((named(f.path), f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


class _Reader(DataSourceReader):
    """Deals files to ranges and reads them; formats give ``cut`` and ``rows``."""

    def __init__(self, source: type[_Source], options: dict):
        self.source, self.path, self.split = source, options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[_Range]:
        return [_Range(p) for path, size in _files(self.path) for p in self.source.cut(path, size, self.split)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        schema, held = self.source.arrow, []
        for row in self.source.rows(partition.part):
            held.append(row)
            if len(held) == ROWS:
                yield _batch(held, schema)
                held = []
        if held:
            yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class _Source(DataSource):
    arrow: pa.Schema
    ddl: str

    def schema(self) -> str:
        return self.ddl

    def reader(self, schema) -> _Reader:
        return _Reader(type(self), dict(self.options))

    @classmethod
    def cut(cls, path: str, size: int, split: int) -> list[Part]:
        raise NotImplementedError

    @classmethod
    def rows(cls, part: Part) -> Iterator[tuple]:
        raise NotImplementedError


# FASTQ ---------------------------------------------------------------------
def _lines(file: pa.NativeFile, at: int) -> Iterator[tuple[int, str]]:
    """(place, line) of the lines from a place on, without their ends."""
    file.seek(at)
    rest = b""
    while chunk := file.read(CHUNK):
        *whole, rest = (rest + chunk).split(b"\n")
        for line in whole:
            yield at, line.removesuffix(b"\r").decode()
            at += len(line) + 1
    if rest:
        yield at, rest.removesuffix(b"\r").decode()


def _is_read(four: list[str]) -> bool:
    return four[0].startswith("@") and four[2].startswith("+") and len(four[1]) == len(four[3])


class Fastq(_Source):
    """Reads of four lines each: @name description, sequence, + and quality."""

    ddl = "seq_id string, description string, sequence string, quality string, source_uri string"
    arrow = pa.schema([(n, pa.string()) for n in ("seq_id", "description", "sequence", "quality", "source_uri")])

    @classmethod
    def name(cls) -> str:
        return "fastq"

    @classmethod
    def cut(cls, path: str, size: int, split: int) -> list[Part]:
        return [Part(path, i, min(i + split, size)) for i in range(0, size, split)]

    @classmethod
    def rows(cls, part: Part) -> Iterator[tuple]:
        with _opened(part.path) as file:
            lines = _lines(file, max(part.start - 1, 0))
            ahead: list[tuple[int, str]] = []
            if part.start:
                next(lines, None)  # what began before the range, up to its line's end
                # A quality may begin like a name: the lines' kinds follow from four lines that fit each other.
                ahead = [x for _, x in zip(range(8), lines, strict=False)]
                first = next((k for k in range(min(4, len(ahead) - 3)) if _is_read([x[1] for x in ahead[k : k + 4]])), None)
                if first is None:
                    if len([x for x in ahead if x[1]]) >= 7:
                        raise MalformedRecord(f"{part.path}: no read begins after byte {part.start}")
                    return
                ahead = ahead[first:]

            def following() -> tuple[int, str] | None:
                return ahead.pop(0) if ahead else next(lines, None)

            while (line := following()) is not None and line[0] < part.end:
                if not line[1]:
                    continue
                four = [line[1], *[(following() or (0, None))[1] for _ in range(3)]]
                if None in four or not _is_read(four):
                    raise MalformedRecord(f"{part.path}: no read at byte {line[0]}: {four[0][:80]!r}")
                name, _, description = four[0][1:].partition(" ")
                if not name:
                    raise MalformedRecord(f"{part.path}: a read without a name at byte {line[0]}")
                yield name, description.strip(), four[1], four[3], part.path


# SEG-Y ---------------------------------------------------------------------
#: Places and types of the trace header's fields that are given; fixed values of the format.
TRACE_FIELDS = {"trace_in_line": (0, ">i4"), "field_record": (8, ">i4"), "cdp": (20, ">i4"), "offset": (36, ">i4"), "scalar": (70, ">i2"), "source_x": (72, ">i4"), "source_y": (76, ">i4"), "samples": (114, ">u2"), "interval": (116, ">u2"), "inline": (188, ">i4"), "crossline": (192, ">i4")}
_SAMPLE_BYTES = {1: 4, 2: 4, 3: 2, 5: 4, 8: 1}


def ibm_floats(words: np.ndarray) -> np.ndarray:
    """Numbers of base 16: a sign, seven bits of exponent, 24 of fraction."""
    sign = np.where(words >> 31, -1.0, 1.0)
    exponent = ((words >> 24) & 0x7F).astype(np.int64) - 64
    return (sign * (words & 0xFFFFFF) * np.exp2(4.0 * exponent - 24)).astype(np.float32)


def _samples(raw: bytes, kind: int) -> np.ndarray:
    if kind == 1:
        return ibm_floats(np.frombuffer(raw, ">u4").astype(np.uint32))
    return np.frombuffer(raw, {2: ">i4", 3: ">i2", 5: ">f4", 8: ">i1"}[kind]).astype(np.float32)


class Segy(_Source):
    """A row a trace: its place, header fields and samples."""

    ddl = "trace_index long, header map<string,long>, data array<float>, source_uri string"
    arrow = pa.schema([("trace_index", pa.int64()), ("header", pa.map_(pa.string(), pa.int64())), ("data", pa.list_(pa.float32())), ("source_uri", pa.string())])

    @classmethod
    def name(cls) -> str:
        return "segy"

    @classmethod
    def layout(cls, path: str) -> tuple[int, int, int]:
        """(first trace's place, samples a trace, kind of samples)."""
        with _opened(path) as file:
            head = file.read(3600)
        if len(head) < 3600:
            raise MalformedRecord(f"{path}: the file's header is cut off")
        at = lambda k: int(np.frombuffer(head[k : k + 2], ">i2")[0])
        samples, kind, more = at(3220) & 0xFFFF, at(3224), max(at(3504), 0)
        if kind not in _SAMPLE_BYTES or not samples:
            raise MalformedRecord(f"{path}: samples of kind {kind}, {samples} a trace")
        return 3600 + 3200 * more, samples, kind

    @classmethod
    def cut(cls, path: str, size: int, split: int) -> list[Part]:
        first, samples, kind = cls.layout(path)
        width = 240 + samples * _SAMPLE_BYTES[kind]
        if (size - first) % width or size < first:
            raise MalformedRecord(f"{path}: {size - first} bytes are no whole traces of {width}")
        n, each = (size - first) // width, max(split // width, 1)
        return [Part(path, i, min(i + each, n)) for i in range(0, n, each)]

    @classmethod
    def rows(cls, part: Part) -> Iterator[tuple]:
        first, samples, kind = cls.layout(part.path)
        width = 240 + samples * _SAMPLE_BYTES[kind]
        with _opened(part.path) as file:
            file.seek(first + part.start * width)
            for i in range(part.start, part.end):
                raw = file.read(width)
                header = {n: int(np.frombuffer(raw[k : k + np.dtype(t).itemsize], t)[0]) for n, (k, t) in TRACE_FIELDS.items()}
                if header["samples"] not in (0, samples):
                    raise MalformedRecord(f"{part.path}: trace {i} has {header['samples']} samples, not {samples}")
                yield i, list(header.items()), _samples(raw[240:], kind), part.path


# EDF -----------------------------------------------------------------------
class Edf(_Source):
    """A row a signal and data record: samples in physical units."""

    ddl = "signal_index int, label string, sample_rate double, n_samples long, physical_min double, physical_max double, record long, data array<double>, source_uri string"
    arrow = pa.schema([("signal_index", pa.int32()), ("label", pa.string()), ("sample_rate", pa.float64()), ("n_samples", pa.int64()), ("physical_min", pa.float64()), ("physical_max", pa.float64()), ("record", pa.int64()), ("data", pa.list_(pa.float64())), ("source_uri", pa.string())])

    @classmethod
    def name(cls) -> str:
        return "edf"

    @classmethod
    def layout(cls, path: str) -> dict:
        """The header's fields; of signals as lists."""
        try:
            with _opened(path) as file:
                head = file.read(256).decode("latin-1")
                n = int(head[252:256])
                rest = file.read(256 * n).decode("latin-1")
            if len(rest) != 256 * n or n < 1:
                raise ValueError("the header is cut off")
            widths, fields, at = {"label": 16, "_transducer": 80, "_dimension": 8, "physical_min": 8, "physical_max": 8, "digital_min": 8, "digital_max": 8, "_filter": 80, "samples": 8}, {}, 0
            for name, w in widths.items():
                fields[name] = [rest[at + i * w : at + (i + 1) * w].strip() for i in range(n)]
                at += n * w
            read = {k: [float(x) for x in fields[k]] for k in ("physical_min", "physical_max", "digital_min", "digital_max")}
            found = {"n": n, "label": fields["label"], "samples": [int(x) for x in fields["samples"]], "first": int(head[184:192]), "records": int(head[236:244]), "seconds": float(head[244:252]), **read}
            if any(a == b for a, b in zip(found["digital_min"], found["digital_max"], strict=True)) or min(found["samples"]) < 0 or not sum(found["samples"]):
                raise ValueError("a signal without a range or samples")
            return found
        except ValueError as wrong:
            raise MalformedRecord(f"{path}: {wrong}") from wrong

    @classmethod
    def cut(cls, path: str, size: int, split: int) -> list[Part]:
        head = cls.layout(path)
        width = 2 * sum(head["samples"])
        there, odd = divmod(size - head["first"], width)
        n = there if head["records"] < 0 else head["records"]
        if n > there or head["records"] < 0 and odd:
            raise MalformedRecord(f"{path}: {there} whole data records, not {n}")
        each = max(split // width, 1)
        return [Part(path, i, min(i + each, n)) for i in range(0, n, each)]

    @classmethod
    def rows(cls, part: Part) -> Iterator[tuple]:
        head = cls.layout(part.path)
        width = 2 * sum(head["samples"])
        with _opened(part.path) as file:
            size = file.size()
            n = (size - head["first"]) // width if head["records"] < 0 else head["records"]
            file.seek(head["first"] + part.start * width)
            for record in range(part.start, part.end):
                whole, at = np.frombuffer(file.read(width), "<i2"), 0
                for i, count in enumerate(head["samples"]):
                    low, high = head["physical_min"][i], head["physical_max"][i]
                    step = (high - low) / (head["digital_max"][i] - head["digital_min"][i])
                    data = low + (whole[at : at + count] - head["digital_min"][i]) * step
                    at += count
                    rate = count / head["seconds"] if head["seconds"] > 0 else 0.0
                    yield i, head["label"][i], rate, count * n, low, high, record, data, part.path


def _read(spark: SparkSession, source: type[_Source], path: str, split: int) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("split", split).load(path)


def read_fastq(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(seq_id, description, sequence, quality, source_uri), a row a read of four lines; blank lines between reads are skipped."""
    return _read(spark, Fastq, path, split)


def read_segy(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(trace_index, header, data, source_uri), a row a trace; samples of kinds 1 (base 16), 2, 3, 5 and 8 as floats."""
    return _read(spark, Segy, path, split)


def read_edf(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(signal_index, label, sample_rate, n_samples, physical_min, physical_max, record, data, source_uri), a row a signal and data record."""
    return _read(spark, Edf, path, split)
