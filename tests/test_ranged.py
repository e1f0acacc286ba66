"""FASTQ, SEG-Y and EDF by byte ranges."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.sources import ranged as R


def fails(df, message, column):
    for run in (lambda: df.count(), lambda: df.select(column).collect(), lambda: df.agg(F.max(column)).collect()):
        with pytest.raises(Exception, match=message):
            run()


def reads(rng, n):
    out = []
    for i in range(n):
        k = rng.randint(0, 30)
        quality = "".join(rng.choice("@+IF!#") for _ in range(k))
        out.append((f"r{i}", rng.choice(["", "a b", "@x +y"]), "".join(rng.choice("ACGTN") for _ in range(k)), quality))
    return out


def fastq(rows, end="\n"):
    return "".join(f"@{n}{' ' + d if d else ''}{end}{s}{end}+{n if i % 3 == 0 else ''}{end}{q}{end}" for i, (n, d, s, q) in enumerate(rows))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("split", [1 << 20, 97, 31])
def test_fastq(spark, tmp_path, split, end):
    rng = random.Random(split)
    rows = reads(rng, 150)
    (tmp_path / "a.fastq").write_bytes(fastq(rows, end).encode())
    (tmp_path / "b.fastq").write_bytes(b"\n" + fastq(rows[:3]).rstrip().encode() + b"\n\n" if rows[2][3] else fastq(rows[:3]).encode())
    (tmp_path / "_log").write_text("not a read")
    got = R.read_fastq(spark, str(tmp_path), split)
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(rows + rows[:3])
    if split < 1000:
        assert got.rdd.getNumPartitions() > 20


def test_malformed_reads_fail(spark, tmp_path):
    good = fastq(reads(random.Random(1), 40))
    for i, bad in enumerate(("@x\nACGT\n+\nII\n", "@x\nACGT\nIIII\n@y\n", "@ nameless\nA\n+\nI\n", "@x\nACGT\n", "no read at all\n")):
        for split in (1 << 20, 200):
            path = tmp_path / f"{i}_{split}.fastq"
            path.write_text(good + bad + (good if i != 3 else ""))
            fails(R.read_fastq(spark, str(path), split), "no read|without a name", "quality")
    with pytest.raises(Exception, match="absent"):
        R.read_fastq(spark, str(tmp_path / "absent")).count()


def ibm(x):
    if x == 0:
        return 0
    sign, x, e = (1 << 31 if x < 0 else 0), abs(x), 64
    while x >= 1:
        x, e = x / 16, e + 1
    while x < 1 / 16:
        x, e = x * 16, e - 1
    return sign | e << 24 | int(x * (1 << 24))


def segy(traces, kind, samples, more=0, odd=None):
    head = bytearray(3600 + 3200 * more)
    struct.pack_into(">HhhH", head, 3216, 2000, 0, samples, 0)
    struct.pack_into(">h", head, 3224, kind)
    struct.pack_into(">h", head, 3504, more)
    out = bytes(head)
    for i, t in enumerate(traces):
        h = bytearray(240)
        struct.pack_into(">i", h, 20, 100 + i)
        struct.pack_into(">i", h, 72, -5 * i)
        struct.pack_into(">H", h, 114, odd if odd is not None and i == 2 else samples)
        out += bytes(h) + (b"".join(struct.pack(">I", ibm(x)) for x in t) if kind == 1 else np.array(t).astype({5: ">f4", 3: ">i2", 2: ">i4", 8: ">i1"}[kind]).tobytes())
    return out


@pytest.mark.parametrize("kind,more", [(1, 0), (5, 2), (3, 0), (2, 1), (8, 0)])
def test_segy(spark, tmp_path, kind, more):
    rng = random.Random(kind)
    traces = [[float(rng.randint(-100, 100)) + (0.25 if kind in (1, 5) else 0) for _ in range(25)] for _ in range(60)] + [[0.0] * 25]
    path = tmp_path / "a.sgy"
    path.write_bytes(segy(traces, kind, 25, more))
    got = R.read_segy(spark, str(path), 1000)
    assert got.rdd.getNumPartitions() > 10
    rows = sorted(got.collect(), key=lambda r: r.trace_index)
    assert [r.data for r in rows] == traces and [(r.header["cdp"], r.header["source_x"]) for r in rows] == [(100 + i, -5 * i) for i in range(61)]


def test_malformed_traces_fail(spark, tmp_path):
    traces = [[1.0, 2.0]] * 5
    for name, content in (("cut", segy(traces, 5, 2)[:-1]), ("kind", segy([], 5, 2).replace(b"\x00\x05", b"\x00\x09")), ("odd", segy(traces, 5, 2, odd=9)), ("head", b"x" * 100), ("none", segy([], 5, 0))):
        path = tmp_path / f"{name}.sgy"
        path.write_bytes(content)
        fails(R.read_segy(spark, str(path)), "whole traces|of kind|has 9 samples|cut off", "trace_index")


def edf(records, samples, n=None, low=-100.0, high=100.0):
    k = len(samples)
    pad = lambda x, w: str(x).ljust(w)[:w]
    head = pad(0, 8) + pad("", 160) + pad("01.01.24", 8) + pad("00.00.00", 8) + pad(256 * (k + 1), 8) + pad("", 44) + pad(len(records) if n is None else n, 8) + pad(2, 8) + pad(k, 4)
    for values, w in (([f"s{i}" for i in range(k)], 16), ([""] * k, 80), (["uV"] * k, 8), ([low] * k, 8), ([high] * k, 8), ([-1000] * k, 8), ([1000] * k, 8), ([""] * k, 80), (samples, 8), ([""] * k, 32)):
        head += "".join(pad(v, w) for v in values)
    return head.encode() + b"".join(np.array([x for signal in r for x in signal], "<i2").tobytes() for r in records)


def test_edf(spark, tmp_path):
    rng = random.Random(2)
    samples = [4, 1, 10]
    records = [[[rng.randint(-1000, 1000) for _ in range(s)] for s in samples] for _ in range(30)]
    for name, n in (("known", None), ("open", -1)):
        path = tmp_path / f"{name}.edf"
        path.write_bytes(edf(records, samples, n))
        got = R.read_edf(spark, str(path), 100)
        assert got.rdd.getNumPartitions() == 10
        rows = sorted(got.collect(), key=lambda r: (r.record, r.signal_index))
        assert len(rows) == 90 and all(r.n_samples == 30 * samples[r.signal_index] and r.sample_rate == samples[r.signal_index] / 2 and r.label == f"s{r.signal_index}" for r in rows)
        assert all(r.data == pytest.approx([x / 10 for x in records[r.record][r.signal_index]]) for r in rows)
    for name, content in (("cut", edf(records, samples)[:-1]), ("more", edf(records, samples, 31)), ("open", edf(records, samples, -1)[:-3]), ("head", b"0" * 300), ("text", b"x" * 2000), ("none", edf(records, [0, 0, 0]))):
        path = tmp_path / f"bad_{name}.edf"
        path.write_bytes(content)
        fails(R.read_edf(spark, str(path)), "whole data records|cut off|invalid literal|without a range", "label")
