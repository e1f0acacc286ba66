"""Late events as a stream, against the batch operator."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.timeseries import late_events
from millrace.streaming import events

SCHEMA = "arrival long, who string, ts timestamp, value double"


def rows(rng, n, first=0):
    start = datetime(2024, 1, 1)
    times = [start + timedelta(seconds=60 * (first + i) - (rng.choice([0, 0, 0, 4000, 20000]) if i else 0)) for i in range(n)]
    return [(first + i, rng.choice(["a", "b", "hot", "hot", "hot", None]), None if rng.random() < 0.03 else t, None if rng.random() < 0.05 else round(rng.uniform(0, 9), 2)) for i, t in enumerate(times)]


def drained(spark, folder, out, checkpoint, **more):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    found = events.late_events_stream(stream, "arrival", "ts", "value", 3600, 1800, ["who"], **more)
    events.apply_each_batch(found, events.batch_folders(out), checkpoint).awaitTermination()
    return spark.read.parquet(out).drop("batch")


def last_of_each(df):
    newest = F.row_number().over(Window.partitionBy("who", "kind", F.when(F.col("kind") == "event", F.col("arrival")).otherwise(F.col("bucket"))).orderBy(F.desc("arrival")))
    return df.withColumn("n", newest).where("n = 1").drop("n")


def shown(df):
    return Counter((r.who, r.kind, r.arrival, r.bucket, None if r.value is None else round(r.value, 6), r.is_late) for r in df.select("who", "kind", "arrival", "bucket", "value", "is_late").collect())


@pytest.mark.parametrize("aggregation", ["sum", "count", "mean"])
def test_late_events_of_a_stream_equal_the_batch(spark, tmp_path, aggregation):
    rng = random.Random(7)
    made = [spark.createDataFrame(rng.sample(part, len(part)), SCHEMA).coalesce(1) for part in (rows(rng, 60), rows(rng, 1, 60), rows(rng, 90, 61))]
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    for part in made[:2]:
        part.write.mode("append").parquet(f"{tmp_path}/in")
    drained(spark, f"{tmp_path}/in", out, state, aggregation=aggregation)
    made[2].write.mode("append").parquet(f"{tmp_path}/in")
    got = drained(spark, f"{tmp_path}/in", out, state, aggregation=aggregation)  # another start, from the same state
    expected = late_events(spark.read.parquet(f"{tmp_path}/in"), "arrival", "ts", "value", 3600, 1800, ["who"], aggregation)
    assert shown(last_of_each(got)) == shown(expected)
    assert sum(k[1] == "correction" for k in shown(expected)) > 3


def test_buckets_are_forgotten(spark, tmp_path):
    at = lambda k, minutes: (k, "a", datetime(2024, 1, 1) + timedelta(minutes=minutes), 1.0)
    # The stream's watermark reaches the end of the first bucket and an hour after the third batch, so the fourth starts it anew.
    for part in ([at(0, 5), at(1, 50)], [at(2, 70), at(3, 6)], [at(4, 600)], [at(5, 601)], [at(6, 602)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = drained(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", retain_seconds=3600)
    found = [(r.arrival, r.value) for r in got.where("kind = 'correction'").collect()]
    assert found == [(3, 3.0)]
    spark.createDataFrame([at(7, 5), at(8, 603)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = drained(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", retain_seconds=3600)
    assert sorted(r.arrival for r in got.where("kind = 'event'").collect()) == [0, 1, 2, 3, 4, 5, 6, 8]


class Held:
    """A state variable in a dict, with its calls counted; as a value it has one key."""

    def __init__(self, calls):
        self.held, self.calls = {}, calls

    def exists(self):
        return self.containsKey()

    def get(self):
        return self.getValue()

    def update(self, value):
        self.held[()] = value

    def containsKey(self, key=()):
        self.calls["asked", bool(key)] += 1
        return key in self.held

    def getValue(self, key=()):
        self.calls["asked", bool(key)] += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls["put"] += 1
        self.held[key] = value


def test_buckets_are_asked_for_once_and_not_at_all_for_a_new_key():
    calls = Counter()
    p = events._LateEvents(["who"], 3600, 1800, "mean", None)
    p.mark, p.buckets = Held(calls), Held(calls)

    def fed(*parts):
        calls.clear()
        frames = [pd.DataFrame({"who": "a", "arrival": a, "t": pd.Series(t, dtype="float64") * 1_000_000, "value": pd.Series(v, dtype="float64")}) for a, t, v in parts]
        out = pd.concat(p.handleInputRows(("a",), iter(frames), None))
        return [tuple(None if pd.isna(x) else x for x in r) for r in out.itertuples(index=False)], calls["put"], calls["asked", True]

    # A row without a time leaves the key as it was.
    assert fed(([1], [None], [5])) == ([("a", "event", 1, None, 5, None)], 0, 0)
    # Two frames, rows out of order, one twice, one without a value: the bucket at 0 is corrected up to its last late row.
    rows, put, asked = fed(([4, 2, 3], [100, 50, 7300], [2, 1, None]), ([4, 5], [100, 7400], [2, 9]))
    assert rows == [
        ("a", "event", 2, 0, 1, False), ("a", "event", 3, 7200, None, False), ("a", "event", 4, 0, 2, True), ("a", "event", 4, 0, 2, True), ("a", "event", 5, 7200, 9, False),
        ("a", "correction", 4, 0, 5 / 3, True),
    ]
    assert (put, asked) == (2, 0)
    # Later, the buckets that the batch touches are read and written, each once; one of late rows without values has no mean.
    rows, put, asked = fed(([6, 7, 8], [200, 3700, 7500], [7, None, 1]))
    assert rows[3:] == [("a", "correction", 6, 0, 3, True), ("a", "correction", 7, 3600, None, True)]
    assert (put, asked) == (3, 3)
    assert p.buckets.held == {(0,): (4, 12.0), (3600,): (0, 0.0), (7200,): (2, 10.0)}


def test_wrong_calls(spark, tmp_path):
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path))
    for by, aggregation in (([], "sum"), (["who"], "median")):
        with pytest.raises(ValueError):
            events.late_events_stream(stream, "arrival", "ts", "value", 60, 60, by, aggregation)
