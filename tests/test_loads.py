"""Loads that must fail, and rules of keys, migrations and windows by hand."""

import pytest
from pyspark.errors import PySparkException

from millrace.operators import learning as L, text as T, timeseries as S, warehouse as W


def test_duplicate_keys_fail_or_are_chosen(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 1, "c"), (None, 3, "d"), (2, 9, "e")], "k int, v int, x string")
    with pytest.raises(PySparkException, match="duplicate key"):
        W.one_per_key(rows, ["k"]).collect()
    assert sorted(r.x for r in W.one_per_key(rows, ["k"], "first", ["v"]).collect()) == ["a", "c", "e"]
    assert sorted(r.x for r in W.one_per_key(rows, ["k"], "last", ["v"]).collect()) == ["b", "d", "e"]
    with pytest.raises(ValueError):
        W.one_per_key(rows, ["k"], "first")


@pytest.mark.parametrize("body", ["no json", '{"op": "x"}', "[]", None])
def test_malformed_changes_fail(spark, body):
    rows = spark.createDataFrame([(1, '{"op": "c", "after": {"id": 1}}'), (2, body)], "offset long, body string")
    with pytest.raises(PySparkException, match="malformed change"):
        W.strict_changes(rows, "body", "id long").collect()


def test_migrations(spark):
    none = spark.createDataFrame([], "version int")
    steps = [(1, "a"), (2, "b"), (3, "c")]
    assert W.pending_migrations(none, steps) == steps
    assert W.pending_migrations(spark.createDataFrame([(1,), (2,)], none.schema), steps) == [(3, "c")]
    for bad in ([], [(2, "b")], [(1, "a"), (1, "b")], [(1, "a"), (3, "c")]):
        with pytest.raises(ValueError):
            W.pending_migrations(none, bad)


def test_windowed_deduplicate_by_key(spark):
    rows = [("k", "2024-01-01 00:00:00", 1), ("k", "2024-01-01 00:05:00", 2), ("k", "2024-01-01 00:10:00", 3), ("j", "2024-01-01 00:00:00", 2), (None, "2024-01-01 00:00:00", 1), (None, "2024-01-01 00:01:00", 1), ("k", None, 9)]
    df = spark.createDataFrame(rows, "key string, at string, o int").selectExpr("key", "to_timestamp_ntz(at) AS ts", "o")
    got = sorted((r.key or "", r.o) for r in S.windowed_deduplicate(df, ["key"], "ts", 10, "o").collect())
    assert got == [("", 1), ("j", 2), ("k", 1), ("k", 3)]
    assert S.windowed_deduplicate(df.limit(0), ["key"], "ts", 10, "o").count() == 0


def test_too_few_rows_to_walk(spark):
    with pytest.raises(ValueError):
        L.walk_forward(spark.range(10), ["id"], 8, 2, 2)


def test_windows_of_sentences(spark):
    df = spark.createDataFrame([(1, "A b.  C! D? e"), (2, None), (3, " ")], "i int, t string")
    assert [(r.chunk_index, r.chunk) for r in T.sentence_windows(df, "t", 2, 1).collect()] == [(0, "A b. C!"), (1, "C! D?"), (2, "D? e")]
