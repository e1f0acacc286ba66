"""Snapshot tables: changes that rewrite what they touch, refreshes behind a guard, backfills that resume."""

import pytest

from millrace.sources.loads import backfill, full_refresh
from millrace.sources.snapshots import SnapshotTable
from millrace.streaming import events


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    return SnapshotTable(spark, str(tmp_path / "t"))


def frame(spark, pairs, names="id long, v string"):
    return spark.createDataFrame(pairs, names)


def test_merges_rewrite_only_buckets_that_they_hit(spark, table):
    table.overwrite(frame(spark, [(i, f"a{i}") for i in range(200)] + [(None, "none")]), "2024-01-01", buckets=(["id"], 16))
    before = table.entry(1)["folders"]
    assert len(before) == 16 and table.entry(1)["buckets"] == {"keys": ["id"], "n": 16}
    table.merge(frame(spark, [(7, "new"), (900, "more"), (None, "nothing")]), ["id"], ["v"], "2024-01-02")
    after = table.entry(2)["folders"]
    assert 13 <= len(set(before) & set(after)) < 16 and len(after) == 16
    expected = {i: f"a{i}" for i in range(200)} | {7: "new", 900: "more", None: "nothing"}
    assert rows(table.scan()) == sorted(expected.items(), key=repr)
    assert rows(table.scan(as_of="2024-01-01T12")) == sorted([(i, f"a{i}") for i in range(200)] + [(None, "none")], key=repr)
    assert table.scan().columns == ["id", "v"]


def test_merges_keep_folders_without_a_key(spark, table):
    table.append(frame(spark, [(1, "a"), (2, "b")]), "1")
    table.append(frame(spark, [(3, "c")]), "2")
    first, second = table.entry(2)["folders"]
    table.merge(frame(spark, [(3, "x"), (4, "y")]), ["id"], ["v"], "3")
    assert first in table.entry(3)["folders"] and second not in table.entry(3)["folders"]
    assert rows(table.scan()) == [(1, "a"), (2, "b"), (3, "x"), (4, "y")]
    table.merge(frame(spark, [(9, "z")]), ["id"], ["v"], "4")
    assert rows(table.scan()) == [(1, "a"), (2, "b"), (3, "x"), (4, "y"), (9, "z")]
    table.delete("id < 3", "5")
    assert rows(table.scan()) == [(3, "x"), (4, "y"), (9, "z")]


def test_streamed_changes_touch_few_buckets_and_are_found_by_date(spark, table, tmp_path):
    table.overwrite(frame(spark, [(i, "a") for i in range(100)]), "2020-01-01", buckets=(["id"], 8))
    schema = "id long, v string, op string, offset long"
    for k, part in enumerate(([(1, "b", "u", 1), (1, "c", "u", 2)], [(2, None, "d", 3), (500, "n", "c", 4)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        events.changes_into_table(stream, table, ["id"], ["v"], f"{tmp_path}/state").awaitTermination()
    expected = {i: "a" for i in range(100)} | {1: "c", 500: "n"}
    del expected[2]
    assert rows(table.scan()) == sorted(expected.items(), key=repr)
    assert [e.get("batch") for e in table.history()] == [None, 0, 1]
    assert rows(table.scan(as_of="2021-01-01")) == sorted(((i, "a") for i in range(100)), key=repr)
    assert len(set(table.entry(1)["folders"]) & set(table.entry(2)["folders"])) == 7


def test_a_refresh_does_not_empty_a_table_by_mistake(spark, table):
    some, none = frame(spark, [(1, "a"), (2, "b")]), frame(spark, [])
    assert full_refresh(table, none, "0") == {"version": 1, "rows": 0}
    assert full_refresh(table, some, "1") == {"version": 2, "rows": 2}
    with pytest.raises(ValueError, match="not emptied"):
        full_refresh(table, none, "2")
    with pytest.raises(Exception, match="broken"):
        full_refresh(table, some.selectExpr("id", "raise_error('broken') AS v"), "2")
    assert rows(table.scan()) == [(1, "a"), (2, "b")] and table.versions() == [1, 2]
    assert full_refresh(table, none, "3", allow_empty=True)["rows"] == 0 and table.scan().isEmpty()


def test_a_backfill_goes_on_where_it_stopped(spark, table):
    source = frame(spark, [(k // 3, f"r{k}") for k in range(100)] + [(None, "no key")])
    first = backfill(table, source, "id", 10, "1", most=3)
    assert first == {"batches": 3, "rows": first["rows"], "last_key": "9", "done": False} and 28 <= first["rows"] <= 36
    rest = backfill(table, source, "id", 10, "2")
    assert rest["done"] and first["rows"] + rest["rows"] == 100 and rest["last_key"] == "33"
    assert rows(table.scan()) == sorted(((k // 3, f"r{k}") for k in range(100)), key=repr)
    assert backfill(table, source, "id", 10, "3") == {"batches": 0, "rows": 0, "last_key": "33", "done": True}
    grown = source.union(frame(spark, [(40, "late")]))
    assert backfill(table, grown, "id", 10, "4")["rows"] == 1
    with pytest.raises(ValueError):
        backfill(table, source, "id", 0, "5")
