"""Files, snapshot tables and streams."""

import pytest
from pyspark.sql import functions as F

from millrace.sources import files
from millrace.sources.snapshots import SnapshotTable
from millrace.streaming import events

ROWS = [(1, "a b", 1.5), (2, "c,d|e", -2.0), (3, None, 0.0)]
SCHEMA = "id int, name string, x double"


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "tsv", "psv", "jsonl"])
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame(ROWS, SCHEMA)
    files.write(df, f"{tmp_path}/t", fmt)
    assert sorted(map(tuple, files.read(spark, f"{tmp_path}/t", fmt, SCHEMA).collect())) == ROWS


def test_folder_names_the_files(spark, tmp_path):
    for part in ("a", "b"):
        files.write(spark.createDataFrame(ROWS[:1], SCHEMA), f"{tmp_path}/{part}", "parquet")
    got = files.read_folder(spark, str(tmp_path), "parquet").collect()
    assert len(got) == 2 and len({r.source_uri for r in got}) == 2
    with pytest.raises(ValueError):
        files.read(spark, "x", "nothing")


def test_partition_overwrite(spark, tmp_path):
    path = f"{tmp_path}/p"
    files.overwrite_partition(spark.createDataFrame([(1, "a"), (2, "b")], "x int, part string"), path, ["part"])
    files.overwrite_partition(spark.createDataFrame([(9, "b")], "x int, part string"), path, ["part"])
    assert sorted((r.x, r.part) for r in spark.read.parquet(path).collect()) == [(1, "a"), (9, "b")]


def test_snapshots(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    one = spark.createDataFrame([(1, "EU"), (2, "US")], "id int, region string")
    assert table.append(one, "2024-01-01") == 1
    assert table.append(one.withColumn("id", F.col("id") + 10), "2024-01-02") == 2
    assert table.merge(spark.createDataFrame([(1, "XX"), (5, "EU")], "id int, region string"), ["id"], ["region"], "2024-01-03") == 3
    assert table.overwrite(one.limit(0), "2024-01-04") == 4
    assert table.scan().count() == 0 and table.scan(version=2).count() == 4
    assert sorted(map(tuple, table.scan(as_of="2024-01-03").collect())) == [(1, "XX"), (2, "US"), (5, "EU"), (11, "EU"), (12, "US")]
    assert table.scan(version=1, equal={"region": "EU"}, columns=["id"]).collect()[0].id == 1
    assert [e["operation"] for e in table.history()] == ["append", "append", "merge", "overwrite"]


def test_second_writer_of_a_version_fails(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    table.append(spark.range(1), "2024-01-01")
    with pytest.raises(Exception):
        table._commit("append", [], "2024-01-01", 0)


def test_changes_from_a_stream(spark, tmp_path):
    schema = "offset long, id long, op string, amount long"
    inbox, table = f"{tmp_path}/in", SnapshotTable(spark, f"file://{tmp_path}/t")
    for rows in ([(1, 1, "c", 5), (2, 2, "c", 6)], [(3, 1, "u", 7), (4, 2, "d", None), (5, 3, "c", 8)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(inbox)
        stream = spark.readStream.schema(schema).json(inbox)
        events.changes_into_table(stream, table, ["id"], ["amount"], f"{tmp_path}/state").awaitTermination()
    assert sorted(map(tuple, table.scan().collect())) == [(1, 7), (3, 8)]


def _drained(df, tmp_path, name, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state-{name}").start().awaitTermination()


def test_sessions_and_repeats_of_a_stream(spark, tmp_path):
    rows = [("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:09:00"), ("u", "2024-01-01 00:30:00"), ("v", "2024-01-01 00:00:00"), ("v", "2024-01-01 00:00:00")]
    schema = "who string, at timestamp"
    df = spark.createDataFrame(rows, "who string, at string").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    _drained(events.session_stream(read(), "at", ["who"], "10 minutes", "1 hour"), tmp_path, "stays", "complete")
    got = sorted((r.who, r.start.minute, r.end.minute, r.events) for r in spark.table("stays").collect())
    assert got == [("u", 0, 19, 2), ("u", 30, 40, 1), ("v", 0, 10, 2)]
    _drained(events.deduplicate_stream(read(), ["who", "at"], "at", "1 hour"), tmp_path, "once", "append")
    assert spark.table("once").count() == 4


@pytest.mark.parametrize("fmt", ["json", "text", "xml"])
def test_other_round_trips(spark, tmp_path, fmt):
    """What is written as json is read line by line; text has one column, and XML a row element."""
    df, schema = spark.createDataFrame(ROWS, SCHEMA), SCHEMA
    if fmt == "text":
        df, schema = df.select(F.coalesce("name", F.lit("")).alias("value")), None
    options = {"rowTag": "row"} if fmt == "xml" else {}
    files.write(df, f"{tmp_path}/t", fmt, **options)
    got = files.read(spark, f"{tmp_path}/t", "jsonl" if fmt == "json" else fmt, schema, **options)
    assert sorted(map(tuple, got.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("codec", ["gzip", "bzip2", "snappy", "zstd", "lz4"])
def test_codecs(spark, tmp_path, codec):
    fmt = "csv" if codec in ("gzip", "bzip2") else "parquet"
    df = spark.createDataFrame(ROWS, SCHEMA)
    files.write(df, f"{tmp_path}/t", fmt, compression=codec if codec != "lz4" else "lz4_raw")
    assert sorted(map(tuple, files.read(spark, f"{tmp_path}/t", fmt, SCHEMA).collect())) == ROWS


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\x00\x01")
    assert [bytes(r.content) for r in files.read(spark, str(tmp_path), "binary").collect()] == [b"\x00\x01"]


def test_windows_of_a_stream_equal_the_batch(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    out = events.resample_stream(stream, "ts", "value", "1 day", "1 hour")
    out.writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/s").start().awaitTermination()
    got = {r.start: r.n for r in spark.table("days").collect()}
    batch = spark.read.parquet(f"{tmp_path}/in").groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.count("value").alias("n")).collect()
    assert got == {r.d: r.n for r in batch} and schema is not None
