"""Cases that once gave wrong results: odd vectors, malformed rows under pruning, empty sides, repeated keys, cutting marks."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import learning as L, relational as R, text as X, timeseries as S, warehouse as W
from millrace.sources import records


def put(folder, name, text):
    (folder / name).write_text(text, newline="")
    return str(folder / name)


# Vectors -------------------------------------------------------------------
def test_vectors_that_are_no_numbers_or_of_other_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [nan, 1.0]), (3, [0.0, 1.0]), (4, [inf, 1.0]), (5, [1.0, 0.0, 0.0]), (6, []), (7, [1.0, None]), (8, None), (9, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "i long, v array<double>").coalesce(1)
    found = {}
    for r in X.vector_top_k(df, df.toDF("q", "w"), "i", "v", "q", "w", 2).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.i, round(r.score, 6)))
    assert found == {1: [(1, 1.0), (9, 0.707107)], 3: [(3, 1.0), (9, 0.707107)], 9: [(9, 1.0), (1, 0.707107)], 5: [(5, 1.0)], 6: [(6, 0.0)]}
    one = {r.query_id: r.i for r in X.vector_top_k(df, df.toDF("q", "w"), "i", "v", "q", "w", 1).collect()}
    assert one == {1: 1, 3: 3, 9: 9, 5: 5, 6: 6}


# Failing reads ---------------------------------------------------------------
def fails(df, message, column):
    for run in (lambda: df.count(), lambda: df.select(column).collect(), lambda: df.groupBy().agg(F.max(column)).collect(), lambda: df.collect()):
        with pytest.raises(Exception, match=message):
            run()


@pytest.mark.parametrize("bad", ["no json", '{"op": "x", "after": {"id": 1}}', '{"after": {"id": 1}}', None])
def test_strict_changes_fail_whatever_is_read(spark, bad):
    good = json.dumps({"op": "c", "after": {"id": 1}})
    rows = spark.createDataFrame([(0, good), (1, bad)], "offset long, body string")
    assert W.strict_changes(rows.where("offset = 0"), "body", "id long").select("after.id").collect()[0][0] == 1
    fails(W.strict_changes(rows, "body", "id long"), "malformed change", "offset")


def test_readers_fail_whatever_is_read(spark, tmp_path):
    line = "1\t{}\tid\tA\tC\t{}\tPASS\tDP=1\n"
    for name, text in (("short", "1\t2\t3\n"), ("place", line.format("x", ".")), ("quality", line.format("7", "high"))):
        fails(records.read_vcf(spark, put(tmp_path, f"{name}.vcf", line.format("5", "9.5") + text)), "fewer than 8 fields|no number", "alt")
    assert records.read_vcf(spark, put(tmp_path, "good.vcf", line.format("5", "9.5"))).count() == 1
    fails(records.read_fasta(spark, put(tmp_path, "c.fa", ">a\nA\n> \nC\n")), "header without a name", "sequence")
    log = "~Well\n NULL. -999 : none\n~Curve\n D.M : depth\n G.API : gamma\n~A\n{}\n"
    fails(records.read_las(spark, put(tmp_path, "a.las", log.format("1 2 3"))), "do not fill", "source_uri")
    fails(records.read_las(spark, put(tmp_path, "b.las", log.format("1 x"))), "no number", "source_uri")
    assert records.read_las(spark, put(tmp_path, "c.las", log.format("1 -999"))).collect()[0].data == [[1.0, None]]
    for bad, message in (({"type": "Feature"}, "not a FeatureCollection"), ({"type": "FeatureCollection", "features": [{"type": "Point", "id": "1"}]}, "not a Feature")):
        fails(records.read_geojson(spark, put(tmp_path, "bad.geojson", json.dumps(bad))), message, "feature_id")


# Empty sides and values that are no numbers ------------------------------------
def test_bm25_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "i long, t string")
    asked = spark.createDataFrame([("q", "a")], "q string, s string")
    none = spark.createDataFrame([("q", " "), ("r", None)], "q string, s string")
    for d, q in ((docs.limit(0), asked), (docs, asked.limit(0)), (docs, none)):
        got = X.bm25(d, q, "i", "t", "q", "s")
        assert got.collect() == [] and got.dtypes == [("query_id", "string"), ("doc_id", "bigint"), ("score", "double")]
    assert [(r.query_id, r.doc_id) for r in X.bm25(docs, asked, "i", "t", "q", "s").collect()] == [("q", 1)]


@pytest.mark.parametrize("terms", [500_000, 0])
def test_bm25_of_many_queries(spark, monkeypatch, terms):
    import math
    import random

    monkeypatch.setattr(X, "TERMS", terms)
    monkeypatch.setattr(X, "CELLS", 50)
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))) if i % 9 else None) for i in range(60)]
    asked = [(q, " ".join(rng.choice("abcxyz") for _ in range(4))) for q in range(12)] + [(None, "a")]
    words = {i: (t or "").split() for i, t in docs}
    mean = sum(map(len, words.values())) / len(docs)
    df = {w: sum(w in own for own in words.values()) for w in "abcdefghxyz"}
    expected = {}
    for q, text in asked:
        for i, own in words.items():
            parts = [math.log(1 + (60 - df[w] + 0.5) / (df[w] + 0.5)) * own.count(w) * 2.5 / (own.count(w) + 1.5 * (0.25 + 0.75 * len(own) / mean)) for w in text.split() if w in own]
            if parts and q is not None:
                expected[q, i] = pytest.approx(sum(parts), rel=1e-9)
    got = X.bm25(spark.createDataFrame(docs, "i long, t string"), spark.createDataFrame(asked, "q long, s string"), "i", "t", "q", "s").collect()
    assert len(got) == len(expected) and {(r.query_id, r.doc_id): r.score for r in got} == expected


def test_targets_and_residuals_without_numbers(spark):
    df = spark.createDataFrame([("a", None), ("b", None), (None, None)], "c string, y double")
    assert [r.c_target for r in L.target_encode(df, "c", "y").collect()] == [None] * 3
    some = df.union(spark.createDataFrame([("a", 4.0), ("d", 8.0)], df.schema))
    assert {r.c: round(r.c_target, 6) for r in L.target_encode(some, "c", "y", 2.0).collect()} == {"a": round((4 + 12) / 3, 6), "b": 6.0, None: 6.0, "d": round(20 / 3, 6)}
    errors = spark.createDataFrame([(float(x), 0.0) for x in (0, 1, 2, 3, 4)] + [(float("nan"), 0.0), (float("inf"), 0.0), (None, 0.0)], "y double, p double")
    assert {r.bin: r.n for r in L.residual_histogram(errors, "y", "p", 2).collect()} == {0: 2, 1: 3}
    assert L.residual_histogram(errors.where("isnan(y)"), "y", "p", 2).collect() == []


# Repeated keys -----------------------------------------------------------------
def test_prefixes_of_rows_with_equal_keys(spark):
    rows = spark.createDataFrame([(1, "red box", "x"), (1, None, "y"), (1, "small", "z"), (1, "red box", "x"), (2, "blue", "w")], "k long, v string, o string")
    prefixes = spark.createDataFrame([("red", "R"), ("re", "E"), ("small", "S"), (None, "N"), ("reds", "Z")], "p string, code string")
    got = sorted(map(str, (tuple(r) for r in R.prefix_lookup(rows, prefixes, "v", "p", ["code"], ["k"]).select("k", "v", "o", "code").collect())))
    twice = [(1, "red box", "x", "R"), (1, "red box", "x", "E")] * 2
    assert got == sorted(map(str, [*twice, (1, None, "y", None), (1, "small", "z", "S"), (2, "blue", "w", None)]))


def test_late_events_of_null_keys(spark):
    rows = spark.createDataFrame([(1, None, 7200, 1.0), (2, None, 10, 2.0), (3, "a", 7200, 4.0)], "arrival long, who string, at long, v double").withColumn("ts", F.timestamp_seconds("at"))
    got = S.late_events(rows, "arrival", "ts", "v", 3600, 60, ["who"]).where("kind = 'correction'").collect()
    assert [(r.who, r.bucket, r.value) for r in got] == [(None, 0, 2.0)]


# Texts that hold what cuts them --------------------------------------------------
def test_chunks_keep_control_characters(spark):
    df = spark.createDataFrame([(1, "a\x01b c. D\x01e! F")], "i long, t string")
    assert [r.chunk for r in X.sentence_chunks(df, "t", 100).collect()] == ["a\x01b c. D\x01e! F"]
    assert [r.chunk for r in X.sentence_windows(df, "t", 1).orderBy("chunk_index").collect()] == ["a\x01b c.", "D\x01e!", "F"]
    code = spark.createDataFrame([(1, "x\x01y\ndef f():\n  \x01\ndef g():\n  pass")], "i long, t string")
    assert [r.chunk for r in X.code_chunks(code, "t", 5).orderBy("chunk_index").collect()] == ["x\x01y", "def f():\n  \x01", "def g():\n  pass"]


# Consolidation -------------------------------------------------------------------
def test_single_and_other_memories_are_not_consolidated(spark):
    rows = spark.createDataFrame([(1, "episodic", "a b"), (2, "episodic", "a b c"), (3, "semantic", "a b c d"), (4, "episodic", "x"), (5, None, "x"), (6, "episodic", "k"), (7, "semantic", "k")], "id long, kind string, t string")
    classes = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6)], "id long, class_id long")
    longest = [F.desc(F.length("t"))]
    assert [tuple(r) for r in X.consolidated(rows, classes, "id", longest, "t", "kind").collect()] == [(1, 2, "a b c", 2)]
    assert sorted(tuple(r) for r in X.consolidated(rows, classes, "id", longest, "t").collect()) == [(1, 3, "a b c d", 3), (4, 4, "x", 2), (6, 6, "k", 2)]
