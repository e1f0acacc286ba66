"""Operators on rows written by hand: the rules that SQL twins do not show."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import domain as D, features as X, learning as L, linkage as K, quality as Q, relational as R, text as T, timeseries as S, warehouse as W


def values(df, *names):
    return sorted((tuple(r) for r in (df.select(*names) if names else df).collect()), key=repr)


def test_sum_over_nothing_is_zero_and_mean_skips_nulls(spark):
    df = spark.createDataFrame([("EU", 10.0), ("EU", 25.0), ("EU", 5.0), ("US", 100.0), ("US", None), ("XX", None)], "region string, amount double")
    got = R.aggregate(df, ["region"], {"s": R.Agg("amount", "sum"), "m": R.Agg("amount", "mean"), "n": R.Agg("amount", "count")})
    assert values(got) == [("EU", 40.0, pytest.approx(40 / 3), 3), ("US", 100.0, 100.0, 1), ("XX", 0.0, None, 0)]
    assert values(R.aggregate(df, ["region"], {"s": R.Agg("amount", "sum", null_sum=True)}))[-1] == ("XX", None)


def test_first_and_last_keep_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, None)], "i int, v int")
    got = R.aggregate(df, [], {"f": R.Agg("v", "first", "i"), "l": R.Agg("v", "last", "i")})
    assert values(got) == [(None, None)]
    with pytest.raises(ValueError):
        R.Agg("v", "first").column()


def test_rename_rejects_collisions(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        R.rename(df, {"a": "b"})
    with pytest.raises(ValueError):
        R.rename(df, {"c": "d"})


def test_title_case_and_null_words(spark):
    df = spark.createDataFrame([("  mary-ann  o'NEIL ",), ("N/A",), (None,)], "n string")
    got = R.normalize(df, {"n": R.NormalizeRule(case="title", nulls=("n/a",))})
    assert [r.n for r in got.collect()] == ["Mary-Ann O'Neil", None, None]


def test_join_suffix_and_null_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "k int, v string")
    assert values(R.join(a, b, ["k"])) == [(1, "x", "p")]
    assert values(R.join(a, b, ["k"], null_equal=True)) == [(1, "x", "p"), (None, "y", "q")]
    assert values(R.join(a, b, ["k"], "right_anti")) == [(None, "q")]
    assert R.join(a, b, [], "cross").count() == 4


def test_session_breaks_only_past_the_gap(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("u", t), ("u", t + dt.timedelta(minutes=30)), ("u", t + dt.timedelta(minutes=61))], "u string, ts timestamp_ntz")
    got = S.sessionize(df, ["u"], "ts", 30)
    assert [r[2:] for r in values(got)] == [("u_0", 1), ("u_0", 2), ("u_1", 1)]


def test_windowed_deduplication_anchors_on_the_last_kept(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, "k", t + dt.timedelta(minutes=m)) for i, m in enumerate([0, 6, 11, 16, 20, 26])]
    df = spark.createDataFrame(rows, "i int, k string, ts timestamp_ntz")
    assert [r[0] for r in values(S.windowed_deduplicate(df, ["k"], "ts", 10, "i"))] == [0, 2, 5]


def test_funnel_ignores_order(spark):
    df = spark.createDataFrame([(1, "buy"), (1, "view"), (2, "view"), (3, "buy")], "u int, e string")
    assert values(S.funnel(df, "u", "e", ["view", "buy", "gone"])) == [(1, "view", 2, None), (2, "buy", 1, 0.5), (3, "gone", 0, 0.0)]


def test_history_load_is_idempotent(spark):
    at = lambda d: F.to_date(F.lit(d))
    schema = "id int, region string, tier string, valid_from date, valid_to date, is_current boolean"
    source = lambda tier: spark.createDataFrame([(1, "EU", tier), (2, "US", None)], "id int, region string, tier string")
    empty = spark.createDataFrame([], schema)
    one = W.scd2(empty, source("gold"), ["id"], ["region", "tier"], at("2024-01-01"))
    two = W.scd2(one, source("platinum"), ["id"], ["region", "tier"], at("2024-02-01"))
    three = W.scd2(two, source("platinum"), ["id"], ["region", "tier"], at("2024-03-01"))
    assert values(two, "id", "tier", "is_current") == [(1, "gold", False), (1, "platinum", True), (2, None, True)]
    assert values(two) == values(three)


def test_orphans_follow_not_in(spark):
    facts = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert values(Q.orphans(facts, "k", spark.createDataFrame([(1,)], "d int"), "d")) == [(2,)]
    assert values(Q.orphans(facts, "k", spark.createDataFrame([(1,), (None,)], "d int"), "d")) == []


def test_schema_diff(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert values(Q.schema_diff(df, {"a": "bigint", "c": "int"}), "column", "change") == [("a", "retyped"), ("b", "added"), ("c", "dropped")]


def test_expressions_follow_python(spark):
    df = spark.createDataFrame([(-7, 3)], "a int, b int")
    got = X.derive(df, {"q": "a // b", "r": "a % b", "d": "a / b", "c": "-10 < a < 0", "z": "q * b + r"}).first()
    assert (got.q, got.r, got.d, got.c, got.z) == (-3, 2, pytest.approx(-7 / 3), True, -7)
    for bad in ("__import__('os')", "a.b", "nothing + 1"):
        with pytest.raises(ValueError):
            X.compile_expression(bad, ["a", "b"])


def test_unicode_forms(spark):
    df = spark.createDataFrame([("ＡＢ! é ",)], "s string")
    assert X.clean_strings(df, ["s"], form="NFKC").first().s == "ab é"


def test_similarities(spark):
    # textbook values
    left = ["martha", "dwayne", "dixon", "", "", "abc", "same", "ab", "😀b"]
    right = ["marhta", "duane", "dicksonx", "a", "", "xyz", "same", "ba", "😀c"]
    expected = [0.9611, 0.84, 0.8133, 0.0, 1.0, 0.0, 1.0, 0.0, 0.7]
    assert K.jaro_winkler(left, right).tolist() == pytest.approx(expected, abs=1e-4)
    pairs = spark.createDataFrame([*zip(left, right), (None, ""), ("a" * 3000, "a" * 2999)], "a string, b string")
    got = [r[0] for r in pairs.coalesce(1).select(K.jaro_winkler_column("a", "b")).collect()]
    assert got == pytest.approx([*expected, 1.0, 0.9999], abs=1e-4)
    df = spark.createDataFrame([(1, "alice"), (2, "alic3"), (3, "bob"), (4, "alice"), (5, None)], "id long, name string")
    kept = K.fuzzy_deduplicate(df, "id", "name", 2, 0.8)
    assert [r[0] for r in values(kept)] == [1, 3, 5]


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    nodes = spark.range(61)
    assert {r.component for r in K.connected(edges, nodes).collect()} == {0}


def test_chunks_stop_at_the_end(spark):
    df = spark.createDataFrame([("abcdefghij",), ("",)], "t string")
    assert [r.chunk for r in T.fixed_chunks(df, "t", 4, 1).orderBy("chunk_index").collect()] == ["abcd", "defg", "ghij"]
    assert T.split_text("aa bb. cc dd\n\nee", 6) == ["aa bb", "cc dd", "ee"]


def test_recursive_chunks_overlap(spark):
    assert T.split_overlapping("aa bb cc dd ee", 8, 0) == ["aa bb cc", "dd ee"]
    assert T.split_overlapping("aa bb cc dd ee", 8, 5) == ["aa bb cc", "bb cc dd", "cc dd ee"]
    assert T.split_overlapping("aa bb cc dd ee", 8, 1) == ["aa bb cc", "cc dd ee"]
    assert T.split_overlapping("abcdefghij\n\nk", 4, 0) == ["abcd", "efgh", "ij k"]
    assert T.split_overlapping("abcd efgh", 4, 2) == ["abcd", "abcd efgh"]
    assert T.split_overlapping("", 4, 2) == []
    with pytest.raises(ValueError):
        T.split_overlapping("a", 4, 4)
    df = spark.createDataFrame([(1, "aa bb cc dd ee"), (2, ""), (3, None)], "i int, t string")
    assert values(T.recursive_chunks(df, "t", 8, 5), "i", "chunk_index", "chunk") == [(1, 0, "aa bb cc"), (1, 1, "bb cc dd"), (1, 2, "cc dd ee")]


def test_page_text():
    assert T.visible_text("<html><head><title>x</title></head><body><p>a &amp; b</p><script>no()</script><p>c</p></body></html>") == "a & b\nc"


def test_cosine_of_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(T.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, pytest.approx(2**-0.5)]


def test_signals(spark):
    x = np.sin(2 * np.pi * 5 * np.arange(128) / 128)
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    got = df.select(D.spectrum("x").alias("s"), D.median_filter("x", 5).alias("m"), D.fir_filter("x", [1.0]).alias("f"), D.power_density("x", 128.0, 64).alias("p"), D.resample_linear("x", 128.0, 64.0).alias("r")).first()
    assert int(np.argmax(got.s)) == 5 and got.f == pytest.approx(x.tolist())
    assert len(got.m) == 128 and len(got.p) == 33 and got.r == pytest.approx(x[::2].tolist())


def test_split_is_stable(spark):
    df = spark.range(2000)
    a = {r.id: r.split for r in L.hash_split(df, ["id"], {"train": 0.8, "test": 0.2}).collect()}
    b = {r.id: r.split for r in L.hash_split(df.where("id % 2 = 0"), ["id"], {"train": 0.8, "test": 0.2}).collect()}
    assert all(a[i] == s for i, s in b.items())
    assert 0.75 < sum(s == "train" for s in a.values()) / 2000 < 0.85


def test_new_chunks_reads_each_side_once(spark, tmp_path):
    digest = lambda text: None if text is None else hashlib.sha256(text.encode()).hexdigest()
    now = [(1, "same"), (1, "same"), (1, "new"), (1, "new"), (2, "same"), (3, None), (None, "x"), (None, "x"), (None, None)]
    old = [(1, "same"), (1, "gone"), (1, "gone"), (2, "other"), (3, None), (None, "x"), (4, None)]
    spark.createDataFrame(now, "d long, c string").write.parquet(f"{tmp_path}/now")
    spark.createDataFrame([(d, digest(c)) for d, c in old], "d long, digest string").write.parquet(f"{tmp_path}/old")
    chunks, manifest = spark.read.parquet(f"{tmp_path}/now"), spark.read.parquet(f"{tmp_path}/old")
    got = T.new_chunks(chunks, manifest, "d", "c")
    assert got.columns == ["d", "digest", "change"]
    # Nulls equal nothing: what holds one is new on one side and gone on the other.
    added = {(1, "new"), (2, "same"), (3, None), (None, "x"), (None, None)}
    removed = {(1, "gone"), (2, "other"), (3, None), (None, "x"), (4, None)}
    assert values(got) == sorted([*((d, digest(c), "add") for d, c in added), *((d, digest(c), "remove") for d, c in removed)], key=repr)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    assert {r.change for r in T.new_chunks(chunks, manifest.limit(0), "d", "c").collect()} == {"add"}
    assert {r.change for r in T.new_chunks(chunks.limit(0), manifest, "d", "c").collect()} == {"remove"}
