"""Nearest vectors over blocks of vectors and queries."""

import numpy as np

from millrace.operators import text as X


def test_more_queries_than_a_block_and_copies(spark, monkeypatch):
    monkeypatch.setattr(X, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(X, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(3)
    made = rng.normal(size=(300, 8)).astype(np.float32)
    made[100:130] = made[7]
    made[5] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(made)]
    df = spark.createDataFrame([*rows, (300, None)], "i long, v array<float>").repartition(3)
    out = X.vector_top_k(df, df.where("i % 2 = 0").select("i", "v").toDF("q", "w"), "i", "v", "q", "w", 10)
    assert "300" not in {str(r.query_id) for r in out.collect()}
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.i, round(r.score, 9)))
    v = made.astype(float)
    norm = np.linalg.norm(v, axis=1)
    for q in range(0, 300, 2):
        both = norm * norm[q]
        cos = np.round(np.divide(v @ v[q], both, out=np.zeros(300), where=both != 0), 9)
        order = sorted(range(300), key=lambda i: (-cos[i], i))[:10]
        assert [i for i, _ in got[q]] == order, q
    assert set(got) == set(range(0, 300, 2))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000, "queries stay out of the plan"


def test_empty_sides(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "i long, v array<double>")
    q = df.toDF("q", "w")
    assert X.vector_top_k(df, q.limit(0), "i", "v", "q", "w", 3).count() == 0
    assert X.vector_top_k(df.limit(0), q, "i", "v", "q", "w", 3).count() == 0
