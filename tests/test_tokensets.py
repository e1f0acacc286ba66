"""Token sets in groups and blocks against every comparison."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.operators import text as X, tokensets as K
from tests.test_near_duplicates import brute


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    bases = [[f"w{rng.randint(0, 90)}" for _ in range(rng.randint(1, 60))] for _ in range(30)]
    texts = [None, "", " ?", *["Same words, here same"] * 9, "a" * 30, "b" * 9 + " c", "é中x y"]
    return list(enumerate(texts + [" ".join(w for w in rng.choice(bases) if rng.random() < 0.9) for _ in range(260)], 3))


@pytest.mark.parametrize("block,group", [(512, (1024, 32_768)), (6, (20, 40)), (2, (5, 9))])
def test_pairs_and_groups(spark, rows, monkeypatch, block, group):
    monkeypatch.setattr(K, "BLOCK", block)
    monkeypatch.setattr(K, "GROUP", group)
    monkeypatch.setattr(K, "DENSE", 512 if block > 9 else 20)
    monkeypatch.setattr(X, "FEW_CANDIDATES", 200_000 if block > 9 else 0)
    df = spark.createDataFrame(rows, "i long, t string")
    got = X.near_duplicate_groups(df, "i", "t", 0.6).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == brute(rows, 0.6)
    sets = {i: s for i, t in rows if (s := set(re.findall("[a-z0-9]+", (t or "").lower())))}
    for threshold in (0.15, 0.6):
        pairs = X.group_by_shared_tokens(df, "i", "t", threshold).collect()
        expected = {(i, j, len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i in sets for j in sets if i < j}
        assert len(pairs) == len({(r.a, r.b) for r in pairs}) and {tuple(r) for r in pairs} == {p for p in expected if p[2] >= threshold}


def test_sets_are_copied_by_groups(spark, monkeypatch):
    """All texts share their words: an index of tokens meets every pair, here a set is copied once a group."""
    monkeypatch.setattr(K, "GROUP", (64, 64))
    rows = spark.range(1000).selectExpr("id", "CAST(100 + id % 20 AS INT) AS n")
    dealt = K.met(rows, 0.6, lambda n: 8).groupBy("task", "side").count().collect()
    assert sum(r["count"] for r in dealt) <= 1000 * 21 and max(r["count"] for r in dealt) <= 64


def test_tokens():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abz09 -.é中A") for _ in range(rng.choice([0, 1, 5, 200]))) for _ in range(200)] + ["a" * 20, "a" * 8, "ab" * 40, "", "b"]
    whole = pa.array(texts)
    assert K.token_lists(whole.slice(50, 60)).to_pylist() == K.token_lists(whole).to_pylist()[50:110]
    words = [set(re.findall("[a-z0-9]+", t)) for t in texts]
    lists = K.token_lists(whole)
    assert [len(x) for x in lists.to_pylist()] == [len(w) for w in words]
    values, begin = K._flat(lists)
    found = K.overlaps((values, begin), (values, begin))
    assert (found == np.array([[len(a & b) for b in words] for a in words])).all()


def test_sketches_bound_overlaps():
    rng = np.random.default_rng(2)
    a, b = [np.unique(rng.integers(0, 150, n).astype(np.uint64)) for n in (70, 90)]
    both = K.sketches(pa.array([[int(v) for v in x] for x in (a, b)], pa.list_(pa.int64()))).to_pylist()
    width = 8 * min(map(len, both))
    signs = K._signs([both[0]], width) @ K._signs([both[1]], width).T
    assert (width - signs[0, 0]) / 2 <= len(np.setxor1d(a, b))
