"""Similarity classes against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import components, jaccard_join as J, joins
from tests.llm import texts as X


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(docs):
    """(id, class, links) by all pairs."""
    sets = [shingles(t) for _, t in docs]
    n = len(docs)
    near = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 5 >= 4 * max(len(a), len(b)):
                common = len(a & b)
                if 5 * common >= 4 * (len(a) + len(b) - common):
                    near[i].append(j)
                    near[j].append(i)
    seen, result = [None] * n, []
    for i in range(n):
        if seen[i] is None:
            stack, members = [i], []
            seen[i] = i
            while stack:
                x = stack.pop()
                members.append(x)
                for y in near[x]:
                    if seen[y] is None:
                        seen[y] = i
                        stack.append(y)
            ids = [docs[x][0] for x in members if docs[x][0] is not None]
            for x in members:
                result.append((docs[x][0], min(ids) if ids else None, len(near[x])))
    return result


def near_copies(rng, base, n):
    out = []
    for _ in range(n):
        w = base.split(" ")
        for _ in range(rng.randint(0, 4)):
            w.insert(rng.randrange(len(w)), f"new{rng.randrange(10**6)}")
        out.append(" ".join(w))
    return out


def key(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def docs(spark, small):
    rng = random.Random(3)
    texts = X.awkward(rng)
    texts += near_copies(rng, X.words(rng, 150), 90) + near_copies(rng, X.words(rng, 60), 15) + ["One two Three", "one  TWO three"]
    rows = [(10_000 + i, t) for i, t in enumerate(texts)] + [(None, texts[11]), (None, texts[-4]), (10_011, texts[11])]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    return rows


def test_against_all_pairs(spark, docs, monkeypatch):
    monkeypatch.setattr(J, "LEAF", 16)  # large groups take the paths of several levels and blocks
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [tuple(r) for r in J.jaccard_join(df).collect()]
    assert key(got) == key(brute(docs))


def test_one_of_each(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("text", "doc_id", "1 AS key", "'x' AS `size`")
    kept = J.one_of_each(df)
    assert kept.columns == df.columns
    classes = {}
    for (i, t), (j, c, n) in zip(docs, _in_order(docs), strict=True):
        assert i == j
        classes[(i, t)] = (c, n)
    rows = kept.collect()
    lone = sorted((repr(k[0]), k[1]) for k, (c, n) in classes.items() if n == 0)
    got_lone = sorted((repr(r.doc_id), r.text) for r in rows if classes[(r.doc_id, r.text)][1] == 0)
    assert set(got_lone) == set(lone)
    linked = [classes[(r.doc_id, r.text)][0] for r in rows if classes[(r.doc_id, r.text)][1] > 0]
    assert sorted(map(repr, linked)) == sorted({repr(c) for c, n in classes.values() if n > 0})


def _in_order(docs):
    """brute() gives components; bring its rows back to the order of docs."""
    tagged = [(k, t) for k, (_, t) in enumerate(docs)]
    by_tag = {}
    result = brute(tagged)
    groups = {}
    for tag, c, n in result:
        groups.setdefault(c, []).append(tag)
        by_tag[tag] = (c, n)
    name = {c: min((docs[t][0] for t in tags if docs[t][0] is not None), default=None) for c, tags in groups.items()}
    return [(docs[k][0], name[by_tag[k][0]], by_tag[k][1]) for k in range(len(docs))]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_join(empty).count() == 0
    assert J.one_of_each(empty).count() == 0


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 80)).astype(np.uint64)) for _ in range(30)]
    got = J.intersections(np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert got[i, j] == len(np.intersect1d(a, b))


def test_runs_reach_the_recall():
    """Pairs at the threshold, every node split to the last level: how many meet in a leaf and are candidates there."""
    rng = np.random.default_rng(7)
    n, recall = 40_000, 0.9999
    a = rng.integers(0, 1 << 32, (n, J.COORDINATES), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 1 << 32, a.shape, dtype=np.uint32))
    near = (a == b).sum(axis=1) >= J.leaf_bound(recall)

    def nodes(batches):
        tables = [pa.Table.from_batches([x]) for x in batches]
        return pa.concat_tables(tables).to_pandas().astype({"key": "int64"})

    def children(table, signature):
        sig = J._binary(signature[table.key.to_numpy()])
        return nodes(J._split(iter([pa.RecordBatch.from_arrays([pa.array(table.key), pa.array(table.node), sig], names=["key", "node", "sig"])])))

    keys = pa.array(np.arange(n))
    first = [nodes(J._paths(J.runs_for(recall))(iter([pa.RecordBatch.from_arrays([keys, J._binary(x)], names=["key", "sig"])]))) for x in (a, b)]
    common = first[0].merge(first[1]).drop_duplicates()
    for _ in range(J.DEPTH - 1):
        common = children(common, a).merge(children(common, b)).drop_duplicates()
    met = np.zeros(n, bool)
    met[common.key.unique()] = True
    missed = int((~(met & near)).sum())
    assert missed <= n * (1 - recall) + 4 * (n * (1 - recall)) ** 0.5, missed


@pytest.mark.parametrize("leaf", [4, 512])
def test_recall_of_planted_pairs(spark, monkeypatch, leaf):
    """Pairs of 0.80 to 0.85 beside texts that share a long passage, so that nodes are split: all links are found."""
    monkeypatch.setattr(J, "LEAF", leaf)
    rng = random.Random(12)
    texts, pairs = [], 1500
    for i in range(pairs):
        w = [f"{i}w{rng.randrange(10**6)}" for _ in range(100)]
        texts.append(" ".join(w))
        texts.append(" ".join([*w[: 88 + i % 2], *[f"new{i}x{k}" for k in range(9)]]))
    passage = [f"p{k}" for k in range(60)]
    texts += [" ".join([*passage, *[f"{i}q{rng.randrange(10**6)}" for _ in range(40)]]) for i in range(1200 if leaf == 512 else 60)]
    sets = [shingles(t) for t in texts]
    linked = {k // 2 for k in range(0, 2 * pairs, 2) if 5 * len(sets[k] & sets[k + 1]) >= 4 * len(sets[k] | sets[k + 1])}
    assert len(linked) > 0.9 * pairs
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id // 2 for r in J.jaccard_join(df).collect() if r.n_links and r.doc_id < 2 * pairs}
    assert found <= linked and len(linked - found) <= 1


def test_rows_apart_from_the_linked(spark, docs, monkeypatch):
    """Too many linked texts to be sent to every executor: the same rows stay."""
    from millrace.llm import joins

    df = spark.createDataFrame(docs, "doc_id long, text string")
    usual = key([tuple(r) for r in J.one_of_each(df).collect()])
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 64)
    assert key([tuple(r) for r in J.one_of_each(df).collect()]) == usual


def test_near_copies_are_not_split(spark, monkeypatch):
    """A large group of near copies is linked in its nodes, not sent on to their children by every run; outsiders keep their links."""
    rng = random.Random(21)
    base = X.words(rng, 200)
    texts = near_copies(rng, base, 400)
    changed = texts[7].split(" ")
    texts += near_copies(rng, " ".join([*changed[:-25], *[f"fringe{k}" for k in range(25)]]), 30)  # like a few of the copies, or like none
    texts += [" ".join([*base.split(" ")[:60], *[f"{i}q{k}" for k in range(140)]]) for i in range(30)]  # same nodes, no link

    def refuse(batches):
        if any(b.num_rows for b in batches):
            raise AssertionError("near copies were split")
        return iter(())

    monkeypatch.setattr(J, "LEAF", 128)
    monkeypatch.setattr(J, "_split", refuse)
    rows = list(enumerate(texts))
    got = [tuple(r) for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert key(got) == key(brute(rows))


def test_work_for_large_groups(spark, monkeypatch):
    """Large groups that take the paths of all levels: each stage has a task a partition, so many of them are what a few rows cost."""
    rng = random.Random(5)
    base = X.words(rng, 200)
    texts = near_copies(rng, base, 150)
    texts += [" ".join([*base.split(" ")[:150], *[f"{i}q{k}" for k in range(20)]]) for i in range(100)]  # same nodes, no link
    monkeypatch.setattr(J, "LEAF", 16)
    rows, context, group = list(enumerate(texts)), spark.sparkContext, "large groups"
    context.setJobGroup(group, group)
    try:
        got = [tuple(r) for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert key(got) == key(brute(rows))
    tracker = context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    ran = [s for s in map(tracker.getStageInfo, stages) if s and s.numCompletedTasks]
    assert len(ran) < 130, len(ran)  # 110; 151 when each level was compared on its own and stars took two rounds


def test_components_of_stars_take_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "stored", lambda df, store=components.stored: written.append(1) or store(df))
    edges = [(f"a{k}", "a") for k in range(50)] + [("b", "b0"), ("c", "c")]
    got = {tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {(f"a{k}", "a") for k in range(50)} | {("a", "a"), ("b", "b"), ("b0", "b")}
    assert len(written) == 2


@pytest.mark.parametrize("most", [64, 8 << 20])
def test_components(spark, monkeypatch, most):
    """Paths, hubs, rings and random graphs, with minima sent to all executors or not."""
    monkeypatch.setattr(joins, "BROADCAST_BYTES", most)
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(40)] + [(199, k) for k in range(100, 199)] + [(200 + k, 200 + (k + 1) % 9) for k in range(9)]
    edges += [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(120)] + [(7, 7), (600, 600)]
    least = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = [tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert sorted(got) == sorted(least.items())
