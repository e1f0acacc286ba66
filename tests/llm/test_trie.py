"""The prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from millrace.llm import prefix_trie, queries as Q

CONV = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def least(ids):
    return min((i for i in ids if i is not None), default=None)


def trie(convs):
    """Rows of the trie of {id: turns}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    total = {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        total[node] = (sum(total[k][0] for k in children[node]) or 1, own + sum(total[k][1] for k in children[node]))
    out = []
    for node, own in members.items():
        ids = sorted(ends[node], key=lambda x: (x is not None, x))
        text = ",".join("" if i is None else str(i) for i in ids)
        out.append((least(own), len(node), least(members[node[:-1]]) if node else None, len(own), len(children[node]), *total[node], hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


def rebuilt(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in by.items()}
    out = {}
    for c, turns in own.items():
        if c is None:
            out[c] = turns
            continue
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


@pytest.fixture(scope="module")
def folders(spark, small, tmp_path_factory):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a", "b", "é", None])) for c in [*range(40), 42, 43, 49, -1, -3, -5, -6, None] for t in [None, *range(rng.choice([0, 1, 2, 9, 14]))]]
    rows += [(c, t, "user", "same") for c in range(100, 160) for t in range(12)]  # copies
    rows += [(200, t, "user", f"{t} x") for t in range(700)] + [(c, 0, "user", "only") for c in (301, 302, 303)]
    rows += [((1 << 63) - 1, 0, "user", "edge"), (-(1 << 63), 0, "user", "edge")]
    rng.shuffle(rows)
    made = tmp_path_factory.mktemp("trie")
    spark.createDataFrame(rows, CONV).write.parquet(f"{made}/conversations.parquet")
    empty = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], CONV).write.parquet(f"{empty}/conversations.parquet")
    return [small, str(made), str(empty)]


def check(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = Q.op13_prefix_trie(spark, folder)
    assert got.columns == NAMES and {k for n, k in got.dtypes if n != "ends_sha256"} == {"bigint"}
    assert Counter(map(tuple, got.collect())) == trie(rebuilt(rows))


def test_op13(spark, folders):
    for folder in folders:
        check(spark, folder)


def test_paths_in_many_blocks_without_broadcast(spark, folders, monkeypatch):
    from millrace.llm import joins

    monkeypatch.setattr(prefix_trie, "BLOCK", 5)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    check(spark, folders[1])


def test_any_conversations(spark):
    """Without the query's own branching; ties and repeated turns, and a light edge in every second step."""
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "tool"]), rng.choice("ab")) for c in range(200) for t in range(rng.randint(1, 12))]
    rows += [(1000 + c, t, "comb", "x" if t < c else "y") for c in range(30) for t in range(c + 1)]
    odd = spark.createDataFrame(rows, CONV).selectExpr("*", "1 AS `a.b`", "'x' AS TEXT", "2 AS conv", "3 AS part", "4 AS n", "5 AS `tick``s`")
    turns = prefix_trie.number_turns(odd).cache()
    got = prefix_trie.prefix_trie(turns, turns.select("conv").distinct().union(spark.createDataFrame([(5000,), (None,)], "conv long")))
    own = defaultdict(list, {5000: [], None: []})
    for conv, turn, role, text in sorted(rows, key=lambda r: r[:2]):
        own[conv].append((role, text))
    assert Counter(map(tuple, got.select(NAMES).collect())) == trie(own)
