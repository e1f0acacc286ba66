"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from millrace.llm import queries as Q, spelling
from tests.llm import texts as X


def near(x, y):
    """Exactly one code point inserted, deleted or replaced."""
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    short, long = sorted((x, y), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def groups(n, pairs, ratio=2):
    by = defaultdict(list)
    for x, y in pairs:
        by[x].append(y)
        by[y].append(x)
    form = {}
    for w in n:
        best = min(by[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return Counter((w, form[w], root(w), n[w], len(by[w]), n[form[w]] if form[w] is not None else None) for w in n)


def counted(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 3}


def all_pairs(words):
    """Near pairs by a pass over words of one pattern: each place left open, or filled by nothing."""
    places = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            places[w[:i], w[i + 1 :]].add(w)
    found = set()
    for (head, tail), own in places.items():
        found |= {(x, y) for x in own for y in own if x < y}
        if head + tail in words:
            found |= {tuple(sorted((x, head + tail))) for x in own}
    return {(x, y) for x, y in found if near(x, y)}


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh") for _ in range(70))
    ties = " ".join(["magic magyc magec"] * 4 + ["magjc"] * 2 + ["magjc"])
    own = [
        *X.awkward(rng),
        ties,
        " ".join(["Wort WORT wort", "wört wörtes wörter"] * 9),
        " ".join(["aaaaa aaaaaa aaaaaaa"] * 5 + ["aaaaa"] * 9),
        " ".join(["abcdef bcdefg abdcef acbdef"] * 3),  # two edits apart
        " ".join([long, long[:30] + long[31:], long[:30] + "z" + long[31:], "x" + long, long[:64], long[:63], long[:65], long[1:66]] * 4),
        " ".join(["ab×cde ab÷cde Àbcde àbcde bcde"] * 4),
        "\U0001f600" + "grüße" * 3 + " grüße grüsse grüße grüße" * 4,
        *["hello helo hallo"] * 40,
    ]
    made = tmp_path_factory.mktemp("spelling")
    X.documents(spark, own, extra=[(None, "hello hello nullid nullid nullid", None, None, None), (7, own[7], "en", "src0", 1), (7, own[7], "en", "src0", 1)]).write.parquet(f"{made}/documents.parquet")
    empty = tmp_path_factory.mktemp("empty")
    X.documents(spark, []).write.parquet(f"{empty}/documents.parquet")
    return [str(made), str(empty)]


def test_op11(spark, small, awkward):
    for folder in [small, *awkward]:
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
        n = counted(docs)
        got = Counter(map(tuple, Q.op11_spelling_variants(spark, folder).select("word", "form", "root", "n", "n_near", "form_n").collect()))
        assert got == groups(n, all_pairs(set(n)))


def test_pairs_by_every_comparison(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(0, 7))) for _ in range(250)} | {"", "日本語", "日本", "日木語", "本日語"}
    n = {w: rng.choice([1, 1, 2, 3, 5, 9, 40]) for w in words}
    pairs = {(x, y) for x in words for y in words if x < y and near(x, y)}
    got = spelling.spelling_groups(spark.createDataFrame([*n.items(), (None, 4)], "word string, n long"))
    assert Counter(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect())) == groups(n, pairs)


def test_long_words_and_long_chains(spark, monkeypatch):
    rng = random.Random(5)
    huge = "".join(rng.choice("abcdefgh") for _ in range(300_000))
    n = {huge: 8, huge[:5] + huge[6:]: 4, huge[:-1] + "z": 3, "b" * 200_000: 5, "b" * 200_001: 10}
    chain = [("ab" * 20)[:k] for k in range(6, 40)]
    n |= {w: 3 * 2**i for i, w in enumerate(chain)}
    pairs = {(huge, huge[:5] + huge[6:]), (huge, huge[:-1] + "z"), ("b" * 200_000, "b" * 200_001), *zip(chain, chain[1:], strict=False)}
    got = spelling.spelling_groups(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == groups(n, pairs)
    assert {r.root for r in got if r.word in chain} == {chain[-1]}


def test_hot_forms_without_broadcast(spark, monkeypatch):
    from millrace.llm import joins

    words = ["center", *["center"[:i] + c + "center"[i + 1 :] for i in range(6) for c in "xyzwvuqk"]]
    n = {w: 3 for w in words} | {"center": 100}
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    got = spelling.spelling_groups(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert Counter(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect())) == groups(n, all_pairs(set(n)))
