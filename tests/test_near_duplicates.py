"""Classes of near-duplicate texts against brute force."""

import random
import re

from millrace.operators import text as X


def brute(rows, threshold):
    sets = {i: set(re.findall("[a-z0-9]+", (t or "").lower())) for i, t in rows}
    alike = lambda p, q: not (p | q) or len(p & q) / len(p | q) >= threshold
    links = {i: {j for j in sets if j != i and alike(sets[i], sets[j])} for i in sets}
    label = {}
    for i in sorted(sets):
        todo = [] if i in label else [i]
        while todo:
            j = todo.pop()
            if j not in label:
                label[j] = i
                todo += links[j]
    return {(i, label[i], len(links[i])) for i in sets}


def test_groups(spark, monkeypatch):
    rng = random.Random(4)
    bases = [[f"w{rng.randint(0, 60)}" for _ in range(rng.randint(3, 25))] for _ in range(25)]
    texts = [None, "", " ?", "same words here", *["Words same, here same"] * 40]
    texts += [" ".join(w for w in rng.choice(bases) if rng.random() < 0.85) for _ in range(150)]
    rows = list(enumerate(texts, 7))
    df = spark.createDataFrame(rows, "i long, t string")
    for hot, known in ((1000, 1000), (3, 1000), (3, 5)):
        monkeypatch.setattr(X, "HOT_TOKEN", hot)
        monkeypatch.setattr(X, "KNOWN_TOKENS", known)
        got = X.near_duplicate_groups(df, "i", "t", 0.6).collect()
        assert len(got) == len(rows) and {tuple(r) for r in got} == brute(rows, 0.6)
