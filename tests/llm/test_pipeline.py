"""The pipeline and its operators with outcomes that SQL cannot give."""

import math
import random
from collections import Counter

import pytest

import corpus_pipeline
from millrace.llm import language_id, mixing, quality_classifier, queries, sharding
from tests.llm import test_jaccard as TJ, texts as X
from tests.llm.test_contracts import bench_words


def contaminated(text, windows):
    w, hit = bench_words(text), set()
    for i in range(len(w)):
        for n in {len(x) for x in windows}:
            if i + n <= len(w) and tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_pipeline_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    windows = set()
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        w = bench_words(r.text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    lettered = [d for d in docs if any(c.isalpha() for c in d.text or "")]
    classes = {i: c for i, c, _ in TJ.brute([(d.doc_id, d.text) for d in lettered])}
    expected = {d.doc_id for d in lettered if classes[d.doc_id] == d.doc_id and not contaminated(d.text, windows)}
    got = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in got} == expected
    by_id = {d.doc_id: d for d in docs}
    assert all((r.text, r.lang, r.source, r.n_chars) == (by_id[r.doc_id].text, by_id[r.doc_id].lang, by_id[r.doc_id].source, by_id[r.doc_id].n_chars) for r in got)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) <= set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())


def test_stages_on_awkward_and_empty_tables(spark, tmp_path):
    """Which rows pass each stage, by hand; columns that stages use themselves are carried."""
    clash = ["key", "t1", "mix_row", "mix_source", "full", "cut", "budget", "prior", "said", "__declared", "__body", "row_id", "h", "row", "c0", "a.b"]
    for name, texts in (("awkward", X.awkward()), ("empty", [])):
        folder = tmp_path / name
        extra = [(None, None, None, None, None), (3, texts[4], "en", None, 1), (3, texts[4], "en", None, 1)] if texts else []
        X.documents(spark, texts, extra).selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in clash]).write.parquet(f"{folder}/documents.parquet")
        item = X.awkward()[17] if texts else "x y"
        spark.createDataFrame([(1, None), (None, "x y"), (2, ""), (3, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        columns = docs.columns
        passed = []
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(folder))
            assert docs.columns[: len(columns)] == columns
            rows = docs.collect()
            assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in rows for c in clash)
            passed.append(Counter(r.doc_id for r in rows))
        if not texts:
            assert not any(passed)
            continue
        lettered = {i for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")} - {8, 14}  # one letter again and again, and the alphabet: no language
        assert set(passed[0]) == lettered | {3} and passed[0][3] == 2  # the two rows of one letter
        classes = TJ.brute([(i, texts[i]) for i in lettered] + [(3, texts[4])] * 2)
        assert set(passed[1]) == {c for _, c, _ in classes} and max(passed[1].values()) == 1
        clean = {i for i in passed[1] if not contaminated(texts[4] if i == 3 else texts[i], {tuple(bench_words(item))[k : k + 13] for k in range(2)})}
        assert set(passed[2]) == clean and 17 not in clean
        assert set(passed[3]) == clean and passed[4] == passed[3]


def check_draws(rows, draws, weight, budget):
    """rows: (row, source, tokens); draws: (row, source, tokens, epoch, start). Whole blocks, then a cut where the budget ends."""
    for s in {x for _, x, _ in rows}:
        own = sorted((d for d in draws if d[1] == s), key=lambda d: (d[4], d[3], d[2]))
        mine = Counter(r for r, x, _ in rows if x == s)
        worded = sum(t for _, x, t in rows if x == s)
        assert weight[s] >= 0 and (worded or not weight[s])
        at = 0
        for d in own:
            assert d[4] == at
            at += d[2]
        last = max(d[3] for d in own)
        for e in range(last):
            assert Counter(d[0] for d in own if d[3] == e) == mine
        ending = Counter(d[0] for d in own if d[3] == last)
        if not worded:
            assert last == 0 and ending == mine
        elif budget[s] == (last + 1) * worded:
            assert ending == mine
        else:
            assert not ending - mine and at >= budget[s] > last * worded
            assert all(d[4] < budget[s] for d in own if d[3] == last)


def test_mixing_by_hand(spark):
    rng = random.Random(2)
    rows = [(i, X.words(rng, rng.randint(1, 30)), "big" if i % 10 else rng.choice(["small", "tiny", None])) for i in range(600)]
    rows += [(600 + i, rng.choice([None, "", " "]), rng.choice(["big", "wordless"])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counted = mixing.count_tokens(df)
    mix = mixing.plan_mix(counted.select(mixing.source_key("source"), "mix_tokens"), evenness=0.9, max_repeats=None)
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
    del tokens["wordless"]
    total = sum(tokens.values())
    weights = {s: (n / total) ** mix.exponent for s, n in tokens.items()}
    z = sum(weights.values())
    entropy = -sum(w / z * math.log(w / z) for w in weights.values())
    assert entropy == pytest.approx(0.9 * math.log(len(tokens)), abs=1e-6)
    drawn = mixing.mix_order(counted, mix).collect()
    planned = {(r.mix_source or None) and r.mix_source[1:]: r for r in mix.sources.collect()}
    for s in tokens:
        assert planned[s].weight == pytest.approx(weights[s] / z)
    check_draws(
        [(i, s, len((t or "").split())) for i, t, s in rows],
        [(r.doc_id, r.source, r.mix_tokens, r.mix_epoch, r.mix_start) for r in drawn],
        {s: r.weight for s, r in planned.items()},
        {s: r.budget for s, r in planned.items()},
    )
    assert {r.doc_id for r in drawn} == {i for i, _, _ in rows}
    plain = Counter(r.doc_id for r in mixing.mixed(df, evenness=0.9, max_repeats=None).collect())
    assert plain == Counter(r.doc_id for r in drawn)


def test_mixing_query(spark, small, tmp_path):
    """The whole query: blocks, weights of the target entropy, budgets; much repeated rows too."""
    X.documents(spark, X.awkward(), [(3, "same words here", "en", "src1", 1)] * 9000 + [(None, None, None, None, None)] * 3).write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (small, str(tmp_path)):
        docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
        got = queries.op1_source_mixing(spark, folder).collect()
        tokens = Counter()
        for d in docs:
            tokens[d.source] += len(X.split_words(d.text))
        worded = {s: n for s, n in tokens.items() if n}
        weight = {s: next(r.weight for r in got if r.source == s) for s in {d.source for d in docs}}
        assert sum(weight.values()) == pytest.approx(1, abs=1e-6)
        top = max(n / weight[s] for s, n in worded.items())
        entropy = -sum(weight[s] * math.log(weight[s]) for s in worded)
        repeats = max(weight[s] / n for s, n in worded.items()) / min(weight[s] / n for s, n in worded.items())
        assert repeats <= 4.01 and (entropy >= 0.98 * math.log(len(worded)) - 1e-6 or repeats >= 3.99 or len(worded) == 1)
        key = lambda d: (d.doc_id, d.source)
        rows = [(key(d), d.source, len(X.split_words(d.text))) for d in docs]
        starts = [(key(r), r.source, r.n_tokens, r.epoch, r.start_token) for r in got]
        ends = {s: max((d[4] + d[2] for d in starts if d[1] == s), default=0) for s in weight}
        for s, n in worded.items():
            assert ends[s] >= round(weight[s] * top) - 2 and ends[s] < weight[s] * top + 2 + max(r[2] for r in rows)
        check_draws(rows, starts, weight, {s: min(ends[s], max(tokens[s], round(weight[s] * top))) for s in weight})


def test_mixing_limit_of_repeats(spark):
    rows = [("=a", 1000), ("=b", 100), ("=c", 10)]
    mix = mixing.plan_mix(spark.createDataFrame(rows, "mix_source string, mix_tokens long"), evenness=1.0, max_repeats=3.0)
    got = {r.mix_source: r.budget / r.tokens for r in mix.sources.collect()}
    assert got["=a"] == 1 and got["=c"] == pytest.approx(3, abs=0.06)


def test_sharding_shuffles(spark):
    df = spark.range(4000).selectExpr("id", "id % 3 AS `Slot`", "map('k', id) AS m")
    got = sharding.shuffle_into_shards(df, 3).collect()
    assert sorted(r.id for r in got) == list(range(4000))
    order = [r.id for r in sorted(got, key=lambda r: (r.slot, r.shard))]
    rises = sum(a < b for a, b in zip(order, order[1:]))
    assert 1800 < rises < 2200


def test_sharding_numbers_repeated_rows(spark):
    rows = spark.range(900).selectExpr("1 AS a", "'same' AS b").union(spark.range(100).selectExpr("cast(id AS int)", "cast(null AS string)"))
    got = sharding.shuffle_into_shards(rows, 7, bucket_bytes=2048).collect()
    assert Counter((r.a, r.b) for r in got) == Counter([(1, "same")] * 900 + [(i, None) for i in range(100)])
    places = sorted(r.slot * 7 + r.shard for r in got)
    assert places == list(range(1000))
    first = [r for r in got if r.slot * 7 + r.shard < 500 and r.b is None]
    assert 25 < len(first) < 75, "repeated rows are spread over the whole permutation"


def test_language_of_pages_by_markup_and_address(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").selectExpr("page_id", "url", "html", "regexp_replace(html, '<[^>]*>', ' ') AS body")
    found = language_id.identify(pages, text="body", declared=None, host="url", markup="html").collect()
    assert len(found) == pages.count()
    same = [r.language == r.declared_language for r in found if r.declared_language]
    assert sum(same) >= 0.9 * len(same)


def test_language_query(spark, small):
    """Pages are evidence only: a row for each document, with the language it declares."""
    got = queries.op6_language_id(spark, small).collect()
    docs = {d.doc_id: d for d in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    lettered = [r for r in got if any(c.isalpha() for c in docs[r.doc_id].text or "")]
    assert all(r.kept and r.language == docs[r.doc_id].lang for r in lettered)
    assert not any(r.kept for r in got if r not in lettered)


def test_language_of_few_texts(spark):
    """A language that one text declares is modelled; nothing is needed to be accepted but letters."""
    rows = [(1, "der hund und die katze sind im haus", "de", "a"), (2, "the dog and the cat are in the house", "en", "a"), (3, "the house and the dog", None, "a"), (4, "die katze und der hund", None, "b"), (5, "12 34", None, "b"), (6, None, "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.language, r.accepted) for r in language_id.identify(df).collect()}
    assert got == {1: ("de", True), 2: ("en", True), 3: ("en", True), 4: ("de", True), 5: ("und", False), 6: ("und", False)}


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hidden = docs.selectExpr("doc_id", "text", "source", "lang AS truth", "if(doc_id % 2 = 0, lang, null) AS lang")
    held = [r for r in language_id.identify(hidden).collect() if r.doc_id % 2]
    assert sum(r.language == r.truth for r in held) >= 0.98 * len(held)
    assert all(r.accepted for r in held)


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = quality_classifier.classify(docs, labels.where("doc_id % 2 = 0"), keep=["doc_id"])
    held = found.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum((r.p_quality >= 0.5) == (r.quality == 1) for r in held) >= 0.97 * len(held)
    toxic = [r.p_toxic >= 0.5 for r in held if r.toxic == 1]
    clean = [r.p_toxic >= 0.5 for r in held if r.toxic == 0]
    assert sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_quality_awkward(spark):
    docs = X.documents(spark, X.awkward(), [(None, None, None, None, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(5, 1, None), (10, 0, 1), (99, 1, 1), (None, 0, 0)], none.schema)
    for labels in (none, some):
        got = quality_classifier.classify(docs, labels).collect()
        assert len(got) == docs.count()
        assert all(0 <= r.p_quality <= 1 and 0 <= r.p_toxic <= 1 for r in got)
        assert not any(r.keep for r in got if not (r.text or "").strip())
    assert quality_classifier.classify(docs.limit(0), some).count() == 0
