"""Every operator on tables whose columns are called like its own, or oddly; all columns come back as they were."""

import pytest

from millrace.llm import decontaminate, jaccard_join, language_id, licenses, mixing, quality_classifier, quality_rules, secrets_scan, sharding, suffix_dedup
from tests.llm import texts as X

NAMES = """a.b A `tick` c0 c1 c5 made0 body id key sig size t1 t2 h row lot bucket n start item pos place mark n_x wid row_id component node other
mix_row mix_source mix_place mix_slice mix_rows mix_lot mix_first mix_copy mix_draw mix_draws full cut rest budget tokens prior said
__ll __letters __declared __host __suffix __body __fits __p __by_text g_lang g_source k1 k2 whole_sha256 cut_sha256 n_hit_ spans_ base ident opaque endpoint
parts __quality __toxic __bins __path __site_quality symbol_rate_low word anchor content firsts numbers Measure""".split()


@pytest.fixture(scope="module")
def docs(spark):
    made = X.documents(spark, X.awkward(), [(None, None, None, None, None), (3, "x", "en", None, 1), (3, "x", "en", None, 1)])
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    return made.selectExpr("*", *[f"concat('{i}:', doc_id) AS {quoted(c)}" for i, c in enumerate(NAMES)]).cache()


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, X.awkward()[17], "x"), (2, None, "y")], "item_id long, text string, `a.b` string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, None, "z"), (10, 0, 1, "z"), (11, 1, 0, "z")], "doc_id long, quality int, toxic int, `a.b` string")


CASES = {
    "mixed": lambda d, b, l: mixing.mixed(d),
    "mix_order": lambda d, b, l: mixing.mix_order(c := mixing.count_tokens(d), mixing.plan_mix(c.select(mixing.source_key("source"), "mix_tokens"))),
    "sharding": lambda d, b, l: sharding.shuffle_into_shards(d, 4),
    "one_of_each": lambda d, b, l: jaccard_join.one_of_each(d),
    "classify": lambda d, b, l: quality_classifier.classify(d, l),
    "remove_repeats": lambda d, b, l: suffix_dedup.remove_repeats(d),
    "identify": lambda d, b, l: language_id.identify(d),
    "in_a_language": lambda d, b, l: language_id.in_a_language(d),
    "secret_scan": lambda d, b, l: secrets_scan.secret_scan(d),
    "contamination_report": lambda d, b, l: decontaminate.contamination_report(d, b),
    "decontaminate": lambda d, b, l: decontaminate.decontaminate(d, b),
    "quality_rules": lambda d, b, l: quality_rules.quality_rules(d),
    "license_scan": lambda d, b, l: licenses.license_scan(d),
}


@pytest.mark.parametrize("name", CASES)
def test_columns_come_back(docs, benchmark, labels, name):
    got = CASES[name](docs, benchmark, labels)
    assert got.columns[: len(docs.columns)] == docs.columns
    rows = got.collect()
    assert rows
    by_id = {r[0]: r for r in docs.collect() if r[0] != 3}
    for r in rows:
        for i, c in enumerate(NAMES):
            assert r[5 + i] == (None if r[0] is None else f"{i}:{r[0]}"), c
        if r[0] in by_id:
            assert r[1:5] == by_id[r[0]][1:5]
    if name not in ("mixed", "mix_order", "one_of_each", "in_a_language", "decontaminate"):
        assert len(rows) == docs.count()
