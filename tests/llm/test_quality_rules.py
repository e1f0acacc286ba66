"""Fences that follow the spread of their groups."""

from millrace.llm import quality_rules as Q
from tests.llm import texts as X

SCHEMA = "doc_id long, g_lang string, g_source string, " + ", ".join(f"{n} {t}" for n, t in Q.COUNTS)


def counted(spark):
    """Two sources of 400 texts: one with lines and words repeated by habit, one almost without."""
    rows = []
    for source, often in (("calm", 100), ("lists", 2)):
        for i in range(400):
            repeats = i % often == 0
            rows.append((len(rows), "en", source, 100, 480 + i % 40, 0, 10, 4 if repeats and source == "lists" else 0, 18 if repeats and source == "lists" else int(repeats)))
    rows += [(1000, "en", "calm", 100, 500, 0, 10, 4, 0), (1001, "en", "calm", 100, 500, 0, 10, 0, 18), (1002, "en", "calm", 100, 700, 0, 10, 0, 0), (1003, "en", "calm", 100, 480, 0, 10, 0, 0)]
    # Junk: a tenth of the source, and texts that the base rule rejects.
    rows += [(2000 + i, "en", "calm", 100, 800, 300, 10, 0, 0) for i in range(40)] + [(3000 + i, "en", "calm", 100, 500, 0, 10, 9, 90) for i in range(40)]
    return spark.createDataFrame(rows, SCHEMA)


def test_fences_follow_the_group(spark):
    failed = {r.doc_id: set(r.failed) for r in Q.judged(counted(spark), ["doc_id"], 4.0, 100).collect()}
    assert failed[1000] == {"dup_line_rate"} and failed[1001] == {"repeat_rate"}  # below the fixed 0.5 and 0.2
    assert failed[1002] == {"word_length"} and failed[1003] == set()
    assert all({"symbol_rate", "word_length"} <= failed[2000 + i] for i in range(40))
    assert all("repeat_rate" in failed[3000 + i] for i in range(40))
    assert not any(failed[i] for i in range(800)), "what a source does by habit passes there"


def test_floor_seldom_decides(spark):
    rows = Q.learnt(counted(spark), 4.0, 100).collect()
    assert len(rows) == 8
    assert {r.measure for r in rows if r.floored} <= {"symbol_rate", "word_length"}


def test_group_of_junk_takes_the_fence_above(spark):
    junk = spark.createDataFrame([(5000 + i, "en", "junk", 100, 800, 300, 10, 9, 90) for i in range(120)], SCHEMA)
    got = Q.judged(counted(spark).union(junk), ["doc_id"], 4.0, 100).where("doc_id >= 5000").collect()
    assert len(got) == 120 and not any(r.passes for r in got)


def test_tables_without_a_sound_text(spark):
    docs = X.documents(spark, ["a b", None, ""])
    assert [r.passes for r in Q.quality_rules(docs).collect()] == [True] * 3
