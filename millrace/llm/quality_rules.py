"""Quality rules with thresholds learnt per language and source.

Counts over whole texts are made batch by batch; quality measures derived from
them go into mergeable quantile sketches (relative-error histograms with
logarithmic bins, as in DDSketch) per language and source.  Sketches of small
groups are merged upwards, to the language and then to all rows.  Robust upper
and lower fences from the sketches take the place of fixed cutoffs, and one join
brings them back to the rows.  Texts that are plainly junk do not teach the fences.

The sketches are plain grouped counts: exact to merge, the same on every run,
and bounded in size per group (bins follow the logarithm of the value's range).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from millrace.llm import textarrays as ta
from millrace.llm.carried import Carried
from millrace.llm.joins import join_groups
from millrace.llm.storage import stored

_WORD = ~ta.byte_set([0x20, *range(0x09, 0x0E)])
_SYMBOL = ta.byte_set(b"#*$%&|<>")
_CONTINUED = np.arange(256) & 0xC0 == 0x80
_REPEAT = 5

COUNTS = [(n, "long") for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")]


def count_texts(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """The counts of ``COUNTS`` for each text."""
    n = len(offsets) - 1
    inside = _WORD[data]
    start, end, text = ta.words(data, offsets, inside)
    hashes = ta.prefix_hash(data)
    salt = ta.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))

    begin = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    begin = begin[begin < len(data)]
    stop = np.concatenate([begin[1:], [len(data)]]) if len(begin) else begin
    owner = np.searchsorted(offsets, begin, side="right") - 1
    stop = np.minimum(stop, offsets[owner + 1])
    stop = stop - ((stop > begin) & (data[stop - 1] == 10)) if len(stop) else stop
    worded = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=worded[1:])
    lines = worded[stop] > worded[begin]
    begin, stop, owner = begin[lines], stop[lines], owner[lines]
    _, again = ta.repeated(ta.span_hash(hashes, begin, stop) ^ salt[owner])

    grams, at = ta.ngrams(ta.span_hash(hashes, start, end), text, _REPEAT)
    many, _ = ta.repeated(grams ^ salt[text[at]])
    repeats = ta.covered(at[many], _REPEAT, len(start))
    return [
        pa.array(x, pa.int64())
        for x in (
            np.bincount(text, minlength=n),
            ta.per_text(inside & ~_CONTINUED[data], offsets),
            ta.per_text(_SYMBOL[data], offsets),
            np.bincount(owner, minlength=n),
            np.bincount(owner[again], minlength=n),
            np.bincount(text[repeats], minlength=n),
        )
    ]


#: Bins grow by this factor; a quantile is off by about half of it, 2.5 %.
GROWTH = 1.05
#: Values below this share the bin of zero.
SMALLEST = 1e-3

def measures() -> dict[str, Column]:
    """Quality measures; null where a text has no words."""
    n = F.nullif(F.col("n_words"), F.lit(0))
    return {
        "symbol_rate": F.col("n_symbols") / n,
        "word_length": F.col("word_chars") / n,
        "dup_line_rate": F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0)),
        "repeat_rate": F.col("n_repeat_words") / n,
    }


#: A fence is this many bins from the median at least, so that a group without
#: spread does not reject the first text that differs a little.
LEAST_BINS = 2
#: Where most values are zero the upper fence starts at this quantile.
TAIL = 0.99


def bin_of(value: Column) -> Column:
    return F.when(value < SMALLEST, F.lit(-1)).otherwise(F.ceil(F.log(value / SMALLEST) / float(np.log(GROWTH)))).cast("int")


def bin_value(number: Column) -> Column:
    middle = F.pow(F.lit(GROWTH), number.cast("double")) * (2 * SMALLEST / (1 + GROWTH))
    return F.when(number < 0, F.lit(0.0)).otherwise(middle)


def sketches(rows: DataFrame, group: list[str], values: dict[str, Column]) -> DataFrame:
    """(group, measure, bin, n): grouped counts, combined before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), bin_of(v).alias("bin")) for m, v in values.items()])
    return (
        rows.select(*group, F.explode(pairs).alias("p"))
        .where("p.bin IS NOT NULL")
        .groupBy(*group, "p.measure", "p.bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quantiles(sketch: DataFrame, group: list[str]) -> DataFrame:
    """(group, measure, total, q1, q2, q3, tail, p1, p3) of sketches; p1 and p3 are quartiles of the values above zero.

    A group and measure hold as many rows as bins, some hundreds at most.
    """
    by = Window.partitionBy(*group, "measure")
    zeros = F.coalesce(F.sum(F.when(F.col("bin") < 0, F.col("n"))).over(by), F.lit(0))
    summed = sketch.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("total", F.sum("n").over(by)).withColumn("zeros", zeros)
    at = lambda r: bin_value(F.min(F.when(F.col("upto") >= F.ceil(F.lit(r) * F.col("total")), F.col("bin"))))
    positive = lambda r: bin_value(F.min(F.when((F.col("bin") >= 0) & (F.col("upto") - F.col("zeros") >= F.ceil(F.lit(r) * (F.col("total") - F.col("zeros")))), F.col("bin"))))
    found = {"q1": at(0.25), "q2": at(0.5), "q3": at(0.75), "tail": at(TAIL), "p1": positive(0.25), "p3": positive(0.75)}
    return summed.groupBy(*group, "measure").agg(F.max("total").alias("total"), *[v.alias(k) for k, v in found.items()])


def fences(sketch: DataFrame, groups: DataFrame, spread: float, least_rows: int) -> DataFrame:
    """(g_lang, g_source, measure, low, high, floored) for each group and measure of ``groups``.

    The fence lies ``spread`` inter-quartile ranges beyond the quartiles.  Where
    the lower quartile is zero (most texts have no symbols or repeats) the upper one
    lies at least an inter-quartile range of the values above zero beyond the
    ``TAIL`` quantile, that of the language or of all rows if this is zero too.  floored: the upper fence is only that of ``LEAST_BINS``.
    A group of fewer than ``least_rows`` rows takes its language's fence, and a
    language of fewer that of all rows.
    """
    names, tails = ["q1", "q2", "q3"], ["tail", "p1", "p3"]
    by_lang = sketch.groupBy("g_lang", "measure", "bin").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("measure", "bin").agg(F.sum("n").alias("n"))
    named = lambda df, p: df.select(*[c for c in df.columns if c.startswith("g_") or c == "measure"], *[F.col(c).alias(f"{p}_{c}") for c in ("total", *names, *tails)])
    own = named(quantiles(sketch, ["g_lang", "g_source"]), "o")
    langs = named(quantiles(by_lang, ["g_lang"]), "l")
    every = named(quantiles(overall, []), "a")
    joined = groups.join(own, ["g_lang", "g_source", "measure"], "left").join(langs, ["g_lang", "measure"], "left").join(every, "measure", "left")
    pick = lambda q: F.when(F.col("o_total") >= least_rows, F.col(f"o_{q}")).when(F.col("l_total") >= least_rows, F.col(f"l_{q}")).otherwise(F.col(f"a_{q}"))
    width = F.col("q3") - F.col("q1")
    least = F.greatest("q2", F.lit(SMALLEST)) * (GROWTH**LEAST_BINS - 1)
    above = lambda p: F.when((F.col(f"{p}_total") >= least_rows) & (F.col(f"{p}_tail") > 0), F.col(f"{p}_tail") + F.col(f"{p}_p3") - F.col(f"{p}_p1"))
    tail = F.coalesce(above("o"), above("l"), F.greatest("a_tail", "a_p3") + F.col("a_p3") - F.col("a_p1"))
    high = F.greatest(F.col("q3") + spread * width, F.when(F.col("q1") == 0, F.col("tail")))
    return joined.select("g_lang", "g_source", "measure", *[pick(q).alias(q) for q in names], tail.alias("tail")).select(
        "g_lang",
        "g_source",
        "measure",
        F.least(F.col("q1") - spread * width, F.col("q2") - least).alias("low"),
        F.greatest(high, F.col("q2") + least).alias("high"),
        (high < F.col("q2") + least).alias("floored"),
    )


def quality_rules(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", spread: float = 4.0, least_rows: int = 100, keep: list[str] | None = None) -> DataFrame:
    """Counts, the verdict of the adaptive rules, and what failed.

    Adds to the carried columns: the counts of ``COUNTS``, ``failed`` (array of
    measures outside their group's fences) and ``passes`` (none failed).

    Defined cases: a text without words (null, empty, blank) has counts of 0,
    null measures and passes here (a word minimum is the caller's rule); a null
    language or source is a group of its own; texts are read whole; repeated
    rows each stay; an empty table gives an empty result; input columns named
    as a result are replaced.
    """
    own = Carried(df, [*(n for n, _ in COUNTS), "failed", "passes"], keep)
    group = lambda name: F.coalesce(F.concat(F.lit("="), F.col(own.find(name)).cast("string")), F.lit(""))  # noqa: E731  null is no value's key
    marked = own.rows.select(*own.rows.columns, group(lang).alias("g_lang"), group(source).alias("g_source"))
    counted = stored(ta.with_text_columns(marked, own.find(text), COUNTS, count_texts, keep=[*own.columns(), "g_lang", "g_source"]))
    return judged(counted, own.columns(), spread, least_rows).select(*own.restored(), *[n for n, _ in COUNTS], "failed", "passes")


def learnt(counted: DataFrame, spread: float, least_rows: int) -> DataFrame:
    """Fences of all groups, in two passes so that junk does not stretch the fences that should reject it.

    Texts that fail the base rule teach nothing.  Of the others, those outside the
    fences of measures with values above zero in most texts (word length) stay
    out of the second sketches, from which all fences are taken.
    """
    values = measures()
    group = ["g_lang", "g_source"]
    sound = counted.where(~base_failed())
    groups = counted.select(*group).distinct().select(*group, F.explode(F.array(*[F.lit(m) for m in values])).alias("measure"))
    common = fences(sketches(sound, group, values), groups, spread, least_rows).where("low > 0")
    return fences(sketches(_within(sound, common, values).where(F.size("failed") == 0), group, values), groups, spread, least_rows)


def _within(rows: DataFrame, limits: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``rows`` with their group's fences joined and failed, the measures outside them."""
    wide = limits.groupBy("g_lang", "g_source").agg(*[F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in values for side in ("low", "high")])
    bad = [F.when((v < F.col(f"{m}_low")) | (v > F.col(f"{m}_high")), F.lit(m)) for m, v in values.items()]
    return join_groups(rows, stored(wide), ["g_lang", "g_source"], 256).withColumn("failed", F.array_compact(F.array(*bad)))


def judged(counted: DataFrame, keep: list[str], spread: float, least_rows: int) -> DataFrame:
    """Fences of the counted rows, joined back to them."""
    found = _within(counted, learnt(counted, spread, least_rows), measures())
    return found.select(*keep, *[n for n, _ in COUNTS], "failed").withColumn("passes", F.size("failed") == 0)


def base_failed() -> Column:
    """The fixed base rule: too few words, or over 20 % of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
