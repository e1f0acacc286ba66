"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior over languages:

* the text: byte-trigram likelihoods, counted over all texts that declare a
  language, against a flat background for texts in none of them;
* the declared language (a column or the markup's ``lang`` attribute), weighed
  by how often the declaration agrees with the texts;
* the host, and above it the suffix of its address: priors from grouped sums
  of the texts' posteriors, each level smoothed towards the one above it
  (host, suffix, all rows).

Counts and sums are grouped aggregates with partial sums before the shuffle;
texts are read in place and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm import textarrays as ta
from millrace.llm.carried import Carried
from millrace.llm.joins import join_groups
from millrace.llm.storage import stored

BINS = 1 << 14
#: Trigrams overlap, so their evidence counts for about a third each.
TEMPER = 1 / 3
#: Weight of the level above in a host's or suffix's prior, in documents.
SMOOTHING = 20.0
#: Trigrams that the pooled counts of all languages count for in a language's own: languages of few texts lean on them.
POOLED = 2_000.0
#: Log-odds against the background before the text is seen.
BACKGROUND = 10.0
NONE = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin of the trigram at each place, whether it counts); letters only, others as blanks."""
    low = _FOLD[data]
    n = len(low)
    if n < 3:
        return np.zeros(n, np.int64), np.zeros(n, bool)
    wide = low.astype(np.uint32)
    code = np.zeros(n, np.uint32)
    code[: n - 2] = (wide[: n - 2] << 16) | (wide[1 : n - 1] << 8) | wide[2:]
    bins = ((code * np.uint32(2654435761)) >> np.uint32(32 - 14)).astype(np.int64)
    blank = low == 32
    counts = np.zeros(n, bool)
    counts[: n - 2] = ~(blank[: n - 2] & blank[1 : n - 1]) & ~(blank[1 : n - 1] & blank[2:])
    ends = offsets[1:][offsets[1:] > offsets[:-1]]
    counts[ends - 1] = False
    counts[np.maximum(ends - 2, 0)] = False
    return bins, counts


def declared_language(declared: str | None, markup: str | None) -> Column:
    """Two-letter code from a column, else from the ``lang`` attribute of a page's html tag; null for none."""
    code = lambda c: F.nullif(F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]{2})(?:$|[-_])", 1), F.lit(""))
    found = []
    if declared:
        found.append(code(F.col(f"`{declared}`").cast("string")))
    if markup:
        found.append(code(F.regexp_extract(F.col(f"`{markup}`"), r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2}(?:[-_][A-Za-z0-9]+)*)", 1)))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def host_of(address: str | None) -> Column:
    """The host of an address, or the whole value where it holds no scheme; null for none."""
    if not address:
        return F.lit(None).cast("string")
    value = F.lower(F.trim(F.col(f"`{address}`").cast("string")))
    inside = F.regexp_extract(value, r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.nullif(F.when(inside != "", inside).otherwise(value), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label of a host's name; empty where it has none."""
    return F.regexp_extract(host, r"\.([a-z]{2,})$", 1)


@dataclass
class Model:
    """Log-likelihoods of trigram bins; the last row is the background."""

    languages: list[str]
    weights: np.ndarray


def fit(marked: DataFrame, body: str) -> Model:
    """Trigram counts of all texts per declared two-letter language, shrunk towards those of all texts.

    The driver gets a row of BINS sums a language, at most 26 * 26 of them (44 MB of weights); each task
    holds and sends the same for the languages that it meets.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = ta.text_bytes(batch.column(0))
            declared = np.array(batch.column(1).to_pylist(), dtype=object)
            for i, j in ta.runs(offsets):
                own = offsets[i : j + 1]
                bins, counts = _trigrams(data[own[0] : own[-1]], own - own[0])
                names, which = np.unique(declared[i:j].astype(str), return_inverse=True)
                spread = np.repeat(which, np.diff(own))
                table = np.bincount(spread[counts] * BINS + bins[counts], minlength=len(names) * BINS).reshape(len(names), BINS)
                for k, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + table[k]
        for name, table in sums.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(table[at], pa.int64())], names=["language", "bin", "n"])

    ta.limit_batches(marked)
    summed = marked.where("__declared IS NOT NULL").select(F.col(f"`{body}`"), "__declared").mapInArrow(count, "language string, bin int, n long").groupBy("language", "bin").agg(F.sum("n").alias("n"))
    rows = stored(summed.groupBy("language").agg(F.collect_list("bin").alias("bins"), F.collect_list("n").alias("counts")))
    found = {r.language: (r.bins, r.counts) for r in rows.toLocalIterator()}
    languages = sorted(found)
    table = np.zeros((len(languages) + 1, BINS))
    for k, x in enumerate(languages):
        table[k, found[x][0]] = found[x][1]
    pooled = table.sum(axis=0) + 0.5
    table[:-1] += POOLED * pooled / pooled.sum()
    table[-1] += 0.5
    return Model(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def _score(model) -> ta.Compute:
    """Tempered log-likelihood of each text under each language and the background."""

    def compute(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        weights = model.value.weights
        n_texts = len(offsets) - 1
        bins, counts = _trigrams(data, offsets)
        text = np.repeat(np.arange(n_texts), np.diff(offsets))[counts]
        at = bins[counts]
        letters = ta.per_text(_FOLD[data] != 32, offsets)
        scores = np.stack([np.bincount(text, weights=row[at], minlength=n_texts) for row in weights], axis=1) * TEMPER
        flat = pa.array(scores.ravel(), pa.float64())
        return [pa.ListArray.from_arrays(pa.array(np.arange(n_texts + 1) * len(weights), pa.int32()), flat), pa.array(letters, pa.int64())]

    return compute


def _softmax(scores: Column) -> Column:
    """Probabilities of an array of log-weights."""
    powers = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def _priors(scored: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """(host priors, likelihoods of declarations), each an array of log-weights in the model's order.

    Background texts speak for no language and stay out of the sums.
    """
    k = len(model.languages)
    text_only = _softmax(F.slice("__ll", 1, k))
    parts = F.filter(F.transform(text_only, lambda p, i: F.struct(i.alias("language"), p.alias("p"))), lambda x: x["p"] > 0)
    known = scored.where((F.col("__letters") > 0) & (F.array_max(F.slice("__ll", 1, k)) > F.element_at("__ll", k + 1) - BACKGROUND))
    summed = stored(
        known.select("__host", "__suffix", "__declared", F.explode(parts).alias("x"))
        .groupBy("__host", "__suffix", "__declared", "x.language")
        .agg(F.sum("x.p").alias("n"))
    )

    def array_of(df: DataFrame, by: list[str]) -> DataFrame:
        cells = [F.sum(F.when(F.col("language") == i, F.col("n")).otherwise(0.0)) for i in range(k)]
        return df.groupBy(*by).agg(F.array(*cells).alias("n")) if by else df.agg(F.array(*cells).alias("n"))

    def shrink(own: Column, above: Column) -> Column:
        total = F.aggregate(own, F.lit(0.0), lambda a, y: a + y)
        return F.zip_with(own, above, lambda x, y: (x + SMOOTHING * y) / (total + SMOOTHING))

    flat = [1.0 / k] * k
    all_row = array_of(summed, []).first()
    overall = np.array([x or 0.0 for x in all_row["n"]]) if all_row else np.zeros(k)
    overall = (overall + SMOOTHING * np.array(flat)) / (overall.sum() + SMOOTHING)
    top = F.array(*[F.lit(float(x)) for x in overall])
    by_host = summed.groupBy("__host", "__suffix", "language").agg(F.sum("n").alias("n"))
    suffixes = array_of(by_host, ["__suffix"]).select("__suffix", shrink(F.col("n"), top).alias("above"))
    hosts = array_of(by_host, ["__host", "__suffix"]).join(suffixes, "__suffix").select("__host", shrink(F.col("n"), F.col("above")).alias("prior"))
    declared = array_of(summed.where("__declared IS NOT NULL"), ["__declared"])
    # p(declared | language), smoothed by one declaration in a hundred texts of the language at random
    per_language = array_of(summed.where("__declared IS NOT NULL"), []).first()
    sizes = F.array(*[F.lit(float((x or 0.0) if per_language else 0.0)) for x in (per_language["n"] if per_language else flat)])
    likely = declared.select("__declared", F.zip_with("n", sizes, lambda x, s: F.log((x + 0.01 * s / 100 + 0.1) / (s + 10.0))).alias("said"))
    return (
        stored(hosts.select("__host", F.transform("prior", lambda p: F.log(p)).alias("prior"))),
        stored(likely),
    )


RESULTS = ["language", "language_p", "text_language", "declared_language", "accepted"]


def identify(
    df: DataFrame,
    text: str = "text",
    declared: str | None = "lang",
    host: str | None = "source",
    markup: str | None = None,
    least_p: float = 0.5,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add the fused language of each text to the carried columns.

    language: the most probable, ``und`` where no language fits the text better than
    the background; language_p: its posterior; text_language: the text's evidence alone;
    declared_language: what was declared; accepted: a language was found with ``least_p`` or more.

    declared, host, markup: columns of declared codes, of hosts or addresses and
    of markup with a lang attribute; each may be None.

    Every declared two-letter language is modelled; other codes count as none.

    Defined cases: null and empty texts, and texts without letters, are ``und``
    and not accepted; rows without host or declaration go without that
    evidence; ties take the first code in order; without a single declared
    language nothing is accepted; repeated rows each stay; an empty table gives
    no rows; input columns named as a result are replaced.
    """
    own = Carried(df, RESULTS, keep)
    column = lambda name: own.find(name) if name else None
    keep = own.columns()
    host_column = host_of(column(host))
    body = own.find(text)
    if body not in keep or own.rows.schema[body].dataType.typeName() != "string":
        body = "__body"
    marked = own.rows.select(
        *keep,
        *([F.col(own.find(text)).cast("string").alias("__body")] if body == "__body" else []),
        declared_language(column(declared), column(markup)).alias("__declared"),
        host_column.alias("__host"),
        F.coalesce(suffix_of(host_column), F.lit("")).alias("__suffix"),
    )
    model = fit(marked, body)
    if not model.languages:
        return marked.select(*own.restored(), F.lit(NONE).alias("language"), F.lit(0.0).alias("language_p"), F.lit(NONE).alias("text_language"), F.col("__declared").alias("declared_language"), F.lit(False).alias("accepted"))
    sent = df.sparkSession.sparkContext.broadcast(model)
    score = lambda columns: ta.with_text_columns(marked, body, [("__ll", "array<double>"), ("__letters", "long")], _score(sent), keep=columns)
    evidence = ["__declared", "__host", "__suffix"]
    hosts, likely = _priors(score(evidence), model)
    k = len(model.languages)
    joined = join_groups(score([*keep, *evidence[:2]]), hosts, ["__host"], 16 * k + 64)
    joined = join_groups(joined, likely, ["__declared"], 8 * k + 16)
    names = F.array(*[F.lit(x) for x in model.languages])
    nothing = F.array(*[F.lit(0.0)] * k)
    ll = F.slice("__ll", 1, k)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = joined.select(
        *keep,
        "__declared",
        ((F.col("__letters") > 0) & (F.array_max(ll) > F.element_at("__ll", k + 1) - BACKGROUND)).alias("__fits"),
        F.element_at(names, F.array_position(ll, F.array_max(ll)).cast("int")).alias("__by_text"),
        _softmax(add(add(ll, F.coalesce("prior", nothing)), F.coalesce("said", nothing))).alias("__p"),
    )
    best = F.array_max("__p")
    fits = F.col("__fits")
    return fused.select(
        *own.restored(),
        F.when(fits, F.element_at(names, F.array_position("__p", best).cast("int"))).otherwise(NONE).alias("language"),
        F.when(fits, F.round(best, 6)).otherwise(0.0).alias("language_p"),
        F.when(fits, F.col("__by_text")).otherwise(NONE).alias("text_language"),
        F.col("__declared").alias("declared_language"),
        (fits & (best >= least_p)).alias("accepted"),
    )


def in_a_language(df: DataFrame, text: str = "text", declared: str | None = "lang", host: str | None = "source", markup: str | None = None, least_p: float = 0.5) -> DataFrame:
    """The rows in which a language was found, columns as they were, whatever their names.

    Defined cases as in ``identify``: null and empty texts and those without letters go; repeated rows each stay or go.
    """
    own = Carried(df)
    column = lambda name: own.find(name) if name else None
    found = identify(own.rows, own.find(text), column(declared), column(host), column(markup), least_p)
    return found.where("accepted").select(*own.restored())
