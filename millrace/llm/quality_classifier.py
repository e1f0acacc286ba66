"""Quality classifier: document evidence and site posteriors, by empirical Bayes.

A document classifier is fitted on a bounded sample of labelled documents:
logistic regressions over the shape of a text and the words whose shares of
the classes clearly differ.  Every document gets two probabilities from it, quality
and toxicity.  Their means per host and per path of a host are then shrunk
towards the level above (path, host, all documents), with the strength
of shrinking estimated from the spread between sites; sparse sites thus follow the
global prior.  A document's final odds are its own evidence times its site's prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm import textarrays as ta
from millrace.llm.carried import Carried
from millrace.llm.joins import join_groups
from millrace.llm.storage import stored

BINS = 1 << 16
#: A word is looked at when its share of the two classes differs by so many standard errors.
CLEAR = 5.0

_WORD = ~ta.byte_set([0x20, *range(0x09, 0x0E)])
_SYMBOL = ta.byte_set(b"#*$%&|<>!")
_UPPER = ta.byte_set(range(65, 91))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = ta.byte_set([*range(97, 123), *range(128, 256)])
#: Bins for the shape of a text, beside those of its words.
SHAPES = 5 * 8


def _presences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bin), each pair once: words by hash, then the text's shape.

    Shapes are eighths of: words with symbols, upper-case words, words equal to
    the one before or of repeated five-word windows, distinct words, and the
    logarithm of the mean word length.
    """
    n = len(offsets) - 1
    low = _LOWER[data]
    start, end, text = ta.words(low, offsets, _LETTER[low])
    value = ta.span_hash(ta.prefix_hash(low), start, end)
    words = (value % np.uint64(BINS)).astype(np.int64)
    width = BINS + SHAPES
    pairs = [np.unique(text * width + words)]

    first, last, owner = ta.words(data, offsets, _WORD[data])
    counts = np.maximum(np.bincount(owner, minlength=n), 1)
    some = lambda flags: ta.per_text_spans(flags, first, last)
    raw = ta.span_hash(ta.prefix_hash(data), first, last)
    salt = ta.mix(np.arange(n, dtype=np.uint64) + np.uint64(7))
    grams, at = ta.ngrams(raw, owner, 5)
    many, _ = ta.repeated(grams ^ salt[owner[at]])
    repeat = ta.covered(at[many], 5, len(first))
    if len(raw):
        repeat[1:] |= (raw[1:] == raw[:-1]) & (owner[1:] == owner[:-1])
    _, again = ta.repeated(raw ^ salt[owner])
    rate = lambda flags: np.bincount(owner[flags], minlength=n) / counts
    length = np.log2(np.bincount(owner, weights=last - first, minlength=n) / counts + 1) / 8
    shapes = [rate(some(_SYMBOL[data]) > 0), rate((some(_UPPER[data]) > 1)), rate(repeat), rate(~again), length]
    for k, share in enumerate(shapes):
        eighth = np.minimum((share * 8).astype(np.int64), 7)
        pairs.append((np.arange(n) * width + BINS + k * 8 + eighth)[np.bincount(owner, minlength=n) > 0])
    return np.divmod(np.concatenate(pairs), width)


@dataclass
class Evidence:
    """Words that speak for a label, and the labels' weights over (shapes, words)."""

    words: np.ndarray  # sorted bins
    weights: dict[str, np.ndarray]
    offset: dict[str, float]  # fitted intercept less the sample's prior odds
    prior: dict[str, float]  # log-odds of the label in the sample


def _columns(doc: np.ndarray, bins: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of what the classifier sees: shapes first, then chosen words."""
    shape = bins >= BINS
    at = np.minimum(np.searchsorted(words, bins), max(len(words) - 1, 0))
    chosen = (words[at] == bins) & ~shape if len(words) else np.zeros(len(bins), bool)
    return np.concatenate([doc[shape], doc[chosen]]), np.concatenate([bins[shape] - BINS, at[chosen] + SHAPES])


def _chosen_words(labelled: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(all bins whose presence stands clear of chance for some label, labelled documents per label and class)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(names), 2, BINS + 1), np.int64)
        for batch in batches:
            data, offsets = ta.text_bytes(batch.column(0))
            given = [np.array([-1 if v is None else v for v in batch.column(k + 1).to_pylist()], np.int64) for k in range(len(names))]
            for i, j in ta.runs(offsets):
                own = offsets[i : j + 1]
                doc, bins = _presences(data[own[0] : own[-1]], own - own[0])
                doc, bins = doc[bins < BINS], bins[bins < BINS]
                for k in range(len(names)):
                    for c in (0, 1):
                        of = given[k][i:j] == c
                        sums[k, c, :BINS] += np.bincount(bins[of[doc]], minlength=BINS)
                        sums[k, c, BINS] += int(of.sum())
        k, c, at = np.nonzero(sums)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(c, pa.int32()), pa.array(at, pa.int32()), pa.array(sums[k, c, at], pa.int64())], names=["label", "class", "bin", "n"])

    ta.limit_batches(labelled)
    rows = labelled.mapInArrow(count, "label int, class int, bin int, n long").groupBy("label", "class", "bin").agg(F.sum("n").alias("n"))
    table = np.zeros((len(names), 2, BINS + 1))
    for r in rows.toLocalIterator():  # labels x 2 x bins at most
        table[r["label"], r["class"], r["bin"]] = r["n"]
    found = []
    for k in range(len(names)):
        no, yes = table[k, 0, :BINS], table[k, 1, :BINS]
        n_no, n_yes = np.maximum(table[k, :, BINS], 1.0)
        share = (yes + no + 0.5) / (n_no + n_yes + 1.0)
        clear = np.abs(yes / n_yes - no / n_no) / np.sqrt(share * (1 - share) * (1 / n_yes + 1 / n_no))
        found.append(np.flatnonzero(clear >= CLEAR))
    return np.unique(np.concatenate(found)), table[:, :, BINS]


def fit(docs: DataFrame, labels: DataFrame, ids: str, text: str, names: list[str], sample: int, seed: int) -> Evidence:
    """Logistic regressions on at most ``sample`` labelled documents, chosen by hash of the id.

    The sample of labels is small enough to be broadcast (24 bytes a row); texts stay where they are.
    """
    given, texts = Carried(labels), Carried(docs)
    chosen = given.rows.select(F.col(given.find(ids)).alias("__id"), *[F.col(given.find(x)).cast("int").alias(f"__{x}") for x in names]).where("__id IS NOT NULL")
    chosen = stored(chosen.orderBy(F.xxhash64(F.lit(seed), "__id"), "__id", *[f"__{x}" for x in names]).limit(sample))
    labelled = texts.rows.select(F.col(texts.find(ids)).alias("__id"), F.col(texts.find(text)).cast("string").alias("__body")).join(F.broadcast(chosen), "__id").select("__body", *[f"__{x}" for x in names])
    words, classes = _chosen_words(labelled, names)
    width = SHAPES + len(words)

    def features(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        doc, at = _columns(*_presences(data, offsets), words)
        order = np.lexsort((at, doc))
        ends = np.searchsorted(doc[order], np.arange(len(offsets)))
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[order], pa.int32()))]

    sparse = F.udf(lambda at: Vectors.sparse(width, at, np.ones(len(at))), VectorUDT())
    rows = stored(ta.with_text_columns(labelled, "__body", [("__x", "array<int>")], features, keep=[f"__{x}" for x in names])).coalesce(8)  # a bounded sample, read in every iteration
    weights, offset, prior = {}, {}, {}
    for k, name in enumerate(names):
        prior[name] = float(np.log((classes[k, 1] + 1) / (classes[k, 0] + 1)))
        weights[name], offset[name] = np.zeros(width), 0.0
        if classes[k].min() > 0:
            known = rows.where(f"__{name} IN (0, 1)").select(sparse("__x").alias("features"), F.col(f"__{name}").cast("double").alias("label"))
            model = LogisticRegression(regParam=1e-4, maxIter=100, standardization=False).fit(known)
            weights[name], offset[name] = model.coefficients.toArray(), float(model.intercept) - prior[name]
    return Evidence(words, weights, offset, prior)


def _evidence(sent, names: list[str]) -> ta.Compute:
    def compute(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        found = sent.value
        presences = _presences(data, offsets)
        doc, at = _columns(*presences, found.words)
        n = len(offsets) - 1
        seen = np.bincount(presences[0], minlength=n)
        sums = [(np.bincount(doc, weights=found.weights[x][at], minlength=n) + found.offset[x]) * (seen > 0) for x in names]
        return [pa.array(np.round(x, 6), pa.float64()) for x in sums] + [pa.array(seen, pa.int64())]

    return compute


def site_of(own: Carried, host: str | None, path: str | None, address: str | None) -> tuple[Column, Column]:
    """(host, first part of the path) of an address, else of the columns that stand for them; null for none."""
    named = [F.col(own.find(x)).cast("string") if x else F.lit(None).cast("string") for x in (host, path)]
    if not address:
        return named[0], named[1]
    parts = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)(?::[0-9]*)?/?([^/?#]*)"
    given = F.col(own.find(address)).cast("string")
    known = F.regexp_extract(given, parts, 1) != ""
    return F.when(known, F.lower(F.regexp_extract(given, parts, 1))).otherwise(named[0]), F.when(known, F.regexp_extract(given, parts, 2)).otherwise(named[1])


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def shrunk_rates(means: DataFrame, levels: list[str], top: float, name: str) -> DataFrame:
    """Posterior mean rate of each path: path towards host towards all documents.

    means: (levels, n, s) with number and sum of probabilities.  A level's
    strength (documents that the level above counts for) is the method-of-moments
    estimate from the spread of the rates of its sites around the mean.
    """
    rates, above = None, F.lit(top)
    for depth in range(1, len(levels) + 1):
        by = levels[:depth]
        own = stored(means.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
        rate = F.col("s") / F.col("n")
        row = own.agg(
            F.sum("n").alias("n"),
            F.sum("s").alias("s"),
            F.sum(F.col("n") * rate * rate).alias("q"),
            F.sum(F.col("n") * F.col("n")).alias("nn"),
            F.count(F.lit(1)).alias("k"),
        ).first()
        strength = _strength(row)
        joined = own if rates is None else own.join(rates, by[:-1])
        rates = joined.select(*by, ((F.col("s") + strength * above) / (F.col("n") + strength)).alias("above"))
        above = F.col("above")
    return rates.withColumnRenamed("above", name)


def _strength(row) -> float:
    """Beta-binomial prior size from weighted between-site variance (within bounds)."""
    if not row["n"] or row["k"] < 2:
        return 100.0
    mean = row["s"] / row["n"]
    spread = row["q"] - row["n"] * mean * mean
    scale = row["n"] - row["nn"] / row["n"]
    noise = mean * (1 - mean)
    between = max(0.0, (spread - (row["k"] - 1) * noise) / scale) if scale > 0 else 0.0
    return float(min(1e4, max(1.0, noise / between - 1))) if between > 0 else 1e4


RESULTS = ["p_quality", "p_toxic", "doc_p_quality", "doc_p_toxic", "keep"]


def classify(
    docs: DataFrame,
    labels: DataFrame,
    ids: str = "doc_id",
    text: str = "text",
    host: str = "source",
    path: str | None = "lang",
    address: str | None = None,
    sample: int = 20_000,
    seed: int = 31,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add quality and toxicity posteriors to the carried columns.

    doc_p_*: from the text alone; p_*: with its site's prior; keep: quality of one half or more and
    toxicity below one half.  address: a column of addresses, whose host and first part of the path name the site;
    where it is None or holds no address, the columns host and path do (a part of a site in one
    language is the nearest to a path that rows without an address have).
    sample: the largest number of labelled documents that are fitted on (20,000
    by default), over every word that speaks clearly for a label; all other sums go over all documents.

    Defined cases: texts without words get the site's prior alone and are not kept;
    null hosts and paths are sites of their own; labels that are null, or of
    unknown documents, are left out; without labels every probability is one half;
    repeated rows each stay; an empty table gives no rows; input columns named
    as a result are replaced.
    """
    names = ["quality", "toxic"]
    own = Carried(docs, RESULTS, keep)
    keep = own.columns()
    evidence = fit(docs, labels, ids, text, names, sample, seed)
    sent = docs.sparkSession.sparkContext.broadcast(evidence)
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    site, part = site_of(own, host, path, address)
    marked = own.rows.select(*keep, F.col(own.find(text)).cast("string").alias("__body"), key(site).alias("__host"), key(part).alias("__path"))
    fields = [("__quality", "double"), ("__toxic", "double"), ("__bins", "long")]
    scored = ta.with_text_columns(marked, "__body", fields, _evidence(sent, names), keep=[*keep, "__host", "__path"])
    if own.find(text) not in keep:  # light rows: scored once
        scored = stored(scored)
    for x in names:
        scored = scored.withColumn(f"doc_p_{x}", _sigmoid(F.col(f"__{x}") + evidence.prior[x]))
    sums = stored(scored.where("__bins > 0").groupBy("__host", "__path").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"doc_p_{x}").alias(f"s_{x}") for x in names]))
    result = scored
    for x in names:
        whole = sums.agg(F.sum("n").alias("n"), F.sum(f"s_{x}").alias("s")).first()
        top = (whole["s"] + 0.5) / (whole["n"] + 1.0) if whole["n"] else 0.5
        sites = stored(shrunk_rates(sums.select("__host", "__path", "n", F.col(f"s_{x}").alias("s")), ["__host", "__path"], top, f"__site_{x}"))
        result = join_groups(result, sites, ["__host", "__path"], 200)
        site = F.least(F.greatest(F.coalesce(f"__site_{x}", F.lit(top)), F.lit(1e-4)), F.lit(1 - 1e-4))
        result = result.withColumn(f"p_{x}", F.round(_sigmoid(F.col(f"__{x}") + _logit(site)), 6))
    return result.select(
        *own.restored(),
        "p_quality",
        "p_toxic",
        *[F.round(f"doc_p_{x}", 6).alias(f"doc_p_{x}") for x in names],
        ((F.col("__bins") > 0) & (F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5)).alias("keep"),
    )
