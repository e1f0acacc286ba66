"""Text and retrieval operators."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T
from pyspark.sql.window import Window

from millrace.functions.ranges import numbered
from millrace.functions.storage import written
from millrace.operators import tokensets
from millrace.operators.linkage import connected

# The patterns of personal data, in the order they are applied.
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"(?:\+?1[-. ]?)?\(?\d{3}\)?[-. ]?\d{3}[-. ]?\d{4}\b",
}


def redact(text: Column, patterns: dict[str, str] = PII, mark: str = "<redacted>") -> Column:
    for pattern in patterns.values():
        text = F.regexp_replace(text, pattern, mark)
    return text


def fixed_chunks(df: DataFrame, text: str, size: int, overlap: int = 0) -> DataFrame:
    """A row a chunk: chunk_index, start, chunk. The last chunk is the first that reaches the end."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and below the size")
    stride = size - overlap
    n = F.length(text)
    number = F.ceil(F.greatest(n - size, F.lit(0)) / stride).cast("int")
    starts = F.transform(F.sequence(F.lit(0), number), lambda i: i * stride)
    return (
        df.where(n > 0)
        .select("*", F.posexplode(starts).alias("chunk_index", "start"))
        .withColumn("chunk", F.col(text).substr(F.col("start") + 1, F.lit(size)))
    )


def sentence_chunks(df: DataFrame, text: str, size: int) -> DataFrame:
    """Sentences packed in order into chunks of at most ``size`` characters (a longer sentence is a chunk)."""
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 0)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        joined = F.when(acc["open"] == "", s).otherwise(F.concat(acc["open"], F.lit(" "), s))
        fits = F.length(joined) <= size
        full = (acc["open"] != "") & ~fits
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.when(full, s).otherwise(joined).alias("open"))

    chunks = F.aggregate(sentences, start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    return df.select("*", F.posexplode(chunks).alias("chunk_index", "chunk"))


SEPARATORS = ["\n\n", "\n", ". ", " ", ""]


def split_text(text: str, size: int, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that does it."""
    if len(text) <= size:
        return [text] if text.strip() else []
    head, rest = separators[0], separators[1:]
    if head == "":
        return [text[i : i + size] for i in range(0, len(text), size)]
    pieces: list[str] = []
    for part in text.split(head):
        small = [part] if len(part) <= size else split_text(part, size, rest)
        for s in filter(str.strip, small):
            if pieces and len(pieces[-1]) + 1 + len(s) <= size:
                pieces[-1] += " " + s
            else:
                pieces.append(s)
    return pieces


def _atoms(text: str, size: int, separators: Sequence[str]) -> Iterator[str]:
    """Pieces of at most ``size`` characters that no coarser separator cuts further; empty ones go."""
    if len(text) <= size:
        yield from filter(None, [text])
    elif not separators or not separators[0]:
        yield from (text[i : i + size] for i in range(0, len(text), size))
    else:
        for part in text.split(separators[0]):
            yield from _atoms(part, size, separators[1:])


def split_overlapping(text: str, size: int, overlap: int, separators: Sequence[str] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Runs of pieces joined by blanks, as many as fit in ``size`` characters; each run takes over the last pieces of the one before.

    At least one piece is taken over, more while they fit in ``overlap`` characters joined. A piece that
    does not fit behind what is taken over stands there all the same, so a chunk may exceed ``size`` by
    one taken-over run. No overlap: plain runs.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and less than the size")
    atoms = list(_atoms(text, size, separators))
    ends = np.cumsum([len(a) + 1 for a in atoms])  # places in all pieces joined by blanks
    starts = ends - [len(a) + 1 for a in atoms]
    chunks, first = [], 0
    for k in range(len(atoms)):
        after = ends[k + 1] - 1 if k + 1 < len(atoms) else None
        if after is None or after - starts[first] > size:
            chunks.append(" ".join(atoms[first : k + 1]))
            first = min(k, int(np.searchsorted(starts, ends[k] - 1 - overlap))) if overlap else k + 1
    return chunks


def recursive_chunks(df: DataFrame, text: str, size: int, overlap: int | None = None) -> DataFrame:
    """A row a piece of ``split_text``, or of ``split_overlapping`` where an overlap is given, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if not t else split_text(t, size) if overlap is None else split_overlapping(t, size, overlap))

    return df.select("*", F.posexplode(cut(text)).alias("chunk_index", "chunk"))


def _sentences(text: Column) -> Column:
    """Trimmed sentences: pieces between white space that follows a full stop, an exclamation or a question mark."""
    cut = F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+")
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 0)


def sentence_windows(df: DataFrame, text: str, size: int, overlap: int = 0) -> DataFrame:
    """A row a window of ``size`` sentences: chunk_index, sentence_start, sentence_count, chunk. The last window is the first that reaches the end."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and below the size")
    stride = size - overlap
    cut = df.withColumn("__s", _sentences(F.col(text))).where(F.size("__s") > 0)
    last = F.ceil(F.greatest(F.size("__s") - size, F.lit(0)) / stride).cast("int")
    rows = cut.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: i * stride)).alias("chunk_index", "sentence_start"))
    window = F.slice("__s", F.col("sentence_start") + 1, F.lit(size))
    return rows.withColumn("sentence_count", F.size(window)).withColumn("chunk", F.array_join(window, " ")).drop("__s")


def parent_chunks(chunks: DataFrame, keys: Sequence[str], index: str, chunk: str, group: int) -> DataFrame:
    """Children with parent_index and parent_text: the ``group`` chunks of one document that stand together, joined by line ends."""
    rows = chunks.withColumn("parent_index", F.floor(F.col(index) / group).cast("int"))
    within = Window.partitionBy(*keys, "parent_index").orderBy(index).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("parent_text", F.array_join(F.collect_list(chunk).over(within), "\n"))


#: Lines that open a block of source code.
CODE_BOUNDARY = r"(?:async\s+def|def|class|function|func|fn|interface|struct|enum|impl|public|private|protected)\b.*"


def code_chunks(df: DataFrame, text: str, size: int, boundary: str = CODE_BOUNDARY) -> DataFrame:
    """Blocks of source lines (each opened by a boundary line) packed in order into chunks of at most ``size`` characters; a longer block is a chunk."""
    blocks = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\n(?=" + boundary + ")"), lambda b: b.rlike(r"\S"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, b: Column) -> Column:
        joined = F.coalesce(F.concat(acc["open"], F.lit("\n\n"), b), b)
        full = acc["open"].isNotNull() & (F.length(joined) > size)
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.when(full, b).otherwise(joined).alias("open"))

    chunks = F.aggregate(blocks, start, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    return df.select("*", F.posexplode(chunks).alias("chunk_index", "chunk"))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


#: Terms of all queries that are sent to every executor; more of them meet the words of the documents in joins.
TERMS = 500_000
#: Scores of a batch of documents and all queries that are held at once.
CELLS = 1 << 22


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str, text: str, query_id: str, query: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) of all documents that share a term with the query.

    Texts are cut once and keep the counts of the terms that queries hold, a row a document; the same pass observes
    how many documents there are and how long. Documents are scored where they are, against all queries at once, so no word is shuffled. A query's
    repeated terms count again. No documents or no terms give no rows; null query ids are left out.
    """
    spark = docs.sparkSession
    kinds = {n: df.schema[c].dataType.simpleString() for n, df, c in (("query_id", queries, query_id), ("doc_id", docs, doc_id))}
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(query))).alias("term")).where("query_id IS NOT NULL")
    asked = written(asked.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")))
    if docs.isEmpty() or asked.isEmpty():  # nothing would run, and nothing be observed
        return spark.createDataFrame([], f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")
    seen = Observation()
    cut = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("t"))
    # The size must be a column before the explode, or it is computed anew for every term.
    whole = cut.select("doc_id", "t", F.size("t").alias("length")).observe(seen, F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"))
    if asked.limit(TERMS + 1).count() > TERMS:
        words = whole.select("doc_id", "length", F.explode("t").alias("term"))
        counts = written(words.join(asked.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "length", "term").agg(F.count(F.lit(1)).alias("tf")))
        n, mean = seen.get["n_docs"], seen.get["mean_length"] or 1.0
        idf = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
        scored = counts.join(idf, "term").join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
        return scored.where("score > 0")
    known = asked.toArrow().combine_chunks()
    terms = pc.unique(known.column("term").combine_chunks())
    sent = spark.sparkContext.broadcast(terms)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The places of a document's terms among the queries', and how often each stands in it."""
        for batch in batches:
            lists = batch.column(1)
            place = pc.index_in(lists.flatten(), sent.value)
            row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists).fill_null(0)))
            there = np.asarray(place.is_valid())
            key, times = np.unique(row[there].astype(np.int64) * len(sent.value) + np.asarray(place.filter(pa.array(there))), return_counts=True)
            ends = np.searchsorted(key // len(sent.value), np.arange(len(lists) + 1))
            listed = lambda x: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), listed(key % len(sent.value)), listed(times)], names=["doc_id", "length", "terms", "tf"])

    counts = written(whole.select("doc_id", "t", "length").mapInArrow(counted, f"doc_id {kinds['doc_id']}, length int, terms array<int>, tf array<int>"))
    n, mean = seen.get["n_docs"], seen.get["mean_length"] or 1.0
    frequency = np.zeros(len(terms))
    for r in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow().to_batches():
        frequency[np.asarray(r.column(0))] = np.asarray(r.column(1))
    idf = np.log(1 + (n - frequency + 0.5) / (frequency + 0.5))
    names = pc.unique(known.column("query_id").combine_chunks())
    by_term = np.asarray(pc.index_in(known.column("term").combine_chunks(), terms))
    order = np.argsort(by_term, kind="stable")
    firsts = np.searchsorted(by_term[order], np.arange(len(terms) + 1))
    who, weight = np.asarray(pc.index_in(known.column("query_id").combine_chunks(), names))[order], np.asarray(known.column("times").combine_chunks())[order]
    model = spark.sparkContext.broadcast((idf, firsts, who, weight * 1.0, names))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, firsts, who, weight, names = model.value
        for batch in batches:
            each = max(1, CELLS // len(names))
            for at in range(0, batch.num_rows, each):
                part = batch.slice(at, each)
                term, tf = (np.asarray(part.column(i).flatten()) for i in (2, 3))
                row = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(part.column(2))))
                length = np.asarray(part.column(1), np.float64)[row]
                own = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
                many = firsts[term + 1] - firsts[term]
                hit = np.repeat(np.arange(len(term)), many)
                posting = np.repeat(firsts[term] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(len(hit)) if len(hit) else hit
                cells = np.bincount(row[hit] * len(names) + who[posting], own[hit] * weight[posting], part.num_rows * len(names))
                found = np.flatnonzero(cells > 0)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(found % len(names))), part.column(0).take(pa.array(found // len(names))), pa.array(cells[found])], names=["query_id", "doc_id", "score"])

    return counts.mapInArrow(score, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


#: Vectors and queries of a block; two blocks meet in one matrix product.
VECTOR_BLOCK, QUERY_BLOCK = 1024, 256


def _blocks(df: DataFrame, ids: str, vector: str, size: int, names: tuple[str, str]) -> DataFrame:
    """Rows of (list of ids in order, their vectors of one length as bytes of doubles), up to ``size`` a row; vectors that are null or hold what is no finite number are left out."""
    kind = df.schema[ids].dataType.simpleString()

    def pack(batches):
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1))
            for length in pc.unique(lengths):
                alike = batch.filter(pc.equal(lengths, length))
                for at in range(0, alike.num_rows, size):
                    part = alike.slice(at, size)
                    part = part.take(pc.sort_indices(part.column(0)))
                    flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    listed = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                    yield pa.RecordBatch.from_arrays([listed, pa.array([flat.tobytes()], pa.binary())], names=list(names))

    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    rows = df.where(F.col(vector).isNotNull() & ~F.exists(vector, odd)).select(ids, F.col(vector).cast("array<double>"))
    return rows.mapInArrow(pack, f"{names[0]} array<{kind}>, {names[1]} binary")


def _cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosines of paired rows, summed in order of places, so that equal vectors score alike wherever they stand."""
    dot, a, b = np.zeros((3, len(left)))
    for x, y in zip(left.T, right.T):
        dot, a, b = dot + x * y, a + x * x, b + y * y
    norm = np.sqrt(a) * np.sqrt(b)
    return np.divide(dot, norm, out=np.zeros(len(dot)), where=norm != 0)


def vector_top_k(vectors: DataFrame, queries: DataFrame, ids: str, vector: str, query_id: str, query: str, k: int) -> DataFrame:
    """The k nearest vectors by cosine for each query; both sides may be whole tables.

    Blocks of vectors meet blocks of queries in matrix products; of each such pair the k
    best a query go on (a margin keeps those that rounding could swap, then scores are summed
    anew in a fixed order), and a grouped merge ranks them. No vector goes through the driver's plan.
    Equal scores go by id; a zero vector scores 0; vectors that are or hold null, NaN or infinity are left out, and a query meets the vectors of its own length.
    """
    id_type, query_type = vectors.schema[ids].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()

    def unit(x: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.divide(x, norm, out=np.zeros_like(x), where=norm != 0)

    def best(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                own, asked = batch.column(0).slice(r, 1).flatten(), batch.column(2).slice(r, 1).flatten()
                v, q = (np.array(memoryview(batch.column(c)[r].as_py()).cast("d")).reshape(n, -1) if len(batch.column(c)[r].as_py()) else np.zeros((n, 0)) for c, n in ((1, len(own)), (3, len(asked))))
                if v.shape[1] != q.shape[1]:
                    continue
                near = unit(q) @ unit(v).T
                least = np.partition(near, -k, axis=1)[:, -k] if k < len(own) else np.full(len(asked), -np.inf)
                row, col = np.nonzero(near >= least[:, None] - 1e-9)
                score = _cosines(v[col], q[row])
                order = np.lexsort((col, -score, row))
                row, col, score = row[order], col[order], score[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(row[kept])), own.take(pa.array(col[kept])), pa.array(score[kept])], names=["query_id", ids, "score"])

    pairs = _blocks(vectors, ids, vector, VECTOR_BLOCK, ("__i", "__v")).crossJoin(_blocks(queries, query_id, query, QUERY_BLOCK, ("__a", "__q")))
    scored = pairs.mapInArrow(best, f"query_id {query_type}, `{ids}` {id_type}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), ids))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def reciprocal_rank_fusion(rankings: DataFrame, ids: str, rank: str, k: int = 60, by: Sequence[str] = ()) -> DataFrame:
    """Sum of 1 / (k + rank) over rankings, ranks from 0."""
    return rankings.groupBy(*by, ids).agg(F.sum(1.0 / (k + F.col(rank))).alias("score"))


def group_by_shared_tokens(df: DataFrame, ids: str, text: str, threshold: float = 0.6) -> DataFrame:
    """(a, b, similarity) of texts whose token sets have a Jaccard similarity of ``threshold`` or more.

    Sets meet in groups by size (``tokensets``), and their overlaps are counted block by block.
    """
    sets = written(tokensets.with_sets(df, ids, text).where("n > 0").select("id", "n", "s"))
    pairs = tokensets.similar_pairs(tokensets.met(sets, threshold, lambda n: 8 * n + 40), threshold)
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


#: Former bounds of an index of tokens, which nothing uses now; the sizes of groups and blocks are those of ``tokensets``.
HOT_TOKEN, KNOWN_TOKENS = 1000, 200_000
#: So many sets with candidates are sent to every executor to be found among all.
FEW_CANDIDATES = 200_000


def near_duplicate_groups(df: DataFrame, ids: str, text: str, threshold: float = 0.6) -> DataFrame:
    """(id, class_id, links) of every row: its class of token sets that links of ``threshold`` or more connect.

    links: other rows whose token sets have that Jaccard similarity; class_id: the least id of the class.
    Rows of equal sets are reduced to one representative with a count, so copies make no
    pairs. Representatives meet as sketches, which rule out most pairs; what they leave is connected to candidate groups, whose
    sets are then compared exactly, block by block. Texts without tokens are equal to each other.
    """
    light = written(tokensets.with_sketches(df, ids, text))
    reps = written(light.groupBy("r").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies")))
    dealt = tokensets.met(reps.where("n > 0").select("r", "n", "sketch"), threshold, lambda n: int(tokensets.sketch_bits(np.array(n))) // 8 + 40)
    may = written(tokensets.candidate_forest(dealt, threshold))
    groups = connected(may, may.select(F.col("a").alias("id")).union(may.select("b")).distinct())
    links = written(_exact_links(df, ids, text, light, groups.withColumnRenamed("id", "r"), reps, threshold))
    linked = connected(links.select(F.col("key").alias("a"), F.col("other").alias("b")), links.select(F.col("key").alias("id")).distinct())
    others = links.groupBy(F.col("key").alias("r")).agg(F.sum("links").alias("m"))
    classes = reps.select("r", "copies").join(others, "r", "left").join(linked.withColumnRenamed("id", "r"), "r", "left")
    classes = written(classes.select("r", F.coalesce("component", "r").alias("component"), (F.col("copies") - 1 + F.coalesce("m", F.lit(0))).alias("links")))
    named = written(light.select("id", "r").join(classes, "r"))
    least = named.groupBy("component").agg(F.min("id").alias("class_id"))
    return named.join(least, "component").select("id", "class_id", "links")


def _exact_links(df: DataFrame, ids: str, text: str, light: DataFrame, groups: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(key, links, other) of the sets that have similar ones in their candidate group (r, component).

    The texts of these sets are read again, one of each set.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / tokensets.BLOCK).cast("int").alias("k"))
    members = written(groups.join(sizes, "component").join(reps, "r"))
    alone = F.lit(0).cast("int").alias("side")
    small = members.where("k = 1").select(F.xxhash64("component").alias("block"), alone, F.col("r").alias("key"), "copies")
    own = F.pmod(F.xxhash64("r", F.lit(5)), F.col("k")).cast("int")
    placed = members.where("k > 1").withColumns({"own": own, "part": F.floor(own / tokensets.PART).cast("int"), "c": F.xxhash64("component")})
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.floor((F.col("k") - 1) / tokensets.PART).cast("int"))))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    side = F.when(low == high, 0).when(F.col("part") == low, 1).otherwise(2).cast("int").alias("side")
    paired = paired.select(F.xxhash64("component", low, high).alias("at"), side, F.col("r").alias("key"), "n", "sketch", "copies", "c", "own")
    large = tokensets.candidates_in_blocks(paired.repartition(partitions, "at").sortWithinPartitions("at"), threshold)
    asked = written(small.union(large))
    wanted = light.join(asked.select(F.col("key").alias("r")).distinct(), "r").groupBy("r").agg(F.min(F.struct("id")).alias("first")).select(F.col("first.id").alias("__id"))
    wanted = written(wanted.distinct())
    few = wanted.count() <= FEW_CANDIDATES
    texts = df.select(ids, text).join(F.broadcast(wanted) if few else wanted, F.col(ids).eqNullSafe(F.col("__id")), "left_semi")
    found = tokensets.with_sets(texts, ids, text).groupBy("r").agg(F.first("s").alias("s"))
    rows = asked.join(found.withColumnRenamed("r", "key"), "key").select("block", "side", "key", "copies", "s")
    return tokensets.links_in_blocks(rows.repartition(partitions, "block").sortWithinPartitions("block"), threshold)


class _Visible(HTMLParser):
    """Collects the text that a page shows."""

    hidden = {"script", "style", "head", "noscript", "template"}
    blocks = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "nav"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.hidden
        if tag in self.blocks:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - (tag in self.hidden))
        if tag in self.blocks:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def visible_text(html: str | None) -> str:
    parser = _Visible()
    parser.feed(html or "")
    parser.close()
    lines = [re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in "".join(parser.parts).split("\n")]
    return "\n".join(x for x in lines if x)


@F.pandas_udf(T.StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    """The visible text of pages, in Arrow batches."""
    return html.map(visible_text)


def prune_conversation(df: DataFrame, conversation: str, turn: str, text: str, budget: int, role: str | None = None, always: str = "system") -> DataFrame:
    """The latest turns whose characters fit the budget, without gaps; turns of the role ``always`` stay and use it up first."""
    fixed = F.lit(False) if role is None else F.coalesce(F.col(role) == always, F.lit(False))
    size = F.coalesce(F.length(text), F.lit(0))
    sized = df.withColumn("__fixed", fixed).withColumn("__size", size)
    used = F.coalesce(F.sum(F.when(F.col("__fixed"), F.col("__size"))).over(Window.partitionBy(conversation)), F.lit(0))
    back = Window.partitionBy(conversation).orderBy(F.col(turn).desc()).rowsBetween(Window.unboundedPreceding, 0)
    kept = sized.withColumn("__used", used).withColumn("__back", F.sum(F.when(~F.col("__fixed"), F.col("__size")).otherwise(0)).over(back))
    return kept.where(F.col("__fixed") | (F.col("__used") + F.col("__back") <= budget)).select(*df.columns)


# Phrases that try to take over a prompt.
INJECTION = [
    r"(?i)ignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions",
    r"(?i)disregard\s+(?:the\s+)?(?:above|previous|system|prior)",
    r"(?i)forget\s+(?:everything|all\s+previous|your\s+instructions)",
    r"(?i)you\s+are\s+now\s+(?:a|an|in|no\s+longer)\b",
    r"(?i)new\s+(?:system\s+)?(?:instructions?|rules?|prompt)\s*:",
    r"(?i)\b(?:call|invoke|run|use|execute)\s+the\s+[\w.-]+\s+tool\b",
    r"(?i)system\s*prompt\b",
    r"(?i)reveal\s+(?:your\s+)?(?:system\s+prompt|instructions?|secrets?)",
    r"(?i)(?:exfiltrate|leak|send)\s+.{0,40}?(?:https?://|api[_-]?key|password|secret)",
    r"(?i)!\[[^\]]*\]\(https?://",
    r"(?i)override\s+(?:the\s+)?(?:system|instructions?|policy|guardrails?)",
]


def injection_score(text: Column, patterns: Sequence[str] = INJECTION) -> Column:
    """0.3 for each pattern found, 1 at most."""
    hits = sum((F.coalesce(text.rlike(p), F.lit(False)).cast("int") for p in patterns), F.lit(0))
    return F.least(F.lit(1.0), hits * 0.3)


def new_chunks(chunks: DataFrame, manifest: DataFrame, doc: str, chunk: str) -> DataFrame:
    """(doc, digest, change): chunks to add or remove against a manifest of (doc, digest)."""
    now = chunks.select(doc, F.sha2(chunk, 256).alias("digest"), F.lit(True).alias("__now"), F.lit(False).alias("__old"))
    old = manifest.select(doc, "digest", F.lit(False).alias("__now"), F.lit(True).alias("__old"))
    sides = now.union(old).groupBy(doc, "digest").agg(F.max("__now").alias("__now"), F.max("__old").alias("__old"))
    # A null equals nothing, so such a chunk is added and removed where both sides have it.
    differs = (F.col("__now") != F.col("__old")) | F.col(doc).isNull() | F.col("digest").isNull()
    kinds = F.array_compact(F.array(F.when(F.col("__now"), "add"), F.when(F.col("__old"), "remove")))
    return sides.where(differs).select(doc, "digest", F.explode(kinds).alias("change"))


def hybrid_top_k(dense: DataFrame, lexical: DataFrame, query: str, item: str, k: int, candidates: int = 4, constant: int = 60) -> DataFrame:
    """(query, item, score): the k best of two rankings fused by reciprocal ranks; both hold (query, item, score), higher is better.

    Of each ranking the ``candidates * k`` best of a query take part; ties by item.
    """
    fetch = k * candidates

    def ranks(scored: DataFrame) -> DataFrame:
        number = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), item))
        return scored.select(query, item, "score").withColumn("r", number).where(F.col("r") <= fetch).select(query, item, (1 / (F.lit(constant) + F.col("r"))).alias("part"))

    fused = ranks(dense).unionByName(ranks(lexical)).groupBy(query, item).agg(F.sum("part").alias("score"))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), item))
    return fused.withColumn("r", place).where(F.col("r") <= k).drop("r")


def decayed(value: Column, age_seconds: Column, half_life_seconds: float) -> Column:
    """A value halved once a half life; negative ages count as none."""
    return value * F.pow(F.lit(0.5), F.greatest(age_seconds, F.lit(0.0)) / half_life_seconds)


def ranked_recall(df: DataFrame, by: Sequence[str], item: str, relevance: str, age_seconds: str, importance: str, half_life_seconds: float, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """``df`` with score and place: relevance, decayed recency and importance, each scaled to 0..1 within ``by`` (no spread: 0), weighed and summed."""
    rows = df.withColumn("__recency", decayed(F.lit(1.0), F.col(age_seconds).cast("double"), half_life_seconds))
    score = F.lit(0.0)
    bounds = rows.groupBy(*by).agg(*[f(c).cast("double").alias(f"__{n}{i}") for i, c in enumerate((relevance, "__recency", importance)) for n, f in (("lo", F.min), ("hi", F.max))])
    for i, c in enumerate((relevance, "__recency", importance)):
        span = F.col(f"__hi{i}") - F.col(f"__lo{i}")
        score = score + weights[i] * F.when(span > 0, (F.col(c) - F.col(f"__lo{i}")) / span).otherwise(0.0)
    joined = rows.join(bounds, list(by)) if by else rows.crossJoin(F.broadcast(bounds))
    scored = joined.withColumn("score", score).select(*df.columns, "score")
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), item))) if by else numbered(scored, [F.desc("score"), item], "place")


def consolidated(df: DataFrame, classes: DataFrame, ids: str, order: Sequence[str | Column], text: str, kind: str | None = None, taken: str = "episodic") -> DataFrame:
    """(class_id, id, text, members): one row a class of near-duplicates that two rows or more belong to, its first text in an order.

    classes: (id, class_id) of ``df``'s rows. kind: a column; only its rows of the kind ``taken`` are consolidated and counted.
    """
    own = df if kind is None else df.where(F.col(kind) == taken)
    rows = own.join(classes.select(F.col("id").alias(ids), "class_id"), ids)
    first = F.row_number().over(Window.partitionBy("class_id").orderBy(*order, ids))
    members = rows.groupBy("class_id").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return rows.withColumn("__first", first).where("__first = 1").join(members, "class_id").select("class_id", ids, text, "members")
