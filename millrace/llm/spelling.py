"""Spelling variants: words one edit apart, grouped under their most frequent form.

A word emits itself and each of its distinct single deletions as keys; words that share a
key are candidates (symmetric delete), an exact comparison of the two words decides, forms are chosen
by a grouped aggregate, and roots by joins that double the distance followed.

Two near words of equal length share exactly one string, both without the place in which they differ;
of two whose lengths differ by one, the shorter word itself. So every near pair is met once, and a key is shared by at
most (length + 1) * letters + 1 words of the alphabet: no key grows with the corpus. Deletions are hashed from
running sums, so a word of a megabyte costs as many keys and no square of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm import textarrays as ta
from millrace.llm.joins import join_groups
from millrace.llm.storage import stored

LETTERS = "[A-Za-zÀ-ÿ]"
#: Words up to this length travel with their keys; longer ones by number, and meet their texts only when two share a key.
CARRIED = 64


def runs(text: Column, least: int = 1) -> Column:
    """Maximal runs of at least ``least`` letters, A-Z in lower case; none of a null text."""
    found = F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.transform(found, lambda w: F.translate(w, upper, upper.lower()))


def count_words(words: DataFrame, word: str, length: int = 5, count: int = 3) -> DataFrame:
    """(word, n): words of at least ``length`` code points that stand at least ``count`` times."""
    counted = words.where(F.length(word) >= length).groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= count)


def _keys(words: DataFrame) -> DataFrame:
    """(id, n, size, word, key, at): a row for each word itself (at -1) and each distinct deletion; word as text where it is carried."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.utf8_length(batch.column(2)))
            ends = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
            for i, j in ta.runs(ends):
                part = batch.slice(i, j - i)
                texts = part.column(2).to_pylist()
                codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
                start, end = ends[i:j] - ends[i], ends[i + 1 : j + 1] - ends[i]
                # A deletion stands for its run of equal letters, under the first of them.
                first = np.ones(len(codes), bool)
                first[1:] = codes[1:] != codes[:-1]
                first[start] = True
                gap = np.flatnonzero(first)
                owner = np.searchsorted(start, gap, side="right") - 1
                prefix = ta.prefix_hash(codes)
                whole = ta.span_hash(prefix, start, end)
                key = np.r_[whole, ta.gap_hash(prefix, start[owner], gap, end[owner])]
                who = np.r_[np.arange(j - i), owner]
                at = np.r_[np.full(j - i, -1), gap - start[owner]]
                text = pa.array([w if len(w) <= CARRIED else None for w in texts], pa.string())
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(sizes[i:j][who].astype(np.int32)), text.take(take), ta.longs(key), pa.array(at.astype(np.int32))],
                    names=["id", "n", "size", "word", "key", "at"],
                )

    ta.limit_batches(words)
    return words.select("id", "n", "word").mapInArrow(emit, "id long, n long, size int, word string, key long, at int")


def _near(x: str, y: str) -> Column:
    """Whether two words that met on a key are one edit apart, and share just that key's string.

    Words of one length are so if they lose the same place, a deletion standing for any place of its run of equal letters.
    """
    word, at, size = (lambda s, c=c: F.col(f"{s}.{c}") for c in ("word", "at", "size"))
    rest = lambda s: F.when(at(s) < 0, word(s)).otherwise(F.concat(F.substring(word(s), F.lit(1), at(s)), F.substring(word(s), at(s) + 2, size(s))))

    def one_run(s: str, upto: Column) -> Column:
        letters = F.substring(word(s), at(s) + 1, upto - at(s) + 1)
        return letters == F.repeat(F.substring(letters, 1, 1), upto - at(s) + 1)

    same_place = F.when(at(x) <= at(y), one_run(x, at(y))).otherwise(one_run(y, at(x)))
    return (rest(x) == rest(y)) & ((size(x) != size(y)) | same_place)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of every two near words of a stored table (id, word, n), each way round."""
    keys = _keys(words)
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))
    light = keys.where(F.col("size") <= CARRIED)
    pairs = light.alias("x").join(light.alias("y"), met).where(_near("x", "y")).select("x.word", "x.n", F.col("y.word").alias("other"), F.col("y.n").alias("other_n"))
    # Pairs with a longer word meet by number and fetch their texts.
    heavy = keys.where(F.col("size") >= CARRIED).drop("word")
    wide = heavy.alias("x").join(heavy.alias("y"), met & (F.greatest("x.size", "y.size") > CARRIED))
    fields = [f"{s}.{c}" for s in "xy" for c in ("id", "n", "size", "at")]
    wide = wide.select(*[F.col(f).alias(f.replace(".", "_")) for f in fields])
    texts = words.select(F.col("id"), F.col("word"))
    for s in "xy":
        wide = wide.join(texts.select(F.col("id").alias(f"{s}_id"), F.col("word").alias(f"{s}_word")), f"{s}_id")
    shaped = wide.select(*[F.struct(*[F.col(f"{s}_{c}").alias(c) for c in ("word", "n", "size", "at")]).alias(s) for s in "xy"])
    pairs = pairs.union(shaped.where(_near("x", "y")).select("x.word", "x.n", "y.word", "y.n"))
    ways = F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return pairs.select(F.inline(ways))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) from a stored table (word, form) without cycles: the last word that forms lead to.

    Each round follows twice as far as the one before. A form that very many words share meets its own row by a
    broadcast of counted size, or else in a merge join whose hot side is split.
    """
    now = stored(links.select("word", F.col("form").alias("root")))
    width = now.agg(F.max(F.octet_length("word") + F.octet_length("root"))).first()[0] or 0
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = stored(join_groups(now, further, ["root"], int(width) + 64).select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def spelling_groups(counts: DataFrame, ratio: float = 2.0) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a table (word, n) of distinct words.

    form: the near word of largest n (ties: smallest in code-point order) if that is at least
    ``ratio`` times the word's; else null. root: where forms end, the word itself if it has none. Null words are left out; an
    empty table gives no rows.
    """
    words = stored(counts.where("word IS NOT NULL").select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("b"))
    best = best.select("word", "n_near", F.col("b.other").alias("other"), (-F.col("b.minus")).alias("other_n"))
    fits = F.col("other_n") >= ratio * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("other")).alias("form"), F.when(fits, F.col("other_n")).alias("form_n"))
    found = stored(found)
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
