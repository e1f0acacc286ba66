"""Temperature mixing of sources, realised as budgeted block permutations.

Token shares p of the sources are raised to an exponent t: weights are
p ** t, normalised.  t = 1 keeps the shares, t = 0 makes all sources equal.
Bisection finds the exponent at which the weights reach a target entropy, or
the largest at which no source repeats more often than a limit.  A source's
budget of tokens is then drawn in blocks: each block is a seeded permutation
of the whole source, and the last one is cut where the budget ends.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from millrace.llm import textarrays as ta
from millrace.llm.carried import Carried
from millrace.llm.joins import join_groups
from millrace.llm.storage import stored
from millrace.llm.sums import sums_before

_WORD = ~ta.byte_set([0x20, *range(0x09, 0x0E)])
#: Rows of one slice of a permutation, about; a slice is ordered by one task.
SLICE_ROWS = 4_096
#: Equal rows that travel as one at most.
LOT_ROWS = 4_096


def _count_words(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    _, _, text = ta.words(data, offsets, _WORD[data])
    return [pa.array(np.bincount(text, minlength=len(offsets) - 1), pa.int64())]


def count_tokens(df: DataFrame, text: str = "text", name: str = "mix_tokens", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the number of words of each whole text (null, empty and blank ones: 0); a column of that name is replaced."""
    return ta.with_text_columns(df, text, [(name, "long")], _count_words, keep=keep)


def source_key(source: str) -> Column:
    """Sources as keys that join; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("mix_source")


def _moments(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy of the weights, most repeats of a source) at each exponent, in one job."""
    columns = []
    for k, t in enumerate(exponents):
        power = F.exp(F.col("log_share") * t)
        columns += [F.sum(power).alias(f"z{k}"), F.sum(power * F.col("log_share")).alias(f"m{k}")]
    row = shares.agg(F.min("log_share").alias("low"), F.max("log_share").alias("high"), *columns).first()
    return [(math.log(row[f"z{k}"]) - t * row[f"m{k}"] / row[f"z{k}"], math.exp((1 - t) * (row["high"] - row["low"]))) for k, t in enumerate(exponents)]


def bisect_exponent(shares: DataFrame, entropy: float | None, max_repeats: float | None, steps: int = 40) -> float:
    """The largest exponent in 0..1 that reaches ``entropy``, unless the limit of repeats asks for a larger one.

    Both measures fall as the exponent grows.  Each job halves the range four
    times, by evaluating the 15 inner points of a 16-fold split.
    """

    def last(good) -> float:
        low, high = 0.0, 1.0
        if good(*_moments(shares, [1.0])[0]):
            return 1.0
        for _ in range(math.ceil(steps / 4)):
            inner = [low + (high - low) * k / 16 for k in range(1, 16)]
            kept = [t for t, m in zip(inner, _moments(shares, inner), strict=True) if good(*m)]
            low = max(kept, default=low)
            high = min([t for t in inner if t > low], default=high)
        return low

    wanted = last(lambda h, r: h >= entropy) if entropy is not None else 0.0
    if max_repeats is None or _moments(shares, [wanted])[0][1] <= max_repeats:
        return wanted
    low = last(lambda h, r: r > max_repeats)
    return min(1.0, low + 1.0 / 2**steps)


@dataclass
class Mix:
    """Weights and budgets: one row a source in ``sources``."""

    exponent: float
    entropy: float
    sources: DataFrame  # mix_source, tokens, weight, budget
    slices: int


def plan_mix(counted: DataFrame, evenness: float | None = 0.98, max_repeats: float | None = 4.0, budget: int | None = None) -> Mix:
    """Weights and budgets of the sources of (mix_source, mix_tokens) rows.

    evenness: target entropy as a part of the largest possible, ln(number of
    sources).  max_repeats: times that a source may be drawn for one time of
    the largest.  budget: tokens in all; by default the least at which each
    source is drawn whole at least once, so that no document is left out.
    Sources without a word have no weight and no budget: their rows are drawn once.
    counted may hold mix_rows, the number of rows that each of its rows stands for.
    """
    rows = F.col("mix_rows") if "mix_rows" in counted.columns else F.lit(1)
    totals = stored(counted.groupBy("mix_source").agg(F.sum(F.col("mix_tokens") * rows).alias("tokens"), F.sum(rows).alias("rows")))
    whole = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.coalesce(F.sum("rows"), F.lit(0)).alias("r"), F.count_if(F.col("tokens") > 0).alias("k")).first()
    slices = max(1, math.ceil(whole["r"] / SLICE_ROWS))
    if not whole["k"]:
        return Mix(1.0, 0.0, totals.select("mix_source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget")), slices)
    shares = totals.where("tokens > 0").withColumn("log_share", F.log(F.col("tokens") / F.lit(float(whole["t"]))))
    target = evenness * math.log(whole["k"]) if evenness is not None else None
    exponent = bisect_exponent(shares, target, max_repeats)
    entropy = _moments(shares, [exponent])[0][0]
    z = shares.agg(F.sum(F.exp(F.col("log_share") * exponent)).alias("z"), F.max(F.exp(F.col("log_share") * (1 - exponent))).alias("top")).first()
    tokens = budget if budget is not None else whole["t"] * z["top"] * z["z"]
    weighted = totals.withColumn("weight", F.when(F.col("tokens") > 0, F.exp(F.log(F.col("tokens") / F.lit(float(whole["t"]))) * exponent) / z["z"]).otherwise(0.0))
    budgets = F.round(F.col("weight") * tokens).cast("long")
    if budget is None:
        budgets = F.greatest(budgets, F.col("tokens"))  # rounding must not cut the largest source
    return Mix(exponent, entropy, stored(weighted.select("mix_source", "tokens", "weight", budgets.alias("budget"))), slices)


def _row_hash(columns: list[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])


def _place(epoch: str, seed: int, lot: Column | None = None) -> Column:
    """Place of a row (or of a lot of equal ones) in a block's permutation."""
    return F.xxhash64(F.lit(seed), epoch, "mix_row", F.lit(0).cast("long") if lot is None else lot)


def _slice_of(place: Column, slices: int) -> Column:
    """Which of equal slices of all 64-bit places a place lies in."""
    return F.least(F.floor((place / F.lit(2.0**64) + 0.5) * slices).cast("int"), F.lit(slices - 1))


def _blocks() -> list[Column]:
    """full: whole blocks of a source; rest: tokens that the budget leaves for the next. Sources without a word have one block."""
    worded = F.col("tokens") > 0
    return [F.when(worded, F.expr("budget div nullif(tokens, 0)")).otherwise(1).cast("int").alias("full"), F.when(worded, F.expr("budget % nullif(tokens, 0)")).otherwise(0).alias("rest")]


RESULTS = ["mix_tokens", "mix_epoch", "mix_start", "mix_at", "mix_weight"]


def mix_order(df: DataFrame, mix: Mix, tokens: str = "mix_tokens", source: str = "source", seed: int = 23) -> DataFrame:
    """The draws in order: ``df`` once for each draw, with epoch and start.

    mix_epoch: number of the block; mix_start: tokens of the source's stream before this draw;
    mix_at: mix_start over the budget (0 without one), so that ordering all draws by mix_at
    interleaves the sources by their weights all along.  The block permutation
    is cut into slices by hash, summed first per slice and then inside it, so a
    source with any number of rows is ordered by many tasks.  Equal rows travel as one with their
    number, in lots of ``LOT_ROWS``, and are told out at the end: a much repeated row is no hot key.

    Defined cases: every row of a whole block is drawn, those without words too; of the last block, the rows that
    start before the budget ends; null sources form one source; sources without words are drawn once; rows equal in every column are
    interchangeable; an empty table gives no draws; input columns named as a result
    are replaced, others are carried whatever their names.
    """
    own = Carried(df, RESULTS)
    places, counts = own.columns(), own.find(tokens)
    rows = own.rows.select(*places, F.col(counts).alias("mix_tokens"), source_key(own.find(source)), _row_hash(_hashable(own.rows, places), seed).alias("mix_row"))
    if own.groupable():
        rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("mix_rows"))
    else:
        rows = rows.withColumn("mix_rows", F.lit(1).cast("long"))
    lots = F.sequence(F.lit(0).cast("long"), F.floor((F.col("mix_rows") - 1) / LOT_ROWS))
    rows = rows.withColumn("mix_lot", F.explode(lots)).withColumn("mix_rows", F.least(F.lit(LOT_ROWS).cast("long"), F.col("mix_rows") - F.col("mix_lot") * LOT_ROWS))
    planned = mix.sources.select("*", *_blocks())
    drawn = (
        join_groups(rows, planned, ["mix_source"], 200, "inner")
        .withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("full") - F.when(F.col("rest") > 0, 0).otherwise(1))))
        .where("full + rest > 0")
        .withColumn("mix_place", _place("mix_epoch", seed, F.col("mix_lot")))
        .withColumn("mix_slice", _slice_of(F.col("mix_place"), mix.slices))
    )
    block = ["mix_source", "mix_epoch"]
    sums = stored(drawn.groupBy(*block, "mix_slice").agg(F.sum(F.col("mix_tokens") * F.col("mix_rows")).alias("n")))
    base = sums_before(sums, block, "mix_slice", "n", mix.slices).select(*block, "mix_slice", "base")
    inside = F.sum(F.col("mix_tokens") * F.col("mix_rows")).over(Window.partitionBy(*block, "mix_slice").orderBy("mix_place", "mix_row").rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("mix_epoch") * F.col("tokens") + F.col("base") + F.coalesce(inside, F.lit(0))
    return (
        drawn.join(base.hint("merge"), [*block, "mix_slice"])
        .withColumn("mix_first", start)
        .withColumn("mix_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_rows") - 1)))
        .withColumn("mix_start", F.col("mix_first") + F.col("mix_copy") * F.col("mix_tokens"))
        .where("mix_epoch < full OR mix_start < budget")
        .withColumn("mix_at", F.coalesce(F.col("mix_start") / F.nullif(F.col("budget"), F.lit(0)), F.lit(0.0)))
        .select(*own.restored(), "mix_tokens", "mix_epoch", "mix_start", "mix_at", F.col("weight").alias("mix_weight"))
    )


def _hashable(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]


def mixed(df: DataFrame, text: str = "text", source: str = "source", evenness: float | None = 0.98, max_repeats: float | None = 4.0, budget: int | None = None, seed: int = 23) -> DataFrame:
    """``df`` with each row as often as it is drawn, columns as they were.

    Whole blocks need no order.  Of a source's last block, the rows whose place lies
    before the cut are drawn, and the cut is found from tokens per
    (source, slice) first and from the rows of one slice a source after that.  Texts are
    never shuffled; equal rows are counted as one with their number.

    Defined cases: rows equal in all columns are drawn alike, which may
    exceed the budget by their tokens; rows without words are drawn with every whole block; a source without words is drawn once;
    null sources form one source; an empty table gives no rows; columns are carried whatever their names.
    """
    own = Carried(df)
    hashed = _hashable(own.rows, own.columns())
    marked = own.rows.withColumn("mix_row", _row_hash(hashed, seed)).withColumn("mix_source", source_key(own.find(source)))
    with_tokens = count_tokens(marked, own.find(text), "mix_tokens")
    light = stored(with_tokens.groupBy("mix_source", "mix_tokens", "mix_row").agg(F.count(F.lit(1)).alias("mix_rows")))
    mix = plan_mix(light, evenness, max_repeats, budget)
    cuts = stored(_cuts(light, mix, seed))
    drawn = join_groups(with_tokens, cuts, ["mix_source"], 200, "inner").withColumn(
        "mix_draws", F.col("full") + (_place("full", seed) < F.coalesce("cut", F.lit(-(2**63)))).cast("int")
    )
    return drawn.where("mix_draws > 0").withColumn("mix_draw", F.explode(F.sequence(F.lit(1), F.col("mix_draws")))).select(*own.restored())


def _cuts(light: DataFrame, mix: Mix, seed: int) -> DataFrame:
    """(mix_source, full, cut): whole blocks of a source, and the place at which the next one ends."""
    budgets = mix.sources.select("*", *_blocks())
    size = F.col("mix_tokens") * F.col("mix_rows")
    placed = (
        join_groups(light, budgets.select("mix_source", "full", "rest"), ["mix_source"], 200, "inner")
        .where("rest > 0")
        .withColumn("mix_place", _place("full", seed))
        .withColumn("mix_slice", _slice_of(F.col("mix_place"), mix.slices))
    )
    sums = stored(placed.groupBy("mix_source", "mix_slice").agg(F.sum(size).alias("n")))
    upto = sums_before(sums, ["mix_source"], "mix_slice", "n", mix.slices)
    edge = stored(join_groups(upto, budgets.select("mix_source", "rest"), ["mix_source"], 200, "inner").where("base < rest AND base + n >= rest").select("mix_source", "mix_slice", "base"))
    inside = join_groups(placed, edge, ["mix_source", "mix_slice"], 200, "inner")
    earlier = F.sum(size).over(Window.partitionBy("mix_source").orderBy("mix_place", "mix_row").rowsBetween(Window.unboundedPreceding, -1))
    cut = inside.withColumn("start", F.coalesce(earlier, F.lit(0)) + F.col("base")).where("start < rest").groupBy("mix_source").agg((F.max("mix_place") + 1).alias("cut"))
    return budgets.select("mix_source", "full").join(cut, "mix_source", "left")
