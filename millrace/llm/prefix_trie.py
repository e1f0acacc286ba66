"""Trie of conversations' prefixes by heavy-path decomposition.

Turns are numbered along a global order dealt to ranges, so a conversation of any length is worked on by many tasks. A prefix
is known by its depth and running sums of its turns' hashes (128 bits of the turns' SHA-256 with their places); equal prefixes meet in one
grouped aggregate. Every node's largest child continues its path; any other begins a path of its own, and has at most half its parent's
members, so no node lies below more than log2(conversations) light edges. Subtrees are then summed level by
level of light edges, from the last: a suffix sum along each path's arrays, whose heads' totals are attached to their parents.
Texts are hashed where they are scanned; all later steps move rows of some sixty bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from millrace.llm.carried import Carried
from millrace.llm.joins import is_small, join_groups
from millrace.llm.storage import stored

#: Places of a conversation or path that are summed in one array.
BLOCK = 4096
#: Bytes of a joined row: two nodes of 16 bytes, numbers and what a hash table takes.
ROW_BYTES = 160


def number_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, d1, d2, size): each turn's place in its conversation from 1, hashes of its role and text, and its text's bytes.

    Ordered by turn, null first; turns of equal number in the order of their hashes. Null conversations are one
    conversation; null roles and texts count as empty.
    """
    own = Carried(df)  # extra columns may have any names
    said, who = (F.coalesce(F.col(own.find(c)).cast("string"), F.lit("")) for c in (text, role))
    digest = F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said).cast("binary"), 256)
    light = own.rows.select(F.col(own.find(conv)).alias("conv"), F.col(own.find(turn)).alias("turn"), digest.alias("digest"), F.octet_length(said).cast("long").alias("size"))
    light = light.select("conv", "turn", *[F.xxhash64(F.lit(k), "digest").alias(f"d{k}") for k in (1, 2)], "size")
    order = [F.col("turn").asc_nulls_first(), "d1", "d2"]
    dealt = stored(light.orderBy(F.col("conv").asc_nulls_first(), *order).withColumn("part", F.spark_partition_id()))
    # A range begins inside one conversation at most: there are no more of these rows than ranges.
    counts = dealt.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("conv").alias("conv_"), F.col("part").alias("part_"), F.sum("n").over(earlier).alias("before")).where("before IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order))
    numbered = dealt.withColumn("own", place).join(F.broadcast(before), F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("part") == F.col("part_")), "left")
    return numbered.select("conv", (F.col("own") + F.coalesce("before", F.lit(0))).cast("long").alias("place"), "d1", "d2", "size")


def running(df: DataFrame, group: str, place: Column, values: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``df`` with sums or maxima over the rows of a group up to each row's place; groups are worked off in blocks of ``BLOCK`` places.

    values: new column to (column, "sum" or "max"). ``df`` must be stored, as it is read twice.
    """
    kinds = {"sum": F.sum, "max": F.max}
    rows = df.withColumns({"place_": place, "block": F.floor(place / BLOCK)})
    upto = Window.partitionBy(group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy(group, "block").agg(*[kinds[k](c).alias(n) for n, (c, k) in values.items()], F.lit(True).alias("there"))
    before = whole.select(F.col(group).alias("g_"), F.col("block").alias("b_"), *[kinds[k](n).over(upto).alias(f"{n}_") for n, (_, k) in values.items()], F.max("there").over(upto).alias("there"))
    before = stored(before.where("there").drop("there"))
    inside = Window.partitionBy(group, "block").orderBy("place_").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({f"{n}__": kinds[k](c).over(inside) for n, (c, k) in values.items()})
    before = F.broadcast(before) if is_small(before, ROW_BYTES) else before
    joined = own.join(before, F.col(group).eqNullSafe(F.col("g_")) & (F.col("block") == F.col("b_")), "left")
    both = {n: F.coalesce(F.col(f"{n}__") + F.col(f"{n}_"), f"{n}__", f"{n}_") if k == "sum" else F.greatest(f"{n}__", f"{n}_") for n, (_, k) in values.items()}
    return joined.select(*df.columns, *[c.alias(n) for n, c in both.items()])


def _node(depth: Column, sums: Sequence[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]).cast("binary")))


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv, place, size, node, parent): the prefix that ends at each turn, and the one before it."""
    halves = {}
    for k in (1, 2):
        h = F.xxhash64(F.lit(k), "place", "d1", "d2")
        halves |= {f"h{k}": F.shiftrightunsigned(h, 32), f"l{k}": h.bitwiseAND(F.lit((1 << 32) - 1))}
    hashed = stored(turns.select("conv", "place", "size", *[c.alias(n) for n, c in halves.items()]))
    summed = running(hashed, "conv", F.col("place"), {f"s_{n}": (n, "sum") for n in halves})
    now, before = [F.col(f"s_{n}") for n in halves], [F.col(f"s_{n}") - F.col(n) for n in halves]
    return stored(summed.select("conv", "place", "size", _node(F.col("place"), now).alias("node"), _node(F.col("place") - 1, before).alias("parent")))


def _hashed_ends(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, conv): SHA-256 of the ids in order, comma-joined.

    The hash of a node's ids is one chain by its definition: they stream through a task in order, and are not collected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column(0).to_pylist()
            ids = ["" if x is None else str(x) for x in batch.column(1).to_pylist()]
            cuts = [0, *[i for i in range(1, len(nodes)) if nodes[i] != nodes[i - 1]], len(nodes)]
            done = []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if sha is None or nodes[i] != node:
                    if sha is not None:
                        done.append((node, sha.hexdigest()))
                    node, sha = nodes[i], hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(",".join(ids[i:j]).encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["node", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    return ends.select("node", "conv").repartition("node").sortWithinPartitions("node", F.col("conv").asc_nulls_first()).mapInArrow(run, "node binary, ends_sha256 string")


def _on_paths(rows: DataFrame, nodes: DataFrame, root: Column) -> DataFrame:
    """Stored nodes with parent_conv_id, n_children, path (its head's node) and level (light edges above it)."""
    below = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"), F.max(F.struct("n_convs", "node")).alias("m"))
    counted = stored(nodes.join(below.select("node", "n_children", F.col("m.node").alias("heavy")), "node", "left"))
    above = stored(counted.where("heavy IS NOT NULL").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "heavy"))
    flagged = join_groups(counted.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).drop("heavy"), above, ["parent"], ROW_BYTES)
    flagged = stored(flagged.withColumn("light", F.coalesce(F.col("heavy") != F.col("node"), F.lit(False))).drop("heavy"))
    # A conversation passes all ancestors of its nodes, so the last light node on its way is the head.
    marks = flagged.select("node", "conv_id", F.col("light").cast("long").alias("light"))
    seen = join_groups(rows.select("conv", "place", "node"), marks, ["node"], ROW_BYTES).withColumn("head", F.when(F.col("light") == 1, F.struct("place", "node")))
    along = running(stored(seen), "conv", F.col("place"), {"level": ("light", "sum"), "last": ("head", "max")})
    paths = along.where(F.col("conv").eqNullSafe(F.col("conv_id"))).select("node", F.coalesce("last.node", root).alias("path"), "level")
    placed = flagged.drop("light").join(paths, "node", "left")
    return stored(placed.withColumns({"path": F.coalesce("path", root), "level": F.coalesce("level", F.lit(0).cast("long"))}))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row a distinct prefix of conversations, the empty one included.

    turns: (conv, place, d1, d2, size) with places 1, 2, ... in each conversation, as of ``number_turns``. convs: (conv), every
    conversation once, those without turns too. Returns conv_id (least member; null only if its one member is),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes of last texts that members beyond the first would repeat, summed over the
    subtree) and ends_sha256 (of the ids that end there, a null id first and written as nothing). No conversations: no rows.
    """
    rows, convs = _prefixes(turns), stored(convs.select("conv"))
    root = _node(F.lit(0), [F.lit(0)] * 4)
    made = rows.groupBy("node", "parent", F.col("place").alias("depth"), "size").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"))
    top = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    top = top.select(root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("size"), "n_convs", "conv_id")
    nodes = _on_paths(rows, stored(made.union(top)), root)
    parts, attached = [], None
    for level in range(nodes.agg(F.max("level")).first()[0] or 0, -1, -1):
        now = nodes.where(F.col("level") == level)
        own = {"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("size")}
        if attached is not None:
            now = now.join(attached, "node", "left")
            own = {n: c + F.coalesce(f"more_{n}", F.lit(0)) for n, c in own.items()}
        now = stored(now.select("node", "parent", "depth", "path", *[c.alias(n) for n, c in own.items()]))
        summed = stored(running(now, "path", -F.col("depth"), {"n_leaves": ("leaves", "sum"), "saved_tokens": ("saved", "sum")}))
        parts.append(summed.select("node", "n_leaves", "saved_tokens"))
        attached = summed.where("node = path").groupBy(F.col("parent").alias("node")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    last = rows.groupBy("conv").agg(F.max(F.struct("place", "node")).alias("m")).select(F.col("conv").alias("c_"), "m.node")
    ends = convs.join(last, F.col("conv").eqNullSafe(F.col("c_")), "left").select("conv", F.coalesce("node", root).alias("node"))
    found = nodes.join(whole, "node").join(_hashed_ends(ends), "node", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
