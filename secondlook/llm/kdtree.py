"""Shards of near equal size by a k-d tree over the rows' metadata.

Every node that still has to give several shards is cut along the dimension in which its rows spread
widest, at the weighted quantile that leaves each side bytes in proportion to its shards. Cuts of one
level are found together: bytes are summed by bins of the coordinate (a grouped sum, at most nodes x
BINS rows come back), and the bin that holds the wanted weight is divided again until it is light
enough. A coordinate is a 62-bit number: the dimension's value in front, a hash of the row behind, so
that a value that a third of all rows share is cut as finely as any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secondlook.llm.common import no_text, shuffle_partitions, stage

VALUE_BITS, HASH_BITS = 31, 31
BINS = 1_024
TOLERANCE = 0.0005  # of a shard's bytes: how far a cut may lie from the wanted weight
ROW_BYTES = 16


@dataclass
class Node:
    first: int
    shards: int
    dim: int = -1
    cut: int = 0
    left: "Node | None" = None
    right: "Node | None" = None

    def leaves(self) -> list["Node"]:
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()

    def name(self, dims: list[str]) -> Column:
        """The first shard of the leaf that a row falls into."""
        if self.left is None:
            return F.lit(self.first)
        return F.when(F.col(dims[self.dim]) < self.cut, self.left.name(dims)).otherwise(self.right.name(dims))


def _coordinate(value: Column, low: float, high: float, salt: str) -> Column:
    """The value's place between low and high, then a hash of the row."""
    span = (high - low) or 1.0
    place = F.floor((F.coalesce(value, F.lit(low)) - low) / span * (2 ** VALUE_BITS - 1)).cast("long")
    place = F.least(F.greatest(place, F.lit(0)), F.lit(2 ** VALUE_BITS - 1))
    return F.shiftleft(place, HASH_BITS) + F.pmod(F.xxhash64(F.lit(salt), "row"), F.lit(2 ** HASH_BITS))


def _cuts(rows: DataFrame, root: Node, nodes: list[Node], dims: list[str], bytes_of: dict[int, int], slack: float) -> None:
    """Set ``cut`` of each node to the coordinate below which its left half's share of bytes lies."""
    wanted = {n.first: bytes_of[n.first] * (n.shards // 2) / n.shards for n in nodes}
    low, high = {n.first: 0 for n in nodes}, {n.first: 2 ** (VALUE_BITS + HASH_BITS) for n in nodes}
    below = {n.first: 0 for n in nodes}
    open_nodes = {n.first: n for n in nodes}
    while open_nodes:
        width = {k: max(1, -(-(high[k] - low[k]) // BINS)) for k in open_nodes}
        # literal arrays by node; -1 as the width of a node that has its cut
        of = lambda values, default=0: F.array(*[F.lit(values.get(k, default)).cast("long") for k in range(root.shards)])[F.col("node")]
        x = F.array(*dims)[of({k: n.dim for k, n in open_nodes.items()}).cast("int")]
        sums = (rows.select("size", *dims, root.name(dims).alias("node"))
                .select("node", "size", x.alias("x"), of(low).alias("low"), of(high).alias("high"), of(width, -1).alias("width"))
                .where("width > 0 AND x >= low AND x < high")
                .groupBy("node", F.expr("(x - low) div width").alias("bin")).agg(F.sum("size").alias("bytes")).collect())
        for k in list(open_nodes):
            weight = below[k]
            bins = sorted((r["bin"], r["bytes"]) for r in sums if r["node"] == k)
            for b, w in bins:
                if weight + w >= wanted[k] or (b, w) == bins[-1]:
                    break
                weight += w
            else:  # no rows at all
                open_nodes.pop(k).cut = low[k]
                continue
            start = low[k] + b * width[k]
            if w <= slack or width[k] == 1:
                before, after = wanted[k] - weight, weight + w - wanted[k]
                open_nodes.pop(k).cut = start if before <= after else start + width[k]
            else:
                low[k], high[k], below[k] = start, start + width[k], weight


def grow(rows: DataFrame, dims: list[str], shards: int) -> Node:
    """The tree for ``rows`` (row, size and a coordinate per dimension)."""
    root = Node(0, shards)
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = TOLERANCE * total / shards
    while todo := [n for n in root.leaves() if n.shards > 1]:
        spread = [F.max(d) - F.min(d) for d in dims]
        found = {r["node"]: r for r in rows.groupBy(root.name(dims).alias("node")).agg(
            F.sum("size").alias("bytes"), *[s.alias(f"spread_{i}") for i, s in enumerate(spread)]).collect()}
        for n in todo:
            r = found.get(n.first)
            n.dim = max(range(len(dims)), key=lambda i: (r[f"spread_{i}"] or 0) if r else 0)
        _cuts(rows, root, todo, dims, {n.first: found[n.first]["bytes"] if n.first in found else 0 for n in todo}, slack)
        for n in todo:
            n.left, n.right = Node(n.first, n.shards // 2), Node(n.first + n.shards // 2, n.shards - n.shards // 2)
    return root


def shard(df: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text",
          dimensions: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    Size is the text's UTF-8 bytes plus 16; a missing text has none. Dimensions are numbers; by default
    the hashed language and source, the logarithm of the size, and the id, where the columns
    exist. Missing values lie at the low end. Repeated rows are separate rows and may part. Fewer
    rows than shards leave shards empty. Other columns are ignored, whatever their names.
    """
    hashed = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")).cast("double")
    size = (F.octet_length(no_text(text)) + ROW_BYTES).cast("long")
    if dimensions is None:
        dimensions = {c: hashed(c) for c in ("lang", "source") if c in df.columns}
        dimensions |= {"bytes": F.log2(size.cast("double")), "id": F.col(doc_id).cast("double")}
    dims = [f"x{i}" for i in range(len(dimensions))]
    # written once: the running number must not change when a lost task is run again
    rows = stage(df.select(F.col(doc_id).cast("long").alias("doc_id"), size.alias("size"), F.crc32(no_text(text).cast("binary")).alias("text_crc32"),
                           *[v.cast("double").alias(d) for d, v in zip(dims, dimensions.values())],
                           F.monotonically_increasing_id().alias("row")), "kdtree")
    edge = rows.agg(*[f(d).alias(f"{d}_{f.__name__}") for d in dims for f in (F.min, F.max)]).first()
    placed = rows.select("row", "doc_id", "size", "text_crc32", *[
        _coordinate(F.col(d), edge[f"{d}_min"] or 0.0, edge[f"{d}_max"] or 0.0, d).alias(d) for d in dims])
    tree = grow(placed, dims, shards)
    named = placed.select("doc_id", "size", "text_crc32", "row", tree.name(dims).alias("shard"))
    # slots: count by (shard, part), add up the parts before, number within the part; no task has a whole shard
    parts = shuffle_partitions(df.sparkSession)
    named = named.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    counts = named.groupBy("shard", "part").agg(F.count("*").alias("n"))  # shards x parts rows
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    return (named.withColumn("inside", inside).join(offsets, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("ahead") + F.col("inside") - 1).alias("slot")))
