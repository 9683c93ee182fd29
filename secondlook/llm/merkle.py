"""Merkle manifest: a digest tree per source, a tree over the sources' roots, and proofs drawn from both.

Three consecutive digests make a parent; a last run may have two or one. A tree is stored as blocks of at most
3 ** CLIMB leaves and the CLIMB rows above them. A block keeps its digests in van Emde Boas order: a tree of
h rows is its top half-height subtree, then the bottom subtrees one after the other, each laid out the same way.
``address`` computes a node's place from its row and number alone, and serves building and sibling lookups.
The roots of a tree's blocks are the leaves of its next round, until one block is left: a source with any number of
rows never meets in one task. Rounds are written to the shared folder.

Going down again, a block gets the path above its root from the block that holds that root as a leaf, and hands
paths on; what reaches a row is its proof, from its leaf to the root of all sources.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from secondlook.llm.common import map_arrow, shuffle_partitions, small_batches, stage

FAN = 3
CLIMB = 6  # rows that a full block climbs: 729 leaves, 1,093 digests, 35 kB
BATCH_LEAVES = 4_000  # leaves whose paths one Arrow batch holds, or else those of one block
BUCKET_LEAVES = 20_000  # leaves that one task builds blocks of, on average
ZERO = b"0" * 64
BLOCK = "tree string, block long, n long, climb int, root string, nodes binary, names array<string>, claims array<string>"


def digest(raw: bytes) -> bytes:
    return hashlib.sha256(raw).hexdigest().encode()


def size_of(rows: int) -> int:
    """Nodes of a complete tree of so many rows."""
    return (FAN ** rows - 1) // (FAN - 1)


def address(rows: int, row: int, number: np.ndarray) -> np.ndarray:
    """Place in van Emde Boas order of nodes ``number`` of ``row`` (0: the root's) in a complete tree of ``rows`` rows."""
    number = np.asarray(number, np.int64)
    place = np.zeros_like(number)
    while rows > 1:
        top = rows // 2
        if row < top:
            rows = top
            continue
        below = FAN ** (row - top)  # nodes of that row in one bottom subtree
        place += size_of(top) + number // below * size_of(rows - top)
        number, row, rows = number % below, row - top, rows - top
    return place


@lru_cache(maxsize=64)
def runs_at(climb: int, level: int, runs: int) -> list[list[int]]:
    """Addresses of the members of each run of a level (0: the leaves)."""
    return address(climb + 1, climb - level, np.arange(FAN * runs).reshape(-1, FAN)).tolist()


def counts_of(n: int, climb: int) -> list[int]:
    """Digests on each level over n leaves."""
    counts = [n]
    for _ in range(climb):
        counts.append(-(-counts[-1] // FAN))
    return counts


def height(n: int) -> int:
    """Levels until one digest remains over n leaves."""
    climb = 0
    while n > 1:
        n, climb = -(-n // FAN), climb + 1
    return climb


def build_block(leaves: list[bytes], climb: int) -> tuple[bytes, bytes]:
    """The root's digest and all digests in van Emde Boas order, 32 bytes each, zeros where no node is."""
    store = [b""] * size_of(climb + 1)
    for place, leaf in zip(address(climb + 1, climb, np.arange(len(leaves))).tolist(), leaves):
        store[place] = leaf
    counts = counts_of(len(leaves), climb)
    for level in range(climb):
        parents = address(climb + 1, climb - level - 1, np.arange(counts[level + 1])).tolist()
        for parent, members in zip(parents, runs_at(climb, level, counts[level + 1])):
            store[parent] = digest(b"".join([store[m] for m in members]))
    return store[0], bytes.fromhex(b"".join(x or ZERO for x in store).decode())


def paths_of(nodes: bytes, n: int, climb: int) -> list[list[str]]:
    """For each leaf of a block, the siblings before and after it on every level: ``before|after`` in hex."""
    text = nodes.hex()
    counts, sides = counts_of(n, climb), []
    for level in range(climb):
        own = []
        left = counts[level]
        for members in runs_at(climb, level, counts[level + 1]):
            there = [text[64 * m:64 * m + 64] for m in members[:left]]
            left -= FAN
            own += ["".join(there[:k]) + "|" + "".join(there[k + 1:]) for k in range(len(there))]
        sides.append(own)
    steps = [FAN ** level for level in range(climb)]
    return [[own[i // step] for own, step in zip(sides, steps)] for i in range(n)]


def leaves_of(nodes: bytes, n: int, climb: int) -> list[str]:
    text = nodes.hex()
    return [text[64 * m:64 * m + 64] for m in address(climb + 1, climb, np.arange(n)).tolist()]


def fold(claim: str, path: str) -> str:
    """The root that a leaf's digest gives with the siblings of a path."""
    own = claim.encode()
    for step in path.split(",") if path else []:
        before, after = step.encode().split(b"|")
        own = digest(before + own + after)
    return own.decode()


def field(value: Column) -> Column:
    """How a leaf states a value: its UTF-8 bytes, a colon, the value; ``-`` if missing."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def numbered(rows: DataFrame) -> DataFrame:
    """Staged rows (tree, id, digest, row, ...) with position (from 0 in a tree, by id, digest and row; missing ids
    first) and n (leaves of the tree). Rows are range-partitioned on all of that, so no tree meets in one task."""
    keys = ["tree", F.col("id").asc_nulls_first(), "digest", "row"]
    placed = (rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
              .drop("row").withColumn("place", F.monotonically_increasing_id()))
    placed = stage(placed, "merkle-order").withColumn("part", F.shiftright("place", 33))
    counts = placed.groupBy("part", "tree").agg(F.count("*").alias("here"), F.min("place").alias("lowest"))
    of_tree = Window.partitionBy("tree")  # a row per task that holds rows of the tree
    before = F.sum("here").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", "tree", "lowest", F.coalesce(before, F.lit(0)).alias("before"), F.sum("here").over(of_tree).alias("n"))
    return (placed.join(offsets, ["part", "tree"])
            .withColumn("position", F.col("before") + F.col("place") - F.col("lowest")).drop("part", "place", "lowest", "before"))


def _round(leaves: DataFrame, buckets: int, most: int) -> DataFrame:
    """Blocks that climb up to ``most`` rows over leaves (tree, position, n, digest, name, claim)."""
    full = FAN ** most

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by([("tree", "ascending"), ("position", "ascending")])
        trees, totals = group.column("tree").to_pylist(), group.column("n").to_pylist()
        positions, digests = group.column("position").to_pylist(), group.column("digest").to_pylist()
        names, claims = group.column("name").to_pylist(), group.column("claim").to_pylist()
        out, at = [], 0
        while at < len(trees):
            block = positions[at] // full
            size = min(full, totals[at] - block * full)
            climb = most if totals[at] > full else height(totals[at])
            root, nodes = build_block([x.encode() for x in digests[at:at + size]], climb)
            out.append((trees[at], block, size, climb, root.decode(), nodes, names[at:at + size], claims[at:at + size]))
            at += size
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string())]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[f.split()[0] for f in BLOCK.split(", ")])

    block = F.floor(F.col("position") / full)
    dealt = leaves.select(F.pmod(F.xxhash64("tree", block), F.lit(buckets)).alias("bucket"), "tree", "position", "n", "digest", "name", "claim")
    return stage(dealt.groupBy("bucket").applyInArrow(build, BLOCK), "merkle-blocks")


@dataclass
class Tower:
    """Rounds of blocks over many trees, and each tree's number of leaves."""

    rounds: list[DataFrame]
    sizes: DataFrame  # tree, n
    climb: int = CLIMB

    def roots(self) -> DataFrame:
        """tree, root."""
        full = FAN ** self.climb
        last = None
        for k, blocks in enumerate(self.rounds):
            share = F.ceil(F.col("total") / full ** k)
            sizes = self.sizes.select("tree", F.col("n").alias("total"))
            own = blocks.where("block = 0").join(sizes, "tree").where(share <= full).select("tree", "root", "total")
            if k:  # trees that ended before have no block in this round
                own = own.where(F.ceil(F.col("total") / full ** (k - 1)) > full)
            own = own.select("tree", "root")
            last = own if last is None else last.union(own)
        return last

    def rows(self, above: DataFrame) -> DataFrame:
        """tree, position, name, claim, leaf, path, and what ``above`` (tree, path, ...) tells of each tree: the path of a leaf leads
        through its tree and on through the tree's own path."""
        full = FAN ** self.climb
        extra = [c for c in above.columns if c not in ("tree", "path")]
        paths = None
        for k in reversed(range(len(self.rounds))):
            ended = (F.ceil(F.col("n") / full ** k) <= full) & ((F.ceil(F.col("n") / full ** (k - 1)) > full) if k else F.lit(True))
            tops = above.join(self.sizes, "tree").where(ended).select("tree", F.lit(0).cast("long").alias("block"), "path", *extra)
            paths = tops if paths is None else paths.unionByName(tops)
            paths = _hand_on(self.rounds[k].drop("root").join(paths, ["tree", "block"]), extra, full, leaves=k == 0)
            if k:
                paths = stage(paths.select("tree", F.col("position").alias("block"), "path", *extra), "merkle-paths")
        return paths


def _hand_on(blocks: DataFrame, extra: list[str], full: int, leaves: bool) -> DataFrame:
    """A row with its path for every leaf of the blocks (tree, block, ..., path: that above the block's root)."""
    small_batches(blocks.sparkSession)

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        out = {c: [] for c in ("position", "path", "name", "claim", "leaf")}
        many = []
        for k, (block, n, climb, nodes, outer) in enumerate(zip(*(at[c] for c in ("block", "n", "climb", "nodes", "path")))):
            many += [k] * n
            out["position"] += range(block * full, block * full + n)
            out["path"] += [",".join(own + [outer] if outer else own) for own in paths_of(nodes, n, climb)]
            if leaves:
                out["leaf"] += leaves_of(nodes, n, climb)
                out["name"] += at["names"][k]
                out["claim"] += at["claims"][k]
        own = pa.array(many, pa.int32())
        made = {"tree": batch.column("tree").take(own), "position": pa.array(out["position"], pa.int64())}
        made |= {c: pa.array(out[c], pa.string()) for c in (["path", "name", "claim", "leaf"] if leaves else ["path"])}
        return pa.RecordBatch.from_pydict(made | {c: batch.column(c).take(own) for c in extra})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column("n").to_numpy())
            at = 0
            while at < batch.num_rows:  # paths are many times larger than blocks: a few thousand at a time
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_LEAVES, "right")))
                yield some(batch.slice(at, to - at))
                at = to

    columns = ["tree", "block", "n", "climb", "nodes", "path", *extra, *(["names", "claims"] if leaves else [])]
    kinds = "tree string, position long, path string" + ", name string, claim string, leaf string" * leaves
    return blocks.select(*columns).mapInArrow(run, ", ".join([kinds, *[f"{c} string" for c in extra]]))


def tower(rows: DataFrame, climb: int = CLIMB) -> Tower:
    """Blocks over staged rows (tree, id, digest, row, name, claim)."""
    small_batches(rows.sparkSession)
    leaves = stage(numbered(rows), "merkle-leaves")
    sizes = stage(leaves.where("position = 0").select("tree", "n"), "merkle-trees")
    largest, total = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = max(4 * shuffle_partitions(rows.sparkSession), total // BUCKET_LEAVES)
    rounds = [_round(leaves, buckets, climb)]
    full = FAN ** climb
    while largest > full:
        size = F.ceil(F.col("total") / full ** len(rounds))  # block roots of the tree in this round
        up = rounds[-1].join(sizes.select("tree", F.col("n").alias("total")), "tree").where(size > 1)
        up = up.select("tree", F.col("block").alias("position"), size.alias("n"), F.col("root").alias("digest"),
                       F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("claim"))
        largest = -(-largest // full)
        rounds.append(_round(up, buckets, climb))
    return Tower(rounds, sizes, climb)


@dataclass
class Manifest:
    """Trees of the sources and the tree over their roots."""

    sources: Tower
    top: Tower

    def root(self) -> DataFrame:
        """One row with ``root``; none for an empty table."""
        return self.top.roots().select("root")

    def proofs(self) -> DataFrame:
        """doc_id, leaf, subroot, root, path and claim of every row. A path lists, from leaf to root, the digests before and
        after the own one in its run as ``before|after``, levels parted by commas; the root alone has an empty path."""
        root = self.root()
        # the tree over the sources' roots is one tree: its row carries the root
        above = root.select(F.lit("").alias("tree"), F.lit("").alias("path"), "root")
        of_source = self.top.rows(above).select(F.col("name").alias("tree"), "path", F.col("leaf").alias("subroot"), "root")
        rows = self.sources.rows(stage(of_source, "merkle-sources"))
        return rows.select(F.col("name").cast("long").alias("doc_id"), "leaf", "subroot", "root", "path", "claim")


def build(df: DataFrame, leaf: Column, claim: Column | None = None, doc_id: str = "doc_id", source: str = "source",
          climb: int = CLIMB) -> Manifest:
    """The manifest of all rows of ``df``: a tree per value of ``source``, whose leaves ascend by ``doc_id``.

    ``leaf`` is a row's digest (64 hex digits; see ``leaf_digest``); ``claim``, if given, a digest that is stored beside the
    row to be checked later. Blocks climb ``climb`` rows. A missing source is a source of its own and comes before all others, which stand in the order
    of their UTF-8 bytes. Missing ids come first; equal ids stand by digest, equal rows are leaves of their own. An empty
    table has no root. Only the named columns are read; others may have any name.
    """
    # a letter in front keeps a missing source apart from an empty one, and first
    tree = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    rows = stage(df.select(
        tree.alias("tree"), F.col(doc_id).cast("long").alias("id"), leaf.alias("digest"), F.col(doc_id).cast("string").alias("name"),
        (F.lit(None).cast("string") if claim is None else claim).alias("claim"), F.monotonically_increasing_id().alias("row")), "merkle-digests")
    sources = tower(rows, climb)
    roots = sources.roots().select(
        F.lit("").alias("tree"), F.lit(None).cast("long").alias("id"), F.col("root").alias("digest"), F.col("tree").alias("name"),
        F.lit(None).cast("string").alias("claim"))
    return Manifest(sources, tower(_in_order(roots), climb))


def _in_order(roots: DataFrame) -> DataFrame:
    """Sources numbered in the order of their names, which is then the order of their leaves."""
    keys = ["name"]
    placed = stage(roots.repartitionByRange(shuffle_partitions(roots.sparkSession), *keys).sortWithinPartitions(*keys)
                   .withColumn("row", F.monotonically_increasing_id()), "merkle-roots")
    return placed.withColumn("id", F.col("row"))  # partitions ascend, so these ids do


def verified(proofs: DataFrame, claim: str = "claim") -> DataFrame:
    """``proofs`` with folded_root, the root that the claimed digest gives with the proof's siblings, and verified: whether it
    is the manifest's. A missing claim is not verified."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        claims, paths = batch.column(claim).to_pylist(), batch.column("path").to_pylist()
        found = pa.array([None if c is None else fold(c, p) for c, p in zip(claims, paths)], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "folded_root"])

    proofs = proofs.drop("folded_root", "verified")
    schema = StructType([*proofs.schema.fields]).add("folded_root", "string")
    return map_arrow(proofs, run, schema).withColumn("verified", F.coalesce(F.col("folded_root") == F.col("root"), F.lit(False)))
