"""N-gram Jaccard join: linked documents by T-occurrence search, as classes.

Candidates are narrowed exactly. A linked document shares ``percent`` of its shingles with one other, so a count of those that
any other row has too leaves out most documents: 32 bits of each shingle go to the task of its hash, counts per document come back.
Sets of similarity t have a bounded symmetric difference, so if the shingles of a size class are dealt into a few
more buckets than that bound, a linked pair agrees on at least one whole bucket. Of the documents left, those with an equal
bucket are joined into candidate groups (links to the bucket's smallest document, then components), and groups travel with their sets.

Inside a group an inverted list per shingle leads to the documents that share it. For each document the
overlap T that a partner needs is known from its size; DivideSkip puts the longest lists aside, merges
the short ones, keeps what reaches T less the number of lists put aside, and probes the long ones by
binary search for just these. Documents already in one class are not compared again.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondlook.llm.common import (binary_array, blobs_by_bucket, map_arrow, no_text, shuffle_partitions, stage, text_hashes, texts_of,
                                   unsigned_hash)
from secondlook.llm.graph import components, contract

WORDS, PERCENT = 5, 80
MU = 0.01  # cost of probing a long list against merging it, as in the paper's rule for how many lists to put aside
LEAST_BUCKETS = 48  # tasks that compare bucket keys; more only with the corpus, as a document of a large group has a link from each
PART_BYTES = 16 << 20  # of text whose shingles one task counts
SETS_BYTES = 4 << 20  # of sets whose buckets are made together
SMALL = 200_000  # documents that may link: as many are broadcast, more are joined by a shuffle
GROUP_SHINGLES = 4 << 20  # shingles that one task holds; a larger candidate group is split into blocks
PROBE = 20_000  # entries of lists that are counted in about the time of probing one candidate
RECENT = 4  # classes that a document is held against directly; the search that follows covers all others
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def shingle_set(raw: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; with fewer words, of the whole sequence; A-Z count as a-z."""
    own = text_hashes(raw.translate(LOWER))
    if not own.size:
        return own
    width = min(words, own.size)
    out = np.full(own.size - width + 1, width, np.uint64)
    for k in range(width):
        out = unsigned_hash(out * np.uint64(ODD[k % 5]) + own[k:k + out.size], k)
    return np.unique(out)


def size_class(n: int, percent: int) -> int:
    """Linked sets lie in the same class or in neighbouring ones."""
    c = int(math.log(n) / math.log(100 / percent))
    while (100 / percent) ** (c + 1) <= n:
        c += 1
    while (100 / percent) ** c > n:
        c -= 1
    return c


def may_differ(n: int | np.ndarray, percent: int) -> bool | np.ndarray:
    """Whether sets of ``n`` shingles can link with another than themselves."""
    return (n > 0) & (100 * n >= percent * (n + 1))


def dealt_shingles(sets: list[np.ndarray], parts: int) -> tuple[list[int], list[bytes], list[bytes]]:
    """Parts that get some of the sets' shingles; for each, 32 bits of the shingles in the order of the sets, and how many are of each set."""
    sizes = np.array([s.size for s in sets], np.int64)
    mixed = unsigned_hash(np.concatenate([np.zeros(0, np.uint64), *sets]), 13)
    part = ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.uint32 if parts > 1 << 16 else np.uint16)
    order = np.argsort(part, kind="stable")
    own, owner = part[order], np.repeat(np.arange(len(sets)), sizes)[order]
    hashes = (mixed & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order]
    edge = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), own.size) if own.size else np.zeros(1, np.int64)
    spans = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
    return (own[edge[:-1]].tolist(), [hashes[a:b].tobytes() for a, b in spans],
            [np.bincount(owner[a:b], minlength=len(sets)).astype(np.uint32).tobytes() for a, b in spans])


def shared_counts(hashes: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """Of shingles dealt to one part, how many of each set's own stand in another set as well; equal 32 bits count as
    equal shingles, so never too few."""
    every = np.concatenate([np.zeros(0, np.uint32), *hashes])
    ordered = np.sort(every)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    shared = np.zeros(every.size, bool)
    if twice.size:
        shared = twice[np.minimum(np.searchsorted(twice, every), twice.size - 1)] == every
    ends = np.cumsum(np.concatenate([[0], *counts]).astype(np.int64))
    upto = np.append(0, np.cumsum(shared))[ends]
    return np.split(np.diff(upto), np.cumsum([c.size for c in counts])[:-1]) if counts else []


def bucket_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set: its content in each bucket, for its own size class and the next.

    Pairs meet under the class of the larger one. Sets too small to differ in a shingle have none:
    they are linked only if equal.
    """
    n = shingles.size
    if not may_differ(n, percent):
        return np.zeros(0, np.uint64)
    own, out = size_class(n, percent), []
    for c in (own, own + 1):
        largest = math.ceil((100 / percent) ** (c + 1))
        differ = 2 * largest * (100 - percent) // (100 + percent)
        spare = differ // 5 + 6  # buckets beyond the bound: so many may be empty on both sides, which few sets exceed
        buckets = differ + 1 + spare
        where = (unsigned_hash(shingles, 7) % np.uint64(buckets)).astype(np.int64)
        content = np.zeros(buckets, np.uint64)
        np.add.at(content, where, unsigned_hash(shingles, 8))
        full = np.bincount(where, minlength=buckets) > 0
        if full.sum() >= buckets - spare:  # two sets that agree on a bucket only by its being empty have more empty ones
            used = np.flatnonzero(full)
        else:
            used = np.arange(buckets)
        out.append(unsigned_hash(content[used] + np.uint64(ODD[0]) * (used.astype(np.uint64) + np.uint64(1) + np.uint64(c << 32)), 9))
    return np.concatenate(out)


def star(keys: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with the smallest document of each, and links from a key's other documents to it."""
    if not keys.size:
        return keys, documents, documents, documents
    order = np.lexsort((documents, keys))
    keys, documents = keys[order], documents[order]
    new = np.append(True, keys[1:] != keys[:-1])
    centre = documents[new][np.cumsum(new) - 1]
    links = np.unique(np.stack([documents, centre])[:, documents != centre], axis=1)
    return keys[new], documents[new], links[0], links[1]


def _contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One link for each document that hangs together with a smaller one: to the smallest."""
    if not a.size:
        return a.astype(np.int64), b.astype(np.int64)
    node, label = contract(a, b)
    return node[node != label], label[node != label]


def links_in_group(sets: list[np.ndarray], percent: int) -> list[int]:
    """The smallest place linked with each set through any chain; places are those in ``sets``."""
    root = np.arange(len(sets))
    sizes = np.array([s.size for s in sets])
    tokens, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(inverse, kind="stable")
    lists, ends = owner[order], np.cumsum(np.bincount(inverse, minlength=tokens.size))
    starts, length = np.append(0, ends[:-1]), np.diff(np.append(0, ends))
    numbered = np.split(inverse, np.cumsum(sizes)[:-1])
    recent: dict[int, int] = {}  # classes of two or more by their smallest place, the latest last: the last place linked

    def link(q: int, r: int) -> None:
        a, b = sorted((int(root[q]), int(root[r])))
        root[root == b] = a
        for k in (a, b):
            recent.pop(k, None)
        recent[a] = q

    for q in range(1, len(sets)):
        own = numbered[q]
        for top in list(islice(reversed(recent), RECENT)):  # a copy of many usually shows by one look at its class
            if any(_similar(own, numbered[r], percent) for r in {top, recent[top]}):
                link(q, top)
                break
        other = root[:q] != root[q]
        if not other.any():
            continue
        need = -(-percent * sizes[q] // 100)
        by_length = own[np.argsort(length[own], kind="stable")]
        most = max(2, int(length[by_length[-1]]))
        aside = min(need - 1, int(need / (MU * math.log2(most) + 1)))
        short, long = by_length[:own.size - aside], by_length[own.size - aside:]
        places, count = _merge(short[length[short] > 1], lists, starts, ends, other)
        enough = (count >= need - aside) & (100 * np.minimum(sizes[places], sizes[q]) >= percent * np.maximum(sizes[places], sizes[q]))
        places, shared = places[enough], count[enough]
        if places.size * PROBE > length[long].sum():  # so many candidates that counting the long lists costs less than probing them
            shared = shared + _count(long, lists, starts, ends, q)[places]
        else:
            shared = shared + np.array([_probe(long, lists, starts, ends, r) for r in places.tolist()], np.int64)
        for r in places[100 * shared >= percent * (sizes[q] + sizes[places] - shared)].tolist():
            if root[r] != root[q]:
                link(q, r)
    return root.tolist()


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(a.size, b.size) < percent * max(a.size, b.size):
        return False
    shared = np.intersect1d(a, b, assume_unique=True).size
    return 100 * shared >= percent * (a.size + b.size - shared)


def _merge(short: np.ndarray, lists: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places for which ``other`` holds and in how many of the lists: by a heap of the lists' heads where they are few, else counted in one go."""
    if (ends[short] - starts[short]).sum() > 32:
        count = _count(short, lists, starts, ends, other.size) * other
        places = np.flatnonzero(count)
        return places, count[places]
    merged = np.fromiter(heapq.merge(*[lists[starts[t]:ends[t]].tolist() for t in short]), np.int64)
    merged = merged[merged < other.size]
    return np.unique(merged[other[merged]], return_counts=True)


def _count(terms: np.ndarray, lists: np.ndarray, starts: np.ndarray, ends: np.ndarray, below: int) -> np.ndarray:
    """In how many of the lists each place smaller than ``below`` is."""
    length = ends[terms] - starts[terms]
    at = np.repeat(starts[terms] - np.cumsum(length) + length, length) + np.arange(length.sum())
    found = lists[at]
    return np.bincount(found[found < below], minlength=below)


def _probe(long: np.ndarray, lists: np.ndarray, starts: np.ndarray, ends: np.ndarray, place: int) -> int:
    """How many of the long lists hold ``place``: a binary search in all of them at once."""
    low, high = starts[long].copy(), ends[long].copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        right = open_ & (lists[np.minimum(middle, lists.size - 1)] < place)
        low, high = np.where(right, middle + 1, low), np.where(open_ & ~right, middle, high)
    return int(((low < ends[long]) & (lists[np.minimum(low, lists.size - 1)] == place)).sum())


def classes(df: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) per row of ``df``.

    Documents link when 100 * intersection >= percent * union of their distinct shingles. A text without
    words, missing or empty, has no shingles and stays alone. Rows with one id and different texts are documents
    of their own that share the id. A missing id links with nothing and has no component. Other columns are ignored.
    """
    return _classes(df, words, percent, doc_id, text).select("doc_id", "n_shingles", "component_id")


def _classes(df: DataFrame, words: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """``classes`` with place, the hash of each row's text, and class, a number of its own for each class (none without words)."""
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), no_text(text).alias("text"), F.xxhash64(text).alias("place"))

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_BUCKETS, size // PART_BYTES)

    def head(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(raw, words) for raw in texts_of(batch.column(1))]
        known = [i is not None for i in batch.column(0).to_pylist()]
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if s.size and k else None for s, k in zip(sets, known)]
        sent = [s if k and may_differ(s.size, percent) else s[:0] for s, k in zip(sets, known)]
        part, hashes, counts = dealt_shingles(sent, parts)
        told = hashlib.blake2b(repr([batch.column(0).to_pylist(), batch.column(2).to_pylist(), digests]).encode(), digest_size=8).digest()
        chunk, none = int.from_bytes(told, "little", signed=True), [None] * len(part)  # the same for the same rows
        rows = {"doc_id": batch.column(0).to_pylist(), "place": batch.column(2).to_pylist(), "n_shingles": [s.size for s in sets], "digest": digests}
        return {"part": pa.array([*part, chunk % parts], pa.int64()), "chunk": pa.array([chunk] * (len(part) + 1), pa.int64()),
                "hashes": binary_array([*hashes, None]), "counts": binary_array([*counts, None]),
                **{n: pa.array([*none, v], pa.list_(k)) for (n, v), k in zip(rows.items(), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))}}

    listed = "doc_id array<long>, place array<long>, n_shingles array<long>, digest array<binary>"

    def count(group: pa.Table) -> pa.Table:
        sent = group.filter(pc.is_valid(group.column("hashes")))
        found = shared_counts(*([np.frombuffer(x, np.uint32) for x in sent.column(c).to_pylist()] for c in ("hashes", "counts")))
        rest = group.filter(pc.is_null(group.column("hashes"))).drop_columns(["part", "hashes"])
        out = {"chunk": sent.column("chunk").combine_chunks(), "counts": binary_array([x.astype(np.uint32).tobytes() for x in found])}
        made = pa.table({f.name: out.get(f.name, pa.nulls(len(found), f.type)) for f in rest.schema}, schema=rest.schema)
        return pa.concat_tables([made, rest])

    def assemble(group: pa.Table) -> pa.Table:
        rows = group.filter(pc.is_null(group.column("counts")))  # several if whole batches are equal: then so are their counts
        sizes = np.array(rows.column("n_shingles")[0].as_py(), np.int64)
        shared = np.zeros(sizes.size, np.int64)
        for x in group.column("counts").to_pylist():
            shared += 0 if x is None else np.frombuffer(x, np.uint32)
        may = (sizes > 0) & (100 * (shared // rows.num_rows) >= percent * sizes) & may_differ(sizes, percent)
        out = {c: pc.list_flatten(rows.column(c).combine_chunks()) for c in ("doc_id", "place", "n_shingles", "digest")}
        return pa.table({**out, "may_link": pa.array(np.tile(may, rows.num_rows))})

    sent = map_arrow(docs, head, f"part long, chunk long, hashes binary, counts binary, {listed}")
    counted = sent.groupBy("part").applyInArrow(count, f"chunk long, counts binary, {listed}")
    heads = stage(counted.groupBy("chunk").applyInArrow(assemble, "doc_id long, place long, n_shingles long, digest binary, may_link boolean"), "sets")

    # One document stands for each distinct set; only those that share enough shingles with any other row travel with their sets.
    known = heads.where("digest IS NOT NULL").select("doc_id", "n_shingles", "digest", "may_link")
    standing = stage(known.groupBy("digest").agg(F.min("doc_id").alias("standing")), "standing")
    wanted = stage(known.where("may_link").groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "wanted")
    if wanted.limit(SMALL + 1).count() <= SMALL:
        wanted = F.broadcast(wanted)

    def sets_of(batch: pa.RecordBatch) -> dict | None:
        rows = []
        for raw, i, g, node in zip(*(c.to_pylist() for c in batch.columns)):
            own = shingle_set(raw.encode(), words)
            if hashlib.blake2b(own.tobytes(), digest_size=16).digest() == g:  # not another text with this id
                rows.append((i, g, node, own.size, own.tobytes()))
        if not rows:
            return None
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        return {n: pa.array(list(c), k) for n, c, k in zip(("doc_id", "digest", "node", "n_shingles", "shingles"), zip(*rows), kinds)}

    sets = stage(map_arrow(docs.join(wanted, "doc_id").select("text", "doc_id", "digest", F.xxhash64("digest").alias("node")), sets_of,
                           "doc_id long, digest binary, node long, n_shingles long, shingles binary"), "sets")
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, total // (4 << 20))

    def deal(batch: pa.RecordBatch) -> dict | None:
        least: dict[bytes, tuple[int, bytes]] = {}
        links = []
        for i, g, s in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "shingles"))):  # equal sets are one entry
            if g in least:
                links.append((max(i, least[g][0]), min(i, least[g][0])))
                least[g] = (min(i, least[g][0]), least[g][1])
            else:
                least[g] = (i, bucket_keys(np.frombuffer(s, np.uint64), percent).tobytes())
        if not least:
            return None
        keys = np.frombuffer(b"".join(k for _, k in least.values()), np.uint64)
        owner = np.repeat(np.array([i for i, _ in least.values()]), [len(k) // 8 for _, k in least.values()])
        keys, centre, a, b = star(keys, owner)
        bucket, (k, c) = blobs_by_bucket(keys, buckets, centre)
        a, b = _contracted(*(np.concatenate([x, np.array([p[j] for p in links], np.int64)]) for j, x in enumerate((a, b))))
        return {"bucket": pa.array([*bucket, int(keys[0] % np.uint64(buckets))], pa.int64()), "final": pa.array([False] * len(bucket) + [True]),
                "keys": binary_array([*k, a.astype(np.int64).tobytes()]), "documents": binary_array([*c, b.astype(np.int64).tobytes()])}

    def join(group: pa.Table) -> pa.Table:
        done = group.column("final").to_pylist()
        rows = list(zip(done, group.column("keys").to_pylist(), group.column("documents").to_pylist()))
        of = lambda k, final, kind: np.frombuffer(b"".join(r[k] for r in rows if r[0] == final), kind)
        _, _, a, b = star(of(1, False, np.uint64), of(2, False, np.int64))
        a, b = _contracted(np.concatenate([a, of(1, True, np.int64)]), np.concatenate([b, of(2, True, np.int64)]))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    dealt = map_arrow(sets.select("doc_id", "digest", "shingles"), deal, "bucket long, final boolean, keys binary, documents binary", SETS_BYTES)
    groups = components(dealt.groupBy("bucket").applyInArrow(join, "a long, b long"))

    # A group of one set has nothing to compare.
    members = sets.select("doc_id", "digest", "n_shingles").distinct().join(groups, F.col("doc_id") == F.col("node")).select("doc_id", "digest", "label", "n_shingles")
    weights = members.groupBy("label").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("group_weight")).where("sets > 1").drop("sets")
    # Linked sets lie in one size class or in neighbouring ones (a little wider than ``size_class``): those of a large group
    # go to the tasks of two classes, and only a pair of classes too large for a task is split into blocks that meet pairwise.
    span = F.floor(F.log("n_shingles") / F.lit(math.log(100 / percent) * (1 + 1e-7))).cast("int") if percent < 100 else F.col("n_shingles").cast("int")
    spans = F.when(F.col("group_weight") <= GROUP_SHINGLES // 2, F.array(F.lit(-1))).otherwise(F.array(span, span + 1) if percent < 100 else F.array(span))
    members = members.join(weights, "label").select("doc_id", "digest", "label", "n_shingles", F.explode(spans).alias("span"))
    weights = members.groupBy("label", "span").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("weight")).where("sets > 1")
    blocks = F.ceil(F.col("weight") / (GROUP_SHINGLES // 2)).cast("int")
    tasks = max(4 * shuffle_partitions(spark), total // (GROUP_SHINGLES // 4))
    small = F.array(F.concat_ws("-", F.lit("s"), F.pmod(F.xxhash64("label"), F.lit(tasks))))
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    large = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.concat_ws("-", F.lit("l"), "label", "span", F.least(k, F.col("block")), F.greatest(k, F.col("block"))))
    members = members.join(weights.select("label", "span", blocks.alias("blocks")), ["label", "span"]).withColumn("block", block)
    members = members.groupBy("doc_id", "digest", "label").agg(F.flatten(F.collect_list(F.when(F.col("span") < 0, small).otherwise(large))).alias("tasks"))
    carried = sets.join(members.select("digest", "label", "tasks"), "digest").select("node", "label", "shingles", "tasks")

    def compare(group: pa.Table) -> pa.Table:
        whole = group.column("task")[0].as_py().startswith("s")
        by_label: dict[int, list] = {}
        for i, label, s in zip(*(group.column(c).to_pylist() for c in ("node", "label", "shingles"))):
            by_label.setdefault(label, []).append((i, s))
        found = []
        for own in by_label.values():
            own = sorted(set(own))
            ids = [i for i, _ in own]
            found += [(ids[k], ids[r]) for k, r in enumerate(links_in_group([np.frombuffer(s, np.uint64) for _, s in own], percent)) if r != k]
        return pa.table({"whole": pa.array([whole] * len(found), pa.bool_()),
                         "a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    exploded = carried.select("node", "label", "shingles", F.explode("tasks").alias("task"))
    links = stage(exploded.groupBy("task").applyInArrow(compare, "whole boolean, a long, b long"), "links")
    # A group that one task saw whole is done; what several saw of a split group is put together.
    found = links.where("whole").select(F.col("a").alias("node"), F.col("b").alias("class"))
    if links.where("NOT whole").limit(1).count():
        found = found.union(components(links.where("NOT whole")).withColumnRenamed("label", "class"))
    linked = standing.withColumn("node", F.xxhash64("digest")).join(found, "node", "left").select(
        "digest", "standing", F.coalesce("class", "node").alias("class"))
    # a class of one set, as most are, is named by its own document
    several = found.union(found.select(F.col("class").alias("node"), "class")).distinct()
    named = several.join(standing.select(F.xxhash64("digest").alias("node"), "standing"), "node").groupBy("class").agg(F.min("standing").alias("least"))
    label = linked.join(named, "class", "left").select("digest", "class", F.least("least", "standing").alias("component"))
    alone = F.when(F.col("digest").isNull(), F.col("doc_id"))
    return heads.select("doc_id", "place", "n_shingles", "digest").join(label, "digest", "left").select(
        "doc_id", "place", "n_shingles", "class", F.coalesce("component", alone).alias("component_id"))


def one_of_each(df: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each class of near duplicates, all columns unchanged: that with the smallest id, of its texts the one with the
    smallest hash. Which row goes is decided by id and text: another text under the same id is judged alone. Of rows with
    equal id and text one stays, the least by all its columns as JSON. Rows without an id, or without words, all stay.
    """
    place = F.xxhash64("text")
    found = stage(_classes(df, words, percent, "doc_id", "text").where("doc_id IS NOT NULL AND n_shingles > 0")
                  .groupBy("doc_id", "place", "class").agg(F.count("*").alias("copies")), "classes")
    kept = found.groupBy("class").agg(F.min(F.struct("doc_id", "place")).alias("first")).select("first.*")
    gone = found.join(kept, ["doc_id", "place"], "left_anti").select("doc_id", "place")
    marked = df.withColumn("__place", place)
    here = [F.col("doc_id") == F.col("__id"), F.col("__place") == F.col("__text")]
    out = marked.join(gone.select(F.col("doc_id").alias("__id"), F.col("place").alias("__text")), here, "left_anti")
    again = found.where("copies > 1").join(kept, ["doc_id", "place"], "left_semi").select(F.col("doc_id").alias("__id"), F.col("place").alias("__text"))
    if again.isEmpty():
        return out.select(df.columns)
    whole = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    repeated = out.join(again, here, "left_semi").groupBy("doc_id", "__place").agg(F.min_by(F.struct(*df.columns), whole).alias("row"))
    return out.join(again, here, "left_anti").select(df.columns).union(repeated.select("row.*"))
