"""Repeated word windows, found by suffix automata over reference shards.

Text that occurs twice is first located by anchors: of the five-word hashes inside a window the
smallest is its key, so equal windows have equal keys wherever they stand, and few keys cover a text.
Keys that two documents share send the words around them to a shard chosen by the key. A
shard's reference is a suffix automaton over its distinct passages (of a key with many passages: over its single
windows, dealt by a hash of all their words); every state knows the smallest
document that holds its words. Passages run through it, and at each word the matching statistics give
the longest match; where that spans a whole window, the window's state names its first document.
The maximal runs of windows first seen in a smaller document are removed.

A shard's automaton goes only to the documents with keys in it, because a reference that grows with
the corpus has no bound that would allow sending all of it to every executor.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondlook.llm.common import (binary_array, blobs_by_bucket, map_arrow, no_text, shuffle_partitions, small_batches, stage, texts_of,
                                   text_hashes, unsigned_hash)

WINDOW, GRAM = 13, 5
CHUNK_BYTES = 1 << 20  # text that is read together
BUCKET_KEYS = 1 << 20  # keys compared by one task
SHARD_WORDS = 50_000  # words of the corpus for each reference shard
KEY_PASSAGES = 2_000  # passages of one key that stay whole and in one shard; with more, its windows are dealt singly
NO_ID = 2 ** 63 - 1  # stands for a missing id: larger than any other
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def window_keys(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The key of every window of a document, given its words' hashes."""
    n = hashes.size - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    size = hashes.size - gram + 1
    grams = np.zeros(size, np.uint64)
    for k in range(gram):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + size]
    grams = unsigned_hash(grams)
    keys = grams[:n].copy()
    for k in range(1, window - gram + 1):
        np.minimum(keys, grams[k:k + n], out=keys)
    return keys


def window_hash(words: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(words, digest_size=8).digest(), "little")


def passages(keys: np.ndarray, wanted: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last window of each run of windows with one wanted key."""
    if not keys.size or not wanted.size:
        return [], []
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    last = np.append(edge[1:], keys.size) - 1
    at = np.minimum(np.searchsorted(wanted, keys[edge]), wanted.size - 1)
    hit = wanted[at] == keys[edge]
    return edge[hit].tolist(), last[hit].tolist()


class SuffixAutomaton:
    """Over sequences of words; ``first`` is the smallest document of a state's words."""

    def __init__(self, sequences: list[tuple[list, int]]):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [NO_ID]
        for words, document in sorted(sequences, key=lambda s: s[1]):
            last = 0
            for w in words:
                last = self._extend(last, w)
                if document < self.first[last]:
                    self.first[last] = document
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            parent = self.link[s]
            if self.first[s] < self.first[parent]:
                self.first[parent] = self.first[s]

    def _state(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.first.append(NO_ID)
        return len(self.link) - 1

    def _split(self, p: int, w, q: int) -> int:
        """The state of the words that reach q through p alone."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w) -> int:
        if (q := self.next[last].get(w)) is not None:
            return self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new

    def first_documents(self, words: list, window: int) -> list[int]:
        """For each window of ``words``: the smallest document that holds it, NO_ID if none does."""
        out, state, size = [], 0, 0
        following, link, length = self.next, self.link, self.length
        for k, w in enumerate(words):
            while state and w not in following[state]:
                state = link[state]
                size = length[state]
            if w in following[state]:
                state, size = following[state][w], size + 1
            if k >= window - 1:
                if size < window:
                    out.append(NO_ID)
                else:
                    s = state
                    while length[link[s]] >= window:
                        s = link[s]
                    out.append(self.first[s])
        return out


def shared_keys(blobs: DataFrame) -> DataFrame:
    """chunk, keys (packed, sorted) that occur twice or more and those of them with more than KEY_PASSAGES passages (hot), from
    (bucket, chunk, keys, runs: the key's passages in the chunk); a chunk gives a key that two of its documents have twice.
    A task sees a key once or twice for each chunk, however many rows hold it."""
    most = KEY_PASSAGES

    def run(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in group.column("keys").to_pylist()]
        keys, place, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        runs = np.bincount(place, weights=np.frombuffer(b"".join(group.column("runs").to_pylist()), np.int64), minlength=keys.size)
        shared, hot = count > 1, (count > 1) & (runs > most)
        found, hots = [], []
        for own in np.split(place, np.cumsum([p.size for p in parts])[:-1]):  # ascending, as the keys of a blob are
            own = own[shared[own]]
            own = own[np.append(True, own[1:] != own[:-1])[:own.size]]
            found.append(keys[own])
            hots.append(keys[own[hot[own]]])
        keep = [i for i, f in enumerate(found) if f.size]
        return pa.table({"chunk": group.column("chunk").take(pa.array(keep, pa.int64())), "keys": binary_array([found[i].tobytes() for i in keep]),
                         "hot": binary_array([hots[i].tobytes() for i in keep])})

    return blobs.groupBy("bucket").applyInArrow(run, "chunk long, keys binary, hot binary")


def repeats(df: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans (start, stop: removed word places) per row of ``df``.

    A word goes if a window around it also starts in a document with a smaller id. A missing or
    empty text has no words; a text shorter than a window loses nothing. A missing id is larger than any
    other; rows with equal ids don't remove from each other. Other columns are ignored.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), no_text(text).alias("text"))
    docs = docs.withColumn("place", F.xxhash64("id", "text"))

    def head(batch: pa.RecordBatch) -> dict:
        words = [raw.split() for raw in texts_of(batch.column(3))]
        return {"doc_id": batch.column(0), "id": batch.column(1), "place": batch.column(2), "n_words": pa.array(map(len, words), pa.int64()),
                "sha": pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words])}

    heads = stage(map_arrow(docs.select("doc_id", "id", "place", "text"), head, "doc_id long, id long, place long, n_words long, sha string"), "heads")
    total = heads.agg(F.sum("n_words")).first()[0] or 0
    chunks = max(1, 8 * total // CHUNK_BYTES)
    buckets = max(2 * shuffle_partitions(spark), total // (4 * BUCKET_KEYS))
    shards = max(4 * shuffle_partitions(spark), total // SHARD_WORDS)

    # Copies of a text follow from its first document: only that one is searched.
    first = heads.where(F.col("n_words") >= window).groupBy("sha").agg(F.min("id").alias("id"))
    first = first.join(heads.groupBy("sha", "id").agg(F.min("place").alias("place")), ["sha", "id"])  # one raw text of several with these words
    texts = docs.select(F.pmod("place", F.lit(chunks)).alias("chunk"), "id", "place", "text")
    notes = first.select(F.pmod("place", F.lit(chunks)).alias("chunk"), F.col("place").alias("id"), "sha", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("firsts"))

    def firsts_of(left: pa.Table, right: pa.Table) -> list[tuple[int, str, bytes]]:
        """The documents of a chunk that are their text's first: id, sha and text."""
        wanted = {p: s for p, s in zip(right.column("id").to_pylist(), right.column("sha").to_pylist()) if s is not None}
        out = []
        for i, p, raw in zip(left.column("id").to_pylist(), left.column("place").to_pylist(), texts_of(left.column("text"))):
            if (sha := wanted.pop(p, None)) is not None:  # of equal rows one
                out.append((i, sha, raw))
        return out

    def give_keys(left: pa.Table, right: pa.Table) -> pa.Table:
        own = [window_keys(text_hashes(raw), window, gram) for _, _, raw in firsts_of(left, right)]
        starts = [k[np.append(True, k[1:] != k[:-1])] for k in own if k.size]  # one for each passage
        none = np.zeros(0, np.uint64)
        keys, count = np.unique(np.concatenate([none, *map(np.unique, own)]), return_counts=True)
        runs = np.unique(np.concatenate([none, *starts]), return_counts=True)[1]
        twice = np.minimum(count, 2)
        told = np.zeros(twice.sum(), np.int64)
        told[np.cumsum(twice) - twice] = runs
        bucket, (packed, told) = blobs_by_bucket(np.repeat(keys, twice), buckets, told)
        chunk = left.column("chunk")[0].as_py() if left.num_rows else 0
        return pa.table({"bucket": pa.array(bucket, pa.int64()), "chunk": pa.array([chunk] * len(bucket), pa.int64()), "keys": binary_array(packed), "runs": binary_array(told)})

    by_chunk = texts.groupBy("chunk")
    blobs = by_chunk.cogroup(notes.groupBy("chunk")).applyInArrow(give_keys, "bucket long, chunk long, keys binary, runs binary")
    shared = shared_keys(blobs).select("chunk", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("sha"), "keys", F.col("hot").alias("firsts"))
    # here ``firsts`` are the hot ones of the keys; in ``notes`` ``id`` is the place of a text's first document

    def give_passages(left: pa.Table, right: pa.Table) -> pa.Table:
        packed = [k for k in right.column("keys").to_pylist() if k is not None]
        wanted = np.unique(np.frombuffer(b"".join(packed), np.uint64))
        hot = set(np.frombuffer(b"".join(k for k in right.column("firsts").to_pylist() if k is not None), np.uint64).tolist())
        found: dict[bytes, list] = {}  # a passage once for the chunk, with its smallest and largest document
        for i, _, raw in firsts_of(left, right) if wanted.size else ():
            keys, words = window_keys(text_hashes(raw), window, gram), raw.split()
            for a, b in zip(*passages(keys, wanted)):
                key = int(keys[a])
                for own in [b" ".join(words[k:k + window]) for k in range(a, b + 1)] if key in hot else [b" ".join(words[a:b + window])]:
                    seen = found.setdefault(own, [key, i, i])
                    seen[1], seen[2] = min(seen[1], i), max(seen[2], i)
        chunk = left.column("chunk")[0].as_py() if left.num_rows else 0
        rows = list(found.values())
        return pa.table({"shard": pa.array([shards + window_hash(w) % (window * shards) if k in hot else k % shards for w, (k, _, _) in found.items()], pa.int64()), "chunk": pa.array([chunk] * len(rows), pa.int64()),
                         "key": pa.array(np.array([k for k, _, _ in rows], np.uint64).view(np.int64)), "words": binary_array(list(found)),
                         "low": pa.array([a for _, a, _ in rows], pa.int64()), "high": pa.array([b for _, _, b in rows], pa.int64())})

    sent = by_chunk.cogroup(notes.union(shared).groupBy("chunk")).applyInArrow(give_passages, "shard long, chunk long, key long, words binary, low long, high long")

    def search(group: pa.Table) -> pa.Table:
        texts, low = group.column("words").to_pylist(), group.column("low").to_pylist()
        smallest: dict[bytes, int] = {}
        for t, d in zip(texts, low):
            smallest[t] = min(d, smallest.get(t, NO_ID))
        cut = {t: t.split(b" ") for t in smallest}
        automaton = SuffixAutomaton([(cut[t], d) for t, d in smallest.items()])
        known = {t: automaton.first_documents(words, window) for t, words in cut.items()}
        keep = [i for i, (t, h) in enumerate(zip(texts, group.column("high").to_pylist())) if min(known[t]) < h]
        return pa.table({"chunk": group.column("chunk").take(pa.array(keep, pa.int64())),
                         "keys": binary_array([texts[i] for i in keep]), "firsts": binary_array([np.array(known[texts[i]], np.int64).tobytes() for i in keep]),
                         "id": group.column("key").take(pa.array(keep, pa.int64()))})

    told = sent.groupBy("shard").applyInArrow(search, "chunk long, keys binary, firsts binary, id long")
    # here ``id`` is the key of the passage whose words stand in ``keys``
    told = told.select("chunk", "id", F.lit(None).cast("string").alias("sha"), "keys", "firsts")

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        about = [(i, k, f) for i, k, f in zip(*(right.column(c).to_pylist() for c in ("id", "keys", "firsts"))) if f is not None]
        known = {k: np.frombuffer(f, np.int64) for _, k, f in about}
        wanted = np.unique(np.array([i for i, _, _ in about], np.int64).view(np.uint64))
        rows = []
        for i, sha, raw in firsts_of(left, right) if wanted.size else ():
            keys, words = window_keys(text_hashes(raw), window, gram), raw.split()
            gone = np.zeros(len(words) + 1, np.int64)
            for a, b in zip(*passages(keys, wanted)):
                before = known.get(b" ".join(words[a:b + window]))
                if before is None and b > a:  # a hot key's windows come singly
                    one = [known.get(b" ".join(words[k:k + window])) for k in range(a, b + 1)]
                    before = np.array([NO_ID if f is None else f[0] for f in one], np.int64)
                if before is not None:
                    hit = a + np.flatnonzero(before < i)
                    np.add.at(gone, hit, 1)
                    np.add.at(gone, hit + window, -1)
            gone = np.cumsum(gone)[:-1] > 0
            if gone.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                rows.append((sha, int(gone.sum()), hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": b} for a, b in edge.reshape(-1, 2).tolist()]))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
        columns = list(zip(*rows)) or [()] * 4
        return pa.table({n: pa.array(list(c), k) for n, c, k in zip(("sha", "n_removed", "kept", "spans"), columns, kinds)})

    removed = by_chunk.cogroup(notes.union(told).groupBy("chunk")).applyInArrow(
        remove, "sha string, n_removed long, kept string, spans array<struct<start: long, stop: long>>")
    fate = first.select("sha", F.col("id").alias("first_id")).join(removed, "sha", "left")
    joined = heads.join(fate, "sha", "left")
    copy = F.col("id") > F.col("first_id")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))
    none = F.expr("CAST(array() AS array<struct<start: bigint, stop: bigint>>)")
    return joined.select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                         F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
                         F.when(copy, whole).otherwise(F.coalesce("spans", none)).alias("spans"))
