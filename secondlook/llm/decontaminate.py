"""Benchmark items in training text: BM25 by block-max WAND, then overlap of question and answer.

The inverted index holds the test items; every passage of every training document is a query.
Impacts are BM25 weights over the item's own total, so an item scores at most 1 and one threshold
fits all. Passages are twice as long as the longest item and start at each multiple of its length,
so that every occurrence lies whole in one of them.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondlook.llm.common import map_arrow, texts_of

THRESHOLD = 0.6  # share of an item's own BM25 score that a passage must reach
OVERLAP, SHINGLE = 0.8, 5  # share of the item's five-word shingles; at least half of the question's and of the answer's words
K1, B = 1.2, 0.75
BLOCK = 64
INDEX_BYTES = 32 << 20  # text of the items that one broadcast index may hold; more items make more rounds
SEPARATORS = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower case, cut at everything in ASCII that is neither letter nor digit."""
    return text.lower().encode().translate(SEPARATORS).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The answer follows the first question mark, else it is the last sentence, else the last third."""
    at = text.find("?") + 1
    if not words_of(text[at:]) or not words_of(text[:at]):
        ends = [m.end() for m in re.finditer(r"[.!?:\n]\s+", text.rstrip())]
        at = ends[-1] if ends else 0
    question, answer = words_of(text[:at]), words_of(text[at:])
    if not question or not answer:
        every = words_of(text)
        cut = len(every) - len(every) // 3
        question, answer = every[:cut], every[cut:]
    return question, answer


def shingles(words: list[bytes]) -> set[tuple]:
    return {tuple(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


class Index:
    """Posting lists in blocks of BLOCK items with the largest impact of each block."""

    def __init__(self, items: list[tuple[int, str]], n_items: int, mean_words: float, document_count: dict[bytes, int], threshold: float):
        self.ids, self.threshold = [i for i, _ in items], threshold
        self.parts = [question_and_answer(t) for _, t in items]
        self.words = [words_of(t) for _, t in items]
        self.longest = max([SHINGLE, *map(len, self.words)])
        postings: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        self.weights: list[dict[bytes, float]] = []
        for k, words in enumerate(self.words):
            norm = K1 * (1 - B + B * len(words) / max(mean_words, 1e-9))
            raw = {w: np.log(1 + (n_items - document_count[w] + 0.5) / (document_count[w] + 0.5)) * f * (K1 + 1) / (f + norm)
                   for w, f in Counter(words).items()}
            total = sum(raw.values())
            self.weights.append({w: x / total for w, x in raw.items()})
            for w, x in self.weights[-1].items():
                postings[w].append((k, x))
        self.number = {w: i for i, w in enumerate(postings)}
        lists = list(postings.values())
        self.items = [np.array([k for k, _ in p]) for p in lists]
        self.impacts = [np.array([x for _, x in p]) for p in lists]
        self.block_end = [p[BLOCK - 1::BLOCK].tolist() + ([] if p.size % BLOCK == 0 else [int(p[-1])]) for p in self.items]
        self.block_max = [[float(x[i:i + BLOCK].max()) for i in range(0, x.size, BLOCK)] for x in self.impacts]
        self.most = [float(x.max()) for x in self.impacts]
        # Terms without which an item can't pass half the threshold; only passages that hold some of them are queries.
        self.rest = np.zeros(len(items))
        key: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for k, weights in enumerate(self.weights):
            for w, x in sorted(weights.items(), key=lambda z: (z[1], z[0])):
                if self.rest[k] + x < threshold / 2:
                    self.rest[k] += x
                else:
                    key[self.number[w]].append((k, x))
        count = np.array([len(key.get(t, ())) for t in range(len(lists))], np.int64)
        self.key_first, self.key_count = np.cumsum(count) - count, count
        flat = [p for t in range(len(lists)) for p in key.get(t, ())]
        self.key_item, self.key_impact = np.array([k for k, _ in flat], np.int64), np.array([x for _, x in flat])

    def candidates(self, numbers: np.ndarray) -> np.ndarray:
        """Starts of the passages that some item can reach the threshold in, by its key terms alone."""
        step = self.longest
        at = np.flatnonzero(numbers >= 0)
        at = at[self.key_count[numbers[at]] > 0]
        if not at.size:
            return at
        term, passage = numbers[at], at // step
        # a word at a place belongs to the passage that starts at or before it and to the one before that
        term, passage = np.concatenate([term, term]), np.concatenate([passage, passage - 1])
        term, passage = term[passage >= 0], passage[passage >= 0]
        pair = np.unique(passage * len(self.items) + term)  # a term counts once in a passage
        passage, term = pair // len(self.items), pair % len(self.items)
        count = self.key_count[term]
        ends = np.cumsum(count)
        place = np.repeat(self.key_first[term] - ends + count, count) + np.arange(ends[-1])
        cell, owner = np.unique(np.repeat(passage, count) * len(self.ids) + self.key_item[place], return_inverse=True)
        reach = np.bincount(owner, self.key_impact[place], cell.size) + self.rest[cell % len(self.ids)]
        return np.unique(cell[reach >= self.threshold - 1e-9] // len(self.ids)) * step

    def retrieve(self, terms: set[int]) -> list[tuple[int, float]]:
        """Every item scoring the threshold or more (block-max WAND): (place of the item, score)."""
        goal, found = self.threshold - 1e-9, []
        cursors = [(int(self.items[t][0]), t, 0) for t in terms]
        heapq.heapify(cursors)
        while cursors:
            # the pivot: the first item at which the lists' largest impacts could reach the goal
            taken, bound = [], 0.0
            while cursors and bound < goal:
                taken.append(heapq.heappop(cursors))
                bound += self.most[taken[-1][1]]
            if bound < goal:
                break
            pivot = taken[-1][0]
            while cursors and cursors[0][0] == pivot:
                taken.append(heapq.heappop(cursors))
            tight, until = 0.0, None
            for _, t, _ in taken:  # the same bound by the blocks that hold the pivot
                ends = self.block_end[t]
                b = next((j for j, e in enumerate(ends) if e >= pivot), None)
                if b is not None:
                    tight += self.block_max[t][b]
                    until = ends[b] if until is None else min(until, ends[b])
            if tight >= goal:
                score, target = 0.0, pivot + 1
                for _, t, at in taken:
                    at = int(np.searchsorted(self.items[t], pivot))
                    if at < self.items[t].size and self.items[t][at] == pivot:
                        score += float(self.impacts[t][at])
                if score >= goal:
                    found.append((pivot, score))
            else:  # nothing up to the first block's end, or to the next list's item
                target = min(until + 1, cursors[0][0]) if cursors else until + 1
                target = max(target, pivot + 1)
            for _, t, _ in taken:
                at = int(np.searchsorted(self.items[t], target))
                if at < self.items[t].size:
                    heapq.heappush(cursors, (int(self.items[t][at]), t, at))
        return found

    def leaks(self, text: str) -> list[tuple[int, float, int, float, float]]:
        """(item_id, best score, first word of the passage, overlap of question and of answer) of verified items."""
        words = words_of(text)
        if not words:
            return []
        get = self.number.get
        numbers = np.array([get(w, -1) for w in words])
        best: dict[int, tuple] = {}
        for start in self.candidates(numbers).tolist():
            own = words[start:start + 2 * self.longest]
            seen, parts = set(own), None
            for k, score in self.retrieve({n for n in numbers[start:start + 2 * self.longest].tolist() if n >= 0}):
                parts = shingles(own) if parts is None else parts
                question, answer = ([w in seen for w in part] for part in self.parts[k])
                q, a = (sum(x) / len(x) if x else 1.0 for x in (question, answer))
                of_item = shingles(self.words[k])
                if len(of_item & parts) >= OVERLAP * len(of_item) and min(q, a) >= 0.5 and score > best.get(k, (0, 0))[1]:
                    best[k] = (self.ids[k], score, start, q, a)
        return [best[k] for k in sorted(best)]


def indexes(benchmark: DataFrame, threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES) -> list[Index]:
    """One index for each ``index_bytes`` of item text. Items without words match nothing; repeated items are all reported."""
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = max(1, -(-size // index_bytes))
    items = []
    for k in range(rounds):  # a round's items fit the bound, up to the unevenness of a hash
        own = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == k).collect() if rounds > 1 else rows.collect()
        items.append(sorted((r.item_id, r.text) for r in own if words_of(r.text)))
    count = Counter(w for own in items for _, t in own for w in set(words_of(t)))
    n = sum(map(len, items))
    mean = sum(len(words_of(t)) for own in items for _, t in own) / max(n, 1)
    return [Index(own, n, mean, {w: count[w] for _, t in own for w in words_of(t)}, threshold) for own in items if own]


def find(df: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, score, first_word, question_overlap, answer_overlap: a row per leak.

    A missing or empty text leaks nothing; a missing id stays missing; a repeated row reports its
    leaks again. Without items the result is empty. Other columns are ignored.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, score double, first_word long, question_overlap double, answer_overlap double"
    out = df.sparkSession.createDataFrame([], schema)
    for index in indexes(benchmark, threshold):
        shared = df.sparkSession.sparkContext.broadcast(index)  # at most INDEX_BYTES of item text

        def run(batch: pa.RecordBatch, shared=shared) -> dict | None:
            ids = batch.column(0).to_pylist()
            found = [(d, *leak) for d, raw in zip(ids, texts_of(batch.column(1))) for leak in shared.value.leaks(raw.decode())]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]
            names = [f.split(" ")[0] for f in schema.split(", ")]
            return {n: pa.array(c, k) for n, c, k in zip(names, zip(*found), kinds)} if found else None

        out = out.union(map_arrow(rows, run, schema))
    return out


def filter_documents(df: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``df``, all their columns unchanged, that hold no item."""
    at = df.columns.index(text)
    for index in indexes(benchmark, threshold):
        shared = df.sparkSession.sparkContext.broadcast(index)

        def keep(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            return batch.filter(pa.array([not shared.value.leaks(raw.decode()) for raw in texts_of(batch.column(at))]))

        df = map_arrow(df, keep, df.schema)
    return df


