"""Byte-level BPE: texts to token ids and back.

Pieces come from ``pretokenise``; new pieces of a chunk are
merged together and kept in a bounded cache. Ids travel as packed little-endian unsigned 32-bit integers together with the byte
offset at which each token ends, so any span of tokens can be decoded and located in the text.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondlook.llm.common import PieceCache, binary_array, map_arrow, texts_of, worker_memory
from secondlook.llm.pretokenise import boundaries

IDS, NEVER = np.dtype("<u4"), 1 << 40


def read_ranks(path: str) -> bytes:
    """The content of a rank file: a base64 token and its id per line. It is a library's file of fixed size."""
    with open(path, "rb") as file:
        return file.read()


class Pieces(PieceCache):
    """piece -> packed ids by a rank file."""

    def __init__(self, ranks: bytes):
        super().__init__()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.tokens = {i: token for token, i in self.ranks.items()}
        self.lengths = np.zeros(max(self.tokens) + 1, np.int64)
        self.lengths[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)])
        pairs = sorted((l << 32 | r, i) for token, i in self.ranks.items() for k in range(1, len(token))
                       if (l := self.ranks.get(token[:k])) is not None and (r := self.ranks.get(token[k:])) is not None)
        self.pairs, self.joined = np.array([k for k, _ in pairs]), np.array([i for _, i in pairs])

    def learn(self, pieces: list[str]) -> list[bytes]:
        raws = [p.encode() for p in pieces]
        out = [b"" if (i := self.ranks.get(raw)) is None else i.to_bytes(4, "little") for raw in raws]
        short = [k for k, raw in enumerate(raws) if not out[k] and len(raw) <= self.longest]
        for k, packed in zip(short, self.merge_many([raws[k] for k in short])):
            out[k] = packed
        for k, raw in enumerate(raws):
            if not out[k]:
                out[k] = np.array([self.ranks[t] for t in self.merge(raw)], IDS).tobytes()
        return out

    def joint(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that two neighbours join to, which is its rank too; NEVER if they can't."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), self.pairs.size - 1)
        return np.where(self.pairs[at] == key, self.joined[at], NEVER)

    def merge_many(self, raws: list[bytes]) -> list[bytes]:
        """All pieces at once: each round joins the leftmost pair of lowest rank of every piece."""
        if not raws:
            return []
        sizes = np.array([len(r) for r in raws])
        ids = self.of_byte[np.frombuffer(b"".join(raws), np.uint8)]
        owner = np.repeat(np.arange(sizes.size), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(ids.size, NEVER)  # of each place with the next one of its piece
        rank[:-1] = np.where(owner[1:] == owner[:-1], self.joint(ids[:-1], ids[1:]), NEVER)
        while ids.size:
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            count = np.diff(np.append(first, ids.size))
            low = np.minimum.reduceat(rank, first)
            going = low < NEVER
            if not going.all():  # these pieces have no more pairs
                stay = np.repeat(going, count)
                done.append((owner[~stay], ids[~stay]))
                ids, owner, rank, low = ids[stay], owner[stay], rank[stay], low[going]
                if not ids.size:
                    break
                count = count[going]
                first = np.cumsum(count) - count
            hits = np.flatnonzero(rank == np.repeat(low, count))
            hits = hits[np.append(True, owner[hits[1:]] != owner[hits[:-1]])]  # the leftmost of each piece
            ids[hits] = low
            keep = np.ones(ids.size, bool)
            keep[hits + 1] = False
            at = hits - np.arange(hits.size)  # places after removal: each earlier piece has lost one
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            for k in (at, at - 1):
                k = k[k >= 0]
                inside = np.zeros(k.size, bool)
                inside[k + 1 < ids.size] = owner[k[k + 1 < ids.size] + 1] == owner[k[k + 1 < ids.size]]
                rank[k] = NEVER
                rank[k[inside]] = self.joint(ids[k[inside]], ids[k[inside] + 1])
        owner, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        packed, ends = ids[order].astype(IDS).tobytes(), np.cumsum(np.bincount(owner, minlength=sizes.size)) * 4
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merge(self, raw: bytes) -> list[bytes]:
        """Join the neighbours of lowest rank, leftmost first, until none can be joined.

        A queue of candidates makes a piece of n bytes cost n log n, however long it is.
        """
        if raw in self.ranks:
            return [raw]
        rank, n = self.ranks.get, len(raw)
        part = [raw[i:i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i) for i in range(n - 1) if (r := rank(raw[i:i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            j = right[i]
            if not part[i] or j >= n or rank(part[i] + part[j]) != r:
                continue  # one of both has been joined meanwhile
            part[i] += part[j]
            part[j] = b""
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (s := rank(part[i] + part[k])) is not None:
                    heapq.heappush(queue, (s, i))
            if (h := left[i]) >= 0 and (s := rank(part[h] + part[i])) is not None:
                heapq.heappush(queue, (s, h))
        return [p for p in part if p]


def _pieces(ranks: bytes) -> Pieces:
    return worker_memory(f"bpe-{hash(ranks)}", lambda: Pieces(ranks))


def encode(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and ends (packed unsigned 32-bit, ends: byte offset after each token).

    One row per input row, repeated rows included. A missing or empty text has no tokens and
    empty ids; a missing id stays missing. Other columns are ignored, whatever their names.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(path))  # one vocabulary file, below 1 MB

    def run(batch: pa.RecordBatch) -> dict:
        bpe, finder = _pieces(ranks.value), boundaries()
        ids, ends, counts = [], [], []
        for chunk in finder.chunks([raw.decode() for raw in texts_of(batch.column(1))]):
            for packed in bpe.encode(chunk):
                ids.append(packed)
                ends.append(np.cumsum(bpe.lengths[np.frombuffer(packed, IDS)]).astype(IDS).tobytes())
                counts.append(len(packed) // 4)
        return {"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()),
                "ids": binary_array(ids), "ends": binary_array(ends)}

    return map_arrow(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run,
                     "doc_id long, n_tokens long, ids binary, ends binary")


def decode_span(bpe: Pieces, ids: bytes, ends: bytes, first: int = 0, last: int | None = None) -> bytes:
    """The bytes of tokens first to last (not included); by ``ends`` they are a slice of the text."""
    own = np.frombuffer(ids, IDS)[first:last]
    raw = b"".join(map(bpe.tokens.__getitem__, own.tolist()))
    offset = np.concatenate([[0], np.frombuffer(ends, IDS)])
    if len(raw) != int(offset[first + own.size]) - int(offset[first]):
        raise ValueError("ids and offsets do not belong together")
    return raw


def decode(df: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` (bytes) to rows of ``encode``."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batch: pa.RecordBatch) -> dict:
        bpe = _pieces(ranks.value)
        raw = [decode_span(bpe, i, e) for i, e in zip(batch.column("ids").to_pylist(), batch.column("ends").to_pylist())]
        return {**dict(zip(batch.schema.names, batch.columns)), "decoded": binary_array(raw)}

    return map_arrow(df.select("doc_id", "n_tokens", "ids", "ends"), run,
                     "doc_id long, n_tokens long, ids binary, ends binary, decoded binary")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """Encode, decode, and reduce to doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return decode(encode(documents, path), path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


