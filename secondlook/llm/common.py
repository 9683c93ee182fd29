"""What the operators of this folder share: reading, batches, staging, worker memory."""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from secondlook.session import shuffle_partitions, stage  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"  # fixed value: what counts as a word in every operator
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that a batch of long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str | StructType,
              slice_bytes: int = 0) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of whole rows; it returns columns by name, in the schema's order. With ``slice_bytes`` a
    batch comes in slices of about that size, for functions that make much more than they are given."""
    small_batches(df.sparkSession)

    def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        step = -(-batch.num_rows // max(1, batch.nbytes // slice_bytes)) if slice_bytes and batch.num_rows else max(1, batch.num_rows)
        return (batch.slice(at, step) for at in range(0, batch.num_rows, step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                if (out := fn(part)) is not None:
                    yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out

    return df.mapInArrow(run, schema)


def worker_memory(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks: task functions travel by value, their globals do not."""
    kept = sys.modules.setdefault("_secondlook_worker", types.ModuleType("_secondlook_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a missing text is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def binary_array(values: list[bytes]) -> pa.Array:
    return pa.array(values, type=pa.binary())


def unsigned_hash(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit mix (splitmix64) of unsigned 64-bit values."""
    z = values.astype(np.uint64, copy=True)
    z += np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, the same on every worker; keeps at most ``limit`` words."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes() -> WordHashes:
    return worker_memory("word-hashes", WordHashes)


BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG_WORD = 256  # bytes; the few longer words are hashed one by one


def text_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text, eight bytes of all its words at a time."""
    blank = BLANK[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
    start, size = edge[0::2], edge[1::2] - edge[0::2]
    eights = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,))
    out = unsigned_hash((eights[start] & LOW_BYTES[np.minimum(size, 8)]) + unsigned_hash(size.astype(np.uint64), 12), 10)
    left = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    at = 8
    while left.size:
        own = eights[start[left] + at] & LOW_BYTES[np.minimum(size[left] - at, 8)]
        out[left] = unsigned_hash(out[left] * np.uint64(0x9E3779B97F4A7C15) + own, 11)
        at += 8
        left = left[size[left] > at]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(raw[start[k]:start[k] + size[k]], digest_size=8).digest(), "little")
    return out


def blobs_by_bucket(keys: np.ndarray, buckets: int, *values: np.ndarray) -> tuple[list[int], list[list[bytes]]]:
    """Unsigned keys dealt to buckets: the buckets that got some, and each array's part as packed bytes."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if keys.size else np.zeros(0, np.int64)
    last = np.append(first[1:], keys.size)
    parts = [[x[order][a:b].tobytes() for a, b in zip(first.tolist(), last.tolist())] for x in (keys, *values)]
    return bucket[first].tolist(), parts


class PieceCache(dict):
    """piece -> packed ids. New pieces of a chunk are learnt together; short ones are kept, up to ``limit``."""

    limit, longest = 300_000, 64

    def learn(self, pieces: list[str]) -> list[bytes]:
        raise NotImplementedError

    def encode(self, documents: list[list[str]]) -> list[bytes]:
        """The packed ids of each document of a chunk, given as its pieces."""
        if len(self) > self.limit:
            self.clear()
        new = [p for p in set().union(*documents) if p not in self]
        self.update(zip(new, self.learn(new)))
        packed = [b"".join(map(self.__getitem__, own)) for own in documents]
        for p in new:
            if len(p) > self.longest:
                del self[p]
        return packed


def no_text(text: str = "text") -> F.Column:
    return F.coalesce(F.col(text), F.lit(""))
