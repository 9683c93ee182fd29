"""Token ids as framed binary records, with an offset index beside them.

A file is a run of frames, each ended by a line feed:

    length of the payload   unsigned 64 bits
    masked crc32 of that length   unsigned 32 bits
    payload: doc_id signed 64 bits (all ones below zero: missing), count unsigned 32, bytes per id
             unsigned 8, then the ids
    masked crc32 of the payload   unsigned 32 bits

All numbers are little-endian. Masking turns a checksum by 15 bits and adds a constant, so that data
which hold checksums don't spoil their own. Spark's text writer puts the frames (any bytes) into
files, so writing works on every file system Spark knows and a failed task leaves nothing behind.
Part numbers follow the order of ids. The index is a Parquet table: file, offset and length of each
frame, doc_id, number of ids and the position of the first id; a reader can draw frames in any
order and fetch them with one seek each.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from secondlook.llm.bpe import Pieces
from secondlook.llm.common import PieceCache, binary_array, map_arrow, no_text, small_batches, texts_of, unsigned_hash, worker_memory
from secondlook.llm.pretokenise import boundaries

END_ID = 0
LONG_PIECE = 256  # code points
MASK_DELTA = 0xA282EAD8  # fixed value
HEAD, PAYLOAD, TAIL = "<QI", "<qIB", "<I"
MISSING_ID = -(2 ** 63)


def masked(raw: bytes) -> int:
    crc = zlib.crc32(raw)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    body = struct.pack(PAYLOAD, MISSING_ID if doc_id is None else doc_id, ids.size, width) + ids.astype(f"<u{width}").tobytes()
    size = struct.pack("<Q", len(body))
    return size + struct.pack(TAIL, masked(size)) + body + struct.pack(TAIL, masked(body))


def read_frame(raw: bytes, offset: int) -> tuple[int | None, np.ndarray, int]:
    """doc_id, ids and the offset of the next frame; raises if a checksum is wrong."""
    size, check = struct.unpack_from(HEAD, raw, offset)
    if masked(raw[offset:offset + 8]) != check:
        raise ValueError(f"damaged length at byte {offset}")
    at = offset + struct.calcsize(HEAD)
    body = raw[at:at + size]
    if len(body) != size or masked(body) != struct.unpack_from(TAIL, raw, at + size)[0]:
        raise ValueError(f"damaged record at byte {offset}")
    doc_id, count, width = struct.unpack_from(PAYLOAD, body)
    ids = np.frombuffer(body, f"<u{width}", count, struct.calcsize(PAYLOAD))
    return (None if doc_id == MISSING_ID else doc_id), ids, at + size + struct.calcsize(TAIL) + 1


def read_head(raw: bytes, offset: int) -> tuple[int | None, int, int]:
    """doc_id, number of ids and the offset of the next frame, the length checked alone."""
    size, check = struct.unpack_from(HEAD, raw, offset)
    if masked(raw[offset:offset + 8]) != check:
        raise ValueError(f"damaged length at byte {offset}")
    at = offset + struct.calcsize(HEAD)
    doc_id, count, _ = struct.unpack_from(PAYLOAD, raw, at)
    return (None if doc_id == MISSING_ID else doc_id), count, at + size + struct.calcsize(TAIL) + 1


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number modulo 2 ** 64, and those of its inverse."""
    base, out = 0x9E3779B97F4A7C15, []
    for factor in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, factor, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def piece_hashes(points: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the code points from ``begin`` to ``stop`` of each piece: a polynomial of mixed code points, as the
    difference of two sums from the start, shifted back to the piece. Long pieces, which a polynomial
    might confuse, are hashed one by one."""
    up, down = powers(1 << max(1, int(points.size)).bit_length())
    sums = np.concatenate([[np.uint64(0)], np.cumsum(unsigned_hash(points.astype(np.uint64)) * up[:points.size], dtype=np.uint64)])
    length = stop - begin
    hashes = unsigned_hash((sums[stop] - sums[begin]) * down[begin] + length.astype(np.uint64), 1)
    long = length > LONG_PIECE
    if long.any():
        hashes[long] = np.fromiter((int.from_bytes(hashlib.blake2b(points[a:b].tobytes(), digest_size=8).digest(), "little")
                                    for a, b in zip(begin[long].tolist(), stop[long].tolist())), np.uint64, int(long.sum()))
    return hashes


class Library(Pieces):
    """piece -> packed ids as the tokenizers library gives them; pieces are what its own pre-tokenizer finds.

    New short pieces are merged together, in arrays. A pair of tokens joins by the rank of its merge, which is not the id
    of what it makes: both go into one number, the rank above the id, so that the smallest is the pair to
    join. Long pieces go to the library's own model.
    """

    ID_BITS = 20

    def __init__(self, definition: str):
        PieceCache.__init__(self)
        self.forget()
        self.tokenizer = Tokenizer.from_str(definition)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}  # fixed values: bytes that stand for themselves
        hidden = [b for b in range(256) if b not in shown]
        self.signs = {b: chr(256 + i) for i, b in enumerate(hidden)}  # the library writes the others from U+0100 on
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        model = json.loads(definition)["model"]
        vocabulary, plain = model["vocab"], not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        signs = [self.signs.get(b, chr(b)) for b in range(256)]
        # anything but plain merges over all bytes is left to the library
        self.in_arrays = plain and len(vocabulary) < 1 << self.ID_BITS and all(c in vocabulary for c in signs)
        if self.in_arrays:
            self.of_byte = np.array([vocabulary[c] for c in signs])
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            pairs = sorted((vocabulary[l] << 32 | vocabulary[r], rank << self.ID_BITS | vocabulary[l + r]) for rank, (l, r) in enumerate(merges))
            self.pairs, self.joined = np.array([k for k, _ in pairs]), np.array([v for _, v in pairs])

    def joint(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return super().joint(left & (1 << self.ID_BITS) - 1, right & (1 << self.ID_BITS) - 1)

    def learn(self, pieces: list[str]) -> list[bytes]:
        raws = [p.encode() for p in pieces]
        short = [k for k, raw in enumerate(raws) if self.in_arrays and raw and len(raw) <= self.longest]
        out = [b""] * len(raws)
        made = self.merge_many([raws[k] for k in short])
        ids = np.frombuffer(b"".join(made), "<u4") & np.uint32((1 << self.ID_BITS) - 1)
        packed, ends = ids.tobytes(), np.cumsum([len(x) for x in made]).tolist()
        for k, a, b in zip(short, [0, *ends[:-1]], ends):
            out[k] = packed[a:b]
        tokenize, signs = self.tokenizer.model.tokenize, self.signs
        for k, raw in enumerate(raws):
            if not out[k]:
                out[k] = b"".join(t.id.to_bytes(4, "little") for t in tokenize(raw.decode("latin-1").translate(signs)))
        return out

    def texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text. Pieces are known by a hash of their code points, taken of all pieces of some texts at once; only new ones
        become strings. Ids of known pieces stand in one array, from which texts gather theirs."""
        for joined, points, begin, stop, upto in boundaries().spans(texts):
            if not begin.size:
                yield from [np.zeros(0, np.uint32)] * upto.size
                continue
            hashes = piece_hashes(points, begin, stop)
            names, first, place = np.unique(hashes, return_index=True, return_inverse=True)
            if len(self.places) > self.limit:
                self.forget()
            slots = [self.places.get(h, -1) for h in names.tolist()]
            new = [k for k, slot in enumerate(slots) if slot < 0]
            if new:
                made = self.learn([joined[a:b] for a, b in zip(begin[first[new]].tolist(), stop[first[new]].tolist())])
                for k, slot in zip(new, self.keep(made)):
                    slots[k] = slot
                self.places.update(zip(names[new].tolist(), [slots[k] for k in new]))
            slot = np.array(slots)[place]
            count = self.counts[slot]
            ids = self.ids[np.repeat(self.starts[slot] - np.cumsum(count) + count, count) + np.arange(count.sum())]
            ends = np.concatenate([[0], np.cumsum(count)])[upto]
            yield from np.split(ids, ends[:-1])

    def forget(self) -> None:
        """No known pieces, and empty arrays for their ids: places in them are where a piece's ids start, and how many there are."""
        self.places: dict[int, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def keep(self, made: list[bytes]) -> range:
        count = np.array([len(x) // 4 for x in made], np.int64)
        known = self.starts.size
        self.starts = np.concatenate([self.starts, self.ids.size + np.cumsum(count) - count])
        self.counts = np.concatenate([self.counts, count])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(made), np.uint32)])
        return range(known, known + count.size)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def encode_and_frame(df: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """One column ``frame`` (bytes), in the order of the rows of (doc_id, text)."""
    with open(path, encoding="utf-8") as file:
        definition = df.sparkSession.sparkContext.broadcast(file.read())  # one vocabulary file, below 2 MB

    def run(batch: pa.RecordBatch) -> dict:
        library = worker_memory(f"library-{hash(definition.value)}", lambda: Library(definition.value))
        texts = [raw.decode() for raw in texts_of(batch.column(1))]
        cut = [any(s in text for s in library.special) for text in texts]  # the library cuts these out before its pieces
        found = library.texts(["" if c else t for c, t in zip(cut, texts)])
        frames = []
        for doc_id, text, special, ids in zip(batch.column(0).to_pylist(), texts, cut, found):
            ids = np.frombuffer(library.whole(text), "<u4") if special else ids
            frames.append(frame(doc_id, np.append(ids, np.uint32(end_id)), library.width))
        return {"frame": binary_array(frames)}

    return map_arrow(df, run, "frame binary")


def write(df: DataFrame, tokenizer: str, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Write ``folder/records`` and ``folder/index``; documents ascend by id, a missing id comes first.

    A missing or empty text is a record of the end id alone. Rows with equal ids stand by the hash of
    their text; repeated rows are repeated records. Other columns are ignored.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), no_text(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("row")]  # the last one parts equal rows, of which there may be many
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    frames = encode_and_frame(sorted_rows.drop("row"), tokenizer, end_id)
    # a cast keeps the bytes as they are; the text writer adds nothing but the line feed
    frames.select(F.col("frame").cast("string").alias("value")).write.text(f"{folder}/records", lineSep="\n")
    found = scan(df.sparkSession, folder, payload=False).drop("ids")
    found.write.parquet(f"{folder}/unplaced")
    found = df.sparkSession.read.parquet(f"{folder}/unplaced")
    totals = found.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # a row per file; part numbers ascend with ids
    before = F.sum("n").over(Window.orderBy(*file_order("file")).rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select("file", F.coalesce(before, F.lit(0)).alias("base"))
    (found.join(base, "file").select("file", "offset", "length", "doc_id", "n_tokens",
                                     (F.col("base") + F.col("local_start")).alias("start"))
     .write.parquet(f"{folder}/index"))


def file_order(file: str) -> list[Column]:
    """Files in the order of their rows: by part number and, within a part, by piece. Names alone don't sort so from part 100000 on."""
    return [F.regexp_extract(file, r"part-(\d+)", 1).cast("long"), F.regexp_extract(file, r"-c(\d+)", 1).cast("long"), F.col(file)]


def scan(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """Every record of ``folder/records``, checksums verified: file, offset, length, doc_id, n_tokens,
    local_start (ids before it in its file) and ids (packed unsigned 32-bit). Without ``payload`` only the frames' heads are
    read and ids are missing."""
    small_batches(spark)
    files = spark.read.format("binaryFile").load(f"{folder}/records").select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                offset, start, rows = 0, 0, []
                while offset < len(raw):
                    if payload:
                        doc_id, ids, after = read_frame(raw, offset)
                        count, packed = ids.size, ids.astype("<u4").tobytes()
                    else:
                        doc_id, count, after = read_head(raw, offset)
                        packed = None
                    rows.append((name, offset, after - offset, doc_id, count, start, packed))
                    offset, start = after, start + count
                    if len(rows) == 2_000 or offset >= len(raw):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows = []

    names = ["file", "offset", "length", "doc_id", "n_tokens", "local_start", "ids"]
    kinds = [pa.string(), *[pa.int64()] * 5, pa.binary()]
    return files.mapInArrow(run, "file string, offset long, length long, doc_id long, n_tokens long, local_start long, ids binary")


def read(spark: SparkSession, folder: str, **values: F.Column) -> DataFrame:
    """doc_id, start, n_tokens and ``values`` (expressions over ids) of every record, placed by the index."""
    index = spark.read.parquet(f"{folder}/index").groupBy("file").agg(F.min("start").alias("base"))
    found = scan(spark, folder).select("file", "doc_id", "n_tokens", "local_start", *[v.alias(k) for k, v in values.items()])
    return found.join(index, "file").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", *values)
