"""Byte-level BPE and binary records against the public libraries, on whole texts and odd ones."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from secondlook.llm import bpe, records
from secondlook.llm.pretokenise import Boundaries
from secondlook.session import stage_path

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "a", "it's we're I'll 'd 's's 'll've don'tell 'r 'x ''s '''re", " 's  's\n's\t's!'s 1's", "a  b \n\n c   ",
    "tab\tthen nbsp　wide line\u0085next\x1c\x1f", "x²½Ⅷ१२३ ٣ 漢字かな한국어 ไทย", "é́é ñ Ç ß", "😀😀👩‍👩‍👧 #*$%&|<>",
    "nul\0inside\0", "A" * 70 + "'" * 9 + "z" * 3000, "ab" * 5000, "1234567890" * 300, "\r\n\r\n  \r\n", "<|endoftext|> x", "﻿bom ​‍",
]


def test_pieces_equal_the_pattern():
    rng, finder = np.random.default_rng(0), Boundaries()
    letters = list("abst'rvelmd' 12.,\n\t é漢😀")
    texts = ODD + ["".join(rng.choice(letters, rng.integers(0, 400))) for _ in range(600)]
    want = [regex.findall(P.PATTERN, t) for t in texts]
    assert list(finder.pieces(texts)) == want


def test_long_text_crosses_blocks():
    text = "don't stop  'll 12 \n" * 40_000
    assert next(Boundaries().pieces([text])) == regex.findall(P.PATTERN, text)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, None), (4, "copy"), (4, "copy")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "'x' AS n_tokens", "2 AS file")


def test_bpe_equals_tiktoken(spark, sf, odd):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        def row(d, t):
            ids = np.array(want.encode_ordinary(t or ""), "<u4")
            return (d, ids.size, hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        expected = sorted((row(r.doc_id, r.text) for r in docs.collect()), key=repr)
        assert sorted((tuple(r) for r in bpe.digests(docs, RANKS).collect()), key=repr) == expected
    assert bpe.digests(odd.limit(0), RANKS).count() == 0


def test_any_span_decodes(spark, odd):
    tokens = bpe.Pieces(bpe.read_ranks(RANKS))
    for r in bpe.encode(odd.where("doc_id in (4, 8, 12)"), RANKS).collect():
        raw, ends = ODD[r.doc_id].encode() if r.doc_id != 4 else None, np.frombuffer(r.ends, "<u4")
        if raw is not None:
            assert bpe.decode_span(tokens, r.ids, r.ends, 2, 5) == raw[ends[1]:ends[4]]
    with pytest.raises(ValueError):
        bpe.decode_span(tokens, r.ids, r.ends[:-4] + b"\xff\xff\xff\0")


def test_records_equal_the_library(spark, sf, odd):
    library = Tokenizer.from_file(JSON)
    for docs in (odd.repartition(5), spark.read.parquet(f"{sf}/documents.parquet").repartition(4), odd.limit(0)):
        folder = stage_path(spark, "records-test")
        records.write(docs, JSON, folder)
        got = sorted(((r.start, r.doc_id, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in records.read(spark, folder, ids=F.col("ids")).collect()))
        texts = {}
        for r in docs.collect():
            texts.setdefault(r.doc_id, []).append(np.array(library.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4"))
        start, seen = 0, []
        for s, d, n, crc in got:  # gapless, ids ascending, every document once
            assert s == start
            own = next(i for i, ids in enumerate(texts[d]) if (ids.size, zlib.crc32(ids.tobytes())) == (n, crc))
            texts[d].pop(own)
            start += n
            seen.append(d)
        assert not any(texts.values()) and seen == sorted(seen, key=lambda d: (d is not None, d or 0))


def test_damage_is_found():
    raw = records.frame(7, np.arange(5), 2) + b"\n" + records.frame(None, np.arange(3), 2) + b"\n"
    doc_id, ids, after = records.read_frame(raw, 0)
    assert doc_id == 7 and ids.tolist() == [0, 1, 2, 3, 4] and records.read_frame(raw, after)[0] is None
    for at in range(after - 1):
        broken = bytearray(raw)
        broken[at] ^= 4
        with pytest.raises((ValueError, records.struct.error)):
            records.read_frame(bytes(broken), 0)


def test_shuffled_read_by_index(spark, sf):
    folder = stage_path(spark, "records-seek")
    records.write(spark.read.parquet(f"{sf}/documents.parquet"), JSON, folder)
    row = spark.read.parquet(f"{folder}/index").where("doc_id = 17").first()
    path = f"{folder}/records/{row.file}".removeprefix("file:")
    with open(path, "rb") as file:
        file.seek(row.offset)
        raw = file.read(row.length)
    assert raw.endswith(b"\n") and records.read_frame(raw, 0)[0] == 17


def test_new_pieces_in_arrays_equal_the_library():
    import public_tokenizers
    import random
    library = records.Library(open(JSON, encoding="utf-8").read())
    assert library.in_arrays
    rng = random.Random(7)
    letters = "aeiounrst ßé漢\U0001F600\x00\n0123.'\"" + "THEing"
    pieces = ["".join(rng.choices(letters, k=rng.randint(1, 70))) for _ in range(3_000)] + ["a" * 64, "a" * 65, "é" * 32, " the", "\n"]
    own = library.tokenizer.model
    for p, packed in zip(pieces, library.learn(pieces)):
        signs = p.encode().decode("latin-1").translate(library.signs)
        assert np.frombuffer(packed, "<u4").tolist() == [t.id for t in own.tokenize(signs)]
    assert library.learn([]) == []


def test_files_stand_by_their_numbers(spark, sf):
    names = [f"part-{n}-abc-c{c:03d}.txt" for n in ("00002", "99999", "100000", "100001") for c in (0, 1)]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "file string")
    assert [r.file for r in df.orderBy(*records.file_order("file")).collect()] == names
    folder = stage_path(spark, "records-heads")
    records.write(spark.read.parquet(f"{sf}/documents.parquet").limit(50), JSON, folder)
    key = ["file", "offset", "length", "doc_id", "n_tokens", "local_start"]
    heads, whole = (sorted(tuple(r) for r in records.scan(spark, folder, payload).select(*key).collect()) for payload in (False, True))
    assert heads == whole and len(heads) == 50


def test_equal_rows_are_parted(spark):
    """One row many times goes to several tasks and comes back as many times."""
    df = spark.range(4_000).selectExpr("7 AS doc_id", "'the same text' AS text").repartition(6)
    folder = stage_path(spark, "records-equal")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else few rows are one part
    try:
        records.write(df, JSON, folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = records.read(spark, folder).collect()
    assert len(got) == 4_000 and len({r.start for r in got}) == 4_000 and {r.doc_id for r in got} == {7}
    assert spark.read.parquet(f"{folder}/index").select("file").distinct().count() > 1
