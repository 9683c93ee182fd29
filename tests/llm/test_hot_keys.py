"""Keys with many passages: single windows, no large shard."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

from secondlook.llm import substring
from secondlook.llm.common import text_hashes

from test_substring import brute, result

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("most", [0, 3])
def test_single_windows_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(substring, "KEY_PASSAGES", most)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400).select("doc_id", "text")
    rng = random.Random(6)
    shared = [[f"w{rng.randrange(4)}" for _ in range(30)] for _ in range(4)]
    odd = [(10_000 + i, " ".join(sum(rng.choices(shared, k=3), [f"v{rng.randrange(9)}"]))) for i in range(60)]
    odd += [(None, odd[3][1]), (10_003, odd[5][1]), (None, "x " * 40)]
    df = docs.union(spark.createDataFrame(odd, "doc_id long, text string"))
    assert result(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_a_phrase_of_all_documents_makes_no_large_shard(spark, monkeypatch):
    sent, apply = [], PandasGroupedOpsMixin.applyInArrow

    def spy(self, function, schema):
        if function.__name__ == "search":
            sent.append(self._df)
        return apply(self, function, schema)
    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInArrow", spy)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10 ** 6)}"
    phrase = [word() for _ in range(6)]  # shorter than a window: what stands around it differs
    rows = [(i, " ".join([word() for _ in range(12)] + phrase + [word() for _ in range(12)])) for i in range(6_000)]
    rows.append((9_000, rows[5][1] + " end"))
    got = {r.doc_id: r.n_removed for r in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9_000] == 30 and sum(got.values()) == 30
    words = sent[0].groupBy("shard").agg(F.sum(F.size(F.split(F.col("words").cast("string"), " "))).alias("n")).agg(F.max("n")).first()[0]
    assert words <= 42_000


def test_shared_keys_of_chunks_with_many_others(spark):
    """Keys that occur twice, per chunk once and in order; hot ones apart; the time grows with the keys, not with keys times chunks."""
    rng = np.random.default_rng(2)
    chunks = [np.unique(rng.integers(0, 200_000, 300)).astype(np.uint64) * np.uint64(1 << 44) for _ in range(3_000)]  # most keys are in several
    chunks[0] = np.repeat(chunks[0], 2)  # twice in one chunk
    own = np.array([2 ** 64 - 1], np.uint64)
    rows = [(0, k, (np.append(x, own) if k else x).tobytes(), np.full(x.size + (k > 0), 1_500 if k < 2 else 0).tobytes()) for k, x in enumerate(chunks)]
    began = time.monotonic()
    got = {r.chunk: (np.frombuffer(r.keys, np.uint64), np.frombuffer(r.hot, np.uint64)) for r in
           substring.shared_keys(spark.createDataFrame(rows, "bucket long, chunk long, keys binary, runs binary")).collect()}
    assert time.monotonic() - began < 25  # a search of all shared keys for each chunk took minutes
    seen = np.concatenate([chunks[0][::2], *chunks[1:]])
    keys, count = np.unique(np.concatenate([chunks[0], *chunks[1:], np.repeat(own, 2_999)]), return_counts=True)
    shared = set(keys[count > 1].tolist())
    assert len(shared) < seen.size and {k: x.tolist() for k, (x, _) in got.items()} == {
        k: [y for y in np.unique(np.append(x, own[:k])).tolist() if y in shared] for k, x in enumerate(chunks)}
    assert set(got[0][1].tolist()) == set(np.unique(chunks[0]).tolist())
    assert got[1][1].tolist() == np.intersect1d(chunks[0], chunks[1]).tolist()


def test_word_hashes_of_a_text_depend_on_its_words_alone():
    rng = random.Random(4)
    words = {bytes(rng.choices([*range(0x21, 0x80), 0xC2, 0x85, 0xA0, 0], k=n)) for n in [*range(1, 60), 255, 256, 257, 900] for _ in range(9)}
    words = [w for w in words if w.split() == [w]] + [b"a", b"a\0", b"a\0\0"]
    raw = b" ".join(words)
    seen = text_hashes(raw)
    assert seen.size == np.unique(seen).size == len(set(words)) == len(words)
    odd = b"\n\t " + b"".join(w + bytes(rng.choices(b" \t\n\r\x0b\x0c", k=rng.randint(1, 3))) for w in words)
    assert (text_hashes(odd) == seen).all() and [text_hashes(w)[0] for w in words] == seen.tolist()
    assert not text_hashes(b"").size and not text_hashes(b" \n").size
