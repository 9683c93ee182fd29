"""Compression classifier, tokeniser fertility and k-d tree shards."""

import re
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

from secondlook.llm import compression, fertility, kdtree
from secondlook.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
RANKS, MODEL = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "en", ""), (2, "en", None), (None, None, "no id here"), (4, "en", "same same same same same same"),
            (4, "en", "same same same same same same"), (5, "xx", "漢字 かな # $ | x\n\n \nx\nx\ty\v\nx"), (6, "en", "word " * 50_000),
            (7, None, "a b c a b c"), (8, "en", "one two three")]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string").selectExpr("*", "1 AS score", "'x' AS row", "2 AS size", "3 AS difference")


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op8_compression_classifier"](spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in got.items())
    told = [(got[x.doc_id].predicted, x.quality) for x in labels if got[x.doc_id].held_out]
    assert sum(a == b for a, b in told) / len(told) >= 0.93


def test_classifier_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (4, 0), (6, 1), (8, 0), (None, 1), (5, None)], "doc_id long, quality int")
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        model = compression.fit(odd, known)
        rows = compression.score(odd, model).collect()
        assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
        kept = compression.filter_documents(odd, model, 0.0)
        assert kept.columns == odd.columns and kept.count() == 9
    assert compression.score(odd.limit(0), compression.fit(odd.limit(0), labels)).count() == 0


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_base_rules_equal_brute_force(spark, odd):
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)
        rows = sorted(fertility.judge(docs, RANKS, MODEL).collect(), key=lambda r: repr((r.doc_id, r.n_words)))
        want = sorted(((d, *plain_counts(t)) for d, t in texts), key=repr)
        assert sorted(((r.doc_id, *r[3:8]) for r in rows), key=repr) == want
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
        assert not any(r.base_failed and r.kept for r in rows)
    assert fertility.judge(odd.limit(0), RANKS, MODEL).count() == 0


def test_fertility_measures(spark):
    text = "The naïve 漢字 fox ☃ jumps, jumps"
    r = fertility.measure(spark.createDataFrame([(1, text)], "doc_id long, text string"), RANKS, MODEL).first()
    import base64
    import sentencepiece
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    bpe = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    chars = len(text.replace(" ", ""))
    assert r.chars_per_token == pytest.approx(chars / len(bpe.encode_ordinary(" " + text)))
    pieces = [i for w in text.split() for i in sp.encode(w)]
    assert r.piece_chars_per_token == pytest.approx(chars / len(pieces))
    assert r.fallback_share == pytest.approx(sum(map(sp.is_byte, pieces)) / len(pieces)) and r.fallback_share > 0
    assert r.script == "LATIN" and 0 < r.entropy <= 1


def test_fertility_keeps_good_and_rejects_bad(spark):
    rows = fertility.judge(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), RANKS, MODEL).join(
        spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    kept = lambda q: [r.kept for r in rows if r.quality == q]
    assert sum(kept(1)) / len(kept(1)) > 0.97 and sum(kept(0)) / len(kept(0)) < 0.25


def check_shards(docs, shards):
    got = kdtree.shard(docs, shards).collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect()), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == want
    for k in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    return [sum(r["size"] for r in got if r.shard == k) for k in range(shards)]


def test_shards_are_near_equal_and_gapless(spark, odd):
    sizes = check_shards(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), 40)
    mean = sum(sizes) / 40
    assert max(abs(x - mean) for x in sizes) < 0.05 * mean
    assert len(check_shards(odd, 3)) == 3 and sum(check_shards(odd.limit(0), 5)) == 0


def test_equal_rows_are_spread(spark):
    docs = spark.range(3000).selectExpr("7L AS doc_id", "'one text' AS text", "'s' AS source")
    sizes = check_shards(docs, 7)
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes)
