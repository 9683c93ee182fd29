"""The pipeline: each stage judged on its own input."""

import base64

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from secondlook.llm import compression, decontaminate, jaccard
from secondlook.llm.common import stage

from test_near import brute, brute_lines

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "jaccard_join", "decontamination", "byte_level_bpe"]
    for name, step in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(step(spark, docs, SF), name)
        rows = {r.doc_id: r for r in docs.collect()}
        kept[name] = before, rows
        if name != "byte_level_bpe":
            assert docs.columns == names

    before, rows = kept["quality_classifier"]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    share = lambda q: sum(d in rows for d in quality if quality[d] == q) / sum(v == q for v in quality.values())
    assert share(1) > 0.97 and share(0) < 0.3 and all(rows[d] == before[d] for d in rows)

    before, rows = kept["line_dedup"]
    want, _ = brute_lines([(r.doc_id, r.text) for r in before.values()])
    assert {d: r.text for d, r in rows.items()} == {d: t for d, t, _, gone in want if not gone or t.strip()}
    assert all(r.n_chars == len(r.text) for r in rows.values())

    before, rows = kept["jaccard_join"]
    assert set(rows) == {d for d, _, c in brute([(r.doc_id, r.text) for r in before.values()], jaccard.WORDS, jaccard.PERCENT) if c == d}

    before, rows = kept["decontamination"]
    index, = decontaminate.indexes(spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert set(rows) == {d for d, r in before.items() if not index.leaks(r.text)}

    before, rows = kept["byte_level_bpe"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {d: np.frombuffer(r.ids, "<u4").tolist() for d, r in rows.items()} == {d: own.encode_ordinary(r.text) for d, r in before.items()}


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF), name)
        assert docs.count() == 0
    assert compression.CompressionModel(b"", b"", 0.0, 0.0).slope == 0
