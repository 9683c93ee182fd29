"""Fill-in-the-middle: cuts against Python's own strings, exact round trips."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from secondlook.llm import fim

LETTERS = "ab <>PSM\n\x00éß€漢\U0001F600́\U0010FFFF"


def made(text, hs, marks=fim.MARKS):
    """(output, form, prefix_chars, middle_chars, prefix_bytes, middle_bytes)"""
    text, n = text or "", len(text or "")
    a, b = sorted((hs[0] % (n + 1), hs[1] % (n + 1)))
    if not text or any(m in text for m in marks) or hs[2] % 100 >= 90:
        return text, "plain", None, None, None, None
    p, s, m = marks
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    spm = hs[3] % 100 < 20
    out = s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle
    return out, "spm" if spm else "psm", a, b - a, len(prefix.encode()), len(middle.encode())


def hashes(doc_id):
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[8 * k:8 * k + 8], 16) for k in range(4)]


def test_positions_both_ways():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choices(LETTERS, k=rng.randint(0, 40)))
        raw = np.frombuffer(text.encode(), np.uint8)
        index = fim.Exceptions.of(raw)
        at = np.arange(len(text) + 1)
        want = np.array([len(text[:k].encode()) for k in at])
        assert index.to_bytes(at).tolist() == want.tolist() and index.to_points(want).tolist() == at.tolist()
        assert index.points.size == sum(ord(c) > 127 for c in text)


def test_slices_of_a_batch():
    column = pa.array(["é", None, "", "abc", "漢x"])
    raw, starts = fim.run_of_bytes(column.slice(1, 4))
    assert raw.tobytes().decode() == "abc漢x" and starts.tolist() == [0, 0, 0, 3, 7]


@pytest.mark.parametrize("marks", [fim.MARKS, ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")])
def test_texts_equal_python_strings(spark, marks):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choices(LETTERS, k=rng.randint(0, 60)))) for k in range(1_500)]
    rows += [(None, "no id é"), (None, None), (9, None), (10, ""), (11, "has <S> inside"), (11, "has <S> inside"), (12, "<|fim_middle|>"),
             (13, "é" * 400_000 + "x" * 700_000), (-4, "<P"), (-5, "P><S"), (-6, "\U0001F600")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "7 AS n", "text", "'q' AS form", "array(1) AS `a b`")
    key = F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    got = fim.transform(df, fim.draws(key), marks=marks)
    assert got.columns == ["doc_id", "text", "a b", *fim.ADDED]
    back = fim.restore(got, marks=marks).collect()
    want = sorted(((d, *made(t, hashes(d), marks)) for d, t in rows), key=repr)
    assert sorted(((r.doc_id, r.text, *(r[c] for c in fim.ADDED[1:])) for r in back), key=repr) == want
    assert sorted(((r.doc_id, r.restored, r.n) for r in back), key=repr) == sorted(((d, t or "", len(t or "")) for d, t in rows), key=repr)
    assert {r.form for r in back} == {"plain", "psm", "spm"}


def test_empty_table_and_bad_marks(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fim.restore(fim.transform(df, fim.draws(F.col("doc_id").cast("string")))).count() == 0
    for marks in (("<P>", "", "<M>"), ("aba", "x", "y"), ("ab", "bc", "y")):
        with pytest.raises(ValueError):
            fim.transform(df, [], marks=marks)
