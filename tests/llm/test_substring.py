"""Repeated windows against brute force."""

import hashlib
import random
import re

from secondlook.llm import substring

SF = "/root/testdata/sf0.01"


def brute(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    key = lambda d: substring.NO_ID if d is None else d
    for (d, _), w in zip(rows, words):
        for k in range(len(w) - 12):
            own = tuple(w[k:k + 13])
            first[own] = min(key(d), first.get(own, substring.NO_ID))
    out = []
    for (d, _), w in zip(rows, words):
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k:k + 13])] < key(d) for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    rows = substring.repeats(df).collect()
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in rows)
    return sorted((tuple(r)[:4] for r in rows), key=repr)


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert result(docs) == want and sum(r[2] > 0 for r in want) > 50


def test_random_and_odd_texts(spark):
    rng = random.Random(1)
    shared = [[f"w{rng.randrange(4)}" for _ in range(rng.randint(10, 40))] for _ in range(6)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(shared)[rng.randrange(5):] + [f"w{rng.randrange(4)}" for _ in range(rng.randint(0, 20))]
        rows.append((i, "\n \t".join(words)))
    rows += [(200, None), (201, ""), (None, rows[5][1]), (None, "x " * 40), (5, rows[5][1]), (300, "y " * 30_000), (301, "y " * 13), (302, "y " * 12), (-4, rows[7][1] + " end"), (9, "other text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS sha", "3 AS chunk", "4 AS place")
    assert result(df) == brute(rows)
    assert substring.repeats(df.limit(0)).count() == 0


def test_one_row_for_each_row_of_repeated_ids(spark):
    """One id with the same words under other white space: as many rows come out as went in."""
    a = " ".join(f"w{k}" for k in range(30))
    rows = [(1, a), (1, a.replace(" ", "\n", 1)), (1, a + " "), (1, a), (2, "x " + a), (2, a), (None, a), (None, " " + a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(df) == brute(rows)
