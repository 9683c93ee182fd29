"""Merkle manifest: addresses, roots, proofs and tampering against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from secondlook.llm import merkle

SF = "/root/testdata/sf0.01"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def layout(rows, node=(0, 0)):
    """Nodes (row, number) of a complete tree in van Emde Boas order, by its definition."""
    if rows == 1:
        return [node]
    top = rows // 2
    out = layout(top, node)
    row, number = node
    for k in range(merkle.FAN ** top):
        out += layout(rows - top, (row + top, number * merkle.FAN ** top + k))
    return out


@pytest.mark.parametrize("rows", range(1, 8))
def test_addresses_follow_the_layout(rows):
    order = layout(rows)
    assert len(order) == merkle.size_of(rows)
    for row in range(rows):
        numbers = np.arange(merkle.FAN ** row)
        assert [order[a] for a in merkle.address(rows, row, numbers)] == [(row, k) for k in numbers]


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k:k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, k):
    out = []
    for row in tree[:-1]:
        first = k // 3 * 3
        out.append("".join(row[first:k]) + "|" + "".join(row[k + 1:first + 3]))
        k //= 3
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, path) of rows (doc_id, source, text)."""
    own = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = {}
    for d, s, t in rows:
        by.setdefault(s, []).append((d is not None, d or 0, sha(own(d) + own(s) + own(t)), d))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, x in enumerate(sorted(by[s], key=lambda x: x[:3])):
            out.append((x[3], x[2], trees[s][-1][0], top[-1][0], ",".join(siblings(trees[s], i) + siblings(top, k))))
    return sorted(out, key=repr)


def proofs(df, climb):
    leaf = merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("text"))
    found = merkle.build(df, leaf, claim=leaf, climb=climb).proofs()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.path) for r in found.collect()), key=repr), found


ODD = [(None, "a", "x"), (None, "a", "x"), (1, None, "x"), (1, "", "x"), (1, "é", None), (2, "é", ""), (5, "z", "same"), (5, "z", "same"), (5, "z", "other"),
       (-9, "z", "before"), (2 ** 63 - 1, "z", "last"), (7, "a", "long " * 50_000)]


@pytest.mark.parametrize("climb", [1, 2, 6])
def test_proofs_equal_plain_trees(spark, climb):
    """Blocks of 3, 9 and 729 leaves: up to six rounds, a source with most rows, 40 sources, and odd rows."""
    rng = random.Random(5)
    rows = ODD + [(k, "hot" if rng.random() < 0.6 else f"s{rng.randrange(40)}", f"text {k % 7}") for k in range(1_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(7)
    df = df.selectExpr("doc_id", "'x' AS tree", "source", "text", "1 AS n", "2 AS position", "'y' AS path", "3 AS block")
    got, found = proofs(df, climb)
    assert got == brute(rows)
    assert all(r.verified and r.folded_root == r.root for r in merkle.verified(found).collect())


def test_one_row_one_source_and_none(spark):
    schema = "doc_id long, source string, text string"
    got, found = proofs(spark.createDataFrame([(3, "a", "b")], schema), 6)
    assert got == brute([(3, "a", "b")]) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == ""
    assert merkle.verified(found).first().verified
    empty = spark.createDataFrame([], schema)
    assert proofs(empty, 6)[0] == [] and merkle.build(empty, F.lit("")).root().count() == 0


def test_changed_rows_are_found(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    leaf = merkle.leaf_digest(F.col("doc_id"), F.col("text"))
    other = merkle.leaf_digest(F.col("doc_id"), F.concat("text", F.lit(" ")))
    claim = F.when(F.col("doc_id") % 3 == 0, other).when(F.col("doc_id") % 3 == 1, leaf)
    rows = merkle.verified(merkle.build(df, leaf, claim).proofs()).collect()
    assert len(rows) == df.count() and all(r.verified == (r.doc_id % 3 == 1) for r in rows)
    assert all((r.folded_root is None) == (r.doc_id % 3 == 2) for r in rows)
