"""Jaccard classes and fuzzy lines against brute force over all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from secondlook.llm import fuzzylines, graph, jaccard

SF = "/root/testdata/sf0.01"


def classes_of(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def brute(rows, words, percent):
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k:k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    links = []
    order = sorted((d, k) for k, (d, _) in enumerate(rows) if d is not None)  # texts that share an id are nodes of their own
    for (i, j) in combinations([n for n in order if sets[n[1]]], 2):
        a, b = sets[i[1]], sets[j[1]]
        if min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
            links.append((i, j))
    label = classes_of(links, order)
    return sorted(((d, len(sets[k]), label[d, k][0] if d is not None else None) for k, (d, _) in enumerate(rows)), key=repr)


def result(df, **options):
    return sorted((tuple(r) for r in jaccard.classes(df, **options).collect()), key=repr)


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, 3, 90)
    assert result(docs, words=3, percent=90) == want and len({r[2] for r in want}) < len(want) - 40


@pytest.mark.parametrize("block", [4 << 20, 2_000])
def test_planted_copies_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "GROUP_SHINGLES", block)  # the small one splits groups into blocks
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(300)}"
    rows = []
    for base in range(12):
        text = [word() for _ in range(rng.choice([2, 9, 10, 11, 12, 30, 60, 200]))]
        for _ in range(12):
            own = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), (" " if base % 2 else "\n\t").join(own).upper() if base % 3 else " ".join(own)))
    rows += [(900, None), (901, ""), (902, " \n"), (None, rows[3][1]), (None, rows[3][1]), (903, "one"), (904, "One"), (904, "One"), (905, "ÉT a"), (906, "ét a"),
             (907, "z " * 40_000), (908, "z " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS label", "3 AS digest", "4 AS component")
    for words, percent in ((3, 90), (5, 80)):
        assert result(df, words=words, percent=percent) == brute(rows, words, percent)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([d for d, _, c in brute(rows, 5, 80) if c == d], key=repr)
    assert jaccard.classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [10 ** 6, 0])
def test_components_of_chains_and_stars(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "LOCAL_LINKS", limit)
    rng = random.Random(limit)
    links = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 150)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    df = spark.createDataFrame(links, "a long, b long")
    want = classes_of(links, {n for x in links if x[0] != x[1] for n in x})
    assert {r.node: r.label for r in graph.components(df).collect()} == want
    assert graph.components(df.limit(0)).count() == 0


def test_buckets_lose_no_pair():
    rng = np.random.default_rng(2)
    for _ in range(400):
        percent, n = int(rng.choice([80, 90])), int(rng.integers(4, 300))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        change = rng.integers(0, max(1, n * (100 - percent) // 100) + 1)
        b = np.unique(np.concatenate([a[change:], rng.integers(0, 2**63, rng.integers(0, 1 + n // 20), dtype=np.uint64)]))
        a = np.unique(a)
        shared = np.intersect1d(a, b).size
        if 100 * shared >= percent * (a.size + b.size - shared) and not np.array_equal(a, b):
            assert np.intersect1d(jaccard.bucket_keys(a, percent), jaccard.bucket_keys(b, percent)).size


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def bigram_counts(texts):
    out = np.zeros((len(texts), 256), np.int16)
    for i, own in enumerate(texts):
        for x, y in zip(own, own[1:]):
            out[i, (ord(x) * 31 + ord(y)) % 256] += 1
    return out


def near_pairs(names, similarity=0.8):
    """All pairs of lines with that edit similarity. An edit changes at most four counts of bigrams, which rules most pairs out."""
    texts = sorted((n.decode() for n in names), key=len)
    counts, sizes, found = bigram_counts(texts), np.array([len(t) for t in texts]), []
    for i in range(len(texts) - 1):
        last = int(np.searchsorted(sizes, sizes[i] / similarity + 1e-6, "right"))
        room = sizes[i + 1:last] * (1 - similarity) + 1e-9
        apart = np.abs(counts[i + 1:last] - counts[i]).sum(axis=1)
        for j in np.flatnonzero((sizes[i + 1:last] - sizes[i] <= room) & (apart <= 4 * room)).tolist():
            if fuzzylines.edit_distance(texts[i], texts[i + 1 + j]) <= room[j]:
                found.append((texts[i].encode(), texts[i + 1 + j].encode()))
    return found


def test_edit_distance_equals_the_table():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choices("abcé漢", k=rng.randint(0, 30))) for _ in "xy")
        assert fuzzylines.edit_distance(a, b) == edit(a, b)


def brute_lines(rows, min_words=4):
    """Lines taken out by edit similarity alone, over all pairs."""
    key = lambda d: fuzzylines.NO_ID if d is None else d
    lines = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            w = fuzzylines.normalised(x)
            if len(w) >= min_words:
                lines.setdefault(b" ".join(w), set()).add(key(d))
    names = sorted(lines)
    links = near_pairs(names)
    label = classes_of(links, names)
    first = {}
    for n in names:
        first[label[n]] = min(min(lines[n]), first.get(label[n], fuzzylines.NO_ID))
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        seen, kept, gone = set(), [], 0
        for x in t.split("\n"):
            w = fuzzylines.normalised(x)
            g = label.get(b" ".join(w)) if len(w) >= min_words else None
            if g is not None and (first[g] < key(d) or g in seen):
                gone += 1
            else:
                kept.append(x)
            seen.add(g)
        out.append((d, "\n".join(kept), sum(bool(fuzzylines.normalised(x)) for x in t.split("\n")), gone))
    return sorted(out, key=repr), len(links)


def test_lines_equal_brute_force(spark):
    rng = random.Random(9)
    pool = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(4, 60))) for _ in range(60)]
    rows = []
    for i in range(150):
        text = []
        for _ in range(rng.randint(0, 8)):
            line = rng.choice(pool)
            if rng.random() < 0.5:
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice(["x", "", " ", "7", "!"]) + line[at:]
            text.append(line.capitalize() + rng.choice(["", ".", " !"]))
        rows.append((i, "\n".join(text)))
    rows += [(500, None), (501, ""), (None, rows[4][1]), (None, rows[4][1]), (502, "\n\n" + rows[4][1]), (502, rows[4][1]), (503, "a b\n" * 30),
             (504, "one two three four\n" * 5_000), (505, "one  two, three FOUR"), (-3, "one two three four")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "1 AS n_removed", "text", "2 AS id", "'k' AS key", "3 AS chunk")
    got = fuzzylines.dedup(df)
    assert got.columns == ["doc_id", "text", "id", "key", "chunk", "n_lines", "n_removed"]
    want, links = brute_lines(rows)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=repr) == want and links > 5
    assert fuzzylines.dedup(df.limit(0)).count() == 0


def test_lines_of_the_table_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want, _ = brute_lines([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in fuzzylines.dedup(docs).collect()), key=repr) == want


def test_one_row_of_each_class_stays(spark):
    """Ids with several texts, repeated rows, missing ids and texts, clashing columns: a text that nothing repeats is never lost."""
    rng = random.Random(3)
    t, u, v = (" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(60)) for _ in range(3))
    near = t + " more"
    rows = [(1, t, "a"), (5, t, "b"), (5, u, "c"), (1, v, "d"), (7, near, "e"), (9, v + " end", "f"), (11, "same row here", "g"), (11, "same row here", "g"),
            (11, "same row here", "h"), (None, t, "i"), (None, None, "j"), (12, None, "k"), (12, None, "k"), (13, "", "l"), (13, " \t", "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class string").selectExpr("doc_id", "text", "class", "1 AS place", "2 AS node", "3 AS copies")
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns
    kept = sorted(((r.doc_id, r.text, r["class"]) for r in got.collect()), key=repr)
    want = [(1, t, "a"), (5, u, "c"), (1, v, "d"), (11, "same row here", "g"), (None, t, "i"), (None, None, "j"), (12, None, "k"), (12, None, "k"),
            (13, "", "l"), (13, " \t", "l")]
    assert kept == sorted(want, key=repr)
    assert jaccard.one_of_each(df.limit(0)).count() == 0


def test_a_bucket_gives_one_link_for_each_document():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 300, 5_000), rng.integers(0, 300, 5_000)
    node, label = jaccard._contracted(a, b)
    assert node.size == np.unique(node).size < 300 and (label < node).all()
    assert classes_of(list(zip(node.tolist(), label.tolist())), range(300)) == classes_of([(x, y) for x, y in zip(a.tolist(), b.tolist())], range(300))


def test_sets_of_a_large_group_go_to_two_size_classes(spark, monkeypatch):
    """A group too large for a task is split by size first: its sets are not sent once for each block."""
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    sent, apply = [], PandasGroupedOpsMixin.applyInArrow

    def spy(self, function, schema):
        if function.__name__ == "compare":
            sent.append(self._df)
        return apply(self, function, schema)
    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInArrow", spy)
    monkeypatch.setattr(jaccard, "GROUP_SHINGLES", 10_000)
    rng = random.Random(21)
    phrase = [f"p{k}" for k in range(8)]
    rows = []
    for i in range(60):  # hang together by a phrase, few are near
        words = phrase * 2 + [f"w{rng.randrange(10 ** 6)}" for _ in range(int(12 * 1.08 ** i))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words + [f"x{i}"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "bucket_keys", lambda shingles, percent: np.full(1, 7, np.uint64))  # all sets meet: one candidate group
    assert result(df, words=3, percent=90) == brute(rows, 3, 90)
    sets, rows_sent = sent[0].select("node").distinct().count(), sent[0].count()
    assert sets > 60 and rows_sent < 3 * sets


def test_only_sets_that_share_enough_shingles_get_buckets(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=120)) for _ in range(60)]
    texts += [x.replace(" ", " q ", 1) for x in texts[:5]] + [texts[7], "", None, "one two"]
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string").repartition(3)
    calls = spark.sparkContext.accumulator(0)
    keys_of = jaccard.bucket_keys

    def counted(shingles, percent):
        calls.add(1)
        return keys_of(shingles, percent)

    monkeypatch.setattr(jaccard, "bucket_keys", counted)
    got = {r.doc_id: r.component_id for r in jaccard.classes(df, 3, 90).collect() if r.doc_id is not None}
    assert {i: c for i, c in got.items() if i != c} == {**{60 + k: k for k in range(5)}, 65: 7}
    assert 10 <= calls.value <= 2 * 11  # five pairs, and the text that has a copy; 60 sets before


def test_shared_counts_are_never_too_few():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, k).astype(np.uint64)) for k in (0, 1, 50, 200, 0, 30)]
    sent = [jaccard.dealt_shingles(x, 7) for x in (sets[:3], sets[3:], [])]
    total = [np.zeros(3, np.int64), np.zeros(3, np.int64)]
    for p in range(7):
        rows = [(c, np.frombuffer(h, np.uint32), np.frombuffer(n, np.uint32)) for c, x in enumerate(sent) for q, h, n in zip(*x) if q == p]
        for (c, _, _), found in zip(rows, jaccard.shared_counts([h for _, h, _ in rows], [n for _, _, n in rows])):
            total[c] += found
    every = np.concatenate(sets)
    want = [sum((every == t).sum() > 1 for t in s) for s in sets]
    assert np.concatenate(total).tolist() == want and jaccard.shared_counts([], []) == []
