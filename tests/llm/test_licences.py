"""Licence scan: base places against a plain search, notices against altered copies, SQL on a whole table."""

import os
import random
import re

import duckdb
import pytest

from secondlook.llm import licences, queries
from secondlook.llm.licence_texts import NOTICES, PHRASES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def base(text):
    own, found = words(text), []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        found += [(k, label) for k in range(len(own)) if own[k:k + len(parts)] == parts]
    at = [k for k, _ in found]
    return len(own), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


ODD = [(1, None), (2, ""), (3, "\x00 .,;"), (None, "MIT License"), (None, "MIT License"), (4, "mit mit license license cc by by CC-BY cc by"),
       (5, "GNU General Public License " * 400), (6, "gnu general\npublic\tlicense: the Apache/License"), (7, "İMIT license Ämit license mit license"),
       (8, "x " * 100_000 + "apache license"), (9, "mit license"), (9, "other text"), (10, "mit licens")]


def scanned(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "1 AS words", "text", "'a' AS label", "2 AS n_words", "3 AS template", "4 AS `row`")
    return licences.scan(df).collect()


def test_base_places_equal_plain_search(spark):
    rng = random.Random(4)
    pool = "gnu general public license apache cc by mit the of".split()
    rows = ODD + [(100 + k, rng.choice(["", " ", "(C) "]).join(rng.choice([w, w.upper(), w + "."]) + " " for w in rng.choices(pool, k=rng.randint(0, 60)))) for k in range(400)]
    got = scanned(spark, rows)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=repr) == sorted(((d, *base(t)) for d, t in rows), key=repr)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (r.n_base == 0) or r.score == 1


@pytest.mark.parametrize("seed", range(3))
def test_altered_notices_are_found(spark, seed):
    """Notices in a stream of other words; of the longer ones some words are missing, put in or replaced."""
    rng = random.Random(seed)
    other = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    rows, want = [], {}
    for k, (label, text) in enumerate(NOTICES):
        own = words(text)
        if len(own) >= 20:
            for _ in range(len(own) // 25 or 1):
                at = rng.randrange(len(own))
                own[at:at + 1] = rng.choice([[], [own[at], "put"], ["other"]])
        rows.append((k, " ".join(other(rng.randint(0, 300)) + own + other(rng.randint(0, 300)))))
        want[k] = label
    rows += [(1_000 + k, " ".join(other(200))) for k in range(50)]  # clean ones
    rows += [(2_000 + k, " ".join(words(text)[:len(words(text)) // 2])) for k, (_, text) in enumerate(NOTICES)]  # half of a notice isn't it
    notice_labels = {label for label, _ in NOTICES}
    for r in scanned(spark, rows):
        labels = set(filter(None, r.labels.split(",")))
        if r.doc_id < 1_000:
            assert want[r.doc_id] in labels
        elif r.doc_id < 2_000:
            assert not labels and r.score == 0
        else:
            assert not labels & notice_labels and r.score < 1 or r.n_base


def test_own_templates_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "Keep off the grass, please. Keep off the grass!")], "doc_id long, text string")
    r, = licences.scan(df, {"keep off": "kept"}, [("grass", "off the grass please keep")]).collect()
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (2, 0, 5, "kept", "grass,kept", 1.0)
    assert licences.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licences.scan(df, {"one": "x"}, [])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{os.path.join(SF, 'documents.parquet')}'")
    answer = con.execute(queries.ORACLES[name])
    names = [d[0] for d in answer.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    plain = lambda v: round(v, 12) if isinstance(v, float) else v
    assert sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr) == sorted((tuple(map(plain, x)) for x in answer.fetchall()), key=repr)
