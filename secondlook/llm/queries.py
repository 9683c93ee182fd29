"""The queries op1 to op10: each operator over its whole table, reduced to digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secondlook.llm import bpe, compression, decontaminate, fertility, fim, fuzzylines, htmltext, jaccard, kdtree, licences, merkle, records, substring
from secondlook.llm.common import table
from secondlook.llm.licence_texts import NOTICES, PHRASES
from secondlook.session import stage_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query
def op5_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = stage_path(spark, "token-records")
    records.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return records.read(spark, folder, ids_crc32=F.crc32("ids"))


@query
def op8_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = compression.fit(documents, labels, may_learn=~compression.held_out())
    return (compression.score(documents, model, 0.7)
            .select("doc_id", compression.held_out().alias("held_out"), "score", "predicted"))


@query
def op4_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (fertility.judge(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                            public_tokenizers.path("piece_bpe_32k.model"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                    *fertility.MEASURES))


@query
def op9_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.shard(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_html_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query
def op3_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op7_divideskip_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), words=3, percent=90)


@query
def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzylines.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = merkle.leaf_digest(*map(F.col, fields))
    emptied = merkle.leaf_digest(*map(F.col, fields[:-1]), F.replace("text", F.lit("\n"), F.lit("")))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    manifest = merkle.build(table(spark, sf_dir, "documents"), leaf, F.when(tampered, emptied).otherwise(leaf))
    return merkle.verified(manifest.proofs()).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.translate("path", "|,", "").cast("binary"), 256).alias("proof_sha256"),
        "folded_root", "verified")


# crc32 bit by bit over the decimal id; levels of both trees by recursion; siblings folded by list_reduce
ORACLES["op11_merkle_manifest"] = """
WITH RECURSIVE
bits AS (
  SELECT doc_id, list_transform(range(8 * strlen(doc_id::VARCHAR)),
    lambda k: ((ascii(substr(doc_id::VARCHAR, k // 8 + 1, 1)) >> (k % 8)::INT) & 1)::BIGINT) AS bit FROM documents),
crc AS (
  SELECT DISTINCT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, bit),
    lambda c, b: xor(c >> 1, CASE WHEN xor(c & 1, b) = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT) AS crc FROM bits),
fields AS (
  SELECT d.doc_id, d.source, crc.crc % 2 = 0 AS tampered, replace(d.text, chr(10), '') AS cut, d.text,
    coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-') || coalesce(strlen(d.source) || ':' || d.source, '-')
    || coalesce(strlen(d.lang) || ':' || d.lang, '-') || coalesce(strlen(d.n_chars::VARCHAR) || ':' || d.n_chars, '-') AS head
  FROM documents d LEFT JOIN crc ON d.doc_id IS NOT DISTINCT FROM crc.doc_id),
digests AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS claim
  FROM fields),
rows AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM digests),
tree AS (
  SELECT source, 0 AS level, place, n, leaf AS h FROM rows
  UNION ALL
  SELECT source, max(level) + 1, place // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY place)) FROM tree WHERE n > 1 GROUP BY source, place // 3),
subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, place, n, subroot AS h FROM subroots
  UNION ALL
  SELECT max(level) + 1, place // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY place)) FROM top WHERE n > 1 GROUP BY place // 3),
root AS (SELECT h AS root FROM top WHERE n = 1),
own_steps AS (
  SELECT a.source, a.level, a.place, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before,
    coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
  FROM tree a JOIN tree b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.place // 3 = b.place // 3
  WHERE a.n > 1 GROUP BY ALL),
top_steps AS (
  SELECT a.level, a.place, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before,
    coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
  FROM top a JOIN top b ON a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.n > 1 GROUP BY ALL),
steps AS (
  SELECT r.source, r.place, s.level, s.before, s.after FROM rows r
  JOIN own_steps s ON r.source IS NOT DISTINCT FROM s.source AND s.place = r.place // (3 ** s.level)::BIGINT
  UNION ALL
  SELECT r.source, r.place, 1000 + s.level, s.before, s.after FROM rows r JOIN subroots t ON r.source IS NOT DISTINCT FROM t.source
  JOIN top_steps s ON s.place = t.place // (3 ** s.level)::BIGINT),
paths AS (
  SELECT source, place, list(before || '|' || after ORDER BY level) AS path, string_agg(before || after, '' ORDER BY level) AS siblings
  FROM steps GROUP BY ALL),
folded AS (
  SELECT r.doc_id, r.leaf, t.subroot, root.root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
    list_reduce(list_prepend(r.claim, coalesce(p.path, [])), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root
  FROM rows r JOIN subroots t ON r.source IS NOT DISTINCT FROM t.source CROSS JOIN root
  LEFT JOIN paths p ON r.source IS NOT DISTINCT FROM p.source AND r.place = p.place)
SELECT *, folded_root = root AS verified FROM folded
"""


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    key = F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return fim.restore(fim.transform(documents, fim.draws(key))).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha("text").alias("output_sha256"), sha("restored").alias("restored_sha256"),
        "prefix_bytes", "middle_bytes")


ORACLES["op13_fill_in_middle"] = """
WITH keyed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
drawn AS (
  SELECT doc_id, text, length(text) AS n, ('0x' || substr(hex, 1, 8))::BIGINT AS h1, ('0x' || substr(hex, 9, 8))::BIGINT AS h2,
    ('0x' || substr(hex, 17, 8))::BIGINT AS h3, ('0x' || substr(hex, 25, 8))::BIGINT AS h4 FROM keyed),
cut AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256,
  CASE WHEN form <> 'plain' THEN strlen(prefix) END AS prefix_bytes, CASE WHEN form <> 'plain' THEN strlen(middle) END AS middle_bytes
FROM parts
"""


@query
def op12_licence_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_TEMPLATES = ", ".join(f"({_quoted(label)}, {_quoted(text)}, {base})" for label, text, base in
                       [*((label, phrase, True) for phrase, label in PHRASES.items()), *((label, text, False) for label, text in NOTICES)])
_WORDS = r"""regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

# the same votes over the words themselves
ORACLES["op12_licence_diagonals"] = f"""
WITH templates AS (
  SELECT row_number() OVER () AS template, label, base, {_WORDS.format('notice')} AS words FROM (VALUES {_TEMPLATES}) AS t(label, notice, base)),
sized AS (SELECT *, len(words) AS len, CASE WHEN len(words) > {licences.LONG} THEN {licences.LONG} ELSE {licences.SHORT} END AS size FROM templates),
template_grams AS (
  SELECT template, size, place, array_to_string(words[place + 1:place + size], ' ') AS gram
  FROM (SELECT *, unnest(range(len - size + 1)) AS place FROM sized)),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
places AS (SELECT rid, words, unnest(range(len(words))) AS word FROM docs),
document_grams AS (
  SELECT rid, word, size, array_to_string(words[word + 1:word + size], ' ') AS gram
  FROM places, (VALUES ({licences.SHORT}), ({licences.LONG})) AS s(size) WHERE word + size <= len(words)),
votes AS (
  SELECT rid, template, word - place AS diagonal, list(place) AS hits FROM document_grams JOIN template_grams USING (gram, size) GROUP BY ALL),
steps AS (
  SELECT v.*, t.label, t.base, t.len, t.size,
    (diagonal - lag(diagonal) OVER beside <= CASE WHEN t.base THEN 0 ELSE least({licences.DRIFT}, t.len // 4) END) IS NOT TRUE AS apart
  FROM votes v JOIN sized t USING (template) WINDOW beside AS (PARTITION BY rid, template ORDER BY diagonal)),
joined AS (SELECT *, sum(apart::INT) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span FROM steps),
merged AS (
  SELECT rid, template, label, base, len, span, count(DISTINCT p + k) AS covers, count(DISTINCT p + k + diagonal) AS words,
    min(p + diagonal) AS first, max(p + diagonal + size - 1) AS last
  FROM (SELECT *, unnest(hits) AS p FROM joined), (SELECT unnest(range({licences.LONG})) AS k) WHERE k < size GROUP BY ALL),
judged AS (
  SELECT *, least(covers, words) / len AS share,
    CASE WHEN base THEN least(covers, words) >= len
      ELSE least(covers, words) / len >= {licences.LEAST_SHARE} AND last - first + 1 <= len * {licences.SLACK} END AS found FROM merged)
SELECT d.doc_id, len(d.words) AS n_words, count(*) FILTER (j.base AND j.found) AS n_base,
  min(j.first) FILTER (j.base AND j.found) AS first_word, max(j.first) FILTER (j.base AND j.found) AS last_word,
  coalesce(string_agg(DISTINCT j.label, ',' ORDER BY j.label) FILTER (j.base AND j.found), '') AS base_labels,
  coalesce(string_agg(DISTINCT j.label, ',' ORDER BY j.label) FILTER (j.found), '') AS labels, least(1.0::DOUBLE, coalesce(max(j.share), 0.0)) AS score
FROM docs d LEFT JOIN judged j USING (rid) GROUP BY d.rid, d.doc_id, d.words
"""


# every window of 13 words by itself; a word goes if one around it starts in a document with a smaller id
ORACLES["op6_suffix_automata"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT rid, id, k, array_to_string(words[k:k + 12], ' ') AS own FROM (SELECT *, unnest(range(1, len(words) - 11)) AS k FROM docs)),
firsts AS (SELECT own, min(id) AS first FROM windows GROUP BY own),
gone AS (
  SELECT DISTINCT rid, k + j AS place FROM windows JOIN firsts USING (own), (SELECT unnest(range(13)) AS j) WHERE first < id),
places AS (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM docs),
kept AS (
  SELECT p.rid, count(g.place) AS n_removed, coalesce(string_agg(p.word, ' ' ORDER BY p.place) FILTER (g.place IS NULL), '') AS kept
  FROM places p LEFT JOIN gone g ON p.rid = g.rid AND p.place = g.place GROUP BY p.rid)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""

# overlaps of all pairs with a common shingle, then everything within reach
ORACLES["op7_divideskip_jaccard"] = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
shingles AS (
  SELECT DISTINCT rid, array_to_string(words[k:k + 2], ' ') AS own
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS k FROM docs WHERE len(words) > 0)),
sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
common AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.own = b.own AND a.rid < b.rid GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes a ON a.rid = x JOIN sizes b ON b.rid = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
mutual AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT x, y FROM mutual UNION SELECT r.x, b.y FROM reach r JOIN mutual b ON r.y = b.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, min(o.doc_id)) AS component_id
FROM docs d LEFT JOIN sizes s ON s.rid = d.rid LEFT JOIN reach r ON r.x = d.rid LEFT JOIN docs o ON o.rid = r.y
GROUP BY d.rid, d.doc_id, s.n
"""
