"""Licence scan by diagonal voting.

Every document gives the hashes of all its runs of two and of four words; they are joined in Spark with those of the template
texts. A hit at document word d and template word t votes for the diagonal d - t, the place at which the template would begin.
Hits count only if the words themselves are equal. Diagonals that lie close together, as words put in or left out shift the
rest of a text, are merged to one span, and a span is verified by the share of the template's words that its hits cover.

A document's words stay on the task that read them; only hits are shuffled, by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from secondlook.llm.common import small_batches, texts_of, unsigned_hash, word_hashes
from secondlook.llm.licence_texts import NOTICES, PHRASES

SHORT, LONG = 2, 4  # words of a gram: LONG for templates of more than LONG words
DRIFT = 8  # diagonals at most so far apart are merged, a quarter of the template's words at most
LEAST_SHARE = 0.7  # of a template's words
SLACK = 1.5  # words of a span for each word of the template, at most
SLICE_BYTES = 1 << 20  # text whose words are held at a time
SMALL = 1_000_000  # grams of templates: as many are broadcast, more are joined by a shuffle
NO_TEMPLATE = -1  # the one row that every document gets, hits or not
LOWER = bytes(c + 0x20 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words: A-Z lower-cased, runs of other characters than ASCII signs, blanks and controls."""
    return text.translate(LOWER).split()


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, from the words' hashes; 0 where a run would pass the end."""
    out = np.zeros(words.size, np.uint64)
    if words.size >= size:
        runs = words[:words.size - size + 1].copy()
        for k in range(1, size):
            runs = unsigned_hash(runs, k) + words[k:words.size - size + 1 + k]
        out[:runs.size] = unsigned_hash(runs, size) | np.uint64(1)
    return out


def template_grams(spark, phrases: dict[str, str], notices: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(gram, size, template, place, words) of all templates, and (template, label, size, len, base)."""
    grams, about = [], []
    for label, text, base in [*((label, p, True) for p, label in phrases.items()), *((label, t, False) for label, t in notices)]:
        words = words_of(text.encode())
        if len(words) < SHORT:
            raise ValueError(f"a template needs {SHORT} words or more: {text!r}")
        size = LONG if len(words) > LONG else SHORT
        hashes = gram_hashes(word_hashes().of(words), size)[:len(words) - size + 1].view(np.int64).tolist()
        for k, h in enumerate(hashes):
            grams.append((h, size, len(about), k, b" ".join(words[k:k + size]).decode()))
        about.append((len(about), label, size, len(words), base))
    grams.append((0, 0, NO_TEMPLATE, 0, ""))
    return (spark.createDataFrame(grams, "gram long, size int, template int, place int, gram_words string"),
            spark.createDataFrame(about, "template int, label string, size int, len int, base boolean"))


def document_grams(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row, doc_id, n_words, words and grams: at 2 * k the hash of two words from word k on, at 2 * k + 1 of four, and a last 0
    that meets the template table's own 0, so that no document is lost."""
    small_batches(df.sparkSession)

    def some(ids: pa.Array, rows: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        words = [words_of(t) for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        flat = [w for own in words for w in own]
        hashes = word_hashes().of(flat)
        ends = np.concatenate([[0], np.cumsum(counts)])
        grams = np.zeros(2 * hashes.size + counts.size, np.uint64)
        first = 2 * ends[:-1] + np.arange(counts.size)
        for k, size in enumerate((SHORT, LONG)):
            own = gram_hashes(hashes, size)
            left = np.repeat(ends[1:], counts) - np.arange(hashes.size)  # words up to the end of the document
            own[left < size] = 1  # even hashes and 1 belong to no gram
            grams[2 * np.arange(hashes.size) + np.repeat(np.arange(counts.size), counts) + k] = np.maximum(own, np.uint64(1))
        grams[first + 2 * counts] = 0
        lengths = np.fromiter(map(len, flat), np.int64, len(flat))
        spelt = pa.StringArray.from_buffers(len(flat), pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.py_buffer(b"".join(flat)))
        return pa.RecordBatch.from_pydict({
            "row": rows, "doc_id": ids, "n_words": pa.array(counts),
            "words": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spelt),
            "grams": pa.ListArray.from_arrays(pa.array(np.append(first, grams.size), pa.int32()), pa.array(grams.view(np.int64)))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(2))
            ends = np.cumsum([len(t) for t in texts])
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
                yield some(batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), texts[at:to])
                at = to

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, n_words long, words array<string>, grams array<long>")


def spans(df: DataFrame, phrases: dict[str, str] | None = None, notices: list[tuple[str, str]] | None = None,
          doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every span: row, doc_id, n_words, template, label, base, first and last (its words, from 0), share (of the template's words
    that verified hits cover) and found (whether that is enough). One more row per document has no template.

    A phrase's span is found where all its words stand in order; a notice's from ``LEAST_SHARE`` on and if the span is not much
    longer than the notice. Documents without text or words have their row without template; rows with equal ids are apart.
    """
    spark = df.sparkSession
    grams, about = template_grams(spark, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    if grams.count() <= SMALL:
        grams, about = F.broadcast(grams), F.broadcast(about)
    own = document_grams(df, doc_id, text).select("row", "doc_id", "n_words", "words", F.posexplode("grams").alias("at", "gram"))
    place = F.shiftright("at", 1)
    equal = F.array_join(F.slice("words", place + 1, F.col("size")), " ") == F.col("gram_words")
    hits = (own.join(grams, "gram").where((F.col("template") == NO_TEMPLATE) | equal)
            .select("row", "doc_id", "n_words", "template", F.when(F.col("template") == NO_TEMPLATE, 0).otherwise(F.col("place")).alias("place"),
                    F.when(F.col("template") == NO_TEMPLATE, 0).otherwise(place - F.col("place")).alias("diagonal")))
    # one shuffle by document serves all that follows
    votes = hits.repartition("row").groupBy("row", "doc_id", "n_words", "template", "diagonal").agg(F.collect_list("place").alias("places"))
    votes = votes.join(about, "template", "left")
    beside = Window.partitionBy("row", "template").orderBy("diagonal")
    drift = F.when(F.col("base"), 0).otherwise(F.least(F.lit(DRIFT), F.floor(F.col("len") / 4).cast("int")))
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(beside) > drift, F.lit(True))
    votes = votes.withColumn("span", F.sum(apart.cast("int")).over(beside.rowsBetween(Window.unboundedPreceding, 0)))
    covered = lambda c: F.flatten(F.transform(c, lambda p: F.sequence(p, p + F.col("size") - 1)))
    votes = votes.withColumns({
        "covers": F.when(F.col("template") != NO_TEMPLATE, covered("places")),
        "words": F.when(F.col("template") != NO_TEMPLATE, covered(F.transform("places", lambda p: p + F.col("diagonal"))))})
    merged = votes.groupBy("row", "doc_id", "n_words", "template", "label", "base", "len", "span").agg(
        F.array_distinct(F.flatten(F.collect_list("covers"))).alias("covers"),
        F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    share = F.least(F.size("covers"), F.size("words")) / F.col("len")
    first, last = F.array_min("words"), F.array_max("words")
    fits = last - first + 1 <= F.col("len") * SLACK
    return merged.select(
        "row", "doc_id", "n_words", "template", "label", "base", first.alias("first"), last.alias("last"), share.alias("share"),
        F.coalesce(F.when(F.col("base"), share >= 1).otherwise((share >= LEAST_SHARE) & fits), F.lit(False)).alias("found"))


def scan(df: DataFrame, phrases: dict[str, str] | None = None, notices: list[tuple[str, str]] | None = None,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_base (places of phrases), first_word and last_word (where the first and the last of
    them begin, from 0; null without any), base_labels and labels (distinct, sorted, parted by commas, empty without any; labels
    include the base ones) and score (the largest share of a template that a span covers, 0 to 1).

    A missing text is empty; a missing id stays; repeated rows are rows of their own; other columns are ignored.
    """
    found = spans(df, phrases, notices, doc_id, text)
    base = F.col("base") & F.col("found")
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return found.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"), joined(base).alias("base_labels"),
        joined(F.col("found")).alias("labels"), F.least(F.lit(1.0), F.coalesce(F.max("share"), F.lit(0.0))).alias("score")).drop("row")
