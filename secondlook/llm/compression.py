"""Quality by compression: two dictionaries, one size difference, one calibrated score.

A Zstandard dictionary is trained from text labelled good and another from text labelled
bad. A document that the good dictionary shrinks better than the bad one resembles good text.
The difference of both sizes over their sum is calibrated by logistic regression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondlook.llm.common import map_arrow, no_text, texts_of

SAMPLE_ROWS = 3_000  # labelled rows of each class that a dictionary, and again the calibration, learns from
PIECE_BYTES = 1_000  # bytes of a sampled text that go into its dictionary; scores use whole texts
DICTIONARY_BYTES = 32_768
LEVEL = 3


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries and score = 1 / (1 + exp(-(intercept + slope * difference)))."""
    good: bytes
    bad: bytes
    intercept: float
    slope: float
    level: int = LEVEL


def _dictionary(pieces: list[bytes], size: int, level: int) -> bytes:
    """Trained; where the trainer finds the pieces too few or too short, the pieces themselves."""
    try:
        return zstandard.train_dictionary(size, pieces, level=level).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[-size:]


def _compressor(raw: bytes, level: int) -> zstandard.ZstdCompressor:
    plain = dict(level=level, write_content_size=False, write_checksum=False, write_dict_id=False)
    if len(raw) < 8:
        return zstandard.ZstdCompressor(**plain)
    book = zstandard.ZstdCompressionDict(raw)
    book.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=book, **plain)


def size_difference(df: DataFrame, model: CompressionModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and difference: (size by bad - size by good) / (their sum), whole texts; missing text is empty."""
    def sizes(batch: pa.RecordBatch) -> dict:
        good, bad = _compressor(model.good, model.level), _compressor(model.bad, model.level)
        out = np.empty(batch.num_rows)
        for i, raw in enumerate(texts_of(batch.column(1))):
            a, b = len(good.compress(raw)), len(bad.compress(raw))
            out[i] = (b - a) / (b + a)
        return {"doc_id": batch.column(0), "difference": pa.array(out)}

    return map_arrow(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), sizes,
                     "doc_id long, difference double")


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Newton's steps for one predictor and weighted rows, with a slight ridge so that separable classes stay finite."""
    scale = x.std() or 1.0
    design, beta = np.column_stack([np.ones_like(x), x / scale]), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(2),
                               design.T @ (weight * (y - p)) - 1e-3 * beta)
        beta += step
        if np.abs(step).max() < 1e-10:
            break
    return float(beta[0]), float(beta[1] / scale)


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, piece_bytes: int = PIECE_BYTES,
        dictionary_bytes: int = DICTIONARY_BYTES, level: int = LEVEL, may_learn: F.Column | None = None) -> CompressionModel:
    """Learn from ``labels`` (doc_id, quality 0 or 1) of ``documents`` (doc_id, text).

    The sample is bounded: ``sample_rows`` rows of each class by the hash of the id for the
    dictionaries, as many others for the calibration; they and the number of labels of each class
    are all that reaches the driver. Rows of the calibration weigh as many labels as they stand for, so that a score means the
    same whatever share of a class is sampled. A
    document with both labels counts as 0; missing ids and labels are left out. Without rows of both
    classes every score is the share of label 1, or 0.5 without any label.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    if may_learn is not None:
        known = known.where(may_learn)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)))
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    parts = [known.where((F.col("quality") == q) & (F.col("half") == h))
                  .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for q in (0, 1) for h in (0, 1)]
    rows = [r for part in parts for r in part.collect()]  # at most 4 * sample_rows ids
    spark = documents.sparkSession
    ids = F.broadcast(spark.createDataFrame([tuple(r) for r in rows], "doc_id long, quality int, half long"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), no_text().alias("text")).join(ids, "doc_id")

    raw = F.col("text").cast("binary")
    start = 1 + F.pmod(F.xxhash64("doc_id", "text"), F.greatest(F.lit(1), F.octet_length(raw) - piece_bytes))
    pieces = (texts.where("half = 0").select("quality", raw.substr(start.cast("int"), F.lit(piece_bytes)).alias("piece"),
                                             F.xxhash64("doc_id").alias("h"))
              .groupBy("quality", "h").agg(F.min("piece").alias("piece")).orderBy("h").collect())
    good, bad = ([bytes(r.piece) for r in pieces if r.quality == q and r.piece] for q in (1, 0))
    if not good or not bad:
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return CompressionModel(b"", b"", float(np.log(share / (1 - share))), 0.0, level)
    model = CompressionModel(_dictionary(good, dictionary_bytes, level), _dictionary(bad, dictionary_bytes, level), 0.0, 1.0, level)
    rest = texts.where("half = 1")
    told = size_difference(rest, model).groupBy("doc_id").agg(F.min("difference").alias("difference")).join(ids, "doc_id").collect()
    told = sorted((r.doc_id, r.difference, r.quality) for r in told)
    if len({q for _, _, q in told}) < 2:
        told = [(0, -0.05, 0), (1, 0.05, 1)]
    x, y = np.array([x for _, x, _ in told]), np.array([q for _, _, q in told], float)
    share = counts[1] / (counts[0] + counts[1])
    weight = len(told) * np.where(y == 1, share / y.sum(), (1 - share) / (len(told) - y.sum()))
    b0, b1 = _logistic(x, y, weight)
    return CompressionModel(model.good, model.bad, b0, b1, level)


def score(df: DataFrame, model: CompressionModel, cut: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, difference, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= cut).

    One row per input row, also for repeated rows, a missing id and a missing or empty text (difference 0).
    Other columns are ignored, whatever their names.
    """
    value = 1 / (1 + F.exp(-(F.lit(model.intercept) + F.lit(model.slope) * F.col("difference"))))
    return (size_difference(df, model, doc_id, text).withColumn("score", value)
            .withColumn("predicted", (F.col("score") >= cut).cast("int")))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 4, is 2: rows that no fit may read."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def filter_documents(df: DataFrame, model: CompressionModel, cut: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``df``, all their columns unchanged, whose text scores ``cut`` or more."""
    names = df.columns

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        good, bad = _compressor(model.good, model.level), _compressor(model.bad, model.level)
        raws = texts_of(batch.column(names.index(text)))
        a = np.array([len(good.compress(r)) for r in raws], float)
        b = np.array([len(bad.compress(r)) for r in raws], float)
        chance = 1 / (1 + np.exp(-(model.intercept + model.slope * (b - a) / (b + a))))
        return batch.filter(pa.array(chance >= cut))

    return map_arrow(df, keep, df.schema)
