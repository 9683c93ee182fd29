"""Quality rules on words, and on how public vocabularies cut them.

Plain rules: few words, repeated three-word windows, symbols, repeated lines. Fertility rules: with a
byte-level vocabulary and one with byte fallback, a text's characters per token, share of fallback
tokens and token entropy are measured. Text of a language is cut alike; what lies outside the
band of its language and script is rejected. A band is the middle half of the group, widened on either
side by ``reach`` times its breadth, over all texts that pass the plain rules.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondlook.llm.bpe import Pieces, read_ranks
from secondlook.llm.common import map_arrow, stage, texts_of, worker_memory
from secondlook.operators.joins import lookup_join

MIN_WORDS, MAX_REPEATED = 50, 50  # words; per cent of words in repeated three-word windows
SYMBOLS = "#*$%&|<>"  # fixed value
REACH = 2.0
PARENT_TEXTS = 100  # texts that the band of the script, or of all texts, counts for beside a group's own
KEPT_WORDS = 300_000  # words a worker remembers
MEASURES = ["chars_per_token", "piece_chars_per_token", "fallback_share", "entropy"]
ENDS = [f"{m}_{e}" for m in MEASURES for e in ("low", "high")]
SCRIPTS = ["LATIN", "GREEK", "CYRILLIC", "ARABIC", "HEBREW", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "THAI", "DEVANAGARI"]
SCHEMA = ("row long, doc_id long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, chars_per_token double, piece_chars_per_token double, fallback_share double, entropy double")


class Lexicon(dict):
    """word -> number, and by number: characters, tokens of both vocabularies, fallback tokens, script."""

    def __init__(self, ranks: bytes, model: bytes):
        super().__init__()
        self.bytes_bpe = Pieces(ranks)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.chars = self.script = self.n_pieces = self.n_fallback = self.n_ids = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)

    def learn(self, words: list[bytes]) -> None:
        """Number new words and measure them, all at once."""
        if not words:
            return
        texts = [w.decode() for w in words]
        base = len(self)
        self.update(zip(words, range(base, base + len(words))))
        packed = self.bytes_bpe.learn([" " + t for t in texts])
        cut = self.pieces.encode(texts, num_threads=1)
        counts = np.array([len(c) for c in cut])
        flat = self.fallback[np.fromiter((i for c in cut for i in c), np.int64, counts.sum())]
        owner = np.repeat(np.arange(len(words)), counts)
        add = lambda old, new: np.concatenate([old, np.asarray(new, np.int64)])
        self.chars = add(self.chars, [len(t) for t in texts])
        self.script = add(self.script, [script_of(t) for t in texts])
        self.n_pieces = add(self.n_pieces, counts)
        self.n_fallback = add(self.n_fallback, np.bincount(owner, flat, len(words)))
        self.n_ids = add(self.n_ids, [len(p) // 4 for p in packed])
        self.ids = add(self.ids, np.frombuffer(b"".join(packed), "<u4"))
        self.first_id = np.cumsum(self.n_ids) - self.n_ids


def script_of(word: str) -> int:
    """The script of a word's first letter as a place in SCRIPTS; -1 without one."""
    for c in word:
        if c.isalpha():
            if c < "ɐ":
                return 0
            name = unicodedata.name(c, "").split(" ")[0].split("-")[0]
            return SCRIPTS.index(name) if name in SCRIPTS else len(SCRIPTS)
    return -1


def _ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each run, one run after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if ends.size else 0)


def repeated_words(numbers: np.ndarray) -> int:
    """Words in three-word windows that the text has twice or more, the first included."""
    if numbers.size < 4:
        return 0
    own = np.unique(numbers, return_inverse=True)[1].astype(np.int64)
    k = int(own.max()) + 1
    if k < 1 << 20:
        window = (own[:-2] * k + own[1:-1]) * k + own[2:]
    else:  # three numbers of a very long text don't fit 63 bits: number the pairs first
        pair = np.unique(own[:-2] * k + own[1:-1], return_inverse=True)[1].astype(np.int64)
        window = pair * k + own[2:]
    _, where, times = np.unique(window, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(times[where] > 1)
    covered = np.zeros(numbers.size, bool)
    for shift in (0, 1, 2):
        covered[hit + shift] = True
    return int(covered.sum())


def _measure(lexicon: Lexicon, raw: bytes, words: list[bytes]) -> tuple:
    numbers = np.fromiter(map(lexicon.__getitem__, words), np.int64, len(words))
    lines = [line for line in raw.split(b"\n") if line.split()]
    chars = int(lexicon.chars[numbers].sum())
    count = lexicon.n_ids[numbers]
    tokens, pieces = int(count.sum()), int(lexicon.n_pieces[numbers].sum())
    entropy = script = None
    if tokens:
        share = np.unique(lexicon.ids[_ragged(lexicon.first_id[numbers], count)], return_counts=True)[1] / tokens
        entropy = float(-(share * np.log2(share)).sum()) / np.log2(max(tokens, 2))
        scripts = lexicon.script[numbers]
        scripts = np.bincount(scripts[scripts >= 0], minlength=1)
        script = [*SCRIPTS, "OTHER"][int(scripts.argmax())] if scripts.sum() else None
    return (script, len(words), chars, sum(raw.count(s.encode()) for s in SYMBOLS), len(lines) - len(set(lines)),
            repeated_words(numbers), chars / tokens if tokens else None, chars / pieces if pieces else None,
            float(lexicon.n_fallback[numbers].sum()) / pieces if pieces else None, entropy)


def measure(df: DataFrame, rank_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """One row of counts and measures per row of ``df``; a missing or empty text has no words, and its measures are missing.

    Entropy is that of the text's byte-level tokens over its largest possible value. Words are cut one by one.
    """
    sc = df.sparkSession.sparkContext
    with open(piece_path, "rb") as file:
        files = sc.broadcast((read_ranks(rank_path), file.read()))  # two vocabulary files, below 2 MB
    language = F.col(lang).cast("string") if lang and lang in df.columns else F.lit(None).cast("string")
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), language.alias("lang"), F.col(text).alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        lexicon = worker_memory(f"lexicon-{hash(files.value)}", lambda: Lexicon(*files.value))
        out: list[tuple] = []
        raws, at = texts_of(batch.column(3)), 0
        while at < len(raws):  # about a megabyte of text at a time
            size, group = 0, []
            while at < len(raws) and (not group or size + len(raws[at]) <= 1 << 20):
                size += len(raws[at])
                group.append((raws[at], raws[at].split()))
                at += 1
            if len(lexicon) > KEPT_WORDS:
                lexicon.reset()
            lexicon.learn([w for w in set().union(*(words for _, words in group)) if w not in lexicon])
            out += [_measure(lexicon, raw, words) for raw, words in group]
        columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.string(), *[pa.int64()] * 5, *[pa.float64()] * 4])]
        return dict(zip([f.split(" ")[0] for f in SCHEMA.split(", ")], [*batch.columns[:3], *columns]))

    return map_arrow(rows, run, SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def bands(measured: DataFrame, reach: float = REACH, parent_texts: int = PARENT_TEXTS) -> tuple[DataFrame, DataFrame, list]:
    """Bands by language and script (lang, script, band), by script (script, band), and of all texts (numbers in the order of ENDS).

    Quantiles come from Spark's mergeable sketches: one small row per group and task is shuffled. A group's ends are blended by count with
    those of its script, and a script's with those of all texts: a rare language lies close to its script's band, a frequent one
    has its own, and no number of texts switches from one to the other. What sketches give may differ in the last digits
    with the tasks that made them.
    """
    def ends(m: str) -> list[Column]:
        q = F.percentile_approx(m, [0.25, 0.75], 10_000)
        breadth = F.greatest(q[1] - q[0], 0.02 * F.abs(q[1]), F.lit(0.002))
        return [(q[0] - reach * breadth).alias(f"{m}_low"), (q[1] + reach * breadth).alias(f"{m}_high")]

    def blend(own: str, above: Column) -> Column:
        return (F.col("n") * F.col(own) + parent_texts * above) / (F.col("n") + parent_texts)

    good = measured.where(~base_failed())
    group = good.groupingSets([["lang", "script"], ["script"], []], "lang", "script")
    found = stage(group.agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), *[e for m in MEASURES for e in ends(m)]), "bands")
    whole = found.where("gid = 3 AND n > 0").first()
    every = [whole[e] if whole else None for e in ENDS]
    by_script = found.where("gid = 2").select("script", F.array(*[blend(e, F.lit(v).cast("double")) for e, v in zip(ENDS, every)]).alias("band_1"))
    above = by_script.select(F.col("script").alias("s"), "band_1")
    by_both = (found.where("gid = 0").join(above, F.col("script").eqNullSafe(F.col("s")))
               .select("lang", "script", F.array(*[blend(e, F.col("band_1")[k]) for k, e in enumerate(ENDS)]).alias("band_2")))
    return by_both, by_script, every


def judge(df: DataFrame, rank_path: str, piece_path: str, reach: float = REACH, **columns: str) -> DataFrame:
    """The counts and measures of ``measure`` with base_failed and kept, a row per row of ``df``.

    kept is false if a plain rule fails or any measure lies outside the band of the text's language
    and script. Repeated rows are judged alike; a missing language is a group of its own.
    """
    measured = stage(measure(df, rank_path, piece_path, **columns), "fertility")  # read twice: for bands and verdicts
    by_both, by_script, every = bands(measured, reach)
    joined = lookup_join(measured, by_both, {"lang": "lang", "script": "script"})
    joined = lookup_join(joined, by_script, {"script": "script"})
    band = F.coalesce("band_2", "band_1", F.array(*[F.lit(v).cast("double") for v in every]))
    inside = F.lit(True)
    for k, m in enumerate(MEASURES):
        inside = inside & F.coalesce(F.col(m).between(band[2 * k], band[2 * k + 1]), F.lit(True))
    return joined.select("doc_id", "lang", "script", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *MEASURES,
                         base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"))
