"""Fill-in-the-middle: a text cut in three, its parts in another order behind marks.

Cuts are drawn in code points, texts are UTF-8 bytes. For a whole batch, read as one run of bytes, only its multibyte
characters are recorded: their positions and the excess bytes up to them. A cut moves from code points to bytes, or back, by
adding the excess found with ``searchsorted``; between two such characters both numberings run in step, so ASCII costs nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from secondlook.llm.common import binary_array, map_arrow

MARKS = ("<P>", "<S>", "<M>")  # fixed values: before prefix, suffix and middle
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20  # fixed values: hundredths of the third and fourth draw
ADDED = ("n", "form", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes")


@dataclass
class Exceptions:
    """The multibyte characters of some UTF-8 text."""

    points: np.ndarray  # their code point positions
    bytes: np.ndarray  # their byte positions
    excess: np.ndarray  # bytes beyond one per character before each of them, and in all

    @classmethod
    def of(cls, raw: np.ndarray) -> "Exceptions":
        where = np.flatnonzero(raw >= 0xC0)  # lead bytes; those that follow lie below
        lead = raw[where]
        more = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        excess = np.concatenate([[0], np.cumsum(more)])
        return cls(where - excess[:-1], where, excess)

    def to_bytes(self, points: np.ndarray) -> np.ndarray:
        return points + self.excess[np.searchsorted(self.points, points)]

    def to_points(self, places: np.ndarray) -> np.ndarray:
        """Of byte positions at which a character begins or the text ends."""
        return places - self.excess[np.searchsorted(self.bytes, places)]


def run_of_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts in a row, and where each begins, then the end; a missing text is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, ends, raw = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return raw[ends[0]:ends[-1]], ends - ends[0]


def cuts_of(column: pa.Array, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of each text, the code points before its two cuts (2 x texts), the bytes before them, and the texts' starts.

    Draws are numbers from 0 up; modulo the places of a text, its length included, they are cuts.
    """
    raw, starts = run_of_bytes(column)
    index = Exceptions.of(raw)
    points = index.to_points(starts)
    n = np.diff(points)
    cut = np.sort(np.stack([one % (n + 1), other % (n + 1)]), axis=0)
    return n, cut, index.to_bytes(points[:-1] + cut) - starts[:-1], starts


def _check(marks: tuple[str, str, str]) -> list[bytes]:
    packed = [m.encode() for m in marks]
    if any(not m for m in packed) or any(a[k:] == b[:len(a) - k] for a in packed for b in packed for k in range(1, len(a))):
        raise ValueError(f"marks must not be empty or overlap: {marks}")
    return packed


def draws(key: Column, count: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers: the 8-digit groups of the hex sha256 of ``key``."""
    digits = F.sha2(key.cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(count)]


def transform(df: DataFrame, drawn: list[Column], plain_from: int = PLAIN_FROM, suffix_first_below: int = SUFFIX_FIRST_BELOW,
              marks: tuple[str, str, str] = MARKS, text: str = "text") -> DataFrame:
    """All rows and columns of ``df`` with ``text`` rearranged, and n, form, prefix_chars, middle_chars, prefix_bytes and
    middle_bytes (columns of these names are replaced).

    ``drawn`` are four numbers from 0 up: two cuts (modulo n + 1), then two whose hundredths choose the form: plain from
    ``plain_from`` on, else spm below ``suffix_first_below``, else psm. psm is prefix, suffix, middle behind their marks, spm has
    the suffix first. A text that is empty, or holds a mark, is plain and stays as it is, with no cuts (null). A missing text is
    an empty one and comes back empty; a missing draw counts as 0. Rows are judged alone: repeated ones give equal results.
    """
    p, s, m = _check(marks)
    kept = [c for c in df.columns if c not in ADDED]
    inputs = df.select(*kept, *[F.coalesce(d, F.lit(0)).cast("long").alias(f"__draw{k}") for k, d in enumerate(drawn)])

    def run(batch: pa.RecordBatch) -> dict:
        one, other, third, fourth = (batch.column(f"__draw{k}").to_numpy() for k in range(4))
        column = batch.column(text)
        n, points, places, starts = cuts_of(column, one, other)
        raw = run_of_bytes(column)[0].tobytes()
        bounds, first, second = starts.tolist(), places[0].tolist(), places[1].tolist()
        plain, suffix_first = (third % 100 >= plain_from) | (n == 0), fourth % 100 < suffix_first_below
        out, forms = [], []
        for k, (is_plain, is_spm) in enumerate(zip(plain.tolist(), suffix_first.tolist())):
            own = raw[bounds[k]:bounds[k + 1]]
            if is_plain or p in own or s in own or m in own:
                out.append(own)
                forms.append("plain")
                continue
            prefix, middle, suffix = own[:first[k]], own[first[k]:second[k]], own[second[k]:]
            out.append(b"".join([s, suffix, p, prefix, m, middle] if is_spm else [p, prefix, s, suffix, m, middle]))
            forms.append("spm" if is_spm else "psm")
        none = np.array([f == "plain" for f in forms])
        made = {c: batch.column(c) for c in kept} | {text: binary_array(out).cast(pa.string()), "n": pa.array(n, pa.int64()), "form": pa.array(forms)}
        for name, value in zip(ADDED[2:], (points[0], points[1] - points[0], places[0], places[1] - places[0])):
            made[name] = pa.array(value, pa.int64(), mask=none)
        return made

    schema = StructType([*df.select(*kept).schema.fields]).add("n", "long").add("form", "string")
    for c in ADDED[2:]:
        schema = schema.add(c, "long")
    return map_arrow(inputs, run, schema)


def restore(df: DataFrame, marks: tuple[str, str, str] = MARKS, output: str = "text", form: str = "form", into: str = "restored") -> DataFrame:
    """All rows and columns of ``df`` and, in ``into``, the text that ``output`` was made of.

    A missing output gives a missing text; a form other than psm and spm leaves the output as it is.
    """
    p, s, m = _check(marks)
    kept = [c for c in df.columns if c != into]

    def original(raw: bytes | None, kind: str | None) -> bytes | None:
        if raw is None or kind not in ("psm", "spm"):
            return raw
        one, two = (p, s) if kind == "psm" else (s, p)  # neither part holds a mark, so the first one found ends it
        head, tail = raw[len(one):].split(two, 1)
        tail, middle = tail.split(m, 1)
        return head + middle + tail if kind == "psm" else tail + middle + head

    def run(batch: pa.RecordBatch) -> dict:
        raw = batch.column(output).cast(pa.binary()).to_pylist()
        texts = [original(x, kind) for x, kind in zip(raw, batch.column(form).to_pylist())]
        return {c: batch.column(c) for c in kept} | {into: binary_array(texts).cast(pa.string())}

    return map_arrow(df.select(*kept), run, StructType([*df.select(*kept).schema.fields]).add(into, "string"))
