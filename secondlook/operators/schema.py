"""Column-name and projection operators (SURVEY SCH-*, PRJ-*). Driver metadata only."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame


def safe_names(names: Iterable[str]) -> list[str]:
    """Names usable without quoting: other characters become ``_`` and a name
    that does not start with a letter gets an ``X``. A dot would need backticks
    in every later reference, so it is replaced too (SCH-1)."""
    out = []
    for name in names:
        clean = re.sub(r"\W", "_", name.strip())
        out.append(clean if clean[:1].isalpha() else "X" + clean)
    repeated = [n for n, times in Counter(n.lower() for n in out).items() if times > 1]
    if repeated:
        raise ValueError(f"column names collide after cleaning: {sorted(repeated)}")
    return out


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*safe_names(df.columns))


def rename(df: DataFrame, **new_from_old: str) -> DataFrame:
    """``rename(df, SubType="LoanType")``; an unknown old name raises (SCH-2)."""
    missing = [old for old in new_from_old.values() if old not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.withColumnsRenamed({old: new for new, old in new_from_old.items()})


def common_columns(first: DataFrame, *others: DataFrame) -> list[str]:
    """Names present in every table, in the order of the first (SCH-4, SET-6)."""
    return [c for c in first.columns if all(c in o.columns for o in others)]


def unmatched_count(names: Iterable[str], others: Iterable[str]) -> int:
    """How many names of one list are absent from the other (AGG-9)."""
    pool = set(others)
    return sum(n not in pool for n in names)


def project(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly these columns; absent ones are named in the error (SCH-5, PRJ-1)."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*names)


def drop_names(df: DataFrame, *names: str) -> DataFrame:
    """Drop by name; a repeated name is harmless, an unknown one raises (PRJ-2)."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.drop(*names)


def drop_positions(df: DataFrame, *ranges: tuple[int, int],
                   expect: list[str] | None = None) -> DataFrame:
    """Drop columns by 1-based inclusive position ranges (PRJ-3).

    Positions go stale when the layout changes, so the names they are meant to
    hit can be given in ``expect`` and are checked.
    """
    hit = {i for low, high in ranges for i in range(low, high + 1)}
    if hit and max(hit) > len(df.columns):
        raise ValueError(f"position {max(hit)} is beyond {len(df.columns)} columns")
    dropped = [c for i, c in enumerate(df.columns, 1) if i in hit]
    if expect is not None and dropped != expect:
        raise ValueError(f"positions hit {dropped}, expected {expect}")
    return df.select(*[c for i, c in enumerate(df.columns, 1) if i not in hit])


def apply_to(df: DataFrame, names: Iterable[str], fn: Callable[[str], Column]) -> DataFrame:
    """The same function on several columns in one projection (PRJ-7)."""
    return df.withColumns({n: fn(n) for n in names})
