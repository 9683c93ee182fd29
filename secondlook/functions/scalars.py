"""Scalar column functions (SURVEY FN-*). All stay inside Spark's own expressions.

Missing values follow three-valued logic: a flag built from a missing operand
is missing, never 0 or 1, unless the rule says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the analysis: code fragments, date formats, thresholds,
# decline codes and product names that decide results.
REVOLVING_FRAGMENT = "VRL"
REVOLVING_CODE = "RL"
CARD_CODE = "CC"
LOAN_PATTERN = "^[A-Z]{2}L"
ISO_MONTH_FORMAT = "yyyy-M-d"
COMPACT_DATE_FORMAT = "yyyyMMdd"
DAY_FIRST_FORMAT = "d/M/yyyy"
CASH_AND_DEBT_DECLINES = ("D01", "D02", "D09", "D10", "D11", "D21", "D22", "D23", "D24")
TARGET_PRODUCTS = ("CC", "PROUD")
APPROVED = "A"
WAIVER_DEFAULT = "N"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_to_double(x: Column | str) -> Column:
    """Text to number; unreadable text and NaN become NULL (FN-12)."""
    value = _c(x).try_cast("double")
    return F.when(~F.isnan(value), value)


def text_to_int(x: Column | str) -> Column:
    """Text to integer by truncation; out-of-range becomes NULL (FN-11)."""
    return text_to_double(x).try_cast("int")


def month_start(year: int, month: Column | str) -> Column:
    """First day of a month given as text ``6`` or ``06`` (FN-1, FN-5)."""
    text = F.concat(F.lit(f"{year}-"), _c(month).cast("string"), F.lit("-01"))
    return F.try_to_date(text, ISO_MONTH_FORMAT)


def compact_month_start(yyyymm: Column | str) -> Column:
    """First day of a month given as ``yyyymm`` (FN-1, FN-6)."""
    return F.try_to_date(F.concat(_c(yyyymm).cast("string"), F.lit("01")), COMPACT_DATE_FORMAT)


def day_first_date(x: Column | str) -> Column:
    """``dd/mm/yyyy`` text to date (FN-7)."""
    return F.try_to_date(_c(x), DAY_FIRST_FORMAT)


def to_date_only(x: Column | str) -> Column:
    """Date part of a date-time (FN-8)."""
    return _c(x).cast("date")


def months_apart(later: Column | str, earlier: Column | str) -> Column:
    """Whole calendar months between two dates, days ignored (FN-9, FN-10)."""
    a, b = _c(later), _c(earlier)
    return F.lit(12) * (F.year(a) - F.year(b)) + (F.month(a) - F.month(b))


def product_family(code: Column | str) -> Column:
    """Two-way product code; a missing code counts as card (FN-2)."""
    return F.when(_c(code).contains(REVOLVING_FRAGMENT), REVOLVING_CODE).otherwise(CARD_CODE)


def matches(x: Column | str, pattern: str) -> Column:
    """Regular-expression test that is false, not missing, for NULL (FN-3)."""
    return F.coalesce(_c(x).rlike(pattern), F.lit(False))


def left_chars(x: Column | str, n: int) -> Column:
    """First n characters; the input is kept as text so leading zeros stay (FN-4)."""
    return F.substring(_c(x).cast("string"), 1, n)


def default_if_missing(x: Column | str, value) -> Column:
    return F.coalesce(_c(x), F.lit(value))  # FN-16


def present_flag(x: Column | str) -> Column:
    return _c(x).isNotNull().cast("int")  # FN-17


def change_flag(a: Column | str, b: Column | str) -> Column:
    """0 equal, 1 different, missing if either is missing (FN-18)."""
    return (_c(a) != _c(b)).cast("int")


def difference(a: Column | str, b: Column | str) -> Column:
    return _c(a) - _c(b)  # FN-19


def approval_flag(result: Column | str) -> Column:
    return (_c(result) == APPROVED).cast("int")  # FN-20


def approval_target(result: Column | str, product: Column | str,
                    products: tuple[str, ...] = TARGET_PRODUCTS) -> Column:
    """1 when approved for one of the products, else 0; three-valued (FN-21)."""
    return ((_c(result) == APPROVED) & _c(product).isin(*products)).cast("int")


def decline_flag(code: Column | str,
                 codes: tuple[str, ...] = CASH_AND_DEBT_DECLINES) -> Column:
    """1 when the code is listed, 0 otherwise, also for a missing code (FN-22)."""
    return F.coalesce(_c(code).isin(*codes), F.lit(False)).cast("int")


def class_at(probability: Column | str, threshold: float = 0.5) -> Column:
    """Class from a probability; the threshold itself counts as 1 (FN-23)."""
    return (_c(probability) >= F.lit(threshold)).cast("int")


def label_number(label: Column | str) -> Column:
    """The number a class label spells, not its position among the levels (FN-13)."""
    return text_to_double(_c(label).cast("string"))


def share_of(p: float, n: Column | str) -> Column:
    return F.floor(F.lit(p) * _c(n))  # FN-24


def even_steps(start: float, stop: float, length: int) -> Column:
    """Array of ``length`` equally spaced numbers (FN-25)."""
    step = (stop - start) / (length - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)),
                       lambda i: F.lit(start) + i * F.lit(step))


def hash_key(seed: int, key: Column | str) -> Column:
    """Stable pseudo-random order of rows: md5 of seed and row key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), _c(key).cast("string")))


def hash_number(seed: int, *parts: Column | str) -> Column:
    """Stable pseudo-random whole number below 16**15 from a seed and parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def hash_share(seed: int, *parts: Column | str) -> Column:
    """Stable pseudo-random number in [0, 1)."""
    return hash_number(seed, *parts).cast("double") / F.lit(float(16**15))


def records(names: list[str], *rows: tuple) -> Column:
    """Array of structs with the same field names, for ``inline``."""
    return F.array(*[F.struct(*[_value(v).alias(n) for n, v in zip(names, row)]) for row in rows])


def _value(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)
