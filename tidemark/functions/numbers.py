"""Columns that read numbers, ratios and identifiers out of loose text, and plain arithmetic on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT = {"万": 1e4, "亿": 1e8}


def clamp(col: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def safe_ratio(top: Column, bottom: Column) -> Column:
    """0 where the denominator is 0 or null."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def _unit_factor(text: Column) -> Column:
    out = F.lit(1.0)
    for unit, factor in _UNIT.items():
        out = F.when(F.endswith(text, F.lit(unit)), F.lit(factor)).otherwise(out)
    return out


def metric_number(col: Column) -> Column:
    """Metric cell to double: a percent sign or comma goes, a ten-thousands or hundred-millions unit multiplies; null if it is no number.

    The percent sign goes before any size test, so ``0.8%`` reads as 0.8.
    """
    text = F.trim(F.regexp_replace(col, "[,%]", ""))
    return F.regexp_replace(text, "[万亿]$", "").try_cast("double") * _unit_factor(text)


def lenient_number(col: Column) -> Column:
    """The first number within the text, times its unit; 0 without one."""
    text = F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), ",", ""))
    found = F.regexp_extract(F.regexp_replace(text, "[万亿]$", ""), r"-?\d+(?:\.\d+)?", 0)
    return F.coalesce(found.try_cast("double") * _unit_factor(text), F.lit(0.0))


def largest_of_piped(col: Column) -> Column:
    """``"1|5"`` -> 5: the largest number among parts that a bar divides; 0 without one."""
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), r"\|"), lenient_number)
    return F.coalesce(F.array_max(parts), F.lit(0.0))


def visible_count(col: Column) -> Column:
    """A counter as it is shown (``23.8万``), nothing else around it; null otherwise."""
    text = F.trim(F.coalesce(col, F.lit("")))
    number = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)\s*([万亿]?)$", 1)
    return F.when(number != "", number.try_cast("double") * _unit_factor(text)).cast("long")


def ratio(col: Column) -> Column:
    """Numbers above 1 are percent; the result lies in 0..1; null is 0."""
    x = F.coalesce(col.cast("double"), F.lit(0.0))
    return clamp(F.when(x > 1, x / 100).otherwise(x), 0.0, 1.0)


def all_digits(col: Column) -> Column:
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"\D", "")


def ten_or_more(digits: Column) -> Column:
    return F.when(F.length(digits) >= 10, digits)


def joined_digits(col: Column) -> Column:
    """All digits of the text, if there are ten or more of them."""
    return ten_or_more(all_digits(col))


def first_long_digits(col: Column) -> Column:
    """The first run of ten or more digits."""
    return F.nullif(F.regexp_extract(F.coalesce(col, F.lit("")), r"\d{10,}", 0), F.lit(""))


def id_in_url(url: Column, keys: tuple[str, ...] = ("modal_id", "aweme_id", "item_id", "id")) -> Column:
    """Item number in a ``/video/<number>`` path, else in one of the query's ``keys``."""
    found = [F.nullif(F.regexp_extract(url, r"/video/(\d+)", 1), F.lit(""))]
    found += [F.nullif(F.regexp_extract(url, rf"[?&]{k}=(\d+)", 1), F.lit("")) for k in keys]
    return F.coalesce(*found)


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def known(col: Column) -> Column:
    """Neither blank nor one of the words that stand for a missing value."""
    return ~F.lower(F.trim(F.coalesce(col, F.lit("")))).isin("", "unknown", "none", "null", "其他", "其它", "0")


def dataset_date(col: Column) -> Column:
    """The last ``20yymmdd`` in a dataset's name as a number; 0 without one."""
    found = F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(r"20\d{6}"), F.lit(0))
    return F.coalesce(F.try_element_at(found, F.lit(-1)).cast("long"), F.lit(0))


def falsy_first(*cols: Column) -> Column:
    """The first value that is neither null nor zero, else 0."""
    return F.coalesce(*[F.nullif(c.cast("double"), F.lit(0.0)) for c in cols], F.lit(0.0))
