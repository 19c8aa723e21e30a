"""Column expressions; all of them stay inside Catalyst."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_of(ts: Column) -> Column:
    return F.month(ts)


def in_period(ts: Column, months, mode: str = "in", year: int | None = None) -> Column:
    """Month predicate on a timestamp.

    ``in``: the month is one of ``months``; ``before``: it is less than the first one;
    ``not_in``: it is none of them, and a missing timestamp passes.  With ``year`` the
    test becomes timestamp ranges, which Parquet row groups can be pruned by.
    """
    months = [months] if isinstance(months, int) else sorted(months)
    if year is None:
        inside, before = F.month(ts).isin(months), F.month(ts) < months[0]
    else:
        inside = F.lit(False)
        for m in months:
            inside = inside | ((ts >= _month_start(year, m)) & (ts < _month_start(year, m + 1)))
        before = (ts >= _month_start(year, 1)) & (ts < _month_start(year, months[0]))
    if mode == "in":
        return inside
    if mode == "before":
        return before
    if mode == "not_in":
        return ts.isNull() | ~inside
    raise ValueError(f"unknown mode {mode!r}")


def _month_start(year: int, month: int) -> Column:
    start = datetime(year + (month - 1) // 12, (month - 1) % 12 + 1, 1)
    return F.lit(start.strftime("%Y-%m-%d 00:00:00")).cast("timestamp_ntz")


def days_since(ts: Column, cutoff: Column) -> Column:
    """Whole days from ``cutoff`` to ``ts``, rounded down on both sides of zero."""
    clock = "HHmmssSSSSSS"
    earlier = F.date_format(ts, clock) < F.date_format(cutoff, clock)
    return F.datediff(ts, cutoff) - F.when(earlier, 1).otherwise(0)


def tokens(col: Column, sep: str) -> Column:
    """Split on a literal separator; empty or missing text has no tokens, inner blanks stay."""
    return F.when(F.coalesce(col, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(col, "\\Q" + sep + "\\E", -1)
    )


def lower_tokens(col: Column) -> Column:
    return F.transform(col, F.lower)


def flag(col: Column) -> Column:
    return F.coalesce(col, F.lit("N")) == "Y"


def dedupe_array(col: Column, ordered: bool = True) -> Column:
    return F.array_distinct(col) if ordered else F.array_sort(F.array_distinct(col))


def truncate_sequence(seq: Column, length: int = 20, pad: Column | None = None) -> Column:
    """First ``length`` elements, filled up with ``pad`` on the right if it is given."""
    head = F.slice(seq, 1, length)
    if pad is None:
        return head
    return F.concat(head, F.array_repeat(pad, F.lit(length) - F.size(head)))


def pair_features(a: Column, b: Column) -> Column:
    """Elementwise difference followed by elementwise product of two vectors."""
    return F.concat(F.zip_with(a, b, lambda x, y: x - y), F.zip_with(a, b, lambda x, y: x * y))


def no_vector() -> Column:
    """What a row without a vector carries to a Python worker beside rows that have one: an empty list.

    Spark measures a batch after every row, and Arrow then goes over all null lists at its end again, so that a batch of
    them took time with the square of its rows.
    """
    return F.array().cast("array<double>")


def hash_hex(*parts) -> Column:
    """md5 of the parts joined by ``:``; the reproducible source of every random choice."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def hash_int(*parts) -> Column:
    """First 32 bits of :func:`hash_hex` as a non-negative BIGINT."""
    return F.conv(F.substring(hash_hex(*parts), 1, 8), 16, 10).cast("bigint")


def hash_long(*parts) -> Column:
    """First 60 bits of :func:`hash_hex` as a non-negative BIGINT, to order rows by."""
    return F.conv(F.substring(hash_hex(*parts), 1, 15), 16, 10).cast("bigint")
