"""Column functions of the event model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickstrata.schemas import MONEY


def event_time(text: Column) -> Column:
    """A timestamp, null for text that is none: bad times are for the rules to reject, not for the query to fail on."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss 'UTC'")))


def category_l1(code: Column) -> Column:
    """The first dotted segment; null stays null and '' stays ''."""
    return F.substring_index(code, ".", 1)


def money(value: Column) -> Column:
    return value.cast(MONEY)


def total(value: Column) -> Column:
    """A sum of money, nulls as zero."""
    return F.sum(F.coalesce(value, F.lit(0)).cast(MONEY)).cast(MONEY)


def total_where(condition: Column, value: Column) -> Column:
    return total(F.when(condition, value))


def rate(part: Column, whole: Column) -> Column:
    """part / whole to four places, null for an empty whole."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), 4)


def session_id(user: Column, start: Column) -> Column:
    return F.md5(F.concat_ws("|", user, start.cast("string")))


def event_hash(*values: Column) -> Column:
    """20 hex digits over values joined by the unit separator, nulls as empty text."""
    return F.substring(F.sha1(F.concat_ws("\x1f", *[F.coalesce(v.cast("string"), F.lit("")) for v in values])), 1, 20)
