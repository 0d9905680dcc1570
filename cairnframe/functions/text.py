"""Shared text expressions: blanks, missing marks, instants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks and words that stand for "no value", in lower case.
MISSING = ("", "-", "–", "—", "?", "n/a", "na", "n.a.", "none", "null", "nil", "tbd", "tba", "k. a.", "k.a.", "unknown", "not recorded", "none given", "not given", "no value", "no data", "not available", "missing")

#: Unicode blanks as a Java character class.
BLANK = r"[\s\u0085   -​    　﻿]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it; plans stay small."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def constants(pairs: dict) -> Column:
    """A fixed table of texts or numbers as one map literal, which is cheap to make and folded once."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else repr(x) + ("D" if isinstance(x, float) else "")
    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in pairs.items()) + ")")


def squeeze(value: Column) -> Column:
    """Text with single spaces inside and none at its ends."""
    return F.trim(F.regexp_replace(value, BLANK + "+", " "))


def is_missing(value: Column) -> Column:
    """True where the value is null, blank or a mark or word for "no value"."""
    return value.isNull() | F.lower(squeeze(value)).isin(*MISSING)


def instant(value: Column) -> Column:
    """A timestamp out of ISO text, basic or extended; UTC where no zone is given; null if unreadable."""
    text = F.regexp_replace(F.trim(value), r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})", "$1-$2-$3T$4:$5:$6")
    zoned = text.rlike(r"(?i)(z|[+-]\d{2}:?\d{2}|utc|gmt)$") & text.rlike(r"\d{2}:\d{2}")
    clock = text.rlike(r"\d{1,2}:\d{2}")
    return F.when(zoned | ~clock, text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp")


def fold(value: Column) -> Column:
    """Text without letter case: upper case first, so that letters with several lower forms agree."""
    return F.lower(F.upper(value))


def letters(value: Column) -> Column:
    """Case-folded words: runs of letters, marks and digits joined by single spaces."""
    return F.trim(F.regexp_replace(fold(value), r"[^\p{L}\p{M}\p{Nd}]+", " "))
