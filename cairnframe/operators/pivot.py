"""Attribute–value rows reshaped into wide, typed tables.

The attributes are divided into blocks of columns. Rows are cleaned, stored once bucketed by
entity, and each block is pivoted over that same bucketing; the blocks are then joined bucket
by bucket, so that however many thousand attributes there are, rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnframe.functions.text import BLANK, constants, is_missing, squeeze
from cairnframe.session import bucket_count, bucketed

# Month names and their usual short forms, by month.
MONTHS = {
    1: "january januar janvier enero janeiro gennaio styczeń stycznia январь января जनवरी jan janv ene",
    2: "february februar février fevrier febrero fevereiro febbraio luty lutego февраль февраля फ़रवरी फरवरी feb févr fév fev",
    3: "march märz maerz mars marzo março marco marzec marca март марта मार्च mar mär mrz",
    4: "april avril abril aprile kwiecień kwietnia апрель апреля अप्रैल apr avr abr",
    5: "may mai mayo maio maggio maj maja май мая मई",
    6: "june juni juin junio junho giugno czerwiec czerwca июнь июня जून jun",
    7: "july juli juillet julio julho luglio lipiec lipca июль июля जुलाई jul juil",
    8: "august août aout agosto sierpień sierpnia август августа अगस्त aug ago",
    9: "september septembre septiembre setembro settembre wrzesień września сентябрь сентября सितंबर सितम्बर sep sept set",
    10: "october oktober octobre octubre outubro ottobre październik października октябрь октября अक्टूबर अक्तूबर oct okt out",
    11: "november novembre noviembre novembro listopad listopada ноябрь ноября नवंबर नवम्बर nov",
    12: "december dezember décembre decembre diciembre dezembro dicembre grudzień grudnia декабрь декабря दिसंबर दिसम्बर dec dez déc dic",
}
# Words and marks for yes and no.
YES = ("true", "t", "yes", "y", "1", "ja", "oui", "si", "sí", "sim", "tak", "да", "हाँ", "हां", "✓", "✔", "☑", "on", "wahr", "vrai")
NO = ("false", "f", "no", "n", "0", "nein", "non", "não", "nao", "nie", "нет", "नहीं", "✗", "✘", "✕", "×", "☐", "off", "falsch", "faux")

_HEDGE = r"(?i)^(?:(?:ca|c|approx|circa|about|around|roughly|etwa|environ|env|um|nearly|almost|over)\b\.?|[~≈±<>≤≥=])\s*"


def field_key(name: Column) -> Column:
    """A field name without case, blanks, hyphens, underscores and colons."""
    return F.lower(F.regexp_replace(name, BLANK + r"|[-‐-―_:]", ""))


def month_number(word: Column) -> Column:
    """The month of a name or short form, in any case; null for other words."""
    names = {w: k for k, words in MONTHS.items() for w in words.split()}
    return F.try_element_at(constants(names), F.lower(F.regexp_replace(word, r"\.$", "")))


def plain_digits(number: Column) -> Column:
    """A decimal as text without exponent and needless zeros."""
    # Of scale 12, small magnitudes would print with an exponent; eight digits more are never needed below it.
    text = F.when(F.abs(number) < 1, F.concat(F.when(number < 0, "-").otherwise(""), F.lit("0."), F.lpad((F.abs(number) * F.lit(1000000000000)).cast("decimal(38,0)").cast("string"), 12, "0"))).otherwise(number.cast("string"))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def read_number(value: Column) -> Column:
    """Plain decimal digits of a number, without needless zeros; null if the text is not one number."""
    v = F.regexp_replace(F.regexp_replace(value, _HEDGE, ""), "−", "-")
    shape = r"^[-+]?(?:\d{1,3}(?:[ ,'’]\d{3})+|\d+)(?:\.\d+|,\d{1,2}|,\d{4,})?(?:[eE][-+]?\d+)?$"
    plain = F.regexp_replace(F.regexp_replace(v, r"[ '’]|,(?=\d{3}(?!\d))", ""), ",", ".")
    return F.when(v.rlike(shape), plain_digits(F.regexp_replace(plain, r"^\+", "").try_cast("decimal(38,12)")))


def read_bool(value: Column) -> Column:
    v = F.lower(value)
    return F.when(v.isin(*YES), "true").when(v.isin(*NO), "false")


# Shapes of dates: year first, all digits, three numbers, and a day and year around a month's name.
_YEAR_FIRST = r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?:[T ]\d{1,2}:\d{2}.*)?$"
_COMPACT = r"^\d{8}(?:T\d{4,6}Z?)?$"
_NUMERIC = r"^\d{1,2} ?[-/.] ?\d{1,2} ?[-/.] ?\d{4}$"
_NAMED = r"(?i)^(?:\p{L}+, )?(?:\d{1,2}(?:st|nd|rd|th|er|º|ª|\.)? ?(?:de |of )?[\p{L}\p{M}]{3,}\.?,? ?(?:de )?\d{4}|[\p{L}\p{M}]{3,}\.? \d{1,2}(?:st|nd|rd|th)?,? \d{4})$"
_YEAR_NAMED = r"^\d{4}[ ,\-]+[\p{L}\p{M}]{3,}\.?[ ,\-]+\d{1,2}$"


def read_date(value: Column, month: Column, numbers: Column) -> Column:
    """`yyyy-MM-dd` out of squeezed text, its month's number and its runs of digits; null if unreadable.

    Numeric dates are day first unless that is impossible.
    """
    n = lambda k: F.try_element_at(numbers, F.lit(k))
    compact = value.rlike(_COMPACT)
    year = F.when(compact, F.substring(n(1), 1, 4)).when(value.rlike(_YEAR_FIRST) | value.rlike(_YEAR_NAMED), n(1)).when(value.rlike(_NUMERIC), n(3)).when(value.rlike(_NAMED), n(2))
    first = F.when(compact, F.substring(n(1), 5, 2)).when(value.rlike(_YEAR_FIRST) | value.rlike(_NUMERIC), n(2)).otherwise(month.cast("string"))
    second = F.when(compact, F.substring(n(1), 7, 2)).when(value.rlike(_YEAR_FIRST), n(3)).when(value.rlike(_YEAR_NAMED), n(2)).otherwise(n(1))
    impossible = value.rlike(_NUMERIC) & (first.try_cast("int") > 12)
    text = F.concat(year, F.lit("-"), F.lpad(F.when(impossible, second).otherwise(first), 2, "0"), F.lit("-"), F.lpad(F.when(impossible, first).otherwise(second), 2, "0"))
    return F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd")


def read_month(value: Column, month: Column) -> Column:
    """`1`…`12` out of a number or a name, alone or after a preposition."""
    digits = F.regexp_extract(value, r"^(?:0?[1-9]|1[0-2])$", 0).try_cast("int")
    named = F.when(value.rlike(r"(?i)^(?:(?:in|im|en|em|w|в|during|around|about|ca\.?|c\.) )?[\p{L}\p{M}]{3,}\.?$"), month)
    return F.coalesce(digits, named).cast("string")


def read_year(value: Column) -> Column:
    """A four-digit year, alone or between words and marks that hold no other digits."""
    return F.nullif(F.regexp_extract(value, r"^[^\d]{0,20}?(?<!-)(\d{4})(?:\s*[^\d\s][^\d]{0,20})?$", 1), F.lit(""))


TYPES = {"number": "decimal(38,12)", "bool": "boolean", "date": "date", "month": "int", "year": "int"}


def read_cells(rows: DataFrame, specs: list[tuple[str, str, bool]], entity: str = "page_id", name: str = "name", value: str = "value") -> DataFrame:
    """(`entity`, `name`, `cell`) of each row whose name is a declared field and whose value is not missing.

    `specs` lists (name, type, multiple). Missing marks and blanks, null entities and null or
    undeclared names give no row; a value that can't be read as the declared type gives a null cell.
    """
    keys = F.create_map(*[F.lit(x) for n, _, _ in specs for x in ("".join(c for c in n.lower() if c not in " -_:"), n)]) if specs else F.lit(None)
    kinds = F.create_map(*[F.lit(x) for n, t, _ in specs for x in (n, t)]) if specs else F.lit(None)
    field = F.try_element_at(keys, field_key(F.col(name))) if specs else F.lit(None).cast("string")
    kind = F.try_element_at(kinds, field) if specs else F.lit(None).cast("string")
    known = rows.select(F.col(entity), field.alias("name"), kind.alias("_kind"), squeeze(F.col(value)).alias("_v")).where(F.col("name").isNotNull() & F.col(entity).isNotNull() & ~is_missing(F.col("_v")))
    v = F.col("_v")
    # The last word of three letters or more is the month's name; a leading weekday or preposition is none.
    word = F.regexp_extract(v, r"([\p{L}\p{M}]{3,})[^\p{L}]*(?:(?:st|nd|rd|th|de)\b[^\p{L}]*)*$", 1)
    parts = known.withColumns({"_month": F.when(F.col("_kind").isin("date", "month"), month_number(word)), "_n": F.when(F.col("_kind") == "date", F.regexp_extract_all(v, F.lit(r"\d+"), 0))})
    is_ = lambda k: F.col("_kind") == k
    cell = F.when(is_("number"), read_number(v)).when(is_("bool"), read_bool(v)).when(is_("date"), read_date(v, F.col("_month"), F.col("_n"))).when(is_("month"), read_month(v, F.col("_month"))).when(is_("year"), read_year(v)).otherwise(v)
    return parts.select(entity, "name", cell.alias("cell"))


def wide_table(rows: DataFrame, specs: list[tuple[str, str, bool]], entity: str = "page_id", name: str = "name", value: str = "value", block: int = 64, buckets: int | None = None) -> DataFrame:
    """One row per `entity` of `rows` with a typed column for each declared field.

    A field declared multiple is an array of its distinct values in order; of a single field with
    several readable values the most frequent stands, ties going to the smallest text. Entities
    without any filled cell still have a row. Null entities have none. An empty table gives an
    empty table with all columns. The cells stay in the shared folder until `session.release`.
    """
    spark = rows.sparkSession
    n = buckets or bucket_count(rows)
    cells = read_cells(rows, specs, entity, name, value)
    blocks = {f: i // block for i, (f, _, _) in enumerate(specs)}
    index = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])
    # The counts are merged map-side, so one entity or one repeated value with a huge share of the rows shrinks before the shuffle.
    counted = cells.groupBy(entity, "name", "cell").agg(F.count("*").alias("n")).withColumn("block", index[F.col("name")])
    every = rows.select(entity).where(F.col(entity).isNotNull()).distinct().select(entity, F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("cell"), F.lit(0).cast("bigint").alias("n"), F.lit(-1).alias("block"))
    stored = spark.table(bucketed(counted.unionByName(every), "cells", n, entity, sort=True))
    wide = stored.where("block = -1").select(entity)
    for b in sorted(set(blocks.values())):
        columns = []
        for f, kind, many in specs:
            if blocks[f] != b:
                continue
            mine = F.col("name") == f
            as_type = (lambda t: lambda c: c.cast(t) if t else c)(TYPES.get(kind))
            if many:
                values = F.array_sort(F.collect_set(F.when(mine, F.col("cell"))))
                columns.append(F.transform(values, as_type).alias(f))
            else:
                best = F.min(F.when(mine & F.col("cell").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("cell").alias("cell"))))
                columns.append(as_type(best["cell"]).alias(f))
        wide = wide.join(stored.where(F.col("block") == b).groupBy(entity).agg(*columns), entity, "left")
    return wide


def filled_cells(wide: DataFrame, specs: list[tuple[str, str, bool]], entity: str = "page_id") -> DataFrame:
    """The wide table's filled cells as (`entity`, `name`, `cell`) rows, in the text forms of `read_cells`."""
    def cell(f: str, kind: str) -> Callable[[Column], Column]:
        return lambda c: F.struct(F.lit(f).alias("name"), (plain_digits(c) if kind == "number" else c.cast("string")).alias("cell"))

    cells = [F.when(F.col(f).isNotNull(), F.transform(F.col(f), cell(f, kind)) if many else F.array(cell(f, kind)(F.col(f)))) for f, kind, many in specs]
    return wide.select(entity, F.explode(F.flatten(F.array_compact(F.array(*cells)))).alias("c")).select(entity, "c.name", "c.cell")
