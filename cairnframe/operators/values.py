"""The long table of values: pivots, unpivots, filters, orders and folds.

A value row carries entity_id, name, value, value_num, value_max, unit, origin, quote, source,
tier, confidence, status and seq (the order it was found in). Every output table is a pivot of
these rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnframe.functions.standard import convert, display

PROVENANCE = ("confidence", "origin", "source", "quote", "fetched_at")


def to_long(df: DataFrame, key: str, fields: list[str], extra: dict[str, Column] | None = None, drop_nulls: bool = True) -> DataFrame:
    """One row per `key` and filled field: `key`, name, value, value_num; further columns from `extra`."""
    texts = df.select(key, *[F.col(f).cast("string").alias(f) for f in fields])
    long = texts.unpivot([key], fields, "name", "value")
    long = long.where(F.col("value").isNotNull()) if drop_nulls else long
    return long.withColumns({"value_num": F.col("value").try_cast("double"), **(extra or {})})


def shown() -> Column:
    """A value as a cell shows it: a range as "lo-hi", a number as a reader writes it, else its text."""
    number = F.col("value_num")
    high = F.col("value_max")
    return F.when(high.isNotNull(), F.concat(display(number), F.lit("-"), display(high))).when(number.isNotNull(), display(number)).otherwise(F.col("value"))


def accepted(values: DataFrame, min_confidence: float | None = None, include_derived: bool = True) -> DataFrame:
    """Accepted values, without those below a confidence and, if asked, without derived ones."""
    out = values.where("status = 'accepted'")
    if min_confidence is not None:
        out = out.where(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    return out if include_derived else out.where(~F.col("origin").isin("derived", "inferred", "default"))


def best_order() -> Column:
    """Most confident first, then the most trusted tier (null is 3), then the first found."""
    return F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.coalesce("tier", F.lit(3))).alias("t"), (-F.col("seq")).alias("s"))


def to_wide(values: DataFrame, fields: list[str], key: str = "entity_id", cell: Column | None = None, provenance: bool = False) -> DataFrame:
    """One row per `key` with the best value of each field; the fields are given, so no extra job finds them.

    With `provenance` every field also has <field>_confidence, _origin, _source and so on, all of
    the same winning row.
    """
    carried = [c for c in PROVENANCE if provenance and c in values.columns]
    whole = F.struct(best_order().alias("o"), (cell if cell is not None else shown()).alias("v"), *[F.col(c) for c in carried])
    columns = [F.max(F.when(F.col("name") == f, whole)).alias(f"_{i}") for i, f in enumerate(fields)]
    wide = values.groupBy(key).agg(*columns)
    out = []
    for i, f in enumerate(fields):
        out.append(F.col(f"_{i}.v").alias(f))
        out += [F.col(f"_{i}.{c}").alias(f"{f}_{c}") for c in carried]
    return wide.select(key, *out)


def where(df: DataFrame, conditions: dict[str, object]) -> DataFrame:
    """Rows that meet all conditions: a column's shown text equals a value, or one of a list, without case and blanks."""
    for c, wanted in conditions.items():
        texts = [str(w).strip().lower() for w in (wanted if isinstance(wanted, (list, tuple, set)) else [wanted])]
        df = df.where(F.lower(F.trim(F.col(c).cast("string"))).isin(texts))
    return df


def cascade(child: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of a junction or child table whose parent is still there."""
    return child.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def search_cells(df: DataFrame, needle: str) -> DataFrame:
    """Rows with the needle in some cell, in any case."""
    return df.where(F.exists(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), lambda x: F.contains(F.lower(x), F.lit(needle.lower()))))


def choose(df: DataFrame, columns: list[str | dict], keys: list[str]) -> DataFrame:
    """The chosen columns in order under their labels; keys always come first."""
    wanted = [(c, c) if isinstance(c, str) else (c["name"], c.get("label", c["name"])) for c in columns]
    names = [c for c, _ in wanted]
    return df.select(*[k for k in keys if k not in names], *[F.col(c).alias(label) for c, label in wanted])


def in_units(df: DataFrame, column: str, source: str, target: str) -> DataFrame:
    """A numeric column in another unit, to two places."""
    return df.withColumn(column, F.round(convert(F.col(column), source, target), 2))


def sort_by(df: DataFrame, columns: list[str], descending: bool = False) -> DataFrame:
    """Typed order; nulls last ascending, first descending."""
    return df.orderBy(*[F.col(c).desc_nulls_first() if descending else F.col(c).asc_nulls_last() for c in columns])


def split_cells(df: DataFrame, columns: list[str], separator: str = "; ") -> DataFrame:
    """One row for every combination of the parts of joined cells; a null cell stays one null."""
    for c in columns:
        df = df.withColumn(c, F.explode_outer(F.split(F.col(c).cast("string"), separator)))
    return df


def join_cells(child: DataFrame, key: str, column: str, separator: str = "; ") -> DataFrame:
    """A child table's values joined into one cell per key, in order, each once."""
    return child.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(column)), separator).alias(column))


def stack_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables under one another with a `table` column and the union of their columns as text."""
    out = None
    for name, df in tables.items():
        one = df.select(F.lit(name).alias("table"), *[F.col(c).cast("string").alias(c) for c in df.columns])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def restyled(df: DataFrame, style: str) -> DataFrame:
    """Columns renamed to snake_case, camelCase, PascalCase or Title Case."""
    return df.toDF(*[case_style(c, style) for c in df.columns])


def case_style(name: str, style: str) -> str:
    import re

    words = [w for w in re.split(r"[\s_-]+", name) if w] or [""]
    title = [w[:1].upper() + w[1:].lower() for w in words]
    return {"camelCase": words[0].lower() + "".join(title[1:]), "PascalCase": "".join(title), "Title Case": " ".join(title)}.get(style, "_".join(w.lower() for w in words))
