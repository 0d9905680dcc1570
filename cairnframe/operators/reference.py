"""Reference data: places, vocabularies, registries, and what registry answers do to values."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnframe.functions.standard import comparison_key
from cairnframe.session import few_bytes

CLOSE = 0.85


def _hint(df: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """A reference table is broadcast only if its estimated size allows it."""
    return F.broadcast(df) if few_bytes(df, limit) else df


def place_names(places: DataFrame) -> DataFrame:
    """(`code`, `name`, `key`): each place under its name and its aliases, which are parted by semicolons."""
    every = F.flatten(F.array(F.array("name"), F.split(F.coalesce("aliases", F.lit("")), ";")))
    return places.select("code", "name", F.explode(every).alias("_alias")).select("code", "name", comparison_key(F.trim("_alias")).alias("key")).where("key <> ''").distinct()


def match_places(names: DataFrame, places: DataFrame, name: str = "place", threshold: float = CLOSE) -> DataFrame:
    """(`name`, `code`, `similarity`): each distinct name's place by exact key, else by the closest key.

    Close keys meet by their first two or last two letters instead of all against all; similarity is
    computed on those pairs in Arrow batches. Ties go to the smallest code. Names without a match
    have no row.
    """
    keys = names.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct().withColumn("key", comparison_key(F.col("name")))
    known = place_names(places).select("code", F.col("key").alias("known"))
    exact = keys.join(_hint(known), F.col("key") == F.col("known")).groupBy("name").agg(F.min("code").alias("code")).withColumn("similarity", F.lit(1.0))
    rest = keys.join(exact.select("name"), "name", "left_anti")
    ends = lambda c: F.array_distinct(F.array(F.concat(F.lit("a"), F.substring(c, 1, 2)), F.concat(F.lit("z"), F.substring(c, -2, 2))))
    met = rest.withColumn("end", F.explode(ends(F.col("key")))).join(known.withColumn("end", F.explode(ends(F.col("known")))), "end").select("name", "key", "code", "known").distinct()

    def ratio(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["name", "code"]].assign(similarity=[difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(b["key"], b["known"])])

    close = met.mapInPandas(ratio, f"name string, code {places.schema['code'].dataType.simpleString()}, similarity double").where(F.col("similarity") >= threshold)
    best = close.groupBy("name").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "code")).alias("b"))
    return exact.unionByName(best.select("name", F.col("b.code").alias("code"), (-F.col("b.s")).alias("similarity"))).withColumnRenamed("name", name)


def place_parents(places: DataFrame) -> DataFrame:
    """(`code`, `name`, `parent_name`): each place with the name of what it belongs to."""
    up = places.select(F.col("code").alias("parent"), F.col("name").alias("parent_name"))
    return places.select("code", "name", "parent").join(_hint(up), "parent", "left").select("code", "name", "parent_name")


def match_vocabulary(values: DataFrame, vocabulary: DataFrame, value: str = "value", strict: bool = False) -> DataFrame:
    """`values` with `term`: by alias or term under the same key, else by a term that is one of the value's words.

    Ties go to the smallest term. Without a match the value itself stands, or the row goes if `strict`.
    """
    keyed = values.withColumn("_key", comparison_key(F.col(value)))
    both = vocabulary.select("term", F.explode(F.array("term", F.coalesce("alias", "term"))).alias("_a")).select("term", comparison_key(F.col("_a")).alias("_known")).distinct()
    whole = both.groupBy("_known").agg(F.min("term").alias("_whole"))
    single = whole.where(~F.contains("_known", F.lit(" ")))
    found = keyed.join(_hint(whole), F.col("_key") == F.col("_known"), "left").drop("_known")
    words = keyed.select("_key", F.explode(F.split("_key", " ")).alias("_known")).distinct().join(_hint(single), "_known").groupBy("_key").agg(F.min("_whole").alias("_word"))
    out = found.join(words, "_key", "left").withColumn("term", F.coalesce("_whole", "_word", *([] if strict else [F.col(value)]))).drop("_key", "_whole", "_word")
    return out.where("term is not null") if strict else out


def dated_rates(amounts: DataFrame, rates: DataFrame, on: str = "on_date") -> DataFrame:
    """`amounts` (currency, `on`) with the rate of their own day: an equi join on currency and date; null where none is known."""
    return amounts.join(_hint(rates.select("currency", F.col("date").alias(on), "rate")), ["currency", on], "left")


def confirmed(values: DataFrame, answers: DataFrame, key: list[str]) -> DataFrame:
    """Values after registry answers (`key`, answer): equal ones gain 0.15 up to 0.99, defaults are replaced, gaps are filled."""
    both = values.join(answers, key, "full_outer")
    same = F.lower(F.trim("value")) == F.lower(F.trim("answer"))
    fill = F.col("value").isNull() | (F.col("origin") == "default")
    told = F.col("answer").isNotNull()
    return both.withColumns({
        "confidence": F.when(told & F.coalesce(fill, F.lit(True)), 0.8).when(told & same, F.least(F.lit(0.99), F.col("confidence") + 0.15)).otherwise(F.col("confidence")),
        "origin": F.when(told & F.coalesce(fill, F.lit(True)), "registry").otherwise(F.col("origin")),
        "value": F.when(told & F.coalesce(fill, F.lit(True)), F.col("answer")).otherwise(F.col("value")),
    }).drop("answer")


def cross_checked(values: DataFrame, answers: DataFrame, key: list[str], tolerance: float) -> DataFrame:
    """Numbers against measured answers (`key`, answer): within the tolerance +0.1 up to 0.99, beyond it −0.2 down to 0."""
    both = values.join(answers, key, "left")
    near = F.abs(F.col("value_num") - F.col("answer")) <= tolerance
    c: Column = F.col("confidence")
    return both.withColumn("confidence", F.when(near, F.least(F.lit(0.99), c + 0.1)).when(near.isNotNull(), F.greatest(F.lit(0.0), c - 0.2)).otherwise(c)).drop("answer")


def place_functions(places: DataFrame, most: int = 20_000) -> dict:
    """`place_parent(name)` for formulas, out of a place table of at most `most` rows; a larger one is joined by `place_parents`."""
    rows = place_parents(places).where("parent_name is not null").select(F.lower(F.trim("name")).alias("name"), "parent_name").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a place table of more than {most} rows is no part of a formula; join place_parents")
    from cairnframe.functions.formula import STR, Value, text

    table = F.create_map(*[F.lit(x) for r in rows for x in (r["name"], r["parent_name"])]) if rows else F.lit(None)
    return {"place_parent": (1, 1, lambda a: Value(STR, F.try_element_at(table, F.lower(F.trim(text(a[0])))) if rows else F.lit(None).cast("string")))}
