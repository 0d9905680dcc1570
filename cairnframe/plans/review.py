"""The review queue, decisions on it, and their return after a rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnframe.functions.latin import name_key


def queue(values: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """Open items: conflicts, values below the floor and rejected candidates, one row each with its kind."""
    conflicts = values.where("flagged and status = 'accepted'").select("entity_type", "entity_id", "name", "value", F.lit("conflict").alias("kind"))
    low = values.where("status = 'review'").select("entity_type", "entity_id", "name", "value", F.lit("low_confidence").alias("kind"))
    out = conflicts.unionByName(low)
    if rejects is not None:
        out = out.unionByName(rejects.select("entity_type", F.lit(None).cast("bigint").alias("entity_id"), "name", F.col("raw_value").alias("value"), F.lit("sanity").alias("kind")))
    return out


def decided(values: DataFrame, decisions: DataFrame) -> DataFrame:
    """Values with decisions (entity_id, name, value, decision) applied.

    The kept value is accepted and its siblings in the cell are superseded; a rejected value is
    superseded. Decisions are keyed by entity and field, so a rebuild meets them again. Of several
    decisions on one value the greatest text stands.
    """
    one = decisions.groupBy("entity_id", "name", "value").agg(F.max("decision").alias("decision"))
    kept = one.where("decision = 'keep'").groupBy("entity_id", "name").agg(F.max("value").alias("_kept"))
    both = values.join(one, ["entity_id", "name", "value"], "left").join(kept, ["entity_id", "name"], "left")
    status = F.when(F.col("decision") == "reject", "superseded").when(F.col("_kept") == F.col("value"), "accepted").when(F.col("_kept").isNotNull(), "superseded").otherwise(F.col("status"))
    return both.withColumn("status", status).drop("decision", "_kept")


def gap_queries(gaps: DataFrame) -> DataFrame:
    """Search texts for what is missing: the example's name and the field's words."""
    return gaps.select("entity_type", "name", F.explode("examples").alias("example")).withColumn("query", F.concat_ws(" ", F.concat(F.lit('"'), F.col("example"), F.lit('"')), F.replace(F.col("name"), F.lit("_"), F.lit(" "))))


def decide(decisions: DataFrame | None, entity_id: int, name: str, value: str, decision: str, spark=None) -> DataFrame:
    """The decisions with one more: keep or reject; a later decision on the same value replaces the earlier."""
    if decision not in ("keep", "reject"):
        raise ValueError(f"unknown decision {decision!r}")
    session = decisions.sparkSession if decisions is not None else spark
    new = session.createDataFrame([(entity_id, name, value, decision)], "entity_id bigint, name string, value string, decision string")
    return new if decisions is None else forget(decisions, entity_id, name, value).unionByName(new)


def forget(decisions: DataFrame, entity_id: int, name: str, value: str | None = None) -> DataFrame:
    """The decisions without those on a cell, or on one value of it."""
    mine = (F.col("entity_id") == entity_id) & (F.col("name") == name)
    return decisions.where(~(mine if value is None else mine & (F.col("value") == value)))


def open_items(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Review items on whose cell nothing has been decided."""
    return items.join(decisions.select("entity_id", "name"), ["entity_id", "name"], "left_anti")


def more_sources(items: DataFrame, entities: DataFrame) -> DataFrame:
    """Search texts for another source of each open value: the thing's name, the field's words and the value."""
    words = F.replace(F.col("name"), F.lit("_"), F.lit(" "))
    return items.join(entities.select("entity_id", "canonical_name"), "entity_id").select("entity_type", "entity_id", "name", "value", F.concat_ws(" ", F.concat(F.lit('"'), F.col("canonical_name"), F.lit('"')), words, "value").alias("query"))


def schema_queries(spec, topic: str | None = None) -> list[str]:
    """Search texts for a project's entities and fields, before there is anything to look for by name."""
    about = topic or spec.project
    return [f"{about} {e.name} {f.name.replace('_', ' ')}" for e in spec.entities for f in e.fields if f.name not in e.identity]


def find_entity(entities: DataFrame, aliases: DataFrame, name: str, least: float = 0.9) -> DataFrame:
    """(entity_id, canonical_name, how, similarity) of a name, best first: the same key, an alias's key, or similar from `least` on."""
    from cairnframe.operators.resolution import similarity

    wanted = name_key(F.lit(name))
    own = entities.select("entity_id", "canonical_name", name_key(F.col("canonical_name")).alias("_k"), wanted.alias("_w"))
    exact = own.where("_k = _w").select("entity_id", "canonical_name", F.lit("name").alias("how"), F.lit(1.0).alias("similarity"))
    other = aliases.select("entity_id", name_key(F.col("alias")).alias("_k"), wanted.alias("_w")).where("_k = _w").select("entity_id").distinct().join(entities.select("entity_id", "canonical_name"), "entity_id").select("entity_id", "canonical_name", F.lit("alias").alias("how"), F.lit(1.0).alias("similarity"))
    near = own.where("_k <> _w").select("entity_id", "canonical_name", F.lit("similar").alias("how"), similarity(F.col("_k"), F.col("_w")).alias("similarity")).where(F.col("similarity") >= least)
    rank = F.when(F.col("how") == "name", 0).when(F.col("how") == "alias", 1).otherwise(2)
    return exact.unionByName(other).unionByName(near).orderBy(rank, F.desc("similarity"), "entity_id")


def with_history(history: DataFrame, values: DataFrame) -> DataFrame:
    """(url, name, value, seen_at): the last value of each address and field; a rebuild adds to it and never clears it."""
    every = history.select("url", "name", "value", "seen_at").unionByName(values.select("url", "name", "value", "seen_at"))
    return every.groupBy("url", "name").agg(F.max(F.struct("seen_at", "value")).alias("b")).select("url", "name", "b.value", "b.seen_at")
