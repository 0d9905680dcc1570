"""Reports on a build: what was rejected, changed, held back, and how well rules and sources do."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnframe.operators import relations


def rejections(rejected: DataFrame, top: int = 6) -> DataFrame:
    """The commonest refusals: `what` (type and field), `reason`, `n`; ties in order of their texts."""
    what = F.concat_ws(".", "entity_type", "field").alias("what")
    return rejected.groupBy(what, "reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "what", "reason").limit(top)


def standardization(kept: DataFrame, examples: int = 3) -> DataFrame:
    """Per (entity_type, name) how many values were written anew and the first few raw → value pairs, most changed first.

    Pairs are counted before they are gathered, and of a field only its `examples` smallest are kept
    by nested minima, so that a field of any number of values stays small.
    """
    changed = kept.where(~F.col("raw_value").eqNullSafe(F.col("value"))).groupBy("entity_type", "name", "raw_value", "value").agg(F.count("*").alias("n"))
    pair = F.concat_ws(" → ", "raw_value", "value")
    # Pre-aggregated by a digest's bucket, whose lists are cut before they meet.
    few = changed.groupBy("entity_type", "name", F.pmod(F.xxhash64("raw_value"), F.lit(64)).alias("_b")).agg(F.sum("n").alias("n"), *[F.min(pair).alias("_least")])
    return few.groupBy("entity_type", "name").agg(F.sum("n").alias("changes"), F.slice(F.array_sort(F.collect_list("_least")), 1, examples).alias("examples")).orderBy(F.desc("changes"), "entity_type", "name")


def held_back(values: DataFrame, top: int = 3) -> DataFrame:
    """The sources that hold most values in review: domain, tier, values and their best confidence."""
    waiting = values.where("status = 'review'").groupBy("domain", "tier").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))
    return waiting.orderBy(F.desc("n"), "domain", "tier").limit(top)


def held_back_text(values: DataFrame, floor: float, top: int = 3) -> list[str]:
    """A line for each of the sources that hold most values back, and what would let them pass."""
    return [
        f"{r['n']} values of {r['domain']} (tier {r['tier']}) reach at most {r['confidence']:.2f} of the {floor:.2f} asked for: trust the site more, lower min_confidence, or add a second source"
        for r in held_back(values, top).collect()
    ]


def rule_health(pages: DataFrame, fields: DataFrame, names: list[str]) -> DataFrame:
    """Per field with a rule: pages tried, pages on which it matched, and when it last did."""
    tried = pages.agg(F.count("*").alias("tried"))
    matched = fields.where(F.col("name").isin(*names) & F.col("value").isNotNull()).select("page_id", "name").distinct().join(pages.select("page_id", "fetched_at"), "page_id")
    seen = matched.groupBy("name").agg(F.count("*").alias("matched"), F.max("fetched_at").alias("last_seen"))
    wanted = pages.sparkSession.createDataFrame([(n,) for n in names], "name string")
    return wanted.join(F.broadcast(tried)).join(seen, "name", "left").select("name", "tried", F.coalesce("matched", F.lit(0)).alias("matched"), "last_seen")


def review_items(queue: DataFrame, kind: str, limit: int = 20) -> DataFrame:
    """The newest open items of a kind."""
    return queue.where(F.col("kind") == kind).orderBy(F.desc("created_at"), F.desc("item_id")).limit(limit)


def top_fields(values: DataFrame, top: int = 10) -> DataFrame:
    """The fields with most values."""
    return values.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)


def filled_fields(values: DataFrame) -> DataFrame:
    """Per (entity_type, name) the entities with an accepted value."""
    return values.where("status = 'accepted'").groupBy("entity_type", "name").agg(F.count_distinct("entity_id").alias("filled"))


def filled_cells(values: DataFrame) -> int:
    """How many cells (entity and field) hold an accepted value."""
    return filled_fields(values).agg(F.coalesce(F.sum("filled"), F.lit(0))).first()[0]


@dataclass
class Report:
    """What there is to say about a build, each part a small table."""

    coverage: DataFrame
    gaps: DataFrame
    sources: DataFrame
    rejections: DataFrame
    standardization: DataFrame
    held_back: DataFrame


def report(values: DataFrame, entities: DataFrame, fields: DataFrame, pages: DataFrame, rejected: DataFrame, kept: DataFrame) -> Report:
    """All reports of a build; `fields` are the declared (entity_type, name)."""
    totals = entities.groupBy("entity_type").agg(F.count("*").alias("total"))
    return Report(relations.coverage(values, fields, totals), relations.gaps(entities, values, fields), relations.source_health(pages, values), rejections(rejected), standardization(kept), held_back(values))
