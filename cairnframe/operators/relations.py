"""Typed relations between entities, and reports over values: coverage, gaps, sources, accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(edges: DataFrame, relation: str) -> DataFrame:
    """(entity_id, other_id) of a relation, both ways, each pair once."""
    mine = edges.where(F.col("relation") == relation)
    out = mine.select(F.col("from_id").alias("entity_id"), F.col("to_id").alias("other_id"))
    back = mine.select(F.col("to_id").alias("entity_id"), F.col("from_id").alias("other_id"))
    return out.unionByName(back).distinct()


def related_count(entities: DataFrame, edges: DataFrame, relation: str, others: DataFrame | None = None, key: str = "entity_id", name: str = "related") -> DataFrame:
    """`entities` with the number of different related ids (of `others`, if given); 0 without any."""
    pairs = neighbours(edges, relation)
    if others is not None:
        pairs = pairs.join(others.select(F.col(key).alias("other_id")), "other_id", "left_semi")
    counts = pairs.groupBy("entity_id").agg(F.count_distinct("other_id").alias(name))
    return entities.join(counts.withColumnRenamed("entity_id", key), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def related_sum(entities: DataFrame, edges: DataFrame, relation: str, values: DataFrame, key: str = "entity_id", name: str = "total") -> DataFrame:
    """`entities` with the sum of (`key`, value_num) rows of related entities; null without any."""
    sums = neighbours(edges, relation).join(values.select(F.col(key).alias("other_id"), "value_num"), "other_id").groupBy("entity_id").agg(F.sum("value_num").alias(name))
    return entities.join(sums.withColumnRenamed("entity_id", key), key, "left")


def saved_edges(edges: DataFrame, allowed: list[tuple[str, str, str]]) -> DataFrame:
    """Edges of allowed (from type, relation, to type), once per pair and page, confidence 0.6 where none is given."""
    rule = F.lit(False)
    for a, r, b in allowed:
        rule = rule | ((F.col("from_type") == a) & (F.col("relation") == r) & (F.col("to_type") == b))
    kept = edges.where(rule).withColumn("confidence", F.coalesce("confidence", F.lit(0.6)))
    return kept.dropDuplicates(["from_id", "relation", "to_id", "page_id"])


def coverage(values: DataFrame, fields: DataFrame, totals: DataFrame) -> DataFrame:
    """Per declared (entity_type, name): filled, derived and default entities, the total and the percentage filled."""
    ok = values.where("status = 'accepted'").groupBy("entity_type", "name").agg(
        F.count_distinct("entity_id").alias("filled"),
        F.count_distinct(F.when(F.col("origin").isin("derived", "inferred"), F.col("entity_id"))).alias("derived"),
        F.count_distinct(F.when(F.col("origin") == "default", F.col("entity_id"))).alias("defaults"),
    )
    both = fields.join(ok, ["entity_type", "name"], "left").join(totals, "entity_type", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("filled", "derived", "defaults", "total")}
    return both.withColumns(zero).withColumn("percent", F.coalesce(F.round(F.try_divide(100.0 * (F.col("filled") - F.col("defaults")), F.col("total").cast("double")), 1), F.lit(0.0)))


def gaps(entities: DataFrame, values: DataFrame, fields: DataFrame, key: str = "entity_id", examples: int = 8) -> DataFrame:
    """Per field: how many entities lack it and the first few of them by name, most missing first."""
    wanted = entities.join(fields, "entity_type").select(key, "canonical_name", "entity_type", "name")
    missing = wanted.join(values.where("status = 'accepted'").select(key, "name"), [key, "name"], "left_anti")
    order = Window.partitionBy("entity_type", "name").orderBy("canonical_name", key)
    # Only the few examples pass through the window; the count is a plain aggregate.
    counts = missing.groupBy("entity_type", "name").agg(F.count("*").alias("missing"))
    few = missing.withColumn("k", F.row_number().over(order)).where(F.col("k") <= examples).groupBy("entity_type", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "canonical_name"))), lambda x: x["canonical_name"]).alias("examples"))
    return counts.join(few, ["entity_type", "name"]).orderBy(F.desc("missing"), "entity_type", "name")


def source_health(pages: DataFrame, values: DataFrame, page: str = "page_id", domain: str = "domain") -> DataFrame:
    """Per domain: pages, values, values in review and superseded, best tier and mean confidence."""
    per_page = values.groupBy(page).agg(F.count("*").alias("v"), F.count_if(F.col("status") == "review").alias("r"), F.count_if(F.col("status") == "superseded").alias("s"), F.min("tier").alias("t"), F.sum("confidence").alias("c"), F.count("confidence").alias("n"))
    both = pages.select(page, domain).join(per_page, page, "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.groupBy(domain).agg(F.count_distinct(page).alias("pages"), zero("v").alias("values"), zero("r").alias("review"), zero("s").alias("superseded"), F.min("t").alias("best_tier"), F.round(F.try_divide(F.sum("c"), F.sum("n").cast("double")), 3).alias("confidence"))


def gold_accuracy(found: DataFrame, gold: DataFrame, keys: list[str], same: Column, high: float = 0.8) -> DataFrame:
    """One row: gold facts, found, correct, wrong, missing, coverage and accuracy in percent, accuracy where confident."""
    both = gold.join(found, keys, "left")
    hit, right = F.col("value").isNotNull(), F.coalesce(same, F.lit(False))
    sure = hit & (F.coalesce("confidence", F.lit(0.0)) >= high)
    percent = lambda a, b: F.round(F.try_divide(100.0 * a, b.cast("double")), 1)
    return both.agg(
        F.count("*").alias("total"), F.count_if(hit).alias("found"), F.count_if(hit & right).alias("correct"), F.count_if(hit & ~right).alias("wrong"), F.count_if(~hit).alias("missing"),
        percent(F.count_if(hit), F.count("*")).alias("coverage"), percent(F.count_if(hit & right), F.count_if(hit)).alias("accuracy"), percent(F.count_if(sure & right), F.count_if(sure)).alias("confident_accuracy"),
    )


def lineage(derived: DataFrame, values: DataFrame, pages: DataFrame) -> DataFrame:
    """Derived values with the values they came from and those values' pages: a row per input."""
    inputs = derived.select("value_id", "name", "value", F.explode("inputs").alias("input_id"))
    source = values.select(F.col("value_id").alias("input_id"), F.col("name").alias("input_name"), F.col("value").alias("input_value"), "page_id", "quote")
    return inputs.join(source, "input_id").join(pages.select("page_id", "url"), "page_id", "left")


def latest(rows: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """The newest row per key, whole; ties go to the greatest `tie`. A maximum of structs, so no window gathers a key."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max(F.struct(F.col(at).alias("_at"), F.col(tie).alias("_tie"), F.struct(*rest).alias("_row"))).alias("_b"))
    return best.select(*key, *[F.col(f"_b._row.{c}").alias(c) for c in rest])


def with_defaults(values: DataFrame, entities: DataFrame, defaults: dict[tuple[str, str], str], key: str = "entity_id") -> DataFrame:
    """`values` with declared defaults for entities that lack the field: origin default, confidence 0, never evidence."""
    spark = values.sparkSession
    wanted = spark.createDataFrame([(t, n, v) for (t, n), v in defaults.items()], "entity_type string, name string, value string")
    new = entities.select(key, "entity_type").join(F.broadcast(wanted), "entity_type").join(values.select(key, "name"), [key, "name"], "left_anti")
    made = new.withColumns({"origin": F.lit("default"), "confidence": F.lit(0.0), "status": F.lit("accepted")})
    return values.unionByName(made, allowMissingColumns=True)
