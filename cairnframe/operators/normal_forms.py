"""Normal forms: the tables of each level, and the checks that a table keeps to its level.

Every check is one or a few aggregations; nothing is collected but the verdicts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("0NF", "1NF", "2NF", "3NF", "BCNF", "4NF", "5NF", "6NF")
#: Suffixes of columns that describe other columns and take no part in dependencies.
METADATA = ("_confidence", "_origin", "_source", "_quote", "_fetched_at", "valid_from", "valid_to")


@dataclass
class Table:
    """An output table: its rows, key and kind (entity, junction, attribute, lookup or provenance)."""

    name: str
    df: DataFrame
    key: list[str]
    kind: str = "entity"
    derived: tuple[str, ...] = ()

    def payload(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.key and not c.endswith(METADATA)]


def determines(df: DataFrame, left: str, rights: list[str]) -> dict[str, bool]:
    """For each right column whether every value of `left` goes with one value of it (nulls aside), in one aggregation.

    Least and greatest value per group say it all, so a group of any size is combined before the
    shuffle.
    """
    if not rights:
        return {}
    groups = df.where(F.col(left).isNotNull()).groupBy(left).agg(*[F.min(r).alias(f"_a{i}") for i, r in enumerate(rights)], *[F.max(r).alias(f"_b{i}") for i, r in enumerate(rights)])
    row = groups.agg(*[F.coalesce(F.bool_and(F.coalesce(F.col(f"_a{i}") == F.col(f"_b{i}"), F.lit(True))), F.lit(True)).alias(f"_{i}") for i in range(len(rights))]).first()
    return {r: row[i] for i, r in enumerate(rights)}


def first_normal(t: Table) -> list[str]:
    """Cells with more than one value, and repeated rows."""
    texts = [c for c, k in t.df.dtypes if k == "string"]
    out = []
    if texts:
        row = t.df.agg(*[F.coalesce(F.bool_or(F.contains(c, F.lit("; "))), F.lit(False)).alias(c) for c in texts]).first()
        out += [f"{t.name}.{c} holds more than one value" for c in texts if row[c]]
    repeated = t.df.groupBy(*t.df.columns).agg(F.count("*").alias("_n")).where("_n > 1").limit(1)
    return out + ([f"{t.name} has duplicate rows"] if not repeated.isEmpty() else [])


def partial_dependencies(t: Table) -> list[str]:
    """Columns that depend on one part of a composite key; key parts that are null or unique throughout are no evidence."""
    out = []
    if len(t.key) < 2 or not t.payload():
        return out
    for part in t.key:
        n = t.df.agg(F.count(part).alias("n"), F.count_distinct(part).alias("d")).first()
        if not n["n"] or n["n"] == n["d"]:
            continue
        out += [f"{t.name}: {c!r} depends on {part!r} alone" for c, yes in determines(t.df, part, t.payload()).items() if yes]
    return out


def transitive_dependencies(t: Table) -> list[str]:
    """Non-key columns that look determined by another non-key column, on strong evidence only.

    The determinant has at least two values and three repeated ones, at most half as many values
    as rows, and at least half of the rows in repeats; the dependent has more than one image over
    at least three of its values.
    """
    columns = [c for c in t.payload() if not c.endswith("_id") and c not in t.derived]
    total = t.df.count()
    out = []
    if total < 3 or len(columns) < 2:
        return out
    for left in columns:
        counts = t.df.where(F.col(left).isNotNull() & (F.col(left).cast("string") != "")).groupBy(left).agg(F.count("*").alias("n"))
        s = counts.agg(F.count("*").alias("d"), F.count_if(F.col("n") > 1).alias("r"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows")).first()
        if s["d"] < 2 or s["r"] < 3 or s["d"] > 0.5 * total or s["rows"] < 0.5 * total:
            continue
        for right, yes in determines(t.df, left, [c for c in columns if c != left]).items():
            if yes:
                images = t.df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).agg(F.count_distinct(left).alias("l"), F.count_distinct(right).alias("r")).first()
                if images["l"] >= 3 and images["r"] > 1:
                    out.append(f"{t.name}: {right!r} looks determined by non-key {left!r}")
    return out


def determinants(t: Table) -> list[str]:
    """Repeated values that fix another column although their column is no superkey."""
    columns = [c for c in t.df.columns if not c.endswith(METADATA)]
    out = []
    for left in columns:
        repeated = t.df.where(F.col(left).isNotNull()).groupBy(left).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
        if repeated.isEmpty():
            continue
        rows = t.df.join(repeated, left, "left_semi")
        out += [f"{t.name}: {left!r} determines {c!r} but is not a superkey" for c, yes in determines(rows, left, [c for c in columns if c != left]).items() if yes]
    return out


def multivalued(t: Table) -> list[str]:
    """Of three columns X, Y, Z: whether Y and Z are independent facts about X, each X holding all its combinations."""
    columns = [c for c in t.df.columns if not c.endswith(METADATA)]
    out = []
    if len(columns) != 3:
        return out
    for x in columns:
        y, z = (c for c in columns if c != x)
        groups = t.df.select(*columns).distinct().groupBy(x).agg(F.count("*").alias("p"), F.count_distinct(F.coalesce(F.col(y).cast("string"), F.lit(""))).alias("y"), F.count_distinct(F.coalesce(F.col(z).cast("string"), F.lit(""))).alias("z"))
        s = groups.agg(F.bool_and(F.col("p") == F.col("y") * F.col("z")).alias("full"), F.bool_or((F.col("y") > 1) & (F.col("z") > 1)).alias("wide")).first()
        if s["full"] and s["wide"]:
            out.append(f"{t.name}: {y!r} and {z!r} are independent facts about {x!r}")
    return out


def spurious_rows(df: DataFrame, key: list[str]) -> int:
    """How many rows the join of the three pair projections makes that the table does not have."""
    a, b, c = key
    rows = df.select(*key).distinct()
    rejoined = rows.select(a, b).distinct().join(rows.select(a, c).distinct(), a).join(rows.select(b, c).distinct(), [b, c])
    return rejoined.select(*key).distinct().count() - rows.count()


def check(tables: list[Table], level: str) -> list[str]:
    """What keeps the tables from their level; nothing means they pass. Provenance tables are not checked."""
    at, problems = LEVELS.index(level), []
    for t in (t for t in tables if t.kind != "provenance"):
        steps = []
        if at >= 1:
            steps.append(first_normal(t))
        if at >= 2:
            steps.append(([f"{t.name} keeps {t.payload()} beside a composite key"] if t.kind == "junction" and len(t.key) > 1 and t.payload() else []) + partial_dependencies(t))
        if at >= 3:
            steps.append(transitive_dependencies(t))
        if at >= 4:
            steps.append(determinants(t))
        if at >= 5:
            ids = [c for c in t.df.columns if c.endswith("_id") and c not in t.key]
            steps.append(([f"{t.name} mixes independent many-valued facts {ids}"] if t.kind == "entity" and len(ids) > 1 else []) + multivalued(t))
        if at >= 6 and t.kind == "junction" and len(t.key) == 3 and (n := spurious_rows(t.df, t.key)) > 0:
            steps.append([f"{t.name}: the pairwise join creates {n} rows that never were"])
        if at >= 7 and t.kind == "entity" and len(t.payload()) > 1:
            steps.append([f"{t.name} has {len(t.payload())} attributes; 6NF allows one"])
        problems += [p for s in steps for p in s]
    return problems


def flat_table(entity: DataFrame, key: str, children: dict[str, DataFrame], separator: str = "; ") -> DataFrame:
    """0NF: the primary entity with each child's or related name's values joined into one cell."""
    joined = [c.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.col(n).cast("string"))), separator).alias(n)) for n, c in children.items()]
    return reduce(lambda a, b: a.join(b, key, "left"), joined, entity)


def attribute_tables(values: DataFrame, fields: list[str], key: str = "entity_id") -> dict[str, DataFrame]:
    """6NF: one table per attribute, `key` and its value with its validity."""
    empty = F.lit(None).cast("string")
    return {f: values.where(F.col("name") == f).select(key, F.col("value").alias(f), empty.alias("valid_from"), empty.alias("valid_to")).distinct() for f in fields}


def named_junction(pairs: DataFrame, names: DataFrame, from_id: str, to_id: str) -> DataFrame:
    """2NF: a junction of two ids with the second's name beside it, which depends on part of the key only."""
    return pairs.select(from_id, to_id).distinct().join(names.select(F.col("entity_id").alias(to_id), F.col("canonical_name").alias(f"{to_id.removesuffix('_id')}_name")), to_id, "left").select(from_id, to_id, f"{to_id.removesuffix('_id')}_name")


def junction(pairs: DataFrame, accepted_from: DataFrame, accepted_to: DataFrame, from_id: str, to_id: str) -> DataFrame:
    """Pairs of ids both of which are accepted, each once."""
    kept = pairs.join(accepted_from.select(F.col("entity_id").alias(from_id)), from_id, "left_semi")
    return kept.join(accepted_to.select(F.col("entity_id").alias(to_id)), to_id, "left_semi").select(from_id, to_id).distinct()


def accepted_ids(values: DataFrame, entity_type: str | None = None) -> DataFrame:
    """Entities that have an accepted value."""
    mine = values.where("status = 'accepted'")
    return (mine.where(F.col("entity_type") == entity_type) if entity_type else mine).select("entity_id").distinct()


def provenance(values: DataFrame, pages: DataFrame, key: str = "entity_id") -> DataFrame:
    """Where each accepted value comes from; values without a page keep their row with null address and time."""
    told = values.where("status = 'accepted'").select(key, "name", "value", "origin", "confidence", "tier", "quote", "page_id")
    return told.join(pages.select("page_id", "url", "fetched_at"), "page_id", "left").select(key, "name", "value", "origin", "confidence", "tier", "quote", "url", "fetched_at")


def identifiers(registry: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, authority, identifier): registry rows (name, authority, identifier) by an entity's name or an alias, in any case.

    Two equal joins instead of one on either, so neither becomes a nested loop.
    """
    names = entities.select("entity_id", F.lower(F.trim("canonical_name")).alias("_k")).unionByName(aliases.select("entity_id", F.lower(F.trim("alias")).alias("_k")))
    return registry.withColumn("_k", F.lower(F.trim("name"))).join(names.where("_k <> ''").distinct(), "_k").select("entity_id", "authority", "identifier").distinct()
