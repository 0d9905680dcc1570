"""The build: candidates to standard values, entities, resolved cells, derived columns and checked tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnframe.functions import standard as S
from cairnframe.functions.text import let
from cairnframe.operators import conflict, evidence, resolution
from cairnframe.operators import values as V
from cairnframe.operators.derive import derive
from cairnframe.operators.normal_forms import Table, check
from cairnframe.operators.relations import with_defaults
from cairnframe.plans.spec import FieldSpec, Spec
from cairnframe.session import cut


# Words of the names of fields that hold amounts of money.
MONEY = ("price", "cost", "amount", "fee", "salary", "revenue", "budget", "wage")


@dataclass
class Dataset:
    values: DataFrame
    entities: DataFrame
    rejects: DataFrame
    tables: list[Table] = field(default_factory=list)
    problems: list[str] = field(default_factory=list)
    aliases: DataFrame | None = None
    notes: DataFrame | None = None


def standard_value(f: FieldSpec, raw: Column, spec: Spec) -> Column:
    """struct(value, num, high, unit, problem) of a raw text as the field's type."""
    return let(S.normal(raw), lambda text: _standard(f, text, spec))


def _standard(f: FieldSpec, text: Column, spec: Spec) -> Column:
    none = F.lit(None)

    def made(value, num=None, high=None, unit=None, problem=None) -> Column:
        number = lambda c: (c if c is not None else none).cast("double")
        word = lambda c: (c if c is not None else none).cast("string")
        return F.struct(value.alias("value"), number(num).alias("num"), number(high).alias("high"), word(unit).alias("unit"), word(problem).alias("problem"))

    if spec.standard == "raw" or f.type in ("text", "category", "url"):
        return made(text)
    if f.type in ("number", "range"):
        if (f.unit or "").upper() in S.CURRENCIES or (not f.unit and any(w in f.name for w in MONEY)):
            return let(S.money(text, (f.unit or spec.currency or "").upper() or None, spec.rates), lambda m: made(S.display(m["amount"]), m["amount"], None, m["currency"], F.coalesce(m["problem"], F.when(m["amount"].isNull(), "no number found in the value"))))
        shown = lambda m: F.when(m["hi"].isNotNull(), F.concat(S.display(m["lo"]), F.lit("-"), S.display(m["hi"]))).otherwise(S.display(m["lo"]))
        return let(S.measured(text, f.unit), lambda m: made(shown(m), m["lo"], m["hi"], m["unit"], F.when(m["lo"].isNull(), "no number found in the value")))
    if f.type == "date":
        return let(S.iso_date(text), lambda iso: made(iso, problem=F.when(iso.isNull(), "could not read a date")))
    if f.type == "month":
        return let(S.month_of(text), lambda m: made(F.try_element_at(F.array(*[F.lit(x) for x in S.MONTHS]), m), m, problem=F.when(m.isNull(), "could not read a month")))
    if f.type == "year":
        return let(F.substring(S.iso_date(text), 1, 4).try_cast("int"), lambda y: made(y.cast("string"), y, problem=F.when(y.isNull(), "could not read a year")))
    return made(S.boolean(text))


def standardized(candidates: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) candidates with value, value_num, value_max and unit; rejected ones with a reason."""
    std, sane = None, None
    for e in spec.entities:
        for f in e.fields:
            mine = (F.col("entity_type") == e.name) & (F.col("name") == f.name)
            value = standard_value(f, F.col("raw_value"), spec)
            std = F.when(mine, value) if std is None else std.when(mine, value)
    # Inlining the struct keeps its one expression from being repeated for each of its fields.
    flat = candidates.select(*candidates.columns, F.inline(F.array_compact(F.array(std)))).withColumnsRenamed({"num": "value_num", "high": "value_max", "problem": "reason"})
    for e in spec.entities:
        for f in e.fields:
            if f.sanity is not None:
                mine = (F.col("entity_type") == e.name) & (F.col("name") == f.name) & ~evidence.sane(F.col("value_num"), F.col("value_max"), F.col("value"), f.sanity)
                sane = mine if sane is None else sane | mine
    if sane is not None:
        flat = flat.withColumn("reason", F.coalesce("reason", F.when(sane, "outside the allowed values")))
    return flat.where("reason is null").drop("reason"), flat.where("reason is not null")


def build(candidates: DataFrame, spec: Spec, aliases: DataFrame | None = None, relations: DataFrame | None = None, fuzzy: bool = True, vocabulary: DataFrame | None = None) -> Dataset:
    """A dataset out of candidates (entity_type, identity, name, raw_value, tier, domain, fetched_at, origin, seq).

    Stages: trust the sites as the project file does, standardize and check limits and
    vocabularies, resolve entities, group and settle each cell (a site in `authority` decides its
    fields), score confidence, hold back what lies below the floor, name entities by their label,
    fill declared defaults, pivot, derive, check the level. The shuffles are those of entity
    resolution, of the cells and of the pivot. `vocabulary` are (vocabulary, term, alias) rows;
    a strict project refuses values outside their field's vocabulary.
    """
    if spec.tiers:
        candidates = candidates.withColumn("tier", F.coalesce(*[F.when((F.lower("domain") == t.lower()) | F.endswith(F.lower("domain"), F.lit("." + t.lower())), F.lit(int(n))) for t, n in sorted(spec.tiers.items(), key=lambda kv: -len(kv[0]))], F.col("tier").cast("int")))
    kept, rejects = standardized(candidates, spec)
    if vocabulary is not None:
        kept, refused = in_vocabulary(kept, vocabulary, spec)
        rejects = rejects.unionByName(refused, allowMissingColumns=True)
    inexact = [e.name for e in spec.entities if not e.fuzzy]
    placed = resolution.resolve(kept.where(~F.col("entity_type").isin(*inexact)) if inexact else kept, aliases, fuzzy=fuzzy)
    if inexact:
        placed = placed.unionByName(resolution.resolve(kept.where(F.col("entity_type").isin(*inexact)), aliases, fuzzy=False))
    placed = cut(placed.where("entity_id is not null"))
    entities = placed.groupBy("entity_id", "entity_type").agg(F.first("canonical_name").alias("canonical_name"))
    # Values of a field declared multiple do not compete: each is a cell of its own.
    many = F.lit(False)
    for e in spec.entities:
        for f in e.fields:
            if f.multiple:
                many = many | ((F.col("entity_type") == e.name) & (F.col("name") == f.name))
    apart = placed.withColumn("_own", F.when(many, F.lower(F.trim("value"))).otherwise(""))
    cells = conflict.resolved(apart, ["entity_type", "entity_id", "name", "_own"], spec.conflict, spec.trusted, spec.authority).drop("_own")
    # Tables and their checks read the settled cells many times over, so the lineage is cut here.
    settled = cut(conflict.held_back(cells.withColumn("origin", F.lit("extracted")), spec.floor))
    entities, former = labelled(entities, settled, spec)
    defaults = {(e.name, f.name): f.default for e in spec.entities for f in e.fields if f.default is not None}
    if defaults:
        settled = with_defaults(settled, entities, defaults)
    tables = []
    for e in spec.entities:
        mine = settled.where((F.col("entity_type") == e.name) & (F.col("status") == "accepted"))
        single = [f for f in e.fields if not f.multiple]
        numeric = {f.name for f in single if f.type in ("number", "year", "month")}
        wide = V.to_wide(mine, [f.name for f in single])
        wide = wide.withColumns({f: F.col(f).try_cast("double") for f in numeric}) if numeric else wide
        named = wide.join(entities.where(F.col("entity_type") == e.name).select("entity_id", "canonical_name"), "entity_id")
        extra = spec.derived.get(e.name, [])
        full = cut(derive(named, extra) if extra else named)
        # A field of that very name keeps it; the key then gives way.
        key = f"{e.name}_id" if e.field(f"{e.name}_id") is None else f"{e.name}_key"
        tables.append(Table(e.name, full.withColumnRenamed("entity_id", key), [key], "entity", tuple(d.name for d in extra)))
        for f in e.fields:
            if f.multiple:
                rows = mine.where(F.col("name") == f.name).select(F.col("entity_id").alias(key), F.col("value").alias(f.name)).distinct()
                tables.append(Table(f"{e.name}_{f.name}", rows, [key, f.name], "attribute"))
    if relations is not None:
        for a, r, b in spec.relations:
            pairs = relations.where(F.col("relation") == r).select(F.col("from_id").alias(f"{a}_id"), F.col("to_id").alias(f"{b}_id")).distinct()
            tables.append(Table(f"{a}_{r}_{b}", pairs, [f"{a}_id", f"{b}_id"], "junction"))
    notes = conflict.disputed_by_trusted(settled, ["entity_type", "entity_id", "name"])
    return Dataset(settled, entities, rejects, tables, check(tables, spec.level) if spec.level != "0NF" else [], former, notes)


def in_vocabulary(kept: DataFrame, vocabulary: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """(kept, refused): values of fields with a vocabulary as its terms; a strict project refuses others, else they stay as written."""
    listed = [(e.name, f.name, f.vocabulary) for e in spec.entities for f in e.fields if f.vocabulary]
    if not listed:
        return kept, kept.where("false").withColumn("reason", F.lit(""))
    mine = kept.sparkSession.createDataFrame(listed, "entity_type string, name string, vocabulary string")
    key = S.comparison_key(F.col("alias"))
    terms = vocabulary.select("vocabulary", "term", "alias").unionByName(vocabulary.select("vocabulary", "term", F.col("term").alias("alias"))).groupBy("vocabulary", key.alias("_k")).agg(F.min("term").alias("_term"))
    both = kept.join(F.broadcast(mine), ["entity_type", "name"], "left").withColumn("_k", S.comparison_key(F.col("value"))).join(terms, ["vocabulary", "_k"], "left")
    strict = F.lit(spec.standard == "strict") & F.col("vocabulary").isNotNull() & F.col("_term").isNull()
    done = both.withColumn("value", F.coalesce("_term", "value")).withColumn("_out", strict).drop("_k", "_term", "vocabulary")
    return done.where("not _out").drop("_out"), done.where("_out").drop("_out").withColumn("reason", F.lit("not in the vocabulary"))


def labelled(entities: DataFrame, values: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """(entities, aliases): entities with a label field are named by its most confident value, and keep their identity as an alias."""
    labels = F.lit(False)
    for e in spec.entities:
        if e.label:
            labels = labels | ((F.col("entity_type") == e.name) & (F.col("name") == e.label))
    best = values.where(labels & (F.col("status") == "accepted")).groupBy("entity_id").agg(F.max_by("value", F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("group"))).alias("_label"))
    both = entities.join(best, "entity_id", "left")
    former = both.where(F.col("_label").isNotNull() & (F.col("_label") != F.col("canonical_name"))).select("entity_id", F.col("canonical_name").alias("alias"))
    return both.withColumn("canonical_name", F.coalesce("_label", "canonical_name")).drop("_label"), former
