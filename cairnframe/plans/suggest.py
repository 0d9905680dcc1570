"""Derived columns that a project could have: conversions, midpoints, counts, seasons. None is applied by itself."""

from __future__ import annotations

from dataclasses import dataclass

from cairnframe.functions.standard import unit_table
from cairnframe.plans.spec import EntitySpec, Spec


@dataclass(frozen=True)
class Suggestion:
    """A formula for an unfilled field; `safe` ones follow from the project file alone."""

    entity: str
    field: str
    formula: str
    safe: bool


def _base(name: str) -> tuple[str, str | None]:
    head, _, tail = name.rpartition("_")
    return (head, tail) if head and tail in unit_table() else (name, None)


def suggestions(spec: Spec, filled: dict[str, int]) -> list[Suggestion]:
    """Suggestions for the fields of every entity without values; `filled` counts values by "entity.field"."""
    out = []
    for e in spec.entities:
        have = [f for f in e.fields if filled.get(f"{e.name}.{f.name}")]
        for f in e.fields:
            if not filled.get(f"{e.name}.{f.name}") and (s := _one(spec, e, f.name, [h.name for h in have])):
                out.append(s)
    return out


def _one(spec: Spec, e: EntitySpec, name: str, have: list[str]) -> Suggestion | None:
    base, unit = _base(name)
    for h in have:
        other, from_unit = _base(h)
        if unit and from_unit and base == other and unit_table()[unit][0] == unit_table()[from_unit][0]:
            return Suggestion(e.name, name, f"convert({h}, '{from_unit}', '{unit}')", True)
        if name == f"{h}_midpoint" or name == f"mid_{h}":
            return Suggestion(e.name, name, f"midpoint({h}.min, {h}.max)", True)
        if name.endswith("_year") and h == name.removesuffix("_year") + "_date":
            return Suggestion(e.name, name, f"year_of({h})", True)
        field = e.field(h)
        if "season" in name and field is not None and field.type == "month":
            return Suggestion(e.name, name, f"season_of({h}, '{spec.seasons}')", spec.seasons != "northern")
    for a, r, b in spec.relations:
        far = b if a == e.name else a if b == e.name else None
        if far and far in name and any(w in name for w in ("count", "number", "total")):
            return Suggestion(e.name, name, f"count({far} via {r})", True)
    return None


#: The columns of stored suggestions.
STORED = "entity string, field string, formula string, safe boolean, status string"


def stored(spark, new: list[Suggestion], before=None):
    """Stored suggestions with new ones as pending; what was decided about the same field stays decided."""
    fresh = spark.createDataFrame([(s.entity, s.field, s.formula, s.safe, "pending") for s in new], STORED)
    if before is None:
        return fresh
    decided = before.where("status <> 'pending'")
    return decided.unionByName(fresh.join(decided.select("entity", "field"), ["entity", "field"], "left_anti"))


def decided(suggestions_, entity: str, field: str, status: str):
    """Stored suggestions with one approved or rejected."""
    from pyspark.sql import functions as F

    if status not in ("approved", "rejected"):
        raise ValueError(f"unknown decision {status!r}")
    mine = (F.col("entity") == entity) & (F.col("field") == field)
    return suggestions_.withColumn("status", F.when(mine, status).otherwise(F.col("status")))


def applied(new: list[Suggestion], policy: str) -> tuple[list[Suggestion], list[Suggestion]]:
    """(to apply, to ask about) under a policy: auto_safe applies safe ones, suggest asks about all, off forgets them."""
    if policy not in ("auto_safe", "suggest", "off"):
        raise ValueError(f"unknown policy {policy!r}")
    if policy == "off":
        return [], []
    now = [s for s in new if s.safe] if policy == "auto_safe" else []
    return now, [s for s in new if s not in now]


def with_derivation(text: str, entity: str, name: str, formula: str) -> str:
    """A project file's text with one more derived column; everything else, comments too, stays as it is."""
    lines, quoted = text.splitlines(), '"' + formula.replace("\\", "\\\\").replace('"', '\\"') + '"'
    indent = lambda i: len(lines[i]) - len(lines[i].lstrip())
    top = next((i for i, x in enumerate(lines) if x.split("#")[0].rstrip() == "derived:"), None)
    if top is None:
        return "\n".join([*lines, "derived:", f"  {entity}:", f"    {name}: {quoted}"]) + "\n"
    end = next((i for i in range(top + 1, len(lines)) if lines[i].strip() and not lines[i].lstrip().startswith("#") and indent(i) == 0), len(lines))
    at = next((i for i in range(top + 1, end) if lines[i].split("#")[0].strip() == f"{entity}:"), None)
    if at is None:
        return "\n".join([*lines[: top + 1], f"  {entity}:", f"    {name}: {quoted}", *lines[top + 1 :]]) + "\n"
    return "\n".join([*lines[: at + 1], " " * (indent(at) + 2) + f"{name}: {quoted}", *lines[at + 1 :]]) + "\n"
