"""The project file: entities, fields, relations, derived columns and targets, validated before use."""

from __future__ import annotations

import difflib
from dataclasses import dataclass, field
from pathlib import Path

from cairnframe.functions.formula import FormulaError, parsed
from cairnframe.operators.derive import Derivation, needs
from cairnframe.operators.normal_forms import LEVELS

# Fixed values of the project file.
TYPES = ("text", "number", "range", "date", "month", "year", "bool", "url", "category")
STANDARDS = ("raw", "standard", "strict")
CONFLICTS = ("keep_all_and_flag", "majority", "trusted_first", "newest")
MISSING = ("leave_empty", "use_fallback", "partial")


@dataclass
class FieldSpec:
    name: str
    type: str = "text"
    unit: str | None = None
    multiple: bool = False
    required: bool = False
    sanity: list | None = None
    vocabulary: str | None = None
    rules: list[str] = field(default_factory=list)
    default: str | None = None


@dataclass
class EntitySpec:
    name: str
    identity: list[str]
    fields: list[FieldSpec]
    aliases_from: list[str] = field(default_factory=list)
    label: str | None = None
    fuzzy: bool = True

    def field(self, name: str) -> FieldSpec | None:
        return next((f for f in self.fields if f.name == name), None)


@dataclass
class Problem:
    level: str
    where: str
    message: str


@dataclass
class Spec:
    project: str
    entities: list[EntitySpec]
    relations: list[tuple[str, str, str]] = field(default_factory=list)
    derived: dict[str, list[Derivation]] = field(default_factory=dict)
    tiers: dict[str, int] = field(default_factory=dict)
    conflict: str = "keep_all_and_flag"
    trusted: list[str] = field(default_factory=list)
    authority: dict[str, list[str]] = field(default_factory=dict)
    level: str = "3NF"
    floor: float = 0.5
    currency: str | None = None
    rates: dict[str, float] = field(default_factory=dict)
    standard: str = "standard"
    seasons: str = "northern"

    @property
    def primary(self) -> EntitySpec:
        """The first entity of the file; rules fill only this one."""
        return self.entities[0]

    def entity(self, name: str) -> EntitySpec | None:
        return next((e for e in self.entities if e.name == name), None)


def _field(raw) -> FieldSpec:
    if isinstance(raw, str):
        return FieldSpec(raw)
    known = {k: v for k, v in raw.items() if k in FieldSpec.__dataclass_fields__}
    rules = raw.get("rules", raw.get("rule", raw.get("extract", [])))
    return FieldSpec(**(known | {"rules": [rules] if isinstance(rules, str) else list(rules)}))


def from_dict(raw: dict) -> Spec:
    """A Spec out of parsed YAML; shorthands are allowed for fields, entities and relations."""
    entities = []
    for name, e in (raw.get("entities") or {}).items():
        e = {"fields": e} if isinstance(e, list) else e
        fields = [_field(f) for f in (e.get("fields") or [])]
        identity = e.get("identity") or ([fields[0].name] if fields else [])
        entities.append(EntitySpec(name, [identity] if isinstance(identity, str) else list(identity), fields, list(e.get("aliases_from") or []), e.get("label"), bool(e.get("fuzzy", True))))
    relations = [tuple(r.split()) if isinstance(r, str) else (r["from"], r["name"], r["to"]) for r in raw.get("relations") or []]
    derived = {}
    for entity, items in (raw.get("derived") or {}).items():
        derived[entity] = [Derivation(name=n, **({"formula": d} if isinstance(d, str) else {k: tuple(map(tuple, v)) if k == "rules" else tuple(v) if isinstance(v, list) else v for k, v in d.items()})) for n, d in items.items()]
    output, std = raw.get("output") or {}, raw.get("standardize") or {}
    return Spec(
        project=str(raw.get("project", "dataset")), entities=entities, relations=relations, derived=derived, tiers=raw.get("tiers") or {},
        conflict=raw.get("conflict", "keep_all_and_flag"), trusted=raw.get("trusted") or [], authority=raw.get("authority") or {}, level=output.get("level", "3NF"),
        floor=float(raw.get("min_confidence", 0.5)), currency=std.get("currency"), rates=std.get("rates") or {}, standard=std.get("level", "standard"), seasons=std.get("seasons", "northern"),
    )


def load(path: str) -> Spec:
    import yaml

    return from_dict(yaml.safe_load(Path(path).read_text()))


def validate(spec: Spec) -> list[Problem]:
    """Everything that would make a build fail or mean nothing."""
    out: list[Problem] = []
    error = lambda where, message: out.append(Problem("error", where, message))
    if not spec.entities:
        error("entities", "no entity is declared")
    names = [e.name for e in spec.entities]
    for n in {n for n in names if names.count(n) > 1}:
        error(n, "the entity is declared twice")
    for e in spec.entities:
        fields = [f.name for f in e.fields]
        for f in e.fields:
            at = f"{e.name}.{f.name}"
            if f.type not in TYPES:
                near = difflib.get_close_matches(f.type, TYPES, 1)
                error(at, f"unknown type {f.type!r}" + (f"; did you mean {near[0]}?" if near else ""))
            if fields.count(f.name) > 1:
                error(at, "the field is declared twice")
            if f.sanity is not None and len(f.sanity) == 2 and all(isinstance(x, (int, float)) for x in f.sanity) and f.sanity[0] > f.sanity[1]:
                error(at, "the sanity range ends before it begins")
        for i in e.identity:
            if i not in fields:
                error(e.name, f"the identity {i!r} is no field")
        if not e.identity:
            error(e.name, "no identity")
    for a, r, b in spec.relations:
        for x in (a, b):
            if x not in names:
                error(f"relation {r}", f"unknown entity {x!r}")
    for entity, items in spec.derived.items():
        if entity not in names:
            error(f"derived {entity}", "unknown entity")
            continue
        known = {f.name for f in spec.entity(entity).fields} | {d.name for d in items}
        for d in items:
            at = f"{entity}.{d.name}"
            try:
                if d.formula:
                    parsed(d.formula)
                for n in sorted(needs(d) - known):
                    error(at, f"unknown field {n!r}")
            except FormulaError as e2:
                error(at, str(e2))
            if d.if_missing not in MISSING:
                error(at, f"unknown if_missing {d.if_missing!r}")
        for cycle in cycles(items):
            error(f"derived {entity}", "columns need one another: " + " → ".join(cycle))
    if spec.conflict not in CONFLICTS:
        error("conflict", f"unknown rule {spec.conflict!r}")
    if spec.level not in LEVELS:
        error("output.level", f"unknown level {spec.level!r}")
    if spec.standard not in STANDARDS:
        error("standardize.level", f"unknown level {spec.standard!r}")
    return out


def cycles(items: list[Derivation]) -> list[list[str]]:
    """Circles of derived columns that need one another."""
    edges = {d.name: sorted(needs(d) & {x.name for x in items}) for d in items}
    found, done = [], set()

    def walk(n: str, path: list[str]) -> None:
        if n in path:
            found.append([*path[path.index(n) :], n])
            return
        if n in done:
            return
        for m in edges.get(n, []):
            walk(m, [*path, n])
        done.add(n)

    for n in edges:
        walk(n, [])
    return found
