"""A first project file out of example rows, SQL definitions or a JSON schema."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnframe.functions.standard import iso_date, month_of, unit_table
from cairnframe.plans.spec import EntitySpec, FieldSpec


def guessed_types(df: DataFrame) -> dict[str, str]:
    """Each column's type by all of its values: number, range, date, month, bool or url where every value fits, else text."""
    tests = []
    for c in df.columns:
        v = F.trim(F.col(c).cast("string"))
        some = v.isNotNull() & (v != "")
        fits = {
            "number": v.rlike(r"^[-+]?\d[\d,]*(\.\d+)?([eE][-+]?\d+)?(\s*[a-zA-Z°%]+)?$"),
            "range": v.rlike(r"^\d[\d,.]*\s*(-|–|to)\s*\d[\d,.]*(\s*[a-zA-Z°%]+)?$"),
            "date": v.rlike(r"\d{4}") & (F.length(iso_date(v)) == 10),
            "month": month_of(v).isNotNull(),
            "bool": F.lower(v).isin("true", "false", "yes", "no", "y", "n"),
            "url": v.rlike(r"^https?://\S+$"),
        }
        tests += [F.bool_and(F.when(some, t)).alias(f"{c}\0{k}") for k, t in fits.items()]
    row = df.agg(*tests).first().asDict()
    order = ("number", "date", "range", "month", "bool", "url")
    return {c: next((k for k in order if row[f"{c}\0{k}"]), "text") for c in df.columns}


def heading(text: str) -> tuple[str, str | None]:
    """A field name and unit out of a column heading: "Height (m)" is height in m."""
    unit = re.search(r"[(\[]\s*([^)\]]+?)\s*[)\]]", text)
    plain = re.sub(r"[(\[][^)\]]*[)\]]", " ", text)
    name = re.sub(r"[^0-9a-zA-Z]+", "_", plain).strip("_").lower() or "field"
    return name, unit[1] if unit and unit[1].lower() in unit_table() else None


def identity(df: DataFrame, types: dict[str, str]) -> str | None:
    """The first text or url column whose values are all there and all different."""
    columns = [c for c in df.columns if types[c] in ("text", "url")]
    if not columns:
        return None
    row = df.agg(F.count("*").alias("_n"), *[F.count_distinct(c).alias(c) for c in columns]).first()
    return next((c for c in columns if row[c] == row["_n"]), None)


def from_rows(df: DataFrame, name: str) -> EntitySpec:
    types = guessed_types(df)
    fields = []
    for c in df.columns:
        n, unit = heading(c)
        fields.append(FieldSpec(n, types[c], unit))
    key = identity(df, types)
    return EntitySpec(name, [heading(key)[0]] if key else [fields[0].name], fields)


def from_ddl(text: str) -> list[EntitySpec]:
    """Entities of CREATE TABLE statements."""
    out = []
    for name, body in re.findall(r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[\"`\[]?(\w+)[\"`\]]?\s*\((.*?)\)\s*;", text + ";"):
        fields, keys = [], []
        for part in re.split(r",(?![^(]*\))", body):
            words = part.split()
            if not words:
                continue
            head = words[0].strip('"`[]')
            if head.upper() in ("PRIMARY", "FOREIGN", "UNIQUE", "CONSTRAINT", "CHECK", "KEY"):
                keys += re.findall(r"\w+", part[part.find("(") + 1 : part.find(")")]) if head.upper() == "PRIMARY" else []
                continue
            kind = (words[1] if len(words) > 1 else "text").lower()
            fields.append(FieldSpec(head, "number" if re.match(r"int|real|num|dec|float|double|bigint|small", kind) else "date" if kind.startswith("date") else "bool" if kind.startswith("bool") else "text", required="not null" in part.lower()))
            if "primary key" in part.lower():
                keys.append(head)
        if fields:
            out.append(EntitySpec(name, keys or [fields[0].name], fields))
    return out


def from_json_schema(schema: dict, name: str = "record") -> EntitySpec:
    kinds = {"integer": "number", "number": "number", "boolean": "bool"}
    required = set(schema.get("required", []))
    fields = []
    for n, p in schema.get("properties", {}).items():
        items = p.get("items", p) if p.get("type") == "array" else p
        kind = "date" if items.get("format") in ("date", "date-time") else "url" if items.get("format") == "uri" else kinds.get(items.get("type"), "text")
        fields.append(FieldSpec(n, kind, multiple=p.get("type") == "array", required=n in required))
    return EntitySpec(schema.get("title", name), [next((f.name for f in fields if f.required), fields[0].name)] if fields else [], fields)


def from_sqlite(path: str) -> tuple[list[EntitySpec], list[tuple[str, str, str]]]:
    """(entities, relations) of a SQLite file: its tables and their foreign keys, read from the catalogue alone."""
    import sqlite3

    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        tables = [r[0] for r in db.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name")]
        entities, relations = [], []
        for t in tables:
            columns = db.execute(f'pragma table_info("{t}")').fetchall()
            kind = lambda declared: "number" if re.match(r"(?i)int|real|num|dec|float|double", declared or "") else "date" if re.match(r"(?i)date|time", declared or "") else "bool" if re.match(r"(?i)bool", declared or "") else "text"
            keys = [c[1] for c in sorted(columns, key=lambda c: c[5]) if c[5]]
            entities.append(EntitySpec(t, keys or [columns[0][1]], [FieldSpec(c[1], kind(c[2]), required=bool(c[3])) for c in columns]))
            relations += [(t, f"has_{f[2]}", f[2]) for f in db.execute(f'pragma foreign_key_list("{t}")')]
        return entities, list(dict.fromkeys(relations))
    finally:
        db.close()


def imported(path: str, name: str = "record") -> tuple[list[EntitySpec], list[tuple[str, str, str]]]:
    """(entities, relations) of a structure file, by its suffix: SQL definitions, a JSON schema or a SQLite file."""
    import json
    from pathlib import Path

    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "sql":
        return from_ddl(Path(path).read_text()), []
    if suffix == "json":
        return [from_json_schema(json.loads(Path(path).read_text()), name)], []
    if suffix in ("db", "sqlite", "sqlite3"):
        return from_sqlite(path)
    raise ValueError(f"no structure can be read from {path}")


def questions(entities: list[EntitySpec], most: int = 5) -> list[dict]:
    """What is unclear in a draft, the most important first: identities, units of numbers, fields that may hold several values."""
    out = []
    for e in entities:
        if not e.identity:
            out.append({"entity": e.name, "ask": "identity", "text": f"Which field tells one {e.name} from another?", "options": [f.name for f in e.fields]})
    for e in entities:
        out += [{"entity": e.name, "field": f.name, "ask": "unit", "text": f"In which unit is {f.name} of {e.name}?", "options": []} for f in e.fields if f.type in ("number", "range") and not f.unit and any(w in f.name for w in ("height", "length", "width", "depth", "weight", "mass", "area", "altitude", "temperature", "age"))]
    for e in entities:
        out += [{"entity": e.name, "field": f.name, "ask": "multiple", "text": f"Can one {e.name} have several {f.name}?", "options": ["yes", "no"]} for f in e.fields if not f.multiple and f.name.endswith("s") and f.type == "text"]
    return out[:most]


def with_answers(entities: list[EntitySpec], answered: list[tuple[dict, str]]) -> list[EntitySpec]:
    """The draft with answers to its questions folded in; blank answers change nothing."""
    from copy import deepcopy

    out = deepcopy(entities)
    by_name = {e.name: e for e in out}
    for question, answer in answered:
        text, e = answer.strip(), by_name.get(question["entity"])
        f = e.field(question.get("field", "")) if e else None
        if not text or e is None:
            continue
        if question["ask"] == "identity" and e.field(text):
            e.identity = [text]
        elif question["ask"] == "unit" and f and text.lower() in unit_table():
            f.unit = text.lower()
        elif question["ask"] == "multiple" and f:
            f.multiple = text.lower() in ("yes", "y", "true")
    return out


def from_words(text: str) -> EntitySpec:
    """A draft out of a description such as "plants with name, height (m) and flowering month"."""
    subject, _, rest = re.sub(r"^(?:a |an |the )?(?:list|table|dataset|collection) of ", "", text.strip(), flags=re.I).partition(" with ")
    name = re.sub(r"[^0-9a-zA-Z]+", "_", subject).strip("_").lower() or "record"
    fields = []
    for part in re.split(r",|;| and ", rest) if rest else ["name"]:
        if part.strip():
            n, unit = heading(part)
            kind = "month" if n.endswith("month") else "year" if n.endswith("year") else "date" if n.endswith("date") else "url" if n.endswith(("url", "link", "website")) else "number" if unit or re.search(r"(?:height|length|width|weight|price|count|number|area|altitude|rating)$", n) else "text"
            fields.append(FieldSpec(n, kind, unit))
    singular = name[:-1] if name.endswith("s") and not name.endswith("ss") else name
    return EntitySpec(singular, [fields[0].name], fields)
