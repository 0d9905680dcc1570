"""Derived columns: formulas, bands, rules and counts over relations, in dependency order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnframe.functions.formula import BOOL, NUM, STR, Bound, Compiler, FormulaError, Value, reads, statistics_in
from cairnframe.operators.statistics import with_statistics


@dataclass(frozen=True)
class Derivation:
    """One derived column.

    `method` is formula, lookup (bands on the first input), rules (ordered condition and result
    pairs; a None condition is the default) or code (a function of a row's values). `if_missing`
    is leave_empty, use_fallback or partial.
    """

    name: str
    formula: str | None = None
    method: str = "formula"
    inputs: tuple[str, ...] = ()
    cutoffs: tuple[float, ...] = ()
    labels: tuple[str, ...] = ()
    rules: tuple[tuple[str | None, str], ...] = ()
    code: Callable | None = None
    if_missing: str = "partial"
    fallback: object = None
    round_to: int | None = None


def needs(d: Derivation) -> set[str]:
    out = set(d.inputs)
    if d.formula:
        out |= reads(d.formula) | {str(a[0]) for _, a in statistics_in(d.formula)}
    for condition, result in d.rules:
        out |= (reads(condition) if condition else set()) | reads(result)
    return out


def in_order(derivations: list[Derivation]) -> list[list[Derivation]]:
    """Derivations in levels: each needs only columns of earlier levels; a cycle ends up in the last."""
    left, levels = list(derivations), []
    while left:
        names = {d.name for d in left}
        ready = [d for d in left if not (needs(d) - {d.name}) & names] or left
        levels.append(ready)
        left = [d for d in left if d not in ready]
    return levels


def kinds_of(df: DataFrame) -> dict[str, str]:
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return {c: NUM if t in numbers or t.startswith("decimal") else BOOL if t == "boolean" else STR for c, t in df.dtypes}


def bound(df: DataFrame) -> dict[str, Bound]:
    """Every column as a field; a struct with `lo` and `hi` is a range."""
    out = {}
    for c, t in df.dtypes:
        if t.startswith("struct<lo:"):
            out[c] = Bound(F.col(f"{c}.lo").cast("double"), NUM, F.col(f"{c}.hi").cast("double"), F.col(f"{c}.lo").cast("string"))
        else:
            kind = kinds_of(df)[c]
            out[c] = Bound(F.col(c).cast("double") if kind == NUM else F.col(c) if kind == BOOL else F.col(c).cast("string"), kind, text=F.col(c).cast("string"))
    return out


def derive(df: DataFrame, derivations: list[Derivation], relations: Callable[[DataFrame, str, tuple], tuple[DataFrame, Column]] | None = None, extra: dict | None = None) -> DataFrame:
    """`df` with the derived columns; those of one level are added together.

    Statistics (`f(x over entity)`) range over `df`. A missing input makes the result empty under
    leave_empty, the fallback under use_fallback, and is passed on as null under partial.
    """
    base = df.columns
    out = df
    for level in in_order(derivations):
        wanted = list(dict.fromkeys(s for d in level for text in _formulas(d) for s in statistics_in(text)))
        clean = [(n, tuple(a for i, a in enumerate(args) if i != 1)) for n, args in wanted]
        joined, columns = with_statistics(out, clean, kinds_of(out))
        counted: dict[tuple, Column] = {}
        if relations:
            for d in level:
                for call in _relation_calls(d):
                    if call not in counted:
                        joined, counted[call] = relations(joined, *call)
        statistic = lambda name, args, cs=columns: _typed(cs[name, tuple(a for i, a in enumerate(args) if i != 1)], name)
        relation = lambda name, args, cs=counted: Value(NUM, cs[name, args].cast("double"))
        compiler = Compiler(bound(out), statistic, relation if relations else None, extra)
        made = {d.name: _column(d, compiler, out) for d in level}
        out = joined.withColumns(made).select(*[c for c in out.columns if c not in made], *made)
    return out.select(*[c for c in base if c in out.columns], *[c for c in out.columns if c not in base])


def _typed(c: Column, name: str) -> Value:
    return Value(STR if name == "mode" else NUM, c if name == "mode" else c.cast("double"))


def _formulas(d: Derivation) -> list[str]:
    return [f for f in [d.formula, *[x for rule in d.rules for x in rule]] if f]


def _relation_calls(d: Derivation) -> list[tuple[str, tuple]]:
    import ast

    from cairnframe.functions.formula import parsed

    out = []
    for f in _formulas(d):
        for n in ast.walk(parsed(f)):
            if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in ("count", "sum_related") and len(n.args) >= 2 and all(isinstance(a, ast.Constant) and isinstance(a.value, str) for a in n.args[:2]):
                out.append((n.func.id, tuple(a.value for a in n.args if isinstance(a, ast.Constant))))
    return out


def _column(d: Derivation, compiler: Compiler, df: DataFrame) -> Column:
    if d.method == "formula":
        value = compiler.compile(d.formula)
    elif d.method == "lookup":
        labels = ", ".join(repr(x) for x in d.labels)
        value = compiler.compile(f"band({d.inputs[0]}, {list(d.cutoffs)}, [{labels}])")
    elif d.method == "rules":
        text = "None"
        for condition, result in reversed(d.rules):
            text = f"({result})" if condition is None else f"(({result}) if ({condition}) else {text})"
        value = compiler.compile(text)
    elif d.method == "code":
        value = Value(STR, _coded(d, df))
    else:
        raise FormulaError(f"no derivation method {d.method!r}")
    c = F.bround(value.col, d.round_to) if d.round_to is not None and value.kind == NUM else value.col
    missing = F.lit(False)
    for name in sorted(needs(d) & set(df.columns)):
        missing = missing | F.col(name).isNull()
    if d.if_missing == "leave_empty":
        return F.when(~missing, c)
    if d.if_missing == "use_fallback":
        return F.when(~missing, c).otherwise(F.lit(d.fallback))
    return c


def load_code(path: str, folder: str) -> Callable:
    """The function `compute` of a Python file inside the project folder; files elsewhere are refused."""
    import runpy
    from pathlib import Path

    where, root = Path(path).resolve(), Path(folder).resolve()
    if where.suffix != ".py" or not where.is_relative_to(root):
        raise FormulaError(f"code must be a Python file inside {root}")
    found = runpy.run_path(str(where)).get("compute")
    if not callable(found):
        raise FormulaError(f"{where.name} defines no function `compute`")
    return found


def code_failures(df: DataFrame, d: Derivation) -> DataFrame:
    """(error, n): what user code failed with, and on how many rows; most frequent first."""
    return df.select(_coded(d, df, failures=True).alias("error")).where("error is not null").groupBy("error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error")


def _coded(d: Derivation, df: DataFrame, failures: bool = False) -> Column:
    """User code over Arrow batches; a row on which it fails is null, and `failures` tells the kind of its error instead."""
    inputs, code = list(d.inputs), d.code

    def run(values):
        def one(row):
            try:
                got = code(row)
                return None if got is None or failures else str(got)
            except Exception as e:
                return f"{type(e).__name__}: {e}"[:200] if failures else None

        return pd.Series([one(r) for r in values.to_dict("records")], dtype="object")

    # Annotations are objects here, because the module's own are kept as texts.
    run.__annotations__ = {"values": pd.DataFrame, "return": pd.Series}
    return F.pandas_udf(run, "string")(F.struct(*[F.col(c) for c in inputs]))


@dataclass
class Preview:
    """What a formula would give: counts over all rows, and a few samples for reading."""

    filled: int
    empty: int
    samples: list = field(default_factory=list)


def preview(df: DataFrame, d: Derivation, samples: int = 3) -> Preview:
    made = derive(df, [d])
    r = made.agg(F.count(d.name).alias("filled"), F.count_if(F.col(d.name).isNull()).alias("empty")).first()
    return Preview(r["filled"], r["empty"], [x[0] for x in made.where(F.col(d.name).isNotNull()).select(d.name).limit(samples).collect()])


def derived_rows(wide: DataFrame, values: DataFrame, items: list[Derivation], entity_type: str, key: str = "entity_id") -> DataFrame:
    """Derived columns as rows of the long table, with lineage and confidence.

    A derived value is as sure as the least sure of its accepted inputs, at most 0.45 if one of
    them is itself inferred, 0.2 less where a partial result lacks an input, and 0.5 without any
    input. `inputs` lists the `value_id` of what it came from; null results give no row.
    """
    accepted_ = values.where("status = 'accepted'").select(key, "name", "value_id", "confidence", "origin")
    out = None
    for d in items:
        wanted = sorted(needs(d) & {c.split(".")[0] for c in wide.columns})
        told = accepted_.where(F.col("name").isin(*wanted)).groupBy(key).agg(F.min(F.coalesce("confidence", F.lit(0.0))).alias("_c"), F.max(F.col("origin") == "inferred").alias("_i"), F.count_distinct("name").alias("_n"), F.array_sort(F.collect_set("value_id")).alias("inputs"))
        sure = F.when(F.col("_c").isNull(), 0.5).otherwise(F.when(F.col("_i"), F.least("_c", F.lit(0.45))).otherwise(F.col("_c")))
        lacks = F.lit(d.if_missing == "partial") & (F.coalesce("_n", F.lit(0)) < len(wanted))
        confidence = F.round(F.greatest(F.lit(0.0), sure - F.when(lacks, 0.2).otherwise(0.0)), 6)
        rows = wide.where(F.col(d.name).isNotNull()).select(key, F.col(d.name).cast("string").alias("value"), F.col(d.name).try_cast("double").alias("value_num") if dict(wide.dtypes)[d.name] != "boolean" else F.lit(None).cast("double").alias("value_num"))
        made = rows.join(told, key, "left").select(key, F.lit(entity_type).alias("entity_type"), F.lit(d.name).alias("name"), "value", "value_num", F.lit("derived").alias("origin"), confidence.alias("confidence"), F.coalesce("inputs", F.array().cast("array<bigint>")).alias("inputs"))
        out = made if out is None else out.unionByName(made)
    return out
