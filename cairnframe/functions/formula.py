"""The formula language: safe expressions compiled to Columns.

A formula is parsed on the driver, every node is checked against what the language allows, and
the result is one Column that runs inside whole-stage code. Missing values make results missing;
nothing raises at run time (division by zero, overflow and bad casts give null).
"""

from __future__ import annotations

import ast
import difflib
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnframe.functions import standard as S

NUM, STR, BOOL, LIST, NULL = "number", "text", "bool", "list", "null"
CONSTANTS = {"pi": math.pi, "e": math.e, "tau": math.tau}
#: Statistics over a column, and what they are called with besides `field over entity`.
STATISTICS = ("mean", "median", "stdev", "variance", "total", "spread", "smallest", "largest", "records", "percentile", "zscore", "normalize", "rank", "share", "count_distinct", "mode", "correlation")
EARTH_KM = 6371.0088


class FormulaError(ValueError):
    """A formula that the language does not allow, with a suggestion where one is near."""


@dataclass
class Value:
    """A compiled node: its kind, its Column, and a list's members."""

    kind: str
    col: Column | None = None
    items: list["Value"] = field(default_factory=list)
    constant: object = None


@dataclass(frozen=True)
class Bound:
    """What a field name stands for: its best value, and the ends of its range."""

    col: Column
    kind: str
    high: Column | None = None
    text: Column | None = None


def _lit(x) -> Value:
    if x is None:
        return Value(NULL, F.lit(None).cast("double"))
    if isinstance(x, bool):
        return Value(BOOL, F.lit(x), constant=x)
    if isinstance(x, (int, float)):
        return Value(NUM, F.lit(float(x)), constant=x)
    if isinstance(x, str):
        return Value(STR, F.lit(x), constant=x)
    raise FormulaError(f"{x!r} is not a value of the language")


def num(v: Value) -> Column:
    if v.kind == NUM:
        return v.col
    if v.kind == BOOL:
        return v.col.cast("double")
    if v.kind == STR:
        return S.number_in(v.col)
    return F.lit(None).cast("double")


def text(v: Value) -> Column:
    if v.kind == STR:
        return v.col
    if v.kind == NUM:
        return S.display(v.col)
    if v.kind == BOOL:
        return F.when(v.col, "True").when(~v.col, "False")
    return F.lit(None).cast("string")


def truth(v: Value) -> Column:
    """Python's truth: null, zero, "" and empty lists are false."""
    if v.kind == BOOL:
        return F.coalesce(v.col, F.lit(False))
    if v.kind == NUM:
        return F.coalesce(v.col != 0, F.lit(False))
    if v.kind == STR:
        return F.coalesce(v.col != "", F.lit(False))
    return F.lit(bool(v.items))


def empty(v: Value) -> Column:
    if v.kind == LIST:
        return F.lit(not v.items)
    if v.kind == NULL:
        return F.lit(True)
    return v.col.isNull() | (v.col == "") if v.kind == STR else v.col.isNull()


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _flat(args: list[Value]) -> list[Value]:
    return [y for x in args for y in (_flat(x.items) if x.kind == LIST else [x])]


def _numbers(args: list[Value]) -> Column:
    return F.array_compact(F.array(*[num(a) for a in _flat(args)])) if args else F.array().cast("array<double>")


def _fold(args: list[Value]) -> Column:
    return F.aggregate(_numbers(args), F.lit(0.0), lambda a, x: a + x)


def _mean(args: list[Value]) -> Column:
    return F.round(F.try_divide(_fold(args), F.size(_numbers(args)).cast("double")), 6)


def _n(c: Column) -> Value:
    return Value(NUM, c.cast("double"))


def _b(c: Column) -> Value:
    return Value(BOOL, c)


def _s(c: Column) -> Value:
    return Value(STR, c)


def merged(a: Value, b: Value, pick: Callable[[Column, Column], Column]) -> Value:
    """Two values under one type: equal kinds keep theirs, a missing one takes the other's, else text."""
    kind = a.kind if b.kind in (a.kind, NULL) else b.kind if a.kind == NULL else STR
    as_ = {NUM: num, STR: text, BOOL: lambda v: v.col if v.kind == BOOL else F.lit(None).cast("boolean"), NULL: num}[kind]
    return Value(NUM if kind == NULL else kind, pick(as_(a), as_(b)))


def _band(v: Value, cutoffs: Value, labels: Value) -> Value:
    if cutoffs.kind != LIST or labels.kind != LIST or len(labels.items) != len(cutoffs.items) + 1:
        raise FormulaError("band needs a list of cutoffs and one more label")
    out = text(labels.items[-1])
    x = num(v)
    for c, label in reversed(list(zip(cutoffs.items, labels.items))):
        out = F.when(x < num(c), text(label)).otherwise(out)
    return _s(F.when(x.isNotNull(), out))


def _coalesce(args: list[Value]) -> Value:
    out = _lit(None)
    for a in reversed(_flat(args)):
        out = merged(a, out, lambda x, y, a=a: F.when(~empty(a), x).otherwise(y))
    return out


def _log(args: list[Value]) -> Column:
    x = F.when(num(args[0]) > 0, num(args[0]))
    if len(args) == 1:
        return F.log(x)
    base = num(args[1])
    return finite(F.try_divide(F.log(x), F.log(F.when((base > 0) & (base != 1), base))))


def _haversine(a: Column, b: Column, c: Column, d: Column) -> Column:
    h = F.pow(F.sin(F.radians(c - a) / 2), 2) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin(F.radians(d - b) / 2), 2)
    return F.round(2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h))), 4)


def _word(t: Column, n: int) -> Column:
    words = F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " ")
    return F.nullif(F.try_element_at(words, F.lit(n or 1)), F.lit(""))


def _day(v: Value) -> Column:
    iso = S.iso_date(text(v))
    return F.when(F.length(iso) == 10, F.try_to_date(iso, "yyyy-MM-dd"))


def _constant(v: Value, what: str):
    if v.constant is None:
        raise FormulaError(f"{what} must be written out in the formula")
    return v.constant


def _unary(f: Callable[[Column], Column]) -> Callable[[list[Value]], Value]:
    return lambda a: _n(finite(f(num(a[0]))))


def _clamped(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def _joined(parts: list[Value], separator: str) -> Value:
    """The filled texts of values and lists, joined; null where none is filled."""
    filled = F.filter(F.array(*[text(x) for x in _flat(parts)]), lambda x: x.isNotNull() & (x != ""))
    return _s(F.nullif(F.array_join(filled, separator), F.lit("")))



FUNCTIONS: dict[str, tuple[int, int, Callable[[list[Value]], Value]]] = {
    "min": (1, 99, lambda a: _n(F.array_min(_numbers(a)))),
    "max": (1, 99, lambda a: _n(F.array_max(_numbers(a)))),
    "avg": (1, 99, lambda a: _n(_mean(a))),
    "sum": (1, 99, lambda a: _n(F.when(F.size(_numbers(a)) > 0, _fold(a)))),
    "count": (0, 99, lambda a: _n(F.size(F.filter(F.array(*[~empty(x) for x in _flat(a)]), lambda x: x)) if a else F.lit(0))),
    "round": (1, 2, lambda a: _n(F.bround(num(a[0]), int(_constant(a[1], "round's digits")) if len(a) > 1 else 0))),
    "floor": (1, 1, _unary(F.floor)),
    "ceil": (1, 1, _unary(F.ceil)),
    "abs": (1, 1, _unary(F.abs)),
    "sign": (1, 1, _unary(F.signum)),
    "clamp": (3, 3, lambda a: _n(F.when(num(a[0]).isNotNull() & num(a[1]).isNotNull() & num(a[2]).isNotNull(), F.greatest(num(a[1]), F.least(num(a[2]), num(a[0])))))),
    "midpoint": (1, 2, lambda a: _n(_mean(a))),
    "sqrt": (1, 1, lambda a: _n(F.sqrt(F.when(num(a[0]) >= 0, num(a[0]))))),
    "pow": (2, 2, lambda a: _n(finite(F.pow(num(a[0]), num(a[1]))))),
    "log": (1, 2, lambda a: _n(_log(a))),
    "log10": (1, 1, lambda a: _n(F.log10(F.when(num(a[0]) > 0, num(a[0]))))),
    "exp": (1, 1, _unary(F.exp)),
    "sin": (1, 1, _unary(F.sin)),
    "cos": (1, 1, _unary(F.cos)),
    "tan": (1, 1, _unary(F.tan)),
    "asin": (1, 1, lambda a: _n(F.asin(_clamped(num(a[0]))))),
    "acos": (1, 1, lambda a: _n(F.acos(_clamped(num(a[0]))))),
    "atan": (1, 1, _unary(F.atan)),
    "atan2": (2, 2, lambda a: _n(F.atan2(num(a[0]), num(a[1])))),
    "hypot": (1, 99, lambda a: _n(F.sqrt(F.aggregate(_numbers(a), F.lit(0.0), lambda s, x: s + x * x)))),
    "radians": (1, 1, _unary(F.radians)),
    "degrees": (1, 1, _unary(F.degrees)),
    "distance_km": (4, 4, lambda a: _n(_haversine(*map(num, a)))),
    "if": (2, 3, lambda a: merged(a[1], a[2] if len(a) > 2 else _lit(None), lambda x, y: F.when(truth(a[0]), x).otherwise(y))),
    "band": (3, 3, lambda a: _band(*a)),
    "coalesce": (1, 99, _coalesce),
    "is_empty": (1, 1, lambda a: _b(empty(a[0]))),
    "contains": (2, 2, lambda a: _b(F.contains(F.lower(text(a[0])), F.lower(text(a[1]))))),
    "startswith": (2, 2, lambda a: _b(F.startswith(F.lower(text(a[0])), F.lower(text(a[1]))))),
    "endswith": (2, 2, lambda a: _b(F.endswith(F.lower(text(a[0])), F.lower(text(a[1]))))),
    "word": (1, 2, lambda a: _s(_word(text(a[0]), int(_constant(a[1], "word's number")) if len(a) > 1 else 1))),
    "substr": (1, 3, lambda a: _s(F.substring(text(a[0]), F.greatest(F.lit(1), (num(a[1]) if len(a) > 1 else F.lit(1)).cast("int")), (num(a[2]).cast("int") if len(a) > 2 else F.length(text(a[0])))))),
    "replace": (2, 3, lambda a: _s(F.replace(text(a[0]), text(a[1]), text(a[2]) if len(a) > 2 else F.lit("")))),
    "trim": (1, 1, lambda a: _s(F.regexp_replace(text(a[0]), r"^[\s ]+|[\s ]+$", ""))),
    "lower": (1, 1, lambda a: _s(F.lower(text(a[0])))),
    "upper": (1, 1, lambda a: _s(F.upper(text(a[0])))),
    "concat": (1, 99, lambda a: _joined(a, "; ")),
    "len": (1, 1, lambda a: _n(F.lit(len(a[0].items)) if a[0].kind == LIST else F.coalesce(F.length(text(a[0])), F.lit(0)))),
    "number": (1, 1, lambda a: _n(num(a[0]))),
    "days_between": (2, 2, lambda a: _n(F.datediff(_day(a[1]), _day(a[0])))),
    "years_between": (2, 2, lambda a: _n(F.round(F.datediff(_day(a[1]), _day(a[0])) / F.lit(365.25), 2))),
    "year_of": (1, 1, lambda a: _n(F.substring(S.iso_date(text(a[0])), 1, 4).try_cast("int"))),
    "month_of": (1, 1, lambda a: _n(S.month_of(text(a[0])))),
    "day_of": (1, 1, lambda a: _n(F.dayofmonth(_day(a[0])))),
    "weekday_of": (1, 1, lambda a: _s(F.date_format(_day(a[0]), "EEEE"))),
    "season_of": (1, 2, lambda a: _s(S.season_of(text(a[0]), str(_constant(a[1], "the calendar")) if len(a) > 1 else "northern"))),
    "convert": (3, 3, lambda a: _n((lambda x: F.when(F.abs(x) >= 1, F.round(x, 2)).otherwise(F.round(x, 6)))(S.convert(num(a[0]), str(_constant(a[1], "a unit")), str(_constant(a[2], "a unit")))))),
}

_SUGAR = re.compile(r"\b([A-Za-z_]\w*)\s+(?:over|via)\s+([A-Za-z_]\w*)")
#: `if(` as a function stands at a beginning, after an opening sign or an operator; after a value it is Python's own `if`.
_IF = re.compile(r"(^|[(,\[+\-*/%<>=!:]|\b(?:and|or|not|else|in|if))(\s*)\bif\s*\(")


def prepared(formula: str) -> str:
    """The formula with its shorthand spelled out; quoted text stays as it is."""
    parts = re.split(r"('[^']*'|\"[^\"]*\")", formula)
    for i in range(0, len(parts), 2):
        plain = _SUGAR.sub(r'"\1", "\2"', parts[i])
        # After quoted text a part begins behind a value, not at a beginning.
        parts[i] = _IF.sub(r"\1\2if_(", plain) if i == 0 else _IF.sub(r"\1\2if_(", "." + plain)[1:]
    return "".join(parts)


def parsed(formula: str) -> ast.expression:
    try:
        return ast.parse(prepared(formula).strip(), mode="eval").body
    except SyntaxError as error:
        raise FormulaError(f"the formula cannot be read: {error.msg}") from error


class _FieldNames(ast.NodeVisitor):
    """Collects the names that stand for fields: not those of called functions, nor constants."""

    def __init__(self):
        self.found: set[str] = set()

    def visit_Name(self, node):  # noqa: N802
        if node.id not in CONSTANTS:
            self.found.add(node.id)

    def visit_Call(self, node):  # noqa: N802
        if not isinstance(node.func, ast.Name):
            self.visit(node.func)
        for part in [*node.args, *node.keywords]:
            self.visit(part)


def reads(formula: str) -> set[str]:
    """Field names a formula reads."""
    visitor = _FieldNames()
    visitor.visit(parsed(formula))
    return visitor.found


def catalogue(words: str = "") -> list[tuple[str, int, int]]:
    """(name, fewest, most arguments) of every function and statistic whose name holds one of the words; all without words."""
    wanted = words.lower().split()
    every = [(n, low, high) for n, (low, high, _) in FUNCTIONS.items()] + [(n, 1, 3) for n in sorted(STATISTICS)]
    return [f for f in every if not wanted or any(w in f[0] for w in wanted)]


def statistics_in(formula: str) -> list[tuple[str, tuple]]:
    """The calls of column statistics: (name, constant arguments)."""
    out = []
    for n in ast.walk(parsed(formula)):
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in STATISTICS and n.args and isinstance(n.args[0], ast.Constant) and isinstance(n.args[0].value, str):
            out.append((n.func.id, tuple(a.value for a in [*n.args, *[k.value for k in n.keywords]] if isinstance(a, ast.Constant))))
    return out


def suggestion(name: str, known) -> str:
    near = difflib.get_close_matches(name, known, 1, 0.55) or [k for k in known if k.startswith(name[:3])][:1]
    return f"; did you mean {near[0]}?" if near else ""


class Compiler:
    """Compiles formulas over bound fields.

    `statistics` gives the Column of a statistic call, `relations` that of a count or sum over
    related records; both are joined to the rows beforehand.
    """

    def __init__(self, fields: dict[str, Bound], statistics: Callable[[str, tuple], Value] | None = None, relations: Callable[[str, tuple], Value] | None = None, extra: dict | None = None):
        self.fields, self.statistics, self.relations = fields, statistics, relations
        self.functions = FUNCTIONS | (extra or {})

    def compile(self, formula: str) -> Value:
        return self.visit(parsed(formula))

    def visit(self, n) -> Value:
        method = getattr(self, type(n).__name__, None)
        if method is None:
            raise FormulaError(f"{type(n).__name__} is not part of the language")
        return method(n)

    def Constant(self, n) -> Value:  # noqa: N802
        return _lit(n.value)

    def List(self, n) -> Value:  # noqa: N802
        return Value(LIST, items=[self.visit(x) for x in n.elts])

    Tuple = List

    def Name(self, n) -> Value:  # noqa: N802
        if n.id in self.fields:
            b = self.fields[n.id]
            return Value(b.kind, b.col)
        if n.id in CONSTANTS:
            return _lit(CONSTANTS[n.id])
        raise FormulaError(f"unknown field {n.id!r}{suggestion(n.id, self.fields)}")

    def Attribute(self, n) -> Value:  # noqa: N802
        if not isinstance(n.value, ast.Name) or n.value.id not in self.fields or n.attr not in ("min", "max", "value"):
            raise FormulaError("only .min, .max and .value of a field may follow a point")
        b = self.fields[n.value.id]
        if n.attr == "max":
            return Value(b.kind, F.coalesce(b.high, b.col) if b.high is not None else b.col)
        return _s(b.text) if n.attr == "value" and b.text is not None else Value(b.kind, b.col)

    def UnaryOp(self, n) -> Value:  # noqa: N802
        v = self.visit(n.operand)
        if isinstance(n.op, ast.Not):
            return _b(~truth(v))
        if isinstance(n.op, (ast.USub, ast.UAdd)):
            out = _n(-num(v) if isinstance(n.op, ast.USub) else num(v))
            if isinstance(v.constant, (int, float)):
                out.constant = -v.constant if isinstance(n.op, ast.USub) else v.constant
            return out
        raise FormulaError("this sign is not part of the language")

    def BinOp(self, n) -> Value:  # noqa: N802
        a, b = self.visit(n.left), self.visit(n.right)
        if isinstance(n.op, ast.Add):
            if STR in (a.kind, b.kind):
                return _s(F.concat(F.coalesce(text(a), F.lit("None")), F.coalesce(text(b), F.lit("None"))))
            return _n(num(a) + num(b))
        x, y = num(a), num(b)
        nonzero = F.when(y != 0, y)
        whole = F.floor(F.try_divide(x, nonzero))
        made = {ast.Sub: lambda: x - y, ast.Mult: lambda: x * y, ast.Div: lambda: F.try_divide(x, nonzero), ast.FloorDiv: lambda: whole, ast.Mod: lambda: x - nonzero * whole, ast.Pow: lambda: F.pow(x, y)}.get(type(n.op))
        if made is None:
            raise FormulaError("this operator is not part of the language")
        return _n(finite(made().cast("double")))

    def BoolOp(self, n) -> Value:  # noqa: N802
        parts = [truth(self.visit(v)) for v in n.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(n.op, ast.And) else out | p
        return _b(out)

    def Compare(self, n) -> Value:  # noqa: N802
        out, left = None, self.visit(n.left)
        for op, right_node in zip(n.ops, n.comparators):
            right = self.visit(right_node)
            this = self._compare(op, left, right)
            out = this if out is None else F.when(~F.coalesce(out, F.lit(False)), out).otherwise(this)
            left = right
        return _b(out)

    def _compare(self, op, a: Value, b: Value) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)):
            if b.kind == LIST:
                found = F.lit(False)
                for x in b.items:
                    found = found | F.coalesce(self._compare(ast.Eq(), a, x), F.lit(False))
            else:
                found = F.coalesce(F.contains(text(b), text(a)), F.lit(False))
            return found if isinstance(op, ast.In) else ~found
        x, y = num(a), num(b)
        both = x.isNotNull() & y.isNotNull()
        ordered = {ast.Lt: x < y, ast.LtE: x <= y, ast.Gt: x > y, ast.GtE: x >= y}.get(type(op))
        if ordered is not None:
            return F.when(both, ordered)
        if isinstance(op, (ast.Eq, ast.NotEq)):
            s, t = text(a), text(b)
            same = F.when(both, x == y).otherwise(s.eqNullSafe(t))
            return same if isinstance(op, ast.Eq) else ~same
        raise FormulaError("this comparison is not part of the language")

    def IfExp(self, n) -> Value:  # noqa: N802
        c, a, b = self.visit(n.test), self.visit(n.body), self.visit(n.orelse)
        return merged(a, b, lambda x, y: F.when(truth(c), x).otherwise(y))

    def Call(self, n) -> Value:  # noqa: N802
        if not isinstance(n.func, ast.Name):
            raise FormulaError("only functions of the language can be called")
        name = "if" if n.func.id == "if_" else n.func.id
        constants = tuple(a.value for a in [*n.args, *[k.value for k in n.keywords]] if isinstance(a, ast.Constant))
        relation = name in ("count", "sum_related") and len(n.args) >= 2 and all(isinstance(a, ast.Constant) and isinstance(a.value, str) for a in n.args[:2])
        if relation and self.relations:
            return self.relations(name, constants)
        if name in STATISTICS and constants and isinstance(constants[0], str) and self.statistics:
            return self.statistics(name, constants)
        if name not in self.functions:
            raise FormulaError(f"unknown function {name!r}{suggestion(name, [*self.functions, *STATISTICS])}")
        if name == "concat" and (given := [k for k in n.keywords if k.arg == "separator"]):
            if not isinstance(given[0].value, ast.Constant):
                raise FormulaError("the separator must be a text")
            return _joined([self.visit(a) for a in n.args], str(given[0].value.value))
        low, high, make = self.functions[name]
        args = [self.visit(a) for a in n.args] + [self.visit(k.value) for k in n.keywords]
        if not low <= len(args) <= high:
            raise FormulaError(f"{name} takes {low} to {high} arguments")
        return make(args)


def expression(formula: str, columns: dict[str, str]) -> Column:
    """A formula over plain columns: `columns` gives each column's kind, number or text."""
    fields = {c: Bound(F.col(c).cast("double") if k == NUM else F.col(c).cast("string"), k, text=F.col(c).cast("string")) for c, k in columns.items()}
    return Compiler(fields).compile(formula).col
