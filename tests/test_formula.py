import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnframe.functions import standard as S
from cairnframe.functions.formula import NUM, STR, Bound, Compiler, FormulaError, prepared, reads
from cairnframe.operators.derive import Derivation, derive, in_order, preview
from cairnframe.operators.statistics import ranks

CASES = [
    ("round(width / 7, 3)", 5.714), ("floor(-2.5)", -3), ("ceil(-2.5)", -2), ("sign(0 - width)", -1), ("clamp(grade, 10, 90)", 90), ("sqrt(2.25)", 1.5), ("sqrt(-1)", None), ("pow(0, -1)", None), ("exp(1000)", None), ("log10(0)", None), ("log(8, 2)", 3),
    ("if(width < 41, 'narrow', 'wide')", "narrow"), ("'a' if (width > 50) else 'b'", "b"), ("band(33, [20, 30, 60], ['i', 'ii', 'iii', 'iv'])", "iii"), ("coalesce(other, label)", "Moor"), ("is_empty(other)", True), ("contains(note, 'DRY mea')", True),
    ("word('low-lying marsh edge', 2)", "marsh"), ("word('a b c', -1)", "c"), ("word('a', 5)", None), ("substr(ref, 2, 2)", "X-"), ("substr(ref, -3, 2)", "QX"), ("years_between('2001-02-03', '2003-08-05')", 2.5), ("days_between('2027-02-27', '2027-03-02')", 3),
    ("month_of('October to February')", 2), ("weekday_of('2031-03-07')", "Friday"), ("convert(50, 'f', 'c')", 10.0), ("number('at 1,203.5 m')", 1203.5), ("season_of('August', 'southern')", "winter"), ("-7 % 3", 2), ("-7 // 3", -3), ("1 / 0", None), ("'a' + width", "a40"),
    ("1 < width < 50", True), ("width in [1, 40]", True), ("not other and width", True), ("'A 1' == 'B 1'", True), ("concat(label, other, ref)", "Moor; QX-908"), ("concat(label, ref, separator=' / ')", "Moor / QX-908"), ("len(other)", 0), ("count(label, other)", 1), ("distance_km(0, 0, 0, 1)", 111.1951), ("max(1, width, 3)", 40), ("other > 3", None),
    ("convert(2, 'pounds', 'kg')", 0.907185), ("convert(3, 'kilometers', 'm')", 3000),
]


def test_catalogue(spark):
    df = spark.range(1).select(F.lit(40.0).alias("width"), F.lit("Dry meadow (7 sites)").alias("note"), F.lit("QX-908").alias("ref"), F.lit(None).cast("string").alias("other"), F.lit("Moor").alias("label"), F.lit(130.0).alias("grade"))
    kinds = {"width": NUM, "note": STR, "ref": STR, "other": STR, "label": STR, "grade": NUM}
    c = Compiler({k: Bound(F.col(k), v, text=F.col(k).cast("string")) for k, v in kinds.items()})
    row = df.select(*[c.compile(t).col.alias(f"c{i}") for i, (t, _) in enumerate(CASES)]).first()
    for (text, want), got in zip(CASES, row):
        assert got == want or got == pytest.approx(want), text


@pytest.mark.parametrize("bad", ["__import__('os')", "a.b.c", "(lambda: 1)()", "[x for x in y]", "nosuch(1)", "1 +", "open('x')", "price.__class__"])
def test_refused(bad):
    with pytest.raises(FormulaError):
        Compiler({"price": Bound(F.lit(1.0), NUM)}).compile(bad) if "spark" else None


def test_reads_and_shorthand():
    assert reads("zscore(price over book) + tax * pi") == {"tax"}
    assert prepared("'x over y' + if(a, 1, 2)") == "'x over y' + if_(a, 1, 2)"


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.floats(-1e6, 1e6), st.floats(-1e3, 1e3)), min_size=1, max_size=20))
def test_operators_like_python(spark, pairs):
    df = spark.createDataFrame(pairs, "a double, b double")
    c = Compiler({k: Bound(F.col(k), NUM) for k in "ab"})
    got = df.select(*[c.compile(t).col.alias(n) for n, t in (("q", "a / b"), ("s", "a - b"), ("w", "a // b"))]).collect()
    for (a, b), r in zip(pairs, got):
        assert r.s == a - b
        assert r.q == (a / b if b and math.isfinite(a / b) else None)
        if b and math.isfinite(a / b) and abs(a / b) < 1e15 and abs(a / b - round(a / b)) > 1e-9:
            assert r.w == math.floor(a / b)


def test_derivations(spark):
    df = spark.createDataFrame([(1, 10.0, "a"), (2, 20.0, None), (3, None, "c")], "id bigint, x double, t string")
    ds = [Derivation("c", "b * 2"), Derivation("b", "x + 1"), Derivation("z", "zscore(x over t)"), Derivation("r", "rank(x over t)"), Derivation("k", method="lookup", inputs=("x",), cutoffs=(15,), labels=("lo", "hi")), Derivation("u", method="code", inputs=("t",), code=lambda v: v["t"].upper()), Derivation("f", "t", if_missing="use_fallback", fallback="none"), Derivation("m", "mode(t over t)")]
    assert [sorted(d.name for d in level) for level in in_order(ds)][1] == ["c"]
    rows = {r.id: r for r in derive(df, ds).collect()}
    assert rows[1]["c"] == 22 and rows[1]["z"] == -1.0 and rows[2]["r"] == 1 and rows[3]["r"] is None
    assert rows[2]["k"] == "hi" and rows[1]["u"] == "A" and rows[2]["u"] is None and rows[2]["f"] == "none" and rows[3]["m"] == "a"
    p = preview(df, ds[1])
    assert (p.filled, p.empty) == (2, 1)


def test_ranks_with_ties_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 37).cast("double").alias("v"))
    got = {r.v: r["rank"] for r in ranks(df, "v", True, 5).collect()}
    values = sorted((i % 37 for i in range(1000)), reverse=True)
    assert got == {float(v): values.index(v) + 1 for v in set(values)}


def test_standard_forms(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first().x
    dates = {
        "7 Mar 2031": "2031-03-07", "March 7th, 2031": "2031-03-07", "3/4/2020": "2020-04-03", "3/14/2020": "2020-03-14", "3-14-2020": "2020", "14.3.2020": "2020-03-14", "2020/3/4": "2020-03-04", "2020-05": "2020-05", "2020-13": "2020", "1999": "1999", "7 Sept 31": "2031-09-07", "7-march-31": "2031-03-07",
        "2031-03-07T10:20:30": "2031-03-07", "2031-03-07 10:20:30": "2031-03-07", "31/2/2020": "2020", "5 Mar, 1999": "1999", "5 March, 1999": "1999-03-05", "mAy 5, 1999": "1999-05-05", "some time in 1850": "1850", "never": None, "": None, "x" * 50000: None, "99/99/9999": None,
    }
    for text, want in dates.items():
        assert val(S.iso_date(F.lit(text))) == want, text
    assert val(S.display(F.lit(5.972e24))) == "5.972e+24" and val(S.display(F.lit(3.0))) == "3" and val(S.display(F.lit(0.00001))) == "1e-05"
    assert tuple(val(S.measured(F.lit("6,562 ft"), "m"))) == (2000.0, None, "m")
    assert tuple(val(S.measured(F.lit("120 to 1,450 m"), "m"))) == (120.0, 1450.0, "m")
    assert tuple(val(S.money(F.lit("31.40 gbp"), "USD", {"GBP": 1.25, "USD": 1}))) == (39.25, "USD", None)
    assert [val(S.currency_of(F.lit(t))) for t in ("€5 or $6", "Rs. 5", "5 chf!", "5 XYZ", "5")] == ["USD", "INR", "CHF", None, None]
    assert val(S.money(F.lit("£31.40"), "USD", {}))["problem"]
    assert val(S.scientific_name(F.lit("carex NIGRA Reichard"))) == "Carex nigra"
    assert val(S.normal(F.lit(" .a   b;"))) == "a b" and val(S.comparison_key(F.lit("A-b  C"))) == "a b c"
    with pytest.raises(ValueError):
        S.convert(F.lit(1), "m", "kg")
