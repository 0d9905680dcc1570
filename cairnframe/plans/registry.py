"""Registered queries of the engine's own operators, each with the SQL it must agree with.

Every query runs over its whole tables. Columns are bigint, double, string or boolean on both
sides; rounding keeps away from ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.functions import formula, standard
from cairnframe.functions.formula import NUM, STR
from cairnframe.operators import conflict, evidence, extraction, normal_forms, pages, relations, resolution, search, statistics
from cairnframe.operators import values as V
from cairnframe.operators.derive import Derivation, derive, derived_rows
from cairnframe.operators.units import with_numbers
from cairnframe.plans import core_problems, report, sqlgate
from cairnframe.plans.spec import from_dict
from cairnframe.session import table
from cairnframe.sources import records
from cairnframe.streaming import landing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: The blanks that part sentences, for SQL.
_SQL_GAP = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _sql_normal(c: str) -> str:
    """SQL of the normal form of a text."""
    plain = f"regexp_replace(replace(replace({c}, chr(8203), ''), chr(65279), ''), '[{_SQL_GAP}]+', ' ', 'g')"
    return f"regexp_replace({plain}, '^[\\s.,;:|\\-]+|[\\s.,;:|\\-]+$', '', 'g')"


def _sql_plain(c: str) -> str:
    """SQL of the form in which quotes are compared."""
    return f"trim(regexp_replace(lower(translate(coalesce({c}, ''), '–—’', '--' || chr(39))), '[{_SQL_GAP}]+', ' ', 'g'))"


def _sql_states(v: str, q: str) -> str:
    """SQL of whether a quote states a value, both in plain form."""
    numbers = lambda x: f"list_distinct(list_transform(regexp_extract_all({x}, '\\d(?:[\\d,.]*\\d)?'), lambda n: replace(n, ',', '')))"
    bare = lambda x: f"regexp_replace({x}, '[^a-z0-9]+', '', 'g')"
    return f"(({v} <> '' and contains({q}, {v})) or case when len({numbers(v)}) = 0 then contains({bare(q)}, {bare(v)}) else list_has_all({numbers(q)}, {numbers(v)}) end)"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def formulas(df: DataFrame, keep: list[str], made: dict[str, str]) -> DataFrame:
    """Key columns and formulas over a table's columns, compiled to Columns."""
    kinds = {c: NUM if t in ("int", "bigint", "double", "float") else STR for c, t in df.dtypes}
    return df.select(*keep, *[formula.expression(text, kinds).alias(n) for n, text in made.items()])


# ------------------------------------------------------------------ the long table and its pivots
@query(
    "flagship_part",
    """select p_partkey, p_name, p_brand, p_retailprice, case when p_retailprice < 1000 then 'low' when p_retailprice < 1500 then 'mid' else 'high' end price_band,
    round((p_retailprice - avg(p_retailprice) over ()) / stddev_pop(p_retailprice) over (), 4) price_z, rank() over (order by p_retailprice desc)::double price_rank from part""",
)
def flagship_part(spark: SparkSession, root: str) -> DataFrame:
    part = table(spark, root, "part")
    long = V.to_long(part, "p_partkey", ["p_name", "p_brand", "p_retailprice"], {"value_max": F.lit(None).cast("double"), "origin": F.lit("extracted"), "confidence": F.lit(0.95), "tier": F.lit(0), "seq": F.lit(0), "status": F.lit("accepted")})
    wide = V.to_wide(V.accepted(long), ["p_name", "p_brand", "p_retailprice"], "p_partkey", F.col("value")).withColumn("p_retailprice", F.col("p_retailprice").cast("double"))
    return derive(wide, [Derivation("price_band", "band(p_retailprice, [1000, 1500], ['low', 'mid', 'high'])"), Derivation("price_z", "zscore(p_retailprice over part)"), Derivation("price_rank", "rank(p_retailprice over part)")])


@query("unpivot_long", "select p_partkey, 'p_brand' as name, p_brand as value from part union all select p_partkey, 'p_type', p_type from part where p_type is not null")
def unpivot_long(spark, root):
    return V.to_long(table(spark, root, "part"), "p_partkey", ["p_brand", "p_type"]).select("p_partkey", "name", "value")


@query(
    "pivot_best_value",
    """with v as (select l_orderkey, l_returnflag as name, l_shipmode as value, c, l_linenumber from (select *, l_linestatus as l_shipmode, 1 - l_discount as c from lineitem)),
    b as (select l_orderkey, name, arg_max(value, (c, -l_linenumber, value)) as v from v group by 1, 2)
    select l_orderkey, max(v) filter (name = 'A') as a, max(v) filter (name = 'N') as n, max(v) filter (name = 'R') as r from b group by 1""",
)
def pivot_best_value(spark, root):
    """Best value per cell: the row of the highest confidence (here 1 − discount), then the first."""
    rows = table(spark, root, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("value"), (1 - F.col("l_discount")).alias("confidence"), F.lit(1).alias("tier"), F.col("l_linenumber").alias("seq"))
    return V.to_wide(rows, ["A", "N", "R"], "l_orderkey", F.col("value")).toDF("l_orderkey", "a", "n", "r")


@query("where_filter", "select o_orderkey, o_orderstatus, o_orderpriority from orders where lower(trim(o_orderstatus)) in ('f', 'p') and lower(trim(o_orderpriority)) = '1-urgent'")
def where_filter(spark, root):
    return V.where(table(spark, root, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), {"o_orderstatus": ["F", "p "], "o_orderpriority": "1-URGENT"})


@query("where_cascade", "select l_orderkey, l_linenumber::bigint as l_linenumber, l_partkey from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'P')")
def where_cascade(spark, root):
    kept = V.where(table(spark, root, "orders"), {"o_orderstatus": "P"})
    return V.cascade(table(spark, root, "lineitem"), kept, "l_orderkey", "o_orderkey").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey")


@query("search_cells", "select c_custkey, c_name, c_mktsegment from customer where contains(lower(c_name), 'mach') or contains(lower(c_mktsegment), 'mach') or contains(c_custkey::varchar, 'mach')")
def search_cells(spark, root):
    return V.search_cells(table(spark, root, "customer").select("c_custkey", "c_name", "c_mktsegment"), "MACH")


@query("stack_tables", "select 'nation' as \"table\", n_nationkey::varchar as n_nationkey, n_name, null::varchar as r_regionkey, null::varchar as r_name from nation union all select 'region', null, null, r_regionkey::varchar, r_name from region")
def stack_tables(spark, root):
    return V.stack_tables({"nation": table(spark, root, "nation").select("n_nationkey", "n_name"), "region": table(spark, root, "region").select("r_regionkey", "r_name")})


@query("joined_cells", "select n_regionkey::bigint as n_regionkey, array_to_string(list_sort(list_distinct(list(n_name))), '; ') as n_name from nation group by 1")
def joined_cells(spark, root):
    return V.join_cells(table(spark, root, "nation").withColumn("n_regionkey", F.col("n_regionkey").cast("bigint")), "n_regionkey", "n_name")


@query("split_cells", "select n_regionkey::bigint as n_regionkey, n_name from nation")
def split_cells(spark, root):
    return V.split_cells(joined_cells(spark, root), ["n_name"])


@query("flat_0nf", "select r_regionkey::bigint as r_regionkey, r_name, array_to_string(list_sort(list_distinct(list(n_name))), '; ') as n_name from region left join nation on r_regionkey = n_regionkey group by 1, 2")
def flat_0nf(spark, root):
    regions = table(spark, root, "region").select(F.col("r_regionkey").cast("bigint").alias("r_regionkey"), "r_name")
    return normal_forms.flat_table(regions, "r_regionkey", {"n_name": table(spark, root, "nation").select(F.col("n_regionkey").cast("bigint").alias("r_regionkey"), "n_name")})


@query("nested_rows", "select n_regionkey::bigint as r_regionkey, count(*) as n, sum(length(n_name))::bigint as letters from nation group by 1")
def nested_rows(spark, root):
    from cairnframe.plans.export import nested

    children = table(spark, root, "nation").select(F.col("n_regionkey").cast("bigint").alias("r_regionkey"), "n_name")
    out = nested(table(spark, root, "region").select(F.col("r_regionkey").cast("bigint").alias("r_regionkey")), "r_regionkey", {"nations": children})
    return out.select("r_regionkey", F.size("nations").cast("bigint").alias("n"), F.aggregate("nations", F.lit(0), lambda a, x: a + F.length(x["n_name"])).cast("bigint").alias("letters"))


@query("sql_export", """select 'INSERT INTO "region" ("r_regionkey", "r_name") VALUES (''' || r_regionkey || ''', ''' || replace(r_name, '''', '''''') || ''');' as value from region""")
def sql_export(spark, root):
    from cairnframe.plans.export import sql_statements

    return sql_statements(table(spark, root, "region").select("r_regionkey", "r_name"), "region")


@query("unit_column", "select p_partkey, round(p_size * 0.3048 / 1.0, 2) as p_size from part")
def unit_column(spark, root):
    return V.in_units(table(spark, root, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size")), "p_size", "ft", "m")


@query("export_columns", "select s_suppkey, s_name as \"Name\", s_acctbal as balance from supplier")
def export_columns(spark, root):
    return V.choose(table(spark, root, "supplier"), [{"name": "s_name", "label": "Name"}, {"name": "s_acctbal", "label": "balance"}], ["s_suppkey"])


# ------------------------------------------------------------------ statistics over a column
STATS = [(s, ("p_retailprice",)) for s in ("mean", "median", "stdev", "variance", "total", "spread", "smallest", "largest", "records")]


@query(
    "stats_summary",
    """select round(avg(p_retailprice), 4) as mean, round(median(p_retailprice), 4) as median, round(stddev_pop(p_retailprice), 4) as stdev, round(var_pop(p_retailprice), 2) as variance, round(sum(p_retailprice), 2) as total,
    round(max(p_retailprice) - min(p_retailprice), 4) as spread, min(p_retailprice) as smallest, max(p_retailprice) as largest, count(p_retailprice) as records from part""",
)
def stats_summary(spark, root):
    one = statistics.one_row(table(spark, root, "part"), STATS, {})
    places = {"variance": 2, "total": 2}
    return one.select(*[F.col(statistics.label(s, a)).alias(s) if s in ("smallest", "largest", "records") else F.round(statistics.label(s, a), places.get(s, 4)).alias(s) for s, a in STATS])


@query("percentile", "select round(quantile_cont(o_totalprice, 0.9), 4) as p90, round(quantile_cont(o_totalprice, 0.25), 4) as p25 from orders")
def percentile(spark, root):
    wanted = [("percentile", ("o_totalprice", 90)), ("percentile", ("o_totalprice", 25))]
    one = statistics.one_row(table(spark, root, "orders"), wanted, {})
    return one.select(*[F.round(statistics.label(*w), 4).alias(f"p{w[1][1]}") for w in wanted])


@query("zscore_rank_asc", "select c_custkey, round((c_acctbal - avg(c_acctbal) over ()) / stddev_pop(c_acctbal) over (), 4) as z, rank() over (order by c_acctbal)::double as r from customer")
def zscore_rank_asc(spark, root):
    return derive(table(spark, root, "customer").select("c_custkey", "c_acctbal"), [Derivation("z", "zscore(c_acctbal over customer)"), Derivation("r", "rank(c_acctbal over customer, 'asc')")]).select("c_custkey", "z", "r")


@query("share_normalize", "select p_partkey, round(p_size / sum(p_size) over (), 6) as share, round((p_size - min(p_size) over ()) / (max(p_size) over () - min(p_size) over ()), 4) as normal from part")
def share_normalize(spark, root):
    return derive(table(spark, root, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size")), [Derivation("share", "share(p_size over part)"), Derivation("normal", "normalize(p_size over part)")]).select("p_partkey", "share", "normal")


@query("correlation", "select round(corr(l_quantity, l_extendedprice), 4) as c from lineitem")
def correlation(spark, root):
    one = statistics.one_row(table(spark, root, "lineitem"), [("correlation", ("l_quantity", "l_extendedprice"))], {})
    return one.toDF("c")


@query("distinct_texts", "select count(distinct lower(trim(c_mktsegment))) as n from customer")
def distinct_texts(spark, root):
    return statistics.one_row(table(spark, root, "customer"), [("count_distinct", ("c_mktsegment",))], {"c_mktsegment": STR}).toDF("n")


@query("mode_text", "select p_brand as m from part group by 1 order by count(*) desc, p_brand limit 1")
def mode_text(spark, root):
    return statistics.one_row(table(spark, root, "part"), [("mode", ("p_brand",))], {"p_brand": STR}).toDF("m")


# ------------------------------------------------------------------ formulas
@query(
    "formula_arithmetic",
    """select c_custkey, floor(c_acctbal / 7) as whole, round(c_acctbal - 7 * floor(c_acctbal / 7), 4) as rest, round(-c_acctbal * 2 + 1, 4) as neg, c_acctbal / nullif(c_nationkey, 0) as ratio,
    least(greatest(c_acctbal, 0), 5000)::double as held, sign(c_acctbal)::double as sgn, abs(c_acctbal) as size, least(c_acctbal, 100)::double as low, greatest(c_acctbal, 100)::double as high, round((c_acctbal + c_nationkey) / 2, 4) as mean from customer""",
)
def formula_arithmetic(spark, root):
    made = formulas(
        table(spark, root, "customer"), ["c_custkey"],
        {"whole": "c_acctbal // 7", "rest": "c_acctbal % 7", "neg": "-c_acctbal * 2 + 1", "ratio": "c_acctbal / c_nationkey", "held": "clamp(c_acctbal, 0, 5000)", "sgn": "sign(c_acctbal)", "size": "abs(c_acctbal)", "low": "min(c_acctbal, 100)", "high": "max(c_acctbal, 100)", "mean": "avg(c_acctbal, c_nationkey)"},
    )
    return made.withColumns({c: F.round(c, 4) for c in ("rest", "neg", "mean")})


@query(
    "formula_maths",
    """select p_partkey, round(log10(p_retailprice), 8) as lg, round(ln(p_retailprice) / ln(2), 8) as l2, round(sqrt(p_size), 8) as rt, round(pow(p_size, 1.5), 6) as pw, round(exp(p_size / 50), 8) as ex, round(sin(p_size), 8) as sn, round(cos(p_size), 8) as cs,
    round(atan2(p_size, 3), 8) as at, round(sqrt(p_size * p_size + 9), 8) as hy, round(radians(p_size), 8) as rd, round(pi() * p_size * p_size, 6) as area, case when p_size > 30 then null else round(sqrt(30 - p_size), 8) end as gone from part""",
)
def formula_maths(spark, root):
    made = formulas(
        table(spark, root, "part"), ["p_partkey"],
        {"lg": "log10(p_retailprice)", "l2": "log(p_retailprice, 2)", "rt": "sqrt(p_size)", "pw": "p_size ** 1.5", "ex": "exp(p_size / 50)", "sn": "sin(p_size)", "cs": "cos(p_size)", "at": "atan2(p_size, 3)", "hy": "hypot(p_size, 3)", "rd": "radians(p_size)", "area": "pi * p_size ** 2", "gone": "sqrt(30 - p_size)"},
    )
    return made.select("p_partkey", *[F.round(c, 6 if c in ("pw", "area") else 8).alias(c) for c in made.columns[1:]])


@query(
    "formula_choices",
    """select c_custkey, case when c_acctbal < 0 then 'debt' when c_acctbal < 3000 then 'low' when c_acctbal < 7000 then 'mid' else 'high' end as band, case when c_acctbal >= 0 and c_nationkey <> 0 then 'yes' else 'no' end as flag,
    coalesce(nullif(c_mktsegment, ''), 'none') as seg, (c_acctbal > 1000 and c_acctbal < 2000) as middle, c_mktsegment in ('BUILDING', 'MACHINERY') as two, case when c_mktsegment = 'BUILDING' then 'b' when c_acctbal < 0 then 'n' else 'o' end as ruled from customer""",
)
def formula_choices(spark, root):
    df = table(spark, root, "customer")
    made = formulas(df, ["c_custkey", "c_mktsegment", "c_acctbal"], {"band": "band(c_acctbal, [0, 3000, 7000], ['debt', 'low', 'mid', 'high'])", "flag": "if(c_acctbal >= 0 and c_nationkey, 'yes', 'no')", "seg": "coalesce(c_mktsegment, 'none')", "middle": "1000 < c_acctbal < 2000", "two": "c_mktsegment in ['BUILDING', 'MACHINERY']"})
    rules = Derivation("ruled", method="rules", rules=(("c_mktsegment == 'BUILDING'", "'b'"), ("c_acctbal < 0", "'n'"), (None, "'o'")))
    return derive(made, [rules]).select("c_custkey", "band", "flag", "seg", "middle", "two", "ruled")


@query(
    "formula_texts",
    """select p_partkey, contains(lower(p_name), 'an') as has, starts_with(lower(p_type), 'pro') as starts, ends_with(lower(p_type), 'm') as ends, split_part(trim(regexp_replace(p_name, '\\s+', ' ', 'g')), ' ', 1) as first_word,
    substring(p_brand, 1, 5) as head, replace(p_brand, '#', '-') as dashed, upper(p_name) as up, p_brand || '; ' || p_type as joined, length(p_name)::double as n, 'part ' || p_partkey::varchar as named,
    try_cast(replace(regexp_extract(p_brand, '[-+]?\\d[\\d,]*(?:\\.\\d+)?(?:[eE][-+]?\\d+)?'), ',', '') as double) as num from part""",
)
def formula_texts(spark, root):
    return formulas(
        table(spark, root, "part"), ["p_partkey"],
        {"has": "contains(p_name, 'AN')", "starts": "startswith(p_type, 'PRO')", "ends": "endswith(p_type, 'M')", "first_word": "word(p_name, 1)", "head": "substr(p_brand, 1, 5)", "dashed": "replace(p_brand, '#', '-')", "up": "upper(p_name)", "joined": "concat(p_brand, p_type)", "n": "len(p_name)", "named": "'part ' + p_partkey", "num": "number(p_brand)"},
    )


@query(
    "formula_dates",
    """select o_orderkey, date_diff('day', o_orderdate::date, date '1999-01-01')::double as days, round(date_diff('day', o_orderdate::date, date '1999-01-01') / 365.25::double, 2) + 0.0 as years, year(o_orderdate)::double as y, month(o_orderdate)::double as m, day(o_orderdate)::double as d, dayname(o_orderdate) as w,
    case when month(o_orderdate) in (12, 1, 2) then 'winter' when month(o_orderdate) < 6 then 'spring' when month(o_orderdate) < 9 then 'summer' else 'autumn' end as s, case when month(o_orderdate) in (12, 1, 2) then 'winter' when month(o_orderdate) in (3, 4) then 'spring' when month(o_orderdate) in (5, 6) then 'summer' when month(o_orderdate) < 10 then 'monsoon' else 'autumn' end as i from orders""",
)
def formula_dates(spark, root):
    df = table(spark, root, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"))
    return formulas(df, ["o_orderkey"], {"days": "days_between(at, '1999-01-01')", "years": "years_between(at, '1999-01-01')", "y": "year_of(at)", "m": "month_of(at)", "d": "day_of(at)", "w": "weekday_of(at)", "s": "season_of(at)", "i": "season_of(at, 'india')"})


@query("formula_units", "select p_partkey, round(p_size / 0.3048, 2) as ft, round(case when abs((p_size - 32) * 5 / 9.0::double) >= 1 then round((p_size - 32) * 5 / 9.0::double, 2) else round((p_size - 32) * 5 / 9.0::double, 6) end, 6) as c from part")
def formula_units(spark, root):
    return formulas(table(spark, root, "part"), ["p_partkey"], {"ft": "convert(p_size, 'm', 'ft')", "c": "convert(p_size, 'f', 'c')"})


@query("formula_distance", "select s_suppkey, round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(13.0827 - s_nationkey) / 2), 2) + cos(radians(s_nationkey)) * cos(radians(13.0827)) * pow(sin(radians(80.2707 - s_suppkey % 90) / 2), 2))), 2) as km from supplier")
def formula_distance(spark, root):
    made = formulas(table(spark, root, "supplier"), ["s_suppkey"], {"km": "distance_km(s_nationkey, s_suppkey % 90, 13.0827, 80.2707)"})
    return made.withColumn("km", F.round("km", 2))


# ------------------------------------------------------------------ standard values
@query("comparison_keys", "select p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', ' ', 'g')) as k from part")
def comparison_keys(spark, root):
    return table(spark, root, "part").select("p_partkey", standard.comparison_key(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("k"))


@query("scripts", "select doc_id, case when m = '' then 'Latin' when m <= 'ॿ' then 'Devanagari' else 'Tamil' end as s from (select doc_id, regexp_extract(coalesce(text, ''), '[ऀ-ॿ஀-௿]', 0) as m from documents)")
def scripts(spark, root):
    return table(spark, root, "documents").select("doc_id", standard.script(F.col("text")).alias("s"))


@query("written_dates", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as a, strftime(o_orderdate, '%Y-%m-%d') as b, strftime(o_orderdate, '%Y-%m') as c from orders")
def written_dates(spark, root):
    df = table(spark, root, "orders")
    texts = df.select("o_orderkey", F.date_format("o_orderdate", "d MMMM yyyy").alias("a"), F.date_format("o_orderdate", "MMM d, yyyy").alias("b"), F.date_format("o_orderdate", "yyyy-MM").alias("c"))
    return texts.select("o_orderkey", *[standard.iso_date(F.col(c)).alias(c) for c in "abc"])


@query("written_ranges", "select l_orderkey, l_linenumber::bigint as l_linenumber, round(l_quantity * 1000, 6) as lo, round((l_quantity + 2) * 1000, 6) as hi, 'm' as unit from lineitem")
def written_ranges(spark, root):
    df = table(spark, root, "lineitem")
    text = F.concat(F.col("l_quantity").cast("int"), F.lit(" to "), (F.col("l_quantity") + 2).cast("int"), F.lit(" km"))
    return df.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), standard.measured(text, "m").alias("r")).select("l_orderkey", "l_linenumber", "r.lo", "r.hi", "r.unit")


@query("amounts", "select o_orderkey, round(round(o_totalprice, 2) * 1.25 / 1.1, 4) as amount, 'EUR' as currency from orders")
def amounts(spark, root):
    text = F.concat(F.lit("£"), F.format_number("o_totalprice", 2))
    m = standard.money(text, "EUR", {"GBP": 1.25, "EUR": 1.1})
    return table(spark, root, "orders").select("o_orderkey", m.alias("m")).select("o_orderkey", F.round("m.amount", 4).alias("amount"), "m.currency")


# ------------------------------------------------------------------ evidence and trust
@query("sanity_limits", "select candidate_id, confidence between 0.5 and 0.9 or confidence is null as sane from candidates")
def sanity_limits(spark, root):
    none = F.lit(None).cast("double")
    return table(spark, root, "candidates").select("candidate_id", evidence.sane(F.col("confidence"), none, F.lit(""), [0.5, 0.9]).alias("sane"))


@query("value_in_quote", f"select candidate_id, q <> '' and given and {_sql_states('v', 'q')} as proved from (select candidate_id, raw_value is not null as given, {_sql_plain('raw_value')} as v, {_sql_plain('quote')} as q from candidates)")
def value_in_quote(spark, root):
    rows = table(spark, root, "candidates")
    return rows.select("candidate_id", evidence.value_in_quote(F.col("raw_value"), F.col("quote")).alias("proved"))


@query(
    "quote_proof",
    f"""with p as (select candidate_id, raw_value is not null as given, {_sql_plain('raw_value')} as v, {_sql_plain('c.quote')} as q, {_sql_plain('p.text')} as t from candidates c left join pages p using (page_id)),
    j as (select *, regexp_replace(q, '[^a-z0-9]+', '', 'g') as s, {_sql_states('v', 'q')} as states from p)
    select candidate_id, case when q = '' then '{evidence.NO_QUOTE}' when not (contains(t, q) or (len(s) > 8 and contains(regexp_replace(t, '[^a-z0-9]+', '', 'g'), s))) then '{evidence.NOT_ON_PAGE}' when not (given and states) then '{evidence.NOT_IN_QUOTE}' else '{evidence.VERIFIED}' end as reason, reason = '{evidence.VERIFIED}' as kept from j""",
)
def quote_proof(spark, root):
    rows = table(spark, root, "candidates").select("candidate_id", "raw_value", "quote", "page_id")
    both = rows.join(table(spark, root, "pages").select("page_id", "text"), "page_id", "left")
    return both.select("candidate_id", evidence.proof(F.col("raw_value"), F.col("quote"), F.col("text")).alias("p")).select("candidate_id", "p.kept", "p.reason")


@query("trust_tiers", "select page_id, coalesce(r.tier, 3)::bigint as tier from pages p left join (select domain, min(tier) as tier from ref_source_rank group by 1) r using (domain)")
def trust_tiers(spark, root):
    ranks = {r["domain"]: r["tier"] for r in table(spark, root, "ref_source_rank").groupBy("domain").agg(F.min("tier").alias("tier")).collect()}
    return table(spark, root, "pages").select("page_id", evidence.trust_tier(F.col("domain"), ranks).cast("bigint").alias("tier"))


@query("sentence_count", f"select doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?।])[{_SQL_GAP}]+', '\\1' || chr(10), 'g'), chr(10)), lambda s: regexp_matches(s, '[^{_SQL_GAP}]')))::bigint as n from documents where text is not null")
def sentence_count(spark, root):
    whole = table(spark, root, "documents").where(F.col("text").isNotNull())
    return whole.select("doc_id", F.size(evidence.sentences(F.col("text"))).cast("bigint").alias("n"))





@query("phrase_matches", "select distinct doc_id, n_name as term from documents, (select distinct unnest(['causeway', 'beacon', 'winter count', 'north wall']) as n_name) where text is not null and regexp_matches(' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{Nd}]+', ' ', 'g')) || ' ', ' ' || n_name || ' ')")
def phrase_matches(spark, root):
    terms = spark.createDataFrame([(t,) for t in ("causeway", "beacon", "winter count", "north wall")], "term string")
    return evidence.phrase_matches(table(spark, root, "documents"), terms, "doc_id", "text", "term")


# ------------------------------------------------------------------ conflicts and confidence
@query(
    "source_confidence",
    """with d as (select l_partkey, count(distinct l_suppkey) as n, min(l_linenumber % 4) as t, count(distinct l_returnflag) > 1 as dis from lineitem group by 1)
    select l_partkey, round(greatest(0, least(0.99, case t when 0 then 0.95 when 1 then 0.8 when 2 then 0.6 else 0.4 end + 0.15 * greatest(0, n - 1) - case when dis then 0.2 else 0 end))::double, 3) as confidence from d""",
)
def source_confidence(spark, root):
    rows = table(spark, root, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n"), F.min(F.col("l_linenumber") % 4).alias("t"), (F.count_distinct("l_returnflag") > 1).alias("d"))
    return rows.select("l_partkey", conflict.confidence(F.col("t"), F.col("n"), F.col("d")).alias("confidence"))


@query(
    "agreeing_values",
    """select a.l_partkey, count(*) as pairs, count(*) filter (abs(a.p - b.p) <= greatest(abs(a.p), abs(b.p), 1.0) * 0.02) as agree from (select l_partkey, l_suppkey, min(l_extendedprice / l_quantity) as p from lineitem group by 1, 2) a
    join (select l_partkey, l_suppkey, min(l_extendedprice / l_quantity) as p from lineitem group by 1, 2) b on a.l_partkey = b.l_partkey and a.l_suppkey < b.l_suppkey group by 1""",
)
def agreeing_values(spark, root):
    one = table(spark, root, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    cell = F.struct(F.lit(None).cast("string").alias("value"), F.col("p").alias("value_num"), F.lit(None).cast("double").alias("value_max"))
    a, b = one.select("l_partkey", F.col("l_suppkey").alias("s"), cell.alias("a")), one.select("l_partkey", F.col("l_suppkey").alias("t"), cell.alias("b"))
    return a.join(b, "l_partkey").where("s < t").groupBy("l_partkey").agg(F.count("*").alias("pairs"), F.count_if(conflict.same_value("a", "b")).alias("agree"))


#: The candidates' fields of numbers, by how they are read: quantities and counts, years, months. The rest are texts.
QUANTITIES = (*core_problems.MEASURED, "population")
YEARS, MONTHS = ("first_described", "founded", "printed"), ("flowering_month",)


def _cells(spark, root, fields: Callable[[DataFrame], DataFrame] = lambda c: c) -> DataFrame:
    """Every candidate with a value as a reading of its cell, numbers standardised; `fields` may choose among the rows."""
    c = fields(table(spark, root, "candidates").where(F.col("raw_value").isNotNull()))
    keep = ["subject_id", "field", "raw_value", "tier", "source_id", "fetched_at", "candidate_id"]
    measured = with_numbers(c.where(F.col("field").isin(*QUANTITIES)), table(spark, root, "ref_units"), keep)
    text = standard.normal(F.col("raw_value"))
    year = F.coalesce(F.substring(standard.iso_date(text), 1, 4), F.regexp_extract(text, r"(?<!\d)(\d{4})(?!\d)", 1)).try_cast("double")
    number = F.when(F.col("field").isin(*YEARS), year).when(F.col("field").isin(*MONTHS), standard.month_of(text).cast("double"))
    others = c.where(~F.coalesce(F.col("field").isin(*QUANTITIES), F.lit(False))).select(*keep, number.alias("value_num"), F.lit(None).cast("double").alias("value_max"))
    return measured.unionByName(others).select(F.col("subject_id").alias("entity_id"), F.col("field").alias("name"), text.alias("value"), "value_num", "value_max", F.coalesce("tier", F.lit(3)).alias("tier"), F.col("source_id").alias("domain"), "fetched_at", F.col("candidate_id").alias("seq"))





@query("conflict_trusted_first")
def conflict_trusted_first(spark, root):
    out = conflict.resolved(_cells(spark, root), ["entity_id", "name"], "trusted_first")
    return out.where("status = 'accepted'").select("entity_id", "name", "value", "value_num", "value_max")


@query("conflict_majority")
def conflict_majority(spark, root):
    out = conflict.resolved(_cells(spark, root), ["entity_id", "name"], "majority")
    return out.select("entity_id", "name", "group", "value", "confidence", "status")


def _segments(spark, root) -> DataFrame:
    """Customers as readings of their nation's market segment."""
    c = table(spark, root, "customer")
    none = F.lit(None).cast("double")
    return c.select(F.col("c_nationkey").cast("bigint").alias("entity_id"), F.lit("segment").alias("name"), F.col("c_mktsegment").alias("value"), none.alias("value_num"), none.alias("value_max"), (F.col("c_custkey") % 4).cast("int").alias("tier"), F.concat(F.lit("d"), F.col("c_custkey") % 7).alias("domain"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("fetched_at"), F.col("c_custkey").cast("bigint").alias("seq"))


@query("conflict_newest", "select c_nationkey::bigint as entity_id, arg_max(lower(c_mktsegment), c_custkey) as value from customer group by 1")
def conflict_newest(spark, root):
    return conflict.resolved(_segments(spark, root), ["entity_id", "name"], "newest").where("status = 'accepted'").select("entity_id", F.lower("value").alias("value"))


@query(
    "conflict_by_domains",
    """with g as (select c_nationkey, lower(c_mktsegment) as value, count(distinct c_custkey % 7) as domains, min(c_custkey % 4) as tier, min((c_custkey % 4) * 1000000000 + c_custkey) as first from customer group by 1, 2)
    select c_nationkey::bigint as entity_id, arg_min(value, (-domains, tier, first)) as value, max(domains) as domains from g group by 1""",
)
def conflict_by_domains(spark, root):
    out = conflict.resolved(_segments(spark, root), ["entity_id", "name"], "majority").where("status = 'accepted'")
    return out.select("entity_id", F.lower("value").alias("value"), F.size("domains").cast("bigint").alias("domains"))


@query("held_back_values", "select candidate_id, case when raw_value is null then 'superseded' when coalesce(confidence, 0) < 0.6 then 'review' else 'accepted' end as status from candidates")
def held_back_values(spark, root):
    c = table(spark, root, "candidates").select("candidate_id", "confidence", F.when(F.col("raw_value").isNull(), "superseded").otherwise("accepted").alias("status"))
    return conflict.held_back(c, 0.6).select("candidate_id", "status")


@query("accepted_values", "select candidate_id from candidates where raw_value is not null and coalesce(confidence, 0) >= 0.8 and origin not in ('derived', 'inferred', 'default')")
def accepted_values(spark, root):
    c = table(spark, root, "candidates").withColumn("status", F.when(F.col("raw_value").isNull(), "superseded").otherwise("accepted"))
    return V.accepted(c, 0.8, include_derived=False).select("candidate_id")


# ------------------------------------------------------------------ entities
@query("entity_block_keys", "select p_partkey, unnest(list_distinct(['a' || regexp_replace(k, '[^0-9]', '', 'g') || ':' || left(regexp_replace(k, '[^a-z]', '', 'g'), 3), 'z' || regexp_replace(k, '[^0-9]', '', 'g') || ':' || right(regexp_replace(k, '[^a-z]', '', 'g'), 3)])) as block from (select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) as k from part)")
def entity_block_keys(spark, root):
    return table(spark, root, "part").select("p_partkey", F.explode(resolution.block_keys(standard.comparison_key(F.col("p_name")))).alias("block"))


@query("entities_exact", f"with k as (select entity_type, identity, candidate_id, coalesce(nullif(trim(regexp_replace(lower(identity), '[^a-z0-9]+', ' ', 'g')), ''), lower({_sql_normal('identity')})) as key from candidates where identity is not null) select entity_type, arg_min(identity, candidate_id) as canonical_name, count(*) as rows from k where key <> '' group by entity_type, key")
def entities_exact(spark, root):
    rows = table(spark, root, "candidates").select("entity_type", "identity", F.col("candidate_id").alias("seq"))
    return resolution.resolve(rows, fuzzy=False).where("entity_id is not null").groupBy("entity_id", "entity_type", "canonical_name").agg(F.count("*").alias("rows")).select("entity_type", "canonical_name", "rows")





@query("entities_fuzzy")
def entities_fuzzy(spark, root):
    rows = table(spark, root, "candidates").select("entity_type", "identity", F.col("candidate_id").alias("seq"))
    return resolution.resolve(rows).where("entity_id is not null").groupBy("entity_id", "entity_type", "canonical_name").agg(F.count("*").alias("rows"))


# ------------------------------------------------------------------ relations and reports
@query("related_count", "select n_nationkey::bigint as entity_id, n_name, (select count(*) from customer where c_nationkey = n_nationkey) as customers from nation")
def related_count(spark, root):
    edges = table(spark, root, "customer").select((F.col("c_custkey") + 1000000).alias("from_id"), F.lit("lives_in").alias("relation"), F.col("c_nationkey").cast("bigint").alias("to_id"))
    nations = table(spark, root, "nation").select(F.col("n_nationkey").cast("bigint").alias("entity_id"), "n_name")
    return relations.related_count(nations, edges, "lives_in", name="customers")


@query("related_sum", "select n_nationkey::bigint as entity_id, round(sum(c_acctbal), 2) as total from nation left join customer on c_nationkey = n_nationkey group by 1")
def related_sum(spark, root):
    c = table(spark, root, "customer").withColumn("id", F.col("c_custkey") + 1000000)
    edges = c.select(F.col("id").alias("from_id"), F.lit("lives_in").alias("relation"), F.col("c_nationkey").cast("bigint").alias("to_id"))
    nations = table(spark, root, "nation").select(F.col("n_nationkey").cast("bigint").alias("entity_id"))
    return relations.related_sum(nations, edges, "lives_in", c.select(F.col("id").alias("entity_id"), F.col("c_acctbal").alias("value_num"))).withColumn("total", F.round("total", 2))


def _values(spark, root) -> DataFrame:
    c = table(spark, root, "candidates")
    return c.select(F.col("subject_id").alias("entity_id"), "entity_type", F.col("field").alias("name"), F.col("raw_value").alias("value"), "origin", "confidence", "tier", "page_id", F.when(F.col("raw_value").isNull(), "superseded").when(F.coalesce("confidence", F.lit(0.0)) < 0.5, "review").otherwise("accepted").alias("status"))


@query(
    "coverage",
    """with v as (select subject_id, entity_type, field as name from candidates where raw_value is not null and coalesce(confidence, 0) >= 0.5), t as (select entity_type, count(distinct subject_id) as total from candidates group by 1),
    f as (select distinct entity_type, field as name from candidates) select f.entity_type, f.name, count(distinct v.subject_id) as filled, t.total, round(100.0::double * count(distinct v.subject_id) / t.total, 1) as percent from f left join v using (entity_type, name) join t using (entity_type) group by f.entity_type, f.name, t.total""",
)
def coverage(spark, root):
    c = table(spark, root, "candidates")
    fields = c.select("entity_type", F.col("field").alias("name")).distinct()
    totals = c.groupBy("entity_type").agg(F.count_distinct("subject_id").alias("total"))
    return relations.coverage(_values(spark, root), fields, totals).select("entity_type", "name", "filled", "total", "percent")


@query(
    "gaps",
    """with v as (select distinct subject_id, field as name from candidates where raw_value is not null and coalesce(confidence, 0) >= 0.5), e as (select distinct subject_id, entity_type from candidates), f as (select distinct entity_type, field as name from candidates)
    select e.entity_type, f.name, count(*) as missing from e join f using (entity_type) left join v on v.subject_id = e.subject_id and v.name = f.name where v.name is null group by 1, 2""",
)
def gaps(spark, root):
    c = table(spark, root, "candidates")
    entities = c.groupBy(F.col("subject_id").alias("entity_id"), "entity_type").agg(F.min("identity").alias("canonical_name"))
    return relations.gaps(entities, _values(spark, root), c.select("entity_type", F.col("field").alias("name")).distinct()).select("entity_type", "name", "missing")


@query(
    "source_health",
    """with v as (select page_id, count(*) as v, count(*) filter (raw_value is not null and coalesce(confidence, 0) < 0.5) as r, count(*) filter (raw_value is null) as s, min(tier) as t from candidates group by 1)
    select domain, count(distinct page_id) as pages, coalesce(sum(v), 0)::bigint as "values", coalesce(sum(r), 0)::bigint as review, coalesce(sum(s), 0)::bigint as superseded, min(t)::bigint as best_tier from pages left join v using (page_id) group by 1""",
)
def source_health(spark, root):
    out = relations.source_health(table(spark, root, "pages"), _values(spark, root))
    return out.select("domain", "pages", "values", "review", "superseded", F.col("best_tier").cast("bigint").alias("best_tier"))


@query("gold_accuracy", "with f as (select subject_id, field, arg_min(lower(trim(raw_value)), candidate_id) as v from candidates where raw_value is not null group by 1, 2), g as (select subject_id, field, arg_max(lower(trim(coalesce(raw_value, ''))), candidate_id) as w from candidates group by 1, 2) select count(*) as total, count(v) as found, count(*) filter (v = w) as correct, count(*) filter (v <> w) as wrong, count(*) - count(v) as missing, round(100.0::double * count(v) / count(*), 1) as coverage, round(100.0::double * count(*) filter (v = w) / count(v), 1) as accuracy from g left join f using (subject_id, field)")
def gold_accuracy(spark, root):
    c = table(spark, root, "candidates")
    text = F.lower(F.trim(F.coalesce("raw_value", F.lit(""))))
    found = c.where("raw_value is not null").groupBy("subject_id", "field").agg(F.min_by(text, "candidate_id").alias("value"), F.max("confidence").alias("confidence"))
    gold = c.groupBy("subject_id", "field").agg(F.max_by(text, "candidate_id").alias("gold"))
    return relations.gold_accuracy(found, gold, ["subject_id", "field"], F.col("value") == F.col("gold")).drop("confident_accuracy")


@query("declared_defaults", "with d(entity_type, name, value) as (values ('plant', 'family', 'unplaced'), ('place', 'region', 'nowhere'), ('book', 'author_name', 'anonymous')), e as (select distinct subject_id, entity_type from candidates) select e.subject_id as entity_id, d.name, d.value from e join d using (entity_type) where not exists (select 1 from candidates c where c.subject_id = e.subject_id and c.field = d.name)")
def declared_defaults(spark, root):
    v = _values(spark, root)
    entities = v.select("entity_id", "entity_type").distinct()
    given = {("plant", "family"): "unplaced", ("place", "region"): "nowhere", ("book", "author_name"): "anonymous"}
    return relations.with_defaults(v, entities, given).where("origin = 'default'").select("entity_id", "name", "value")


@query("latest_pages", "select url, arg_max(page_id, (fetched_at is not null, coalesce(fetched_at, ''), coalesce(content_hash, ''), page_id)) as page_id from pages group by 1")
def latest_pages(spark, root):
    p = table(spark, root, "pages").withColumn("content_hash", F.concat(F.coalesce("content_hash", F.lit("")), F.lpad(F.col("page_id").cast("string"), 20, "0")))
    return records.latest_pages(p).select("url", "page_id")


# ------------------------------------------------------------------ pages, search, records
@query("page_addresses", "select page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '([^/])/+$', '\\1') as url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][\\w+.-]*://(?:[^/@?#]*@)?([^/?#]*)', 1)), '^www\\.', '') as host from pages where url is not null")
def page_addresses(spark, root):
    return table(spark, root, "pages").where("url is not null").select("page_id", pages.clean_url(F.col("url")).alias("url"), pages.domain_of(F.col("url")).alias("host"))


@query("page_relevance", "select page_id, (least(len(regexp_extract_all(lower(coalesce(text, '')), 'winter')), 10) + case when contains(lower(coalesce(title, '')), 'winter') then 5 else 0 end + least(len(regexp_extract_all(lower(coalesce(text, '')), 'scree')), 10) + case when contains(lower(coalesce(title, '')), 'scree') then 5 else 0 end)::double as relevance from pages")
def page_relevance(spark, root):
    return table(spark, root, "pages").select("page_id", pages.relevance(F.col("title"), F.col("text"), ["winter", "scree"]).alias("relevance"))


@query("content_hashes", "select page_id, left(sha256(text), 32) as hash from pages")
def content_hashes(spark, root):
    return table(spark, root, "pages").select("page_id", F.left(F.sha2(F.encode("text", "UTF-8"), 256), F.lit(32)).alias("hash"))


@query("parsed_pages")
def parsed_pages(spark, root):
    p = table(spark, root, "pages")
    body = F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title></head><body><nav>menu</nav><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1><p>"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p></body></html>"))
    return pages.parse_pages(p.select("url", body.alias("html"))).select("url", "title", "headings", "word_count")


@query("ranked_search")
def ranked_search(spark, root):
    return search.search(table(spark, root, "pages"), "winter count", limit=20)


@query("term_index", """with c as (select page_id, title as t, 4.0::double as w from pages union all select page_id, description, 2.0 from pages union all select page_id, headings, 2.0 from pages union all select page_id, text, 1.0 from pages),
    w as (select page_id, w, unnest(list_filter(regexp_split_to_array(lower(t), '[^\\p{L}\\p{M}\\p{Nd}]+'), lambda x: x <> '')) as term from c where t is not null) select term, page_id, sum(w) as tf from w group by 1, 2""")
def term_index(spark, root):
    return search.build_index(table(spark, root, "pages"))





@query("corpus_totals", "select count(*) as pages, count(distinct domain) as domains, sum(word_count)::bigint as words from pages")
def corpus_totals(spark, root):
    return search.corpus_stats(table(spark, root, "pages"))[0]


@query("json_flatten", "select event_id, json_extract_string(props, '$.k') as k from events")
def json_flatten(spark, root):
    e = table(spark, root, "events").select("event_id", F.from_json("props", "k string").alias("props"))
    return e.select("event_id", *records.flat_columns(e.select("props").schema)).withColumnRenamed("props.k", "k")


@query("record_fields", "select 'nation#' || n_nationkey as url, 'n_name' as name, n_name as value from nation union all select 'nation#' || n_nationkey, 'n_nationkey', n_nationkey::varchar from nation union all select 'nation#' || n_nationkey, 'n_regionkey', n_regionkey::varchar from nation")
def record_fields(spark, root):
    return records.record_rows(table(spark, root, "nation"), "nation", "n_nationkey")[1]


@query("formula_numbers", "select p_partkey, coalesce(p_retailprice, 0) + p_size as total, (p_retailprice is not null)::int + (p_size is not null)::int as filled, floor(p_retailprice / 7) as low, ceil(p_retailprice / 7) as high, (p_size + p_retailprice) / 2 as middle, asin(p_size / 100.0) as a, acos(p_size / 100.0) as c, atan2(p_size, 3) as t from part")
def formula_numbers(spark, root):
    p = table(spark, root, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return formulas(p, ["p_partkey"], {"total": "sum(p_retailprice, p_size)", "filled": "count(p_retailprice, p_size)", "low": "floor(p_retailprice / 7)", "high": "ceil(p_retailprice / 7)", "middle": "midpoint(p_size, p_retailprice)", "a": "asin(p_size / 100)", "c": "acos(p_size / 100)", "t": "atan2(p_size, 3)"})


@query("lookup_bands", "select p_partkey, p_size, case when p_size < 10 then 'small' when p_size < 30 then 'middle' else 'large' end as band, case when p_size < 10 then 's' when p_retailprice > 1500 then 'dear' else 'other' end as rule from part")
def lookup_bands(spark, root):
    p = table(spark, root, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    ds = [Derivation("band", method="lookup", inputs=("p_size",), cutoffs=(10, 30), labels=("small", "middle", "large")), Derivation("rule", method="rules", rules=(("p_size < 10", "'s'"), ("p_retailprice > 1500", "'dear'"), (None, "'other'")))]
    return derive(p, ds).select("p_partkey", F.col("p_size").cast("int").alias("p_size"), "band", "rule")


# ------------------------------------------------------------------ extraction and reports
#: A project of the pages' own fields, for the queries of this part.
_PROJECT = from_dict({"entities": {"entry": {"identity": "sheet", "fields": [{"name": "sheet", "extract": r"regex:\b\d{2,3}-\d{3}\b"}, {"name": "span", "multiple": True, "extract": r"regex:\b\d+ (?:m|km)\b"}]}}})


@query(
    "rule_candidates",
    r"""with s as (select page_id, regexp_extract_all(coalesce(text, ''), '\b\d{2,3}-\d{3}\b') as sheets, regexp_extract_all(coalesce(text, ''), '(?i)\b\d+ (?:m|km)\b') as spans, headings, title from pages),
    i as (select *, coalesce(sheets[1], nullif(""" + _sql_normal("split_part(coalesce(headings, ''), '|', 1)") + r""", ''), nullif(""" + _sql_normal("split_part(split_part(coalesce(title, ''), '|', 1), ' - ', 1)") + r""", '')) as identity from s)
    select page_id, 'sheet' as field, sheets[1] as raw_value from i where len(sheets) > 0 and identity is not null union all select page_id, 'span', unnest(spans) from i where identity is not null""",
)
def rule_candidates(spark, root):
    nothing = spark.createDataFrame([], "page_id bigint, name string, value string")
    return extraction.by_rules(table(spark, root, "pages"), nothing, _PROJECT.primary).select("page_id", "field", "raw_value")


@query("provenance_rows", "select c.subject_id as entity_id, c.field as name, c.raw_value as value, p.url, p.fetched_at from candidates c left join pages p using (page_id) where c.raw_value is not null")
def provenance_rows(spark, root):
    v = table(spark, root, "candidates").where("raw_value is not null").select(F.col("subject_id").alias("entity_id"), F.col("field").alias("name"), F.col("raw_value").alias("value"), "origin", "confidence", "tier", "quote", "page_id", F.lit("accepted").alias("status"))
    return normal_forms.provenance(v, table(spark, root, "pages")).select("entity_id", "name", "value", "url", "fetched_at")


@query("named_junction", "select distinct c_custkey::bigint as customer_id, c_nationkey::bigint as nation_id, n_name as nation_name from customer left join nation on n_nationkey = c_nationkey")
def named_junction(spark, root):
    pairs = table(spark, root, "customer").select(F.col("c_custkey").cast("bigint").alias("customer_id"), F.col("c_nationkey").cast("bigint").alias("nation_id"))
    names = table(spark, root, "nation").select(F.col("n_nationkey").cast("bigint").alias("entity_id"), F.col("n_name").alias("canonical_name"))
    return normal_forms.named_junction(pairs, names, "customer_id", "nation_id")


@query("identifier_rows", "with n as (select subject_id as entity_id, lower(trim(identity)) as k from candidates where identity is not null union select c.subject_id, lower(trim(a.alias)) from candidates c join alias_candidates a on a.page_id = c.page_id and a.alias is not null), r as (select distinct alias as name, language as authority, alias_id as identifier from alias_candidates where alias is not null) select distinct entity_id, authority, identifier from n join r on lower(trim(r.name)) = n.k where n.k <> ''")
def identifier_rows(spark, root):
    c, a = table(spark, root, "candidates"), table(spark, root, "alias_candidates")
    entities = c.select(F.col("subject_id").alias("entity_id"), F.col("identity").alias("canonical_name")).where("canonical_name is not null").distinct()
    aliases = c.select(F.col("subject_id").alias("entity_id"), "page_id").distinct().join(a.where("alias is not null").select("page_id", "alias"), "page_id").select("entity_id", "alias")
    registry = a.where("alias is not null").select(F.col("alias").alias("name"), F.col("language").alias("authority"), F.col("alias_id").alias("identifier"))
    return normal_forms.identifiers(registry, entities, aliases)


@query("held_back_sources", "select domain, tier::bigint as tier, count(*) as n, max(confidence) as confidence from candidates where raw_value is not null and coalesce(confidence, 0) < 0.5 group by 1, 2 order by n desc, domain nulls first, tier nulls first limit 3")
def held_back_sources(spark, root):
    c = table(spark, root, "candidates").select("domain", "tier", "confidence", F.when(F.col("raw_value").isNotNull() & (F.coalesce("confidence", F.lit(0.0)) < 0.5), "review").otherwise("accepted").alias("status"))
    return report.held_back(c).withColumn("tier", F.col("tier").cast("bigint"))


@query("rule_health", "select f.name, (select count(*) from pages) as tried, count(distinct p.page_id) as matched, max(p.fetched_at) as last_seen from (select distinct name from field_specs) f left join page_fields v on v.name = f.name and v.value is not null left join pages p on p.page_id = v.page_id group by 1")
def rule_health(spark, root):
    names = [n for n, _, _ in core_problems.field_specs(spark, root)]
    return report.rule_health(table(spark, root, "pages"), table(spark, root, "page_fields"), names)


@query("filled_fields", "select entity_type, field as name, count(distinct subject_id) as filled from candidates where raw_value is not null and coalesce(confidence, 0) >= 0.5 group by 1, 2")
def filled_fields(spark, root):
    return report.filled_fields(_values(spark, root))


@query("top_fields", "select field as name, count(*) as n from candidates group by 1 order by n desc, name limit 10")
def top_fields(spark, root):
    return report.top_fields(_values(spark, root))


@query("rejections", "select entity_type || '.' || field as what, case when quote is null or trim(quote) = '' then 'no quote' else 'low' end as reason, count(*) as n from candidates where coalesce(confidence, 0) < 0.5 and entity_type is not null and field is not null group by 1, 2 order by n desc, what, reason limit 6")
def rejections(spark, root):
    c = table(spark, root, "candidates").where("coalesce(confidence, 0) < 0.5 and entity_type is not null and field is not null")
    return report.rejections(c.withColumn("reason", F.when(F.coalesce(F.trim("quote"), F.lit("")) == "", "no quote").otherwise("low")))


@query("derived_lineage", "select p_partkey::bigint as entity_id, round(least(0.9, 0.5 + (p_size % 5) * 0.1)::double, 6) as confidence, (p_partkey::bigint * 2)::varchar || ',' || (p_partkey::bigint * 2 + 1)::varchar as inputs from part")
def derived_lineage(spark, root):
    p = table(spark, root, "part").select(F.col("p_partkey").cast("bigint").alias("entity_id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    v = p.select("entity_id", F.inline(F.array(F.struct(F.lit("size").alias("name"), (F.col("entity_id") * 2).alias("value_id"), (0.5 + (F.col("size") % 5) * 0.1).alias("confidence")), F.struct(F.lit("price").alias("name"), (F.col("entity_id") * 2 + 1).alias("value_id"), F.lit(0.9).alias("confidence"))))).withColumns({"origin": F.lit("extracted"), "status": F.lit("accepted")})
    ds = [Derivation("unit_price", "price / size")]
    return derived_rows(derive(p, ds), v, ds, "part").select("entity_id", "confidence", F.array_join(F.transform("inputs", lambda i: i.cast("string")), ",").alias("inputs"))


# ------------------------------------------------------------------ normal forms, SQL, windows
@query("functional_dependencies", "select 'n_name' as dependent, bool_and(d = 1) as holds from (select n_nationkey, count(distinct n_name) as d from nation group by 1) union all select 'n_regionkey', bool_and(d = 1) from (select n_nationkey, count(distinct n_regionkey) as d from nation group by 1)")
def functional_dependencies(spark, root):
    got = normal_forms.determines(table(spark, root, "nation"), "n_nationkey", ["n_name", "n_regionkey"])
    return spark.createDataFrame(list(got.items()), "dependent string, holds boolean")


@query("normal_form_check")
def normal_form_check(spark, root):
    t = normal_forms.Table("lineitem", table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), ["l_orderkey", "l_linenumber"])
    return spark.createDataFrame([(p,) for p in normal_forms.check([t], "3NF")], "problem string")


@query("rejoin_spurious", "with t as (select distinct l_suppkey % 7 as a, l_linenumber as b, l_returnflag as c from lineitem) select (select count(*) from (select distinct x.a, x.b, y.c from (select distinct a, b from t) x join (select distinct a, c from t) y on x.a = y.a join (select distinct b, c from t) z on z.b = x.b and z.c = y.c)) - (select count(*) from t) as extra")
def rejoin_spurious(spark, root):
    t = table(spark, root, "lineitem").select((F.col("l_suppkey") % 7).alias("a"), F.col("l_linenumber").alias("b"), F.col("l_returnflag").alias("c"))
    return spark.createDataFrame([(normal_forms.spurious_rows(t, ["a", "b", "c"]),)], "extra bigint")


@query("attribute_6nf", "select n_nationkey::bigint as entity_id, n_name, null::varchar as valid_from, null::varchar as valid_to from nation")
def attribute_6nf(spark, root):
    long = V.to_long(table(spark, root, "nation").select(F.col("n_nationkey").cast("bigint").alias("entity_id"), "n_name"), "entity_id", ["n_name"])
    return normal_forms.attribute_tables(long, ["n_name"])["n_name"]


@query("sql_passthrough", "select n_name, count(c_custkey) as customers from nation left join customer on c_nationkey = n_nationkey group by n_name having count(c_custkey) > 0")
def sql_passthrough(spark, root):
    views = {n: table(spark, root, n) for n in ("nation", "customer")}
    return sqlgate.query(spark, "select n_name, count(c_custkey) as customers from nation left join customer on c_nationkey = n_nationkey group by n_name having count(c_custkey) > 0", views)


@query("event_windows", "select epoch_us(time_bucket(interval '1 hour', ts, timestamp '1970-01-01')) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark, root):
    w = landing.windowed(table(spark, root, "events"), "ts", ["event_type"], "1 hour")
    return w.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "event_sessions",
    """with g as (select *, coalesce(ts >= lag(ts) over (partition by user_id order by ts) + interval '30 minutes', true) as new from events), s as (select *, sum(new::int) over (partition by user_id order by ts rows unbounded preceding) as k from g)
    select user_id, epoch_us(min(ts)) as start, count(*) as n from s group by user_id, k""",
)
def event_sessions(spark, root):
    return landing.sessions(table(spark, root, "events"), "ts", "user_id", "30 minutes").select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "n")
