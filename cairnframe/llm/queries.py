"""Registered queries of the text-corpus problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.functions.text import MISSING, instant
from cairnframe.llm import containers, entities, main_text, mojibake, records, site_lines, survivors, tokens
from cairnframe.session import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return main_text.furniture_lines(table(spark, root, "pages"))


def p4_keys(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The stored keys, and the ledger after two batches: landed before and after the middle of the landing time."""
    keys = records.keep_keys(table(spark, root, "pages"))
    low, high = keys.agg(F.min("at"), F.max("at")).first()
    middle = low + (high - low) / 2 if low is not None else None
    late = F.coalesce(F.col("at") >= F.lit(middle), F.lit(True))
    return keys, records.record_ledger(keys, late, [False, True])


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return records.copy_pairs(*p4_keys(spark, root))


def p4_ledger(spark: SparkSession, root: str) -> DataFrame:
    _, ledger = p4_keys(spark, root)
    return ledger.select(F.lower(F.hex("key")).alias("key"), "copies", F.col("first_id").alias("page_id"), F.col("first_at"))


def p4_members(spark: SparkSession, root: str) -> DataFrame:
    """Each page under its record: the record's number of copies and its earliest page."""
    keys, ledger = p4_keys(spark, root)
    return records.members(keys, ledger).select(F.col("id").alias("page_id"), F.col("first_id").alias("representative"), "copies")


#: The attributes of the candidates' entity types; altitudes are given as ranges, whose middles vary more.
P5_FIELDS = {
    "plant": [entities.Field(n, k, t) for n, k, t in (("first_described", "year", 0), ("region", "text", 0), ("family", "text", 0), ("flowering_month", "month", 0), ("altitude_m", "number", 0.1), ("height", "number", 0.05), ("lifespan", "number", 0.05), ("min_temperature", "degree", 0.9), ("seed_mass", "number", 0.05))],
    "place": [entities.Field(n, k, t) for n, k, t in (("founded", "year", 0), ("region", "text", 0), ("population", "number", 0.05), ("area", "number", 0.05), ("elevation", "number", 0.05), ("mean_temperature", "degree", 0.9))],
    "book": [entities.Field(n, k, t) for n, k, t in (("printed", "year", 0), ("author_name", "text", 0), ("subject", "text", 0), ("weight", "number", 0.05), ("loan_period", "number", 0.05), ("spine_height", "number", 0.05))],
}


def p5_matches(spark: SparkSession, root: str) -> DataFrame:
    return entities.matches(table(spark, root, "candidates"), table(spark, root, "alias_candidates"), table(spark, root, "ref_units"), P5_FIELDS)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return p5_matches(spark, root).select("subject_a", "subject_b")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return survivors.survivors(table(spark, root, "candidates"), ["subject_id", "field"])


def p6_fused(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "candidates").withColumns({"at": instant(F.col("fetched_at")), "name": survivors.name_key(F.col("identity"))})
    return survivors.fused_values(rows, ["entity_type", "name", "field"], "domain", "raw_value", "at")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, root, "pages"))


def p7_blocks(spark: SparkSession, root: str) -> DataFrame:
    return site_lines.repeated_blocks(table(spark, root, "pages")).drop("line_nos")


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokens.encoded(table(spark, root, "documents"))


def p9_containers(spark: SparkSession, root: str) -> DataFrame:
    return containers.containers(tokens.token_counts(table(spark, root, "documents")), 2048)


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return mojibake.restored_hashes(mojibake.repaired(table(spark, root, "documents")))


QUERIES = {"p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found, "p1_found": p1_found, "p4_found": p4_found, "p4_ledger": p4_ledger, "p4_members": p4_members, "p5_found": p5_found, "p5_matches": p5_matches, "p6_found": p6_found, "p6_fused": p6_fused, "p7_found": p7_found, "p7_blocks": p7_blocks}
_BLANKS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_MISSING = ", ".join(f"'{m}'" for m in MISSING)

_BARE = "lower(upper(regexp_replace({}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g')))".format
#: Pages with their title and canonical text, parts sorted.
_RECORDS = f"""with p as (select page_id, landed_at, coalesce({_BARE('title')}, '') as t, {_BARE('text')} as b, text from pages where text is not null),
        k as (select page_id, landed_at, t, case when regexp_matches(text, '(?s)^\\s*[^:;|\\n]{{1,40}}:\\s[^;|\\n]*(?:\\s*[;|\\n•·]\\s*[^:;|\\n]{{1,40}}:\\s[^;|\\n]*)+[;|\\n]?\\s*$')
        then '=' || array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(text, '\\s*[;|\\n•·]+\\s*'), lambda x: {_BARE('x')}), lambda x: x <> '')), chr(31)) else b end as k from p where b <> '')"""

#: Lines that hold words, by position among these, and those that stand on eight pages of their domain.
_LINES = """with l as (select page_id, domain, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from pages where text is not null and domain is not null),
        t as (select page_id, domain, line_no, trim(regexp_replace(lower(upper(line)), '[^\\p{L}\\p{M}\\p{Nd}]+', ' ', 'g')) as words from l),
        w as (select *, row_number() over (partition by page_id order by line_no) as k from t where words <> ''),
        r as (select domain, words from w group by 1, 2 having count(distinct page_id) >= 8)"""

#: SQL for the queries that SQL can state; the others are tested against brute force, round trips and the public library.
ORACLES: dict[str, str] = {
    "p6_found": f"""with c as (select *, raw_value is null or lower(trim(regexp_replace(raw_value, '{_BLANKS}', ' ', 'g'))) in ({_MISSING}) as missing,
        regexp_replace(trim(fetched_at), '^(\\d{{4}})(\\d{{2}})(\\d{{2}})T(\\d{{2}})(\\d{{2}})(\\d{{2}})', '\\1-\\2-\\3T\\4:\\5:\\6') as t from candidates),
        r as (select *, try_cast(case when regexp_matches(t, '(Z|[+-]\\d{{2}}:?\\d{{2}})$') then t else t || 'Z' end as timestamptz) as seen from c),
        k as (select subject_id, field, candidate_id, missing, count(*) over (partition by subject_id, field) as n, row_number() over (partition by subject_id, field order by missing, tier nulls last, confidence desc nulls last, seen desc nulls last, candidate_id) as k from r)
        select subject_id, field, candidate_id from k where n >= 2 and k = 1 and not missing""",
    "p4_found": f"""{_RECORDS} select a.page_id as page_a, b.page_id as page_b from k a join k b on a.t = b.t and a.k = b.k and a.page_id < b.page_id""",
    "p4_ledger": f"""{_RECORDS} select md5(t || chr(30) || k) as key, count(*) as copies, arg_min(page_id, (landed_at is null, landed_at, page_id)) as page_id, min(landed_at) as first_at from k group by t, k""",
    "p4_members": f"""{_RECORDS} select page_id, first_value(page_id) over (partition by t, k order by landed_at nulls last, page_id) as representative, count(*) over (partition by t, k) as copies from k""",
    "p7_found": f"""{_LINES} select page_id, line_no::bigint as line_no from w join r using (domain, words)""",
    # Every part of every run of neighbouring repeated lines is counted; the longest at each position stays unless it lies inside one begun earlier.
    "p7_blocks": f"""{_LINES}, x as (select w.page_id, domain, w.k, line_no, words, w.k - row_number() over (partition by w.page_id order by w.k) as run from w join r using (domain, words)),
        s as (select page_id, domain, run, list(words order by k) as ws, list(line_no order by k) as nos from x group by all),
        p as (select page_id, domain, run, ws, nos, i, unnest(range(1, len(ws) - i + 2)) as n from (select *, unnest(range(1, len(ws) + 1)) as i from s)),
        b as (select page_id, run, i, n, nos[i] as first_line, domain || chr(31) || array_to_string(ws[i : i + n - 1], chr(30)) as block from p),
        c as (select block, n from b group by 1, 2 having count(distinct page_id) >= 8),
        m as (select page_id, run, i, first_line, max(n) as lines from b join c using (block, n) group by 1, 2, 3, 4),
        e as (select *, max(i + lines) over (partition by page_id, run order by i rows between unbounded preceding and 1 preceding) as reach from m)
        select page_id, first_line, lines::int as lines from e where reach is null or reach < i + lines""",
}
