"""Ranked full-text search over an inverted index, and counts of a corpus."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights of the indexed columns, and the constants of BM25.
WEIGHTS = {"title": 4.0, "description": 2.0, "headings": 2.0, "text": 1.0}
K1, B = 1.2, 0.75


def terms(query: str) -> list[str]:
    """The query's words; letters and digits only, without case, each once."""
    return list(dict.fromkeys(re.findall(r"\w+", query.lower())))


def _words(c: str):
    return F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{M}\p{Nd}]+"), lambda w: w != "")


def build_index(pages: DataFrame, page: str = "page_id", columns: dict[str, float] | None = None) -> DataFrame:
    """(`term`, `page`, tf): weighted term frequencies; each page's terms are counted before the shuffle."""
    parts = [pages.select(page, F.explode(_words(c)).alias("term"), F.lit(w).alias("w")) for c, w in (columns or WEIGHTS).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("term", page).agg(F.sum("w").alias("tf"))


def lengths(pages: DataFrame, page: str = "page_id", columns: dict[str, float] | None = None) -> DataFrame:
    total = sum((F.size(_words(c)) * F.lit(w) for c, w in (columns or WEIGHTS).items()), F.lit(0.0))
    return pages.select(page, total.alias("length"))


def search(pages: DataFrame, query: str, limit: int = 20, domain: str | None = None, any_term: bool = False, page: str = "page_id", columns: dict[str, float] | None = None) -> DataFrame:
    """The best pages for a query: page, url, title, score, snippet; all terms must occur, or any.

    Only rows that hold a term are looked at; the corpus contributes its size, mean length and
    each term's document count. Ties go to the smaller page id; `limit` is the report's length.
    """
    wanted, cols = terms(query), columns or WEIGHTS
    base = pages.where(F.col("domain") == domain) if domain else pages
    if not wanted:
        return base.limit(0).select(page, "url", "title", F.lit(0.0).alias("score"), F.lit("").alias("snippet"))
    # Words are counted by patterns, without cutting texts up; terms only where the plain text holds them.
    edge = r"[\p{L}\p{M}\p{Nd}]"
    low = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in cols}
    hits = lambda c, t: F.when(F.contains(low[c], F.lit(t)), F.regexp_count(low[c], F.lit(f"(?<!{edge}){re.escape(t)}(?!{edge})"))).otherwise(0)
    counts = [sum((hits(c, t) * F.lit(w) for c, w in cols.items()), F.lit(0.0)).alias(f"_t{i}") for i, t in enumerate(wanted)]
    length = sum((F.regexp_count(low[c], F.lit(f"{edge}+")) * F.lit(w) for c, w in cols.items()), F.lit(0.0)).alias("_length")
    scored = base.select(page, "url", "title", "text", length, *counts)
    stats = scored.agg(F.count("*").alias("_n"), F.avg("_length").alias("_mean"), *[F.count_if(F.col(f"_t{i}") > 0).alias(f"_d{i}") for i in range(len(wanted))])
    both = scored.crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    present = F.lit(not any_term)
    for i in range(len(wanted)):
        tf, df = F.col(f"_t{i}"), F.col(f"_d{i}")
        idf = F.greatest(F.lit(1e-6), F.log((F.col("_n") - df + 0.5) / (df + 0.5)))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_length") / F.col("_mean")))
        present = (present | (tf > 0)) if any_term else (present & (tf > 0))
    at = F.least(*[F.coalesce(F.nullif(F.locate(t, F.lower("text")), F.lit(0)), F.lit(1 << 30)) for t in wanted], F.lit(1 << 30))
    snippet = F.when(at < (1 << 30), F.substring(F.col("text"), F.greatest(F.lit(1), at - 40), F.lit(160))).otherwise(F.substring("text", 1, 160))
    return both.where(present).select(page, "url", "title", F.round(score, 6).alias("score"), snippet.alias("snippet")).orderBy(F.desc("score"), page).limit(limit)


def corpus_stats(pages: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """One row of totals, and the largest domains."""
    totals = pages.agg(F.count("*").alias("pages"), F.count_distinct("domain").alias("domains"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))
    return totals, pages.groupBy("domain").agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "domain").limit(top)


def search_or_any(pages: DataFrame, query: str, limit: int = 20, domain: str | None = None) -> DataFrame:
    """`search` for all terms, and where no page holds them all, for any of them."""
    whole = search(pages, query, limit, domain)
    return search(pages, query, limit, domain, any_term=True) if len(terms(query)) > 1 and whole.isEmpty() else whole


def match_expression(query: str, any_term: bool = False) -> str:
    """The query as an expression of quoted terms, joined by AND or OR."""
    return (" OR " if any_term else " AND ").join(f'"{t}"' for t in terms(query))


def indexed_search(index: DataFrame, page_lengths: DataFrame, query: str, limit: int = 20, any_term: bool = False, page: str = "page_id") -> DataFrame:
    """(`page`, score): the best pages by a stored `build_index` and its `lengths`; only the query's terms are read from it.

    Stored by term, the index is pruned to the terms' files. BM25 as in `search`; ties go to the smaller id.
    """
    wanted = terms(query)
    hits = index.where(F.col("term").isin(*wanted))
    stats = page_lengths.agg(F.count("*").alias("_n"), F.avg("length").alias("_mean"))
    counts = hits.groupBy("term").agg(F.count("*").alias("_d"))
    both = hits.join(F.broadcast(counts), "term").join(page_lengths, page).crossJoin(F.broadcast(stats))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("_n") - F.col("_d") + 0.5) / (F.col("_d") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("_mean")))
    scored = both.groupBy(page).agg(F.sum(part).alias("score"), F.count("*").alias("_t"))
    kept = scored if any_term else scored.where(F.col("_t") == len(wanted))
    return kept.select(page, F.round("score", 6).alias("score")).orderBy(F.desc("score"), page).limit(limit)


def page_detail(pages: DataFrame, fields: DataFrame, values: DataFrame, ids: list[int]) -> DataFrame:
    """Pages with their fields and the values found on them, as lists."""
    mine = lambda df: df.where(F.col("page_id").isin(*ids))
    told = mine(fields).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("fields"))
    found = mine(values).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("name", "value", "status"))).alias("values"))
    return mine(pages).join(told, "page_id", "left").join(found, "page_id", "left")
