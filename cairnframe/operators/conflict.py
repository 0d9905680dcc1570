"""Sources that disagree about one cell: agreement, grouping, rules and confidence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnframe.operators.groups import map_groups

TOLERANCE = 0.02
# Fixed values of the score: a source's base by tier, the bonus of each further domain, the cost of disagreement.
BASE, BONUS, PENALTY, CEILING, INFERRED = {0: 0.95, 1: 0.80, 2: 0.60, 3: 0.40}, 0.15, 0.20, 0.99, 0.45


def same_value(a: str, b: str) -> Column:
    """Whether the values of struct columns `a` and `b` (value, value_num, value_max) agree.

    Numbers agree within 2 %; a point agrees with a range that holds it, widened by 2 %; ranges
    agree at both ends; other values as text without case.
    """
    x, y, p, q = (F.col(f"{s}.{c}") for s, c in ((a, "value_num"), (b, "value_num"), (a, "value_max"), (b, "value_max")))
    near = lambda u, v: F.abs(u - v) <= F.greatest(F.abs(u), F.abs(v), F.lit(1.0)) * TOLERANCE
    held = lambda lo, hi, v: (lo - F.greatest(F.abs(lo), F.abs(hi), F.lit(1.0)) * TOLERANCE <= v) & (v <= hi + F.greatest(F.abs(lo), F.abs(hi), F.lit(1.0)) * TOLERANCE)
    texts = F.lower(F.trim(F.coalesce(F.col(f"{a}.value"), F.lit("")))) == F.lower(F.trim(F.coalesce(F.col(f"{b}.value"), F.lit(""))))
    return F.when(x.isNotNull() & y.isNotNull(), F.when(p.isNull() & q.isNull(), near(x, y)).when(p.isNotNull() & q.isNotNull(), near(x, y) & near(p, q)).when(p.isNotNull(), held(x, p, y)).otherwise(held(y, q, x))).otherwise(texts)


def confidence(best_tier: Column, domains: Column, disagreement: Column, origin: Column | None = None) -> Column:
    """The score of a group: its base by best tier, a bonus per further domain, less if sources disagree; 0.99 at most."""
    base = F.lit(0.40)
    for tier, value in BASE.items():
        base = F.when(best_tier == tier, value).otherwise(base)
    score = base + BONUS * F.greatest(F.lit(0), domains - 1) - F.when(disagreement, PENALTY).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(CEILING), score))
    if origin is not None:
        score = F.when(origin == "default", 0.0).when(origin == "inferred", F.least(score, F.lit(INFERRED))).otherwise(score)
    return F.round(score, 3)


def _same(x: tuple, y: tuple) -> bool:
    (v, n, m), (w, o, p) = x, y
    if n is not None and o is not None:
        if (m is None) != (p is None):
            (lo, hi), at = ((n, m), o) if m is not None else ((o, p), n)
            margin = max(abs(lo), abs(hi), 1.0) * TOLERANCE
            return lo - margin <= at <= hi + margin
        if abs(n - o) > max(abs(n), abs(o), 1.0) * TOLERANCE:
            return False
        return m is None or abs(m - p) <= max(abs(m), abs(p), 1.0) * TOLERANCE
    return v == w


def grouped(candidates: DataFrame, cell: list[str]) -> DataFrame:
    """Distinct values of each cell with the group they belong to: `cell`, value, value_num, value_max, group, …

    Values are taken in order of `tier`, then `seq`, and join the first group whose first member
    agrees, as a reader who goes down the list would. Equal values are folded into one before the
    shuffle, so what a cell holds in memory are its distinct values, not its rows. Adds per
    value: seq, tier, fetched_at (the latest), domains (a set) and n.
    """
    text = F.lower(F.trim(F.coalesce("value", F.lit(""))))
    first = F.struct(F.coalesce("tier", F.lit(3)).alias("tier"), F.col("seq"), F.col("value"))
    distinct = candidates.groupBy(*cell, text.alias("k"), "value_num", "value_max").agg(F.min(first).alias("first"), F.max("fetched_at").alias("fetched_at"), F.collect_set("domain").alias("domains"), F.count("*").alias("n"))
    flat = distinct.select(*cell, "k", "value_num", "value_max", "first.tier", "first.seq", "first.value", "fetched_at", "domains", "n")

    def work(b: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        none = lambda s: [None if x is None or x != x else float(x) for x in s]
        rows = list(zip(b["k"], none(b["value_num"]), none(b["value_max"])))
        group = np.zeros(len(b), dtype=np.int64)
        for i, j in zip(starts, [*starts[1:], len(b)]):
            heads: list[tuple] = []
            for k in range(i, j):
                for g, head in enumerate(heads):
                    if _same(head, rows[k]):
                        group[k] = g
                        break
                else:
                    group[k] = len(heads)
                    heads.append(rows[k])
        return b.assign(group=group).drop(columns=["k"])

    schema = ", ".join([f"`{c}` {candidates.schema[c].dataType.simpleString()}" for c in cell])
    kinds = {c: flat.schema[c].dataType.simpleString() for c in ("tier", "seq", "fetched_at")}
    return map_groups(flat, cell, ["tier", "seq"], work, f"{schema}, value_num double, value_max double, tier {kinds['tier']}, seq {kinds['seq']}, value string, fetched_at {kinds['fetched_at']}, domains array<string>, n bigint, group bigint")


def resolved(candidates: DataFrame, cell: list[str], rule: str = "keep_all_and_flag", trusted: list[str] | None = None, authority: list[str] | dict[str, list[str]] | None = None) -> DataFrame:
    """The groups of each cell and which of them stand: `cell`, group, value, value_num, value_max, domains, confidence, status.

    Rules: majority (most domains, then the best rank), trusted_first (best rank), newest (latest
    fetch) and keep_all_and_flag (all stay, flagged). A domain in `authority`, or one
    below it, decides, for all fields or for those it is listed under, except under keep_all_and_flag. Rank is the place in `trusted`, by domain suffix at a point, or the
    tier beyond them. Losers are superseded at confidence 0; flagged groups are accepted with the
    penalty. A group shows its first value of the lowest tier. Ties go to the earlier group.
    """
    values = grouped(candidates, cell)
    rank = F.col("tier") + len(trusted or [])
    ends = lambda t: lambda d: (F.lower(d) == F.lit(t.lower())) | F.endswith(F.lower(d), F.lit("." + t.lower()))
    for i, t in reversed(list(enumerate(trusted or []))):
        rank = F.when(F.exists("domains", ends(t)), i).otherwise(rank)
    named = F.lit(False)
    for field, sites in (authority.items() if isinstance(authority, dict) else [(None, authority or [])]):
        for site in sites:
            named = named | (F.exists("domains", ends(site)) & (F.lit(True) if field is None else F.col("name") == field))
    head = F.min(F.struct("tier", "seq", "value", "value_num", "value_max")).alias("head")
    groups = values.groupBy(*cell, "group").agg(head, F.array_sort(F.array_distinct(F.flatten(F.collect_list("domains")))).alias("domains"), F.min(rank).alias("rank"), F.max("fetched_at").alias("fetched_at"), F.max(named.cast("int")).alias("named"), F.sum("n").alias("n"))
    size = F.size("domains")
    order = {
        "majority": F.struct(size.alias("a"), (-F.col("rank")).alias("b"), (-F.col("group")).alias("c")),
        "trusted_first": F.struct((-F.col("rank")).alias("a"), (-F.col("group")).alias("b")),
        "newest": F.struct(F.col("fetched_at").alias("a"), (-F.col("group")).alias("b")),
        "keep_all_and_flag": F.struct((-F.col("group")).alias("a")),
    }[rule]
    if authority and rule != "keep_all_and_flag":
        order = F.struct(F.col("named").alias("named"), order.alias("rest"))
    best = groups.groupBy(*cell).agg(F.max_by("group", order).alias("winner"), F.count("*").alias("n_groups"))
    both = groups.join(best, cell)
    keeps = F.lit(True) if rule == "keep_all_and_flag" else F.col("group") == F.col("winner")
    score = confidence(F.col("head.tier"), size, F.col("n_groups") > 1)
    return both.select(*cell, "group", "head.value", "head.value_num", "head.value_max", F.col("head.tier").alias("tier"), F.col("head.seq").alias("seq"), "domains", "n", F.when(keeps, score).otherwise(0.0).alias("confidence"), F.when(keeps, "accepted").otherwise("superseded").alias("status"), ((F.col("n_groups") > 1) & keeps & F.lit(rule == "keep_all_and_flag")).alias("flagged"))


def held_back(values: DataFrame, floor: float) -> DataFrame:
    """Accepted values below the acceptance floor become review cases."""
    return values.withColumn("status", F.when((F.col("status") == "accepted") & (F.coalesce("confidence", F.lit(0.0)) < floor), "review").otherwise(F.col("status")))


def disputed_by_trusted(values: DataFrame, cell: list[str]) -> DataFrame:
    """Cells whose best value is of tier 0 while two domains of tier 1 or more say otherwise: `cell`, value, others, domains.

    `values` are the groups of `resolved`; such a cell deserves a note, not a change.
    """
    head = values.where("tier = 0 and status = 'accepted'").select(*cell, F.col("group").alias("_g"), "value")
    rest = values.where("tier = 1").select(*cell, "group", F.col("value").alias("_v"), "domains")
    both = head.join(rest, cell).where("group <> _g")
    told = both.groupBy(*cell, "value").agg(F.array_sort(F.collect_set("_v")).alias("others"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("domains")))).alias("domains"))
    return told.where(F.size("domains") >= 2)
