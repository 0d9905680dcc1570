"""Statistics over a whole column, joined back to its rows.

All statistics of one table come from a single aggregation whose one row is broadcast; only
`rank` needs an order, which is taken over distinct values with their counts, range-partitioned,
so that no single task sees the whole column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnframe.session import cut


def one_row(df: DataFrame, wanted: list[tuple[str, tuple]], kinds: dict[str, str]) -> DataFrame:
    """The one-row frame of the plain statistics `wanted`: (name, (field, …)); columns are named by `label`.

    Null on an empty column; deviations need two values; the mode's ties go to the first in order.
    Medians, percentiles and modes come from counts per value, so no task holds a column's values.
    """
    columns, seen, apart = [], set(), []
    for name, args in wanted:
        for s in NEEDS.get(name, (name,)):
            key = label(s, args)
            if key in seen:
                continue
            seen.add(key)
            if s in ("median", "percentile", "mode"):
                apart.append((s, args, key))
            else:
                columns.append(_aggregate(s, args, kinds).alias(key))
    out = df.agg(*columns) if columns else df.sparkSession.range(1).select(F.lit(1).alias("_one"))
    for s, args, key in apart:
        share = 0.5 if s == "median" or len(args) < 2 else min(100.0, max(0.0, float(args[1]))) / 100
        one = most_frequent(df, args[0], key) if s == "mode" else quantile(df, args[0], share, key)
        out = out.join(F.broadcast(one), how="left")
    return out if columns else out.drop("_one")


def most_frequent(df: DataFrame, value: str, name: str) -> DataFrame:
    """One row: the commonest text of a column, ties going to the smallest; counts are combined before the shuffle."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("string").alias("v")).agg(F.count("*").alias("n"))
    return counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias(name))


def placed_counts(df: DataFrame, value: str, descending: bool = False, partitions: int | None = None) -> DataFrame:
    """(`v`, `n`, `before`): every distinct number of a column, its count, and how many values come before it in order.

    Values are counted first (combined before the shuffle), then range-partitioned; each
    partition's total is one row, whose running sum gives the offset of the next.
    """
    p = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("v").desc() if descending else F.col("v").asc()
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    placed = cut(counts.where("v is not null").repartitionByRange(p, order).withColumn("part", F.spark_partition_id()))
    whole = placed.groupBy("part").agg(F.sum("n").alias("total"))
    # One row per partition of the plan, not of the data.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("run", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(offsets), "part").select("v", "n", (F.col("run") + F.col("offset")).alias("before"))


def quantile(df: DataFrame, value: str, share: float, name: str) -> DataFrame:
    """One row: the exact quantile of a column, between two values in proportion; null on an empty column."""
    counts = placed_counts(df, value)
    at = counts.sparkSession.range(1).crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select(((F.col("all") - 1) * F.lit(share)).alias("at"))
    met = counts.join(F.broadcast(at), (F.col("before") <= F.ceil("at")) & (F.col("before") + F.col("n") > F.floor("at")))
    low = F.max(F.when(F.col("before") <= F.floor("at"), F.col("v")))
    high = F.max(F.when(F.col("before") + F.col("n") > F.ceil("at"), F.col("v")))
    return met.agg(F.round(low + (high - low) * F.max(F.col("at") - F.floor("at")), 6).alias(name))


#: Statistics that a row's own value is compared with.
NEEDS = {"zscore": ("mean_raw", "stdev_raw", "records"), "normalize": ("smallest", "largest"), "share": ("total",), "rank": ()}


def label(name: str, args: tuple) -> str:
    return "_".join(["stat", name, *[str(a).replace(".", "p").replace("-", "m") for a in args]])


def _aggregate(name: str, args: tuple, kinds: dict[str, str]) -> Column:
    x = F.col(args[0]).cast("double") if kinds.get(args[0]) != "text" or name not in ("count_distinct", "mode", "records") else F.col(args[0])
    n = F.count(x)
    if name == "mean":
        return F.round(F.avg(x), 6)
    if name == "mean_raw":
        return F.avg(x)
    if name == "stdev_raw":
        return F.stddev_pop(x)
    if name == "stdev":
        return F.when(n >= 2, F.round(F.stddev_pop(x), 6))
    if name == "variance":
        return F.when(n >= 2, F.round(F.var_pop(x), 6))
    if name == "total":
        return F.round(F.sum(x), 6)
    if name == "spread":
        return F.round(F.max(x) - F.min(x), 6)
    if name in ("smallest", "largest"):
        return (F.min if name == "smallest" else F.max)(x)
    if name == "records":
        return n
    if name == "count_distinct":
        return F.count_distinct(F.lower(F.trim(F.col(args[0]).cast("string"))))
    if name == "correlation":
        a, b = F.col(args[0]).cast("double"), F.col(args[2] if len(args) > 2 else args[1]).cast("double")
        both = a.isNotNull() & b.isNotNull()
        a, b = F.when(both, a), F.when(both, b)
        n = F.count(a)
        varied = (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
        covariance = F.covar_pop(a, b)
        return F.when((n >= 2) & varied, F.round(F.try_divide(covariance, F.stddev_pop(a) * F.stddev_pop(b)), 4))
    raise ValueError(f"no statistic {name!r}")


def ranks(df: DataFrame, value: str, descending: bool = True, partitions: int | None = None) -> DataFrame:
    """(`value`, rank): competition rank with gaps of every distinct value, 1 for the first in order."""
    return placed_counts(df, value, descending, partitions).select(F.col("v").alias(value), (F.col("before") + 1).cast("bigint").alias("rank"))


def with_statistics(df: DataFrame, wanted: list[tuple[str, tuple]], kinds: dict[str, str]) -> tuple[DataFrame, dict[tuple[str, tuple], Column]]:
    """`df` with what the statistics need joined on, and a Column for each of `wanted`."""
    plain = list(dict.fromkeys((name, args) for name, args in wanted if name != "rank"))
    out, columns = df, {}
    if plain:
        out = out.crossJoin(F.broadcast(one_row(df, plain, kinds)))
    for name, args in wanted:
        if name == "rank":
            key = label("rank", args)
            if key not in out.columns:
                order = "asc" not in [str(a) for a in args[1:]]
                r = ranks(df, args[0], order).select(F.col(args[0]).alias(f"{key}_v"), F.col("rank").alias(key))
                out = out.join(r, F.col(args[0]).cast("double") == F.col(f"{key}_v"), "left").drop(f"{key}_v")
            columns[name, args] = F.col(key)
            continue
        mine = F.col(args[0]).cast("double") if kinds.get(args[0]) != "text" else None
        stat = lambda s, a=args: F.col(label(s, a))
        if name == "zscore":
            columns[name, args] = F.when((stat("records") >= 2) & mine.isNotNull(), F.when(stat("stdev_raw") == 0, 0.0).otherwise(F.round(F.try_divide(mine - stat("mean_raw"), stat("stdev_raw")), 4)))
        elif name == "normalize":
            spread = stat("largest") - stat("smallest")
            columns[name, args] = F.when(mine.isNotNull(), F.when(spread == 0, 0.0).otherwise(F.round(F.try_divide(mine - stat("smallest"), spread), 4)))
        elif name == "share":
            columns[name, args] = F.round(F.try_divide(mine, F.when(stat("total") != 0, stat("total"))), 6)
        else:
            columns[name, args] = stat(name)
    return out, columns
