"""One surviving record out of each group of duplicates.

`survivors` chooses field by field by a fixed order of trust. `fused_values` chooses by
Bayesian fusion: source accuracies and the dependence between sources are estimated from the
data, copied votes are discounted, and the value of maximum posterior stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnframe.functions.text import fold, instant, is_missing, squeeze
from cairnframe.session import bucket_count, bucketed, cut, sweep


def survivors(rows: DataFrame, group: list[str], row_id: str = "candidate_id", value: str = "raw_value", tier: str = "tier", confidence: str = "confidence", at: str = "fetched_at", least: int = 2) -> DataFrame:
    """The surviving row of each group with at least `least` rows: `group` columns and `row_id`.

    Rows whose value is missing never survive, though they count as rows. Among the rest the
    lowest tier comes first, then the highest confidence, the latest instant (UTC where no zone is
    given) and the smallest id; null, and NaN confidence, rank last in each. Groups in which every
    value is missing have no survivor; null group columns are a group of their own. One
    aggregation: partial maxima are taken before the shuffle, so a group may hold any share of
    the rows.
    """
    c = F.col(confidence)
    order = F.struct((-F.col(tier)).alias("tier"), F.when(~F.isnan(c), c).alias("confidence"), instant(F.col(at)).alias("at"), (-F.col(row_id)).alias("id"), F.col(row_id).alias("row"))
    best = rows.groupBy(*group).agg(F.count("*").alias("n"), F.max(F.when(~is_missing(F.col(value)), order)).alias("best"))
    return best.where((F.col("n") >= least) & F.col("best").isNotNull()).select(*group, F.col("best.row").alias(row_id))


#: So many sources, or pairs of sources, are broadcast at most; beyond that their joins are shuffled.
FEW = 100_000

#: Sources of one value are paired in blocks of about so many, block against block.
BLOCK = 256


def _small(df: DataFrame) -> DataFrame:
    df = cut(df)
    return F.broadcast(df) if df.count() <= FEW else df


def fused_values(rows: DataFrame, item: list[str], source: str, value: str, at: str, rounds: int = 5, false_values: int = 20, prior: float = 0.8, copy: float = 0.8) -> DataFrame:
    """The value of maximum posterior of each item, with its probability.

    An item is the `item` columns; every source gives each of its values for an item once, at its
    earliest instant. In each round a value's score is the sum over its sources of
    ln(n·A/(1−A)), A being the source's accuracy and n = `false_values`; every vote is weighted by
    the chance that it was not copied from a source that gave the value earlier.

    Dependence is estimated from shared false values: two sources that share many of them hardly
    found them apart. Every value tells of every pair of its sources, however many they are and
    however weak the dependence, so a value of n sources costs n·(n−1)/2 pairs. A pair's dependence
    is the share of what both give that is false, shrunk for few meetings, times `copy`; a vote is
    discounted by its most likely model.

    Null and missing values cast no vote; null sources vote together as one source. Ties go to
    the smallest value. Returns `item`, value, probability, n_sources. Empty in, empty out.

    Rounds carry 64-bit digests of items, values and sources only, aggregated by (item, value)
    before they meet, so a hot item or source is spread; texts are joined back once at the end.
    """
    v = F.col(value)
    named = rows.where(~is_missing(v)).select(F.xxhash64(*item).alias("_i"), F.xxhash64(*item, fold(squeeze(v))).alias("_x"), F.xxhash64(F.coalesce(F.col(source), F.lit(""))).alias("_s"), F.col(at).alias("_t"), squeeze(v).alias("_value"), *item)
    spark, n_buckets = rows.sparkSession, bucket_count(rows)
    # A value's digest holds its item's, so it alone is the key; votes stored by it are never shuffled again.
    claims = named.groupBy(F.col("_i").alias("i"), F.col("_x").alias("x"), F.col("_s").alias("s")).agg(F.min("_t").alias("t"))
    given = spark.table(bucketed(claims, "fusion_claims", n_buckets, "x"))
    # Each source of a value beside each earlier one; cells of two blocks spread a value of many sources.
    shared = given.join(given.groupBy("x").agg(F.count("*").alias("n")).where("n > 1"), "x").withColumn("k", F.ceil(F.col("n") / BLOCK))
    own, each = F.pmod(F.col("s"), F.col("k")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))
    later = shared.select("x", "s", "t", own.alias("b"), each.alias("c")).repartition(n_buckets, "x", "b", "c")
    earlier = shared.select("x", F.col("s").alias("from"), F.col("t").alias("u"), own.alias("c"), each.alias("b")).repartition(n_buckets, "x", "b", "c")
    met = cut(later.join(earlier.hint("merge"), ["x", "b", "c"]).where(F.struct(F.col("u").alias("t"), F.col("from").alias("s")) < F.struct("t", "s")).select("x", "s", "from"))
    accuracy, copied = None, None
    votes = None
    for k in range(rounds):
        voters = given.select("i", "x", "s")
        told = F.lit(prior) if accuracy is None else F.coalesce("a", F.lit(prior))
        voters = voters if accuracy is None else voters.join(accuracy, "s", "left")
        strength = F.log(F.lit(false_values) * told / (1 - told))
        scores = voters.groupBy("x").agg(F.first("i").alias("i"), F.sum(strength).alias("score"), F.count("*").alias("n"))
        if copied is not None:
            # What copied votes are too much: by the likeliest model of each later vote; shuffled into the claims' buckets, or Spark would shuffle the claims.
            weighed = met.join(copied, ["s", "from"]).groupBy("x", "s").agg(F.max("c").alias("c")).join(accuracy, "s", "left")
            less = weighed.repartition(n_buckets, "x").groupBy("x").agg(F.sum(F.col("c") * strength).alias("less"))
            scores = scores.join(less, "x", "left").select("x", "i", (F.col("score") - F.coalesce("less", F.lit(0.0))).alias("score"), "n")
        top = scores.groupBy("i").agg(F.max("score").alias("top"), F.count("*").alias("values"))
        lifted = scores.join(top, "i").select("i", "x", "n", "top", "values", F.exp(F.col("score") - F.col("top")).alias("e"))
        # What is left of `false_values` that nobody claims shares the remaining probability.
        total = lifted.groupBy("i").agg((F.sum("e") + F.greatest(F.lit(0), F.lit(false_values + 1) - F.first("values")) * F.exp(-F.first("top"))).alias("total"))
        votes = cut(lifted.select("i", "x", "n", "e").join(total, "i").select("i", "x", "n", (F.col("e") / F.col("total")).alias("p")))
        if k + 1 < rounds:
            told_ = votes.select("x", "p").repartition(n_buckets, "x")
            accuracy = _small(given.select("x", "s").join(told_, "x").groupBy("s").agg(F.least(F.lit(0.99), F.greatest(F.lit(0.05), (F.sum("p") + 2 * prior) / (F.count("*") + 2))).alias("a")))
            copied = _small(met.join(votes.where("n > 1").select("x", "p"), "x").groupBy("s", "from").agg((copy * F.sum(1 - F.col("p")) / (F.count("*") + 2)).alias("c")))
        sweep(spark)
    texts = named.groupBy("_i", "_x", *item).agg(F.min("_value").alias("_value"))
    told = texts.join(votes.select(F.col("i").alias("_i"), F.col("x").alias("_x"), F.col("p").alias("_p"), F.col("n").alias("_n")), ["_i", "_x"])
    best = told.groupBy(*item).agg(F.max(F.struct("_p", "_n")).alias("_m"), F.min_by("_value", F.struct(-F.col("_p"), F.col("_value"))).alias("_best"))
    return best.select(*item, F.col("_best").alias("value"), F.round("_m._p", 6).alias("probability"), F.col("_m._n").alias("n_sources"))


def name_key(identity: Column) -> Column:
    """An identity without case, marks and punctuation, for grouping what several domains call by one name."""
    return F.trim(F.regexp_replace(fold(squeeze(identity)), r"[^\p{L}\p{M}\p{Nd}]+", " "))
