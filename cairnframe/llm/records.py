"""Duplicate records that differ only in formatting, counted in an incremental ledger.

A record's canonical key drops what does not matter: white space, letter case and punctuation,
and in pages of `label: value` parts also their order and separators. The ledger holds one row
per key with the number of copies and the earliest representative, bucketed by key. Each batch
is aggregated first and full-outer-joined with the ledger bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.functions.text import fold
from cairnframe.session import bucket_count, bucketed, drop, scratch

#: Parts end at `;`, `|`, a line end, or a bullet before the next label; blanks around these don't count.
SEPARATOR = r"\s*(?:[;|\n]|[•·](?=\s{0,9}[^:;|\n•·]{1,40}:\s))[\s•·]*"
#: The beginning of a `label: value` part.
LABEL = r"^[^:;|\n]{1,40}:(?:\s|$)"


def bare(text: Column) -> Column:
    """Letters, marks and digits only, without case."""
    return fold(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}]+", ""))


def canonical_key(title: Column, text: Column) -> Column:
    """16 bytes of digest of a record's canonical form; null where the text is null or holds no letter or digit.

    A text is one of parts if it splits into at least two and each begins with a label; the parts
    are then compared as a sorted list. Splitting is linear in the text, however many parts it has.
    """
    pieces = F.filter(F.split(F.regexp_replace(text, r"^[\s•·]+|\s+$", ""), SEPARATOR), lambda p: p != "")
    sheet = (F.size(pieces) > 1) & F.forall(pieces, lambda p: p.rlike(LABEL))
    parts = F.array_join(F.array_sort(F.filter(F.transform(pieces, bare), lambda p: p != "")), "\u001f")
    # Only a text that begins with a label needs to be split.
    body = F.when(text.rlike(r"^[\s•·]*[^:;|\n]{1,40}:\s") & sheet, F.concat(F.lit("="), parts)).otherwise(bare(text))
    return F.when(text.rlike(r"[\p{L}\p{M}\p{N}]"), F.unhex(F.md5(F.concat_ws("\u001e", F.coalesce(bare(title), F.lit("")), body))))


class Ledger:
    """Copies per canonical key, kept as a bucketed table in the shared folder.

    Every update writes a new version and drops the old one only when the new one stands, so a
    failed update loses nothing and an executor can vanish at any time.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets
        self.name: str | None = None

    def table(self) -> DataFrame | None:
        return self.spark.table(self.name) if self.name else None

    def update(self, batch: DataFrame) -> DataFrame:
        """The ledger after `batch` (`key`, `id`, `at`): `key`, `copies`, `first_at`, `first_id`.

        Rows with a null key are left out. The representative is the row of earliest `at`, a null
        `at` ranking last; ties go to the smallest id. Partial aggregates are taken before the
        shuffle, so a third of the rows may share one key.
        """
        late = F.coalesce(F.col("at"), F.lit("9999-12-31 23:59:59").cast("timestamp"))
        new = batch.where(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("copies"), F.min(F.struct(late.alias("at"), F.col("id"))).alias("first"))
        if self.name:
            old = self.table().select("key", F.col("copies").alias("old_copies"), F.struct(F.col("first_at").alias("at"), F.col("first_id").alias("id")).alias("old_first"))
            new = new.join(old, "key", "full_outer").select("key", (F.coalesce("copies", F.lit(0)) + F.coalesce("old_copies", F.lit(0))).alias("copies"), F.least("first", "old_first").alias("first"))
        rows = new.select("key", "copies", F.col("first.at").alias("first_at"), F.col("first.id").alias("first_id"))
        self.buckets = self.buckets or bucket_count(batch)
        before, self.name = self.name, bucketed(rows, "ledger", self.buckets, "key", sort=True)
        if before:
            drop(self.spark, before)
        return self.table()


def keyed(pages: DataFrame) -> DataFrame:
    """(`key`, `id`, `at`) of each page; the only pass over the texts."""
    return pages.select(canonical_key(F.col("title"), F.col("text")).alias("key"), F.col("page_id").alias("id"), F.col("landed_at").alias("at")).where(F.col("key").isNotNull())


def keep_keys(pages: DataFrame) -> DataFrame:
    """`keyed(pages)` stored once in the shared folder, in the order of the pages: no key is gathered."""
    path = scratch(pages.sparkSession, "keys")
    keyed(pages).write.parquet(path)
    return pages.sparkSession.read.parquet(path)


def record_ledger(keys: DataFrame, batch: Column, batches: list) -> DataFrame:
    """The ledger after the batches have been taken in one after the other."""
    ledger = Ledger(keys.sparkSession, bucket_count(keys))
    for b in batches:
        ledger.update(keys.where(batch == b))
    return ledger.table()


def members(keys: DataFrame, ledger: DataFrame) -> DataFrame:
    """(`key`, `id`, `copies`, `first_id`): each page under its record, a page once per record.

    Keys that hold over a fifty-thousandth of all copies, fewer than 50,000 by that, are joined
    by broadcast and leave the shuffled join, so that no task gathers a hot key.
    """
    bound = (ledger.agg(F.sum("copies")).first()[0] or 0) // 50_000 + 1_000
    rows, facts = keys.select("key", "id").distinct(), ledger.select("key", "copies", "first_id")
    hot = F.broadcast(facts.where(F.col("copies") > bound))
    return rows.join(hot, "key").unionByName(rows.join(hot, "key", "left_anti").join(facts.where(F.col("copies") <= bound), "key"))


def copy_pairs(keys: DataFrame, ledger: DataFrame, block: int = 1024) -> DataFrame:
    """(`page_a`, `page_b`), smaller first, of pages under one key that the ledger counts more than once.

    Only keys with copies are looked at again. Pages of a key of more than `block` copies go into
    blocks of about that size and each block meets each, so that no task forms more than
    about `block`² pairs of one cell whatever a key's share of all pages.
    """
    rows = members(keys, ledger.where("copies > 1"))
    placed = rows.withColumn("of", F.ceil(F.col("copies") / block)).withColumn("mine", F.pmod(F.xxhash64("id"), "of"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("of") - 1)))
    cells = met.select("key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"), "id")
    a, b = cells.where("side < 2").withColumnRenamed("id", "a"), cells.where("side <> 1").select("key", "low", "high", F.col("side").alias("side_b"), F.col("id").alias("b"))
    pairs = a.join(b, ["key", "low", "high"]).where("(side = 0 and side_b = 0 and a < b) or (side = 1 and side_b = 2 and a <> b)")
    return pairs.select(F.least("a", "b").alias("page_a"), F.greatest("a", "b").alias("page_b")).distinct()
