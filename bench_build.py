"""The published baseline's shape: N rows, standardize, resolve, three derived columns, check, export with provenance.

Prints one JSON line with seconds for each N in `BENCH_ROWS` (default 20000,100000,500000).
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import functions as F

from cairnframe.plans import build, export, spec
from cairnframe.session import local_session

SPEC = {
    "project": "shops",
    "entities": {"shop": {"identity": "shop_id", "fields": ["shop_id", "name", {"name": "price", "type": "number"}, {"name": "height", "type": "range", "unit": "m"}, {"name": "opened", "type": "year"}, {"name": "kind", "type": "category"}, {"name": "rating", "type": "number"}]}},
    "derived": {"shop": {"z": "zscore(price over shop)", "place": "rank(price over shop)", "label": "if(rating >= 3, 'good', 'poor')"}},
    "conflict": "majority", "min_confidence": 0.3,
}


def run(spark, n: int) -> float:
    """Seconds from a CSV file of `n` rows to tables and provenance on disk; names are matched as a project's are."""
    folder = tempfile.mkdtemp(prefix="bench-")
    rows = spark.range(n).select(F.concat(F.lit("S-"), "id").alias("shop_id"), F.concat(F.lit("Shop number "), "id").alias("name"), (F.col("id") * 7919 % 100003 / 10).cast("string").alias("price"), F.concat((F.col("id") % 900).cast("string"), F.lit(" ft")).alias("height"), (1900 + F.col("id") % 120).cast("string").alias("opened"), F.concat(F.lit("kind "), F.col("id") % 9).alias("kind"), (F.col("id") % 6).cast("string").alias("rating"))
    rows.write.option("header", True).csv(f"{folder}/in")
    start = time.perf_counter()
    project = spec.from_dict(SPEC)
    read = spark.read.option("header", True).csv(f"{folder}/in")
    fields = [f.name for f in project.primary.fields]
    long = read.select("shop_id", *[F.col(f).alias(f"_{f}") for f in fields]).unpivot(["shop_id"], [f"_{f}" for f in fields], "name", "raw_value").where("raw_value is not null")
    candidates = long.select(F.lit("shop").alias("entity_type"), F.col("shop_id").alias("identity"), F.expr("substring(name, 2)").alias("name"), "raw_value", F.lit(0).alias("tier"), F.lit("shops.csv").alias("domain"), F.lit("2024-01-01").alias("fetched_at"), F.lit("extracted").alias("origin"), F.xxhash64("shop_id").alias("seq"))
    d = build.build(candidates, project)
    export.write_all(d.tables, f"{folder}/out", ["csv"])
    export.write_csv(d.values.select("entity_type", "entity_id", "name", "value", "domains", "confidence", "status"), f"{folder}/provenance.csv")
    took = time.perf_counter() - start
    shutil.rmtree(folder)
    return round(took, 1)


def main() -> None:
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "16g", "bench_build")
    spark.sparkContext.setLogLevel("ERROR")
    took = {str(n): run(spark, n) for n in map(int, os.environ.get("BENCH_ROWS", "20000,100000,500000").split(","))}
    print(json.dumps({"metric": "build_export_seconds", "rows": took, "unit": "sec"}))
    spark.stop()


if __name__ == "__main__":
    main()
