"""Registered queries of the general data problems (units, wide tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.functions.text import instant
from cairnframe.operators.pivot import filled_cells, wide_table
from cairnframe.operators.units import unit_histories
from cairnframe.session import table

#: The measured fields of the candidates: lengths, masses, times, temperatures, areas.
MEASURED = ("area", "elevation", "mean_temperature", "altitude_m", "height", "lifespan", "min_temperature", "seed_mass", "spine_height", "weight", "loan_period")


def p2_read(spark: SparkSession, root: str) -> DataFrame:
    """Every measured reading of the candidates, brought to its base unit along the history of its subject and field."""
    rows = table(spark, root, "candidates").where(F.col("field").isin(*MEASURED)).withColumn("at", instant(F.col("fetched_at")))
    return unit_histories(rows, table(spark, root, "ref_units"), ["subject_id", "field"])


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """The readings that state a unit; what a row states stands, whatever its history says."""
    return p2_read(spark, root).where("stated").select("candidate_id", "base_unit", "lo_micro", "hi_micro")


def p2_histories(spark: SparkSession, root: str) -> DataFrame:
    return p2_read(spark, root).select("subject_id", "field", "candidate_id", "base_unit", "value", "unit_shift")


def field_specs(spark: SparkSession, root: str) -> list[tuple[str, str, bool]]:
    """The declared fields, a project file's worth of rows."""
    return [tuple(r) for r in table(spark, root, "field_specs").select("name", "ftype", "multiple").distinct().orderBy("name").collect()]


def p3_wide(spark: SparkSession, root: str) -> DataFrame:
    return wide_table(table(spark, root, "page_fields"), field_specs(spark, root), block=10)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    specs = field_specs(spark, root)
    return filled_cells(p3_wide(spark, root), specs)


QUERIES = {"p2_found": p2_found, "p2_histories": p2_histories, "p3_found": p3_found, "p3_wide": p3_wide}
ORACLES: dict[str, str] = {}
