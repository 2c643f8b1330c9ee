"""Checks of a library's tables, rolled up to one status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("OK", "WARNINGS", "ERRORS")


def stale_overrides(overrides: DataFrame, live: DataFrame) -> DataFrame:
    """Overrides (signature, ...) of clusters that the live map no longer has (signature)."""
    return overrides.join(live.select("signature").distinct(), "signature", "left_anti")


def issues(dangling: DataFrame, run_mismatches: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """severity, code and n of everything found: dangling rows (code, n) and wrong runs are errors, stale overrides a warning."""
    found = dangling.where("n > 0").select(F.lit("error").alias("severity"), "code", "n")
    found = found.union(run_mismatches.agg(F.count("*").alias("n")).where("n > 0").select(F.lit("error"), F.lit("map_run_mismatch"), "n"))
    if stale is not None:
        found = found.union(stale.agg(F.count("*").alias("n")).where("n > 0").select(F.lit("warning"), F.lit("stale_override"), "n"))
    return found


def status(found: DataFrame) -> DataFrame:
    """One row: the worst severity as status, and the issues by severity."""
    level = F.coalesce(F.max(F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)), F.lit(0))
    rolled = found.agg(level.alias("level"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return rolled.select(F.element_at(F.array(*map(F.lit, STATUSES)), F.col("level") + 1).alias("status"), "errors", "warnings")


def exit_code(report: DataFrame, strict: bool = False) -> int:
    """1 for errors, and for warnings if strict."""
    worst = report.first()["status"]
    return int(worst == "ERRORS" or (strict and worst == "WARNINGS"))
