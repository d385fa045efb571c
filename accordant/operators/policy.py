"""From statuses to actions: ladders of conditions over result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
BLOCKING = {"AUDIT": (), "WARN": ("CRITICAL",), "ENFORCE": ("CRITICAL", "HIGH")}


def blocking(mode: str, status: Column, severity: Column) -> Column:
    """Whether a result blocks: a failure or an error of a severity that the mode blocks."""
    return ~status.isin("PASS", "WARN") & severity.isin(*BLOCKING[mode.upper()]) if BLOCKING[mode.upper()] else F.lit(False)


def action(mode: str, status: Column, severity: Column) -> Column:
    return F.when(status == "PASS", "ALLOW").when(blocking(mode, status, severity), "BLOCK").when((status == "WARN") | severity.isin("MEDIUM", "HIGH", "CRITICAL"), "WARN").otherwise("LOG")


def decorate(results: DataFrame, mode: str) -> DataFrame:
    """Adds validation_mode, action and blocking."""
    status, severity = F.col("status"), F.col("severity")
    return results.withColumns({"validation_mode": F.lit(mode.upper()), "action": action(mode, status, severity), "blocking": blocking(mode, status, severity)})


def summarize(decorated: DataFrame, mode: str) -> DataFrame:
    """One row: counts of statuses, whether anything blocks, and the decision."""
    count = lambda s: F.count_if(F.col("status") == s)
    counted = decorated.agg(
        F.count("*").alias("total_checks"), count("PASS").alias("passed"), count("FAIL").alias("failed"), count("WARN").alias("warned"), count("ERROR").alias("errored"), F.count_if("blocking").alias("blocked")
    )
    troubled = F.col("warned") + F.col("failed") + F.col("errored") > 0
    decision = F.when(F.lit(mode.upper() == "AUDIT"), "ALLOW_WITH_AUDIT_TRAIL").when(F.col("blocked") > 0, "BLOCK").when(troubled, "ALLOW_WITH_WARNINGS").otherwise("ALLOW")
    return counted.withColumns({"blocking": F.col("blocked") > 0, "decision": decision})


def exit_code(summary: dict) -> int:
    return 2 if summary["blocking"] else 0


def status_from_rate(rate: Column, warn_above: float, fail_above: float) -> Column:
    return F.when(rate > fail_above, "FAIL").when(rate > warn_above, "WARN").otherwise("PASS")


def severity_for_status(status: Column) -> Column:
    return F.when(status == "PASS", "LOW").when(status == "WARN", "MEDIUM").otherwise("HIGH")


#: Order and score of a status, and names of the trust tiers.
RANKS = {"PASS": 0, "WARN": 1, "FAIL": 2}
SCORES = {"PASS": 1.0, "WARN": 0.6, "FAIL": 0.2}
TIERS = ("tier_1_registry_plus_lineage", "tier_2_registry_primary", "tier_3_lineage_only_fallback")


def _looked_up(table: dict[str, int] | dict[str, float], key: Column, otherwise: float) -> Column:
    out = F.lit(otherwise)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def status_rank(status: Column) -> Column:
    return _looked_up(RANKS, status, 0)


def worst_status(status: Column) -> Column:
    """An aggregate."""
    return F.max_by(status, status_rank(status))


def status_score(status: Column) -> Column:
    return _looked_up(SCORES, status, 0.0)


def trust_tier(has_registry: Column, has_lineage: Column) -> Column:
    return F.when(has_registry & has_lineage, TIERS[0]).when(has_registry, TIERS[1]).otherwise(TIERS[2])
