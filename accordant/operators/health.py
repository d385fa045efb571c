"""One score for the state of a contract, and the report around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS = ("baseline_validation", "ai_contract_extensions", "attribution_and_blast_radius", "schema_evolution_gate", "governance_and_snapshots")


def health_scores(state: DataFrame) -> DataFrame:
    """Adds the five parts and health_score (0 to 100) to rows of passed, total_checks, ai_score (mean of status scores),
    subscriber_count, lineage_confidence, evolution_decision, least_snapshots."""
    parts: dict[str, Column] = {
        "baseline_validation": F.col("passed") / F.greatest(F.col("total_checks").cast("double"), F.lit(1.0)) * 35,
        "ai_contract_extensions": F.col("ai_score") * 20,
        "attribution_and_blast_radius": F.lit(15.0) - F.when(F.col("subscriber_count") == 0, 7.0).otherwise(0.0) - F.when(F.col("lineage_confidence") == "low", 4.0).otherwise(0.0),
        "schema_evolution_gate": F.when(F.col("evolution_decision") == "PASS", 12.0).when(F.col("evolution_decision") == "WARN", 9.0).otherwise(15.0),
        "governance_and_snapshots": F.lit(15.0) - F.when(F.col("least_snapshots") < 2, 5.0).otherwise(0.0),
    }
    scored = state.withColumns({k: F.bround(v, 2) for k, v in parts.items()})
    total = sum((F.col(k) for k in COMPONENTS[1:]), F.col(COMPONENTS[0]))
    return scored.withColumn("health_score", F.greatest(F.lit(0), F.least(F.lit(100), F.bround(total, 0).cast("int"))))


def logged_findings(log: DataFrame) -> DataFrame:
    """One row: how many entries of the AI checks a log(ord, source_component, message) has, and the last one's message."""
    own = log.where("source_component = 'ai_extensions'")
    return own.agg(F.count("*").alias("findings"), F.max_by("message", "ord").alias("latest"))


def keep_first(df: DataFrame, key: str, order_by: str) -> DataFrame:
    """The first row of each key."""
    first = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), order_by).alias("_r"))
    return first.select("_r.*")


def recommendations(rows: DataFrame, limit: int = 3) -> DataFrame:
    """Different recommendations(ord, text), the first of each, in order."""
    return keep_first(rows, "text", "ord").orderBy("ord").limit(limit)


def render_markdown(report: dict) -> str:
    """The report as Markdown."""
    lines = ["# Data contract report", "", f"Contract: `{report.get('contract_id', '')}`", "", f"**Health score: {report.get('health_score', 0)} / 100**", "", "| Component | Score |", "| --- | --- |"]
    lines += [f"| {k.replace('_', ' ')} | {report.get(k, 0)} |" for k in COMPONENTS]
    for title, key in (("Decisions", "decisions"), ("Failing checks", "failures"), ("Subscribers hit", "subscribers"), ("Schema changes", "changes"), ("AI metrics", "ai_metrics"), ("Recommended actions", "actions")):
        if entries := report.get(key):
            lines += ["", f"## {title}", ""]
            lines += [f"- {k}: {v}" for k, v in entries.items()] if isinstance(entries, dict) else [f"{i}. {e}" if key == "actions" else f"- {e}" for i, e in enumerate(entries, 1)]
    return "\n".join(lines) + "\n"
