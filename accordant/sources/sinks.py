"""Sinks: reports, logs, contracts, snapshots, baselines, seeds and SQL test projects."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.operators.contract import Contract, model_document
from accordant.sources import files

#: Fields of a log entry, in order, and the result column that each comes from.
LOGGED = {
    "report_id": "report_id", "contract_id": "contract_id", "snapshot_id": "snapshot_id", "run_timestamp": "run_timestamp", "validation_mode": "validation_mode", "field": "column_name", "check_type": "check_type",
    "status": "status", "severity": "severity", "action": "action", "blocking": "blocking", "message": "message", "sample_values": "sample_failing", "records_failing": "records_failing",
    "records_total": "records_total", "failing_percent": "failing_percent", "check_id": "check_id",
}


def now_iso() -> str:
    return datetime.now(UTC).isoformat()


def timestamp_slug() -> str:
    return datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")


def _write(path: str | Path, text: str) -> None:
    files.write_text(path, text)


def write_json(path: str | Path, value: Any) -> None:
    _write(path, json.dumps(value, indent=2, default=str))


def write_yaml(path: str | Path, value: Any) -> None:
    import yaml

    _write(path, yaml.safe_dump(value, sort_keys=False, width=100, allow_unicode=True))


def violation_rows(results: DataFrame, **fixed: str) -> DataFrame:
    """Log entries of the results that aren't passes. fixed: report_id, contract_id, snapshot_id, run_timestamp."""
    known = results.withColumns({k: F.lit(v) for k, v in fixed.items()})
    if "sample_failing" not in known.columns:
        known = known.withColumn("sample_failing", F.array().cast("array<string>"))
    return known.where("status <> 'PASS'").select(*[F.col(c).alias(k) for k, c in LOGGED.items()])


def append_violations(results: DataFrame, path: str, **fixed: str) -> None:
    """Adds the entries of a report to the log, once however often it is called."""
    files.append_run(violation_rows(results, **fixed), path, f"violations-{fixed.get('report_id') or uuid.uuid4()}")


def append_findings(metrics: DataFrame, path: str, run_id: str | None = None) -> None:
    """Adds what AI metrics found to the log, once for a run."""
    from accordant.operators.traces import findings

    run = run_id or str(uuid.uuid4())
    message = F.concat(F.col("metric"), F.lit(" is "), F.col("value").cast("string"), F.lit("."))
    entries = findings(metrics).select("*", F.lit(run).alias("report_id"), F.lit(now_iso()).alias("run_timestamp"), F.col("metric").alias("check_id"), F.col("failing").alias("records_failing"), F.col("checked").alias("records_total"), message.alias("message"), F.lit("ai_extensions").alias("source_component"))
    files.append_run(entries, path, f"findings-{run}")


def write_drift_baseline(kept: dict[str, Any], path: str | Path) -> None:
    """The baseline that text_drift.drift_metric gave back."""
    write_json(path, {"written_at": now_iso()} | kept)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_contract(document: dict[str, Any], path: str | Path, snapshots: str | Path) -> dict[str, str]:
    """Writes the version first, then the contract with the places of its versions."""
    folder = Path(snapshots) / document["id"]
    places = {"timestamped": str(folder / f"{timestamp_slug()}.yaml"), "latest": str(folder / "latest.yaml")}
    for place in places.values():
        write_yaml(place, document)
    write_yaml(path, document | {"snapshot_paths": places})
    return places


def write_baselines(baseline: DataFrame, path: str | Path, existing: dict[str, Any]) -> bool:
    """Writes numeric baselines unless there are some already; of several runs at once the first one writes them."""
    if existing.get("written_at") and existing.get("columns"):
        return False
    columns = {r["column"]: {"mean": r["mean"], "stddev": r["stddev"]} for r in baseline.collect()}  # a row a column
    text = json.dumps({"written_at": now_iso(), "columns": columns}, indent=2)
    if existing.get("written_at") is None and files.exists(path) and not existing.get("columns"):  # broken, or without columns
        files.write_text(path, text)
        return True
    return files.write_once(path, text)


def seed_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in this order; missing ones are null, others go."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def write_seed(df: DataFrame, columns: list[str], path: str) -> None:
    seed_columns(df, columns).write.mode("overwrite").option("header", True).csv(path)


def iso_column(name: str) -> Column:
    return F.replace(F.col(name).cast("string"), F.lit(" "), F.lit("T"))


def model_columns(df: DataFrame, contract: Contract) -> DataFrame:
    """The data as a SQL model gives it: date-times as text with a T."""
    times = {c.name for c in contract.clauses if c.format == "date-time"}
    return df.select(*[iso_column(c).alias(c) if c in times else F.col(c) for c in df.columns])


def write_test_project(contract: Contract, model: str, folder: str | Path) -> None:
    """A model and its tests for a SQL test runner."""
    times = {c.name for c in contract.clauses if c.format == "date-time"}
    columns = ",\n  ".join(f"replace(cast({c.name} as varchar), ' ', 'T') as {c.name}" if c.name in times else c.name for c in contract.clauses)
    _write(Path(folder) / "models" / f"{model}.sql", f"select\n  {columns}\nfrom {{{{ ref('{model}_seed') }}}}\n")
    write_yaml(Path(folder) / "models" / f"{model}.yml", model_document(contract, model))
