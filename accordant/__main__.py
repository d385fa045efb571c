"""Command line for pipelines: ``python -m accordant generate | validate | evolve | attribute | metrics | report | tests``. The exit code is 2 if a gate blocks, 1 if SQL tests fail, else 0."""

from __future__ import annotations

import argparse
import json
import os
import uuid

from accordant.operators import checks, policy, registry
from accordant.operators.contract import Contract
from accordant.plans import workflows
from accordant.session import get_session
from accordant.sources import files, readers, sinks


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="accordant", description="Data contracts: generate them, validate data against them, compare their versions.")
    commands = out.add_subparsers(dest="command", required=True)
    generate = commands.add_parser("generate", help="infer a contract from JSON lines")
    validate = commands.add_parser("validate", help="validate JSON lines against a contract")
    evolve = commands.add_parser("evolve", help="compare the versions of a contract")
    generate.add_argument("--source", required=True)
    generate.add_argument("--contract-id", default=None)
    generate.add_argument("--output", required=True)
    generate.add_argument("--snapshot-root", default="schema_snapshots/contracts")
    generate.add_argument("--lineage", default=None, help="lineage snapshots that name consumers of the data")
    generate.add_argument("--hints", default=None, help="YAML: columns, markers, terms, fields, descriptions")
    validate.add_argument("--contract", required=True)
    validate.add_argument("--data", required=True)
    validate.add_argument("--output", required=True)
    validate.add_argument("--mode", default="AUDIT", choices=["AUDIT", "WARN", "ENFORCE"])
    validate.add_argument("--baselines", default="schema_snapshots/baselines.json")
    validate.add_argument("--violation-log", default="violation_log/violations.jsonl")
    evolve.add_argument("--contract-id", required=True)
    evolve.add_argument("--snapshot-root", default="schema_snapshots/contracts")
    evolve.add_argument("--previous", default=None)
    evolve.add_argument("--current", default=None)
    evolve.add_argument("--simulate", default="rename_confidence_field", choices=["none", "rename_confidence_field", "confidence_scale_shift"])
    evolve.add_argument("--output", required=True)
    evolve.add_argument("--compatibility-output", default=None, help="a report with every change beside the summary")
    attribute = commands.add_parser("attribute", help="say which files, commits and consumers stand behind the failures of a report")
    attribute.add_argument("--report", required=True)
    attribute.add_argument("--contract", required=True)
    attribute.add_argument("--lineage", default=None)
    attribute.add_argument("--repository", default=None, help="by default the git root of the files that the contract's data names")
    attribute.add_argument("--days", type=int, default=14)
    attribute.add_argument("--violation-log", default="violation_log/violations.jsonl")
    attribute.add_argument("--output", required=True)
    metrics = commands.add_parser("metrics", help="measure texts, prompts, verdicts and traces")
    metrics.add_argument("--records", required=True, help="JSON lines with facts, whose texts are compared with a baseline")
    metrics.add_argument("--verdicts", required=True)
    metrics.add_argument("--traces", required=True)
    metrics.add_argument("--time-column", default="extracted_at")
    metrics.add_argument("--text-baseline", default="schema_snapshots/text_baseline")
    metrics.add_argument("--refresh-text-baseline", action="store_true")
    metrics.add_argument("--provider", action="store_true", help="take vectors from a service that the environment or the traces name")
    metrics.add_argument("--cache", default=None)
    metrics.add_argument("--violation-log", default="violation_log/violations.jsonl")
    metrics.add_argument("--output", required=True)
    report = commands.add_parser("report", help="one score and a report in Markdown")
    report.add_argument("--validation", required=True)
    report.add_argument("--evolution", required=True)
    report.add_argument("--metrics", required=True)
    report.add_argument("--attribution", default=None)
    report.add_argument("--snapshot-root", default="schema_snapshots/contracts")
    report.add_argument("--output-dir", required=True)
    tests = commands.add_parser("tests", help="write a contract's SQL tests with their data, and run them")
    tests.add_argument("--contract", required=True)
    tests.add_argument("--data", required=True)
    tests.add_argument("--output-dir", required=True)
    for command in (generate, validate, evolve, attribute, report):
        command.add_argument("--registry", default="contract_registry/subscriptions.yaml")
    return out


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    spark = spark or get_session()
    return {"generate": _generate, "validate": _validate, "evolve": _evolve, "attribute": _attribute, "metrics": _metrics, "report": _report, "tests": _tests}[args.command](args, spark)


def _generate(args, spark) -> int:
    from accordant.functions.naming import contract_slug

    hints = workflows.Hints.of(readers.read_yaml(spark, args.hints)) if args.hints else workflows.Hints()
    _, document = workflows.generate(spark, args.source, contract_slug(args.source, args.contract_id), args.registry, lineage_path=args.lineage, hints=hints)
    sinks.write_contract(document, args.output, args.snapshot_root)
    return 0


def _validate(args, spark) -> int:
    from accordant.operators.flatten import flatten_for_profile

    contract = Contract.of(readers.read_yaml(spark, args.contract))
    flat, _ = flatten_for_profile(readers.read_records(spark, args.data))
    stored = readers.read_baselines(spark, args.baselines)
    baselines = {k: (v["mean"], v["stddev"]) for k, v in stored["columns"].items()}
    subscriptions = registry.subscriptions_frame(spark, readers.read_registry(spark, args.registry))
    report, decorated = workflows.validate(flat, contract, args.mode, baselines, subscriptions)
    sinks.write_json(args.output, report)
    sinks.append_violations(decorated, args.violation_log, **{k: report[k] for k in ("report_id", "contract_id", "snapshot_id", "run_timestamp")})
    if not baselines:  # the first validation says what later ones drift from
        sinks.write_baselines(checks.numeric_baseline(flat), args.baselines, stored)
    print(json.dumps({k: report[k] for k in ("contract_id", "validation_mode", "decision", "passed", "failed")}, indent=2))
    return policy.exit_code(report)


def _evolve(args, spark) -> int:
    subscriptions = registry.subscriptions_frame(spark, readers.read_registry(spark, args.registry))
    previous, current, notes = workflows.versions(spark, args.contract_id, args.snapshot_root, args.previous, args.current)
    details, summary = workflows.compatibility(spark, args.contract_id, previous, current, subscriptions, args.simulate)
    summary["notes"] = details["notes"] = notes + summary["notes"]
    sinks.write_json(args.output, summary)
    if args.compatibility_output:
        sinks.write_json(args.compatibility_output, details)
    print(json.dumps({k: summary.get(k) for k in ("contract_id", "decision", "ci_gate_blocking", "total_changes")}, indent=2))
    return 2 if summary["ci_gate_blocking"] else 0


def _attribute(args, spark) -> int:
    document = readers.read_yaml(spark, args.contract)
    roots = [args.repository] if args.repository else list(map(str, readers.contract_roots(spark, document, os.getcwd())))
    if not roots:
        raise SystemExit("No git repository is named, and none follows from the contract's data.")
    subscriptions = registry.subscriptions_frame(spark, readers.read_registry(spark, args.registry))
    out = workflows.attribute_report(spark, readers.read_json(spark, args.report), document, subscriptions, roots, readers.read_violation_log(spark, args.violation_log), args.lineage, args.days)
    if not out["attributions"]:
        raise SystemExit("The report has no failures.")
    sinks.write_json(args.output, out)
    chains = [a["blame_chain"] for a in out["attributions"] if a["blame_chain"]]
    print(json.dumps({"attributed_failures": len(out["attributions"]), "top_file": chains[0][0]["file_path"] if chains else None}, indent=2))
    return 0


def _metrics(args, spark) -> int:
    from accordant.operators import text_drift
    from accordant.sources import embeddings

    facts = text_drift.fact_texts(readers.read_records(spark, args.records), args.time_column).select("ord", "text")
    trace_rows, verdicts = readers.read_traces(spark, args.traces), readers.read_verdicts(spark, args.verdicts)
    provider, why = embeddings.discover(trace_rows) if args.provider else (None, "No provider was asked for.")
    out = workflows.ai_metrics(spark, facts, trace_rows, verdicts, None, store=args.text_baseline, refresh=args.refresh_text_baseline, provider=provider, cache=args.cache)
    out |= {"run_id": str(uuid.uuid4()), "run_timestamp": sinks.now_iso(), "provider": why or provider.base_url}
    sinks.write_json(args.output, {k: v for k, v in out.items() if k != "baseline"})
    from accordant.operators import traces

    sinks.append_findings(traces.trace_metric(traces.canonicalize(trace_rows)), args.violation_log, out["run_id"])
    print(json.dumps({"status": out["status"]} | {k: m["status"] for k, m in out["checks"].items()}, indent=2))
    return 0


def _report(args, spark) -> int:
    validation, ai, evolution = (readers.read_json(spark, p, missing={}) for p in (args.validation, args.metrics, args.evolution))
    attribution = readers.read_json(spark, args.attribution, missing={}) if args.attribution else {}
    own = registry.registry_context(registry.subscriptions_frame(spark, readers.read_registry(spark, args.registry)), str(validation.get("contract_id", "")))
    confidence = attribution.get("lineage", {}).get("confidence", "low")
    data, text = workflows.report(spark, validation, ai, own["subscriber_count"], confidence, evolution, workflows.snapshot_totals(spark, args.snapshot_root))
    folder = args.output_dir.rstrip("/")
    sinks.write_json(f"{folder}/report_data.json", data)
    files.write_text(f"{folder}/report.md", text)
    print(json.dumps({"health_score": data["health_score"]}, indent=2))
    return 0


def _tests(args, spark) -> int:
    from accordant.functions.naming import model_name
    from accordant.operators.flatten import flatten_for_profile

    contract = Contract.of(readers.read_yaml(spark, args.contract))
    flat, _ = flatten_for_profile(readers.read_records(spark, args.data))
    name, folder = model_name(args.data), args.output_dir.rstrip("/")
    seed = sinks.seed_columns(flat, [c.name for c in contract.clauses])
    sinks.write_test_project(contract, name, folder)
    sinks.write_seed(flat, seed.columns, f"{folder}/seeds/{name}_seed")
    results = workflows.run_sql_tests(sinks.model_columns(seed, contract), contract)
    sinks.write_json(f"{folder}/results.json", {"model": name, "run_timestamp": sinks.now_iso(), "results": results})
    failed = sum(r["failures"] > 0 for r in results)
    print(json.dumps({"tests": len(results), "failed": failed}, indent=2))
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
