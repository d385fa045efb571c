"""Whole runs: generate a contract, validate a snapshot, compare versions, attribute failures, measure AI artefacts, report."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from functools import reduce
from types import MappingProxyType
from typing import Any, NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.functions import naming
from accordant.operators import attribution, checks, evolution, flatten, health, lineage, policy, profile, registry, text_drift, traces
from accordant.operators.contract import Contract, sql_tests
from accordant.sources import embeddings, readers, sinks

#: Nodes that an attribution lists on either side.
NEAREST = 20
CONTEXT = {"enforcement_boundary": "consumer", "blast_radius_primary_source": "contract_registry", "lineage_role": "enrichment_only"}


class Hints(NamedTuple):
    """What is known of a data set beforehand: columns that come first, names that its records should have, terms by which a lineage names its
    folder, fields that its consumers read, and descriptions of fields."""

    columns: tuple[str, ...] = ()
    markers: tuple[str, ...] = ()
    terms: tuple[str, ...] = ()
    fields: tuple[str, ...] = ("record_id",)
    descriptions: Mapping[str, str] = MappingProxyType({})

    @classmethod
    def of(cls, document: Mapping[str, Any]) -> Hints:
        lists = {k: tuple(map(str, document[k])) for k in ("columns", "markers", "terms", "fields") if document.get(k)}
        return cls(**lists, descriptions=dict(document.get("descriptions") or {}))


def generate(
    spark: SparkSession, source: str, contract_id: str, registry_path: str | None = None, lineage_nodes: DataFrame | None = None, lineage_path: str | None = None, hints: Hints = Hints()
) -> tuple[Contract, dict[str, Any]]:
    """(contract, document) of a JSON lines file: flattened, profiled, with subscribers named by a registry and consumers by a lineage snapshot.

    lineage_nodes: of the lineage that stands behind the data, if it is at hand; lineage_path: snapshots, of which the one that fits the data's folder is read.
    """
    records = readers.read_records(spark, source)
    flat, meta = flatten.flatten_for_profile(records, list(hints.columns))
    contract = profile.infer_contract(flat, contract_id, descriptions=dict(hints.descriptions))
    observations = meta | {"profiled_row_count": contract.profiled_rows}
    if missing := flatten.missing_markers(records, list(hints.markers)):
        observations["warnings"] = ["The records lack fields that they should have: " + ", ".join(missing)]
    more: dict[str, Any] = {"info": naming.contract_info(source), "servers": {"local": {"path": source}}, "observations": observations}
    found = lineage_nodes is not None and not lineage_nodes.isEmpty()
    if lineage_path:
        more["lineage"] = source_lineage(spark, lineage_path, source, hints)
        found = found or bool(more["lineage"]["downstream"])
    if registry_path:
        document = readers.read_registry(spark, registry_path)
        context = registry.registry_context(registry.subscriptions_frame(spark, document), contract_id, document.get("notes"))
        tier = policy.TIERS[(0 if found else 1) if context["subscriber_count"] else 2]
        more |= {"registry": context, "trust_tier": tier}
    return contract, contract.document(**more)


def source_lineage(spark: SparkSession, path: str, source: str, hints: Hints = Hints()) -> dict[str, Any]:
    """What reads a data set, by the snapshot that fits its folder best; each consumer once, by id."""
    snapshots, how = readers.read_snapshot_rows(spark, path)
    folder = source.replace("\\", "/").lower().rpartition("/")[0]
    nodes, edges, label = lineage.chosen_snapshot(spark, snapshots, [(folder, folder.rpartition("/")[2])], "CONSUMES")
    terms = naming.source_terms(source, {folder.rpartition("/")[2]: list(hints.terms)})
    consumers = lineage.downstream_consumers(nodes, edges, terms, list(hints.fields)).groupBy("id").agg(F.min(F.struct("label", "relationship", "fields_consumed")).alias("c"))
    rows = consumers.select("id", "c.*").orderBy("id").collect()  # the consumers of one data set
    return {"role": "enrichment_only", "snapshot": f"{how}:{label}", "downstream": [r.asDict() for r in rows]}


def validate(
    df: DataFrame, contract: Contract, mode: str = "AUDIT", baselines: dict[str, tuple[float, float]] | None = None, subscriptions: DataFrame | None = None, snapshot_id: str = "", order_by: str | None = None
) -> tuple[dict[str, Any], DataFrame]:
    """(report, decorated results) of one pass over the data and a look at failing values."""
    results = checks.with_samples(df, contract, checks.guarded(df, contract, baselines), order_by)
    decorated = policy.decorate(results, mode)
    summary = policy.summarize(decorated, mode).first().asDict()
    head = {"report_id": str(uuid.uuid4()), "contract_id": contract.id, "snapshot_id": snapshot_id, "run_timestamp": sinks.now_iso(), "validation_mode": mode.upper()}
    rows = [r.asDict() for r in decorated.orderBy("ordinal").drop("ordinal").collect()]  # a row a check
    own = registry.registry_context(subscriptions, contract.id)["subscriptions"] if subscriptions is not None else []
    report = head | summary | {"profiled_row_count": rows[0]["records_total"] if rows else 0, "architecture_context": CONTEXT, "registry_subscribers": own, "results": rows}
    return report, decorated


def evolve(spark: SparkSession, contract_id: str, previous: dict[str, Any] | None, current: dict[str, Any] | None, subscriptions: DataFrame, simulation: str = "none") -> dict[str, Any]:
    """Summary of a comparison; a simulated change stands in for a current version that isn't given. Without both, a warning that doesn't block."""
    return compatibility(spark, contract_id, previous, current, subscriptions, simulation)[1]


def compatibility(
    spark: SparkSession, contract_id: str, previous: dict[str, Any] | None, current: dict[str, Any] | None, subscriptions: DataFrame, simulation: str = "none"
) -> tuple[dict[str, Any], dict[str, Any]]:
    """(report, summary) of a comparison, as ``evolve`` makes it; the report also has each change with the subscribers that it hits."""
    notes = []
    roles = {"role": "producer_side_ci_gate", "registry_role": "primary_impact_source", "lineage_role": "optional_enrichment_only"}  # fixed values
    head = {"generated_at": sinks.now_iso(), "contract_id": contract_id} | roles
    if current is None and previous is not None and simulation != "none":
        current = evolution.simulate(previous, simulation)
        notes.append(f"No current version was given, so a simulated '{simulation}' change was compared.")
    if previous is None or current is None:
        summary = {"contract_id": contract_id, "decision": "WARN", "ci_gate_blocking": False, "total_changes": 0, "notes": [*notes, "Two versions are needed for a comparison."]}
        return head | {k: summary[k] for k in ("decision", "notes")} | {"changes": []}, summary
    changes, summary = evolution.analyze(spark, contract_id, previous, current, subscriptions)
    rows = [r.asDict(recursive=True) for r in changes.collect()]  # a row a changed field
    report = head | {k: summary[k] for k in ("decision", "recommendation", "producer_next_actions")} | {"notes": notes, "changes": sorted(rows, key=lambda r: (str(r.get("field")), str(r.get("change_type"))))}
    return report, summary | {"notes": notes}


def versions(spark: SparkSession, contract_id: str, root: str, previous: str | None = None, current: str | None = None) -> tuple[dict[str, Any] | None, dict[str, Any] | None, list[str]]:
    """(previous, current, notes): documents of the named files; the previous version is by default the last one of different content under root/contract/."""
    notes: list[str] = []
    if previous is None:
        try:
            found = readers.different_snapshots(readers.snapshot_files(spark, f"{root.rstrip('/')}/{contract_id}")).select("path").collect()  # the versions of one contract
        except AnalysisException:  # no such folder
            found = []
        if not found:
            notes.append("There is no earlier version of the contract.")
        elif len(found) == 1:
            notes.append("There is one version of the contract; it counts as the previous one.")
        previous = found[-1][0] if found else None
    return readers.read_yaml(spark, previous) if previous else None, readers.read_yaml(spark, current) if current else None, notes


def fact_count(records: DataFrame, facts: str = "extracted_facts") -> int:
    """Facts of all records; a record without a list has none."""
    return records.agg(F.coalesce(F.sum(F.greatest(F.size(facts), F.lit(0))), F.lit(0))).first()[0] if facts in records.columns else 0


def attribute(results: DataFrame, contract: Contract, subscriptions: DataFrame, files: DataFrame, blame: DataFrame, recent: DataFrame, log: DataFrame, system_id: str) -> DataFrame:
    """A row for each failure with its ranked files, subscribers and earlier violations. The files are read once for all failures."""
    failures = attribution.earlier_violations(attribution.failures_of(results, system_id, None), log)
    tokens = {r.check_id: attribution.search_tokens(r.field, r.message) for r in failures.select("check_id", "field", "message").distinct().collect()}  # a row a check
    candidates = attribution.failure_candidates(files, tokens).select("check_id", "path", "score")
    ranked = attribution.rank_candidates(failures, candidates, attribution.blame_counts(blame), recent)
    chain = ranked.groupBy("check_id").agg(F.array_sort(F.collect_list(F.struct("rank", "file_path", "commit_hash", "confidence_score"))).alias("blame_chain"))
    radius = registry.blast_summary(subscriptions, failures.select(F.lit(contract.id).alias("contract_id"), "field")).drop("contract_id")
    return failures.join(chain, "check_id", "left").join(radius, "field", "left")


def attribute_report(spark: SparkSession, validation: dict[str, Any], document: dict[str, Any], subscriptions: DataFrame, roots: list[str], log: DataFrame, lineage_path: str | None = None, days: int = 14) -> dict[str, Any]:
    """The document of a whole attribution: files are read and scored once for all failures, git is asked about the few best of each, lineage enriches."""
    contract = Contract.of(document)
    known = "check_id string, column_name string, check_type string, status string, severity string, message string, records_failing long"
    names = [c.split()[0] for c in known.split(", ")]
    results = spark.createDataFrame([tuple(r.get(n) for n in names) for r in validation.get("results", [])], known)
    failing = results.where("status = 'FAIL'").select("check_id", F.col("column_name").alias("field"), "message").collect()  # a row a check
    system = contract.id.lower() or "unknown-system"
    files = readers.read_files(spark, roots[0])
    candidates = attribution.failure_candidates(files, {r.check_id: attribution.search_tokens(r.field, r.message) for r in failing}).select("check_id", "path", "score").collect() if failing else []  # five a failure
    fields = {r.check_id: r.field for r in failing}
    wanted: dict[str, set[str]] = {}
    for c in candidates:
        wanted.setdefault(c.path, set()).update(attribution.line_patterns(fields[c.check_id]))
    few = files.where(F.col("path").isin(*wanted)) if wanted else files.limit(0)
    ranges = {}
    for patterns in {tuple(sorted(p)) for p in wanted.values()}:
        own = [p for p, w in wanted.items() if tuple(sorted(w)) == patterns]
        for r in attribution.line_ranges(few.where(F.col("path").isin(*own)), list(patterns)).orderBy("path", "place").collect():  # three a file
            ranges.setdefault(r.path, []).append((r["first"], r["last"]))
    blame = attribution.parse_blame(_all([readers.git_lines(spark, roots[0], p, r) for p, r in ranges.items()], spark, "file_path string, ord long, line string"))
    recent = _all([readers.git_recent(spark, roots[0], p, days) for p in wanted], spark, "file_path string, commit_hash string, author string, email string, commit_ts string, summary string")
    done = attribute(results, contract, subscriptions, files, blame, recent, log, system).collect()  # a row a failure
    lineage_part = lineage_enrichment(spark, lineage_path, roots, fields.values(), system, subscriptions, contract.id) if lineage_path else {"confidence": "low", "notes": ["No lineage was given."]}
    return {"generated_at": sinks.now_iso(), "architecture_context": CONTEXT, "contract_id": contract.id, "repo_roots": roots, "violation_log_entry_count": log.count(), "lineage": lineage_part, "attributions": [r.asDict(recursive=True) for r in done]}


def lineage_enrichment(spark: SparkSession, path: str, roots: list[str], fields: Iterable[str], system: str, subscriptions: DataFrame, contract_id: str) -> dict[str, Any]:
    """What stands before and after the failing fields in the snapshot that fits the roots best: counts by distance, the nearest nodes, and how far to trust them."""
    snapshots, how = readers.read_snapshot_rows(spark, path)
    nodes, edges, label = lineage.chosen_snapshot(spark, snapshots, [(r.lower(), r.rstrip("/").rpartition("/")[2].lower()) for r in roots])
    tokens = sorted({t for f in fields for t in lineage.field_tokens(f)})
    seeds = lineage.score_seeds(nodes, tokens, lineage.context_tokens(system)).select("node_id")
    out: dict[str, Any] = {"load_mode": f"{how}:{label}", "seeds": sorted(r.node_id for r in seeds.collect())}
    for direction in ("downstream", "upstream"):
        reached = lineage.walk(edges, seeds, direction)
        nearest = reached.orderBy("distance", "node_id").limit(NEAREST).collect()
        out[direction] = {"count": reached.count(), "nearest": [r.asDict() for r in nearest]}
    own = registry.contract_subscriptions(subscriptions, spark.createDataFrame([(contract_id,)], "contract_id string"))
    text = F.lower(F.concat_ws(" ", "node_id", "label"))
    aligned = own.select(F.lower("subscriber_id").alias("subscriber")).join(nodes.select(text.alias("text")), F.col("text").contains(F.col("subscriber"))).select("subscriber").distinct().count()  # the subscribers of one contract
    out["confidence"] = spark.range(1).select(lineage.enrichment_confidence(F.lit(out["downstream"]["count"]), F.lit(aligned))).first()[0]
    return out


def _all(frames: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return reduce(DataFrame.union, frames, spark.createDataFrame([], schema))


def run_sql_tests(df: DataFrame, contract: Contract) -> list[dict[str, Any]]:
    """(column, test, arguments, failures) of every SQL test of the contract."""
    return [
        {"column": c.name, "test": test, "arguments": arguments, "failures": checks.sql_test_failures(df, c.name, test, **arguments).count()}
        for c in contract.clauses if c.name in df.columns for test, arguments in sql_tests(c, contract.profiled_rows)
    ]


def snapshot_totals(spark: SparkSession, root: str) -> dict[str, int]:
    """Versions of each contract; none if there is no such folder."""
    try:
        return {r.contract_id: r.n for r in readers.snapshot_counts(readers.snapshot_files(spark, root)).collect()}  # a row a contract
    except AnalysisException:
        return {}


def ai_metrics(
    spark: SparkSession, texts: DataFrame, trace_rows: DataFrame, verdicts: DataFrame, baseline: dict | None, store: str | None = None, refresh: bool = False, provider: embeddings.Provider | None = None, cache: str | None = None
) -> dict[str, Any]:
    """Drift, shapes of prompts and verdicts, and traces, with the worst status; prompts are judged by their rows as given."""
    canonical = traces.canonicalize(trace_rows)
    drift, kept = text_drift.drift_metric(spark, texts, texts.columns[0], baseline, refresh, store, provider, cache)
    found = {m["metric"]: m for df in (traces.prompt_metric(trace_rows), traces.verdict_metric(verdicts), traces.trace_metric(canonical)) for m in [df.first().asDict()]}
    found["embedding_drift"] = drift
    return {"checks": found, "status": max((m["status"] for m in found.values()), key=policy.RANKS.__getitem__), "baseline": kept}


def report(spark: SparkSession, validation: dict[str, Any], ai: dict[str, Any], subscriber_count: int, lineage_confidence: str, evolution_summary: dict[str, Any], snapshots: dict[str, int]) -> tuple[dict[str, Any], str]:
    """(report data, Markdown)."""
    ai_checks = ai.get("checks", {})
    ai_score = sum(policy.SCORES.get(m.get("status", "FAIL"), 0.0) for m in ai_checks.values()) / max(len(ai_checks), 1)
    row = (validation.get("passed", 0), validation.get("total_checks", 1), ai_score, subscriber_count, lineage_confidence, evolution_summary.get("decision", "FAIL"), min(snapshots.values(), default=0))
    state = spark.createDataFrame([row], "passed long, total_checks long, ai_score double, subscriber_count long, lineage_confidence string, evolution_decision string, least_snapshots long")
    data = health.health_scores(state).first().asDict() | {"contract_id": validation.get("contract_id"), "actions": list(dict.fromkeys(evolution_summary.get("producer_next_actions", [])))[:3]}
    data |= {"failures": [f"{r['check_id']}: {r['message']}" for r in validation.get("results", []) if r["status"] == "FAIL"], "ai_metrics": {k: m["status"] for k, m in ai_checks.items()}}
    return data, health.render_markdown(data)
