"""The engine on small hand-made records."""

import json
import math

import pytest
from pyspark.sql import functions as F

from accordant.functions import values as V
from accordant.operators import attribution, checks, contract, dashboard, evolution, flatten, health, lineage, policy, profile, registry, text_drift, traces
from accordant.operators.contract import Clause, Contract
from accordant.plans import workflows
from accordant.sources import readers, sinks

RECORDS = [
    {"doc_id": "3f2b8c1e-1d2a-4c3b-9a5e-0123456789ab", "tags": ["a", "b"], "token_count": {"input": 3}, "extracted_at": "2026-01-01T00:00:00+00:00", "extracted_facts": [{"text": "one", "confidence": 0.9, "page_ref": 1}, {"text": "two", "confidence": 0.5}]},
    {"doc_id": "3f2b8c1e-1d2a-4c3b-9a5e-0123456789ac", "tags": [], "token_count": {"input": 4}, "extracted_at": "2026-01-02T00:00:00Z", "extracted_facts": []},
    {"doc_id": "3f2b8c1e-1d2a-4c3b-9a5e-0123456789ad", "token_count": {"input": 5}, "extracted_at": "2026-01-03"},
]


@pytest.fixture(scope="module")
def records_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("records") / "extractions.jsonl"
    path.write_text("﻿" + "\n\n".join(json.dumps(r) for r in RECORDS) + "\n", encoding="utf-8")
    return str(path)


def test_flatten(spark, records_file):
    flat, meta = flatten.flatten_for_profile(readers.read_records(spark, records_file))
    assert meta == {"flatten_mode": "exploded_repeated_items", "repeated_field": "extracted_facts"}
    rows = {(r.doc_id[-1], r.fact_text): r for r in flat.collect()}
    assert len(rows) == 4
    assert rows["b", "one"].tags == "a|b" and rows["b", "one"].tags_count == 2 and rows["b", "one"].token_count_input == 3
    assert rows["c", None].tags is None and rows["c", None].tags_count == 0
    assert rows["d", None].tags_count is None and rows["d", None].fact_confidence is None


def test_generate_and_validate(spark, records_file):
    found, document = workflows.generate(spark, records_file, "facts")
    clauses = {c.name: c for c in found.clauses}
    assert clauses["doc_id"].format == "uuid" and clauses["doc_id"].required
    assert clauses["extracted_at"].format == "date-time"
    assert (clauses["fact_confidence"].minimum, clauses["fact_confidence"].maximum, clauses["fact_confidence"].required) == (0.0, 1.0, False)
    assert clauses["fact_page_ref"].type == "number"  # whole numbers with gaps
    contract.check_document(document)
    flat, _ = flatten.flatten_for_profile(readers.read_records(spark, records_file))
    base = {r["column"]: (r["mean"], r["stddev"]) for r in checks.numeric_baseline(flat).collect()}
    clean, _ = workflows.validate(flat, found, "ENFORCE", base)
    assert clean["decision"] == "ALLOW" and clean["failed"] == 0
    broken = flat.withColumn("fact_confidence", F.col("fact_confidence") * 100)
    for mode, decision, blocked in (("AUDIT", "ALLOW_WITH_AUDIT_TRAIL", 0), ("WARN", "BLOCK", 1), ("ENFORCE", "BLOCK", 2)):
        report, results = workflows.validate(broken, found, mode, base)
        assert (report["decision"], report["blocked"], report["failed"]) == (decision, blocked, 2)
    failing = {r["check_type"]: r for r in report["results"] if r["status"] == "FAIL"}
    assert failing["range"]["severity"] == "CRITICAL" and sorted(failing["range"]["sample_failing"]) == ["50.0", "90.0"]
    assert failing["drift"]["severity"] == "HIGH" and failing["range"]["failing_percent"] == 50.0
    assert sinks.violation_rows(results, report_id="r", contract_id="c", snapshot_id="s", run_timestamp="t").count() == 2


def test_drift_ladder(spark):
    df = spark.createDataFrame([(81.80147,)], "x double")
    row = checks.run_checks(df, Contract("c", (Clause("x"),)), {"x": (0.818015, 0.087702)}).first()
    assert row.status == "FAIL" and "923.4 stddev" in row.message


def test_values(spark):
    cases = {"2026-04-02": True, "2026-04-02T10:00:00Z": True, "20260402": True, "2026-W14-1": True, "2026": False, "2026-04": False, "12:00": False, "2026-02-30": False, "2026-01-01T25:00": False, "x": False}
    got = {r[0]: r[1] for r in spark.createDataFrame([(c,) for c in cases], "t string").select("t", V.is_iso_datetime(F.col("t"))).collect()}
    assert got == cases
    numbers = {"1": 1.0, " 1.5 ": 1.5, "1e3": 1000.0, "1d": None, "1_000": None, "x": None, "": None}
    df = spark.createDataFrame([(n,) for n in numbers], "t string")
    assert {r[0]: r[1] for r in df.select("t", V.number(F.col("t"), df.schema["t"].dataType)).collect()} == numbers
    row = spark.range(1).select(
        V.normalized_field(F.lit(" Extracted_Facts[].Confidence ")).alias("a"), V.field_aliases(F.lit("fact_confidence")).alias("b"), V.contact_summary(F.lit("O"), F.lit(""), F.lit(None).cast("string")).alias("c"),
        V.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("d"), V.humanized(F.lit("a-b_c")).alias("e"), V.formatted_percent(F.lit(12.34)).alias("f"), V.service_base_url(F.lit("http://x/v1/")).alias("g"),
    ).first()
    assert row.a == "extracted_facts_confidence" and row.b == ["fact_confidence", "extracted_facts_confidence"] and row.c == "O"
    assert (row.d, row.e, row.f, row.g) == (1.0, "A B C", "12.3%", "http://x")


def test_nan_counts_as_null(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,)], "x double")
    rows = {r.check_type: r for r in checks.run_checks(df, Contract("c", (Clause("x", "number", True, minimum=0.0, maximum=2.0),))).collect()}
    assert rows["required"].records_failing == 1 and rows["range"].status == "PASS"


def test_guard_keeps_structural_results(spark):
    df = spark.createDataFrame([("a",)], "x string")
    broken = df.withColumn("y", F.expr("cast(raise_error('no') as double)"))
    kinds = {r.check_type for r in checks.guarded(broken.select("x", "y"), Contract("c", (Clause("x", "string", True), Clause("y", minimum=0.0)))).collect()}
    assert kinds == {"required", "type", "execution"}


def test_renames_and_gate(spark):
    old = {"id": "c", "schema": {"fact_confidence": {"type": "number", "required": True, "minimum": 0.0, "maximum": 1.0, "description": "Confidence value for the extracted fact."}, "fact_page_ref": {"type": "number", "description": "page"}}}
    subs = registry.subscriptions_frame(spark, {"subscriptions": [{"contract_id": "C", "subscriber_id": "s", "fields_consumed": ["extracted_facts[].confidence"]}]})
    renamed = workflows.evolve(spark, "c", old, None, subs, "rename_confidence_field")
    assert renamed["decision"] == "FAIL" and renamed["ci_gate_blocking"] and renamed["total_changes"] == 1
    shifted = workflows.evolve(spark, "c", old, None, subs, "confidence_scale_shift")
    assert shifted["decision"] == "FAIL" and shifted["impacted_systems"] == ["s"]
    assert workflows.evolve(spark, "c", old, None, subs)["decision"] == "WARN"
    assert workflows.evolve(spark, "c", old, old, subs)["decision"] == "PASS"


def test_registry_fallback(spark):
    subs = registry.subscriptions_frame(spark, {"subscriptions": [{"contract_id": "c", "subscriber_id": "s", "fields_consumed": ["x"], "breaking_fields": ["y"], "contact": "me"}]})
    fields = spark.createDataFrame([("c", "y"), ("c", "z"), ("d", "x")], "contract_id string, field string")
    got = {(r.contract_id, r.field): (r.subscriber_count, r.confidence) for r in registry.blast_summary(subs, fields).collect()}
    assert got == {("c", "y"): (1, "high"), ("c", "z"): (1, "medium"), ("d", "x"): (0, "low")}


def test_walk_follows_a_chain_of_over_100_steps(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "R") for i in range(104)], lineage.EDGES).coalesce(1)
    seeds = spark.createDataFrame([("n0",)], "node_id string")
    assert {r.node_id: r.distance for r in lineage.walk(edges, seeds).collect()} == {f"n{i}": i for i in range(1, 105)}


def test_walk_has_least_distance_and_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "R"), ("a", "c", None), ("b", "d", "R"), ("c", "d", "R"), ("d", "a", "R"), ("d", "e", "R"), (None, "x", "R")], lineage.EDGES)
    seeds = spark.createDataFrame([("a",)], "node_id string")
    assert {r.node_id: r.distance for r in lineage.walk(edges, seeds).collect()} == {"b": 1, "c": 1, "d": 2, "e": 3}
    assert {r.node_id: r.distance for r in lineage.walk(edges, seeds, "upstream").collect()} == {"d": 1, "b": 2, "c": 2}
    assert lineage.walk(edges, seeds.limit(0)).count() == 0


def test_snapshots_both_shapes(spark, tmp_path):
    canonical = {"codebase_root": "/r", "nodes": [{"id": "n1", "name": "N"}], "edges": [{"source": "n1", "target": "n2"}]}
    nodes, edges = lineage.normalize_snapshot(spark, canonical)
    assert nodes.first().label == "N" and edges.first().relationship == "RELATED"
    nodes, _ = lineage.normalize_snapshot(spark, {"datasets": {"d": {"name": "D"}}, "transformations": {"t": {}}, "edges": []})
    assert sorted(r.node_type for r in nodes.collect()) == ["dataset", "transformation"]
    for text, label in ((json.dumps(canonical), "jsonl"), (json.dumps(canonical, indent=1), "whole-file-json"), (json.dumps([canonical], indent=1), "json-array")):
        (tmp_path / "l.json").write_text(text)
        assert readers.read_snapshots(spark, str(tmp_path / "l.json"))[1] == label


def test_traces(spark):
    rows = [("prompt", {"a": "1"}, "2026-01-01T00:00:00", "2026-01-01T00:00:01", 1, 1, 2), ("odd", None, "x", "y", None, None, None)]
    df = spark.createDataFrame(rows, "run_type string, metadata map<string,string>, start_time string, end_time string, prompt_tokens long, completion_tokens long, total_tokens long")
    got = {r.metadata["original_run_type"]: r for r in traces.canonicalize(df).collect()}
    assert got["prompt"].run_type == "chain" and got["prompt"].metadata["span_role"] == "prompt_assembly" and got["odd"].run_type == "odd"
    row = traces.trace_metric(traces.canonicalize(df)).first()
    assert (row.failing, row.duration_failures, row.token_failures, row.status) == (1, 1, 0, "FAIL")
    assert traces.trace_metric(df.limit(0)).first().status == "PASS"


def test_text_drift_baseline(spark):
    texts = spark.createDataFrame([(1, "red green"), (2, "red"), (3, "")], "k long, text string")
    first, kept = text_drift.drift_metric(spark, texts, "k", None)
    again, _ = text_drift.drift_metric(spark, texts, "k", kept)
    other, _ = text_drift.drift_metric(spark, spark.createDataFrame([(1, "blue")], texts.schema), "k", kept)
    assert (first["baseline_action"], again["baseline_action"], again["value"]) == ("created", "used_existing", 0.0)
    assert other["status"] == "FAIL" and other["top_shifted_tokens"][0]["token"] == "red"


def test_blame_and_ranking(spark):
    porcelain = ["a" * 40 + " 1 1 1", "author Ann", "author-mail <a@example.com>", "author-time 1", "summary s", "\tx", "a" * 40 + " 2 2", "\ty", "b" * 40 + " 3 3 1", "author Bo", "\tz"]
    lines = spark.createDataFrame([("src/models/schemas.py", i, x) for i, x in enumerate(porcelain)], "file_path string, ord long, line string")
    counts = {r.commit_hash[0]: r for r in attribution.blame_counts(attribution.parse_blame(lines)).collect()}
    assert counts["a"].line_hits == 2 and counts["a"].author == "Ann" and counts["b"].author == "Bo"
    files = spark.createDataFrame([("src/models/schemas.py", "x\nconfidence\n1\n2\n3\n4\n5\nconfidence="), ("tests/a.py", "confidence"), ("README.md", "confidence"), ("b.py", "a\nb")], "path string, content string")
    top = attribution.candidate_files(files, attribution.search_tokens("fact_confidence", "the confidence drifted")).collect()
    assert [(r.path, r.score, r.token_hits) for r in top] == [("src/models/schemas.py", 0.51, 1)]
    ranges = {(r.path, r.place): (r.first, r.last) for r in attribution.line_ranges(files, attribution.line_patterns("fact_confidence")).collect()}
    assert ranges["src/models/schemas.py", 1] == (1, 3) and ranges["src/models/schemas.py", 2] == (7, 8) and ranges["b.py", 1] == (1, 2)


def test_health_and_report(spark):
    data, text = workflows.report(spark, {"passed": 38, "total_checks": 38, "contract_id": "c"}, {"checks": {"a": {"status": "PASS"}}}, 2, "high", {"decision": "FAIL"}, {"c": 2})
    assert data["health_score"] == 100 and "100 / 100" in text
    low, _ = workflows.report(spark, {"passed": 0, "total_checks": 10}, {"checks": {}}, 0, "low", {"decision": "WARN"}, {})
    assert low["health_score"] == 23


def test_policy_ladders(spark):
    df = spark.createDataFrame([("PASS", "LOW"), ("WARN", "MEDIUM"), ("FAIL", "HIGH"), ("ERROR", "CRITICAL")], "status string, severity string")
    got = {m: [r.action for r in policy.decorate(df, m).collect()] for m in ("AUDIT", "WARN", "ENFORCE")}
    assert got == {"AUDIT": ["ALLOW", "WARN", "WARN", "WARN"], "WARN": ["ALLOW", "WARN", "WARN", "BLOCK"], "ENFORCE": ["ALLOW", "WARN", "BLOCK", "BLOCK"]}


def test_readers_and_sinks(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_records(spark, str(tmp_path / "none.jsonl"))
    assert readers.read_registry(spark, str(tmp_path / "none.yaml"))["subscriptions"] == []
    sinks.write_yaml(tmp_path / "r.yaml", [{"contract_id": "c"}])
    assert readers.read_registry(spark, str(tmp_path / "r.yaml"))["subscriptions"] == [{"contract_id": "c"}]
    assert readers.read_baselines(spark, str(tmp_path / "none.json")) == {"written_at": None, "columns": {}}
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    base = tmp_path / "b.json"
    assert sinks.write_baselines(checks.numeric_baseline(df), base, readers.read_baselines(spark, str(base)))
    assert not sinks.write_baselines(checks.numeric_baseline(df), base, readers.read_baselines(spark, str(base)))
    assert readers.read_violation_log(spark, str(tmp_path / "nolog")).count() == 0
    assert sinks.seed_columns(df, ["y", "x"]).columns == ["y", "x"]
    places = sinks.write_contract({"id": "c", "schema": {}}, tmp_path / "c.yaml", tmp_path / "snaps")
    files = readers.snapshot_files(spark, str(tmp_path / "snaps"))
    assert readers.snapshot_counts(files).first().n == 1 and readers.different_snapshots(files).count() == 1
    assert dashboard.snapshot_inventory(files).first().versions == 2 and places["latest"].endswith("latest.yaml")


def test_profile_samples_and_enum(spark):
    df = spark.createDataFrame([(i, f"v{i % 9}", i % 2 == 0) for i in range(20)], "i long, many string, flag boolean")
    facts = {r["column"]: r for r in profile.value_facts(profile.column_values(df, "i")).collect()}
    assert facts["many"].sample_values == ["v0", "v1", "v2", "v3", "v4"] and facts["many"].enum_values is None
    assert facts["flag"].enum_values == ["False", "True"]
    assert health.recommendations(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "ord long, text string")).count() == 2


def test_stream_of_checks(spark, tmp_path):
    from accordant.streaming.micro_batches import check_stream

    spark.createDataFrame([("a", 2.0)], "k string, x double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, x double").parquet(str(tmp_path / "in"))
    query = check_stream(stream, Contract("c", (Clause("x", maximum=1.0),)), str(tmp_path / "out"), str(tmp_path / "cp"), "ENFORCE")
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first().action == "BLOCK"
