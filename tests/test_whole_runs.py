"""Whole runs from the command line: a baseline after the first validation, drift from it, attribution, metrics, a report and SQL tests."""

import json
import subprocess

from accordant import __main__ as command_line


def _git(folder, *args):
    subprocess.run(["git", "-C", str(folder), "-c", "user.name=Ann", "-c", "user.email=a@example.com", *args], check=True, capture_output=True)


def test_from_generation_to_report(spark, tmp_path):
    repo = tmp_path / "producer"
    (repo / "src").mkdir(parents=True)
    (repo / "src/fact_table.py").write_text("a\nconfidence = 0.9\nscale = 1\n")
    (repo / "src/other.py").write_text("nothing\n")
    _git(repo, "init", "-q")
    _git(repo, "add", "-A")
    _git(repo, "commit", "-qm", "first")
    folder = tmp_path / "week3"
    folder.mkdir()
    for name, scale in (("extractions", 1.0), ("shifted", 100.0)):
        rows = [{"doc_id": f"3f2b8c1e-1d2a-4c3b-9a5e-0123456789{k:02d}", "source_path": f"{repo}/src/x.pdf", "extracted_at": f"2026-01-{k + 1:02d}T00:00:00Z", "extracted_facts": [{"text": f"fact {k}", "confidence": (0.5 + k / 100) * scale}]} for k in range(20)]
        (folder / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    registry = tmp_path / "r.yaml"
    registry.write_text("subscriptions:\n- {contract_id: week3-extractions, subscriber_id: mapper, fields_consumed: [fact_confidence], contact: team}\n")
    lineage = tmp_path / "lineage.jsonl"
    graph = {"codebase_root": str(repo), "nodes": [{"id": "confidence-table"}, {"id": "mapper-job"}], "edges": [{"source": "confidence-table", "target": "mapper-job"}, {"source": "mapper-job", "target": "end"}]}
    lineage.write_text(json.dumps({"codebase_root": "/else", "nodes": [], "edges": []}) + "\n" + json.dumps(graph))
    run = lambda *a: command_line.main(list(map(str, a)), spark)
    at = lambda n: tmp_path / n
    read = lambda n: json.loads(at(n).read_text())
    own = ("--registry", registry)
    assert run("generate", "--source", folder / "extractions.jsonl", "--output", at("c.yaml"), "--snapshot-root", at("versions"), *own) == 0
    validate = lambda data, mode, out: run("validate", "--contract", at("c.yaml"), "--data", folder / f"{data}.jsonl", "--mode", mode, "--baselines", at("base.json"), "--violation-log", at("log"), "--output", at(out), *own)
    assert validate("extractions", "ENFORCE", "first.json") == 0
    assert 0.5 < read("base.json")["columns"]["fact_confidence"]["mean"] < 0.7
    assert validate("shifted", "ENFORCE", "second.json") == 2
    assert {(r["check_type"], r["status"]) for r in read("second.json")["results"] if r["status"] != "PASS"} == {("range", "FAIL"), ("drift", "FAIL")}
    before = at("base.json").read_text()
    assert validate("extractions", "AUDIT", "third.json") == 0 and at("base.json").read_text() == before

    assert run("attribute", "--report", at("second.json"), "--contract", at("c.yaml"), "--lineage", lineage, "--violation-log", at("log"), "--output", at("blame.json"), *own) == 0
    blamed = {a["check_id"].rpartition(".")[2]: a for a in read("blame.json")["attributions"]}
    assert set(blamed) == {"range", "drift"} and blamed["range"]["blame_chain"][0]["file_path"] == "src/fact_table.py" and blamed["range"]["violation_count"] == 1
    assert blamed["range"]["subscriber_count"] == 1
    found = read("blame.json")["lineage"]
    assert found["load_mode"] == "jsonl:matched-root" and found["confidence"] == "high" and found["downstream"] == {"count": 2, "nearest": [{"node_id": "mapper-job", "distance": 1, "relationship": "RELATED"}, {"node_id": "end", "distance": 2, "relationship": "RELATED"}]}

    (tmp_path / "traces.jsonl").write_text("\n".join(json.dumps(r) for r in [
        {"run_type": "prompt", "start_time": "2026-01-01T00:00:00", "end_time": "2026-01-01T00:00:02", "total_tokens": 3, "extra": {"metadata": {}}, "inputs": {"document_id": "d", "page": 1, "section": "s", "text": "more than twenty letters"}},
        {"run_type": "odd", "start_time": "2026-01-01T00:00:00", "end_time": "2026-01-01T00:00:02"},
    ]))
    (tmp_path / "verdicts.jsonl").write_text(json.dumps({"verdict_id": "v", "target_ref": "t", "rubric_id": "r", "rubric_version": "1", "overall_verdict": "PASS", "overall_score": 1, "confidence": 0.5, "evaluated_at": "x", "scores": {"a": {"score": 1, "evidence": "e", "notes": "n"}}}))
    measure = lambda data: run("metrics", "--records", folder / f"{data}.jsonl", "--verdicts", at("verdicts.jsonl"), "--traces", at("traces.jsonl"), "--text-baseline", at("texts"), "--violation-log", at("log"), "--output", at("ai.json"))
    assert measure("extractions") == 0
    made = read("ai.json")["checks"]
    assert made["embedding_drift"]["baseline_action"] == "created" and made["prompt_input_schema_violation_rate"]["status"] == "PASS" and made["llm_output_schema_violation_rate"]["status"] == "PASS" and made["trace_contract_violation_rate"]["status"] == "FAIL"
    assert measure("shifted") == 0 and read("ai.json")["checks"]["embedding_drift"]["baseline_action"] == "used_existing"
    assert spark.read.json(str(at("log"))).where("source_component = 'ai_extensions'").count() == 2

    assert run("evolve", "--contract-id", "week3-extractions", "--snapshot-root", at("versions"), "--output", at("e.json"), *own) == 2
    assert run("report", "--validation", at("first.json"), "--evolution", at("e.json"), "--metrics", at("ai.json"), "--attribution", at("blame.json"), "--snapshot-root", at("versions"), "--output-dir", at("out"), *own) == 0
    assert 0 < read("out/report_data.json")["health_score"] <= 100 and "Health score" in at("out/report.md").read_text()

    assert run("tests", "--contract", at("c.yaml"), "--data", folder / "extractions.jsonl", "--output-dir", at("sql")) == 0
    assert run("tests", "--contract", at("c.yaml"), "--data", folder / "shifted.jsonl", "--output-dir", at("sql")) == 1
    assert {r["column"] for r in read("sql/results.json")["results"] if r["failures"]} == {"fact_confidence"} and list((tmp_path / "sql/models").glob("*.yml"))
