"""What a contract says of its surroundings, and the report beside a comparison's summary."""

import json

from accordant import __main__ as command_line
from accordant.operators.contract import check_document


def test_hints_lineage_and_changes(spark, tmp_path):
    folder = tmp_path / "claims"
    folder.mkdir()
    source = folder / "records.jsonl"
    source.write_text("\n".join(json.dumps({"doc_id": k, "kind": "k", "extracted_facts": [{"text": "one", "confidence": 0.9, "page_ref": 1}]}) for k in "abc"))
    hints, registry, lineage, contract = (tmp_path / n for n in ("hints.yaml", "registry.yaml", "lineage.jsonl", "c.yaml"))
    hints.write_text("columns: [kind, fact_confidence]\nmarkers: [doc_id, source_hash, entities]\nterms: [refinery]\nfields: [doc_id]\ndescriptions: {kind: What it is.}\n")
    registry.write_text("subscriptions:\n- {contract_id: claims-records, subscriber_id: s, fields_consumed: [fact_confidence], contact: team}\n")
    other = {"codebase_root": "/elsewhere", "nodes": [{"id": "x", "label": "X"}], "edges": [{"source": "claims", "target": "x"}]}
    own = {"codebase_root": str(folder), "nodes": [{"id": "n1", "label": "Reader"}, {"id": "n2"}], "edges": [{"source": "Refinery.out", "target": "n1", "relationship": "READS"}, {"source": "claims/records", "target": "n2"}, {"source": "claims/records", "target": "n2"}, {"source": "other", "target": "n3"}]}
    lineage.write_text(json.dumps(own) + "\n" + json.dumps(other))
    run = lambda *a: command_line.main([*map(str, a), "--registry", str(registry)], spark)
    assert run("generate", "--source", source, "--output", contract, "--snapshot-root", tmp_path / "v", "--lineage", lineage, "--hints", hints) == 0
    import yaml

    document = yaml.safe_load(contract.read_text())
    assert list(document["schema"])[:2] == ["kind", "fact_confidence"] and document["schema"]["kind"]["description"] == "What it is."
    assert document["observations"]["warnings"] == ["The records lack fields that they should have: entities, source_hash"]
    assert [(c["id"], c["relationship"], c["fields_consumed"]) for c in document["lineage"]["downstream"]] == [("n1", "READS", ["doc_id"]), ("n2", "CONSUMES", ["doc_id"])]
    assert document["lineage"]["downstream"][0]["label"] == "Reader" and document["trust_tier"] == "tier_1_registry_plus_lineage"
    check_document(document)
    summary, report = tmp_path / "e.json", tmp_path / "changes.json"
    assert run("evolve", "--contract-id", "claims-records", "--snapshot-root", tmp_path / "v", "--simulate", "confidence_scale_shift", "--output", summary, "--compatibility-output", report) == 2
    summary, report = json.loads(summary.read_text()), json.loads(report.read_text())
    assert len(report["changes"]) == summary["total_changes"] > 0 and report["decision"] == summary["decision"] == "FAIL"
    assert report["notes"] == summary["notes"] and report["role"] == "producer_side_ci_gate"
    assert run("evolve", "--contract-id", "nothing", "--snapshot-root", tmp_path / "v", "--output", tmp_path / "n.json", "--compatibility-output", tmp_path / "m.json") == 0
    assert json.loads((tmp_path / "m.json").read_text())["changes"] == []
