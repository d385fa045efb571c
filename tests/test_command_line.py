"""The command line, names, providers and the versions of a contract."""

import json

import pytest
from pyspark.sql import functions as F

from accordant import __main__ as command_line
from accordant.functions import naming
from accordant.operators import attribution, evolution, lineage, registry, text_drift
from accordant.operators.contract import Clause
from accordant.plans import workflows
from accordant.sources import embeddings, sinks


def _records(scale=1.0):
    return [{"doc_id": f"3f2b8c1e-1d2a-4c3b-9a5e-0123456789a{k}", "extracted_facts": [{"text": "one", "confidence": 0.9 * scale, "page_ref": 1}]} for k in "bcd"]


def test_gates_by_exit_code(spark, tmp_path):
    folder = tmp_path / "week3"
    folder.mkdir()
    for name, scale in (("extractions", 1.0), ("shifted", 100.0)):
        (folder / f"{name}.jsonl").write_text("\n".join(json.dumps(r) for r in _records(scale)))
    registry_file = tmp_path / "subscriptions.yaml"
    registry_file.write_text("subscriptions:\n- {contract_id: week3-extractions, subscriber_id: s, fields_consumed: [fact_confidence], contact: team}\n")
    run = lambda *a: command_line.main([*map(str, a), "--registry", str(registry_file)], spark)
    contract, versions = tmp_path / "c.yaml", tmp_path / "versions"
    assert run("generate", "--source", folder / "extractions.jsonl", "--output", contract, "--snapshot-root", versions) == 0
    for data, mode, code in (("extractions", "ENFORCE", 0), ("shifted", "AUDIT", 0), ("shifted", "ENFORCE", 2)):
        more = ("--baselines", tmp_path / "none.json", "--violation-log", tmp_path / "log", "--output", tmp_path / "r.json")
        assert run("validate", "--contract", contract, "--data", folder / f"{data}.jsonl", "--mode", mode, *more) == code
    assert spark.read.json(str(tmp_path / "log")).count() > 0
    for simulation, code in (("none", 0), ("rename_confidence_field", 2), ("confidence_scale_shift", 2)):
        assert run("evolve", "--contract-id", "week3-extractions", "--snapshot-root", versions, "--simulate", simulation, "--output", tmp_path / "e.json") == code
    assert json.loads((tmp_path / "e.json").read_text())["impacted_systems"] == ["s"]
    assert workflows.versions(spark, "nothing", str(versions))[0] is None


def test_names():
    source = "outputs/week3/extractions.jsonl"
    assert (naming.contract_slug(source), naming.contract_slug(source, " x "), naming.file_name(source), naming.file_name(source, "_dbt.yml")) == ("week3-extractions", "x", "week3_extractions.yaml", "week3_extractions_dbt.yml")
    assert (naming.model_name("a/b-c/d.jsonl"), naming.contract_title("outputs/my_data/all_events.jsonl")) == ("b_c_d", "My Data All Events Contract")
    assert naming.source_terms(source, {"week3": ["extraction"]}) == ["extraction", "extractions", "week3"]
    assert naming.ordered_columns(["z", "a", "b"], ["b", "q", "z"]) == ["b", "z", "a"]


def test_provider(spark):
    df = spark.createDataFrame([(i, "x" * i if i else None) for i in range(10)], "id long, text string")
    calls = lambda texts: [[float(len(t)), float(len(texts))] for t in texts]
    got = {r.id: r.vector for r in embeddings.embed(df.coalesce(1), "id", calls, batch=4).collect()}
    assert {k: v[0] for k, v in got.items()} == {i: float(i) for i in range(1, 10)} and max(v[1] for v in got.values()) == 4
    with pytest.raises(Exception, match="vectors for"):
        embeddings.embed(df, "id", lambda texts: []).collect()


def test_vectors_of_rows_that_share_a_key(spark):
    rows = [(1, "Alpha beta beta"), (1, "gamma"), (None, "alpha"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "key long, text string")
    assert sorted((r.key or 0, r.weight) for r in text_drift.hashed_vectors(df, "key").collect())[0][1] == 1.0
    want = [0.0] * 128
    import collections
    import hashlib

    for _, text in rows:
        counts = collections.Counter(hashlib.sha256(t.encode()).digest()[-1] % 128 for t in (text or "").lower().split())
        for bucket, n in counts.items():
            want[bucket] += n / sum(m * m for m in counts.values()) ** 0.5 / len(rows)
    got = {r.bucket: r.weight for r in text_drift.text_centroid(df, "key").collect()}
    assert all(abs(got[i] - want[i]) < 1e-12 for i in range(128))
    assert {r.weight for r in text_drift.text_centroid(df.limit(0), "key").collect()} == {0.0}


def test_values_of_changes(spark):
    old = [Clause("a", "integer", True), Clause("c", "number", minimum=0.0, maximum=1.0), Clause("e", "string", enum=("x",))]
    new = [Clause("a", "integer", False), Clause("b", "string"), Clause("c", "number", minimum=-1.0, maximum=2.0), Clause("e", "string", enum=("x", "y"))]
    changes = evolution.compare_clauses(evolution.clauses_frame(spark, "k", old), evolution.clauses_frame(spark, "k", new))
    assert {r.classification for r in changes.collect()} == {"backward-compatible"}
    subscriptions = registry.subscriptions_frame(spark, {"subscriptions": [{"contract_id": "K", "subscriber_id": "s", "fields_consumed": ["a"], "contact": "team"}]})
    impact = {r.field: r for r in registry.change_impact(subscriptions, changes).collect()}
    assert [(c.subscriber_id, c.match_type, c.contact.owner) for c in impact["a"].affected_consumers] == [("s", "field_match", "team")]
    assert impact["b"].affected_consumers[0].match_type == "contract_fallback"
    found = evolution.renames([Clause("fact_confidence", "number", True, minimum=0.0, maximum=1.0, description="Confidence value for the extracted fact.")], [Clause("other", "string")])
    assert found == []


def test_snapshots_keep_edges_and_types(spark):
    nodes, edges = lineage.normalize_snapshot(spark, {"nodes": [], "edges": [{"source": "a", "target": "b"}]})
    assert nodes.count() == 0 and edges.count() == 1
    nodes, _ = lineage.normalize_snapshot(spark, {"nodes": [{"id": "n", "type": "T", "node_type": "N"}], "edges": []})
    assert nodes.first().node_type == "T"
    nodes, _ = lineage.normalize_snapshot(spark, {"datasets": {"d": {"dataset_type": "seed", "source_file": "p"}}, "transformations": {"t": {"name": "x"}}, "edges": []})
    assert {r.node_id: (r.node_type, r.label, r.metadata) for r in nodes.collect()} == {"d": ("seed", "d", {"path": "p"}), "t": ("transformation", "t", {})}
    assert lineage.normalize_snapshot(spark, {"datasets": {"d": {}}})[0].count() == 0


def test_preferred_files_and_line_ranges(spark):
    files = spark.createDataFrame([("src/models/schemas.py", "nothing"), ("src/other.py", "nothing"), ("src/a.py", "token token2")], "path string, content string")
    assert [r.path for r in attribution.candidate_files(files, ["token"]).collect()] == ["src/models/schemas.py"]
    assert attribution.candidate_files(files, ["token"], preferred=()).count() == 0
    lines = "\n".join("hit" if k in (1, 2, 6, 12, 20, 30, 31) else "-" for k in range(1, 41))
    texts = spark.createDataFrame([("a", lines), ("b", "-\n" * 30), ("c", None), ("d", "-")], "path string, content string")
    got = sorted((r.path, r.place, r["first"], r["last"]) for r in attribution.line_ranges(texts, ["hit"]).collect())
    assert got == [("a", 1, 1, 3), ("a", 2, 5, 7), ("a", 3, 11, 13), ("b", 1, 1, 20), ("d", 1, 1, 1)]


def test_fact_count_and_log(spark, tmp_path):
    df = spark.createDataFrame([([1, 2],), (None,), ([],)], "extracted_facts array<int>")
    assert workflows.fact_count(df) == 2 and workflows.fact_count(df.select(F.lit(1).alias("x"))) == 0
    sinks.write_drift_baseline({"centroid": [1.0]}, tmp_path / "b.json")
    assert json.loads((tmp_path / "b.json").read_text())["centroid"] == [1.0]


def test_each_kind_of_change(spark):
    old = [Clause("a", "integer", True), Clause("b", "string", False, enum=("x", "y")), Clause("fact_confidence", "number", True, minimum=0.0, maximum=1.0), Clause("d", "string"), Clause("x", "number", True, minimum=0.0, maximum=0.1)]
    new = [Clause("a", "string", True), Clause("b", "string", True, enum=("x", "y", "z")), Clause("fact_confidence", "number", True, minimum=0.0, maximum=100.0), Clause("e", "string", True), Clause("x", "number", True, minimum=0.0, maximum=0.05)]
    changes = evolution.compare_clauses(evolution.clauses_frame(spark, "c", old), evolution.clauses_frame(spark, "c", new))
    assert {(r.field, r.change_type, r.classification) for r in changes.collect()} == {
        ("a", "type_changed", "breaking"), ("b", "enum_changed", "backward-compatible"), ("b", "nullability_changed", "breaking"), ("fact_confidence", "range_changed", "breaking"), ("d", "field_removed", "breaking"),
        ("e", "field_added", "backward-compatible"), ("x", "range_changed", "breaking"),
    }
