"""Files that are written whole, logs of runs, token baselines in versions, providers that fail, and lineage snapshots as tables."""

import collections
import json

import pytest
from pyspark.sql import functions as F

from accordant.operators import checks, lineage, text_drift
from accordant.operators.contract import Clause, Contract
from accordant.operators.policy import decorate
from accordant.sources import embeddings, files, readers, sinks, token_baseline


def test_files_are_written_whole_and_once(spark, tmp_path):
    place = f"file://{tmp_path}/a/b.json"
    files.write_text(place, "one")
    files.write_text(place, "two é")
    assert (tmp_path / "a/b.json").read_text() == "two é" and not files.write_once(place, "three")
    assert (tmp_path / "a/b.json").read_text() == "two é" and files.write_once(tmp_path / "a/c.json", "x")
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["b.json", "c.json"]


def test_a_repeated_run_adds_nothing_to_the_log(spark, tmp_path):
    df = spark.createDataFrame([("a", 3.0)], "k string, x double")
    results = decorate(checks.run_checks(df, Contract("c", (Clause("x", maximum=1.0),))), "WARN")
    fixed = {"report_id": "r1", "contract_id": "c", "snapshot_id": "s", "run_timestamp": "t"}
    log = str(tmp_path / "log")
    for report in ("r1", "r1", "r2", "r1"):
        sinks.append_violations(results, log, **fixed | {"report_id": report})
    metric = spark.createDataFrame([("trace_contract_violation_rate", 10, 5, 0.5, "FAIL", "HIGH")], "metric string, checked long, failing long, value double, status string, severity string")
    sinks.append_findings(metric, log, "m1")
    sinks.append_findings(metric, log, "m1")
    got = collections.Counter((r.report_id, r.source_component) for r in readers.read_violation_log(spark, log).collect())
    assert got == {("r1", None): 1, ("r2", None): 1, ("m1", "ai_extensions"): 1}
    base = checks.numeric_baseline(df)
    assert sinks.write_baselines(base, f"{tmp_path}/base.json", {"columns": {}}) and not sinks.write_baselines(base, f"{tmp_path}/base.json", readers.read_baselines(spark, f"{tmp_path}/base.json"))
    assert readers.read_baselines(spark, f"{tmp_path}/base.json")["columns"]["x"]["mean"] == 3.0


def test_token_baselines_are_versions(spark, tmp_path):
    store = str(tmp_path / "store")
    texts = lambda *t: spark.createDataFrame(list(enumerate(t)), "k long, text string")
    first, kept = text_drift.drift_metric(spark, texts("red green", "red"), "k", None, store=store)
    assert first["baseline_action"] == "created" and first["fallback_reason"] and "token_counts" not in kept
    again, _ = text_drift.drift_metric(spark, texts("red red blue"), "k", None, store=store)
    assert again["baseline_action"] == "used_existing" and {t["token"]: t["shift"] for t in again["top_shifted_tokens"]} == {"green": 1, "blue": 1}
    merged = token_baseline.merge(spark, store, text_drift.token_counts(texts("blue", "red")), [2.0] * 128, 2)
    assert merged["text_count"] == 4 and {r.token: r.n for r in token_baseline.counts_of(spark, token_baseline.load(spark, store)).collect()} == {"red": 3, "green": 1, "blue": 1}
    assert kept["version"] != merged["version"] and token_baseline.counts_of(spark, kept).count() == 2  # the earlier version can still be read
    fresh, _ = text_drift.drift_metric(spark, texts("x"), "k", None, refresh=True, store=store)
    assert fresh["baseline_action"] == "refreshed" and token_baseline.load(spark, store)["text_count"] == 1
    old = {"centroid": kept["centroid"], "token_counts": {"red": 2}}
    assert text_drift.drift_metric(spark, texts("red red"), "k", old)[0]["top_shifted_tokens"] == []


def _flaky(folder):
    """A provider that fails at every third call of a worker and notes the texts of the others."""

    calls = [0]

    def provider(texts):
        import uuid

        calls[0] += 1
        if calls[0] % 3 == 0:
            raise OSError("gone")
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return [[float(len(t)), 1.0] for t in texts]

    return provider


def test_a_provider_that_fails_now_and_then_is_asked_again(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    asked = lambda: collections.Counter(t for p in (tmp_path / "calls").iterdir() for t in p.read_text().split("\n"))
    df = spark.createDataFrame([(i, "x" * (i % 40)) for i in range(200)] + [(200, None)], "k long, text string").repartition(3)
    cache = str(tmp_path / "cache")
    found = embeddings.centroid(df, _flaky(str(tmp_path / "calls")), cache, batch=4, wait=0.01)
    lengths = [i % 40 for i in range(200) if i % 40]
    assert found.problem is None and found.vector == pytest.approx([sum(lengths) / len(lengths), 1.0])
    assert asked() == {"x" * i: 1 for i in range(1, 40)}  # each text once
    more = df.union(spark.createDataFrame([(7, "other words")], df.schema))
    embeddings.centroid(more, _flaky(str(tmp_path / "calls")), cache, batch=4, wait=0.01)
    assert asked() == {"x" * i: 1 for i in range(1, 40)} | {"other words": 1}  # the cache knows the rest


def test_hashed_vectors_stand_in_for_a_provider_that_fails(spark, tmp_path):
    def broken(texts):
        raise OSError("no service")

    texts = spark.createDataFrame([(1, "red green"), (2, "red")], "k long, text string")
    metric, kept = text_drift.drift_metric(spark, texts, "k", None, provider=broken)
    assert metric["metric_source"] == "hashed_tokens" and "no service" in metric["fallback_reason"] and len(kept["centroid"]) == 128
    good, kept = text_drift.drift_metric(spark, texts, "k", None, provider=lambda t: [[1.0, float(len(x))] for x in t])
    assert good["metric_source"] == "provider" and kept["centroid"] == [1.0, 6.0]
    assert text_drift.drift_metric(spark, texts, "k", kept)[0]["baseline_action"] == "recreated_due_to_shape_mismatch"


def test_discovery_says_why_there_is_no_provider(spark):
    assert embeddings.discover(None, {})[0] is None
    found, _ = embeddings.discover(None, {"OLLAMA_BASE_URL": "http://h:1/v1/", "OLLAMA_EMBED_MODEL": "m"})
    assert (found.base_url, found.model) == ("http://h:1", "m")
    traces = spark.createDataFrame([({"a": "b"},), ({"base_url": "http://127.0.0.1:9"},)], "metadata map<string,string>")
    found, why = embeddings.discover(traces, {}, timeout=2)
    assert found is None and "127.0.0.1:9" in why


SNAPSHOTS = [
    {"codebase_root": "/repos/one", "nodes": [{"id": "n1", "name": "N"}, {"node_id": "n1", "type": "T", "node_type": "x", "metadata": {"path": "p", "depth": 2, "none": None, "more": {"a": 1}}}, {"label": "lost"}], "edges": [{"source": "n1", "target": "n2"}, {"source": "n2", "target": "n3", "type": "USES"}]},
    {"codebase_root": None, "datasets": {"d": {"name": "D", "source_file": "f.sql"}, "e": {"dataset_type": "seed"}}, "transformations": {"t": {"transformation_type": "model"}}, "edges": []},
    {"codebase_root": "/repos/two/sub", "nodes": [{"id": "q", "metadata": {"source_file": "/REPOS/Three/x.py"}}], "edges": [], "datasets": {"no": {}}},
    {"something": "else"},
]


def test_snapshots_as_tables(spark, tmp_path):
    path = tmp_path / "s.json"
    shapes = (("﻿" + "\n\n".join(map(json.dumps, SNAPSHOTS)), "jsonl", 4), (json.dumps(SNAPSHOTS[0], indent=1), "whole-file-json", 1), (json.dumps([*SNAPSHOTS, 3, "x"], indent=1), "json-array", 4))
    for text, label, n in shapes:
        path.write_text(text, encoding="utf-8")
        snapshots, how = readers.read_snapshot_rows(spark, str(path))
        assert how == label and snapshots.count() == n
        nodes, edges = (df.collect() for df in lineage.snapshot_tables(snapshots))
        ords = sorted(r.ord for r in snapshots.select("ord").collect())
        for place, document in zip(ords, SNAPSHOTS, strict=False):
            plain_nodes, plain_edges = lineage.normalize_snapshot(spark, document)
            strip = lambda m: {k: v.replace(" ", "") for k, v in m.items()}
            assert sorted((r.node_id, r.node_type, r.label, sorted(strip(r.metadata).items())) for r in nodes if r.ord == place) == sorted((r.node_id, r.node_type, r.label, sorted(strip(r.metadata).items())) for r in plain_nodes.collect())
            assert sorted((r.source, r.target, r.relationship) for r in edges if r.ord == place) == sorted(tuple(r) for r in plain_edges.collect())
    for bad in ("", "not json", "[1, 2]", "3"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            readers.read_snapshot_rows(spark, str(path))


@pytest.mark.parametrize(("roots", "node", "label"), [([("/repos/one", "one")], "n1", "matched-root"), ([("/repos/two", "two")], "q", "matched-root"), ([("/repos/three", "three")], "q", "matched-root"), ([("/nowhere", "nothing")], None, "fallback-last"), ([], None, "fallback-last")])
def test_the_snapshot_that_fits_best_is_chosen(spark, tmp_path, roots, node, label):
    path = tmp_path / "s.jsonl"
    path.write_text("\n".join(map(json.dumps, SNAPSHOTS)))
    snapshots, _ = readers.read_snapshot_rows(spark, str(path))
    nodes, _, how = lineage.chosen_snapshot(spark, snapshots, roots)
    assert how == label and [r.node_id for r in nodes.collect()] == ([node] if node else [])


def test_roots_of_a_contract(spark, tmp_path):
    (tmp_path / "repo/.git").mkdir(parents=True)
    (tmp_path / "data.jsonl").write_text("\n".join(json.dumps({"source_path": f"{tmp_path}/repo/src/a{k}.py"}) for k in range(3)))
    assert readers.contract_roots(spark, {"servers": {"local": {"path": "data.jsonl"}}}, str(tmp_path)) == [tmp_path / "repo"]
    assert readers.contract_roots(spark, {}) == [] and readers.contract_roots(spark, {"servers": {"local": {"path": "/nowhere"}}}) == []
