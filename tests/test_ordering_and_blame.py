"""Rows numbered by range, blame of one large file in many tasks, candidates of all failures at once, and renames by bounds."""

import collections
import random
import string
import time

import pytest
from pyspark.sql import functions as F

from accordant.operators import attribution, evolution, ordering, text_drift
from accordant.operators.contract import Clause, Contract
from accordant.plans import workflows
from accordant.sources import scratch


@pytest.mark.parametrize("n", [0, 1, 2, 7, 5000])
def test_halves_at_the_midpoint(spark, n):
    rows = [(i, i // 3, None if i % 11 == 0 else str(i)) for i in range(n)]
    random.Random(n).shuffle(rows)
    df = spark.createDataFrame(rows, "id long, at long, text string").repartition(5)
    first, second = (sorted(tuple(r) for r in half.collect()) for half in text_drift.midpoint_windows(df, "at"))
    cut = max(n // 2, 1)
    if n <= 1:
        assert first == second == sorted(rows, key=str)
    else:
        assert sorted(first + second) == sorted(rows) and len(first) == cut and max(r[1] for r in first) <= min(r[1] for r in second)


def test_numbers_are_dealt_over_parts(spark):
    df = spark.range(0, 50_000, 1, 6).select((F.col("id") * 7919 % 50_000).alias("x"))
    out = ordering.numbered(df, ["x"], scratch.Tables(spark), "test")
    assert out.where("number <> x or rows <> 50000").count() == 0


def _plain_blame(lines):
    entries, details = [], {}
    for path, _, line in sorted(lines):
        head = line.split(" ")[0]
        if len(head) == 40 and all(c in string.hexdigits.lower() for c in head):
            entries.append([path, head, {}])
        elif entries and entries[-1][0] == path:
            for key, name in attribution.DETAILS.items():
                if line.startswith(f"{key} "):
                    entries[-1][2][name] = line[len(key) + 1 :]
    for _, head, own in entries:
        for k, v in own.items():
            details.setdefault((head, k), v)
    return collections.Counter((path, head, *(own.get(k) or details.get((head, k)) for k in attribution.DETAILS.values())) for path, head, own in entries)


def test_blame_of_files_that_stand_in_many_parts(spark):
    rng = random.Random(2)
    lines = []
    for f in ("big.py", "small.py", "odd.py"):
        told, ord_ = set(), 0
        for k in range(3000 if f == "big.py" else 5):
            commit = f"{rng.randrange(40) if k % 3 else 7:040x}"
            block = [f"{commit} {k} {k} 1"] + ([f"author A{commit[-2:]}", f"author-mail <{commit[-2:]}>", "author-time 5", f"summary s {commit[-1]}"] if commit not in told else []) + [f"\ttext {k}"]
            told.add(commit)
            for line in (["no header yet"] if f == "odd.py" and not k else []) + block:
                lines.append((f, ord_, line))
                ord_ += 1
    df = spark.createDataFrame(lines, "file_path string, ord long, line string").repartition(7)
    got = collections.Counter(tuple(r) for r in attribution.parse_blame(df).select("file_path", "commit_hash", *attribution.DETAILS.values()).collect())
    assert got == _plain_blame(lines)


def test_a_long_blame_is_dealt_to_many_tasks(spark):
    n = 300_000
    line = F.when(F.col("id") % 3 == 0, F.concat(F.lpad(F.hex(F.col("id") % 50), 40, "0"), F.lit(" 1 1 1"))).when(F.col("id") % 3 == 1, F.concat(F.lit("author A"), F.col("id") % 50)).otherwise("\tx")
    df = spark.range(0, n, 1, 8).select(F.lit("one.py").alias("file_path"), F.col("id").alias("ord"), F.lower(line).alias("line"))
    counts = attribution.blame_counts(attribution.parse_blame(df))
    assert counts.agg(F.sum("line_hits")).first()[0] == n // 3
    laid = ordering.laid_out(df, ["file_path", "ord"], scratch.Tables(spark), "test-blame")
    sizes = [r["count"] for r in laid.groupBy("_part").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 0.6 * n


def test_candidates_of_all_failures_are_those_of_each(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "confidence", "fact_tables", "delta"]
    files = [(f"src/{rng.choice(['strategies/', 'a/', ''])}f{i}.py", " ".join(rng.choice(words) for _ in range(rng.randrange(6))) or None) for i in range(80)]
    files += [(attribution.PREFERRED[0], "confidence"), ("tests/x.py", "alpha beta"), ("README.md", "alpha")]
    df = spark.createDataFrame(files, "path string, content string")
    tokens = {"one": ["alpha", "beta"], "two": ["gamma", "delta", "alpha"], "three": ["nowhere"]}
    got = attribution.failure_candidates(df, tokens)
    every = collections.defaultdict(list)
    for r in got.orderBy("check_id", "rank").collect():
        every[r.check_id].append((r.path, r.score, r.token_hits))
    for check, own in tokens.items():
        assert every[check] == [tuple(r) for r in attribution.candidate_files(df, own).collect()]
    assert len(every["one"]) == 5 and [r[0] for r in every["three"]] == [attribution.PREFERRED[0]]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2  # the files and the tokens, once each


def test_attribution_ranks_files_of_each_failure(spark):
    schema = "check_id string, column_name string, check_type string, status string, severity string, message string, records_failing long"
    results = spark.createDataFrame([("c.fact_confidence.range", "fact_confidence", "range", "FAIL", "CRITICAL", "too high", 3), ("c.page.type", "page", "type", "FAIL", "CRITICAL", "page odd", 1), ("c.x.type", "x", "type", "PASS", "LOW", "", 0)], schema)
    files = spark.createDataFrame([("src/fact_table.py", "confidence 0.0, le=1.0"), ("src/page.py", "page odd"), ("src/other.py", "nothing")], "path string, content string")
    blame = spark.createDataFrame([(p, "h" * 40, "a", "e", "1", "s") for p in ("src/fact_table.py", "src/page.py") for _ in range(3)], "file_path string, commit_hash string, author string, email string, commit_ts string, summary string")
    recent = blame.select("file_path", "commit_hash", "commit_ts").distinct()
    from accordant.operators import registry

    subscriptions = registry.subscriptions_frame(spark, {"subscriptions": [{"contract_id": "c", "subscriber_id": "s", "fields_consumed": ["page"]}]})
    log = spark.createDataFrame([("c.page.type",)] * 2, "check_id string")
    out = {r.check_id: r for r in workflows.attribute(results, Contract("c", ()), subscriptions, files, blame, recent, log, "sys").collect()}
    assert set(out) == {"c.fact_confidence.range", "c.page.type"}
    assert out["c.page.type"].violation_count == 2 and [b.file_path for b in out["c.page.type"].blame_chain] == ["src/page.py"]
    assert out["c.fact_confidence.range"].blame_chain[0].file_path == "src/fact_table.py"


def _plain_renames(removed, added):
    pairs = sorted(((evolution.similarity(a, b), a.name, b.name) for a in removed for b in added), reverse=True)
    out = []
    for score, old, new in pairs:
        if score >= 0.7 and not any(old == o or new == n for o, n, _ in out):
            out.append((old, new, round(score, 3)))
    return out


def _schema(rng, n, stem):
    parts = ["fact", "confidence", "page", "ref", "total", "count", "source", "path", "id", "name", "score"]
    return [Clause("_".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) + f"_{stem}{i}", rng.choice(["string", "number", "integer"]), rng.random() < 0.5, description=rng.choice(["", "Observed field", "Some words"])) for i in range(n)]


def test_renames_against_all_pairs():
    rng = random.Random(6)
    for n, m in ((0, 3), (3, 0), (60, 70)):
        removed, added = _schema(rng, n, "a"), _schema(rng, m, "b")
        assert evolution.renames(removed, added) == _plain_renames(removed, added)


def test_the_rename_of_a_confidence_field_has_a_known_score():
    #: Descriptions of the field before and after, whose score is known to be 0.837.
    before, after = "Confidence value for the extracted fact. This must remain in the 0.0-1.0 range.", "Simulated renamed field for CI gate testing. This intentionally breaks consumers expecting fact_confidence."
    old, new = Clause("fact_confidence", "number", True, description=before), Clause("fact_confidence_score", "number", True, description=after)
    assert evolution.renames([old], [new]) == [("fact_confidence", "fact_confidence_score", 0.837)]


def test_large_schemas_are_not_compared_pair_by_pair(monkeypatch):
    rng = random.Random(7)
    letters = string.ascii_lowercase
    make = lambda i: Clause("".join(rng.choice(letters) for _ in range(18)) + str(i), rng.choice(["string", "number"]), False)
    removed, added = [make(i) for i in range(5000)], [make(i) for i in range(5000)]
    runs, plain = [0], evolution._ratio

    def counted(a, b):
        runs[0] += 1
        return plain(a, b)

    monkeypatch.setattr(evolution, "_ratio", counted)
    began = time.perf_counter()
    evolution.renames(removed, added)
    assert runs[0] < 400_000 and time.perf_counter() - began < 120


