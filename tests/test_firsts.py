"""First values by place and exact order statistics against plain versions, and the plans that make them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.operators import checks, firsts, profile
from accordant.operators.contract import Clause, Contract


def _rows(n, rng):
    return [(rng.choice([None, *range(n // 3 + 1)]), rng.choice([None, "a", "b", "c"]), rng.choice([None, *(f"w{k}" for k in range(40))]), "z" if i == n - 1 else None) for i in range(n)]


@pytest.mark.parametrize(("n", "distinct"), [(3000, True), (3000, False), (1, True), (0, True)])
def test_first_values_against_a_plain_version(spark, n, distinct):
    rows = _rows(n, random.Random(n))
    df = spark.createDataFrame(rows, "p int, few string, many string, last string").repartition(5)
    got = {}
    for r in firsts.first_values(df, {c: F.col(c) for c in ("few", "many", "last")}, 6, F.col("p"), distinct).collect():
        got.setdefault(r.field, []).append((r["rank"], r.value))
    for i, c in enumerate(("few", "many", "last"), 1):
        entries = sorted((r[0] is not None, r[0] or 0, r[i]) for r in rows if r[i] is not None)
        if distinct:
            entries = [e for k, e in enumerate(entries) if e[2] not in {x[2] for x in entries[:k]}] if len(entries) < 50 else list({e[2]: e for e in reversed(entries)}.values())
        assert sorted(got.get(c, [])) == [(k + 1, e[2]) for k, e in enumerate(sorted(entries)[:6])]


def test_first_values_stand_in_reading_order_and_bounded(spark):
    df = spark.range(0, 200_000, 1, 4).select((F.lit(199_999) - F.col("id")).cast("string").alias("v"), F.when(F.col("id") % 1000 == 999, "x").alias("rare"))
    plan = firsts.first_values(df, {"v": F.col("v"), "rare": F.col("rare")}, 3)
    assert sorted((r.field, r["rank"], r.value) for r in plan.collect()) == [("rare", 1, "x"), ("v", 1, "199999"), ("v", 2, "199998"), ("v", 3, "199997")]
    assert "Generate" not in plan._jdf.queryExecution().executedPlan().toString()


def _plain_quantile(values, q):
    values = sorted(values)
    place = q * (len(values) - 1)
    low, high = math.floor(place), math.ceil(place)
    return values[low] if low == high or values[low] == values[high] else (high - place) * values[low] + (place - low) * values[high]


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    columns = {
        "whole": rng.integers(-50, 50, 5000).astype(float), "tiny": rng.normal(size=5000) * 1e-300, "wide": np.exp(rng.normal(size=5000) * 200), "same": np.full(5000, -0.0), "close": 1e6 + np.arange(5000) * 1e-10,
        "ends": np.array([-np.inf, np.inf, 0.0, -5e-324] * 1250), "prices": np.round(rng.uniform(900, 105_000, 5000), 2),
    }
    rows = [tuple(None if i % 7 == 3 else float(v[i]) for v in columns.values()) + (None,) for i in range(5000)]
    names = [*columns, "none"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(5)
    counts = {c: sum(r[k] is not None for r in rows) for k, c in enumerate(names)}
    shares = (0.0, 0.05, 0.5, 0.95, 1.0)
    got = firsts.quantiles(df, {c: F.col(c) for c in names}, counts, shares)
    assert got.pop("none") == [None] * 5
    for k, c in enumerate(columns):
        assert got[c] == [_plain_quantile([r[k] for r in rows if r[k] is not None], q) for q in shares], c


def test_quantiles_of_a_million_different_values(spark):
    df = spark.range(0, 1_000_000, 1, 8).select((F.hash("id").cast("double") + F.col("id") / 1e7).alias("x"))
    exact = df.agg(F.percentile("x", F.array(F.lit(0.5), F.lit(0.95)))).first()[0]
    assert firsts.quantiles(df, {"x": F.col("x")}, {"x": 1_000_000}, (0.5, 0.95))["x"] == pytest.approx(exact, rel=1e-15)


def test_profile_has_no_row_for_each_cell(spark):
    df = spark.createDataFrame([(i, f"v{i % 30}", None if i % 3 else i / 2, None) for i in range(900)], "i long, v string, x double, nothing string").repartition(3)
    facts = profile.clause_frame(df, "i")
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 1 and "explode" not in plan  # the one row of facts becomes a row for each column
    got = {r["column"]: (r.cardinality_estimate, r.sample_values, r.enum_values, r.nulls) for r in facts.collect()}
    assert got["v"] == (30, ["v0", "v1", "v2", "v3", "v4"], None, 0)
    assert got["nothing"] == (0, None, None, 900) and got["x"][0] == 300 and got["x"][1] == ["0.0", "1.5", "3.0", "4.5", "6.0"]
    assert profile.numeric_profile(df.select("v")).count() == 0 and profile.numeric_profile(df.where("x is null"), ["x"]).count() == 0


def test_samples_of_all_failing_checks_in_one_pass(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "ok", float(i)) for i in range(100)], "i long, v string, x double").repartition(4)
    clauses = (Clause("v", "string", True, enum=("no",)), Clause("x", "number", minimum=0.0, maximum=7.0), Clause("i", "integer", maximum=90.0))
    contract = Contract("c", clauses)
    checked = checks.run_checks(df, contract)
    results = spark.createDataFrame(checked.collect(), checked.schema)
    sampled = checks.with_samples(df, contract, results, "i")
    got = {r.check_id: r.sample_failing for r in sampled.collect()}
    assert got["c.v.required"] == [None] * 5 and got["c.v.enum"] == ["ok"] * 5 and got["c.x.range"] == ["8.0", "9.0", "10.0", "11.0", "12.0"] and got["c.i.range"] == ["91", "92", "93", "94", "95"]
    assert got["c.i.type"] == [] and sampled._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
