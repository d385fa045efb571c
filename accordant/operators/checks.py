"""Contracts compiled into one aggregation: all checks of all columns in a single pass over the data.

``compile_checks`` turns clauses into aggregates and, over their one row of results, a list of check rows; the whole is one lazy
plan without a shuffle of data rows. Example values come from ``with_samples``, which looks at failing checks only and stops at five.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.functions import values as V
from accordant.operators import firsts
from accordant.operators.contract import Clause, Contract

SAMPLES = 5
#: Stands for a failing null among samples until they are put together.
GAP = "\x00null"
RESULT = "check_id string, column_name string, check_type string, status string, actual_value string, expected string, severity string, records_failing long, message string"


@dataclass(frozen=True)
class Rule:
    """One check of a present column: aggregates by name, the result as expressions over them, the rows that fail."""

    check_id: str
    column: str
    kind: str
    aggregates: dict[str, Column]
    status: Column
    actual: Column
    expected: Column
    severity: Column
    failing: Column
    message: Column
    fails: Column

    def row(self) -> Column:
        named = dict(check_id=F.lit(self.check_id), column_name=F.lit(self.column), check_type=F.lit(self.kind), status=self.status, actual_value=self.actual, expected=self.expected, severity=self.severity)
        named |= dict(records_failing=self.failing.cast("long"), message=self.message)
        return F.struct(*[v.alias(k) for k, v in named.items()])


def _counted(contract: str, clause: Clause, suffix: str, kind: str, key: str, fails: Column, actual: str, expected: str, good: str, bad: str) -> Rule:
    n = F.col(key)
    return Rule(
        f"{contract}.{clause.name}.{suffix}", clause.name, kind, {key: F.count_if(fails)},
        F.when(n == 0, "PASS").otherwise("FAIL"), F.concat(F.lit(actual), n.cast("string")), F.lit(expected),
        F.when(n == 0, "LOW").otherwise("CRITICAL"), n, F.when(n == 0, good).otherwise(bad), fails,
    )


def logical_type(data_type: T.DataType, nulls: Column, rows: Column) -> Column:
    """string, integer, number or boolean. Whole numbers with a gap are numbers, and booleans with a gap are text."""
    if isinstance(data_type, T.BooleanType):
        return F.when(nulls == 0, "boolean").otherwise("string")
    if isinstance(data_type, V.INTEGRAL):
        return F.when(nulls == 0, "integer").otherwise(F.when(nulls == rows, "string").otherwise("number"))
    if isinstance(data_type, V.NUMERIC):
        return F.lit("number")
    return F.lit("string")


def _type_matches(expected: str, kind: Column) -> Column:
    allowed = {"string": ("string",), "integer": ("integer",), "number": ("integer", "number"), "boolean": ("boolean",)}
    return kind.isin(*allowed[expected]) if expected in allowed else F.lit(True)


def structural_rules(contract: str, clause: Clause, data_type: T.DataType, i: int) -> list[Rule]:
    col = F.col(f"`{clause.name}`")
    there, as_text = V.present(col, data_type), V.text(col, data_type)
    name, out = clause.name, []
    if clause.required:
        out.append(_counted(contract, clause, "required", "required", f"c{i}_required", ~there, "missing=", "missing=0", f"{name} is fully populated.", f"{name} has nulls but is required."))
    if clause.type:
        rows, nulls = F.col(f"c{i}_rows"), F.col(f"c{i}_rows") - F.col(f"c{i}_there")
        kind = logical_type(data_type, nulls, rows)
        fine = _type_matches(clause.type, kind)
        out.append(
            Rule(
                f"{contract}.{name}.type", name, "type", {f"c{i}_rows": F.count("*"), f"c{i}_there": F.count_if(there)},
                F.when(fine, "PASS").otherwise("FAIL"), kind, F.lit(clause.type), F.when(fine, "LOW").otherwise("CRITICAL"), F.when(fine, 0).otherwise(F.col(f"c{i}_there")),
                F.when(fine, f"{name} matches expected type {clause.type}.").otherwise(F.concat(F.lit(f"{name} dtype "), kind, F.lit(f" does not match expected {clause.type}."))), there,
            )
        )
    if clause.enum:
        fails = there & ~as_text.isin(*clause.enum)
        out.append(
            _counted(contract, clause, "enum", "enum", f"c{i}_enum", fails, "nonconforming=", f"subset_of={sorted(set(clause.enum))}", f"{name} only contains allowed enum values.", f"{name} contains values outside the allowed enum.")
        )
    if clause.format == "uuid":
        fails = there & ~as_text.rlike(V.UUID_LOOSE)
        out.append(_counted(contract, clause, "uuid", "format", f"c{i}_uuid", fails, "invalid_uuid=", "^[0-9a-f-]{36}$", f"{name} matches the UUID format.", f"{name} contains values that do not match the UUID format."))
    if clause.format == "date-time":
        fails = there & ~V.is_iso_datetime(as_text)
        out.append(
            _counted(contract, clause, "datetime", "format", f"c{i}_datetime", fails, "unparseable=", "ISO-8601 date-time", f"{name} parses as ISO-8601 date-time.", f"{name} contains values that do not parse as ISO-8601 date-time.")
        )
    if clause.pattern:
        fails = there & ~V.starts_matching(as_text, clause.pattern)
        out.append(_counted(contract, clause, "pattern", "pattern", f"c{i}_pattern", fails, "pattern_failures=", clause.pattern, f"{name} matches the expected pattern.", f"{name} contains values that do not match the expected pattern."))
    return out


def statistical_rules(contract: str, clause: Clause, data_type: T.DataType, i: int, baseline: tuple[float, float] | None) -> list[Rule]:
    col, name, out = F.col(f"`{clause.name}`"), clause.name, []
    value, there = V.number(col, data_type), V.present(col, data_type)
    shared = {f"c{i}_numbers": F.count(value), f"c{i}_values": F.count_if(there), f"c{i}_least": F.min(value), f"c{i}_most": F.max(value)}
    numbers, present = F.col(f"c{i}_numbers"), F.col(f"c{i}_values")

    def ladder(kind: str, aggregates: dict[str, Column], status: Column, actual: Column, expected: str, severity: Column, failing: Column, message: Column, wanted: str, why: str, fails: Column) -> Rule:
        none = numbers == 0
        pick = lambda odd, usual: F.when(none, odd).otherwise(usual)
        return Rule(
            f"{contract}.{name}.{kind}", name, kind, shared | aggregates, pick(F.lit("ERROR"), status), pick(F.lit("non-numeric column"), actual), pick(F.lit(wanted), F.lit(expected)),
            pick(F.lit("CRITICAL"), severity), pick(present, failing), pick(F.lit(f"{name} is not numeric, so {why}."), message), fails,
        )

    if clause.minimum is not None or clause.maximum is not None:
        fails = F.lit(False)
        if clause.minimum is not None:
            fails = fails | F.coalesce(value < float(clause.minimum), F.lit(False))
        if clause.maximum is not None:
            fails = fails | F.coalesce(value > float(clause.maximum), F.lit(False))
        n = F.col(f"c{i}_range")
        actual = F.concat(F.lit("min="), F.col(f"c{i}_least").cast("string"), F.lit(", max="), F.col(f"c{i}_most").cast("string"))
        message = F.when(n == 0, f"{name} stays within the configured range.").otherwise(f"{name} is outside the configured range. Breaking change detected.")
        out.append(
            ladder("range", {f"c{i}_range": F.count_if(fails)}, F.when(n == 0, "PASS").otherwise("FAIL"), actual, f"min>={clause.minimum}, max<={clause.maximum}", F.when(n == 0, "LOW").otherwise("CRITICAL"), n, message,
                   "numeric values for range check", "the range check could not run", fails)
        )
    if baseline is not None:
        mean, spread = baseline
        z = F.abs(F.col(f"c{i}_mean") - mean) / max(spread, 1e-9)
        status = F.when(z > 3, "FAIL").when(z > 2, "WARN").otherwise("PASS")
        message = (
            F.when(z > 3, F.format_string(f"{name} mean drifted %.1f stddev from baseline.", z)).when(z > 2, F.format_string(f"{name} mean within warning range (%.1f stddev).", z)).otherwise(f"{name} remains within the established baseline.")
        )
        actual = F.concat(F.lit("mean="), F.col(f"c{i}_mean").cast("string"), F.lit(", z_score="), V.round_half_even(z, 2).cast("string"))
        severity = F.when(z > 3, "HIGH").when(z > 2, "MEDIUM").otherwise("LOW")
        out.append(
            ladder("drift", {f"c{i}_mean": F.avg(value)}, status, actual, f"baseline_mean={mean}, baseline_stddev={spread}", severity, F.when(status == "PASS", 0).otherwise(numbers), message,
                   "numeric values for drift check", "drift could not be measured", F.lit(False))
        )
    return out


def missing_results(contract: str, clause: Clause, has_baseline: bool) -> tuple[list[tuple], list[tuple]]:
    """Rows for a column that isn't there: structural and statistical ones."""

    def row(kind: str) -> tuple:
        return (f"{contract}.{clause.name}.{kind}", clause.name, kind, "ERROR", "missing column", "column present", "CRITICAL", 0, f"{clause.name} is missing from the dataset, so the {kind} check could not run.")

    structural = [k for k, on in (("required", clause.required), ("type", clause.type), ("enum", clause.enum), (clause.format, clause.format), ("pattern", clause.pattern)) if on]
    statistical = [k for k, on in (("range", clause.minimum is not None or clause.maximum is not None), ("drift", has_baseline)) if on]
    return [row(k) for k in structural], [row(k) for k in statistical]


def compile_checks(df: DataFrame, contract: Contract, baselines: Mapping[str, tuple[float, float]] | None = None) -> tuple[list[Rule | tuple], list[Rule | tuple]]:
    """Structural and statistical checks in the order of the contract; rows for missing columns stand among them."""
    types = {f.name: f.dataType for f in df.schema.fields}
    structural: list[Rule | tuple] = []
    statistical: list[Rule | tuple] = []
    for i, clause in enumerate(contract.clauses):
        baseline = (baselines or {}).get(clause.name)
        if clause.name in types:
            structural += structural_rules(contract.id, clause, types[clause.name], i)
            statistical += statistical_rules(contract.id, clause, types[clause.name], i, baseline)
        else:
            a, b = missing_results(contract.id, clause, baseline is not None)
            structural += a
            statistical += b
    return structural, statistical


def run_checks(df: DataFrame, contract: Contract, baselines: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """A row for each check, with its place, counts over all rows and shares. One aggregation over the data."""
    rules = [r for part in compile_checks(df, contract, baselines) for r in part]
    aggregates: dict[str, Column] = {"_rows": F.count("*")}
    for rule in rules:
        if isinstance(rule, Rule):
            aggregates |= rule.aggregates
    names = [c.split()[0] for c in RESULT.split(", ")]
    rows = []
    for ordinal, rule in enumerate(rules):
        body = rule.row() if isinstance(rule, Rule) else F.struct(*[F.lit(v).cast("long" if n == "records_failing" else "string").alias(n) for n, v in zip(names, rule, strict=True)])
        rows.append(F.struct(F.lit(ordinal).alias("ordinal"), *[body.getField(n).alias(n) for n in names]))
    if not rows:
        return df.sparkSession.createDataFrame([], f"ordinal int, {RESULT}, records_total long, failing_fraction double, failing_percent double")
    out = df.agg(*[v.alias(k) for k, v in aggregates.items()]).select("_rows", F.inline(F.array(*rows)))
    share = F.col("records_failing") / F.greatest(F.col("_rows"), F.lit(1))
    return out.withColumns({"records_total": F.col("_rows"), "failing_fraction": V.round_half_even(share, 6), "failing_percent": V.round_half_even(share * 100, 2)}).drop("_rows")


def guarded(df: DataFrame, contract: Contract, baselines: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """``run_checks``, evaluated; if the statistical part breaks off, the structural results and a row that says so."""
    spark: SparkSession = df.sparkSession
    try:
        rows = run_checks(df, contract, baselines).collect()  # a row for each check
        return spark.createDataFrame(rows, run_checks(df.limit(0), contract, baselines).schema)
    except Exception as problem:  # noqa: BLE001 - whatever it is, it becomes a result
        plain = Contract(contract.id, tuple(Clause(c.name, c.type, c.required, c.format, c.pattern, c.enum) for c in contract.clauses))
        result = (f"{contract.id}.__runner__.execution", "__runner__", "execution", "ERROR", type(problem).__name__, "successful execution", "CRITICAL", 0, str(problem)[:500])
        broken = spark.createDataFrame([(10**6, *result, 0, 0.0, 0.0)], f"ordinal int, {RESULT}, records_total long, failing_fraction double, failing_percent double")
        try:
            kept = run_checks(df, plain)
            return spark.createDataFrame(kept.collect(), kept.schema).unionByName(broken)
        except Exception:  # noqa: BLE001
            return broken


def with_samples(df: DataFrame, contract: Contract, results: DataFrame, order_by: str | None = None) -> DataFrame:
    """Adds sample_failing: at most five failing values of each failing check, first in ``order_by``. One more pass over the data, whatever the number of failing checks."""
    failing = {r.check_id for r in results.where("status = 'FAIL'").select("check_id").distinct().collect()}  # a row a check
    types = {f.name: f.dataType for f in df.schema.fields}
    rules = [r for part in compile_checks(df, contract) for r in part if isinstance(r, Rule) and r.check_id in failing]
    none = F.array().cast("array<string>")
    if not rules:
        return results.withColumn("sample_failing", none)
    fields = {r.check_id: F.when(r.fails, F.coalesce(V.text(F.col(f"`{r.column}`"), types[r.column]), F.lit(GAP))) for r in rules}
    found = firsts.first_values(df, fields, SAMPLES, F.col(order_by) if order_by else None, distinct=False)
    listed = F.array_sort(F.collect_list(F.struct("rank", "value")))
    shown = F.transform(listed, lambda x: F.when(x["value"] != GAP, x["value"]))
    samples = found.groupBy(F.col("field").alias("check_id")).agg(shown.alias("sample_failing"))
    return results.join(F.broadcast(samples), "check_id", "left").withColumn("sample_failing", F.coalesce("sample_failing", none))


def numeric_baseline(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, mean, stddev) of the numeric columns that have values: what drift is later measured against."""
    types = {f.name: f.dataType for f in df.schema.fields}
    chosen = [c for c in (columns or df.columns) if isinstance(types[c], V.NUMERIC)]
    if not chosen:
        return df.sparkSession.createDataFrame([], "column string, mean double, stddev double")
    aggregates = []
    for i, c in enumerate(chosen):
        value = V.number(F.col(f"`{c}`"), types[c])
        aggregates += [F.avg(value).alias(f"m{i}"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias(f"s{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("stddev")) for i, c in enumerate(chosen)])
    return df.agg(*aggregates).select(F.inline(rows)).where("mean is not null")


def sql_test_failures(df: DataFrame, column: str, test: str, **arguments) -> DataFrame:
    """The rows that a SQL test finds fault with; for unique, the values that stand more than once."""
    c = F.col(f"`{column}`")
    if test == "not_null":
        return df.where(c.isNull())
    if test == "accepted_values":
        return df.where(c.isNotNull() & ~c.cast("string").isin(*[str(v) for v in arguments["values"]]))
    if test == "between":
        x = c.cast("string").try_cast("double")
        bad = x.isNull()
        if arguments.get("min_value") is not None:
            bad = bad | (x < float(arguments["min_value"]))
        if arguments.get("max_value") is not None:
            bad = bad | (x > float(arguments["max_value"]))
        return df.where(c.isNotNull() & bad)
    if test == "matches":
        regex = arguments["regex"]
        whole = regex if regex.endswith("$") else regex + ".*"
        return df.where(c.isNotNull() & ~c.cast("string").rlike(f"^(?:{whole})$"))
    if test == "unique":
        return df.where(c.isNotNull()).groupBy(c).count().where("count > 1")
    raise ValueError(f"no such test: {test}")
