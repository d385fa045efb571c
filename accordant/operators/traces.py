"""Shapes of trace runs, prompt inputs and verdicts, and how often they are broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.operators import policy

#: Run types of a trace, and older names of two of them.
RUN_TYPES = ("chain", "embedding", "llm", "retriever", "tool")
CANONICAL = {"prompt": ("chain", "prompt_assembly"), "parser": ("tool", "output_parsing")}
VERDICT_FIELDS = ("confidence", "evaluated_at", "overall_score", "overall_verdict", "rubric_id", "rubric_version", "scores", "target_ref", "verdict_id")
SHAPE_RATES, TRACE_RATES = (0.02, 0.08), (0.05, 0.12)


def canonicalize(traces: DataFrame) -> DataFrame:
    """Run types under their present names; metadata(map) keeps the name that was given, and the role of renamed ones."""
    given = F.trim("run_type")
    metadata = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    new_type, role = given, F.lit(None).cast("string")
    for old, (now, what) in CANONICAL.items():
        new_type, role = F.when(given == old, now).otherwise(new_type), F.when(given == old, what).otherwise(role)
    renamed = given.isin(*CANONICAL)
    put = lambda m, extra: F.map_concat(F.map_filter(m, lambda k, _: ~F.array_contains(F.map_keys(extra), k)), extra)
    changed = put(metadata, F.create_map(F.lit("original_run_type"), given, F.lit("span_role"), role))
    same = F.when(F.map_contains_key(metadata, "original_run_type") | given.isNull(), metadata).otherwise(put(metadata, F.create_map(F.lit("original_run_type"), given)))
    return traces.withColumns({"run_type": new_type, "metadata": F.when(renamed, changed).otherwise(same)})


def normalization_counts(traces: DataFrame) -> DataFrame:
    """(run_type, n) of the run types that were given other names."""
    return traces.where(F.trim("run_type").isin(*CANONICAL)).groupBy(F.trim("run_type").alias("run_type")).agg(F.count("*").alias("n"))


def prompt_family(inputs: Column) -> Column:
    """struct(family, valid) of a map of inputs (values as JSON text, strings in quotes): the first family all of whose keys are there."""
    has = lambda *keys: F.size(F.array_except(F.array(*map(F.lit, keys)), F.map_keys(inputs))) == 0
    raw = lambda k: inputs[k]
    is_text = lambda k: raw(k).startswith('"')
    as_text = lambda k: F.when(is_text(k), F.get_json_object(F.concat(F.lit('{"v":'), raw(k), F.lit("}")), "$.v"))
    is_whole = lambda k: raw(k).rlike(r"^-?\d+$")
    whole = lambda k: F.when(is_whole(k), raw(k).try_cast("long"))
    is_bool = lambda k: raw(k).isin("true", "false")
    filled = lambda k, n=1: is_text(k) & (F.length(F.trim(as_text(k))) >= n)
    page = filled("document_id") & is_whole("page") & (whole("page") >= 1) & is_text("section") & filled("text", 20)
    section = filled("section_title") & filled("section_text", 20) & (is_bool("numeric_dense") | is_whole("numeric_dense"))
    task = (
        filled("task") & filled("prompt", 20) & filled("system", 10) & is_whole("prompt_chars") & (whole("prompt_chars") >= F.length(as_text("prompt")) * 0.5) & is_whole("system_chars")
        & (whole("system_chars") >= F.length(as_text("system")) * 0.5) & is_bool("format_json")
    )
    valid = lambda c: F.coalesce(c, F.lit(False))
    pair = lambda name, ok: F.struct(F.lit(name).alias("family"), ok.alias("valid"))
    return (
        F.when(has("document_id", "page", "section", "text"), pair("document_page_text", valid(page)))
        .when(has("numeric_dense", "section_text", "section_title"), pair("section_prompt", valid(section)))
        .when(has("format_json", "prompt", "prompt_chars", "system", "system_chars", "task"), pair("task_prompt", valid(task)))
        .otherwise(pair("unrecognized_prompt_shape", F.lit(False)))
    )


def _metric(df: DataFrame, failing: Column, rates: tuple[float, float], name: str) -> DataFrame:
    counted = df.agg(F.count("*").alias("checked"), F.count_if(failing).alias("failing"))
    rate = F.bround(F.col("failing") / F.greatest("checked", F.lit(1)), 6)
    status = policy.status_from_rate(F.col("failing") / F.greatest("checked", F.lit(1)), *rates)
    return counted.select(F.lit(name).alias("metric"), "checked", "failing", rate.alias("value"), status.alias("status"), policy.severity_for_status(status).alias("severity"))


def prompt_metric(traces: DataFrame) -> DataFrame:
    """Share of prompt runs of traces(run_type, metadata, inputs) whose inputs have no valid shape."""
    prompts = traces.where((F.col("run_type") == "prompt") | (F.col("metadata")["original_run_type"] == "prompt"))
    return _metric(prompts, ~prompt_family(F.col("inputs"))["valid"], SHAPE_RATES, "prompt_input_schema_violation_rate")


def family_counts(traces: DataFrame) -> DataFrame:
    return traces.groupBy(prompt_family(F.col("inputs"))["family"].alias("family")).agg(F.count("*").alias("n"))


def verdict_problems(df: DataFrame) -> Column:
    """What is wrong with a verdict: codes of missing fields, wrong values and scores of the wrong shape. scores: map to structs or null."""
    field = lambda c: F.col(c) if c in df.columns else F.lit(None)
    missing = [F.when(field(c).isNull(), F.lit(f"missing:{c}")) for c in VERDICT_FIELDS]
    verdict = F.when(F.coalesce(~F.col("overall_verdict").isin("PASS", "FAIL", "WARN"), F.lit(True)), "invalid:overall_verdict")
    confidence = F.col("confidence").cast("string").try_cast("double")
    range_ = F.when(confidence.isNull(), "type:confidence").when((confidence < 0) | (confidence > 1), "range:confidence")
    empty = F.when(F.coalesce(F.size(F.map_keys("scores")) <= 0, F.lit(True)), "type:scores")
    each = F.transform(
        F.map_entries("scores"),
        lambda e: F.when(e["value"].isNull(), F.concat(F.lit("type:scores."), e["key"])).when(
            e["value"]["score"].isNull() | e["value"]["evidence"].isNull() | e["value"]["notes"].isNull(), F.concat(F.lit("shape:scores."), e["key"])
        ),
    )
    single = F.array(*missing, verdict, range_, empty)
    return F.filter(F.concat(single, F.coalesce(each, F.array().cast("array<string>"))), lambda x: x.isNotNull())


def verdict_metric(verdicts: DataFrame) -> DataFrame:
    return _metric(verdicts, F.size(verdict_problems(verdicts)) > 0, SHAPE_RATES, "llm_output_schema_violation_rate")


def trace_metric(traces: DataFrame) -> DataFrame:
    """Share of runs of no known type, with counts of runs that end before they start or have too few tokens, which don't count."""
    unknown = F.coalesce(~F.col("run_type").isin(*RUN_TYPES), F.lit(True))
    start, end = (F.col(c).cast("string").try_cast("timestamp") for c in ("start_time", "end_time"))
    backward = F.coalesce(end <= start, F.lit(True))
    t = lambda c: F.coalesce(F.col(c), F.lit(0))
    short = t("total_tokens") < t("prompt_tokens") + t("completion_tokens")
    extra = traces.agg(F.count_if(backward).alias("duration_failures"), F.count_if(short).alias("token_failures"))
    return _metric(traces, unknown, TRACE_RATES, "trace_contract_violation_rate").join(F.broadcast(extra))


def findings(metrics: DataFrame) -> DataFrame:
    """Metrics on traces that are to be logged."""
    return metrics.where((F.col("metric") == "trace_contract_violation_rate") & F.col("status").isin("WARN", "FAIL"))
