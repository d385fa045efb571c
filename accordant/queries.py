"""The engine's operators applied to whole tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accordant.functions import values as V
from accordant.operators import attribution, checks, dashboard, evolution, flatten, health, lineage, policy, profile, registry, text_drift, traces
from accordant.operators.contract import Clause, Contract, sql_tests
from accordant.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RESULT = ["check_id", "check_type", "status", "severity", "records_failing", "records_total", "failing_percent"]


def _percent(n: str, total: str = "count(*)") -> str:
    return f"cast(round_even(cast({n} as double) / greatest({total}, 1) * 100, 2) as double)"


def _check_sql(check_id: str, kind: str, fails: str, source: str, bad: str = "FAIL", severity: str = "CRITICAL") -> str:
    n = f"count(*) filter (where {fails})"
    return f"""select '{check_id}' as check_id, '{kind}' as check_type, case when {n} = 0 then 'PASS' else '{bad}' end as status,
      case when {n} = 0 then 'LOW' else '{severity}' end as severity, {n} as records_failing, count(*) as records_total, {_percent(n)} as failing_percent from {source}"""


def _union(*parts: str) -> str:
    return " union all ".join(parts)


# -- checks -------------------------------------------------------------------------------------------------

LINEITEM = Contract("lineitem", (Clause("l_orderkey", "integer", True), Clause("l_returnflag", "string", True, enum=("A", "N")), Clause("l_discount", "number", True, minimum=0.0, maximum=0.05)))
_LINEITEM_SQL = _union(
    _check_sql("lineitem.l_orderkey.required", "required", "l_orderkey is null", "lineitem"),
    _check_sql("lineitem.l_orderkey.type", "type", "false", "lineitem"),
    _check_sql("lineitem.l_returnflag.required", "required", "l_returnflag is null", "lineitem"),
    _check_sql("lineitem.l_returnflag.type", "type", "false", "lineitem"),
    _check_sql("lineitem.l_returnflag.enum", "enum", "l_returnflag not in ('A', 'N')", "lineitem"),
    _check_sql("lineitem.l_discount.required", "required", "l_discount is null", "lineitem"),
    _check_sql("lineitem.l_discount.type", "type", "false", "lineitem"),
    _check_sql("lineitem.l_discount.range", "range", "l_discount < 0 or l_discount > 0.05", "lineitem"),
)


@query(_LINEITEM_SQL)
def validate_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.run_checks(table(spark, sf_dir, "lineitem"), LINEITEM).select(RESULT)


@query(_check_sql("orders.o_orderpriority.required", "required", "o_orderpriority = '5-LOW'", "orders"))
def check_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = table(spark, sf_dir, "orders").withColumn("o_orderpriority", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")))
    return checks.run_checks(gaps, Contract("orders", (Clause("o_orderpriority", required=True),))).select(RESULT)


@query(
    _union(
        *[
            f"select 'matrix.{c}.type' as check_id, 'type' as check_type, '{s}' as status, '{v}' as severity, {n} as records_failing, count(*) as records_total, {_percent(n)} as failing_percent from events"
            for c, s, v, n in (
                ("whole", "PASS", "LOW", "0"), ("whole_gaps", "FAIL", "CRITICAL", "count(*) filter (where event_id % 7 <> 0)"), ("number_gaps", "PASS", "LOW", "0"), ("flag", "PASS", "LOW", "0"),
                ("flag_gaps", "FAIL", "CRITICAL", "count(*) filter (where event_id % 7 <> 0)"), ("flag_text", "PASS", "LOW", "0"), ("text", "FAIL", "CRITICAL", "count(*)"), ("odd", "PASS", "LOW", "0"),
            )
        ]
    )
)
def check_type_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type rule with and without gaps: whole numbers with gaps are numbers, booleans with gaps are text."""
    some = F.col("event_id") % 7 != 0
    df = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("whole"), F.when(some, F.col("event_id")).alias("whole_gaps"), F.when(some, F.col("event_id")).alias("number_gaps"), (F.col("value") > 0).alias("flag"),
        F.when(some, F.col("value") > 0).alias("flag_gaps"), F.when(some, F.col("value") > 0).alias("flag_text"), F.col("event_type").alias("text"), F.col("event_type").alias("odd"),
    )
    kinds = {"whole": "integer", "whole_gaps": "integer", "number_gaps": "number", "flag": "boolean", "flag_gaps": "boolean", "flag_text": "string", "text": "number", "odd": "unheard_of"}
    return checks.run_checks(df, Contract("matrix", tuple(Clause(k, v) for k, v in kinds.items()))).select(RESULT)


@query(_check_sql("events.event_type.enum", "enum", "event_type not in ('click', 'view')", "events"))
def check_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.run_checks(table(spark, sf_dir, "events"), Contract("events", (Clause("event_type", enum=("click", "view")),))).select(RESULT)


_AS_UUID = "case when c_custkey % 11 = 0 then c_name else concat_ws('-', substr(m, 1, 8), substr(m, 9, 4), substr(m, 13, 4), substr(m, 17, 4), substr(m, 21, 12)) end"


@query(_check_sql("customer.customer_id.uuid", "format", "not regexp_full_match(u, '[0-9a-fA-F-]{36}')", f"(select {_AS_UUID} as u from (select *, md5(c_name) as m from customer))"))
def check_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.md5("c_name")
    parts = [F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    df = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 11 == 0, F.col("c_name")).otherwise(F.concat_ws("-", *parts)).alias("customer_id"))
    return checks.run_checks(df, Contract("customer", (Clause("customer_id", format="uuid"),))).select(RESULT)


@query(_check_sql("customer.c_name.pattern", "pattern", "not regexp_matches(c_name, '^(?:Customer#0+[1-4])')", "customer"))
def check_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.run_checks(table(spark, sf_dir, "customer"), Contract("customer", (Clause("c_name", pattern="Customer#0+[1-4]"),))).select(RESULT)


_TIMES = "case event_id % 5 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' when 1 then strftime(ts, '%Y-%m') when 2 then strftime(ts, '%Y-%m-%d %H:%M') when 3 then '2026-13-45' else 'yesterday' end"


@query(_check_sql("events.recorded_at.datetime", "format", "event_id % 5 in (1, 3, 4)", "events"))
def check_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format("ts", "yyyy-MM")).when(k == 2, F.date_format("ts", "yyyy-MM-dd HH:mm")).when(k == 3, "2026-13-45").otherwise("yesterday")
    return checks.run_checks(table(spark, sf_dir, "events").select(text.alias("recorded_at")), Contract("events", (Clause("recorded_at", format="date-time"),))).select(RESULT)


@query(_check_sql("lineitem.l_quantity.range", "range", "l_quantity < 2 or l_quantity > 45", "lineitem"))
def check_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers kept as text are read as numbers."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("string").alias("l_quantity"))
    return checks.run_checks(df, Contract("lineitem", (Clause("l_quantity", minimum=2.0, maximum=45.0),))).select(RESULT)


@query(f"select 'events.event_type.range' as check_id, 'range' as check_type, 'ERROR' as status, 'CRITICAL' as severity, count(*) as records_failing, count(*) as records_total, {_percent('count(*)')} as failing_percent from events")
def check_range_non_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.run_checks(table(spark, sf_dir, "events"), Contract("events", (Clause("event_type", minimum=0.0),))).select(RESULT)


@query(
    """with b as (select avg(l_discount) as m, stddev_samp(l_discount) as s from lineitem),
    z as (select f, abs(avg(l_discount * f) - any_value(m)) / greatest(any_value(s), 1e-9) as z, count(*) as n from lineitem, b, (values (1.0), (2.5), (100.0)) v(f) group by f)
    select 'x' || cast(cast(f * 10 as int) as varchar) as dataset, case when z > 3 then 'FAIL' when z > 2 then 'WARN' else 'PASS' end as status,
      case when z > 3 then 'HIGH' when z > 2 then 'MEDIUM' else 'LOW' end as severity, case when z > 2 then n else 0 end as records_failing from z"""
)
def check_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts as they are, scaled a little, and scaled a hundredfold, against their own baseline."""
    df = table(spark, sf_dir, "lineitem").select("l_discount")
    base = {r["column"]: (r["mean"], r["stddev"]) for r in checks.numeric_baseline(df).collect()}
    parts = [
        checks.run_checks(df.select((F.col("l_discount") * f).alias("l_discount")), Contract(f"x{int(f * 10)}", (Clause("l_discount"),)), base).select(F.lit(f"x{int(f * 10)}").alias("dataset"), "status", "severity", "records_failing")
        for f in (1.0, 2.5, 100.0)
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    _union(
        *[
            f"select 'supplier.s_rating.{k}' as check_id, '{k}' as check_type, 'ERROR' as status, 'CRITICAL' as severity, 0 as records_failing, count(*) as records_total, 0.0::double as failing_percent from supplier"
            for k in ("required", "type", "enum", "date-time", "range", "drift")
        ]
    )
)
def check_missing_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    clause = Clause("s_rating", "number", True, format="date-time", enum=("1",), minimum=0.0)
    return checks.run_checks(table(spark, sf_dir, "supplier"), Contract("supplier", (clause,)), {"s_rating": (1.0, 1.0)}).select(RESULT)


def _decision_sql(mode: str, blocks: str) -> str:
    return f"""select '{mode}' as mode, count(*) as total_checks, count(*) filter (where status = 'PASS') as passed, count(*) filter (where status = 'FAIL') as failed, count(*) filter (where status = 'WARN') as warned,
      count(*) filter (where status = 'ERROR') as errored, count(*) filter (where {blocks}) as blocked, count(*) filter (where {blocks}) > 0 as blocking,
      case when '{mode}' = 'AUDIT' then 'ALLOW_WITH_AUDIT_TRAIL' when count(*) filter (where {blocks}) > 0 then 'BLOCK' when count(*) filter (where status <> 'PASS') > 0 then 'ALLOW_WITH_WARNINGS' else 'ALLOW' end as decision
      from ({_LINEITEM_SQL})"""


def _summary(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    results = checks.run_checks(table(spark, sf_dir, "lineitem"), LINEITEM)
    return policy.summarize(policy.decorate(results, mode), mode).withColumn("mode", F.lit(mode))


@query(_decision_sql("AUDIT", "false"))
def validate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, "AUDIT")


@query(_decision_sql("WARN", "status in ('FAIL', 'ERROR') and severity = 'CRITICAL'"))
def validate_warn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, "WARN")


@query(_decision_sql("ENFORCE", "status in ('FAIL', 'ERROR') and severity in ('CRITICAL', 'HIGH')"))
def validate_enforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, "ENFORCE")


@query(
    f"""select 'r1' as report_id, 'lineitem' as contract_id, split_part(check_id, '.', 2) as field, check_type, status, severity, 'BLOCK' as action, true as blocking, records_failing, records_total, failing_percent, check_id
    from ({_LINEITEM_SQL}) where status <> 'PASS'"""
)
def violations_append_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = policy.decorate(checks.run_checks(table(spark, sf_dir, "lineitem"), LINEITEM), "ENFORCE")
    rows = sinks.violation_rows(results, report_id="r1", contract_id="lineitem", snapshot_id="s1", run_timestamp="2026-01-01T00:00:00+00:00")
    return rows.select("report_id", "contract_id", "field", "check_type", "status", "severity", "action", "blocking", "records_failing", "records_total", "failing_percent", "check_id")


@query("select event_type, count(*) as n from events where try_cast(case when event_id % 9 = 0 then 'n/a' else cast(value as varchar) end as double) is null or value < 10 or value > 80 group by event_type")
def sql_test_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that isn't a number fails here."""
    df = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 9 == 0, "n/a").otherwise(F.col("value").cast("string")))
    return checks.sql_test_failures(df, "value", "between", min_value=10, max_value=80).groupBy("event_type").agg(F.count("*").alias("n"))


@query("select p_partkey, p_type from part where not regexp_full_match(p_type, 'S.*')")
def sql_test_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.sql_test_failures(table(spark, sf_dir, "part"), "p_type", "matches", regex="S").select("p_partkey", "p_type")


@query("select l_orderkey, count(*) as count from lineitem group by l_orderkey having count(*) > 1")
def sql_test_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.sql_test_failures(table(spark, sf_dir, "lineitem"), "l_orderkey", "unique")


@query("select o_orderkey from orders where o_orderpriority = '5-LOW'")
def sql_test_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("o_orderpriority", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")))
    return checks.sql_test_failures(df, "o_orderpriority", "not_null").select("o_orderkey")


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus not in ('F', 'O')")
def sql_test_accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.sql_test_failures(table(spark, sf_dir, "orders"), "o_orderstatus", "accepted_values", values=["F", "O"]).select("o_orderkey", "o_orderstatus")


# -- profiles and inference -----------------------------------------------------------------------------------

_NUMBERS = {"lineitem": ["l_quantity", "l_extendedprice", "l_discount"]}


@query(
    _union(
        *[
            f"""select '{c}' as "column", round(min({c}), 6) as observed_min, round(max({c}), 6) as observed_max, round(avg({c}), 6) as observed_mean, round(stddev_samp({c}), 6) as observed_stddev,
            round(quantile_cont({c}, 0.5), 6) as observed_p50, round(quantile_cont({c}, 0.95), 6) as observed_p95 from lineitem"""
            for c in _NUMBERS["lineitem"]
        ]
    )
)
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.numeric_profile(table(spark, sf_dir, "lineitem"), _NUMBERS["lineitem"])


@query("""select 'mean' as kind, "column", round(m, 6) as value from (select 's_acctbal' as "column", avg(s_acctbal) as m from supplier union all select 's_suppkey', avg(s_suppkey) from supplier union all select 's_nationkey', avg(s_nationkey) from supplier)
    union all select 'stddev', "column", round(m, 6) from (select 's_acctbal' as "column", stddev_samp(s_acctbal) as m from supplier union all select 's_suppkey', stddev_samp(s_suppkey) from supplier union all select 's_nationkey', stddev_samp(s_nationkey) from supplier)""")
def baseline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = checks.numeric_baseline(table(spark, sf_dir, "supplier"))
    return base.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col("column"), F.round(k, 6).alias("value")) for k in ("mean", "stddev")])))


_ORDER_COLUMNS = ("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(
    _union(
        *[
            f"""select '{c}' as "column", (select count(distinct {c}) from orders) as cardinality_estimate, (select list(v order by o) from (select cast({c} as varchar) as v, min(o_orderkey) as o from orders group by {c} order by o limit 5)) as sample_values,
            case when (select count(distinct {c}) from orders) <= 8 then (select list(distinct cast({c} as varchar) order by cast({c} as varchar)) from orders) end as enum_values"""
            for c in _ORDER_COLUMNS
        ]
    )
)
def profile_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cardinality, first samples and enum candidates of columns."""
    return profile.value_facts(profile.column_values(table(spark, sf_dir, "orders").select(*_ORDER_COLUMNS), "o_orderkey"))


@query(
    """with p as (select p_partkey, p_type, case when p_partkey % 4 = 0 then null else p_size end as p_size, strftime(timestamp '2026-01-01' + to_days(cast(p_size as int)), '%Y-%m-%dT%H:%M:%S') as created_at, p_size > 20 as large, p_retailprice from part),
    e as (select count(distinct p_type) as types, round(avg((p_size is null)::double), 6) as gaps from p)
    select 'p_partkey' as "column", 0 as ordinal, 'integer' as dtype, 0.0::double as null_fraction, true as required, null as format, null::int as enum_size from e
    union all select 'p_type', 1, 'string', 0.0, true, null, case when types <= 8 then types end from e
    union all select 'p_size', 2, 'number', gaps, gaps = 0, null, null from e
    union all select 'created_at', 3, 'string', 0.0, true, 'date-time', null from e
    union all select 'large', 4, 'boolean', 0.0, true, null, null from e
    union all select 'score_confidence', 5, 'number', 0.0, true, null, null from e"""
)
def infer_contract_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select(
        "p_partkey", "p_type", F.when(F.col("p_partkey") % 4 != 0, F.col("p_size")).alias("p_size"),
        F.date_format(F.expr("timestamp '2026-01-01' + make_interval(0, 0, 0, p_size)"), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), (F.col("p_size") > 20).alias("large"), F.col("p_retailprice").alias("score_confidence"),
    )
    return profile.clause_frame(df, "p_partkey").select("column", "ordinal", "dtype", "null_fraction", "required", "format", F.when(F.col("enum").isNotNull(), F.size("enum")).alias("enum_size"))


@query("""select 'lineitem.l_returnflag.enum' as check_id, (select string_agg(v, '|' order by k, v) from (select l_orderkey as k, l_returnflag as v from lineitem where l_returnflag not in ('A', 'N') order by k, v limit 5)) as samples
    union all select 'lineitem.l_discount.range', (select string_agg(v, '|' order by k, v) from (select l_orderkey as k, l_discount::varchar as v from lineitem where l_discount < 0 or l_discount > 0.05 order by k, v limit 5))""")
def failing_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five failing values of every failing check, from one more pass over the lines."""
    lines = table(spark, sf_dir, "lineitem")
    sampled = checks.with_samples(lines, LINEITEM, checks.run_checks(lines, LINEITEM), "l_orderkey")
    return sampled.where("status = 'FAIL'").select("check_id", F.array_join("sample_failing", "|").alias("samples"))


# -- flattening -------------------------------------------------------------------------------------------------


def _nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), F.struct(F.col("l_returnflag").alias("flag")).alias("state"))).alias("items"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    tags = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("a"), F.col("o_orderstatus"))).when(F.col("o_orderkey") % 3 == 1, F.array().cast("array<string>"))
    return orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", tags.alias("tags"), "items", F.array(F.struct(F.lit(1).alias("x"))).alias("marks"))


@query(
    """select o_orderkey, case o_orderkey % 3 when 0 then 2 when 1 then 0 end as tags_count, case when o_orderkey % 3 = 0 then 'a|' || o_orderstatus end as tags, 1 as marks_count,
    l_linenumber as fact_line, l_quantity as fact_quantity, l_returnflag as fact_state_flag from orders left join lineitem on l_orderkey = o_orderkey"""
)
def flatten_orders_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.flatten(_nested_orders(spark, sf_dir), "items")


@query("""select case when (select count(*) from lineitem join orders on l_orderkey = o_orderkey) > (select count(*) from orders) then 'items' else 'marks' end as repeated_field""")
def flatten_choose_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(flatten.choose_repeated_field(_nested_orders(spark, sf_dir)),)], "repeated_field string")


@query("select event_type, sum(cast(json_extract_string(props, '$.k') as bigint)) as total from events group by event_type")
def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("props"))
    return flatten.flatten(parsed).groupBy("event_type").agg(F.sum("props_k").alias("total"))


@query("select cast(l_shipdate as varchar) as d, replace(cast(l_shipdate as varchar), ' ', 'T') as iso, count(*) as n from lineitem group by 1, 2")
def model_iso_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("d"))
    return df.select("d", sinks.iso_column("d").alias("iso")).groupBy("d", "iso").agg(F.count("*").alias("n"))


# -- traces, prompts, verdicts ----------------------------------------------------------------------------------

_RUN_TYPE = "case event_type when 'click' then ' prompt' when 'view' then 'parser' when 'purchase' then 'llm' when 'signup' then 'tool' else 'agent' end"


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    kind = F.when(t == "click", " prompt").when(t == "view", "parser").when(t == "purchase", "llm").when(t == "signup", "tool").otherwise("agent")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), kind.alias("run_type"), F.create_map().cast("map<string,string>").alias("metadata"), F.col("ts").alias("start_time"),
        F.when(F.col("event_id") % 10 == 0, F.col("ts")).otherwise(F.col("ts") + F.expr("interval 1 second")).alias("end_time"), (F.col("event_id") % 50).alias("prompt_tokens"),
        F.lit(None).cast("long").alias("completion_tokens"), (F.col("event_id") % 40).alias("total_tokens"),
    )


@query(f"""select case trim(t) when 'prompt' then 'chain' when 'parser' then 'tool' else trim(t) end as run_type, trim(t) as original, case trim(t) when 'prompt' then 'prompt_assembly' when 'parser' then 'output_parsing' end as role, count(*) as n
    from (select {_RUN_TYPE} as t from events) group by 1, 2, 3""")
def trace_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = traces.canonicalize(_traces(spark, sf_dir))
    return c.groupBy("run_type", F.col("metadata")["original_run_type"].alias("original"), F.col("metadata")["span_role"].alias("role")).agg(F.count("*").alias("n"))


@query(f"""select 'trace_contract_violation_rate' as metric, count(*) as checked, count(*) filter (where t = 'agent') as failing, round(count(*) filter (where t = 'agent') / count(*), 6) as value,
    case when count(*) filter (where t = 'agent') / count(*) > 0.12 then 'FAIL' when count(*) filter (where t = 'agent') / count(*) > 0.05 then 'WARN' else 'PASS' end as status,
    case when count(*) filter (where t = 'agent') / count(*) > 0.12 then 'HIGH' when count(*) filter (where t = 'agent') / count(*) > 0.05 then 'MEDIUM' else 'LOW' end as severity,
    count(*) filter (where event_id % 10 = 0) as duration_failures, count(*) filter (where event_id % 40 < event_id % 50) as token_failures from (select event_id, {_RUN_TYPE} as t from events)""")
def trace_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.trace_metric(traces.canonicalize(_traces(spark, sf_dir)))


@query("""select 'prompt_input_schema_violation_rate' as metric, count(*) as checked, count(*) filter (where bad) as failing, round(count(*) filter (where bad) / count(*), 6) as value,
    case when count(*) filter (where bad) / count(*) > 0.08 then 'FAIL' when count(*) filter (where bad) / count(*) > 0.02 then 'WARN' else 'PASS' end as status,
    case when count(*) filter (where bad) / count(*) > 0.08 then 'HIGH' when count(*) filter (where bad) / count(*) > 0.02 then 'MEDIUM' else 'LOW' end as severity
    from (select case conv_id % 3 when 0 then turn < 1 or length(trim(text)) < 20 when 1 then length(trim(text)) < 20 else true end as bad from conversations)""")
def prompt_family_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as prompt inputs of two families and of no family."""
    quoted = lambda c: F.regexp_replace(F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{"v":', ""), r"\}$", "")
    k = F.col("conv_id") % 3
    page = F.create_map(F.lit("document_id"), quoted(F.col("conv_id").cast("string")), F.lit("page"), F.col("turn").cast("string"), F.lit("section"), quoted(F.col("role")), F.lit("text"), quoted(F.col("text")))
    section = F.create_map(F.lit("numeric_dense"), F.lit("true"), F.lit("section_text"), quoted(F.col("text")), F.lit("section_title"), quoted(F.col("role")))
    other = F.create_map(F.lit("text"), quoted(F.col("text")))
    df = table(spark, sf_dir, "conversations").select(F.lit("prompt").alias("run_type"), F.create_map().cast("map<string,string>").alias("metadata"), F.when(k == 0, page).when(k == 1, section).otherwise(other).alias("inputs"))
    return traces.prompt_metric(df)


@query("""select problem, count(*) as n from (select unnest(list_concat(list_concat(case when doc_id % 5 = 0 then ['missing:rubric_id'] else [] end, case when doc_id % 7 = 0 then ['invalid:overall_verdict'] else [] end),
    list_concat(case when doc_id % 4 = 0 then ['range:confidence'] else [] end, case when quality = 0 then ['shape:scores.clarity'] else [] end))) as problem from labels) group by problem""")
def verdict_problem_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    score = F.struct(F.lit(0.5).alias("score"), F.when(F.col("quality") == 1, "seen").alias("evidence"), F.lit("none").alias("notes"))
    df = table(spark, sf_dir, "labels").select(
        i.cast("string").alias("verdict_id"), F.lit("t").alias("target_ref"), F.when(i % 5 != 0, "r").alias("rubric_id"), F.lit("1").alias("rubric_version"), F.create_map(F.lit("clarity"), score).alias("scores"),
        F.when(i % 7 == 0, "MAYBE").otherwise("PASS").alias("overall_verdict"), F.lit(0.5).alias("overall_score"), F.when(i % 4 == 0, 1.5).otherwise(0.5).alias("confidence"), F.lit("2026-01-01").alias("evaluated_at"),
    )
    return df.select(F.explode(traces.verdict_problems(df)).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


# -- registry -------------------------------------------------------------------------------------------------

SUBSCRIPTIONS = [
    {"contract_id": "Lineitem ", "subscriber_id": "billing", "fields_consumed": ["l_discount"], "breaking_fields": [{"field": "l_extendedprice", "reason": "sums"}], "contact": {"owner": "Billing", "role": "team", "email": "owner@example.com"}},
    {"contract_id": "lineitem", "subscriber_id": "returns", "fields_consumed": ["L ReturnFlag"], "breaking_fields": [], "validation_mode": "ENFORCE", "contact": {"owner": "Returns", "role": "", "email": None}},
    {"contract_id": "documents", "subscriber_id": "search", "fields_consumed": ["extracted_facts[].confidence"], "breaking_fields": []},
]
_SUBSCRIPTION_VALUES = """(values ('lineitem', 'billing', ['l_discount', 'l_extendedprice'], 'AUDIT', 'Billing | team | owner@example.com'), ('lineitem', 'returns', ['l_returnflag'], 'ENFORCE', 'Returns'),
    ('documents', 'search', ['extracted_facts_confidence', 'fact_confidence'], 'AUDIT', '')) s(contract_id, subscriber_id, aliases, validation_mode, contact_summary)"""


def _subscriptions(spark: SparkSession) -> DataFrame:
    return registry.subscriptions_frame(spark, {"subscriptions": SUBSCRIPTIONS})


def _failing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of failed checks of lineitem, and one of documents."""
    failed = checks.run_checks(table(spark, sf_dir, "lineitem"), LINEITEM).where("status = 'FAIL'").select(F.lit("lineitem").alias("contract_id"), F.col("column_name").alias("field"))
    more = spark.createDataFrame([("documents", "fact_confidence"), ("lineitem", "l_tax"), ("nothing", "x")], "contract_id string, field string")
    return failed.union(more)


_FIELDS_SQL = f"""(select 'lineitem' as contract_id, split_part(check_id, '.', 2) as field from ({_LINEITEM_SQL}) where status = 'FAIL' union all select * from (values ('documents', 'fact_confidence'), ('lineitem', 'l_tax'), ('nothing', 'x')))"""


@query(f"select f.contract_id, f.field, s.subscriber_id from {_FIELDS_SQL} f join {_SUBSCRIPTION_VALUES} on f.contract_id = s.contract_id and list_contains(s.aliases, f.field)")
def registry_field_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.field_matches(_subscriptions(spark), _failing_fields(spark, sf_dir))


_BLAST_SQL = f"""select contract_id, field, subscriber_id, validation_mode, contact_summary, case when best then 'field_match' else 'contract_fallback' end as match_type from (
    select f.contract_id, f.field, s.subscriber_id, s.validation_mode, s.contact_summary, list_contains(s.aliases, f.field) as hit, bool_or(list_contains(s.aliases, f.field)) over (partition by f.contract_id, f.field) as best
    from {_FIELDS_SQL} f join {_SUBSCRIPTION_VALUES} on f.contract_id = s.contract_id) where hit or not best"""


@query(_BLAST_SQL)
def blast_radius_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.blast_radius(_subscriptions(spark), _failing_fields(spark, sf_dir))


@query(
    f"""select f.contract_id, f.field, count(b.subscriber_id) as subscriber_count, coalesce(max(b.match_type) = 'field_match', false) as matched_on_field,
    case when coalesce(max(b.match_type) = 'field_match', false) then 'high' when count(b.subscriber_id) > 0 then 'medium' else 'low' end as confidence from {_FIELDS_SQL} f left join ({_BLAST_SQL}) b using (contract_id, field) group by f.contract_id, f.field"""
)
def blast_radius_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.blast_summary(_subscriptions(spark), _failing_fields(spark, sf_dir)).drop("summary")


# -- schema evolution -----------------------------------------------------------------------------------------

#: A contract for each supplier, a clause for each line number; the version before is seen on even orders, the present one on odd ones.
_VERSION = {"before": "l_orderkey % 2 = 0 and not (l_linenumber = 2 and l_suppkey % 3 = 0)", "now": "l_orderkey % 2 = 1 and not (l_linenumber = 5 and l_suppkey % 4 = 0)"}


def _version(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """The clauses that the lines of a version suggest; the seventh is a confidence in percent where quantities are large."""
    seen = table(spark, sf_dir, "lineitem").where(_VERSION[which])
    seventh, large = F.col("l_linenumber") == 7, F.max("l_quantity") > 49
    grouped = seen.groupBy("l_suppkey", "l_linenumber").agg(
        F.when(large, "number").otherwise("integer").alias("type"), (F.count_if(F.col("l_returnflag") == "R") < 10).alias("required"), F.array_sort(F.collect_set(F.when(F.col("l_discount") > 0.09, F.col("l_returnflag")))).alias("enum"),
        F.min("l_quantity").cast("double").alias("minimum"), F.when(F.first(seventh), F.when(large, 100.0).otherwise(1.0)).otherwise(F.max("l_discount").cast("double")).alias("maximum"),
    )
    name = F.when(seventh, F.concat(F.lit("confidence_"), F.col("l_linenumber").cast("string"))).otherwise(F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")))
    return grouped.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("contract_id"), name.alias("column_name"), "type", "required", F.when(F.size("enum") > 0, F.col("enum")).alias("enum"), "minimum", "maximum", F.lit("").alias("description"))


def _supplier_subscriptions(spark: SparkSession, sf_dir: str, to_the_letter: bool = False) -> DataFrame:
    """Two subscriptions of each supplier's contract but every fifth: its nation reads one line, and a service names another as breaking."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0")
    own = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    line = F.concat(F.lit("line_"), (F.col("s_suppkey") % 6 + 1).cast("string"))
    reader = F.struct(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("subscriber_id"), F.array(line).alias("fields_consumed"), F.array().alias("breaking_fields"))
    service = F.struct(F.lit("service").alias("subscriber_id"), F.array().alias("fields_consumed"), F.array(F.struct(F.lit("Confidence 7").alias("field"), F.lit("sums").alias("reason"))).alias("breaking_fields"))
    types = dict(part.split(" ", 1) for part in ("subscriber_id string", "fields_consumed array<string>", "breaking_fields array<struct<field: string, reason: string>>"))
    shape = f"struct<{', '.join(f'{k}: {v}' for k, v in types.items())}>"
    rows = s.select((own if to_the_letter else F.concat(F.upper(own), F.lit(" "))).alias("contract_id"), F.inline(F.array(reader.cast(shape), service.cast(shape))))
    more = {"validation_mode": F.lit("AUDIT"), "registered_at": F.lit(None).cast("string"), "contact": F.struct(F.lit("team").alias("owner"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("email"))}
    return rows.withColumns(more)


def _version_sql(which: str) -> str:
    return f"""select 's' || l_suppkey as contract_id, case when l_linenumber = 7 then 'confidence_7' else 'line_' || l_linenumber end as field, case when max(l_quantity) > 49 then 'number' else 'integer' end as type, count(*) filter (where l_returnflag = 'R') < 10 as required,
      coalesce(list(distinct l_returnflag order by l_returnflag) filter (where l_discount > 0.09), []) as enum, min(l_quantity)::double as least, case when l_linenumber = 7 then case when max(l_quantity) > 49 then 100.0 else 1.0 end else max(l_discount) end::double as most
      from lineitem where {_VERSION[which]} group by l_suppkey, l_linenumber"""


_CHANGES_SQL = f"""b as ({_version_sql("before")}), a as ({_version_sql("now")}),
    j as (select coalesce(b.contract_id, a.contract_id) as contract_id, coalesce(b.field, a.field) as field, b.field is not null as had, a.field is not null as has, b.type as bt, a.type as nt, b.required as br, a.required as ar, b.enum as be, a.enum as ae, b.least as bl, a.least as al, b.most as bm, a.most as am from b full join a on a.contract_id = b.contract_id and a.field = b.field),
    c as (select contract_id, field, 'field_removed' as change_type, 'breaking' as classification from j where had and not has
      union all select contract_id, field, 'field_added', 'backward-compatible' from j where has and not had
      union all select contract_id, field, 'type_changed', 'breaking' from j where had and has and bt <> nt
      union all select contract_id, field, 'nullability_changed', case when ar then 'breaking' else 'backward-compatible' end from j where had and has and br <> ar
      union all select contract_id, field, 'enum_changed', case when list_has_all(ae, be) then 'backward-compatible' else 'breaking' end from j where had and has and be <> ae
      union all select contract_id, field, 'range_changed', case when (field like '%confidence%' and bm = 1.0 and am > 1.0) or al > bl or am < bm then 'breaking' else 'backward-compatible' end from j where had and has and (bl <> al or bm <> am)),
    u as (select 's' || s_suppkey as contract_id, 'n' || s_nationkey as subscriber_id, 'line_' || (s_suppkey % 6 + 1) as field from supplier where s_suppkey % 5 <> 0 union all select 's' || s_suppkey, 'service', 'confidence_7' from supplier where s_suppkey % 5 <> 0),
    i as (select c.*, list(distinct u.subscriber_id order by u.subscriber_id) filter (where u.field = c.field) as named, list(distinct u.subscriber_id order by u.subscriber_id) filter (where u.subscriber_id is not null) as every from c left join u on u.contract_id = c.contract_id group by all),
    k as (select contract_id, field, change_type, classification, named is not null as matched, coalesce(named, every, []) as hit from i)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolution.compare_clauses(_version(spark, sf_dir, "before"), _version(spark, sf_dir, "now"))


@query(f"with {_CHANGES_SQL} select contract_id, field, change_type, classification from c")
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("contract_id", "field", "change_type", "classification")


@query(f"""with {_CHANGES_SQL} select contract_id, field, change_type, case when classification = 'breaking' and matched then 'HIGH' when classification = 'breaking' and len(hit) > 0 then 'MEDIUM' when classification = 'breaking' or len(hit) > 0 then 'LOW' else 'NONE' end as impact_level,
    array_to_string(hit, '|') as affected, matched as matched_field_subscriptions from k""")
def schema_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = registry.change_impact(_supplier_subscriptions(spark, sf_dir), _changes(spark, sf_dir))
    return found.select("contract_id", "field", "change_type", "impact_level", F.array_join(F.array_sort(F.transform("affected_consumers", lambda c: c["subscriber_id"])), "|").alias("affected"), "matched_field_subscriptions")


@query(f"""with {_CHANGES_SQL} select count(*) as total_changes, count(*) filter (where classification = 'breaking') as breaking_changes, count(*) filter (where classification <> 'breaking') as backward_compatible_changes,
    (select string_agg(s, '|' order by s) from (select distinct unnest(hit) as s from k)) as impacted, case when bool_or(classification = 'breaking' and len(hit) > 0) then 'FAIL' when bool_or(classification = 'breaking') then 'WARN' else 'PASS' end as decision,
    bool_or(classification = 'breaking' and len(hit) > 0) as ci_gate_blocking from k""")
def schema_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolution.gate(registry.change_impact(_supplier_subscriptions(spark, sf_dir), _changes(spark, sf_dir))).withColumn("impacted", F.array_join("impacted_systems", "|")).drop("impacted_systems")


@query("select 's' || s_suppkey as wanted_contract, unnest(['n' || s_nationkey, 'service']) as subscriber_id from supplier where s_suppkey % 5 <> 0 and s_suppkey in (select l_suppkey from lineitem)")
def registry_contract_subs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("contract_id")).distinct()
    return registry.contract_subscriptions(_supplier_subscriptions(spark, sf_dir), wanted).select("wanted_contract", "subscriber_id")


@query()
def schema_rename_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of parts as fields: those of even sizes before, those of odd sizes, with a version in their names, after."""
    parts = table(spark, sf_dir, "part").groupBy(F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")).alias("name")).agg(F.bool_or(F.col("p_size") % 2 == 0).alias("even"), F.bool_or(F.col("p_size") % 2 == 1).alias("odd"))
    kinds = parts.collect()  # the fields of a schema
    old = [Clause(r.name, "string", True, description="before") for r in kinds if r.even]
    new = [Clause(f"{r.name}_v2", "string", True, description="after") for r in kinds if r.odd]
    return spark.createDataFrame(evolution.renames(old, new), "old string, new string, score double")


# -- lineage ----------------------------------------------------------------------------------------------------


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, customer, order as a graph of keys."""
    edge = lambda df, a, b: df.select(a.alias("source"), b.alias("target"), F.lit("HAS").alias("relationship"))
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, c, o = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return edge(n, k("r", "n_regionkey"), k("n", "n_nationkey")).union(edge(c, k("n", "c_nationkey"), k("c", "c_custkey"))).union(edge(o, k("c", "o_custkey"), k("o", "o_orderkey")))


_GRAPH_SQL = """g(source, target) as (select 'r' || n_regionkey, 'n' || n_nationkey from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer union all select 'c' || o_custkey, 'o' || o_orderkey from orders)"""


def _walk_sql(seeds: str, start: str, end: str) -> str:
    return f"""with recursive {_GRAPH_SQL}, r(node_id, distance) as (select * from (values {seeds}) union all select g.{end}, r.distance + 1 from r join g on g.{start} = r.node_id where r.distance < 10)
    select node_id, min(distance)::int as distance from r group by node_id having min(distance) > 0"""


@query(_walk_sql("('r1', 0), ('r2', 0)", "source", "target"))
def lineage_bfs_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.walk(_graph(spark, sf_dir), spark.createDataFrame([("r1",), ("r2",)], "node_id string")).select("node_id", "distance")


@query(_walk_sql("('o1', 0), ('o5', 0), ('o33', 0)", "target", "source"))
def lineage_bfs_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.walk(_graph(spark, sf_dir), spark.createDataFrame([("o1",), ("o5",), ("o33",)], "node_id string"), "upstream").select("node_id", "distance")


@query("""select node_id, score from (select p_name as node_id, min((case when contains(lower(p_name || ' ' || p_type), 'small') then 5 else 0 end) + (case when contains(lower(p_name || ' ' || p_type), 'plate') then 2 else 0 end) +
    (case when contains(lower(p_name || ' ' || p_type), '7') then 2 else 0 end))::int as score from part group by p_name) where score > 0 order by score desc, node_id limit 8""")
def lineage_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_type").alias("label")).select(F.col("p_name").alias("node_id"), F.lit("part").alias("node_type"), "label", F.create_map().cast("map<string,string>").alias("metadata"))
    return lineage.score_seeds(nodes, lineage.field_tokens("small"), lineage.context_tokens("plate-7")).select("node_id", F.col("score").cast("int").alias("score"))


@query("""select 'n' || n_nationkey as id, n_name as label, 'HAS' as relationship from nation where n_regionkey in (1, 3)""")
def lineage_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id"), F.col("n_name").alias("label"))
    return lineage.downstream_consumers(nodes, _graph(spark, sf_dir).where("source like 'r%'"), ["r1", "r3"], ["n_name"]).select("id", "label", "relationship")


@query("""select ord, case when s > 0 then 'matched-root' else 'fallback-last' end as label from (select r_regionkey as ord, max(case when lower(r_name) = 'asia' then 100 when starts_with(lower(r_name), 'asia') then 90 when contains(lower(r_name), 'a') then 70 else 0 end) as s
    from region group by r_regionkey order by s desc, ord limit 1)""")
def lineage_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("ord"), F.col("r_name").alias("codebase_root"), F.lit("").alias("haystack"))
    return lineage.select_snapshot(snapshots, spark.createDataFrame([("ASIA", "a")], "root string, name string"))


# -- texts and vectors -----------------------------------------------------------------------------------------


@query("select token, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from documents) group by token")
def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_drift.token_counts(table(spark, sf_dir, "documents"))


@query("""with t as (select role, token, count(*) as n from (select role, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from conversations) group by role, token)
    select token, before, after, abs(after - before) as shift from (select coalesce(a.token, b.token) as token, coalesce(a.n, 0) as before, coalesce(b.n, 0) as after from (select * from t where role = 'user') a full join (select * from t where role = 'assistant') b on a.token = b.token)
    where before <> after order by shift desc, token desc limit 8""")
def top_shifted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return text_drift.top_shifted(text_drift.token_counts(c.where("role = 'user'")), text_drift.token_counts(c.where("role = 'assistant'")))


_HASHED_SQL = """h as (select doc_id, ('0x' || right(sha256(token), 2))::int % 128 as bucket, count(*) as n from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from documents) group by 1, 2),
    v as (select doc_id, bucket, n / sqrt(sum(n * n) over (partition by doc_id)) as weight from h)"""


@query(f"with {_HASHED_SQL} select doc_id, bucket, round(weight, 6) as weight from v")
def hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_drift.hashed_vectors(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query(f"with {_HASHED_SQL} select b.bucket::int as bucket, round(coalesce(sum(weight), 0) / (select count(*) from documents), 6) as weight from (select unnest(range(128)) as bucket) b left join v on v.bucket = b.bucket group by b.bucket")
def text_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_drift.text_centroid(table(spark, sf_dir, "documents"), "doc_id").select("bucket", F.round("weight", 6).alias("weight"))


@query(f"""with {_HASHED_SQL}, l as (select v.*, d.lang from v join documents d using (doc_id)), c as (select lang, bucket, sum(weight) / (select count(*) from documents d where d.lang = l.lang) as w from l where lang in ('en', 'de') group by lang, bucket),
    p as (select b.bucket, coalesce(max(w) filter (where lang = 'en'), 0) as e, coalesce(max(w) filter (where lang = 'de'), 0) as d from (select unnest(range(128)) as bucket) b left join c on c.bucket = b.bucket group by b.bucket)
    select round(1 - sum(e * d) / (sqrt(sum(e * e)) * sqrt(sum(d * d))), 6) as distance, case when round(1 - sum(e * d) / (sqrt(sum(e * e)) * sqrt(sum(d * d))), 6) > 0.35 then 'FAIL' when round(1 - sum(e * d) / (sqrt(sum(e * e)) * sqrt(sum(d * d))), 6) > 0.18 then 'WARN' else 'PASS' end as status from p""")
def text_drift_between_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return text_drift.drift(text_drift.text_centroid(d.where("lang = 'en'"), "doc_id"), text_drift.text_centroid(d.where("lang = 'de'"), "doc_id")).select("distance", "status")


@query("select label, pos::int as pos, round(avg(x), 6) as value from (select label, unnest(range(64)) as pos, unnest(embedding)::double as x from embeddings) group by label, pos")
def vector_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_drift.vector_centroid(table(spark, sf_dir, "embeddings"), "embedding", "label").withColumn("value", F.round("value", 6))


@query("""with c as (select label, pos, avg(x) as m from (select label, unnest(range(64)) as pos, unnest(embedding)::double as x from embeddings) group by label, pos)
    select a.label as label, b.label as other, round(least(greatest(1 - sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))), 0), 1), 6) as distance from c a join c b on a.pos = b.pos and a.label < b.label group by a.label, b.label""")
def vector_cosine_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text_drift.as_array(text_drift.vector_centroid(table(spark, sf_dir, "embeddings"), "embedding", "label"), "label")
    pairs = c.alias("a").join(F.broadcast(c.alias("b")), F.col("a.label") < F.col("b.label"))  # a row a label
    return pairs.select(F.col("a.label").alias("label"), F.col("b.label").alias("other"), F.round(V.cosine_distance(F.col("a.centroid"), F.col("b.centroid")), 6).alias("distance"))



@query("""with n as (select event_id, ts, row_number() over (order by ts, event_id) - 1 as number, count(*) over () as total from (select event_id, ts + to_microseconds(event_id) as ts from events)),
    h as (select *, case when number < greatest(total // 2, 1) then 'first' else 'second' end as half from n)
    select half, count(*) as events, min(event_id) as least, max(event_id) as most, epoch_us(min(ts)) as began, epoch_us(max(ts)) as ended from h group by half""")
def midpoint_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are split at the middle of their times, which a microsecond for each id tells apart."""
    events = table(spark, sf_dir, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id")).alias("at"))
    told = lambda half, name: half.agg(F.lit(name).alias("half"), F.count("*").alias("events"), F.min("event_id").alias("least"), F.max("event_id").alias("most"), F.min("at").alias("began"), F.max("at").alias("ended"))
    first, second = text_drift.midpoint_windows(events, "at")
    return told(first, "first").union(told(second, "second"))


# -- attribution ----------------------------------------------------------------------------------------------------


@query("""select path, score, token_hits from (select 'src/' || source || '/' || doc_id || '.py' as path,
    (case when contains(lower(text), 'the') then 1 else 0 end) + (case when contains(lower(text), 'shthe') then 1 else 0 end) + (case when contains(lower(text), 'ingly') then 1 else 0 end) as token_hits,
    round(least(0.45, 0.08 * ((case when contains(lower(text), 'the') then 1 else 0 end) + (case when contains(lower(text), 'shthe') then 1 else 0 end) + (case when contains(lower(text), 'ingly') then 1 else 0 end))), 3) as score from documents)
    where score > 0.15 order by score desc, token_hits desc, path limit 5""")
def file_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.col("text").alias("content"))
    return attribution.candidate_files(files, ["ingly", "shthe", "the"])


_LINES_SQL = """l as (select doc_id, generate_subscripts(s, 1) as ln, unnest(s) as line, len(s) as n from (select doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) as s from documents where length(text) > 0)),
    m as (select *, ln - lag(ln) over (partition by doc_id order by ln) > 3 as gap from l where contains(line, 'the')), i as (select *, sum(case when gap then 1 else 0 end) over (partition by doc_id order by ln) as k from m)"""


@query(f"""with {_LINES_SQL} select doc_id::varchar as path, (k + 1)::int as place, greatest(1, min(ln) - 1)::int as first, least(any_value(n), max(ln) + 1)::int as last from i where k < 3 group by doc_id, k
    union all select doc_id::varchar, 1, 1, least(any_value(n), 20)::int from l where doc_id not in (select doc_id from m) group by doc_id""")
def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return attribution.line_ranges(files, ["the"])


@query("""with b as (select 'f' || (o_custkey % 20) as file_path, 'c' || (o_orderkey % 50) as commit_hash, count(*) as line_hits from orders group by 1, 2), best as (select file_path, max(row(line_hits, commit_hash)) as b from b group by file_path),
    s as (select k.check_id, file_path, b[2] as commit_hash, b[1] as line_blame_hits, k.score, round(k.score * 0.55 + 0.2 + 0.08 + least(0.08, b[1] * 0.005), 3) as confidence_score from best, (values ('x', 0.5), ('y', 0.9)) k(check_id, score))
    select check_id, rank, file_path, commit_hash, confidence_score, line_blame_hits from (select *, row_number() over (partition by check_id order by confidence_score desc, line_blame_hits desc, file_path)::int as rank from s) where rank <= 5""")
def blame_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    file_path = F.concat(F.lit("f"), (F.col("o_custkey") % 20).cast("string"))
    lines = o.select(file_path.alias("file_path"), F.concat(F.lit("c"), (F.col("o_orderkey") % 50).cast("string")).alias("commit_hash"), *[F.lit("x").alias(c) for c in ("author", "email", "commit_ts", "summary")])
    recent = o.select(file_path.alias("file_path")).distinct().select("file_path", F.lit("c0").alias("commit_hash"), F.lit("2026").alias("commit_ts"))
    failures = spark.createDataFrame([("x", 0.5), ("y", 0.9)], "check_id string, score double")
    candidates = failures.join(lines.select(F.col("file_path").alias("path")).distinct())
    return attribution.rank_candidates(failures.drop("score"), candidates, attribution.blame_counts(lines), recent).select("check_id", "rank", "file_path", "commit_hash", "confidence_score", "line_blame_hits")


@query("select 'f' || (o_orderkey % 3) as file_path, lpad((o_custkey % 40)::varchar, 40, '0') as commit_hash, count(*) as line_hits, lpad((o_custkey % 40)::varchar, 40, '0') || ' said it' as summary from orders group by 1, 2, 4")
def blame_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries of blame output in three files; a commit's first entry tells what it is about, the others go by that."""
    commit = F.lpad((F.col("o_custkey") % 40).cast("string"), 40, "0")
    tells = F.row_number().over(Window.partitionBy(commit).orderBy(F.col("o_orderkey") % 3, "o_orderkey")) == 1
    entry = F.array(F.concat(commit, F.lit(" 1 1 1")), F.when(tells, F.concat(F.lit("summary "), commit, F.lit(" said it"))), F.lit("\tcode"))
    lines = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), (F.col("o_orderkey") % 3).cast("string")).alias("file_path"), "o_orderkey", entry.alias("entry"))
    lines = lines.select("file_path", "o_orderkey", F.posexplode("entry").alias("k", "line")).where("line is not null")
    return attribution.blame_counts(attribution.parse_blame(lines.select("file_path", (F.col("o_orderkey") * 3 + F.col("k")).alias("ord"), "line"))).select("file_path", "commit_hash", "line_hits", "summary")


@query("select sha256(text) as sha, min(doc_id) as doc_id, count(*) as copies from documents group by 1")
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("sha", F.sha2("text", 256))
    first = health.keep_first(d.select("sha", "doc_id"), "sha", "doc_id")
    return first.join(d.groupBy("sha").agg(F.count("*").alias("copies")), "sha")


# -- health and dashboard -----------------------------------------------------------------------------------------


@query(f"""select count(*) filter (where status = 'PASS') as passed, count(*) as total_checks, round_even(35.0 * count(*) filter (where status = 'PASS') / count(*), 2)::double as baseline_validation,
    round_even(round_even(35.0 * count(*) filter (where status = 'PASS') / count(*), 2) + 16 + 15 + 12 + 10, 0)::int as health_score from ({_LINEITEM_SQL})""")
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = checks.run_checks(table(spark, sf_dir, "lineitem"), LINEITEM).agg(F.count_if(F.col("status") == "PASS").alias("passed"), F.count("*").alias("total_checks"))
    state = passed.withColumns({"ai_score": F.lit(0.8), "subscriber_count": F.lit(2), "lineage_confidence": F.lit("high"), "evolution_decision": F.lit("PASS"), "least_snapshots": F.lit(1)})
    return health.health_scores(state).select("passed", "total_checks", "baseline_validation", "health_score")


@query("select text, ord from (select o_orderpriority as text, min(o_orderkey) as ord from orders group by 1) order by ord limit 3")
def recommendations_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.recommendations(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("text"), F.col("o_orderkey").alias("ord")))


@query("select case when event_type = 'error' then 'UNKNOWN' else upper(event_type) end as severity, count(*) as n from events group by 1")
def dash_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.severity_counts(table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "error", F.col("event_type")).alias("severity")))


@query("""select source_kind, count(*) as n from (select case when l.doc_id is null then 'Unknown' when toxic = 1 then 'Injected test' else 'Real finding' end as source_kind from documents d left join labels l using (doc_id)) group by 1""")
def dash_violation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("report_id"), F.when(F.col("toxic") == 1, "Injected_run.json").otherwise("run.json").alias("file_name"))
    violations = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("report_id"))
    return dashboard.violations_with_source(violations, reports).groupBy("source_kind").agg(F.count("*").alias("n"))


@query("select sum(l_linenumber)::bigint as failed, count(*) filter (where l_returnflag = 'R') as blocking, count(*) filter (where l_linenumber = 0) as clean from lineitem")
def dash_report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.report_totals(table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("failed"), (F.col("l_returnflag") == "R").alias("blocking")))


@query(f"""with v as ({_version_sql("before")}) select contract_id, count(*) as clause_count, string_agg(field, '|' order by field) as risky, case when substr(contract_id, 2)::int % 5 <> 0 then 2 else 0 end as subscriber_count from v group by contract_id""")
def dash_risky_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids have to be equal to the letter here; all fields have bounds, so all are risky."""
    overview = dashboard.contract_overview(_version(spark, sf_dir, "before"), _supplier_subscriptions(spark, sf_dir, to_the_letter=True))
    return overview.select("contract_id", "clause_count", F.array_join("risky_fields", "|").alias("risky"), "subscriber_count")


@query("""select c_custkey, case when length(c_name) <= 12 then c_name else substr(c_name, 1, 4) || '...' || right(c_name, 4) end as middle, substr(md5(c_name), 1, 8) as hash,
    case when c_mktsegment in ('MACHINERY') then 'neutral' else 'neutral' end as tone, format('{:,}', c_custkey) as number from customer""")
def dash_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", V.truncated_middle(F.col("c_name"), 12).alias("middle"), V.short_hash(F.md5("c_name")).alias("hash"), V.severity_tone(F.col("c_mktsegment")).alias("tone"), V.formatted_number(F.col("c_custkey")).alias("number")
    )


@query("select 'ERROR' as status, 'CRITICAL' as severity, count(l_returnflag) as records_failing from lineitem")
def check_drift_non_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of letters against a numeric baseline."""
    found = checks.run_checks(table(spark, sf_dir, "lineitem").select("l_returnflag"), Contract("x", (Clause("l_returnflag"),)), {"l_returnflag": (1.0, 0.5)})
    return found.where("check_type = 'drift'").select("status", "severity", "records_failing")


# -- more of traces -------------------------------------------------------------------------------------------------


@query("""select family, count(*) as n, count(*) filter (where ok) as valid from (select
    case conv_id % 4 when 0 then 'document_page_text' when 1 then 'section_prompt' when 2 then 'task_prompt' else 'unrecognized_prompt_shape' end as family,
    case conv_id % 4 when 0 then turn >= 1 and length(trim(text)) >= 20 when 1 then length(trim(text)) >= 20
      when 2 then length(trim(text)) >= 20 and length(role || ' speaks') >= 10 and 60 >= length(text) * 0.5 and turn % 3 <> 0 else false end as ok from conversations) group by family""")
def prompt_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as prompt inputs of each family: how many there are of each, and how many are valid."""
    quoted = lambda c: F.regexp_replace(F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{"v":', ""), r"\}$", "")
    as_map = lambda **values: F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    k, text, role = F.col("conv_id") % 4, quoted(F.col("text")), quoted(F.col("role"))
    page = as_map(document_id=quoted(F.col("conv_id").cast("string")), page=F.col("turn").cast("string"), section=role, text=text)
    section = as_map(numeric_dense=F.lit("1"), section_text=text, section_title=role)
    system = F.concat("role", F.lit(" speaks"))
    in_json = F.when(F.col("turn") % 3 != 0, "true").otherwise('"true"')
    task = as_map(task=role, prompt=text, system=quoted(system), prompt_chars=F.lit("60"), system_chars=F.length(system).cast("string"), format_json=in_json)
    df = table(spark, sf_dir, "conversations").select(F.when(k == 0, page).when(k == 1, section).when(k == 2, task).otherwise(as_map(text=text)).alias("inputs"))
    valid = df.where(traces.prompt_family(F.col("inputs"))["valid"])
    joined = traces.family_counts(df).join(traces.family_counts(valid).withColumnRenamed("n", "valid"), "family", "left")
    return joined.select("family", "n", F.coalesce("valid", F.lit(0)).alias("valid"))


@query(f"select trim(t) as run_type, count(*) as n from (select {_RUN_TYPE} as t from events) where trim(t) in ('prompt', 'parser') group by 1")
def trace_normalizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.normalization_counts(_traces(spark, sf_dir))


# -- statuses, tiers and logs ---------------------------------------------------------------------------------------


@query("""select l_suppkey, case max(case l_returnflag when 'R' then 2 when 'A' then 1 else 0 end) when 2 then 'FAIL' when 1 then 'WARN' else 'PASS' end as worst,
    round(sum(case l_returnflag when 'R' then 2 when 'A' then 6 else 10 end) / (10.0 * count(*)), 6) as score from lineitem group by l_suppkey""")
def status_worst_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines as failures, others by their flag, for each supplier."""
    status = F.when(F.col("l_returnflag") == "R", "FAIL").when(F.col("l_returnflag") == "A", "WARN").otherwise("PASS")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", status.alias("status"))
    return lines.groupBy("l_suppkey").agg(policy.worst_status(F.col("status")).alias("worst"), F.round(F.avg(policy.status_score(F.col("status"))), 6).alias("score"))


@query("""select case when r and l then 'tier_1_registry_plus_lineage' when r then 'tier_2_registry_primary' else 'tier_3_lineage_only_fallback' end as trust_tier, count(*) as customers
    from (select c_custkey in (select o_custkey from orders) as r, c_nationkey in (select s_nationkey from supplier where s_acctbal > 5000) as l from customer) group by 1""")
def trust_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders are in the registry, those of a nation with a rich supplier in the lineage."""
    known = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("in_registry", F.lit(True))
    nations = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey")).distinct().withColumn("in_lineage", F.lit(True))
    customers = table(spark, sf_dir, "customer").join(known, "c_custkey", "left").join(nations, "c_nationkey", "left")
    tier = policy.trust_tier(F.coalesce("in_registry", F.lit(False)), F.coalesce("in_lineage", F.lit(False)))
    return customers.groupBy(tier.alias("trust_tier")).agg(F.count("*").alias("customers"))


@query("select count(*) as findings, arg_max(event_type || ' of ' || user_id, event_id) as latest from events where event_type in ('click', 'purchase')")
def log_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    component = F.when(F.col("event_type").isin("click", "purchase"), "ai_extensions").otherwise("runner")
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), component.alias("source_component"), F.concat("event_type", F.lit(" of "), F.col("user_id").cast("string")).alias("message"))
    return health.logged_findings(log)


@query("""select 'o' || o_orderkey as check_id, o_orderpriority as field, 'orders' as dataset_system, coalesce(n, 0) as violation_count from orders
    left join (select l_orderkey, count(*) as n from lineitem where l_returnflag = 'R' group by 1) on o_orderkey = l_orderkey where o_orderstatus = 'F'""")
def attribution_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders as failed checks, and how often a log of returned lines has them already."""
    key = lambda c: F.concat(F.lit("o"), F.col(c).cast("string")).alias("check_id")
    status = F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "P", "WARN").otherwise("PASS")
    results = table(spark, sf_dir, "orders").select(
        key("o_orderkey"), F.col("o_orderpriority").alias("column_name"), F.lit("range").alias("check_type"), status.alias("status"), F.lit("HIGH").alias("severity"), F.lit("out of range").alias("message"), F.lit(1).alias("records_failing")
    )
    log = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(key("l_orderkey"))
    return attribution.earlier_violations(attribution.failures_of(results, "orders", None), log).select("check_id", "field", "dataset_system", "violation_count")


@query("""select case when contains(lower(p_type), 'brass') then 'foundry' when contains(lower(p_type), 'steel') then 'mill' when p_type = '' then 'unknown-system' else lower(p_type) end as system, count(*) as n
    from (select case when p_partkey % 50 = 0 then '' else p_type end as p_type from part) group by 1""")
def systems_of_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of parts as ids of contracts, some of them empty."""
    named = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 50 != 0, F.col("p_type")).alias("id"))
    return named.groupBy(attribution.system_of(F.col("id"), {"brass": "foundry", "steel": "mill"}).alias("system")).agg(F.count("*").alias("n"))


@query("""with m as (select r_name as subscriber_id, p_brand as snapshot_root, p_partkey, row_number() over (partition by r_name, p_brand order by p_partkey) as k from region join part
    on contains(lower(p_brand), '#' || (r_regionkey + 1)) and contains(lower(p_type), (array['brass', 'steel', 'tin', 'copper', 'gold'])[r_regionkey + 1])),
    a as (select subscriber_id, snapshot_root, string_agg(lpad(p_partkey::varchar, 9, '0'), '|' order by p_partkey) as nodes, count(*) as n from m where k <= 5 group by 1, 2)
    select r_name as subscriber_id, snapshot_root, nodes, case when r_regionkey = 0 then 'high' when coalesce(n, 0) > 0 then 'medium' else 'low' end as confidence from region left join a on r_name = subscriber_id""")
def lineage_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes of a snapshot for each brand, regions as subscribers that look for a metal in some brands, and how far to trust what they find."""
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("snapshot_root"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("node_id"), F.col("p_type").alias("haystack"))
    metals = F.array(*map(F.lit, ("brass", "steel", "tin", "copper", "gold")))
    regions = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("subscriber_id"))
    patterns = regions.select("subscriber_id", F.array(F.concat(F.lit("#"), (F.col("r_regionkey") + 1).cast("string"))).alias("repo_patterns"), F.array(F.get(metals, F.col("r_regionkey").cast("int"))).alias("file_patterns"))
    found = regions.join(lineage.aligned_consumers(parts, patterns), "subscriber_id", "left")
    direct, aligned = F.when(F.col("r_regionkey") == 0, 1).otherwise(0), F.greatest(F.coalesce(F.size("nodes"), F.lit(0)), F.lit(0))
    return found.select("subscriber_id", "snapshot_root", F.array_join("nodes", "|").alias("nodes"), lineage.enrichment_confidence(direct, aligned).alias("confidence"))


@query("""select doc_id, count(*) as facts, sum(length(t))::bigint as chars, arg_min(t, k) as first_fact from (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as k from documents)
    where t <> '' group by doc_id""")
def facts_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as facts of records, each of which is a second later than the one before."""
    records = table(spark, sf_dir, "documents").select(
        F.timestamp_seconds("doc_id").cast("string").alias("at"), F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text"))).alias("extracted_facts"))
    facts = text_drift.fact_texts(records, "at").groupBy(F.unix_seconds("at").alias("doc_id"))
    return facts.agg(F.count("*").alias("facts"), F.sum(F.length("text")).alias("chars"), F.min_by("text", "ord").alias("first_fact"))


# -- more of the dashboard ------------------------------------------------------------------------------------------


@query("select o_orderpriority as severity, 'o' || o_custkey as contract_id, count(*) as n from orders where o_orderpriority = '1-URGENT' group by 1, 2")
def dash_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    violations = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("severity"), F.concat(F.lit("o"), F.col("o_custkey").cast("string")).alias("contract_id"), F.lit("Unknown").alias("source_kind"))
    return dashboard.filtered_violations(violations, severity="1-URGENT").groupBy("severity", "contract_id").agg(F.count("*").alias("n"))


@query(f"select check_id, status, records_failing from ({_LINEITEM_SQL}) where status <> 'PASS'")
def dash_failing_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.failing_checks(checks.run_checks(table(spark, sf_dir, "lineitem"), LINEITEM)).select("check_id", "status", "records_failing")


@query("select o_orderkey as check_id, 'p' || l_partkey as file_path from orders left join lineitem on l_orderkey = o_orderkey and l_linenumber = 1")
def dash_top_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as violations, their lines as ranked files."""
    ranked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("check_id"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("file_path"))
    return dashboard.with_top_file(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("check_id")), ranked)


@query("""select contract_id, count(*) as versions, min(path) as earliest, coalesce(max(path) filter (where name = 'latest.yaml'), max(path)) as latest from (select 'o' || o_custkey as contract_id,
    case when o_orderstatus = 'F' then 'latest.yaml' else 'v.yaml' end as name, o_custkey || '/' || o_orderkey || '.yaml' as path from orders) group by contract_id""")
def dash_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as snapshot files of their customers."""
    text = lambda c: F.col(c).cast("string")
    name = F.when(F.col("o_orderstatus") == "F", "latest.yaml").otherwise("v.yaml")
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), text("o_custkey")).alias("contract_id"), name.alias("name"), F.concat(text("o_custkey"), F.lit("/"), text("o_orderkey"), F.lit(".yaml")).alias("path"))
    return dashboard.snapshot_inventory(files).select("contract_id", "versions", F.get("paths", F.lit(0)).alias("earliest"), "latest")


@query("""select l_orderkey, l_linenumber, strftime(l_shipdate::timestamp, '%b %-d, %Y, %-I:%M %p') as shipped, case when l_linenumber = 7 then '--' else printf('%.1f%%', l_quantity::double) end as share,
    replace(l_returnflag || chr(92) || l_linenumber, chr(92), '/') as path, case l_returnflag when 'R' then 'danger' when 'A' then 'info' else 'neutral' end as tone,
    'http://h' || l_linenumber as service from lineitem""")
def dash_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, shares, paths, tones and addresses as they are shown."""
    flag, line = F.col("l_returnflag"), F.col("l_linenumber").cast("string")
    severity = F.when(flag == "R", "critical").when(flag == "A", "Medium")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", V.formatted_date(F.col("l_shipdate").cast("timestamp")).alias("shipped"), V.formatted_percent(F.when(F.col("l_linenumber") != 7, F.col("l_quantity"))).alias("share"),
        V.normalized_path(F.concat(flag, F.lit("\\"), line)).alias("path"), V.severity_tone(severity).alias("tone"), V.service_base_url(F.concat(F.lit(" http://h"), line, F.lit("/v1// "))).alias("service"),
    )


@query("""with c as (select c_custkey as customer_id, c_name, c_mktsegment, c_nationkey from customer)
    select 'customer_id' as "column", unnest(['not_null', 'unique']) as test from (select count(*) as n, count(customer_id) as k, count(distinct customer_id) as d from c) where n = k and n = d
    union all select 'c_name', 'not_null' from (select count(*) as n, count(c_name) as k from c) where n = k union all select 'c_mktsegment', 'not_null' from (select count(*) as n, count(c_mktsegment) as k from c) where n = k
    union all select 'c_nationkey', 'not_null' from (select count(*) as n, count(c_nationkey) as k from c) where n = k
    union all select 'c_mktsegment', 'accepted_values' from (select count(distinct c_mktsegment) as d from c) where d between 1 and 8""")
def contract_sql_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL tests that a contract inferred from the customers suggests."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), "c_name", "c_mktsegment", "c_nationkey")
    contract = profile.infer_contract(customers, "customers")
    rows = [(c.name, test) for c in contract.clauses for test, _ in sql_tests(c, contract.profiled_rows)]  # a few a column
    return spark.createDataFrame(rows, "column string, test string")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract on lineitem under the strictest mode."""
    return policy.decorate(checks.run_checks(table(spark, sf_dir, "lineitem"), LINEITEM), "ENFORCE")
