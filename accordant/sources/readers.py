"""Sources: JSON lines, whole JSON and YAML documents, registries, baselines, snapshots, text files, git."""

from __future__ import annotations

import json
import subprocess
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = (
    "report_id string, contract_id string, snapshot_id string, run_timestamp string, validation_mode string, field string, check_type string, status string, severity string, action string, blocking boolean, "
    "message string, sample_values array<string>, records_failing long, records_total long, failing_percent double, check_id string, source_component string"
)
TEXT_SUFFIXES = ("py", "yaml", "yml", "json", "md", "sql", "ts", "tsx", "js", "toml", "txt")
IGNORED_FOLDERS = (".git", ".venv", "venv", "node_modules", "__pycache__", ".next", "dist", "build")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines. Blank lines and a byte order mark are passed over; a line that isn't JSON fails; no file or no record is an error."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read.option("mode", "FAILFAST")
    df = (reader.schema(schema) if schema else reader).json(path)
    if df.isEmpty():
        raise ValueError(f"no records in {path}")
    return df


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file from any file system that Spark reaches; None if there is none."""
    if not _exists(spark, path):
        return None
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    return bytes(rows[0][0]).decode("utf-8-sig")


def read_yaml(spark: SparkSession, path: str) -> Any:
    import yaml

    text = read_text(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    return yaml.safe_load(text)


def read_json(spark: SparkSession, path: str, missing: Any = ...) -> Any:
    """A JSON document; ``missing`` if there is no file, else an error."""
    text = read_text(spark, path)
    if text is None:
        if missing is ...:
            raise FileNotFoundError(path)
        return missing
    return json.loads(text)


def read_registry(spark: SparkSession, path: str) -> dict[str, Any]:
    """A registry document, whatever is wrong with the file: a bare list counts as the subscriptions, anything else odd as none, with a note."""
    import yaml

    text = read_text(spark, path)
    empty = {"version": None, "subscriptions": []}
    if text is None:
        return empty | {"notes": [f"Registry file not found: {path}"]}
    value = yaml.safe_load(text)
    if isinstance(value, list):
        return empty | {"subscriptions": value, "notes": []}
    if not isinstance(value, dict):
        return empty | {"notes": ["Registry file did not contain a mapping."]}
    return value | {"subscriptions": value["subscriptions"] if isinstance(value.get("subscriptions"), list) else []}


def read_baselines(spark: SparkSession, path: str) -> dict[str, Any]:
    """Numeric baselines; none if the file is missing or broken."""
    try:
        value = read_json(spark, path, missing=None)
    except ValueError:
        value = None
    return value if isinstance(value, dict) and "columns" in value else {"written_at": None, "columns": {}}


def read_snapshots(spark: SparkSession, path: str) -> tuple[list[dict[str, Any]], str]:
    """Lineage snapshots and how they were found: JSON lines, one document, or an array."""
    text = read_text(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    try:
        rows = [json.loads(line) for line in text.splitlines() if line.strip()]
        if rows and all(isinstance(r, dict) for r in rows):
            return rows, "jsonl"
    except ValueError:
        pass
    value = json.loads(text)
    if isinstance(value, dict):
        return [value], "whole-file-json"
    if isinstance(value, list) and (rows := [v for v in value if isinstance(v, dict)]):
        return rows, "json-array"
    raise ValueError(f"no lineage snapshot in {path}")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a trace: run_type, times, tokens, metadata, and inputs as JSON texts by name; metadata may stand under ``extra``."""
    shape = "run_type string, start_time string, end_time string, prompt_tokens long, completion_tokens long, total_tokens long, metadata map<string,string>, extra struct<metadata: map<string,string>>, inputs map<string,variant>"
    rows = read_records(spark, path, shape)
    inputs = F.transform_values("inputs", lambda _, v: F.to_json(v))
    return rows.withColumns({"metadata": F.coalesce("metadata", "extra.metadata"), "inputs": inputs}).drop("extra")


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Verdicts: their fields as text, and scores by criterion."""
    names = ("verdict_id", "target_ref", "rubric_id", "rubric_version", "overall_verdict", "overall_score", "confidence", "evaluated_at")
    return read_records(spark, path, ", ".join(f"{n} string" for n in names) + ", scores map<string,struct<score: string, evidence: string, notes: string>>")


def read_snapshot_rows(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """((ord, doc: variant) of lineage snapshots, how they were found): JSON lines, one document, or an array of them; entries of an array that aren't objects go.

    Documents are parsed on the executors. A snapshot is a value of Spark's variant type, which bounds its size; JSON lines hold any number of them.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    parsed = F.try_parse_json(F.regexp_replace("value", "^\ufeff", ""))
    is_object = F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False))
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("ord"), parsed.alias("doc"))
    rows, odd = lines.agg(F.count("*"), F.count_if(~is_object)).first()
    if rows and not odd:
        return lines, "jsonl"
    whole = spark.read.text(path, wholetext=True).select(parsed.alias("doc"))
    entries = spark.sql("select cast(e.pos as long) as ord, e.value as doc from {whole} w, lateral variant_explode(w.doc) e where schema_of_variant(w.doc) like 'ARRAY%'", whole=whole).where(is_object)
    documents = whole.where(is_object).select(F.lit(0).cast("long").alias("ord"), "doc")
    for found, label in ((documents, "whole-file-json"), (entries, "json-array")):
        if not found.isEmpty():
            return found, label
    raise ValueError(f"no lineage snapshot in {path}")


def contract_roots(spark: SparkSession, document: dict[str, Any], workspace: str = "") -> list[Path]:
    """Git roots of the files that the first records of a contract's data set name; none if it isn't there."""
    place = ((document.get("servers") or {}).get("local") or {}).get("path")
    if not place:
        return []
    path = place if "://" in place or place.startswith("/") or not workspace else f"{workspace.rstrip('/')}/{place}"
    return repo_roots(spark.read.json(path)) if _exists(spark, path) else []


def read_violation_log(spark: SparkSession, path: str) -> DataFrame:
    """The log; empty if there is none. Older entries lack newer fields."""
    return spark.read.schema(LOG).json(path) if _exists(spark, path) else spark.createDataFrame([], LOG)


def snapshot_files(spark: SparkSession, root: str) -> DataFrame:
    """(contract_id, name, path, sha) of the versions under root/contract/."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("contract_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path", F.sha2("content", 256).alias("sha"))


def different_snapshots(files: DataFrame) -> DataFrame:
    """Versions by name, the first of equal content; the latest copy only if no version has its content."""
    from accordant.operators.health import keep_first

    ranked = files.withColumn("ord", F.concat(F.when(F.col("name") == "latest.yaml", "1").otherwise("0"), F.col("name"))).withColumn("key", F.concat("contract_id", "sha"))
    return keep_first(ranked, "key", "ord").drop("key").orderBy("contract_id", "ord").drop("ord")


def snapshot_counts(files: DataFrame) -> DataFrame:
    """(contract_id, n) of timestamped versions."""
    return files.groupBy("contract_id").agg(F.count_if(F.col("name") != "latest.yaml").alias("n"))


def read_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = TEXT_SUFFIXES) -> DataFrame:
    """(path, content) of the text files under a folder, less those in folders of tools."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").text(root, wholetext=True)
    full = F.col("_metadata.file_path")
    ignored = F.lit(False)
    for folder in IGNORED_FOLDERS:
        ignored = ignored | full.contains(f"/{folder}/")
    anchor = root.rstrip("/").rpartition("/")[2]
    return found.where(~ignored).select(F.regexp_replace(full, f"^.*/{anchor}/", "").alias("path"), F.col("value").alias("content"))


def find_git_root(start: str | Path) -> Path | None:
    here = Path(start).resolve()
    return next((p for p in (here, *here.parents) if (p / ".git").exists()), None)


def repo_roots(records: DataFrame, column: str = "source_path", sample: int = 20) -> list[Path]:
    """Git roots of the files that the first records name, each once whatever its case."""
    paths = [r[0] for r in records.select(column).limit(sample).collect() if r[0]] if column in records.columns else []
    roots: dict[str, Path] = {}
    for p in paths:
        if (root := find_git_root(Path(p).parent)) is not None:
            roots.setdefault(str(root).lower(), root)
    return list(roots.values())


def git_lines(spark: SparkSession, root: str | Path, path: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """(file_path, ord, line) of git's porcelain blame of ranges of a file."""
    rows: list[tuple[str, int, str]] = []
    for first, last in ranges:
        done = subprocess.run(["git", "-C", str(root), "blame", "-L", f"{first},{last}", "--porcelain", "--", path], capture_output=True, text=True, timeout=60, check=False)
        rows += [(path, len(rows) + i, line) for i, line in enumerate(done.stdout.splitlines())]
    return spark.createDataFrame(rows, "file_path string, ord long, line string")


def git_recent(spark: SparkSession, root: str | Path, path: str, days: int = 14) -> DataFrame:
    """(file_path, commit_hash, author, email, commit_ts, summary) of a file's commits of the last days."""
    done = subprocess.run(["git", "-C", str(root), "log", f"--since={days} days ago", "--format=%H%x1f%an%x1f%ae%x1f%aI%x1f%s", "--", path], capture_output=True, text=True, timeout=60, check=False)
    rows = [(path, *line.split("\x1f")) for line in done.stdout.splitlines() if line.count("\x1f") == 4]
    return spark.createDataFrame(rows, "file_path string, commit_hash string, author string, email string, commit_ts string, summary string")
