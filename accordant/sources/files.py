"""Small files that are there whole or not at all, on any file system that Spark reaches.

A file gets another name while it is written and its own by a rename, so a reader or a lost writer never leaves half of one. ``write_once`` lets the first
writer win; ``append_run`` adds a run's rows to a folder under the run's name, so a run that is repeated adds nothing.
"""

from __future__ import annotations

import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _session() -> SparkSession:
    from accordant.session import get_session

    return SparkSession.getActiveSession() or get_session()


def _system(spark: SparkSession, path: str):
    """(file system, path, path's parent); the local one without files of checksums."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getScheme() == "file":
        system = system.getRawFileSystem() if hasattr(system, "getRawFileSystem") else system
    return system, where


def _rename(spark: SparkSession, path: str, source, target, over: bool) -> None:
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").valueOf("OVERWRITE" if over else "NONE")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, options)


def _put(path: str | Path, text: str, over: bool) -> bool:
    spark = _session()
    system, target = _system(spark, str(path))
    target = system.makeQualified(target)
    system.mkdirs(target.getParent())
    jvm = spark.sparkContext._jvm
    staged = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{target.getName()}-{uuid.uuid4().hex}")
    out = system.create(staged, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    try:
        _rename(spark, str(path), staged, target, over)
    except Py4JJavaError as problem:
        system.delete(staged, False)
        if over or not exists(path):
            raise problem
        return False
    return True


def exists(path: str | Path) -> bool:
    system, where = _system(_session(), str(path))
    return system.exists(where)


def write_text(path: str | Path, text: str) -> None:
    """In place of what is there, at once."""
    _put(path, text, over=True)


def write_once(path: str | Path, text: str) -> bool:
    """Unless there is such a file already; of several writers the first one wins."""
    return not exists(path) and _put(path, text, over=False)


def append_run(rows: DataFrame, folder: str, run: str) -> bool:
    """Adds the rows of a run, those of a report at most, as one JSON file of the folder; False if the run is there already."""
    spark = rows.sparkSession
    target = f"{str(folder).rstrip('/')}/{run}.json"
    if exists(target):
        return False
    system, staging = _system(spark, f"{str(folder).rstrip('/')}/_{run}-{uuid.uuid4().hex}")
    staging = system.makeQualified(staging)
    rows.coalesce(1).write.json(staging.toString())
    written = [s.getPath() for s in system.listStatus(staging) if s.getPath().getName().startswith("part-")]
    try:
        if written:
            _rename(spark, target, written[0], system.makeQualified(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)), over=False)
        return bool(written)
    except Py4JJavaError:
        if not exists(target):
            raise
        return False
    finally:
        system.delete(staging, True)
