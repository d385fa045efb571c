"""Extension: the checks of a contract on every micro-batch of a stream, with its results appended to a log."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from accordant.operators import checks, policy
from accordant.operators.contract import Contract


def check_stream(stream: DataFrame, contract: Contract, log_path: str, checkpoint: str, mode: str = "AUDIT", baselines: Mapping[str, tuple[float, float]] | None = None, **trigger) -> StreamingQuery:
    """Starts a query that writes a folder of results for each batch; a batch that is done again replaces its own."""

    def one(batch: DataFrame, number: int) -> None:
        results = policy.decorate(checks.run_checks(batch, contract, baselines), mode).withColumn("batch", F.lit(number))
        results.coalesce(1).write.mode("overwrite").parquet(f"{log_path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
