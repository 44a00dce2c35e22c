"""Structured Streaming forms of resumable jobs and incremental decisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_jobs(jobs: DataFrame, generate: Callable[[DataFrame], DataFrame], results: str, failures: str, checkpoint: str):
    """Send each new job through ``generate`` once; rows without ``error`` go to results, others to failures for a retry.

    The checkpoint remembers what has been read. A batch that is retried overwrites its own folder, so results hold no row twice.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        made = generate(batch).persist()
        made.where("error is null").write.mode("overwrite").parquet(f"{results}/batch={epoch}")
        made.where("error is not null").write.mode("overwrite").parquet(f"{failures}/batch={epoch}")
        made.unpersist()

    return jobs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decision_counts(decisions: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Decisions per status and time window, with late rows up to a delay."""
    return decisions.withWatermark("ts", delay).groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n"))
