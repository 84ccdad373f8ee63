"""The run log: appended rows only; the newest row of a run is its state. Metrics and per-company roll-ups."""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "run_id string, workspace_id long, status string, started_at timestamp, finished_at timestamp, parameters string, notes string, logged_at timestamp"


def start(spark: SparkSession, path: str, parameters: dict, workspace_id: int | None = None) -> str:
    now, run_id = datetime.datetime.now(datetime.UTC), str(uuid.uuid4())
    spark.createDataFrame([(run_id, workspace_id, "running", now, None, json.dumps(parameters, default=str), None, now)], LOG).write.mode("append").parquet(path)
    return run_id


def finish(spark: SparkSession, path: str, run_id: str, status: str, notes: str | None = None) -> None:
    """Close a run; notes that are not given stay as they were."""
    if status not in ("succeeded", "failed"):
        raise ValueError(f"a run ends as succeeded or failed, not {status}")
    state = latest(spark.read.schema(LOG).parquet(path)).filter(F.col("run_id") == run_id)
    now = datetime.datetime.now(datetime.UTC)
    state.select("run_id", "workspace_id", F.lit(status).alias("status"), "started_at", F.lit(now).alias("finished_at"), "parameters", F.coalesce(F.lit(notes).cast("string"), "notes").alias("notes"), F.lit(now).alias("logged_at")).write.mode("append").parquet(path)


def latest(log: DataFrame) -> DataFrame:
    """One row a run, as logged last."""
    row = F.struct(*[c for c in log.columns if c != "run_id"])
    return log.groupBy("run_id").agg(F.max_by(row, "logged_at").alias("r")).select("run_id", "r.*")


def by_company(metrics: DataFrame, company: str, counters: list[str], silhouette: str = "silhouette", examples: str = "total_examples", clusters: str = "clusters_valid") -> DataFrame:
    """One row over companies: sums of counters, the mean of the silhouettes there are, and examples a valid cluster."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters]
    total = metrics.agg(*sums, F.round(F.avg(silhouette), 4).alias(silhouette), F.count_distinct(company).alias("companies"))
    if examples not in counters or clusters not in counters:
        return total
    return total.withColumn("average_cluster_size", F.when(F.col(clusters) > 0, F.round(F.col(examples) / F.col(clusters), 2)).otherwise(0.0))
