"""From the command line: ``python -m recurq.cli DATA_DIR OUT_DIR`` runs the analysis, with ``--ingest`` the ingest.

The analysis commits clusters, candidates, examples, events, embeddings and metrics to ``OUT_DIR/store`` as one version and
takes the candidates that are there as earlier ones; ``OUT_DIR/candidates`` is a copy of them. The ingest puts clean rows into the tables under ``OUT_DIR/clean`` and writes pairs and counters as JSON lines; with ``--dry-run`` it only counts them.
"""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from recurq import queries
from recurq.operators import ingest, pairing, reports, runs
from recurq.plans import persist
from recurq.sources import io
from recurq.sources.store import Store


def _clean(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    c = queries.Clean(spark, args.data)
    tables = {"workspaces": c.workspaces, "agents": c.agents, "conversations": c.convs, "messages": c.msgs, "faqs": c.faqs}
    return ingest.selected(tables, args.workspace, args.agent, args.since)


def ingested(spark: SparkSession, args: argparse.Namespace) -> None:
    """Put the selected rows into the clean tables, a new version of each; pairs of all messages and counters as JSON lines."""
    tables = _clean(spark, args)
    if args.dry_run:
        reports.counts(tables).orderBy("metric").show(truncate=False)
        return
    old = {name: io.read_table(spark, path) for name in tables if io.has_table(spark, path := f"{args.out}/clean/{name}")}
    counts: dict[str, dict[str, int]] = {}
    for name, df in ingest.ingest(old, tables, counts).items():
        io.replace_table(df, f"{args.out}/clean/{name}", spark)
    seen = Observation()
    found = pairing.pairs(io.read_table(spark, f"{args.out}/clean/messages"), "conversation_pk", ["created_at", "message_pk"])
    io.write_jsonl(found.select("conversation_pk", "message_pk", "assistant_pk", "user_text", "assistant_text").observe(seen, F.count(F.lit(1)).alias("n")), f"{args.out}/pairs")
    io.write_jsonl(spark.createDataFrame(list(ingest.figures(counts, seen.get["n"]).items()), "metric_name string, metric_value long").coalesce(1), f"{args.out}/counters")


def analysed(spark: SparkSession, args: argparse.Namespace) -> None:
    """One run with its log; pairs, clusters and metrics beside the store are those of the last run."""
    run_id = runs.start(spark, f"{args.out}/runs", {"data": args.data, "agent": args.agent, "since": args.since}, args.workspace)
    try:
        store = Store(spark, f"{args.out}/store")
        earlier = store.read("candidates")
        found = queries.analysis(spark, args.data, _clean(spark, args), earlier)
        for name in ("pairs", "clusters", "metrics", *(["members"] if args.debug else [])):
            getattr(found, name).write.mode("overwrite").parquet(f"{args.out}/{name}")
        now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
        done = persist.persist(store, found, run_id, now)
        io.replace_table(store.read("candidates", done), f"{args.out}/candidates", spark)
        runs.finish(spark, f"{args.out}/runs", run_id, "succeeded")
    except Exception as error:
        runs.finish(spark, f"{args.out}/runs", run_id, "failed", str(error)[:500])
        raise


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("data", help="a folder with the source tables")
    parser.add_argument("out", help="a folder for the tables of runs, or of the ingest")
    parser.add_argument("--ingest", action="store_true", help="put clean rows into tables, without an analysis")
    parser.add_argument("--dry-run", action="store_true", help="with --ingest: count the rows and write nothing")
    parser.add_argument("--workspace", type=int, help="only rows of this workspace")
    parser.add_argument("--agent", help="only rows of this agent")
    parser.add_argument("--since", type=datetime.datetime.fromisoformat, help="only messages from this time on")
    parser.add_argument("--debug", action="store_true", help="also write cluster members with their labels")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("recurq").getOrCreate()
    (ingested if args.ingest else analysed)(spark, args)


if __name__ == "__main__":
    main()
