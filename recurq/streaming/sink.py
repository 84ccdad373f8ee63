"""A stream into clean tables: each batch is one version of a store, whose mark names the last batch that is in.

A batch only appends its rows, under its number; ``newest`` reads the last row of each key, and ``compacted`` puts what has
come since into the clean table by key, as an ingest does, and empties the log.

Cases: a batch that comes again changes nothing, also after a restart from the checkpoint; a batch that dies leaves the
version before it; rows whose key is null are left out; of rows of one batch that share a key any one is taken, the same
in every run; an empty batch sets the mark only; a stream with a new checkpoint needs a new ``stream`` name, as it counts from 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from recurq.operators import ingest
from recurq.sources.store import State, Store

BATCH = "__batch"


def _log(name: str) -> str:
    return f"{name}_log"


def put_batch(store: Store, name: str, stream: str, rows: DataFrame, number: int) -> State:
    """Append a batch to the log of a table, unless it is in."""
    since = store.state()
    mark = f"{stream}/{name}"
    if number <= int(since.marks.get(mark, -1)):
        return since
    keys, _ = ingest.TABLES[name]
    rest = [c for c in rows.columns if c not in keys]
    once = rows.dropna(subset=keys).groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__row")).select(*keys, "__row.*")
    # batches of one store are numbered by its versions, so that those of several streams have an order
    return store.commit(since, append={_log(name): once.withColumn(BATCH, F.lit(since.version + 1).cast("long"))}, marks={mark: str(number)})


def sink(rows: DataFrame, store: Store, name: str, stream: str, checkpoint: str, clean: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> DataStreamWriter:
    """The writer of a stream of rows, cleaned batch by batch, into a table of ``ingest.TABLES``."""

    def each(batch: DataFrame, number: int) -> None:
        put_batch(store, name, stream, clean(batch), number)

    return rows.writeStream.queryName(stream).foreachBatch(each).option("checkpointLocation", checkpoint)


def _last(log: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in log.columns if c not in (*keys, BATCH)]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("__row")).select(*keys, "__row.*")


def newest(store: Store, name: str, state: State | None = None) -> DataFrame | None:
    """The clean table with what its log has on top. Rows that are in the log only have no surrogate key yet."""
    state = state or store.state()
    keys, pk = ingest.TABLES[name]
    base, log = store.read(name, state), store.read(_log(name), state)
    if log is None:
        return base
    fresh = _last(log, keys)
    if base is None:
        return fresh.withColumn(pk, F.lit(None).cast("long"))
    fresh = fresh.join(base.select(*keys, pk), keys, "left")
    return base.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def compacted(store: Store, name: str) -> State:
    """Put the log into the clean table, with surrogate keys, and empty it, in one version."""
    since = store.state()
    log = store.read(_log(name), since)
    if log is None:
        return since
    base = store.read(name, since)
    done = ingest.ingest({} if base is None else {name: base}, {name: _last(log, ingest.TABLES[name][0])})[name]
    return store.commit(since, replace={name: done, _log(name): None})
