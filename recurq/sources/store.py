"""Tables that change together: one manifest names the folders of every table, and a commit is one new manifest.

Data is written first, the manifest last, under a temporary name that is renamed to its number. A writer that dies
before the rename leaves the tables as they were, and its folders are never read. Two writers that began at one
version can't both commit: the second gets ``Conflict``. Where a rename is not atomic, let one writer commit at a time.

Cases: a store or a table that does not exist reads as None; a commit of nothing is a version, too; a table of a new
schema is read by the merged schema of its folders; a mark (say, the last batch of a stream) changes with the tables.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since this one read."""


@dataclass(frozen=True)
class State:
    """One version of all tables."""

    version: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)
    marks: dict[str, str] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, *names: str):
        return self._fs.Path("/".join([self.path, *names]))

    def state(self) -> State:
        """The newest version; version 0 has no table."""
        fs, folder = self._at().getFileSystem(self._conf), self._at("manifests")
        if not fs.exists(folder):
            return State()
        names = [str(s.getPath().getName()) for s in fs.listStatus(folder)]
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return State()
        stream = fs.open(self._at("manifests", f"{max(numbers):010d}"))
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return State(max(numbers), found["tables"], found["marks"])

    def read(self, name: str, state: State | None = None) -> DataFrame | None:
        """A table as of ``state`` (the newest)."""
        folders = (state or self.state()).tables.get(name)
        if not folders:
            return None
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{f}" for f in folders])

    def commit(self, since: State, replace: dict[str, DataFrame | None] | None = None, append: dict[str, DataFrame] | None = None, marks: dict[str, str] | None = None) -> State:
        """A version in which the tables of ``replace`` are new (None: gone) and those of ``append`` have more rows.

        The frames may read tables of this store: no folder of an earlier version changes.
        """
        tables = dict(since.tables)
        for name, df in (replace or {}).items():
            tables[name] = [] if df is None else [self._written(name, df)]
        for name, df in (append or {}).items():
            tables[name] = [*tables.get(name, []), self._written(name, df)]
        new = State(since.version + 1, tables, since.marks | (marks or {}))
        self._publish(new)
        return new

    def _written(self, name: str, df: DataFrame) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def _publish(self, new: State) -> None:
        fs, target = self._at().getFileSystem(self._conf), self._at("manifests", f"{new.version:010d}")
        draft = self._at("manifests", f"draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps({"tables": new.tables, "marks": new.marks}), "utf-8"))
        finally:
            stream.close()
        files = self._fs.FileContext.getFileContext(self._at().toUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0)  # no overwriting
        try:
            files.rename(draft, target, plain)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(target):
                raise Conflict(f"version {new.version} of {self.path} was committed by another writer") from e
            raise
