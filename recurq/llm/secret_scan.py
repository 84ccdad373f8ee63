"""Secret scanning with an incremental ledger of blobs.

A version is any row with a text: a file at a commit, a document. Versions are content-addressed by the
SHA-256 of their text. The ledger records which (blob, rule version) pairs have been scanned; a run scans
only the pairs that the ledger lacks, one version of each blob, appends findings and pairs to the ledger,
and joins findings back to every version that has the blob, those of earlier runs included.

Only digests shuffle. One version stands for a blob, and the text side is filtered by a broadcast of the
rows to skip or of the rows to scan, whichever is proven small; if neither is, by a shuffle join on the
row's own key, which no hot text can skew. Blobs without findings leave a pair and no finding.

Findings are written before pairs: a run that dies between the two is repeated and its findings, being
equal, are read once.

Cases: null text is empty; repeated rows are joined back each; an empty table scans nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, maybe_broadcast, new_path, text_of, written

LEDGER_FINDINGS = "sha binary, rule_version string, kind string, start long, stop long"
LEDGER_PAIRS = "sha binary, rule_version string"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched leftmost and without overlaps; a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int


# The kinds in their order, their patterns and lengths.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)


def rule_version(rules: tuple[Rule, ...]) -> str:
    """The version of a rule set: a digest of what it says."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


class Scanner:
    """Finds (kind, start, stop) in code points, in the order of start, then of the rules."""

    def __init__(self, rules: tuple[Rule, ...]):
        self._rules = []
        for r in rules:
            pattern = r.pattern
            # A run of one class that is too short fails wherever it begins: the length can go into the pattern.
            if r.group == 0 and re.fullmatch(r"\[[^\]]+\]\+", pattern):
                pattern = f"{pattern[:-1]}{{{r.least},}}"
            self._rules.append((r, re.compile(pattern, re.ASCII)))

    def find(self, text: str) -> list[tuple[str, int, int]]:
        found = []
        for rank, (rule, pattern) in enumerate(self._rules):
            for m in pattern.finditer(text):
                a, b = m.span(rule.group)
                if b - a >= rule.least:
                    found.append((m.start(), rank, rule.kind, m.end()))
        return [(kind, a, b) for a, _, kind, b in sorted(found)]


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of (sha, text) rows."""
    version = rule_version(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            out: list[tuple] = []
            for sha, text in zip(batch.column(0), batch.column(1), strict=True):
                if found := scanner.find(text.as_py() or ""):
                    key = sha.as_py()
                    out += [(key, version, *f) for f in found]
            columns = zip(*out, strict=True) if out else [[]] * 5
            types = (pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["sha", "rule_version", "kind", "start", "stop"])

    return blobs.select("sha", "text").mapInArrow(run, LEDGER_FINDINGS)


class Ledger:
    """Findings and scanned pairs, kept as Parquet under ``path`` in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "ledger")

    def _read(self, name: str, schema: str) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def findings(self, version: str) -> DataFrame:
        return self._read("findings", LEDGER_FINDINGS).filter(F.col("rule_version") == version).dropDuplicates()

    def pairs(self, version: str) -> DataFrame:
        return self._read("pairs", LEDGER_PAIRS).filter(F.col("rule_version") == version).select("sha").distinct()

    def scan(self, versions: DataFrame, key: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
        """Scan what is new of ``versions``; return their rows (key, sha). ``findings_of`` joins findings back."""
        version = rule_version(rules)
        text = text_of(text_col)
        sha = F.unhex(F.sha2(text.cast("binary"), 256))
        paths = written(versions.select(F.col(key).alias("key"), sha.alias("sha")), "paths")
        unseen = paths.groupBy("sha").agg(F.min("key").alias("key")).join(self.pairs(version), "sha", "left_anti")
        unseen = written(unseen, "unseen")
        new, total = unseen.count(), paths.count()
        source = versions.select(F.col(key).alias("key"), sha.alias("sha"), text.alias("text"))
        on = source["key"].eqNullSafe(unseen["key"]) & (source["sha"] == unseen["sha"])
        if new == total:
            chosen = source
        elif total - new <= BROADCAST_ROWS:
            skip = paths.join(unseen.withColumnRenamed("key", "chosen"), "sha", "left").filter(~F.col("key").eqNullSafe(F.col("chosen"))).select("key", "sha")
            skip = written(skip, "skip")
            off = source["key"].eqNullSafe(skip["key"]) & (source["sha"] == skip["sha"])
            chosen = source.join(F.broadcast(skip), off, "left_anti")
        else:
            chosen = source.join(F.broadcast(unseen) if new <= BROADCAST_ROWS else unseen.hint("merge"), on, "left_semi")
        scan_blobs(chosen, rules).write.mode("append").parquet(f"{self.path}/findings")
        unseen.select("sha", F.lit(version).alias("rule_version")).write.mode("append").parquet(f"{self.path}/pairs")
        return paths


def scan_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES, ledger_path: str | None = None) -> DataFrame:
    """One row per row of ``df``: doc_id, n_<kind> of each kind, base_sha256 and spans (``kind:start:end``, comma-joined)."""
    ledger = Ledger(df.sparkSession, ledger_path)
    paths = ledger.scan(df, id_col, text_col, rules)
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    span = F.struct("start", rank[F.col("kind")].alias("rank"), F.concat_ws(":", "kind", "start", "stop").alias("span"))
    per_blob = ledger.findings(rule_version(rules)).groupBy("sha").agg(
        *[F.count_if(F.col("kind") == r.kind).alias(f"n_{r.kind}") for r in rules],
        F.array_join(F.transform(F.array_sort(F.collect_list(span)), lambda s: s["span"]), ",").alias("spans"),
    )
    per_blob = maybe_broadcast(written(per_blob, "per-blob"), BROADCAST_ROWS // 10)
    spans = F.coalesce("spans", F.lit(""))
    return paths.join(per_blob, "sha", "left").select(
        F.col("key").alias("doc_id"), *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules], F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans")
    )


def _oracle() -> str:
    """Positions from the lengths of matches and of what lies between them. A run of one class that is too short fails
    wherever it begins, so the length can go into its pattern."""
    found = []
    assign = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    for rank, (kind, pattern, group, least) in enumerate((("assign", assign, 2, 8), ("access", "(AKIA[A-Z0-9]{12,})", 1, 16), ("hex", "([0-9a-f]{32,})", 1, 32))):
        found.append(f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, start, start + length(m) AS stop FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(gs) AS g, unnest([list_sum([length(x) FOR x IN ps[1:k]]) + coalesce(list_sum([length(x) FOR x IN ms[1:k - 1]]), 0) FOR k IN range(1, len(ms) + 1)])::BIGINT AS start
    FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {group}) AS gs, regexp_split_to_array(text, '{pattern}') AS ps FROM texts)
  ) WHERE length(g) >= {least}""")
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(found)}),
per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
               string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN per USING (doc_id)
"""


ORACLE = _oracle()
