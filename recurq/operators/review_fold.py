"""Review as an ordered fold: requests of one candidate, edits and decisions alike, apply one after the other.

A request names the status its reviewer saw (``expected_status``, null for any); it is applied only if that is the candidate's
status when its turn comes. Candidates and requests meet in one shuffle by candidate and are sorted there, each candidate before its requests; one walk over the
sorted rows carries the state and the texts. A candidate with more requests than a task should walk is folded as a scan: its log is cut
into ranges of (candidate, time, id) of bounded rows, a range that a candidate shares with its neighbours becomes a table from
the state before it to the state after it, tables are chained, and then each range is folded by itself. A candidate with
a third of all requests is many ranges.

The state is the status and whether question and answer are blank: 5 x 2 x 2 cases. A request is refused whole, its edit included:
``not_found`` (no such candidate), ``unknown_status``, ``conflict`` (the status is another by now), ``blank`` (the edit or the
editor has no text, or a part that it leaves out is blank), ``cannot_promote`` (approval without an agent or an answer).

Cases: an empty or null part of an edit leaves that part as it is, a part of white space only is blank; an edit that changes
nothing is applied and is no edit event; requests without a candidate are ``not_found``; equal times go by request id, equal ids
by the rest of the row, and each repeated row is a request; a null time comes first; a candidate with an unknown or null status is in a fifth state, which no request expects.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recurq.functions import text as T
from recurq.operators.review import STATUSES
from recurq.sources import io
from recurq.sources.shared import maybe_broadcast, written

OTHER = len(STATUSES)  # the state of a candidate whose status is none of them
STATES = 4 * (OTHER + 1)  # status * 4 + blank question * 2 + blank answer
ERRORS = ["", "not_found", "unknown_status", "conflict", "blank", "cannot_promote"]
#: Requests of a range, and the most of a candidate that is not cut into ranges; a task folds one range or about as many rows.
RANGE_ROWS = 100_000
_CODES = ["wanted", "expected", "question_part", "answer_part", "no_actor", "no_agent", "found"]


@lru_cache(maxsize=4096)
def _step(wanted: int, expected: int, question_part: int, answer_part: int, no_actor: bool, no_agent: bool, found: bool) -> tuple[np.ndarray, np.ndarray]:
    """(state after, error) by state before. Parts: 0 left out, 1 text, 2 blank. ``wanted`` and ``expected``: a status, -1 none, -2 unknown."""
    after, errors = np.arange(STATES), np.zeros(STATES, int)
    edits = wanted == -1 or question_part or answer_part
    for state in range(STATES):
        status, no_question, no_answer = state >> 2, state >> 1 & 1, state & 1
        error = 0
        if not found:
            error = 1
        elif wanted == -2:
            error = 2
        elif expected != -1 and expected != status:
            error = 3
        elif edits and (no_actor or question_part == 2 or answer_part == 2 or (not question_part and no_question) or (not answer_part and no_answer)):
            error = 4
        elif wanted == STATUSES.index("approved") and (no_agent or (no_answer and not edits)):
            error = 5
        errors[state] = error
        if not error:
            after[state] = (status if wanted == -1 else wanted) << 2 | (0 if edits else state & 3)
    return after, errors


#: Kinds of requests: wanted and expected status from -2, parts of an edit, an editor without a name.
_KINDS = (len(STATUSES) + 2) ** 2 * 18


@lru_cache(maxsize=1)
def _tables() -> tuple[list[int], list[int]]:
    """State after and error by (candidate absent, with an agent, without; kind; state before), flat."""
    after, errors = [], []
    for base in range(3):
        for kind in range(_KINDS):
            statuses, parts = divmod(kind, 18)
            wanted, expected = divmod(statuses, len(STATUSES) + 2)
            a, e = _step.__wrapped__(wanted - 2, expected - 2, parts // 6, parts // 2 % 3, bool(parts % 2), base != 1, base > 0)
            after += a.tolist()
            errors += e.tolist()
    return after, errors


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Error, status and texts before each request, over candidates (kind -1) and their requests in order."""
    after, errors = _tables()
    last, state, offset, place = object(), 0, 0, 0
    carried: dict[str, pa.Array] = {}
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = batch.column("candidate_id")
        codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
        first = np.concatenate(([ids[0].as_py() != last], codes[1:] != codes[:-1]))
        kinds = batch.column("kind").to_numpy()
        error, previous = [], []
        for new, kind, start, base in zip(first.tolist(), kinds.tolist(), batch.column("start").to_pylist(), batch.column("base").to_pylist(), strict=True):
            if new:
                state, offset = OTHER * 4 + 3, 0
            if kind < 0:
                state, offset = start, base * _KINDS
                error.append(-1)
                previous.append(0)
            else:
                at = (offset + kind) * STATES + state
                error.append(errors[at])
                previous.append(state >> 2)
                state = after[at]
        error = np.array(error, np.int32)
        # places in [nothing, what the batch before hands on, the rows]: a candidate has nothing before its first row
        row = np.arange(n)
        lower = np.maximum.accumulate(np.where(first, row + 2, 1))

        def before(column: str, sets: np.ndarray, lower: np.ndarray = lower, row: np.ndarray = row, batch: pa.RecordBatch = batch) -> pa.Array:
            values = batch.column(column)
            whole = pa.concat_arrays([pa.nulls(1, values.type), carried.get(column, pa.nulls(1, values.type)), values])
            latest = np.maximum.accumulate(np.concatenate(([1], np.where(sets, row + 2, 0))))
            carried[column] = whole.take(pa.array([latest[-1] if latest[-1] >= lower[-1] else 0]))
            return whole.take(pa.array(np.where(latest[:-1] >= lower, latest[:-1], 0)))

        held, ok = kinds < 0, error == 0
        out = {c: batch.column(c) for c in ("request_id", "candidate_id", "at", "asked_status", "actor", "notes", "question", "answer")}
        out |= {"part": pa.array(np.zeros(n, np.int32)), "place": pa.array((place + row).astype(np.int32)), "error": pa.array(error), "previous": pa.array(previous, pa.int32())}
        out["status_0"] = before("asked_status", held)
        out |= {f"previous_{c}": before(c, held | (ok & batch.column(c).is_valid().to_numpy(zero_copy_only=False))) for c in ("question", "answer")}
        place += n
        last = ids[n - 1].as_py()
        yield pa.RecordBatch.from_pydict(out).filter(pa.array(~held))


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """A row a candidate of one range: the state after the range for each state before it."""
    out = []
    for candidate, rows in pdf.sort_values("place").groupby("candidate_id", sort=False):
        table = np.arange(STATES)
        for code in zip(*[rows[c].tolist() for c in _CODES], strict=True):
            table = _step(*code)[0][table]
        out.append((candidate, int(rows["part"].iloc[0]), int(rows["start"].iloc[0]), table.tolist()))
    return pd.DataFrame(out, columns=["candidate_id", "part", "start", "after"])


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state before each range of a candidate; a row a range."""
    pdf = pdf.sort_values("part")
    state, found = int(pdf["start"].iloc[0]), []
    for table in pdf["after"]:
        found.append(state)
        state = int(table[state])
    return pd.DataFrame({"candidate_id": pdf["candidate_id"], "part": pdf["part"], "before": found})


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """Error and status before each request of one range."""
    pdf = pdf.sort_values("place")
    errors, previous = [], []
    last, state = object(), 0
    for candidate, before, *code in zip(pdf["candidate_id"].tolist(), pdf["before"].tolist(), *[pdf[c].tolist() for c in _CODES], strict=True):
        if candidate != last:
            last, state = candidate, before
        after, error = _step(*code)
        errors.append(int(error[state]))
        previous.append(state >> 2)
        state = int(after[state])
    return pd.DataFrame({"part": pdf["part"], "place": pdf["place"], "error": errors, "previous": previous})


def _running(ranged: DataFrame, columns: list[str]) -> DataFrame:
    """The last value other than null of each column before a row of its candidate, as ``before_<column>``.

    Ranges by themselves first; what a range hands on is a row a candidate and range.
    """
    inner = Window.partitionBy("part", "candidate_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy("part", "candidate_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c) for c in columns])
    outer = Window.partitionBy("candidate_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select("part", "candidate_id", *[F.last(c, ignorenulls=True).over(outer).alias(f"handed_{c}") for c in columns])
    found = ranged.select("*", *[F.last(c, ignorenulls=True).over(inner).alias(f"in_{c}") for c in columns]).join(handed, ["part", "candidate_id"], "left")
    return found.select(*ranged.columns, *[F.coalesce(f"in_{c}", f"handed_{c}").alias(f"before_{c}") for c in columns])


def fold(candidates: DataFrame, requests: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row a request, applied or refused, with what was before it and what is after it.

    ``candidates``: candidate_id, status, agent_id, normalized_question, suggested_answer. ``requests``: request_id, candidate_id, at,
    status (null: an edit alone), expected_status, question, answer, actor, notes. The result has request_id, candidate_id, turn (its order among those of the candidate), at, event_type,
    previous_status, new_status, previous_question, new_question, previous_answer, new_answer, edited, actor, notes, error.
    """
    sizes = written(requests.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = written(sizes.filter(F.col("candidate_id").isNotNull() & (F.col("n") > range_rows)).select("candidate_id"), "hot")
    many = hot.take(1)
    others = requests.join(F.broadcast(hot), "candidate_id", "left_anti") if many else requests
    run = _walked(candidates, others, max(1, -(-total // range_rows)))
    if many:  # at most one in range_rows of the requests
        run = run.unionByName(_ranged(candidates.join(F.broadcast(hot), "candidate_id", "left_semi"), requests.join(F.broadcast(hot), "candidate_id", "left_semi"), range_rows))
    ok = F.col("error") == 0
    was = F.when(F.col("previous") < OTHER, F.get(F.array(*[F.lit(s) for s in STATUSES]), F.col("previous"))).otherwise(F.col("status_0"))
    run = run.withColumn("set_question", F.when(ok, F.col("question"))).withColumn("set_answer", F.when(ok, F.col("answer"))).withColumn("previous_status", was)
    other = lambda old, new: F.when(new.isNull(), False).otherwise(T.normalize_text(old) != new)  # noqa: E731  what is set is normalized
    edited = ok & (other("previous_question", F.col("set_question")) | other("previous_answer", F.col("set_answer")))
    return run.select(
        "request_id", "candidate_id", F.struct("part", "place").alias("turn"), "at", F.when(F.col("asked_status").isNull(), "edited").when(F.col("asked_status") == "needs_review", "marked_needs_review").otherwise(F.col("asked_status")).alias("event_type"),
        "previous_status", F.when(ok, F.coalesce("asked_status", "previous_status")).otherwise(F.col("previous_status")).alias("new_status"), "previous_question", F.coalesce("set_question", "previous_question").alias("new_question"),
        "previous_answer", F.coalesce("set_answer", "previous_answer").alias("new_answer"), edited.alias("edited"), "actor", "notes", F.element_at(F.array(*[F.lit(e or None).cast("string") for e in ERRORS]), F.col("error") + 1).alias("error"),
    )


def _blank(c: Column | str) -> Column:
    return F.coalesce(T.normalize_text(c) == "", F.lit(True))


def _code(c: Column) -> Column:
    return F.coalesce(*[F.when(c == s, F.lit(i)) for i, s in enumerate(STATUSES)])


def _part(c: str) -> Column:
    """Of an edit: 0 left out, 1 text, 2 blank."""
    return F.when(F.coalesce(F.col(c), F.lit("")) == "", 0).when(_blank(c), 2).otherwise(1)


def _start() -> Column:
    """The state of a candidate before all requests."""
    return (F.coalesce(_code(F.col("status")), F.lit(OTHER)) * 4 + _blank("normalized_question").cast("int") * 2 + _blank("suggested_answer").cast("int")).cast("int")


def _no_agent() -> Column:
    return F.coalesce(F.trim("agent_id"), F.lit("")) == ""


def _asked(c: str) -> Column:
    """The number of a status that a request names: -1 none, -2 unknown."""
    return F.when(F.col(c).isNull(), -1).otherwise(F.coalesce(_code(F.col(c)), F.lit(-2)))


def _walked(candidates: DataFrame, requests: DataFrame, parts: int) -> DataFrame:
    """What ``_ranged`` gives, for candidates whose requests fit into a task: one shuffle, one sort, one walk."""
    texts = {c: F.when(_part(c) == 1, T.normalize_text(c)) for c in ("question", "answer")}
    wanted, expected = _asked("status") + 2, _asked("expected_status") + 2
    kind = (((wanted * (len(STATUSES) + 2) + expected) * 3 + _part("question")) * 3 + _part("answer")) * 2 + _blank("actor").cast("int")
    asked = requests.select(
        "request_id", "candidate_id", "at", F.col("status").alias("asked_status"), texts["question"].alias("question"), texts["answer"].alias("answer"), "actor", "notes",
        kind.cast("int").alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("base"),
    )
    kinds = {f.name: f.dataType for f in requests.schema.fields}
    nothing = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    held = candidates.select(
        nothing("request_id"), F.col("candidate_id").cast(kinds["candidate_id"]).alias("candidate_id"), nothing("at"), F.col("status").alias("asked_status"), F.col("normalized_question").alias("question"),
        F.col("suggested_answer").alias("answer"), nothing("actor"), nothing("notes"), F.lit(-1).alias("kind"), _start().alias("start"), F.when(_no_agent(), 2).otherwise(1).alias("base"),
    ).filter("candidate_id IS NOT NULL")
    # requests without a candidate go anywhere
    spread = F.when(F.col("candidate_id").isNull(), F.xxhash64("request_id", "at")).otherwise(F.lit(0))
    rows = asked.unionByName(held).repartition(parts, "candidate_id", spread)
    rows = rows.sortWithinPartitions("candidate_id", F.col("kind") >= 0, "at", "request_id", F.expr("kind div 18"), "question", "answer", "actor", "notes", "kind")
    of = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    plain = ["request_id", "candidate_id", "at", "asked_status", "actor", "notes", "question", "answer"]
    return rows.mapInArrow(_walk, ", ".join([f"{c} {of[c]}" for c in plain] + ["part int, place int, error int, previous int, status_0 string, previous_question string, previous_answer string"]))


def _ranged(candidates: DataFrame, requests: DataFrame, range_rows: int) -> DataFrame:
    """Requests with the error, and status and texts before them, as a scan over ranges."""
    known = candidates.select(
        "candidate_id", F.lit(True).alias("found"), _start().alias("start"), F.col("normalized_question").alias("question_0"), F.col("suggested_answer").alias("answer_0"),
        _no_agent().alias("no_agent"), F.col("status").alias("status_0"),
    )
    asked = requests.select("request_id", "candidate_id", "at", "status", "expected_status", "question", "answer", "actor", "notes").join(known, "candidate_id", "left")
    asked = asked.select(
        "request_id", "candidate_id", "at", "actor", "notes", F.col("status").alias("asked_status"), "status_0", "question_0", "answer_0",
        F.when(_part("question") == 1, T.normalize_text("question")).alias("question"), F.when(_part("answer") == 1, T.normalize_text("answer")).alias("answer"),
        _asked("status").alias("wanted"), _asked("expected_status").alias("expected"), _part("question").alias("question_part"), _part("answer").alias("answer_part"), _blank("actor").alias("no_actor"),
        F.coalesce("no_agent", F.lit(True)).alias("no_agent"), F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("start", F.lit(OTHER * 4 + 3)).alias("start"),
    )
    asked = written(asked, "asked")
    parts = max(1, -(-asked.count() // range_rows))
    cut = written(asked.repartitionByRange(parts, "candidate_id", "at", "request_id").withColumn("part", F.spark_partition_id()), "ranges")
    place = F.row_number().over(Window.partitionBy("part").orderBy("candidate_id", "at", "request_id", "wanted", "expected", "question", "answer", "actor", "notes"))
    ranged = written(cut.withColumn("place", place), "places")
    # candidates that more than one range has: at most one a bound between two ranges
    shared = ranged.groupBy("candidate_id").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a < b").select("candidate_id")
    steps = ranged.select("candidate_id", "part", "place", "start", *_CODES)
    kinds = dict(ranged.dtypes)
    tables = steps.join(F.broadcast(shared), "candidate_id", "left_semi").groupBy("part").applyInPandas(_compose, f"candidate_id {kinds['candidate_id']}, part int, start int, after array<int>")
    before = written(tables.groupBy("candidate_id").applyInPandas(_chain, f"candidate_id {kinds['candidate_id']}, part int, before int"), "before")
    entered = ranged.join(maybe_broadcast(before), ["candidate_id", "part"], "left").withColumn("before", F.coalesce("before", "start"))
    said = written(entered.select("candidate_id", "part", "place", "before", *_CODES).groupBy("part").applyInPandas(_fold, "part int, place int, error int, previous int"), "folded")
    joined = ranged.join(said, ["part", "place"])
    ok = F.col("error") == 0
    texts = joined.withColumn("set_question", F.when(ok, F.col("question"))).withColumn("set_answer", F.when(ok, F.col("answer")))
    run = _running(written(texts, "texts"), ["set_question", "set_answer"])
    return run.select(
        "request_id", "candidate_id", "at", "asked_status", "actor", "notes", "question", "answer", "part", "place", "error", "previous", "status_0",
        F.coalesce("before_set_question", "question_0").alias("previous_question"), F.coalesce("before_set_answer", "answer_0").alias("previous_answer"),
    )


def state(candidates: DataFrame, folded: DataFrame) -> DataFrame:
    """Candidates after a fold: status, texts, who decided and edited last, and how often they were edited."""
    ok = folded.filter("error IS NULL")
    order = F.col("turn")
    last = ok.groupBy("candidate_id").agg(
        F.max_by(F.struct("new_status", "new_question", "new_answer"), order).alias("__l"), F.count_if("edited").alias("__n"),
        F.max_by(F.struct("actor", "at"), F.when(F.col("edited"), order)).alias("__e"), F.max_by(F.struct("actor", "at"), F.when(F.col("event_type") != "edited", order)).alias("__d"),
    )
    j = candidates.drop("last_edited_by", "last_edited_at", "human_reviewed_by", "human_reviewed_at", "edit_count", "was_human_edited").join(last, "candidate_id", "left")
    changed = {"status": "new_status", "normalized_question": "new_question", "suggested_answer": "new_answer"}
    j = j.withColumns({c: F.when(F.col("__l").isNotNull(), F.col(f"__l.{new}")).otherwise(F.col(c)) for c, new in changed.items()})
    n = F.coalesce("__n", F.lit(0))
    return j.withColumns({"edit_count": n, "was_human_edited": n > 0, "last_edited_by": F.col("__e.actor"), "last_edited_at": F.col("__e.at"), "human_reviewed_by": F.col("__d.actor"), "human_reviewed_at": F.col("__d.at")}).drop("__l", "__n", "__e", "__d")


def promote(faqs: DataFrame, candidates: DataFrame, folded: DataFrame) -> DataFrame:
    """Known FAQs after all approvals: keyed by the candidate, active again if they were not, with the text as it was approved last.

    Later edits and rejections leave an FAQ as it is, until the candidate is approved again.
    """
    approved = folded.filter("error IS NULL AND event_type = 'approved'").groupBy("candidate_id").agg(F.max_by(F.struct("new_question", "new_answer"), "turn").alias("__t"))
    new = approved.join(candidates.select("candidate_id", "agent_id", "workspace_id"), "candidate_id").select(
        F.col("candidate_id").alias("faq_id"), F.col("agent_id").alias("source_agent_id"), "agent_id", "workspace_id", F.col("__t.new_question").alias("question"), F.col("__t.new_answer").alias("answer"), F.lit(True).alias("is_active")
    )
    return io.upsert(faqs, new, ["faq_id"])
