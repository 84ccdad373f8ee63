"""An extension: pairs from a stream of messages, with the same state machine as the batch plan."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "conversation_pk long, user_pk long, assistant_pk long, user_text string, assistant_text string"


def _close(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(parts)).sort_values(["created_at", "message_pk"])
    waiting = state.get if state.exists else (None, None)
    out = []
    for role, text, pk in zip(rows["role"], rows["content_text"], rows["message_pk"], strict=True):
        if not (text or "").strip():
            continue
        if role == "user":
            waiting = (int(pk), text.strip())
        elif role == "assistant" and waiting[0] is not None:
            out.append((key[0], waiting[0], int(pk), waiting[1], text.strip()))
            waiting = (None, None)
    state.update(waiting)
    yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])


def streamed_pairs(messages: DataFrame) -> DataFrame:
    """Pairs of a stream; the state of a conversation is its one waiting question. Messages of a conversation must come in
    order between batches; within a batch they are sorted."""
    return messages.groupBy("conversation_pk").applyInPandasWithState(_close, _OUT, "pk long, text string", "append", GroupStateTimeout.NoTimeout)
