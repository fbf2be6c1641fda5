"""Edits with undo and redo: an event log for each document, folded to what stands.

``do`` puts a value on what is done and forgets what was undone; ``undo`` takes the last done value back, ``redo`` takes the
last undone one forth; both do nothing where there is none, and so does any other action. The fold keeps the two stacks
of a document and reads its events as a stream: in a batch from rows sorted by document and number, in a stream with state.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DO, UNDO, REDO = "do", "undo", "redo"


def step(done: list, undone: list, action: str | None, value: str | None) -> None:
    if action == DO:
        done.append(value)
        undone.clear()
    elif action == UNDO and done:
        undone.append(done.pop())
    elif action == REDO and undone:
        done.append(undone.pop())


_OUT = pa.schema([("key", pa.int64()), ("done", pa.list_(pa.string())), ("undone", pa.list_(pa.string()))])
_DDL = "key long, done array<string>, undone array<string>"


def _folded(batches: Iterable[pa.RecordBatch]):
    """Rows (key, action, value) in order: a row for each key. A key may go on over any number of batches."""
    key, done, undone, begun = None, [], [], False
    rows: list = []
    for batch in batches:
        for k, action, value in zip(*(c.to_pylist() for c in batch.columns)):
            if begun and k != key:
                rows.append((key, done, undone))
                done, undone = [], []
            key, begun = k, True
            step(done, undone, action, value)
        if len(rows) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.types)], schema=_OUT)
            rows = []
    if begun:
        rows.append((key, done, undone))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.types)], schema=_OUT)


def standing(events: DataFrame, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """(key, done, undone) from events (key, order, action, value): values that stand, first to last, and those that a redo
    would bring back, the next one last. Events of equal number go by action and value. Rows without a key are passed over; a key
    whose events do nothing has empty arrays; an empty log gives no row. Events are never gathered: a task holds the stacks of
    one key.
    """
    own = events.select(F.col(key).cast("long").alias("key"), F.col(order).alias("at"), F.col("action").cast("string").alias("action"), F.col("value").cast("string").alias("value")).where("key is not null")
    dealt = own.repartition("key").sortWithinPartitions("key", "at", "action", "value").select("key", "action", "value")
    return dealt.mapInArrow(_folded, _DDL).withColumnRenamed("key", key)


def standing_stream(events: DataFrame, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """The same over a stream, in update mode: a row for each key that a micro-batch touches. Events of a key must come in
    order from batch to batch; within one they are sorted."""

    def fold(k: tuple, frames: Iterable[pd.DataFrame], state: GroupState):
        done, undone = (json.loads(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(frames)).sort_values(["at", "action", "value"], na_position="first")
        for action, value in zip(rows["action"], rows["value"]):
            step(done, undone, action, value)
        state.update((json.dumps(done), json.dumps(undone)))
        yield pd.DataFrame({"key": [k[0]], "done": [done], "undone": [undone]})

    own = events.select(F.col(key).cast("long").alias("key"), F.col(order).alias("at"), F.col("action").cast("string").alias("action"), F.col("value").cast("string").alias("value")).where("key is not null")
    return own.groupBy("key").applyInPandasWithState(fold, _DDL, "done string, undone string", "update", GroupStateTimeout.NoTimeout).withColumnRenamed("key", key)
