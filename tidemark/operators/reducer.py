"""The reducer: an ordered fold of mutations into records.

Mutations of a chat are applied in the order of (message, ordinal). The fold is sequential within a record, not within a
chat: what one mutation may do depends on its record's state and on the batch's own rows alone. So rows are dealt by
(chat, record) and streamed in order with one record as the state, which holds for chats of any size.

A mutation has chat, message (position), lineage, ordinal, action, record (id), kind, summary, status, trend and
time_anchor; null fields are absent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values.
ACTIONS = ("create", "update", "resolve", "supersede", "noop")
KINDS = ("fact", "development")
STATUSES = ("active", "resolved", "superseded")
TRENDS = ("rising", "stable", "falling")
SUMMARY_CHARS = 700

OUTPUT = "chat long, record string, message long, ordinal long, action string, outcome string, kind string, summary string, status string, trend string, time_anchor string, created long, changed long, evaluated long"


class Fold:
    """State of one record; apply() takes a mutation and returns the outcome: applied, or why it was rejected."""

    def __init__(self) -> None:
        self.kind = self.summary = self.status = self.trend = self.time_anchor = self.created = self.changed = self.evaluated = None
        self.ended_at: tuple | None = None

    def fields(self) -> tuple:
        return self.kind, self.summary, self.status, self.trend, self.time_anchor, self.created, self.changed, self.evaluated

    def apply(self, m: dict) -> str:
        action, summary = m["action"], (m["summary"] or "").strip()[:SUMMARY_CHARS].strip()
        if action not in ACTIONS:
            return "unsupported action"
        if action == "noop":
            return "applied"
        if m["message"] is None or not m["lineage"]:
            return "needs message and lineage"
        if action == "create":
            if m["kind"] not in KINDS or not summary:
                return "needs kind and summary"
            if self.status is not None:
                return "record exists"
            self.kind, self.summary, self.status = m["kind"], summary, m["status"] if m["status"] in STATUSES else "active"
            self.trend = m["trend"] if self.kind == "development" and m["trend"] in TRENDS else None
            self.time_anchor, self.created = m["time_anchor"] or "", m["message"]
            self.changed = self.evaluated = m["message"]
            return "applied"
        if self.status is None:
            return "no such record"
        if self.ended_at == (m["message"], m["lineage"]):
            return "ended in this batch"
        if action == "update" and m["status"] is not None and m["status"] != self.status:
            return "update can't change status"
        before = self.fields()[:5]
        if summary:
            self.summary = summary
        if action == "update" and self.kind == "development" and m["trend"] is not None:
            self.trend = m["trend"] if m["trend"] in TRENDS else None
        if action in ("resolve", "supersede"):
            self.status, self.ended_at = action.removesuffix("e") + "ed", (m["message"], m["lineage"])
        if m["time_anchor"] is not None:
            self.time_anchor = m["time_anchor"].strip()
        self.evaluated = m["message"]
        if self.fields()[:5] != before:
            self.changed = m["message"]
        return "applied"


#: OUTPUT's fields.
FIELDS = [tuple(c.split()) for c in OUTPUT.split(", ")]
_ARROW = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in FIELDS])


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by chat, record, message, ordinal."""
    own, state = None, Fold()
    for batch in batches:
        rows = []
        for m in batch.to_pylist():
            if (m["chat"], m["record"]) != own:
                own, state = (m["chat"], m["record"]), Fold()
            outcome = state.apply(m)
            rows.append((m["chat"], m["record"], m["message"], m["ordinal"], m["action"], outcome, *state.fields()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def reduce_mutations(mutations: DataFrame) -> DataFrame:
    """A row for each mutation: its outcome, and its record's state after it."""
    columns = ["chat", "record", "message", "ordinal", "lineage", "action", "kind", "summary", "status", "trend", "time_anchor"]
    return mutations.select(columns).repartition("chat", "record").sortWithinPartitions("chat", "record", "message", "ordinal").mapInArrow(fold, OUTPUT)


def current_records(outcomes: DataFrame) -> DataFrame:
    """The newest state of each record that was ever created."""
    from pyspark.sql import functions as F

    fields = ["kind", "summary", "status", "trend", "time_anchor", "created", "changed", "evaluated"]
    last = outcomes.filter("status is not null").groupBy("chat", "record").agg(F.max_by(F.struct(*fields), F.struct("message", "ordinal")).alias("r"))
    return last.select("chat", "record", "r.*")
