"""The whole reducer: batches of mutations, with evidence, links and all-or-nothing batches.

A mutation has chat, batch (their order within a chat), ordinal, message, lineage, action, record, kind, summary, status, trend, time_anchor,
anchors, caused_by, affects, related (arrays of texts) and evidence (an array of claim, source_class, message, lineage, time_anchor). Null
fields are absent.

What a mutation does depends on its own record alone, but for three things: a batch without message or lineage is refused as a whole; evidence is numbered
through a batch; and a batch whose evidence contradicts what an id already stands for fails as a whole. So records are folded in parallel,
whatever the size of their chat; links and numbers come from joins and windows; and chats in which a batch fails are folded again without that batch, the
earliest of each first, until none does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.chat import evidence_id, link_id, record_id
from tidemark.functions.text import bounded_text
from tidemark.operators.reducer import ACTIONS, KINDS, STATUSES, SUMMARY_CHARS, TRENDS

#: Fixed values.
CLAIM_CHARS, ANCHOR_CHARS, TIME_CHARS, ID_CHARS = 500, 120, 160, 120
ANCHORS, LINKS, REFERENCES = 20, 20, 32
SOURCE_CLASSES = ("user_narration", "assistant_narration", "recent_history", "elapsed_hint", "lore_baseline", "manual", "rebuild", "foreign_import")

REFUSED, FAILED = "batch needs message and lineage", "batch contradicts evidence"
LISTS = ("anchors", "caused_by", "affects")
TEXTS = ("kind", "summary", "status", "trend", "time_anchor")
_EVIDENCE = "array<struct<claim: string, source_class: string, message: long, lineage: string, time_anchor: string>>"
COLUMNS = ("batch", "ordinal", "message", "lineage", "action", "record", *TEXTS, *LISTS, "related", "evidence")
_FIELD_TYPES = {c: "string" for c in TEXTS} | {c: "array<string>" for c in LISTS} | {c: "long" for c in ("created", "changed", "evaluated")}
NAMES = list(_FIELD_TYPES)
FIELDS = ", ".join(f"{c} {t}" for c, t in _FIELD_TYPES.items())
_STRUCT = "struct<" + ", ".join(f"{c}: {t}" for c, t in _FIELD_TYPES.items()) + ">"
#: Types of a mutation's columns but the chat's.
MUTATION = "batch long, ordinal long, message long, lineage string, action string, record string, " + ", ".join(f"{c} string" for c in TEXTS) + ", " + ", ".join(f"{c} array<string>" for c in (*LISTS, "related")) + f", evidence {_EVIDENCE}"


def _bounded(text: str | None, most: int) -> str:
    return (text or "").strip()[:most].strip()


def _unique(values: list[str] | None, most: int, chars: int) -> list[str]:
    return list(dict.fromkeys(x for x in (_bounded(v, chars) for v in values or []) if x))[:most]


def references(kept: list[str], added: list[str]) -> list[str]:
    """Different evidence ids in their order: the first, and the newest up to the limit."""
    own = list(dict.fromkeys([*kept, *added]))
    return own if len(own) <= REFERENCES else [own[0], *own[1 - REFERENCES :]]


class RecordFold:
    """One record's fields. apply() gives the outcome of a mutation: applied, or why it is rejected."""

    def __init__(self, fields: tuple | None = None, ended: int | None = None):
        self.fields, self.ended = dict(zip(NAMES, fields, strict=True)) if fields else {}, ended

    def values(self) -> tuple:
        return tuple(self.fields[c] for c in NAMES)

    def _given(self, m: dict) -> dict:
        """What an update says of the lists."""
        return {c: _unique(m[c], ANCHORS if c == "anchors" else LINKS, ANCHOR_CHARS if c == "anchors" else ID_CHARS) for c in LISTS if m[c] is not None}

    def apply(self, m: dict) -> str:
        action, summary, own = m["action"], _bounded(m["summary"], SUMMARY_CHARS), self.fields
        if action == "create":
            if m["kind"] not in KINDS or not summary:
                return "needs kind and summary"
            if own:
                return "record exists"
            trend = m["trend"] if m["kind"] == "development" and m["trend"] in TRENDS else None
            self.fields = {"kind": m["kind"], "summary": summary, "status": m["status"] if m["status"] in STATUSES else "active", "trend": trend, "time_anchor": _bounded(m["time_anchor"], TIME_CHARS)}
            self.fields |= {c: [] for c in LISTS} | self._given(m) | dict.fromkeys(("created", "changed", "evaluated"), m["message"])
            return "applied"
        if not own:
            return "no such record"
        if self.ended == m["batch"]:
            return "ended in this batch"
        if action == "update" and m["status"] is not None and m["status"] != own["status"]:
            return "update can't change status"
        told = {"summary": summary} if summary else {}
        if action == "update":
            if own["kind"] == "development" and m["trend"] is not None:
                told["trend"] = m["trend"] if m["trend"] in TRENDS else None
            told |= self._given(m)
        else:
            told["status"], self.ended = {"resolve": "resolved", "supersede": "superseded"}[action], m["batch"]
        if m["time_anchor"] is not None:
            told["time_anchor"] = _bounded(m["time_anchor"], TIME_CHARS)
        if any(own[c] != v for c, v in told.items()):
            own["changed"] = m["message"]
        own |= told | {"evaluated": m["message"]}
        return "applied"


#: What a fold reads of a mutation; all else passes it by as Arrow columns.
_READ = ("chat", "record", "batch", "message", "action", *TEXTS, *LISTS, "outcome", "begun")


def _folded(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come by chat and record, and in their order: each with its outcome, the last of a record with its fields."""
    own, fold, held = None, None, None

    def told(batch: pa.RecordBatch, outcome: list, fields: list) -> pa.RecordBatch:
        new = {"outcome": outcome, "fields": fields}
        return pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name).cast(f.type) for f in schema], schema=schema)

    for batch in batches:
        outcome, fields = [], [None] * batch.num_rows
        for k, m in enumerate(batch.select(_READ).to_pylist()):
            if own != (m["chat"], m["record"]):
                if fold and fold.fields:
                    (fields if k else held[2])[k - 1] = fold.fields
                begun = m["begun"]
                own, fold = (m["chat"], m["record"]), RecordFold(tuple(begun[c] for c in NAMES) if begun else None)
            outcome.append(m["outcome"] or fold.apply(m))
        if outcome:
            # The next batch may go on with the last record.
            if held:
                yield told(*held)
            held = batch, outcome, fields
    if held:
        if fold.fields:
            held[2][-1] = fold.fields
        yield told(*held)


#: The place of what was there before all batches, and the outcome of its rows.
BEFORE, BEGUN = -(2**63), "begun"


def outcomes(mutations: DataFrame, failed: DataFrame | None = None, records: DataFrame | None = None) -> DataFrame:
    """(chat, batch, ordinal, message, lineage, action, record, related, evidence, outcome, fields): what becomes of each mutation; `fields` is the record after its last one.

    failed: (chat, batch) of batches that are to leave no trace. records: those that were there before, a row of theirs begins each. A created record without an id gets one from its place.
    """
    kind = mutations.schema["chat"].dataType.simpleString()
    own = Window.partitionBy("chat", "batch")
    action = F.coalesce("action", F.lit(""))
    refused = F.max(~action.isin("", "noop") & (F.col("message").isNull() | (F.col("message") < 0) | (bounded_text(F.col("lineage"), 80) == ""))).over(own)
    rows = mutations.select("chat", *COLUMNS).withColumn("begun", F.lit(None).cast(_STRUCT))
    if records is not None:
        first = {"batch": F.lit(BEFORE), "ordinal": F.lit(0), "record": F.col("record"), "begun": F.struct(*(F.col(c).cast(t).alias(c) for c, t in _FIELD_TYPES.items()))}
        rows = rows.unionByName(records.select("chat", *(first.get(c, F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in (*COLUMNS, "begun"))))
    named = F.when(F.col("record").isNotNull() & (bounded_text(F.col("record"), ID_CHARS) != ""), bounded_text(F.col("record"), ID_CHARS)).when(action == "create", record_id(F.col("chat"), F.col("message"), F.col("lineage"), F.col("ordinal")))
    outcome = F.when(F.col("begun").isNotNull(), F.lit(BEGUN)).when(F.col("refused"), F.lit(REFUSED)).when(~action.isin(*ACTIONS), F.lit("unsupported action")).when(action == "noop", F.lit("applied")).when((action != "create") & F.col("record").isNull(), F.lit("no such record"))
    rows = rows.withColumn("refused", refused).withColumn("record", named).withColumn("outcome", outcome).drop("refused")
    if failed is not None:
        there = failed.select("chat", "batch", F.lit(True).alias("failed"))
        rows = rows.join(there.withColumnsRenamed({"chat": "c", "batch": "b"}), F.col("chat").eqNullSafe(F.col("c")) & (F.col("batch") == F.col("b")), "left").withColumn("outcome", F.when(F.col("failed"), F.lit(FAILED)).otherwise(F.col("outcome"))).drop("failed", "c", "b")
    out = f"chat {kind}, batch long, ordinal long, message long, lineage string, action string, record string, related array<string>, evidence {_EVIDENCE}, outcome string, fields {_STRUCT}"
    schema = _arrow(mutations.sparkSession, out)
    ordered = rows.repartition("chat", "record").sortWithinPartitions("chat", "record", "batch", "ordinal")
    return ordered.mapInArrow(lambda batches: _folded(batches, schema), out)


def _arrow(spark, columns: str) -> pa.Schema:  # noqa: ANN001
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], columns).schema)


def numbered_evidence(done: DataFrame) -> DataFrame:
    """(chat, batch, ordinal, n, record, id, content): the evidence of applied mutations, numbered through each batch; content is what its id stands for. done: of outcomes()."""
    each = done.filter("outcome = 'applied' and action <> 'noop'").select("chat", "batch", "ordinal", "record", F.col("message").alias("at"), F.col("lineage").alias("key"), F.posexplode("evidence").alias("place", "e"))
    claim = bounded_text(F.col("e.claim"), CLAIM_CHARS)
    order = Window.partitionBy("chat", "batch").orderBy("ordinal", "place")
    told = each.filter(claim != "").withColumn("n", F.row_number().over(order) - 1)
    message = F.when(F.col("e.message") >= 0, F.col("e.message")).otherwise(F.col("at"))
    lineage = F.coalesce(F.nullif(bounded_text(F.col("e.lineage"), 80), F.lit("")), F.col("key"))
    content = F.struct(message.alias("message"), lineage.alias("lineage"), F.when(F.col("e.source_class").isin(*SOURCE_CLASSES), F.col("e.source_class")).otherwise("assistant_narration").alias("source_class"), claim.alias("claim"), bounded_text(F.col("e.time_anchor"), TIME_CHARS).alias("time_anchor"))
    return told.select("chat", "batch", "ordinal", "n", "record", evidence_id(F.col("chat"), F.col("record"), F.col("at"), F.col("key"), F.col("n"), claim).alias("id"), content.alias("content"))


class References:
    """A record's evidence: add() takes what a mutation brings and tells whether it contradicts what is there; close() ends a batch."""

    def __init__(self, ids: list[str] = (), live: dict | None = None):
        self.ids, self.live = list(ids), dict(live or {})

    def add(self, rows: list[tuple[str, dict]]) -> bool:
        for id_, content in rows:
            if self.live.setdefault(id_, content) != content:
                return False
        self.ids = references(self.ids, [id_ for id_, _ in rows])
        return True

    def close(self) -> None:
        self.live = {i: self.live[i] for i in self.ids}


_CONTENT = "struct<message: long, lineage: string, source_class: string, claim: string, time_anchor: string>"


def _referred(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come by chat and record, and in their order: for each record the evidence that it refers to at its end, and batches that contradict what is there."""
    own = at = refs = None
    out, rows = [], []

    def add() -> None:
        if rows and not refs.add([(r["id"], r["content"]) for r in rows]):
            out.append({"chat": own[0], "record": own[1], "failed": at[0]})
        rows.clear()

    def ended() -> None:
        add()
        refs.close()
        out.extend({"chat": own[0], "record": own[1], "place": k, "id": i, "content": refs.live[i]} for k, i in enumerate(refs.ids))

    for batch in batches:
        for r in batch.to_pylist():
            key, place = (r["chat"], r["record"]), (r["batch"], r["ordinal"])
            if own != key or at != place:
                if own is not None and own != key:
                    ended()
                elif own is not None:
                    add()
                    if at[0] != place[0]:
                        refs.close()
                if own != key:
                    refs = References()
                own, at = key, place
            rows.append(r)
        if len(out) > 10_000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
    if own is not None:
        ended()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def referred_evidence(numbered: DataFrame) -> DataFrame:
    """(chat, record, place, id, content, failed): the evidence that each record refers to after all batches; rows with `failed` name batches that contradict an id's content."""
    columns = f"chat {numbered.schema['chat'].dataType.simpleString()}, record string, place int, id string, content {_CONTENT}, failed long"
    schema = _arrow(numbered.sparkSession, columns)
    ordered = numbered.repartition("chat", "record").sortWithinPartitions("chat", "record", "batch", "ordinal", "n")
    return ordered.mapInArrow(lambda batches: _referred(batches, schema), columns)


def related_links(done: DataFrame) -> DataFrame:
    """(chat, id, from, to, message): a link for each pair of records that an applied mutation relates, where the other one was there before; of a pair the earliest."""
    applied = done.filter("outcome = 'applied' and action <> 'noop'").withColumn("who", F.struct("chat"))  # null chats are one
    born = done.filter((F.col("outcome") == BEGUN) | ((F.col("outcome") == "applied") & (F.col("action") == "create"))).select(F.struct("chat").alias("who"), F.col("record").alias("from"), F.struct("batch", "ordinal").alias("born"))
    wanted = F.slice(F.array_distinct(F.filter(F.transform("related", lambda x: bounded_text(x, ID_CHARS)), lambda x: x != "")), 1, LINKS)
    each = applied.select("who", "batch", "ordinal", "message", "lineage", F.col("record").alias("to"), F.posexplode(wanted).alias("place", "from"))
    there = each.join(born, ["who", "from"]).filter((F.col("from") != F.col("to")) & (F.col("born") < F.struct("batch", "ordinal")))
    first = there.groupBy("who", F.least("from", "to").alias("low"), F.greatest("from", "to").alias("high")).agg(F.min(F.struct("batch", "ordinal", "place", "from", "to", "message", "lineage")).alias("r")).select("who.chat", "r.*")
    return first.select("chat", link_id(F.col("chat"), F.col("from"), F.col("to"), F.lit("related"), F.col("message"), F.col("lineage")).alias("id"), "from", "to", "message")


def _places_of_evidence(before: Reduced) -> DataFrame:
    """The evidence that records had, as numbered_evidence() has it, before all batches."""
    place = before.records.select(F.struct("chat").alias("who"), "record", F.posexplode("evidence_ids").alias("n", "id"))
    content = F.struct(*(F.col(c) for c in ("message", "lineage", "source_class", "claim", "time_anchor")))
    own = before.evidence.select(F.struct("chat").alias("who"), "record", "id", content.alias("content"))
    return place.join(own, ["who", "record", "id"]).select("who.chat", F.lit(BEFORE).alias("batch"), F.lit(0).cast("long").alias("ordinal"), "n", "record", "id", "content")


@dataclass
class Reduced:
    """outcomes (chat, batch, ordinal, action, record, outcome); records; evidence; links."""

    outcomes: DataFrame
    records: DataFrame
    evidence: DataFrame
    links: DataFrame


def transact(mutations: DataFrame, before: Reduced | None = None) -> Reduced:
    """The state of all chats after their batches; `before` is the state that they begin with, as an earlier call gave it, so that a replay can stop after any batch and go on.

    Rows of null chats are one chat. Of rows with equal batch and ordinal any order may hold. Chats in which a batch fails are folded again, once for
    each of their failed batches; all others once. Empty tables give empty ones.
    """
    spark = mutations.sparkSession
    pending, failed, parts, begun = mutations, None, [], before
    while True:
        done = _kept(outcomes(pending, failed, begun and begun.records))
        numbered = numbered_evidence(done)
        refs = _kept(referred_evidence(numbered.unionByName(_places_of_evidence(begun)) if begun else numbered))
        first = _kept(refs.filter("failed is not null").groupBy("chat").agg(F.min("failed").alias("batch")))
        if first.isEmpty():
            parts.append((done, refs))
            break
        again = lambda df, how: df.join(first.select(F.col("chat").alias("__chat")), F.col("chat").eqNullSafe(F.col("__chat")), how)  # noqa: B023, E731
        parts.append((again(done, "left_anti"), again(refs, "left_anti")))
        pending = again(pending, "left_semi")
        begun = begun and Reduced(begun.outcomes, *(again(x, "left_semi") for x in (begun.records, begun.evidence)), begun.links)
        failed = first if failed is None else _kept(again(failed, "left_semi").unionByName(first))
    done, refs = (reduce(DataFrame.unionByName, x) for x in zip(*parts, strict=True))
    evidence = refs.filter("id is not null").select("chat", "record", "place", "id", "content")
    ids = evidence.groupBy("chat", "record").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("evidence_ids"))
    records = done.filter("fields is not null").select("chat", "record", "fields.*")
    both = records.withColumn("k", F.hash("chat")).join(ids.withColumnsRenamed({"chat": "c", "record": "r"}), F.col("chat").eqNullSafe(F.col("c")) & (F.col("record") == F.col("r")), "left").drop("k", "c", "r")
    both = both.withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<string>")))
    links = related_links(done)
    if before:
        pair = lambda df: df.withColumns({"who": F.struct("chat"), "low": F.least("from", "to"), "high": F.greatest("from", "to")})
        new = pair(links).join(pair(before.links).select("who", "low", "high"), ["who", "low", "high"], "left_anti")
        links = before.links.unionByName(new.select(before.links.columns))
    told = done.filter(F.col("outcome") != BEGUN).select("chat", "batch", "ordinal", "action", "record", "outcome")
    return Reduced(told, both, evidence.select("chat", "record", "id", "content.*"), links)


def _kept(df: DataFrame) -> DataFrame:
    from tidemark.operators.shared import cut

    return cut(df)
