"""The whole reducer over a stream: one processor for each chat, whose records, evidence and pairs of links are typed map states.

A batch of mutations is worked out on copies of the records that it names and written back only if it goes through. State lies in the state
store (RocksDB: set spark.sql.streaming.stateStore.providerClass), so a chat's size is bounded by disk, and a batch reads what it names alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import transactions as t
from tidemark.operators.log import _fnv
from tidemark.operators.reducer import ACTIONS

_CONTENT = "message long, lineage string, source_class string, claim string, time_anchor string"
#: A row for each mutation, and with it what it changed: the record and its evidence ids; links are told by the mutation that makes them.
OUTPUT = f"batch long, ordinal long, action string, record string, outcome string, fields {t._STRUCT}, evidence_ids array<string>, links array<struct<id: string, from: string, to: string, message: long>>"


def _id(prefix: str, *parts) -> str:  # noqa: ANN002
    return f"{prefix}_" + _fnv("|".join("" if p is None else str(p) for p in parts))


class _Batch:
    """One batch: reads from the states, keeps changes beside them."""

    def __init__(self, records, evidence, links, chat):  # noqa: ANN001
        self.states, self.chat, self.n = (records, evidence, links), chat, 0
        self.folds: dict[str, tuple[t.RecordFold, t.References]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def record(self, name: str) -> tuple[t.RecordFold, t.References]:
        if name not in self.folds:
            row = self.states[0].getValue((name,))
            ids = list(row[len(t.NAMES)]) if row else []
            live = {i: dict(zip(("message", "lineage", "source_class", "claim", "time_anchor"), self.states[1].getValue((i,)), strict=True)) for i in ids}
            fields = tuple(list(x) if isinstance(x, list) else x for x in row[: len(t.NAMES)]) if row else None
            self.folds[name] = t.RecordFold(fields), t.References(ids, live)
        return self.folds[name]

    def apply(self, m: dict) -> dict | None:
        """The row of a mutation, or None if it contradicts what an id stands for."""
        name = t._bounded(m["record"], t.ID_CHARS)
        if m["action"] == "create":
            name = name or _id("wsr", self.chat, m["message"], m["lineage"], m["ordinal"])
        row = {"batch": m["batch"], "ordinal": m["ordinal"], "action": m["action"], "record": name or None, "outcome": "applied", "fields": None, "evidence_ids": None, "links": None}
        if m["action"] not in ACTIONS:
            return row | {"outcome": "unsupported action"}
        if m["action"] == "noop":
            return row
        if not name:
            return row | {"outcome": "no such record"}
        fold, refs = self.record(name)
        row["outcome"] = fold.apply(m)
        if row["outcome"] != "applied":
            return row
        added = []
        for e in m["evidence"] or []:
            claim = t._bounded(e["claim"], t.CLAIM_CHARS)
            if not claim:
                continue
            message = e["message"] if e["message"] is not None and e["message"] >= 0 else m["message"]
            content = {"message": message, "lineage": t._bounded(e["lineage"], 80) or m["lineage"], "source_class": e["source_class"] if e["source_class"] in t.SOURCE_CLASSES else "assistant_narration", "claim": claim, "time_anchor": t._bounded(e["time_anchor"], t.TIME_CHARS)}
            added.append((_id("wse", self.chat, name, m["message"], m["lineage"], self.n, claim), content))
            self.n += 1
        if not refs.add(added):
            return None
        row["links"] = []
        for other in t._unique(m["related"], t.LINKS, t.ID_CHARS):
            pair = min(other, name), max(other, name)
            if other != name and self.record(other)[0].fields and not self.pairs.get(pair) and not self.states[2].containsKey(pair):
                self.pairs[pair] = True
                row["links"].append(Row(id=_id("wsl", self.chat, other, name, "related", m["message"], m["lineage"]), **{"from": other, "to": name}, message=m["message"]))
        return row | {"fields": Row(**fold.fields), "evidence_ids": list(refs.ids)}

    def commit(self) -> None:
        records, evidence, links = self.states
        for name, (fold, refs) in self.folds.items():
            if not fold.fields:
                continue
            before = records.getValue((name,))
            for gone in set(before[len(t.NAMES)] if before else ()) - set(refs.ids):
                evidence.removeKey((gone,))
            refs.close()
            for i, content in refs.live.items():
                evidence.updateValue((i,), tuple(content.values()))
            records.updateValue((name,), (*fold.values(), list(refs.ids)))
        for pair in self.pairs:
            links.updateValue(pair, (True,))


class Reducer(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.records = handle.getMapState("records", "record string", f"{t.FIELDS}, evidence_ids array<string>")
        self.evidence = handle.getMapState("evidence", "id string", _CONTENT)
        self.links = handle.getMapState("links", "low string, high string", "there boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        given = sorted((r.asDict(recursive=True) for r in rows), key=lambda m: (m["batch"], m["ordinal"]))
        for _, ms in groupby(given, key=lambda m: m["batch"]):
            ms = list(ms)
            if any(m["action"] not in (None, "", "noop") and (m["message"] is None or m["message"] < 0 or not t._bounded(m["lineage"], 80)) for m in ms):
                yield from self._refused(key, ms, t.REFUSED)
                continue
            batch, out = _Batch(self.records, self.evidence, self.links, key[0]), []
            for m in ms:
                out.append(batch.apply(m))
                if out[-1] is None:
                    break
            if out[-1] is None:
                yield from self._refused(key, ms, t.FAILED)
                continue
            batch.commit()
            yield from (Row(chat=key[0], **r) for r in out)

    def _refused(self, key, ms: list[dict], why: str) -> Iterator[Row]:  # noqa: ANN001
        for m in ms:
            name = t._bounded(m["record"], t.ID_CHARS) or (_id("wsr", key[0], m["message"], m["lineage"], m["ordinal"]) if m["action"] == "create" else None)
            yield Row(chat=key[0], batch=m["batch"], ordinal=m["ordinal"], action=m["action"], record=name, outcome=why, fields=None, evidence_ids=None, links=None)

    def close(self) -> None:
        pass


def transact_stream(mutations: DataFrame) -> DataFrame:
    """A row for each mutation, as transact() has them, with the record and its evidence ids after it and the links that it made.

    Micro-batches come in the order of batches, and a batch lies in one of them. Chats may have any key type; null ones are one chat.
    """
    kind = mutations.schema["chat"].dataType.simpleString()
    return mutations.select("chat", *t.COLUMNS).groupBy("chat").transformWithState(Reducer(), f"chat {kind}, {OUTPUT}", "append", "none")
