"""The whole reducer against a plain one that goes through each chat's batches in order."""

import random

import pytest

from tidemark.operators import transactions
from tidemark.operators.log import _fnv

KIND = f"chat string, {transactions.MUTATION}"


def _id(prefix, *parts):
    return f"{prefix}_" + _fnv("|".join("" if p is None else str(p) for p in parts))


def _text(value, most):
    return (value or "").strip()[:most].strip()


def _plain(rows):
    """Chat by chat and batch by batch: a copy of the state is changed, and taken if the whole batch went through."""
    told, states = {}, {}
    for chat in {r["chat"] for r in rows}:
        records, evidence, links = {}, {}, []
        own = sorted((r for r in rows if r["chat"] == chat), key=lambda r: (r["batch"], r["ordinal"]))
        for batch in sorted({r["batch"] for r in own}):
            ms = [r for r in own if r["batch"] == batch]
            if any(m["action"] not in (None, "noop") and (m["message"] is None or not m["lineage"]) for m in ms):
                told.update({(chat, batch, m["ordinal"]): transactions.REFUSED for m in ms})
                continue
            new, known, edges, n, ended, out = {k: dict(v, refs=list(v["refs"])) for k, v in records.items()}, dict(evidence), list(links), 0, set(), {}
            failed = False
            for m in ms:
                place, rid = (chat, batch, m["ordinal"]), _text(m["record"], 120)
                if m["action"] not in ("create", "update", "resolve", "supersede", "noop"):
                    out[place] = "unsupported action"
                    continue
                if m["action"] == "noop":
                    out[place] = "applied"
                    continue
                lists = {c: list(dict.fromkeys(x for x in (_text(v, 120) for v in m[c] or []) if x))[:20] for c in ("anchors", "caused_by", "affects")}
                if m["action"] == "create":
                    rid = rid or _id("wsr", chat, m["message"], m["lineage"], m["ordinal"])
                    if m["kind"] not in ("fact", "development") or not _text(m["summary"], 700):
                        out[place] = "needs kind and summary"
                        continue
                    if rid in new:
                        out[place] = "record exists"
                        continue
                    r = new[rid] = {"kind": m["kind"], "summary": _text(m["summary"], 700), "status": m["status"] if m["status"] in ("active", "resolved", "superseded") else "active", "trend": m["trend"] if m["kind"] == "development" and m["trend"] in ("rising", "stable", "falling") else None, "time_anchor": _text(m["time_anchor"], 160), **lists, "created": m["message"], "changed": m["message"], "evaluated": m["message"], "refs": []}
                else:
                    r = new.get(rid)
                    if r is None:
                        out[place] = "no such record"
                        continue
                    if rid in ended:
                        out[place] = "ended in this batch"
                        continue
                    if m["action"] == "update" and m["status"] is not None and m["status"] != r["status"]:
                        out[place] = "update can't change status"
                        continue
                    before = {k: v for k, v in r.items() if k not in ("created", "changed", "evaluated", "refs")}
                    r["summary"] = _text(m["summary"], 700) or r["summary"]
                    if m["action"] == "update":
                        if r["kind"] == "development" and m["trend"] is not None:
                            r["trend"] = m["trend"] if m["trend"] in ("rising", "stable", "falling") else None
                        r.update({c: v for c, v in lists.items() if m[c] is not None})
                    else:
                        ended.add(rid)
                        r["status"] = "resolved" if m["action"] == "resolve" else "superseded"
                    if m["time_anchor"] is not None:
                        r["time_anchor"] = _text(m["time_anchor"], 160)
                    r["evaluated"] = m["message"]
                    if before != {k: v for k, v in r.items() if k not in ("created", "changed", "evaluated", "refs")}:
                        r["changed"] = m["message"]
                out[place] = "applied"
                added = []
                for e in m["evidence"] or []:
                    if not _text(e["claim"], 500):
                        continue
                    i = _id("wse", chat, rid, m["message"], m["lineage"], n, _text(e["claim"], 500))
                    n += 1
                    row = (rid, e["message"] if e["message"] is not None and e["message"] >= 0 else m["message"], _text(e["lineage"], 80) or m["lineage"], e["source_class"] if e["source_class"] in transactions.SOURCE_CLASSES else "assistant_narration", _text(e["claim"], 500), _text(e["time_anchor"], 160))
                    failed |= known.setdefault(i, row) != row
                    added.append(i)
                refs = list(dict.fromkeys(r["refs"] + added))
                r["refs"] = refs if len(refs) <= 32 else [refs[0], *refs[-31:]]
                for other in list(dict.fromkeys(x for x in (_text(v, 120) for v in m["related"] or []) if x))[:20]:
                    if other != rid and other in new and not any({other, rid} == {x[1], x[2]} for x in edges):
                        edges.append((_id("wsl", chat, other, rid, "related", m["message"], m["lineage"]), other, rid, m["message"]))
            if failed:
                told.update({(chat, batch, m["ordinal"]): transactions.FAILED for m in ms})
                continue
            used = {i for r in new.values() for i in r["refs"]}
            records, evidence, links = new, {i: x for i, x in known.items() if i in used}, edges
            told.update(out)
        states[chat] = records, evidence, links
    return told, states


def mutation(chat, batch, ordinal, action, record=None, **more):
    row = dict.fromkeys(x for x in ("message", "lineage", *transactions.COLUMNS)) | {"message": batch, "lineage": f"l{batch}"} | more
    return row | {"chat": chat, "batch": batch, "ordinal": ordinal, "action": action, "record": record}


def _claim(claim, source=None, message=None, lineage=None, anchor=None):
    return {"claim": claim, "source_class": source, "message": message, "lineage": lineage, "time_anchor": anchor}


def _random_rows(seed, chats=6, batches=25):
    rng, rows = random.Random(seed), []
    pick = lambda *x: rng.choice(x)
    for chat in range(chats):
        for batch in range(batches):
            at = rng.choice((batch, max(0, batch - 1)))  # a message may be told of twice
            lineage = pick(*[f"l{at}"] * 12, None)
            for ordinal in range(rng.randint(1, 5)):
                if not ordinal:  # what may contradict an earlier telling
                    rows.append(mutation(f"c{chat}", batch, ordinal, "create" if batch < 2 else "update", "r1", message=at, lineage=lineage, kind="fact", summary="A", evidence=[_claim("one", pick("manual", None))]))
                    continue
                evidence = [_claim(pick("one", "two", " ", None), pick("manual", "odd", None), pick(None, 3, -1), None, pick(None, "then")) for _ in range(rng.randint(0, 3))]
                rows.append(mutation(
                    f"c{chat}", batch, ordinal, pick("create", "create", "update", "update", "update", "resolve", "supersede", "noop", "forget", None), pick("r1", "r2", "r3", "r4", " r5 ", None), message=pick(*[at] * 40, None),
                    lineage=lineage, kind=pick("fact", "development", "development", "rumour"), summary=pick("A summary", "Another", "Third", " ", None, "x" * 900), status=pick(None, None, "active", "resolved", "odd"), trend=pick(None, "rising", "falling", "odd"),
                    time_anchor=pick(None, "", " noon "), anchors=pick(None, [], ["a", " a ", "b"], [str(i) for i in range(30)]), caused_by=pick(None, ["r1", ""]), affects=pick(None, ["r2"]), related=pick(None, ["r1", "r2"], ["r3", "r5", "r3"], ["nobody"]), evidence=pick(None, evidence),
                ))
    return rows


def _check(spark, rows):
    told, states = _plain(rows)
    found = transactions.transact(spark.createDataFrame([tuple(r[c] for c in ("chat", *transactions.COLUMNS)) for r in rows], KIND).repartition(3))
    assert {(r.chat, r.batch, r.ordinal): r.outcome for r in found.outcomes.collect()} == told
    mine = {(r.chat, r.record): r for r in found.records.collect()}
    assert set(mine) == {(c, k) for c, (records, _, _) in states.items() for k in records}
    for chat, (records, evidence, links) in states.items():
        for k, want in records.items():
            r = mine[chat, k]
            assert {c: r[c] for c in transactions.NAMES} == {c: want[c] for c in transactions.NAMES}, (chat, k)
            assert r.evidence_ids == want["refs"]
        own = {r.id: (r.record, r.message, r.lineage, r.source_class, r.claim, r.time_anchor) for r in found.evidence.filter(found.evidence.chat == chat).collect()}
        assert own == evidence
        assert sorted((r.id, r["from"], r["to"], r.message) for r in found.links.filter(found.links.chat == chat).collect()) == sorted(links)
    return told


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_batches(spark, seed):
    told = _check(spark, _random_rows(seed))
    assert {transactions.REFUSED, transactions.FAILED, "applied", "record exists", "no such record", "update can't change status", "needs kind and summary", "unsupported action"} <= set(told.values())


def test_a_failed_batch_leaves_no_trace(spark):
    """The second telling of message 1 contradicts its evidence: nothing of it stays, and what would build on it fails by itself."""
    rows = [
        mutation("c", 1, 0, "create", "a", kind="fact", summary="A", evidence=[_claim("seen")]),
        mutation("c", 2, 0, "update", "a", message=1, lineage="l1", summary="B", evidence=[_claim("seen", "manual")]),
        mutation("c", 2, 1, "create", "b", message=1, lineage="l1", kind="fact", summary="New"),
        mutation("c", 3, 0, "update", "b", summary="C"),
        mutation("c", 3, 1, "update", "a", summary="D", related=["b"]),
        mutation("d", 1, 0, "create", "a", kind="fact", summary="A"),
    ]
    told = _check(spark, rows)
    assert told == {("c", 1, 0): "applied", ("c", 2, 0): transactions.FAILED, ("c", 2, 1): transactions.FAILED, ("c", 3, 0): "no such record", ("c", 3, 1): "applied", ("d", 1, 0): "applied"}


def test_what_ended_in_a_batch_is_not_changed_in_it(spark):
    rows = [mutation("c", 0, 0, "create", "a", kind="development", summary="A", trend="rising"), mutation("c", 1, 0, "resolve", "a"), mutation("c", 1, 1, "update", "a", summary="B"), mutation("c", 2, 0, "update", "a", summary="C", trend="falling")]
    assert list(_check(spark, rows).values()).count("ended in this batch") == 1


def test_evidence_stays_within_its_bound(spark):
    rows = [mutation("c", 0, 0, "create", "a", kind="fact", summary="A", evidence=[_claim("first")])] + [mutation("c", k, 0, "update", "a", evidence=[_claim(f"claim {k}"), _claim(f"more {k}")]) for k in range(1, 40)]
    _check(spark, rows)
    found = transactions.transact(spark.createDataFrame([tuple(r[c] for c in ("chat", *transactions.COLUMNS)) for r in rows], KIND))
    assert found.evidence.count() == 32 and {"first", "more 39"} <= {r.claim for r in found.evidence.collect()}


@pytest.mark.parametrize("stops", [(12,), (0, 5, 6, 24)])
def test_a_replay_that_stops_and_goes_on(spark, stops):
    """Whatever the stops, outcomes and states are those of one replay from the start."""
    rows = _random_rows(11, chats=4)
    told, states = _plain(rows)
    as_frame = lambda own: spark.createDataFrame([tuple(r[c] for c in ("chat", *transactions.COLUMNS)) for r in own], KIND)
    state, outcomes, low = None, {}, 0
    for high in (*stops, 25):
        state = transactions.transact(as_frame([r for r in rows if low <= r["batch"] < high]), state)
        state = transactions.Reduced(*(transactions._kept(x) for x in (state.outcomes, state.records, state.evidence, state.links)))
        outcomes |= {(r.chat, r.batch, r.ordinal): r.outcome for r in state.outcomes.collect()}
        low = high
    assert outcomes == told
    mine = {(r.chat, r.record): r for r in state.records.collect()}
    assert {k: ({c: r[c] for c in transactions.NAMES}, r.evidence_ids) for k, r in mine.items()} == {(c, k): ({x: v[x] for x in transactions.NAMES}, v["refs"]) for c, (records, _, _) in states.items() for k, v in records.items()}
    assert {(r.chat, r.id): (r.record, r.message, r.claim) for r in state.evidence.collect()} == {(c, i): (x[0], x[1], x[4]) for c, (_, evidence, _) in states.items() for i, x in evidence.items()}
    assert sorted((r.chat, r["from"], r["to"]) for r in state.links.collect()) == sorted((c, x[1], x[2]) for c, (_, _, links) in states.items() for x in links)


def test_empty_tables_and_other_keys(spark):
    empty = transactions.transact(spark.createDataFrame([], KIND))
    assert [x.count() for x in (empty.outcomes, empty.records, empty.evidence, empty.links)] == [0, 0, 0, 0]
    rows = [mutation(None, 1, 0, "create", "a", kind="fact", summary="A", evidence=[_claim("x")]), mutation(None, 1, 1, "update", "a", summary="B", related=["a"]), mutation(None, 2, 0, "create", "b", kind="fact", summary="C", related=["a"])]
    found = transactions.transact(spark.createDataFrame([tuple(r[c] for c in ("chat", *transactions.COLUMNS)) for r in rows], KIND))
    assert sorted((r.chat, r.summary, len(r.evidence_ids)) for r in found.records.collect()) == [(None, "B", 1), (None, "C", 0)]
    assert [(r.chat, r["from"], r["to"]) for r in found.links.collect()] == [(None, "a", "b")]
    numbers = spark.createDataFrame([tuple((7 if c == "chat" else r[c]) for c in ("chat", *transactions.COLUMNS)) for r in rows], KIND.replace("chat string", "chat long"))
    assert [r.chat for r in transactions.transact(numbers).records.collect()] == [7, 7]


def test_stream_is_the_batch_reducer(spark, tmp_path):
    """Three micro-batches: outcomes, records, evidence ids and links are those of one batch run."""
    from tidemark.streaming.transactions import transact_stream

    rows = _random_rows(7)
    told, states = _plain(rows)
    as_frame = lambda own: spark.createDataFrame([tuple(r[c] for c in ("chat", *transactions.COLUMNS)) for r in own], KIND)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        (tmp_path / "in").mkdir()
        out = transact_stream(spark.readStream.schema(as_frame(rows[:1]).schema).parquet(f"{tmp_path}/in"))
        for low, high in ((0, 9), (9, 10), (10, 25)):
            as_frame([r for r in rows if low <= r["batch"] < high]).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
            query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r.chat, r.batch, r.ordinal): r.outcome for r in found} == told
    last = {(r.chat, r.record): r for r in sorted(found, key=lambda r: (r.batch, r.ordinal)) if r.fields is not None}
    assert {k: ({c: r.fields[c] for c in transactions.NAMES}, r.evidence_ids) for k, r in last.items()} == {(c, k): ({x: v[x] for x in transactions.NAMES}, v["refs"]) for c, (records, _, _) in states.items() for k, v in records.items()}
    assert sorted((r.chat, x.id) for r in found for x in r.links or []) == sorted((c, x[0]) for c, (_, _, links) in states.items() for x in links)
