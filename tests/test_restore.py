"""Going back, parking and resuming, on small histories."""

import random

import pytest

from tidemark.operators import journal, restore

ENTRY = "chat string, seq long, prev_seq long, message long, before_message long, lineage_key string"
HEAD, CUT, LINE = "chat string, head_seq long, head_message long, floor long", "chat string, cut long", "chat string, pos long, lineage_key string"
STATE, UNDO = "chat string, key string, value long", "chat string, seq long, key string, before long"
SNAP, SNAP_ROWS = "chat string, message long, lineage_key string", "chat string, message long, key string, value long"


class History:
    """Chats whose messages change keys; what a plain fold of their prefixes gives."""

    def __init__(self, seed: int, chats: int = 12, length: int = 30):
        rng = random.Random(seed)
        self.changes = {f"c{k}": [{rng.choice("abcd"): rng.choice((None, rng.randint(0, 9))) for _ in range(rng.randint(0, 3))} for _ in range(rng.randint(1, length))] for k in range(chats)}
        self.cuts = {c: rng.randint(0, len(x)) for c, x in self.changes.items()}

    def prefix(self, chat: str, n: int) -> dict:
        own: dict = {}
        for change in self.changes[chat][:n]:
            for k, v in change.items():
                if v is None:
                    own.pop(k, None)
                else:
                    own[k] = v
        return own

    def tables(self, spark, newest: int = 1000, points: int = 7) -> dict:
        entries, undo, heads, lineage, state, snaps, rows = [], [], [], [], [], [], []
        for chat, changes in self.changes.items():
            own, seq, at = [], 0, -1
            for pos in range(len(changes)):
                lineage.append((chat, pos, f"k{pos}"))
                before, after = self.prefix(chat, pos), self.prefix(chat, pos + 1)
                if before != after:
                    own.append((chat, seq + 1, seq, pos, at, f"k{pos}"))
                    undo += [(chat, seq + 1, k, before.get(k)) for k in before.keys() | after.keys() if before.get(k) != after.get(k)]
                    seq, at = seq + 1, pos
                if pos % points == 0:
                    snaps.append((chat, pos, f"k{pos}"))
                    rows += [(chat, pos, k, v) for k, v in after.items()]
            kept = own[-newest:]
            entries += kept
            heads.append((chat, seq or None, at if seq else None, kept[0][4] if kept and kept[0][4] >= 0 else -1))
            state += [(chat, k, v) for k, v in self.prefix(chat, len(changes)).items()]
        make = spark.createDataFrame
        return {"entries": make(entries, ENTRY), "undo": make(undo, UNDO), "heads": make(heads, HEAD), "cuts": make(list(self.cuts.items()), CUT), "lineage": make(lineage, LINE), "state": make(state, STATE), "snapshots": make(snaps, SNAP), "snapshot_rows": make(rows, SNAP_ROWS)}


def _plan(t, cuts=None):
    walk = restore.walked(t["entries"], t["heads"], t["cuts"], t["lineage"])
    return walk, restore.plan(walk, t["entries"], t["heads"], t["cuts"], t["lineage"], t["state"], t["snapshots"], t["snapshot_rows"])


def _state(df):
    out = {}
    for r in df.collect():
        assert r.key not in out.setdefault(r.chat, {})
        out[r.chat][r.key] = r.value
    return out


@pytest.mark.parametrize(("seed", "newest"), [(1, 1000), (2, 5), (3, 2)])
def test_state_is_that_of_the_prefix(spark, seed, newest):
    h = History(seed)
    t = h.tables(spark, newest)
    walk, plan = _plan(t)
    actions = {r.chat: r.action for r in plan.collect()}
    found = _state(restore.restored(t["state"], t["undo"], walk, plan, t["snapshot_rows"]))
    for chat, cut in h.cuts.items():
        want = h.prefix(chat, len(h.changes[chat]) if actions[chat] == restore.FAIL else cut)
        assert found.get(chat, {}) == want, (chat, actions[chat])
    if newest == 1000:
        assert restore.FAIL not in {a for c, a in actions.items() if any(h.changes[c])}


def test_broken_chains_are_named(spark):
    t = History(1).tables(spark)
    make = spark.createDataFrame
    t["entries"] = make([("m", 1, 0, 0, -1, "k0"), ("m", 3, 2, 2, 1, "k2"), ("e", 1, 0, 0, -1, "k0"), ("e", 2, 1, 1, 0, "k1"), ("w", 1, 0, 0, -1, "k0"), ("w", 2, 1, 1, 0, "k1"), ("n", 1, 0, 0, -1, "k0")], ENTRY)
    t["heads"] = make([("m", 3, 2, -1), ("e", 2, 1, -1), ("w", 2, 1, -1), ("n", None, None, None)], HEAD)
    t["cuts"] = make([(c, 0) for c in "mewnx"], CUT)
    t["lineage"] = make([(c, k, "changed" if (c, k) == ("e", 0) else f"k{k}") for c in "mewn" for k in range(3)], LINE)
    walk, plan = _plan({**t, "state": t["state"].limit(0), "snapshots": t["snapshots"].limit(0), "snapshot_rows": t["snapshot_rows"].limit(0)})
    assert {r.chat: (r.action, r.broken_at) for r in plan.collect()} == {"m": (restore.FAIL, 2), "e": (restore.FAIL, 1), "w": (restore.JOURNAL, None), "n": (restore.FAIL, None), "x": (restore.FAIL, None)}


def test_a_state_that_nothing_changed_since_is_proven_by_a_snapshot(spark):
    make = spark.createDataFrame
    t = {"entries": make([], ENTRY), "heads": make([], HEAD), "cuts": make([("a", 3), ("b", 3), ("c", 1)], CUT), "lineage": make([(c, k, f"k{k}") for c in "abc" for k in range(5)], LINE), "state": make([("a", "x", 1), ("b", "x", 2), ("c", "x", 1)], STATE)}
    t |= {"snapshots": make([("a", 1, "k1"), ("a", 4, "k4"), ("b", 1, "k1"), ("c", 1, "k1")], SNAP), "snapshot_rows": make([("a", 1, "x", 1), ("a", 4, "x", 1), ("b", 1, "x", 1), ("c", 1, "x", 1)], SNAP_ROWS)}
    assert {r.chat: r.action for r in _plan(t)[1].collect()} == {"a": restore.JOURNAL, "b": restore.FAIL, "c": restore.FAIL}


def test_what_is_kept_after_going_back(spark):
    h = History(5)
    t = h.tables(spark)
    _, plan = _plan(t)
    actions = {r.chat: r.action for r in plan.collect()}
    entries = restore.kept_entries(t["entries"], plan)
    assert all(r.message < h.cuts[r.chat] or actions[r.chat] == restore.FAIL for r in entries.collect())
    heads = {r.chat: r for r in restore.kept_heads(entries, t["heads"], plan).collect()}
    for chat in h.cuts:
        own = [r for r in entries.collect() if r.chat == chat]
        last = max(own, key=lambda r: r.seq, default=None)
        if actions[chat] != restore.FAIL:
            assert (heads[chat].head_seq, heads[chat].head_message) == ((last.seq, last.message) if last else (None, None))


def test_parked_states_come_back(spark):
    h = History(4)
    t = h.tables(spark)
    walk, plan = _plan(t)
    after = restore.restored(t["state"], t["undo"], walk, plan, t["snapshot_rows"])
    parks, rows, contents = restore.parked(t["state"], after, plan, t["lineage"])
    # Only keys that differ are stored, and each value once.
    before, then = _state(t["state"]), _state(after)
    differ = {(c, k) for c in h.cuts for k in before.get(c, {}).keys() | then.get(c, {}).keys() if before.get(c, {}).get(k) != then.get(c, {}).get(k)}
    assert {(r.chat, r.key) for r in rows.collect()} == differ and contents.count() <= 10
    hashes = journal.content_hashes(after, "chat").withColumnRenamed("hash", "h")
    states = t["cuts"].join(hashes, "chat", "left").selectExpr("chat", "coalesce(h, '') as hash", "cut - 1 as journal_top")
    chosen, back = restore.resumed(after, parks.selectExpr("*", "3 as park"), rows.selectExpr("*", "3 as park"), contents, t["lineage"], states)
    assert {r.chat for r in chosen.collect()} == {c for c, _ in differ}
    assert _state(back) == before
    # Other messages after the base: nothing comes back.
    other = t["lineage"].selectExpr("chat", "pos", "concat('o', lineage_key) as lineage_key")
    assert restore.resumed(after, parks.selectExpr("*", "3 as park"), rows.selectExpr("*", "3 as park"), contents, other, states)[0].count() == 0


def test_parks_follow_a_prefix_that_was_rewritten(spark):
    make = spark.createDataFrame
    old, new = (make([("a", 0, f"{x}0"), ("a", 1, f"{x}1"), ("b", 0, f"{x}0")], LINE) for x in "on")
    parks = make([("a", 1, "o1", "f", "h"), ("a", 0, "other", "f", "h"), ("b", 0, "o0", "f", "h"), ("b", -1, "root", "f", "h")], "chat string, base long, base_key string, first_key string, base_hash string")
    marks = make([("a", 2, "mark"), ("b", 1, "mark")], "chat string, pos long, fingerprint string")
    found = {(r.chat, r.base): (r.base_key, r.first_key) for r in restore.relinked(parks, old, new, make([("a", 2), ("b", 0)], "chat string, proven long"), marks).collect()}
    from tidemark.operators.log import _fnv

    assert found == {("a", 1): ("n1", "ln_" + _fnv("n1|mark")), ("a", 0): ("other", "f"), ("b", 0): ("o0", "f"), ("b", -1): ("root", "f")}


def test_empty_tables(spark):
    t = {k: v.limit(0) for k, v in History(1, 2).tables(spark).items()}
    walk, plan = _plan(t)
    after = restore.restored(t["state"], t["undo"], walk, plan, t["snapshot_rows"])
    assert plan.count() == after.count() == 0 and [x.count() for x in restore.parked(t["state"], after, plan, t["lineage"])] == [0, 0, 0]
