"""Going back: the state before a message that changed, from the journal or a snapshot; what was given up is parked, and comes back with its messages.

State is rows (chat, key, value), value of any type, a key once in a chat. A journal entry has chat, seq, prev_seq, message, before_message and
lineage_key; its undo rows have chat, seq, key and before (null: the key wasn't there). Lineage is rows (chat, pos, lineage_key) of the log
that the state comes from. Snapshots have chat, message, lineage_key (-1 and `root` for the empty log), their rows chat, message, key and value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import deterministic_id
from tidemark.operators.journal import content_hashes, resumable

JOURNAL, SNAPSHOT, FAIL = "rollback-journal", "exact-checkpoint", "fail-closed"


class Walk:
    """One chat's way back: entries come from the newest, and those on the chain from the head are taken until the cut is reached."""

    def __init__(self, row: dict):
        self.cut, self.floor, self.seq, self.at = row["cut"], row["floor"], row["head_seq"] or 0, row["head_message"]
        self.taken: list[int] = []
        self.broken: int | None = None

    def step(self, row: dict) -> None:
        if row["seq"] is None or self.broken is not None or self.reached():
            return
        if row["seq"] < self.seq or (row["seq"] == self.seq and not row["on_branch"]):
            self.broken = self.seq
        elif row["seq"] == self.seq:
            self.taken.append(self.seq)
            self.seq, self.at = row["prev_seq"], row["before_message"]

    def reached(self) -> bool:
        return self.at is None or self.at < self.cut or self.seq <= 0

    def result(self) -> dict:
        if self.cut - 1 < self.floor:  # beyond the journal
            return {"exact": False, "broken_at": None, "seqs": []}
        broken = self.broken if self.broken is not None else None if self.reached() else self.seq
        return {"exact": self.at is not None and self.at < self.cut, "broken_at": broken, "seqs": self.taken}


def walked(entries: DataFrame, heads: DataFrame, cuts: DataFrame, lineage: DataFrame) -> DataFrame:
    """(chat, exact, broken_at, seqs): for each chat of cuts whether its journal leads back to before the cut, the seq at which its chain breaks, and the entries on the way.

    heads: chat, head_seq, head_message (null: no head), floor (the message from which on the journal is whole; null: -1). cuts: chat, cut, each chat
    once. An entry whose message has another lineage key than it was written with breaks the chain, and so does a missing one. Only entries
    without their undo rows go through a chat's task, in order; they may be any number.
    """
    keys = lineage.select("chat", F.col("pos").alias("message"), F.col("lineage_key").alias("now"))
    own = entries.select("chat", "seq", "prev_seq", "message", "before_message", "lineage_key").join(keys, ["chat", "message"], "left")
    own = own.select("chat", "seq", "prev_seq", "before_message", F.coalesce(F.col("lineage_key") == F.col("now"), F.lit(False)).alias("on_branch"))
    wanted = cuts.select("chat", "cut").join(heads.select("chat", "head_seq", "head_message", F.coalesce("floor", F.lit(-1)).alias("floor")), "chat", "left").withColumn("floor", F.coalesce("floor", F.lit(-1)))
    rows = wanted.join(own, "chat", "left")
    kind = cuts.schema["chat"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, walk, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if walk is None or row["chat"] != own:
                    if walk is not None:
                        out.append({"chat": own, **walk.result()})
                    own, walk = row["chat"], Walk(row)
                walk.step(row)
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if walk is not None:
            out.append({"chat": own, **walk.result()})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    columns = f"chat {kind}, exact boolean, broken_at long, seqs array<long>"
    schema = to_arrow_schema(cuts.sparkSession.createDataFrame([], columns).schema)
    return rows.repartition("chat").sortWithinPartitions("chat", F.col("seq").desc()).mapInArrow(run, columns)


def _on_branch(snapshots: DataFrame, lineage: DataFrame) -> DataFrame:
    """Snapshots whose lineage key is that of the log at their message."""
    at = lineage.select("chat", F.col("pos").alias("message"), F.col("lineage_key").alias("now"))
    there = snapshots.join(at, ["chat", "message"], "left")
    return there.filter(((F.col("message") < 0) & (F.col("lineage_key") == "root")) | ((F.col("message") >= 0) & (F.col("lineage_key") == F.col("now")))).select("chat", "message").distinct()


def unjournaled_since(state: DataFrame, snapshots: DataFrame, snapshot_rows: DataFrame, lineage: DataFrame) -> DataFrame:
    """(chat, since): the earliest message at which a snapshot on the branch holds just the state of now. Chats without one have no row; an empty state equals an empty snapshot."""
    there = _on_branch(snapshots, lineage)
    now = content_hashes(state.select("chat", "key", "value"), "chat").withColumnRenamed("hash", "now")
    rows = snapshot_rows.select(F.struct("chat", "message").alias("of"), "key", "value")
    held = content_hashes(rows, "of").select("of.chat", "of.message", "hash")
    both = there.join(held, ["chat", "message"], "left").join(now, "chat", "left")
    return both.filter(F.coalesce("hash", F.lit("")) == F.coalesce("now", F.lit(""))).groupBy("chat").agg(F.min("message").alias("since"))


def plan(walk: DataFrame, entries: DataFrame, heads: DataFrame, cuts: DataFrame, lineage: DataFrame, state: DataFrame, snapshots: DataFrame, snapshot_rows: DataFrame) -> DataFrame:
    """(chat, cut, action, broken_at): how each chat of cuts gets back to before its cut. walk: of walked().

    rollback-journal where the journal leads there; where a chat has neither entries nor a head, if a snapshot proves that the state has held since
    before the cut. exact-checkpoint where a snapshot on the branch stands just before the cut. Else fail-closed: nothing changes.
    """
    some = entries.select("chat").union(heads.filter("head_message is not null").select("chat")).distinct().withColumn("journaled", F.lit(True))
    since = unjournaled_since(state, snapshots, snapshot_rows, lineage)
    points = _on_branch(snapshots, lineage).select("chat", F.col("message").alias("target"), F.lit(True).alias("point"))
    rows = cuts.select("chat", "cut", (F.col("cut") - 1).alias("target")).join(walk.select("chat", "exact", "broken_at"), "chat", "left").join(some, "chat", "left").join(since, "chat", "left")
    rows = rows.withColumn("target", F.greatest("target", F.lit(-1))).join(points, ["chat", "target"], "left")
    proven = F.col("exact") | (F.col("journaled").isNull() & (F.col("since") <= F.col("target")))
    return rows.select("chat", "cut", F.when(F.coalesce(proven, F.lit(False)), JOURNAL).when(F.col("point"), SNAPSHOT).otherwise(FAIL).alias("action"), "broken_at")


def restored(state: DataFrame, undo: DataFrame, walk: DataFrame, planned: DataFrame, snapshot_rows: DataFrame) -> DataFrame:
    """The state (chat, key, value) after the plan: of each key the earliest before-image on the way, a snapshot's rows, or the state as it is. Chats without a plan keep theirs.

    Every chat and key by itself: nothing goes through a chat's order again.
    """
    ways = walk.join(planned.filter(F.col("action") == JOURNAL).select("chat"), "chat", "left_semi").select("chat", F.explode("seqs").alias("seq"))
    back = undo.join(ways, ["chat", "seq"]).groupBy("chat", "key").agg(F.min_by(F.struct("before"), "seq").alias("b"))
    reset = planned.filter(F.col("action") == SNAPSHOT).select("chat", (F.col("cut") - 1).alias("message"))
    kept = state.join(reset.select("chat"), "chat", "left_anti").join(back.select("chat", "key"), ["chat", "key"], "left_anti").select("chat", "key", "value")
    images = back.filter("b.before is not null").select("chat", "key", F.col("b.before").alias("value"))
    return kept.unionByName(images).unionByName(snapshot_rows.join(reset, ["chat", "message"]).select("chat", "key", "value"))


def kept_entries(entries: DataFrame, planned: DataFrame) -> DataFrame:
    """The journal after the plan: a chat that went back keeps the entries before its cut."""
    back = planned.filter(F.col("action") != FAIL).select("chat", "cut")
    return entries.join(back, "chat", "left").filter(F.col("cut").isNull() | (F.col("message") < F.col("cut"))).drop("cut")


def kept_heads(entries: DataFrame, heads: DataFrame, planned: DataFrame) -> DataFrame:
    """(chat, head_seq, head_message, floor) after the plan; entries: those kept. A chat restored from a snapshot without entries left is exact from its boundary on."""
    last = entries.groupBy("chat").agg(F.max(F.struct("seq", "message")).alias("l"), F.min(F.struct("seq", "before_message")).alias("f"))
    rows = heads.join(planned.select("chat", "cut", "action"), "chat", "left").join(last, "chat", "left")
    went = F.col("action").isNotNull() & (F.col("action") != FAIL)
    floor = F.when(F.col("f").isNotNull(), F.greatest(F.lit(-1), F.col("f.before_message"))).when(F.col("action") == SNAPSHOT, F.col("cut") - 1).otherwise(F.col("floor"))
    return rows.select("chat", F.when(went, F.col("l.seq")).otherwise(F.col("head_seq")).alias("head_seq"), F.when(went, F.col("l.message")).otherwise(F.col("head_message")).alias("head_message"), F.when(went, floor).otherwise(F.col("floor")).alias("floor"))


def _content(value: Column) -> Column:
    return F.sha2(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}).cast("binary"), 256)


def parked(before: DataFrame, after: DataFrame, planned: DataFrame, lineage: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the chats that went back give up: (parks, rows, contents).

    parks: chat, base, base_key, first_key, base_hash, as resumable() takes them, but for the park's number. rows: chat, key, content, for keys whose value differs after going
    back (content is null where the key was not there before). contents: content, value, each different value once: storage grows with what changed. lineage: of the log before.
    A chat whose state is the same after going back parks nothing.
    """
    went = planned.filter(F.col("action") != FAIL).select("chat", (F.col("cut") - 1).alias("base"))
    left = before.join(went.select("chat"), "chat", "left_semi").select("chat", "key", F.struct("value").alias("l"))
    right = after.join(went.select("chat"), "chat", "left_semi").select("chat", "key", F.struct("value").alias("r"))
    differ = left.join(right, ["chat", "key"], "full").filter(~F.col("l").eqNullSafe(F.col("r")))
    rows = differ.select("chat", "key", F.when(F.col("l").isNotNull(), _content(F.col("l.value"))).alias("content"), F.col("l.value").alias("value"))
    keys = lambda shift, name: lineage.select("chat", (F.col("pos") - shift).alias("base"), F.col("lineage_key").alias(name))
    bases = went.join(rows.select("chat").distinct(), "chat", "left_semi").join(keys(1, "first_key"), ["chat", "base"]).join(keys(0, "base_key"), ["chat", "base"], "left")
    hashes = content_hashes(after.select("chat", "key", "value"), "chat").withColumnRenamed("hash", "base_hash")
    parks = bases.join(hashes, "chat", "left").select("chat", "base", F.when(F.col("base") < 0, "root").otherwise(F.col("base_key")).alias("base_key"), "first_key", F.coalesce("base_hash", F.lit("")).alias("base_hash"))
    own = rows.join(parks.select("chat"), "chat", "left_semi")
    return parks, own.select("chat", "key", "content"), own.filter("content is not null").groupBy("content").agg(F.first("value").alias("value"))


def relinked(parks: DataFrame, old: DataFrame, new: DataFrame, proven: DataFrame, marks: DataFrame) -> DataFrame:
    """parks with the keys of a log whose rows before `proven` (chat, proven) changed in nothing that counts: base_key as it is there now, first_key chained from it.

    old, new: lineage before and after. marks: (chat, pos, fingerprint) of the parked rows. A park whose base isn't in that part, or whose key is not
    the old one there, stays as it is.
    """
    at = lambda df, name: df.select("chat", F.col("pos").alias("base"), F.col("lineage_key").alias(name))
    first = marks.select("chat", (F.col("pos") - 1).alias("base"), F.col("fingerprint").alias("mark"))
    rows = parks.join(at(old, "was"), ["chat", "base"], "left").join(at(new, "now"), ["chat", "base"], "left").join(proven, "chat", "left").join(first, ["chat", "base"], "left")
    fits = (F.col("base") >= 0) & (F.col("base") < F.col("proven")) & (F.col("base_key") == F.col("was")) & (F.col("now") != F.col("base_key")) & F.col("mark").isNotNull()
    changed = F.coalesce(fits, F.lit(False))
    return rows.withColumns({"first_key": F.when(changed, deterministic_id("ln", F.col("now"), F.col("mark"))).otherwise(F.col("first_key")), "base_key": F.when(changed, F.col("now")).otherwise(F.col("base_key"))}).select(parks.columns)


def resumed(state: DataFrame, parks: DataFrame, rows: DataFrame, contents: DataFrame, lineage: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, state): for each chat whose log leads back to parked messages the newest park that fits (chat, park), and all chats' state with it.

    parks: with `park`, a number; rows: chat, park, key, content. states: chat, hash, journal_top, as resumable() takes them; hashes of empty states are empty.
    """
    chosen = resumable(parks, lineage, states)
    own = rows.join(chosen, ["chat", "park"]).join(contents.withColumn("there", F.lit(True)), "content", "left")
    kept = state.join(own.select("chat", "key"), ["chat", "key"], "left_anti").select("chat", "key", "value")
    return chosen, kept.unionByName(own.filter("content is not null").select("chat", "key", "value"))
