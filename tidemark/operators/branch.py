"""Two versions of a message log: how an edit is classed, what to do about it, and which chats wait for a capture.

Logs have the columns chat, pos, role and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import canonical_text


def _compared(old: DataFrame, new: DataFrame) -> DataFrame:
    version = lambda log, name: log.select("chat", "pos", F.struct("role", canonical_text(F.col("text")).alias("said")).alias(name))
    return version(old, "l").join(version(new, "r"), ["chat", "pos"], "full")


def rewrite_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chat, plan, first_change): none, rebase where each changed row only hides, shows or respells what it said, else destructive.

    first_change is the first pos that differs, -1 for none. A row that only one version has is destructive; null texts are empty.
    """
    level = F.when(F.col("l").eqNullSafe(F.col("r")), 0).when(F.col("l.said").eqNullSafe(F.col("r.said")), 1).otherwise(2)
    rows = _compared(old, new).select("chat", "pos", level.alias("level"))
    plan = F.element_at(F.array(*map(F.lit, ("none", "rebase", "destructive"))), F.max("level") + 1)
    return rows.groupBy("chat").agg(plan.alias("plan"), F.coalesce(F.min(F.when(F.col("level") > 0, F.col("pos"))), F.lit(-1)).alias("first_change"))


def branch_plan(old: DataFrame, new: DataFrame, floors: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(chat, diverges_at, plan) for each chat of either log.

    same: no difference. forward: the new log only appends. Else the old state has to go back to before the first difference:
    journal where the chat's journal reaches it (floors: chat, floor, which is at most diverges_at), checkpoint where a
    snapshot lies before it (checkpoints: chat, pos), fail otherwise.
    """
    differs = ~F.col("l").eqNullSafe(F.col("r"))
    found = _compared(old, new).groupBy("chat").agg(F.coalesce(F.min(F.when(differs, F.col("pos"))), F.lit(-1)).alias("diverges_at"), F.max(F.when(F.col("l").isNotNull(), F.col("pos"))).alias("__last"))
    floor = floors.groupBy("chat").agg(F.min("floor").alias("__floor"))
    first = checkpoints.groupBy("chat").agg(F.min("pos").alias("__point"))
    at = F.col("diverges_at")
    plan = F.when(at < 0, "same").when(F.col("__last").isNull() | (at > F.col("__last")), "forward").when(F.col("__floor") <= at, "journal").when(F.col("__point") < at, "checkpoint").otherwise("fail")
    return found.join(floor, "chat", "left").join(first, "chat", "left").select("chat", "diverges_at", plan.alias("plan"))


def capture_due(log: DataFrame, captured: DataFrame) -> DataFrame:
    """(chat, pos) of chats whose last row is a reply with a text that no capture (chat, pos) has reached."""
    last = log.groupBy("chat").agg(F.max_by(F.struct("pos", "role", "text"), "pos").alias("r")).select("chat", "r.*")
    reached = captured.groupBy("chat").agg(F.max("pos").alias("__reached"))
    waits = (F.col("role") == "assistant") & (F.trim("text") != "") & (F.col("__reached").isNull() | (F.col("__reached") < F.col("pos")))
    return last.join(reached, "chat", "left").filter(waits).select("chat", "pos")
