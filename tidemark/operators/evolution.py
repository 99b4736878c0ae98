"""Which records to evaluate again, and as of when."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def boundary(evaluated: str = "evaluated", changed: str = "changed", created: str = "created"):  # noqa: ANN201
    """When a record was last looked at; -1 where it never was."""
    return F.coalesce(F.col(evaluated), F.col(changed), F.col(created), F.lit(-1))


def due(records: DataFrame, elapsed: DataFrame, evidence: DataFrame, most: int = 6) -> DataFrame:
    """(chat, id, reason): of each chat the first `most` records, by id, that time or newer evidence has overtaken.

    records: chat, id, boundary. elapsed: chat, pos of the newest time step. evidence: chat, id, pos. Time is the reason named first.
    """
    step = elapsed.groupBy("chat").agg(F.max("pos").alias("__step"))
    newest = evidence.groupBy("chat", "id").agg(F.max("pos").alias("__seen"))
    reason = F.when(F.col("__step") > F.col("boundary"), "time").when(F.col("__seen") > F.col("boundary"), "evidence")
    waiting = records.join(step, "chat", "left").join(newest, ["chat", "id"], "left").withColumn("reason", reason).filter("reason is not null")
    rank = F.row_number().over(Window.partitionBy("chat").orderBy("id"))
    return waiting.withColumn("__rank", rank).filter(F.col("__rank") <= most).select("chat", "id", "reason")


def background(records: DataFrame, cursor: int, scan: int = 32, most: int = 3) -> DataFrame:
    """(chat, id): of each chat's `scan` records from a cursor on, in the order of ids and round to the start, the `most` that were looked at least recently."""
    own = Window.partitionBy("chat")
    place = records.withColumns({"__at": F.row_number().over(own.orderBy("id")) - 1, "__n": F.count("*").over(own)})
    near = place.filter(F.pmod(F.col("__at") - cursor, F.col("__n")) < scan)
    return near.withColumn("__rank", F.row_number().over(own.orderBy("boundary", "id"))).filter(F.col("__rank") <= most).select("chat", "id")


def allowed_evidence(evidence: DataFrame, key: str, order: str, kind: str, allowed: tuple[str, ...], most: int = 4) -> DataFrame:
    """Each key's newest rows of the allowed kinds, with their place in order from 1."""
    ranked = evidence.filter(F.col(kind).isin(*allowed)).withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc())))
    return ranked.filter(F.col("__rank") <= most).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order))).drop("__rank")


def as_of(points: DataFrame, steps: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """points with the value of the key's newest step at or before each; null where there is none.

    Both sides are streamed once in order, so that a key of any size takes constant memory and no pairs are made.
    """
    kind = steps.schema[value].dataType
    both = steps.select(key, order, F.struct(F.col(value).alias("v")).alias("__step"), F.lit(0).alias("__point")).unionByName(
        points.select(key, order, F.lit(None).cast(f"struct<v:{kind.simpleString()}>").alias("__step"), F.lit(1).alias("__point"))
    )
    before = Window.partitionBy(key).orderBy(order, "__point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("__step", F.last("__step", ignorenulls=True).over(before)).filter("__point = 1").select(key, order, F.col("__step.v").alias(value))


def causal_support(evaluations: DataFrame, supports: DataFrame) -> DataFrame:
    """(evaluation, known, triggers, supported) of each evaluation.

    supported: a change may rest on current evidence, or on meaningful time together with older evidence. triggers: how many supports are
    of time or current. known: whether all that it cites are there. evaluations: evaluation, support_ids. supports: id, type, meaningful.
    """
    each = evaluations.select("evaluation", F.explode_outer(F.array_distinct("support_ids")).alias("id")).join(supports, "id", "left")
    has = lambda c: F.coalesce(F.max(c), F.lit(False))
    kind = F.col("type")
    supported = has(kind == "current") | (has((kind == "time") & F.col("meaningful")) & has(kind == "historical"))
    return each.groupBy("evaluation").agg((F.count("id") == F.count("type")).alias("known"), F.count_if(kind.isin("time", "current")).alias("triggers"), supported.alias("supported"))
