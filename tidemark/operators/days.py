"""Days that pass step by step: "the next morning" counts as a day only together with others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import elapsed
from tidemark.functions.narrative import sanitized

_START = "cast(named_struct('steps', array(), 'fired', null, 'counted', false, 'role', '', 'told', false, 'echo', '') as struct<steps: array<bigint>, fired: array<bigint>, counted: boolean, role: string, told: boolean, echo: string>)"


def told_steps(log: DataFrame) -> DataFrame:
    """(chat, pos, role, blank, skip, step): what each row tells: nothing, a meaningful skip of time, or a day's step (its words; empty for none). System rows go; null roles are replies."""
    role = F.when(F.col("role") == "user", "user").otherwise("assistant")
    rows = log.filter("pos is not null and coalesce(role, '') <> 'system'").select("chat", "pos", role.alias("role"), sanitized(F.col("text"), role).alias("text"))
    skip = F.exists(elapsed.established(F.col("text")), lambda p: p["meaningful"])
    read = rows.select("chat", "pos", "role", (F.trim("text") == "").alias("blank"), skip.alias("skip"), elapsed.day_step(F.col("text")).alias("step"))
    return read.withColumn("step", F.when(F.col("skip"), "").otherwise(F.col("step")))


def _walk(threshold: int):
    def step(s: Column, r: Column) -> Column:
        told = s["told"]
        new_turn = (r["role"] == "user") & (s["role"] == "assistant")
        counted, echo = F.when(new_turn, False).otherwise(s["counted"]), F.when(new_turn, "").otherwise(s["echo"])
        follows = new_turn & told
        # What the row says: a blank one nothing; a skip starts the count anew; a user who takes up the narrator's day, and a narrator who repeats it, tell the same day.
        says = ~r["blank"] & ~r["skip"] & (r["step"] != "")
        echoes = says & follows
        repeats = says & ~echoes & (r["role"] == "assistant") & (echo != "") & (r["step"] == echo)
        counts = says & ~echoes & ~repeats & ~counted
        skips = ~r["blank"] & r["skip"]
        steps = F.when(skips, F.expr("cast(array() as array<bigint>)")).when(counts, F.concat(s["steps"], F.array(r["pos"].cast("long")))).otherwise(s["steps"])
        full = counts & (F.size(steps) >= threshold)
        return F.struct(
            F.when(full, F.expr("cast(array() as array<bigint>)")).otherwise(steps).alias("steps"), F.when(skips, F.lit(None)).when(full, steps).otherwise(s["fired"]).alias("fired"),
            (counted | skips | repeats | counts).alias("counted"), r["role"].alias("role"), F.when(r["role"] == "assistant", says).otherwise(told).alias("told"), F.when(echoes, r["step"]).otherwise(echo).alias("echo"),
        )

    return step


def accumulated(steps: DataFrame, since: DataFrame | None = None, lookback: int = 40, threshold: int = 2) -> DataFrame:
    """(chat, pos, fired_at, n_days): for each row as the end, the last message at which so many day's steps had added up, and how many.

    steps: of told_steps(). The walk goes over the `lookback` places up to the end, from after `since` (chat, since) where that is given; an exchange
    counts one day at most; a skip that is told outright, and each time the count is full, start it anew. Ends at which nothing has added up have no row.
    Each end reads its own few rows, so that a long chat is no longer walk. Rows at one place come in the order of their words.
    """
    lookback, threshold = max(1, min(200, lookback)), max(2, threshold)
    if since is not None:
        steps = steps.join(since.groupBy("chat").agg(F.max("since").alias("since")), "chat", "left").filter(F.col("since").isNull() | (F.col("pos") > F.col("since")))
    near = Window.partitionBy("chat").orderBy("pos").rangeBetween(1 - lookback, 0)
    rows = steps.withColumn("pos", F.col("pos").cast("long")).withColumn("near", F.array_sort(F.collect_list(F.struct("pos", "role", "blank", "skip", "step")).over(near)))
    fired = F.aggregate("near", F.expr(_START), _walk(threshold), lambda s: s["fired"])
    done = rows.select("chat", "pos", fired.alias("fired")).filter("fired is not null").distinct()
    return done.select("chat", "pos", F.element_at("fired", -1).alias("fired_at"), F.size("fired").cast("long").alias("n_days"))


def continuity_hints(log: DataFrame, since: DataFrame | None = None, most: int = 4, lookback: int = 40, threshold: int = 2) -> DataFrame:
    """(chat, kind, at, amount, unit, meaningful): what each chat's newest exchange, of `most` rows at most, says of time that has passed.

    explicit: a meaningful skip that it tells outright, the newest. Else accumulated: the day's steps that have added up, if they did so within the exchange. Else the newest
    explicit phrase, though it isn't meaningful. Chats whose exchange says nothing have no row. log: chat, pos, role, text; since: (chat, since), where days were last counted.
    """
    from tidemark.operators.log import newest_rows

    last = log.filter("role = 'assistant'").groupBy(F.struct("chat").alias("who")).agg(F.max("pos").alias("end_pos"))
    rows = newest_rows(log, most).withColumn("who", F.struct("chat")).join(last, ["who", "end_pos"]).select("who", "pos", "text", "role")
    told = rows.select("who", "pos", F.posexplode(elapsed.established(sanitized(F.col("text"), F.col("role")))).alias("k", "p"))
    explicit = told.groupBy("who").agg(F.max(F.struct(F.col("p.meaningful").alias("m"), "pos", "k", F.col("p.amount").alias("amount"), F.col("p.unit").alias("unit"))).alias("e"))
    window = rows.groupBy("who").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    added = accumulated(told_steps(log), since, lookback, threshold).select(F.struct("chat").alias("who"), F.col("pos").alias("last"), "fired_at", "n_days")
    days_ = window.join(added, ["who", "last"]).filter(F.col("fired_at") >= F.col("first")).select("who", "fired_at", "n_days")
    both = window.join(explicit, "who", "left").join(days_, "who", "left").withColumn("by_days", ~F.coalesce("e.m", F.lit(False)) & F.col("fired_at").isNotNull()).filter(F.col("e").isNotNull() | F.col("by_days"))
    pick = lambda a, b: F.when(F.col("by_days"), a).otherwise(b)
    return both.select("who.chat", pick(F.lit("accumulated"), F.lit("explicit")).alias("kind"), pick(F.col("fired_at"), F.col("e.pos").cast("long")).alias("at"), pick(F.col("n_days"), F.col("e.amount").cast("long")).alias("amount"), pick(F.lit("day"), F.col("e.unit")).alias("unit"), pick(F.lit(True), F.col("e.m")).alias("meaningful"))
