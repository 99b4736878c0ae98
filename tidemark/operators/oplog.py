"""The operations log: merging, and failures that nothing recovered since."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.records import keep_newest


def merge_rows(left: DataFrame, right: DataFrame, keys: list[str], newest: int) -> DataFrame:
    """Both logs without repeats: of rows with equal keys the later one, right before left; the newest rows of all."""
    both = left.withColumn("__from", F.lit(0)).unionByName(right.withColumn("__from", F.lit(1)))
    each = both.groupBy(*keys).agg(F.max_by(F.struct(*left.columns), F.struct("at", "__from")).alias("r")).select("r.*")
    return each.orderBy(F.col("at").desc(), *keys).limit(newest)


def unrecovered(log: DataFrame, key: str, at: str, failed, recovered) -> DataFrame:  # noqa: ANN001
    """Failures of a key after its last recovery; a recovery clears what failed before or with it. Rows of null keys are none's; repeats stay."""
    last = log.filter(recovered & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(at).alias("__last"))
    found = log.filter(failed & F.col(key).isNotNull()).join(last, F.col(key) == F.col("__key"), "left")
    return found.filter(F.col("__last").isNull() | (F.col(at) > F.col("__last"))).drop("__key", "__last")


def trim(log: DataFrame, key: str, at: str, most: int, pinned) -> DataFrame:  # noqa: ANN001
    """The newest rows of each key, and the pinned ones whatever their age."""
    return keep_newest(log, key, at, most, pinned)


#: Outcomes that settle a capture, that give it up, and of captures that weren't tried.
SETTLED, GIVEN_UP, NOT_TRIED = ("applied", "noop"), "forfeited", ("skipped", "superseded")


def is_capture_failure() -> Column:
    """A capture of a message that neither settled nor was left out. An abandoned one without a lineage can't be tied to a version."""
    odd = (F.col("outcome") == "stale") & (F.coalesce("lineage", F.lit("")) == "")
    return (F.col("label") == "capture") & F.col("message").isNotNull() & ~F.col("outcome").isin(*SETTLED, GIVEN_UP, *NOT_TRIED) & ~odd


#: Levels of ranges: one of level k has 2^k messages and begins at a multiple of that.
LEVELS = 41


def _cover(start: Column, end: Column) -> Column:
    """The fewest ranges (level, index) that make up the messages from start to end: two of a level at most."""
    zero = F.struct(start.alias("l"), (end + 1).alias("r"), F.expr("cast(array() as array<struct<level: int, index: bigint>>)").alias("out"))

    def step(s: Column, level: Column) -> Column:
        open_ = s["l"] < s["r"]
        low, high = open_ & (s["l"] % 2 == 1), open_ & (s["r"] % 2 == 1) & (s["r"] - 1 > F.when(s["l"] % 2 == 1, s["l"]).otherwise(s["l"] - 1))
        one = lambda index: F.array(F.struct(level.cast("int").alias("level"), index.cast("long").alias("index")))
        none = F.expr("cast(array() as array<struct<level: int, index: bigint>>)")
        out = F.concat(s["out"], F.when(low, one(s["l"])).otherwise(none), F.when(high, one(s["r"] - 1)).otherwise(none))
        half = lambda x: F.shiftright(x, 1).cast("long")
        return F.struct(half(s["l"] + 1).alias("l"), half(s["r"]).alias("r"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), zero, step, lambda s: s["out"])


def _not_covered(failed: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Failures that no later rebuild's range has: both meet by the ranges of a few sizes that make up a rebuild's, of which each message lies in one of a size, so that a chat with many of both is no loop."""
    last = F.lit(2 ** (LEVELS - 1) - 1)
    spans = rebuilt.select("chat", "seen", F.greatest(F.col("start").cast("long"), F.lit(0)).alias("start"), F.least(F.coalesce(F.col("end").cast("long"), last), last).alias("end"))
    each = spans.select("chat", "seen", F.explode(_cover(F.col("start"), F.col("end"))).alias("c")).groupBy("chat", "c.level", "c.index").agg(F.max("seen").alias("seen"))
    own = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.struct(k.alias("level"), F.floor(F.col("message").cast("long") / F.pow(F.lit(2), k)).cast("long").alias("index")))
    met = failed.select("chat", "message", F.explode(own).alias("c")).distinct().select("chat", "message", F.col("c.level").alias("level"), F.col("c.index").alias("index")).join(each, ["chat", "level", "index"])
    top = met.groupBy("chat", "message").agg(F.max("seen").alias("__seen"))
    return failed.join(top, ["chat", "message"], "left").filter(F.col("__seen").isNull() | (F.col("__seen") < F.col("at"))).select(failed.columns)


def capture_failures(log: DataFrame) -> DataFrame:
    """(chat, message, lineage, at): the last failure of each version of a message that nothing since has cleared.

    A settled or given-up capture clears its message's failures of the same lineage (an empty one matches any), a completed rebuild those of its
    range (start to message; no message: to the end), an applied import or reset all. Columns: chat, at, label, outcome, message, lineage, start.
    Failures at the same `at` as what clears them are cleared. Rows without a chat belong to none. Messages count from 0, up to 2^40.
    """
    lineage = F.coalesce("lineage", F.lit(""))
    failed = log.filter(is_capture_failure()).groupBy("chat", "message", lineage.alias("lineage")).agg(F.max("at").alias("at"))
    settled = log.filter((F.col("label") == "capture") & F.col("outcome").isin(*SETTLED, GIVEN_UP)).groupBy("chat", "message", lineage.alias("l")).agg(F.max("at").alias("seen"))
    rebuilt = log.filter((F.col("label") == "rebuild") & (F.col("outcome") == "rebuild-completed") & F.col("start").isNotNull()).select("chat", F.col("at").alias("seen"), "start", F.col("message").alias("end"))
    whole = log.filter(F.col("label").isin("import", "reset") & (F.col("outcome") == "applied")).groupBy("chat").agg(F.max("at").alias("seen"))
    f, s = failed.alias("f"), settled.alias("s")
    own = (F.col("f.chat") == F.col("s.chat")) & (F.col("f.message") == F.col("s.message")) & (F.col("s.seen") >= F.col("f.at")) & ((F.col("f.lineage") == "") | (F.col("s.l") == "") | (F.col("f.lineage") == F.col("s.l")))
    left = f.join(s, own, "left_anti").alias("f")
    left = _not_covered(left.select("f.*"), rebuilt).alias("f")
    w = whole.alias("w")
    return left.join(w, (F.col("f.chat") == F.col("w.chat")) & (F.col("w.seen") >= F.col("f.at")), "left_anti").select("f.*")
