"""Changes of keyed state: before-images, states as of a point, restoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _by_key(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, struct of the other columns); a key that is there twice fails."""
    own = F.struct(*(c for c in rows.columns if c != key))
    each = rows.groupBy(key).agg(F.first(own).alias(name), F.count("*").alias("times"))
    return each.select(key, F.when(F.col("times") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(each.schema[name].dataType)).otherwise(F.col(name)).alias(name))


def keyed_undo(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change, before): what to put back to get from `after` to `before`; `before` is a struct of the other columns, null for an added row.

    A key is there once in each: a repeated one fails, as a row that is put back couldn't tell which it stands for. Rows of null keys are each other's.
    """
    left, right = _by_key(before, key, "l"), _by_key(after.select(before.columns), key, "r")
    both = left.withColumnRenamed(key, "__left").join(right.withColumnRenamed(key, "__right"), F.col("__left").eqNullSafe(F.col("__right")), "full").filter(~F.col("l").eqNullSafe(F.col("r")))
    return both.select(F.coalesce("__left", "__right").alias(key), F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").otherwise("changed").alias("change"), F.col("l").alias("before"))


def apply_undo(after: DataFrame, undo: DataFrame, key: str) -> DataFrame:
    """The state before: rows that didn't change, and the before-images."""
    back = undo.filter("before is not null").select(key, "before.*").select(after.columns)
    return after.join(undo.select(key), key, "left_anti").select(after.columns).unionByName(back)


def changelog(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows with before_value, which replaces a column of that name: the key's value before each row (null at first). Rows at one place come in any order."""
    from pyspark.sql import Window

    return rows.withColumn("before_value", F.lag(value).over(Window.partitionBy(key).orderBy(order)))


def state_as_of(log: DataFrame, key: str, order: str, value: str, at) -> DataFrame:  # noqa: ANN001
    """(key, value) as of a point: the earliest before-image after it, else the newest value. Keys first seen later have none. Of several changes at one place any one's image or value counts: give them places of their own."""
    later = F.col(order) > at
    first = F.min_by(F.struct(F.col("before_value").alias("v")), F.when(later, F.col(order)))
    found = log.groupBy(key).agg(first.alias("b"), F.max_by(value, order).alias("now"), F.max(later.cast("int")).alias("changed"), F.min(order).alias("born"))
    return found.filter(F.col("born") <= at).select(key, F.when(F.col("changed") == 1, F.col("b.v")).otherwise(F.col("now")).alias(value))


def referenced(rows: DataFrame, key: str, references: DataFrame, reference: str) -> DataFrame:
    """Only the rows that something refers to."""
    return rows.join(references.select(F.col(reference).alias(key)), key, "left_semi")


def same_state(left: DataFrame, right: DataFrame) -> bool:
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def coalesce_boundaries(log: DataFrame, key: str, boundary: str, order: str, value: str, newest: int = 256) -> DataFrame:
    """(key, boundary, seq, before, after): a journal with one entry for each boundary of a key and the newest entries kept.

    An entry takes the earliest before-image and the latest value; seq counts a key's boundaries from 1. log has before_value.
    """
    from pyspark.sql import Window

    entries = log.groupBy(key, boundary).agg(F.min_by(F.struct("before_value"), order).alias("b"), F.max_by(F.struct(value), order).alias("a"))
    own = Window.partitionBy(key)
    numbered = entries.withColumns({"seq": F.row_number().over(own.orderBy(boundary)), "__n": F.count("*").over(own)})
    return numbered.filter(F.col("seq") > F.col("__n") - newest).select(key, boundary, "seq", F.col("b.before_value").alias("before"), F.col(f"a.{value}").alias("after"))


def exact_checkpoint(wanted: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(chat, message, seq): the newest snapshot at just that message and lineage; below 0 the root's, whatever its lineage.

    wanted: chat, message, lineage (null: none). checkpoints: chat, message, lineage, seq; those without a snapshot aren't among them.
    """
    root = F.col("w.message") < 0
    at = (F.col("w.chat") == F.col("c.chat")) & (F.col("c.message") == F.greatest(F.col("w.message"), F.lit(-1))) & (root | (F.col("w.lineage") == F.col("c.lineage")))
    found = wanted.alias("w").join(checkpoints.alias("c"), at, "left")
    return found.groupBy(F.col("w.chat").alias("chat"), F.col("w.message").alias("message")).agg(F.when(F.col("w.message") < 0, F.min("c.seq")).otherwise(F.max("c.seq")).alias("seq"))


def rebase_lineage(rows: DataFrame, lineage: DataFrame) -> DataFrame:
    """rows with the lineage key that their chat's new lineage has at their message; rows beyond it keep theirs. rows: chat, message, lineage; lineage: chat, pos, lineage_key."""
    new = lineage.select(F.col("chat"), F.col("pos").alias("message"), F.col("lineage_key").alias("__new"))
    return rows.join(new, ["chat", "message"], "left").withColumn("lineage", F.coalesce("__new", "lineage")).select(rows.columns)


def positioned_undo(before: DataFrame, after: DataFrame, key: str, place: str = "place") -> DataFrame:
    """keyed_undo() with `at`, the place where a removed row stood (null for other changes); a place alone is no change."""
    rows = keyed_undo(before.drop(place), after.drop(place), key)
    stood = before.select(key, F.col(place).alias("at"))
    return rows.join(stood, key, "left").withColumn("at", F.when(F.col("change") == "removed", F.col("at")))


def restore_positioned(after: DataFrame, undo: DataFrame, key: str, place: str = "place", of: str | None = None) -> DataFrame:
    """The rows before, with their places: kept rows in their order, and what was removed put back where it stood.

    A row put back at `at` has that place in the result; kept rows fill the other places in order. Exact for places that count from 0. of: the column that says
    which list a row is in; each list is one window, so name it where there are many. An added row's undo has no `before`, and needs none.
    """
    from pyspark.sql import Window

    columns = [c for c in after.columns if c != place]
    kept = after.join(undo.filter("change = 'added'").select(key), key, "left_anti").join(undo.filter("change = 'changed'").select(key, "before"), key, "left")
    kept = kept.select(key, place, *(F.when(F.col("before").isNotNull(), F.col(f"before.{c}")).otherwise(F.col(c)).alias(c) for c in columns if c != key))
    back = undo.filter("change = 'removed'").select(key, F.col("at").alias(place), "before.*").select(kept.columns)
    own = F.col(of) if of else F.lit(0)
    # The j-th place that is taken has place - j free ones before it; a kept row comes after all taken ones with no more free ones than it has kept rows before it.
    numbered = lambda df, taken: df.withColumn("__n", (F.row_number().over(Window.partitionBy(own).orderBy(place)) - 1).cast("long")).withColumn("__taken", F.lit(taken))
    rows = numbered(back, 1).withColumn("__free", F.col(place) - F.col("__n")).unionByName(numbered(kept, 0).withColumn("__free", F.col("__n")))
    before = F.sum("__taken").over(Window.partitionBy(own).orderBy("__free", F.col("__taken").desc(), "__n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    slot = F.when(F.col("__taken") == 1, F.col(place).cast("long")).otherwise(F.col("__n") + before)
    return rows.withColumn("__slot", slot).select(key, F.col("__slot").alias(place), *(c for c in columns if c != key))


def trim_journal(entries: DataFrame, newest: int = 256) -> DataFrame:
    """(chat, seq, prev_seq, before_message, floor): the newest entries of each chat; the first one's prev_seq is 0, and its boundary the floor (-1 at least)."""
    from pyspark.sql import Window

    own = Window.partitionBy("chat")
    kept = entries.withColumn("__n", F.row_number().over(own.orderBy(F.col("seq").desc()))).filter(F.col("__n") <= newest)
    floor = F.greatest(F.lit(-1), F.first("before_message").over(own.orderBy("seq")))
    first = F.row_number().over(own.orderBy("seq")) == 1
    return kept.select("chat", "seq", F.when(first, F.lit(0)).otherwise(F.col("prev_seq")).alias("prev_seq"), "before_message", floor.alias("floor"))


def resumable(parks: DataFrame, lineage: DataFrame, states: DataFrame) -> DataFrame:
    """(chat, park): the newest parked branch of each chat that its log leads back to.

    A park has chat, park (its number), base, base_key, first_key and base_hash. It fits where the log's key at base is base_key (none for -1),
    that after it first_key, and the chat's state now is that at the base. states: chat, hash, journal_top (the last message with a journal
    entry, which may not lie beyond base). lineage: chat, pos, lineage_key.
    """
    at = lineage.select("chat", F.col("pos").alias("base"), F.col("lineage_key").alias("k0"))
    after = lineage.select("chat", (F.col("pos") - 1).alias("base"), F.col("lineage_key").alias("k1"))
    both = parks.join(after, ["chat", "base"]).filter(F.col("k1") == F.col("first_key")).join(at, ["chat", "base"], "left").filter((F.col("base") < 0) | (F.col("k0") == F.col("base_key")))
    fits = both.join(states, "chat").filter((F.coalesce("journal_top", F.lit(-1)) <= F.col("base")) & (F.col("base_hash") == F.col("hash")))
    return fits.groupBy("chat").agg(F.max("park").alias("park"))


def content_hashes(rows: DataFrame, key: str) -> DataFrame:
    """(key, hash): what a key's rows hold, whatever their order: a sum over the hashes of rows and their number. Repeated rows count."""
    columns = sorted(c for c in rows.columns if c != key)
    own = F.conv(F.substring(F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(key).agg(F.concat_ws(":", F.count("*"), F.sum(own)).alias("hash"))


def integrity_faults(records: DataFrame, evidence: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, id, other): ids that are there twice, and references that lead nowhere, as a strict reading refuses them.

    records: id, evidence_ids, caused_by. evidence: id, record_ids. links: from, to. Null references lead nowhere.
    """
    twice = lambda df, kind: df.groupBy("id").count().filter("count > 1").select(F.lit(kind).alias("kind"), "id", F.lit(None).cast("string").alias("other"))

    def lost(df: DataFrame, own: str, refs, there: DataFrame, kind: str) -> DataFrame:  # noqa: ANN001
        each = df.select(F.col(own).cast("string").alias("id"), F.explode(refs).alias("other")).withColumn("other", F.col("other").cast("string")).distinct()
        return each.join(there.select(F.col("id").cast("string").alias("other")), "other", "left_anti").select(F.lit(kind).alias("kind"), "id", "other")

    ids = [x.withColumn("id", F.col("id").cast("string")) for x in (twice(records, "repeated record"), twice(evidence, "repeated evidence"))]
    found = [*ids, lost(records, "id", F.col("evidence_ids"), evidence, "no evidence"), lost(records, "id", F.col("caused_by"), records, "no cause"), lost(evidence, "id", F.col("record_ids"), records, "no record"), lost(links, "from", F.array("from", "to"), records, "no end")]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
