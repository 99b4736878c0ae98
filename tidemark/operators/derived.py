"""Proposals of what follows from records: rules on their causes and supports, and the evidence that they inherit.

proposals: id (each once), causes and supports (arrays of ids), summary, anchors. supports: id (each once), type (current, time, historical), meaningful,
record_ids (whose support it is), message, lineage, source_class, claim, time_anchor. targets: id (each once), summary; the records at hand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import lexical, wording
from tidemark.operators import consolidation
from tidemark.operators.shared import cut, shuffled

#: The rules in order; the first that fails is the reason.
REASONS = ("causes are no targets", "unknown support", "support of no cause", "cause without support", "too few causes", "no causal support", "only hearsay", "already there", "was there before")


def judged(proposals: DataFrame, supports: DataFrame, targets: DataFrame, records: DataFrame, same: float = 0.78) -> DataFrame:
    """(id, reason, duplicate): the first rule that a proposal fails, null if it holds, and the record that it repeats.

    records: id, kind, status, summary, anchors, as consolidation takes them; a proposal is a development. Proposals, causes and supports meet by equality and sums of
    flags: none of them is a list in one task. Null lists are empty; supports that a proposal names twice count once.
    """
    own = proposals.select("id", "summary", "anchors", F.array_distinct(F.coalesce("causes", F.array().cast(proposals.schema["causes"].dataType))).alias("causes"), F.array_distinct(F.coalesce("supports", F.array().cast(proposals.schema["supports"].dataType))).alias("supports"))
    cause = own.select("id", F.explode("causes").alias("cause")).join(targets.select(F.col("id").alias("cause"), F.lit(True).alias("there"), lexical.hearsay(F.col("summary")).alias("rumour")), "cause", "left")
    causes = cause.groupBy("id").agg(F.count("*").alias("n_causes"), F.bool_and(F.coalesce("there", F.lit(False))).alias("all_there"), F.bool_and(F.coalesce("rumour", F.lit(False))).alias("rumours"))
    told = supports.select(F.col("id").alias("support"), F.lit(True).alias("known"), "type", F.coalesce("meaningful", F.lit(False)).alias("meaningful"), "record_ids", lexical.hearsay(F.col("claim")).alias("hearsay"), wording.of_summary(F.col("claim"))["prospective"].alias("plan"))
    named = own.select("id", "causes", F.explode("supports").alias("support")).join(told, "support", "left").withColumn("mine", F.coalesce(F.arrays_overlap("record_ids", "causes"), F.lit(False)))
    is_ = lambda kind: F.coalesce(F.col("type") == kind, F.lit(False))
    fact = is_("current") | is_("historical")
    any_ = lambda x: F.coalesce(F.bool_or(x), F.lit(False))
    flags = named.groupBy("id").agg(
        F.bool_and(F.coalesce("known", F.lit(False))).alias("all_known"), any_(~is_("time") & ~F.col("mine")).alias("foreign"), any_(is_("current") & F.col("mine")).alias("now"), any_(is_("current")).alias("current"), any_(is_("time") & F.col("meaningful")).alias("time"),
        any_(is_("historical")).alias("history"), any_(fact).alias("facts"), F.coalesce(F.bool_and(F.when(fact, F.col("hearsay") | F.col("plan"))), F.lit(False)).alias("told_only"),
    )
    covered = named.filter(~is_("time")).select("id", F.explode("record_ids").alias("cause")).distinct()
    bare = cause.select("id", "cause").join(covered, ["id", "cause"], "left_anti").select("id").distinct().withColumn("bare", F.lit(True))
    fresh = own.select("id", F.lit("development").alias("kind"), "summary", "anchors")
    alike = consolidation._of_candidates(fresh, consolidation.alike(fresh, records, same)).select("candidate_id", F.struct((-F.col("score")).alias("s"), F.col("id").alias("r"), "active").alias("b"))
    twins = alike.groupBy(F.col("candidate_id").alias("id")).agg(F.min("b").alias("twin"))
    rows = own.select("id", wording.of_summary(F.col("summary")).alias("worded")).join(causes, "id", "left").join(flags, "id", "left").join(bare, "id", "left").join(twins, "id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rules = (
        ~yes("all_there"), F.col("all_known").isNotNull() & ~yes("all_known"), yes("foreign"), yes("bare"), (F.col("n_causes") < 2) & ~yes("now"), ~(yes("current") | (yes("time") & yes("history"))),
        ((yes("facts") & yes("told_only")) | yes("rumours")) & ~(F.col("worded.account") | F.col("worded.acts")), F.col("twin").isNotNull() & yes("twin.active"), F.col("twin").isNotNull(),
    )
    reason = reduce(lambda so_far, x: so_far.when(x[1], x[0]), list(zip(REASONS, rules, strict=True))[1:], F.when(rules[0], REASONS[0]))
    return rows.select("id", reason.alias("reason"), F.when(reason.isin(*REASONS[-2:]), F.col("twin.r")).alias("duplicate"))


def inherited_evidence(proposals: DataFrame, supports: DataFrame, time_anchor: str = "") -> DataFrame:
    """(id, place, message, lineage, source_class, claim, time_anchor): the evidence of each proposal, from its supports in their order.

    Historical and current supports of one message and claim are one entry, the first; time is an entry of its own class. A historical one keeps its time anchor, a
    time one has that of now.
    """
    each = proposals.select("id", F.posexplode("supports").alias("at", "support")).join(supports.withColumnRenamed("id", "support"), "support").filter(F.col("type").isin("current", "time", "historical"))
    key = F.when(F.col("type") == "time", "time").otherwise("evidence")
    first = Window.partitionBy("id", key, "message", "claim").orderBy("at")
    kept = each.withColumn("k", F.row_number().over(first)).filter("k = 1")
    place = F.row_number().over(Window.partitionBy("id").orderBy("at")) - 1
    anchor = F.when(F.col("type") == "time", F.lit(time_anchor)).when(F.col("type") == "historical", F.coalesce("time_anchor", F.lit(""))).otherwise("")
    return kept.select("id", place.alias("place"), "message", "lineage", F.when(F.col("type") == "time", "elapsed_hint").otherwise(F.col("source_class")).alias("source_class"), "claim", anchor.alias("time_anchor"))


#: Steps up to this number are closed in rounds; of more, records that cause no other come off first, in layers of a quarter of the steps at least.
SMALL = 50_000
#: A layer's pairs meet in tasks of about so many.
PAIRS = 2_000_000


def _layers(steps: DataFrame, n: int) -> tuple[list[DataFrame], DataFrame]:
    """The n steps as layers, and the rest: no record of a layer is a cause of its own or a later layer, nor of the rest."""
    layers, rest = [], steps
    while n > SMALL:
        causes = rest.select(F.col("cause").alias("id")).distinct().withColumn("leads", F.lit(True))
        marked = cut(rest.join(shuffled(causes), "id", "left"))
        layer, rest = marked.filter("leads is null").drop("leads"), marked.filter("leads").drop("leads")
        ended = layer.count()
        if ended * 4 < n:
            return layers, marked.drop("leads")
        layers.append(layer)
        n -= ended
    return layers, rest


def _in_rounds(steps: DataFrame, rounds: int) -> DataFrame:
    """Each round takes the newest pairs one step on; pairs are deduplicated before they are kept."""
    known = frontier = cut(steps.withColumn("depth", F.lit(1)))
    for k in range(2, rounds + 2):
        on = frontier.select("id", F.col("cause").alias("mid")).join(shuffled(steps.select(F.col("id").alias("mid"), "cause")), "mid").filter("id <> cause").select("id", "cause").distinct()
        frontier = cut(on.join(shuffled(known.select("id", "cause")), ["id", "cause"], "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)
    raise ValueError(f"causes still lead on after {rounds} rounds")


def all_causes(records: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, cause, depth): what each record follows from, its causes' causes too, each at its least depth; cycles end, and a record is no cause of itself.

    records: id, caused_by (array). Records that cause no other come off in layers, as often as that takes enough of them; what is left, with all cycles, is closed in rounds. Then each layer
    takes the pairs of its causes, so that pairs are found once, from whole ones, and those of the first layer, most as a rule, are worked out as they are read. Depths over `rounds` fail.
    """
    steps = cut(records.select("id", F.explode("caused_by").alias("cause")).filter("id <> cause").distinct())
    layers, rest = _layers(steps, steps.count())
    known = _in_rounds(rest, rounds)
    tasks = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs, deepest, ids = known.agg(F.count("*"), F.max("depth"), F.count_distinct("id")).first()
    for k in reversed(range(len(layers))):
        own = layers[k].agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).first()
        on = layers[k].select("id", F.col("cause").alias("mid")).join(shuffled(known.select(F.col("id").alias("mid"), "cause", "depth")), "mid").select("id", "cause", (F.col("depth") + 1).alias("depth"))
        both = layers[k].withColumn("depth", F.lit(1)).unionByName(on)
        about = own.n * (1 + pairs // max(1, ids))
        both = both.repartition(max(1, min(max(tasks, about // PAIRS), about // 50_000)), "id")  # runs of an id take less disk than pairs dealt out singly
        new = both.groupBy("id", "cause").agg(F.min("depth").alias("depth"))
        if k or (deepest or 0) >= rounds:
            new = cut(new)
            found = new.agg(F.count("*").alias("n"), F.max("depth").alias("depth")).first()
            pairs, deepest, ids = pairs + found.n, max(deepest or 0, found.depth), ids + own.ids
            if deepest > rounds:
                raise ValueError(f"causes still lead on after {rounds} rounds")
        known = known.unionByName(new)
    return known
