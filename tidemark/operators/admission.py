"""Which proposed changes their evidence carries: each is judged by a chain of rules, and the first that fails is its reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import lexical, speech, wording
from tidemark.functions.text import canonical_text
from tidemark.operators.shared import shuffled

#: The rules in order; the first that fails is the reason.
REASONS = (
    "target not in context", "episode not ended", "related not in context", "evidence not from the exchange", "evidence not grounded", "no evidence", "history is immutable", "summary not supported",
    "target not identified", "summary leaves the target", "evidence states the opposite", "evidence says it continues", "ending not narrated", "status not kept",
)


def evidence_status(evidence: DataFrame) -> DataFrame:
    """Adds reported (quoted, reported, or what a speech act is about) and attributed (reported, or planned or conditional) to (.., claim, text, focus).

    focus: what the claim is to support; of several sentences those that share words with it count. Null texts are empty. Columns whose names end with
    two underscores are used meanwhile.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, r"(?:\r?\n)+"), lambda x: F.trim(x) != "")
    read = evidence.withColumns({"sentences__": speech.sentences(text), "lines__": lines, "quotations__": speech.quotations(text), "narration__": speech.narration(text), "parts__": speech.judged_parts(F.col("claim"), F.col("focus"))})
    names = ("sentences__", "lines__", "parts__")
    read = read.withColumns({f"{c}told__": speech.read_pieces(F.col(c)) for c in names}).withColumn("quoted__", speech.words_in_quotes_only(F.col("quotations__"), F.col("narration__")))
    sentences, lines, parts = (speech.with_facts(F.col(c), F.col(f"{c}told__")) for c in names)
    read = read.withColumns({"sentences__": sentences, "lines__": lines, "parts__": parts, "canon__": canonical_text(text), "quotations__": F.transform("quotations__", canonical_text), "narration__": canonical_text(F.col("narration__"))})
    source = speech.Source(F.col("canon__"), F.col("sentences__"), F.col("lines__"), F.col("quotations__"), F.col("narration__"), F.col("quoted__"))
    told = read.withColumn("reported", F.forall("parts__", lambda p: speech.reported(p, source)))
    planned = F.forall("parts__", lambda p: speech.prospective(p, source))
    return told.withColumn("attributed", F.col("reported") | planned).drop(*names, *(f"{c}told__" for c in names), "quotations__", "narration__", "quoted__", "canon__")


def admitted(proposals: DataFrame, evidence: DataFrame, messages: DataFrame, records: DataFrame) -> DataFrame:
    """(proposal_id, reason, anchors): the first rule that a proposal fails, null if it is admitted, and the anchors that its evidence supports.

    proposals: proposal_id (each once), action (create, update, resolve, supersede, noop), record_id, summary, status, anchors, episode_of,
    related (array of ids), bound_id (the only record that the context binds, or null). evidence: proposal_id, place, message_id, claim.
    messages: message_id (each once), role, text. records: id (each once), status, summary, anchors; those of the context.

    Null anchors stay null (unchanged); an update that loses all of them has null too. A noop is admitted. Evidence of unknown proposals
    counts for nothing, repeated evidence no more than once. Proposals, evidence and messages meet by equality of keys, and evidence is
    combined by sums of flags, so that no proposal's evidence is held as a list.
    """
    known = records.select(F.col("id").alias("record_id"), F.col("status").alias("r_status"), F.col("summary").alias("r_summary"), F.coalesce("anchors", F.array().cast("array<string>")).alias("r_anchors"), F.lit(True).alias("known"))
    prior = records.select(F.col("id").alias("episode_of"), F.col("status").alias("e_status"))
    own = proposals.join(shuffled(known), "record_id", "left").join(shuffled(prior), "episode_of", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    own = own.withColumn("assertion", F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary")).otherwise(F.coalesce("r_summary", F.lit(""))))

    cited = evidence.select("proposal_id", "place", "message_id", "claim").join(shuffled(messages.select("message_id", "role", "text")), "message_id", "left")
    cited = cited.withColumns({"from_exchange": F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)), "grounded": speech.grounded(F.col("claim"), F.col("text"))})
    both = evidence_status(cited.join(shuffled(own.select("proposal_id", "assertion", "summary", "anchors", "r_summary", "r_anchors", "known")), "proposal_id").withColumn("focus", F.col("assertion")))
    claim, none = F.col("claim"), F.array().cast("array<string>")
    both = both.withColumns(
        {
            "supports": lexical.lexical_affinity(F.col("assertion"), claim, F.coalesce("anchors", "r_anchors", none)),
            "identifies": F.col("known") & lexical.target_affinity(F.col("r_summary"), F.coalesce("r_anchors", none), claim),
            "opposes": lexical.contradicts(F.col("summary"), claim),
            "continues": F.col("known") & lexical.states_continuation(F.col("r_summary"), claim),
            "kept": F.filter(F.col("anchors"), lambda a: lexical.anchor_supported(a, F.array(claim), F.coalesce("r_anchors", none), F.col("assertion"))),
        }
    )
    fails = F.when(~F.col("from_exchange"), F.lit(3)).when(~F.col("grounded"), F.lit(4))
    among = lambda flag: F.coalesce(F.bool_and(F.when(F.col("supports"), flag)), F.lit(False))
    flags = both.groupBy("proposal_id").agg(
        F.min_by(fails, F.when(fails.isNotNull(), F.col("place"))).alias("evidence_fails"), F.bool_or("supports").alias("supported"), F.bool_or("identifies").alias("identified"),
        among(F.col("opposes")).alias("opposed"), among(F.col("continues")).alias("goes_on"), among(F.col("attributed")).alias("all_attributed"), among(~F.col("reported")).alias("plans_only"), F.lit(True).alias("cited"),
    )
    anchors = both.select("proposal_id", F.explode("kept").alias("anchor")).groupBy("proposal_id").agg(F.collect_set("anchor").alias("supported_anchors"))
    missing = own.select("proposal_id", F.explode("related").alias("record_id")).join(shuffled(known.select("record_id")), "record_id", "left_anti").select("proposal_id").distinct().withColumn("unrelated", F.lit(True))
    all_ = own.join(shuffled(flags), "proposal_id", "left").join(shuffled(anchors), "proposal_id", "left").join(shuffled(missing), "proposal_id", "left")

    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    said = F.coalesce("summary", F.lit("")) != ""
    ends = F.coalesce(F.col("action").isin("resolve", "supersede") | F.col("status").isin("resolved", "superseded"), F.lit(False)) | F.col("action").isin("resolve", "supersede")
    bound = yes("known") & F.coalesce(F.col("bound_id") == F.col("record_id"), F.lit(False))
    all_ = all_.withColumns({"worded": wording.of_summary(F.col("assertion")), "r_worded": wording.of_summary(F.col("r_summary"))})
    status_kept = F.col("worded.account") | F.col("worded.acts") | (yes("plans_only") & F.col("worded.planned"))
    rules = (
        (F.col("action") != "create") & ~F.col("known"),
        (F.col("action") == "create") & F.col("episode_of").isNotNull() & ~F.coalesce(F.col("e_status").isin("resolved", "superseded"), F.lit(False)),
        yes("unrelated"),
        F.coalesce(F.col("evidence_fails") == 3, F.lit(False)),
        F.coalesce(F.col("evidence_fails") == 4, F.lit(False)),
        ~yes("cited"),
        F.col("known") & F.coalesce(F.col("r_status") != "active", F.lit(True)),
        ~yes("supported"),
        F.col("known") & ~yes("identified") & ~bound,
        bound & said & ~lexical.target_affinity(F.col("r_summary"), F.coalesce("r_anchors", none), F.col("summary")),
        ~ends & said & yes("opposed"),
        F.col("known") & ends & yes("goes_on"),
        F.col("known") & ends & yes("all_attributed") & ~F.col("r_worded.account"),
        yes("all_attributed") & ~status_kept,
    )
    reason = F.when(F.col("action") == "noop", F.lit(None))
    for name, fails_ in zip(REASONS, rules, strict=True):
        reason = reason.when(fails_, F.lit(name))
    left = F.filter("anchors", lambda a: F.array_contains(F.coalesce("supported_anchors", none), a))
    kept = F.when(F.col("known") & (F.size("anchors") > 0) & (F.size(left) == 0), F.lit(None)).otherwise(left)
    return all_.select("proposal_id", reason.alias("reason"), kept.alias("anchors"))
