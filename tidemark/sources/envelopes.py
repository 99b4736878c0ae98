"""Replies of a model: one JSON object, perhaps in a code fence, with proposed mutations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lexical import bounded_excerpt

#: Rows of a reply, pieces of evidence of a row, and characters of a claim.
MOST_ROWS, MOST_EVIDENCE, CLAIM_CHARS = 8, 4, 500
_ROW = "action string, kind string, category string, recordId string, summary string, description string, status string, trend string, timeAnchor string, newEpisodeOfRecordId string, anchors array<string>, relatedRecordIds array<string>, evidence array<struct<sourceMessageId:long,claim:string>>"


def parse_replies(replies: DataFrame, id_col: str = "id", text_col: str = "reply") -> DataFrame:
    """(id, ordinal, reason, and the fields of each row): reason says why a row or a whole reply (ordinal -1) isn't taken, null if it is.

    Other names of summary and kind are repaired (repairs: how many); if both names are there with different values the row is refused. Rows
    after the eighth are capped. All but noop rows need one to four pieces of evidence, each with a message and a claim. An absent field and a
    null one count the same. Null replies are refused; equal ids are replies of their own.
    """
    body = F.regexp_extract(F.trim(F.coalesce(F.col(text_col), F.lit(""))), r"(?s)^(?:```(?:json)?\s*)?(\{.*\})(?:\s*```)?$", 1)
    parsed = replies.select(F.col(id_col).alias("id"), F.from_json(body, f"mutations array<struct<{re.sub(r'(\w+) (\w+)', r'\1:\2', _ROW)}>>").alias("p"))
    bad = parsed.filter("p is null or p.mutations is null").select("id", F.lit(-1).alias("ordinal"), F.lit("not one object with mutations").alias("reason"))
    rows = parsed.filter("p.mutations is not null").select("id", F.posexplode("p.mutations").alias("ordinal", "m")).select("id", "ordinal", "m.*")
    clash = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    given = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    create, action = F.col("action") == "create", F.coalesce("action", F.lit(""))
    summary = F.coalesce(given("summary"), given("description"))
    repaired = create & given("kind").isNull() & given("category").isin("fact", "development")
    kind = F.when(repaired, given("category")).otherwise(given("kind"))
    repairs = (given("summary").isNull() & given("description").isNotNull()).cast("int") + F.coalesce(repaired, F.lit(False)).cast("int")
    pieces = F.coalesce("evidence", F.array().cast("array<struct<sourceMessageId:long,claim:string>>"))
    sound = F.forall(pieces, lambda e: F.coalesce(e["sourceMessageId"] >= 0, F.lit(False)) & (F.trim(F.coalesce(e["claim"], F.lit(""))) != ""))
    listed = lambda c: F.size(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != ""))
    reason = (
        F.when(F.col("ordinal") >= MOST_ROWS, "capped")
        .when(clash("summary", "description") | (create & clash("kind", "category")), "conflicting names")
        .when(~action.isin("create", "update", "resolve", "supersede", "noop"), "unsupported action")
        .when(action == "noop", F.lit(None))
        .when(F.size(pieces) == 0, "no evidence")
        .when(F.size(pieces) > MOST_EVIDENCE, "too much evidence")
        .when(~sound, "evidence without message or claim")
        .when(create & (summary.isNull() | ~F.coalesce(kind, F.lit("")).isin("fact", "development")), "needs kind and summary")
        .when(create & given("recordId").isNotNull(), "a new record has no id yet")
        .when(create & ~F.coalesce("status", F.lit("active")).isin("active", "resolved"), "unsupported status")
        .when(~create & given("recordId").isNull(), "needs a record")
        .when(~create & F.col("status").isNotNull() & ~F.col("status").isin("active", "resolved", "superseded"), "unsupported status")
        .when((action == "update") & summary.isNull() & F.col("trend").isNull() & F.col("anchors").isNull() & F.col("status").isNull() & (listed("relatedRecordIds") == 0), "nothing to update")
    )
    good = rows.select("id", "ordinal", reason.alias("reason"), "action", kind.alias("kind"), F.col("recordId").alias("record"), summary.alias("summary"), "status", "trend", F.col("timeAnchor").alias("time_anchor"), F.col("newEpisodeOfRecordId").alias("episode_of"), "anchors", F.transform(pieces, lambda e: F.struct(e["sourceMessageId"].alias("message"), bounded_excerpt(e["claim"], CLAIM_CHARS).alias("claim"))).alias("evidence"), repairs.alias("repairs"))
    return good.unionByName(bad, allowMissingColumns=True)


#: Evaluations, derived developments and supports of a reply, causes of a development, and characters of texts.
EVALUATIONS, DERIVED, SUPPORTS, CAUSES, WHY_CHARS, SUMMARY_CHARS, ANCHORS, NAME_CHARS = 6, 1, 8, 4, 500, 700, 20, 120
OUTCOMES, TRENDS = ("stable", "update", "resolve", "supersede"), ("rising", "stable", "falling")
_EVALUATION = "struct<recordId: string, outcome: string, reason: string, supportIds: array<string>, summary: string, trend: string, anchors: array<string>, causeRecordIds: array<string>>"


def parse_evaluations(replies: DataFrame, id_col: str = "id", text_col: str = "reply") -> DataFrame:
    """(id, section, ordinal, reason, record, outcome, why, summary, trend, anchors, supports, causes): the evaluations and derived developments of replies.

    reason says why a row, or a whole reply (ordinal -1), isn't taken, null if it is. A reply is one JSON object, perhaps in a code fence, with at most six evaluations and one
    derived development. Outcomes count in any case; an unknown trend and empty anchors mean that nothing is said of them; of a stable record only the supports
    are kept. Absent and null fields are the same, and so are lists that are no lists. Null replies are refused; equal ids are replies of their own.
    """
    own = F.trim(F.coalesce(F.col(text_col), F.lit("")))
    body = F.regexp_extract(own, r"(?s)^(?:```(?:json)?\s*)?(\{.*\})(?:\s*```)?$", 1)
    parsed = replies.select(F.col(id_col).alias("id"), F.from_json(body, f"evaluations array<{_EVALUATION}>, derived array<{_EVALUATION}>, damaged string", {"columnNameOfCorruptRecord": "damaged"}).alias("p"))
    fault = F.when(F.col("p").isNull() | F.col("p.damaged").isNotNull() | F.col("p.evaluations").isNull(), "not one object with evaluations").when(F.size("p.evaluations") > EVALUATIONS, "too many evaluations").when(F.coalesce(F.size("p.derived"), F.lit(0)) > DERIVED, "too many derived")
    judged = parsed.withColumn("fault", fault)
    text = lambda c, most: F.nullif(F.trim(F.substring(F.trim(F.coalesce(F.col(c), F.lit(""))), 1, most)), F.lit(""))
    listed = lambda c, most: F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(F.substring(F.trim(F.coalesce(x, F.lit(""))), 1, NAME_CHARS))), lambda x: x != "")), 1, most)
    rows = [judged.filter("fault is null").select("id", F.lit(section).alias("section"), F.posexplode(f"p.{section}").alias("ordinal", "e")) for section in ("evaluations", "derived")]
    each = rows[0].unionByName(rows[1])
    evaluation, outcome = F.col("section") == "evaluations", F.lower(text("e.outcome", 24))
    changes = evaluation & (outcome != "stable")
    fields = each.select(
        "id", "section", "ordinal", F.col("e").isNull().alias("none"), F.when(evaluation, text("e.recordId", NAME_CHARS)).alias("record"), F.when(evaluation, outcome).alias("outcome"), text("e.reason", WHY_CHARS).alias("why"), F.when(changes | ~evaluation, text("e.summary", SUMMARY_CHARS)).alias("summary"),
        F.when((changes | ~evaluation) & F.col("e.trend").isin(*TRENDS), F.col("e.trend")).alias("trend"), F.when(changes | ~evaluation, F.filter(listed("e.anchors", ANCHORS), lambda x: x != "")).alias("anchors"), listed("e.supportIds", SUPPORTS).alias("supports"), F.when(~evaluation, listed("e.causeRecordIds", CAUSES)).alias("causes"),
    ).withColumn("anchors", F.when((F.col("section") == "evaluations") & (F.size("anchors") == 0), F.lit(None)).otherwise(F.col("anchors")))
    of = F.col("section") == "evaluations"
    reason = (
        F.when(F.col("none"), "no object")
        .when(of & F.col("record").isNull(), "needs a record")
        .when(of & ~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False)), "unsupported outcome")
        .when(of & F.col("why").isNull(), "needs a reason")
        .when(~of & (F.col("summary").isNull() | F.col("why").isNull()), "needs summary and reason")
        .when(of & F.col("outcome").isin("resolve", "supersede") & F.col("summary").isNull(), "needs a summary")
        .when(of & (F.col("outcome") == "update") & F.col("summary").isNull() & F.col("trend").isNull() & F.col("anchors").isNull(), "nothing to update")
    )
    good = fields.select("id", "section", "ordinal", reason.alias("reason"), "record", "outcome", "why", "summary", "trend", "anchors", "supports", "causes")
    bad = judged.filter("fault is not null").select("id", F.lit(None).cast("string").alias("section"), F.lit(-1).alias("ordinal"), F.col("fault").alias("reason"))
    return good.unionByName(bad, allowMissingColumns=True)
