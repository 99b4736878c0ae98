"""Queries of quotations, reports and admission, and their SQL. Texts are made of names of parts by rules, which the SQL knows the outcome of."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import lexical, speech
from tidemark.operators import admission, log
from tidemark.plans.catalogue import messages, query, read

_SPOKEN = """'The guard said "' || p_name || ', come!" at the ' || p_type || ' gate. “' || p_type || ' ' || p_brand || '” was all. Nobody heard.'"""


def _said(*parts):  # noqa: ANN002, ANN202
    return F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))


@query(f"""with t as (select p_partkey as id, {_SPOKEN} as t from part)
select id, array_to_string(list_transform(regexp_extract_all(t, '"[^"]*"|“[^”]*”'), lambda q: substr(q, 2, length(q) - 2)), '|') as quoted, regexp_replace(t, '"[^"]*"|“[^”]*”', ' ', 'g') as told from t""")
def spoken_parts(spark, d):
    name, kind, brand = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    text = _said('The guard said "', name, ', come!" at the ', kind, " gate. “", kind, " ", brand, "” was all. Nobody heard.")
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(speech.quotations(text), "|").alias("quoted"), speech.narration(text).alias("told"))


#: SQL has no look-behind: full stops of titles and initials are set aside (twice, as two may share a space), and put back.
_INITIAL = r"""regexp_replace({0}, '(^|[\s(\["“''‘])({1}|\p{{Lu}})\.([ \t])', '\1\2' || chr(1) || '\3', 'g')"""
_APART = _INITIAL.format(_INITIAL.format("coalesce(text, '')", speech.ABBREVIATED), speech.ABBREVIATED)


@query(
    r"""with s as (select doc_id, list_transform(list_filter(string_split_regex(regexp_replace(APART, '([.!?]["'')\]]{0,4})[ \t]+', '\1' || chr(10), 'g'), '\s*\n\s*'), lambda x: trim(x) <> ''), lambda x: replace(x, chr(1), '.')) as s from documents)
select doc_id, cast(len(s) as bigint) as n, md5(array_to_string(s, '|')) as sentences_md5 from s""".replace("APART", _APART)
)
def sentence_split(spark, d):
    own = speech.sentences(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(own).cast("long").alias("n"), F.md5(F.array_join(own, "|").cast("binary")).alias("sentences_md5"))


@query("""select p_partkey as id, p_partkey % 10 in (1, 2, 4, 5) as reported, p_partkey % 10 in (1, 2, 3, 4, 5, 9) as attributed from part""")
def evidence_status(spark, d):
    k = F.col("p_partkey")
    told = F.concat_ws(" ", "p_name", F.lit("reached"), "p_type")
    forms = (("Then ", "."), ("The scout reports that ", "."), ('A trader says, "', '."'), ("If ", ", all is lost."), ("They demand that ", "."), ("", ", the trader said."), ("The captain announced the curfew, ", "."), ("Rumour has it ", ""), ("They threatened the town and ", "."), ("They saw it; ", " will follow."))
    text = F.lit(None).cast("string")
    for n, (before, after) in enumerate(forms):
        text = F.when(k % 10 == n, _said(before, told, after) if n != 7 else _said(before, told, ". Later ", told, ".")).otherwise(text)
    rows = read(spark, d, "part").select(k.alias("id"), F.when(k % 10 == 9, _said(told, " will follow")).otherwise(told).alias("claim"), text.alias("text"), F.lit("").alias("focus"))
    return admission.evidence_status(rows).select("id", "reported", "attributed")


_REASONS = "[" + ", ".join(f"'{r}'" for r in admission.REASONS) + "]"


@query(f"select p_partkey as id, {_REASONS}[1 + p_partkey % 18] as reason, case when p_partkey % 18 = 16 then p_name end as anchors from part")
def admission_gate(spark, d):
    """A proposal for each part, of a form that fails one rule and no earlier one, or none."""
    k, form = F.col("p_partkey"), F.col("p_partkey") % 18
    told, other = F.concat_ws(" ", "p_name", "p_type", F.lit("reached the harbour")), F.lit("Winter brings heavy snowfall")
    turned = lambda word: F.concat_ws(" ", "p_name", "p_type", F.lit(word), F.lit("reached the harbour"))
    scout = F.concat(F.lit("The scout reports that "), told)
    part = read(spark, d, "part")
    on_record = form.isin(6, 8, 9, 11, 12, 16)
    action = F.when(form.isin(0, 6, 8, 9, 16), "update").when(form.isin(11, 12), "resolve").when(form == 17, "noop").otherwise("create")
    proposals = part.select(
        k.alias("proposal_id"), action.alias("action"), F.when(form == 0, -1 - k).when(on_record, k).alias("record_id"), F.when(form.isin(7, 8, 9), other).when(form == 15, scout).when(~form.isin(11, 12), told).alias("summary"),
        F.lit(None).cast("string").alias("status"), F.when(form == 16, F.array("p_name", F.lit("Nowhere Keep"))).alias("anchors"), F.when(form == 1, k).alias("episode_of"),
        F.when(form == 2, F.array(F.lit(-1).cast("long"))).alias("related"), F.when(form == 9, k).alias("bound_id"),
    )
    claim = F.when(form.isin(8, 9), other).when(form == 10, turned("never")).when(form == 11, turned("still")).otherwise(told)
    evidence = part.filter(form != 5).select(k.alias("proposal_id"), F.lit(0).alias("place"), k.alias("message_id"), claim.alias("claim"))
    text = F.when(form == 4, other).when(form.isin(12, 13, 15), scout).otherwise(claim)
    messages = part.select(k.alias("message_id"), F.when(form == 3, "system").otherwise("assistant").alias("role"), F.concat(text, F.lit(".")).alias("text"))
    records = part.select(k.alias("id"), F.when(form == 6, "resolved").otherwise("active").alias("status"), told.alias("summary"), F.array("p_name").alias("anchors"))
    found = admission.admitted(proposals, evidence, messages, records)
    return found.select(F.col("proposal_id").alias("id"), "reason", F.array_join("anchors", "|").alias("anchors"))


#: Phrases of time after turns, which have none: of weeks, of an hour, and four that aren't narrated as past.
_TIMES = ("Three weeks later, the gate fell.", "An hour later she left.", "Two weeks later, we will be gone.", 'He said "two months later" and left.', "If the rains come, three weeks later we go.", "We could go two days later.", "Nothing.")


@query("""with t as (select conv_id as chat, turn, (conv_id * 3 + turn) % 7 as f from conversations where turn is not null and coalesce(role, '') <> 'system'), n as (select chat, arg_max(f, (case when f = 0 then 1 else 0 end) * 1000000000 + turn) as f from t where f < 2 group by chat)
select chat, case f when 0 then 'Three weeks later' else 'An hour later' end as raw, case f when 0 then 3 else 1 end as amount, case f when 0 then 'week' else 'hour' end as unit, f = 0 as meaningful from n""")
def newest_elapsed(spark, d):
    told = F.element_at(lexical.listed(_TIMES), (1 + (F.col("chat") * 3 + F.col("pos")) % 7).cast("int"))
    return log.newest_elapsed(messages(spark, d).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), told)))
