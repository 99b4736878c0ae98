"""Queries of text, grounding and chat functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import chat, lexical, spatial_text, text
from tidemark.operators import log
from tidemark.plans.catalogue import canon, fnv, messages, query, read

_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_STOPS = _LIST(lexical.SUPPORT_STOPS)


def words_sql(column: str) -> str:
    return f"list_filter(string_split({canon(column)}, ' '), lambda w: w <> '')"


def significant_sql(column: str) -> str:
    kept = f"list_filter({words_sql(column)}, lambda w: length(w) >= 3 and not list_contains({_STOPS}, w))"
    return f"list_transform({kept}, lambda w: case when length(w) > 5 and ends_with(w, 'ies') then substr(w, 1, length(w) - 3) || 'y' when length(w) > 4 and ends_with(w, 's') then substr(w, 1, length(w) - 1) else w end)"


def holds_sql(hay: str, needle: str) -> str:
    return f"contains(' ' || {hay} || ' ', ' ' || {needle} || ' ')"


def digest(column):  # noqa: ANN001, ANN201
    return F.md5(F.array_join(column, "|").cast("binary"))


@query(f"select doc_id, md5(array_to_string({significant_sql('text')}, '|')) as words_md5, cast(len({significant_sql('text')}) as bigint) as n from documents")
def significant_words(spark, d):
    own = lexical.significant(F.col("text"))
    return read(spark, d, "documents").select("doc_id", digest(own).alias("words_md5"), F.size(own).cast("long").alias("n"))


#: Texts of other scripts, put beside the tables' own, which have none.
_OTHERS = ("王都の門が閉じた", "서울에서 온 소식", "กรุงเทพมหานคร", "きのうのことを", "été à la société", "カタカナとかな王都", "plain words")
_MIXED = f"(select conv_id, turn, {_LIST(_OTHERS)}[1 + (conv_id + turn) % 7] || ' ' || text as l, {_LIST(_OTHERS)}[1 + (conv_id * 2 + turn) % 7] || ' 王都の' as r from conversations)"
_RUNS = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}ー]{2,}"
_CONTENT = r"[\p{Han}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"


def pairs_sql(column: str) -> str:
    return f"list_distinct(flatten(list_transform(regexp_extract_all({canon(column)}, '{_RUNS}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))))"


@query(f"""with p as (select conv_id, turn, {pairs_sql('l')} as a, {pairs_sql('r')} as b from {_MIXED}), s as (select *, list_intersect(a, b) as met from p)
select conv_id, turn, md5(array_to_string(list_sort(a), '|')) as pairs_md5, cast(case when len(list_filter(met, lambda x: regexp_matches(x, '{_CONTENT}'))) > 0 then len(met) else 0 end as bigint) as shared,
  cast(len(list_filter(met, lambda x: regexp_matches(x, '{_CONTENT}'))) as bigint) as content from s""")
def spaceless_overlap(spark, d):
    """Turns with words of other scripts before them."""
    other = lambda k: F.element_at(lexical.listed(_OTHERS), (1 + (F.col("chat") * k + F.col("pos")) % 7).cast("int"))
    left, right = F.concat(other(1), F.lit(" "), "text"), F.concat(other(2), F.lit(" 王都の"))
    return messages(spark, d).select(F.col("chat").alias("conv_id"), F.col("pos").alias("turn"), digest(F.array_sort(lexical.spaceless_pairs(left))).alias("pairs_md5"), lexical.shared_spaceless(left, right).cast("long").alias("shared"), lexical.shared_content(left, right).cast("long").alias("content"))


@query(f"""with t as (select doc_id, replace({canon('text')}, ' ', '') as c from documents), p as (select doc_id, i, substr(c, i, 2) as g from (select doc_id, c, unnest(range(1, length(c))) as i from t where length(c) >= 2) where regexp_matches(substr(c, i, 2), '[^\\x00-\\x7F]')),
f as (select doc_id, g, min(i) as first, max(i) as last from p group by all), k as (select *, row_number() over (partition by doc_id order by first) as a, row_number() over (partition by doc_id order by last desc) as b from f),
m as (select doc_id, string_agg(g, '|' order by a) filter (a <= 64) as x, string_agg(g, '|' order by b) filter (b <= 64) as y from k group by doc_id)
select doc_id, md5(coalesce(x, case when length(c) = 1 and regexp_matches(c, '[^\\x00-\\x7F]') then c else '' end)) as first_md5, md5(coalesce(y, case when length(c) = 1 and regexp_matches(c, '[^\\x00-\\x7F]') then c else '' end)) as last_md5 from t left join m using (doc_id)""")
def non_ascii_pairs(spark, d):
    own = F.col("text")
    return read(spark, d, "documents").select("doc_id", digest(lexical.non_ascii_pairs(own)).alias("first_md5"), digest(lexical.non_ascii_pairs(own, newest_first=True)).alias("last_md5"))


@query(f"""with w as (select conv_id, turn, {words_sql('text')} as w from conversations), s as (select conv_id, turn, w, unnest(range(1, len(w) + 1)) as i from w), r as (select conv_id, turn, w, i, unnest(range(1, 7)) as k from s),
p as (select conv_id, turn, k, array_to_string(w[i:i + k - 1], ' ') as p, min(i * 10 + k) as o from r where i + k - 1 <= len(w) group by all),
f as (select *, row_number() over (partition by conv_id, turn order by o) as n from p)
select w.conv_id, w.turn, md5(coalesce(string_agg(p, '|' order by k desc, o) filter (n <= 384), '')) as phrases_md5 from w left join f on w.conv_id = f.conv_id and w.turn = f.turn group by all""")
def phrase_lists(spark, d):
    return messages(spark, d).select(F.col("chat").alias("conv_id"), F.col("pos").alias("turn"), digest(lexical.phrase_candidates(F.col("text"))).alias("phrases_md5"))


@query(r"""with t as (select doc_id, trim(coalesce(text, '')) as t, substr(trim(coalesce(text, '')), 1, 120) as h from documents),
s as (select *, regexp_matches(substr(t, 121, 1), '[\p{L}\p{N}]') and regexp_matches(h, '[\p{L}\p{N}]$') as within, regexp_replace(h, '\s\S*$', '') as c from t)
select doc_id, case when length(t) <= 120 then t when within and regexp_matches(h, '\s') and length(c) > 60 then trim(c) else trim(h) end as excerpt from s""")
def excerpts(spark, d):
    return read(spark, d, "documents").select("doc_id", lexical.bounded_excerpt(F.col("text"), 120).alias("excerpt"))


#: A statement, and a claim made of it and of the next turn by a rule.
_CLAIMS = """(select a.conv_id, a.turn, split_part(a.text, '.', 1) as l, case (a.conv_id * 3 + a.turn) % 5 when 0 then b.text || '; ' || split_part(a.text, '.', 1) || ' does not hold' when 1 then 'It still is ' || split_part(a.text, '.', 1)
  when 2 then lower(split_part(a.text, '.', 1)) when 3 then 'It is said that' else b.text end as r, [split_part(a.text, ' ', 2), split_part(b.text, ' ', 3)] as anchors from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)"""


def _claims(spark, d):
    own = messages(spark, d)
    both = own.select("chat", "pos", F.col("text").alias("a")).join(own.select("chat", (F.col("pos") - 1).alias("pos"), F.col("text").alias("b")), ["chat", "pos"])
    first = F.split("a", r"\.")[0]
    k = (F.col("chat") * 3 + F.col("pos")) % 5
    claim = F.when(k == 0, F.concat("b", F.lit("; "), first, F.lit(" does not hold"))).when(k == 1, F.concat(F.lit("It still is "), first)).when(k == 2, F.lower(first)).when(k == 3, "It is said that").otherwise(F.col("b"))
    part = lambda c, i: F.coalesce(F.get(F.split(c, " "), F.lit(i - 1)), F.lit(""))
    return both.select(F.col("chat").alias("conv_id"), F.col("pos").alias("turn"), first.alias("l"), claim.alias("r"), F.array(part("a", 2), part("b", 3)).alias("anchors"))


_SPACED = "len(list_intersect(pl, pr)) >= 3 and len(list_filter(list_intersect(pl, pr), lambda x: regexp_matches(x, '" + _CONTENT + "'))) > 0"
_FACTS = f"""with c as (select *, {canon('l')} as a, {canon('r')} as b, list_distinct({significant_sql('l')}) as sl, list_distinct({significant_sql('r')}) as sr, {pairs_sql('l')} as pl, {pairs_sql('r')} as pr, list_filter(list_transform(anchors, lambda x: {canon('x')}), lambda x: length(x) >= 3) as an from {_CLAIMS}),
f as (select *, list_intersect(sl, sr) as met from c)"""


@query(f"""{_FACTS} select conv_id, turn, a <> '' and b <> '' and ((length(a) >= 8 and {holds_sql('b', 'a')}) or (length(b) >= 8 and {holds_sql('a', 'b')}) or len(met) >= 2 or ({_SPACED})
  or len(list_filter(an, lambda x: {holds_sql('a', 'x')} and {holds_sql('b', 'x')})) > 0 or (len(met) = 1 and length(met[1]) >= 6)) as fits,
len(met) >= 2 or (len(met) = 1 and length(met[1]) >= 6 and 2 >= least(len(sl), len(sr))) or (b <> '' and (({_SPACED}) or len(list_filter(an, lambda x: {holds_sql('b', 'x')} and contains(x, ' '))) > 0 or len(list_filter(an, lambda x: {holds_sql('b', 'x')})) >= 2
  or (len(an) = 1 and len(list_filter(an, lambda x: {holds_sql('b', 'x')} and length(x) >= 5)) = 1))) as identifies from f""")
def affinities(spark, d):
    return _claims(spark, d).select("conv_id", "turn", lexical.lexical_affinity(F.col("l"), F.col("r"), F.col("anchors")).alias("fits"), lexical.target_affinity(F.col("l"), F.col("anchors"), F.col("r")).alias("identifies"))


_NEG = rf"(?i)\b(?:{lexical._NEGATED})\b|n[''’]t\b"
_CON = rf"(?i)\b(?:{lexical._CONTINUES})\b"
_ENDS = lexical.CLAUSE_ENDS.replace("'", "''")


@query(f"""with c as (select *, list_filter(list_distinct({significant_sql('l')}), lambda w: not list_contains({_LIST(lexical.NEGATIONS)}, w)) as need from {_CLAIMS}),
k as (select *, case when len(need) < 2 then [] else list_filter(string_split_regex(r, '{_ENDS}'), lambda x: len(list_filter(need, lambda w: not list_contains({significant_sql('x')}, w))) = 0) end as cl, regexp_matches(l, '{_NEG}') as neg from c)
select conv_id, turn, len(cl) > 0 and len(list_filter(cl, lambda x: regexp_matches(x, '{_NEG}') = neg)) = 0 as contradicts,
  len(list_filter(cl, lambda x: len(regexp_extract_all(x, '{_CON}')) > len(regexp_extract_all(l, '{_CON}')) and regexp_matches(x, '{_NEG}') = neg)) > 0 as continues,
  regexp_matches(r, '(?i)\\b(?:{lexical._HEARSAY})\\b') as hearsay from k""")
def claim_polarity(spark, d):
    left, right = F.col("l"), F.col("r")
    return _claims(spark, d).select("conv_id", "turn", lexical.contradicts(left, right).alias("contradicts"), lexical.states_continuation(left, right).alias("continues"), lexical.hearsay(right).alias("hearsay"))


@query(f"""with c as (select conv_id, turn, l, r, unnest(anchors) as anchor, generate_subscripts(anchors, 1) as i from {_CLAIMS}), s as (select *, {canon('anchor')} as a, {significant_sql('anchor')} as need, {significant_sql('r')} as have from c),
o as (select *, list_filter(need, lambda w: list_contains(have, w)) as met from s)
select conv_id, turn, cast(i as int) as i, a <> '' and (({holds_sql(canon('r'), 'a')}) or (len(need) > 0 and len(met) >= ceil(len(need) / 2) and len(list_filter(met, lambda w: length(w) >= 4)) > 0)
  or ({holds_sql(canon('l'), 'a')} and len(list_filter(met, lambda w: length(w) >= 5)) > 0)) as supported from o""")
def anchors_supported(spark, d):
    each = _claims(spark, d).select("conv_id", "turn", "l", "r", F.posexplode("anchors").alias("i", "anchor"))
    return each.select("conv_id", "turn", (F.col("i") + 1).alias("i"), lexical.anchor_supported(F.col("anchor"), F.array("r"), F.array().cast("array<string>"), F.col("l")).alias("supported"))


#: Host rows made of turns by a rule: whose they are, hidden or not, of which kind, and where their text is.
_HOST = """(select *, case when turn % 3 = 0 then null else role end as own_role, case conv_id % 3 when 0 then role = 'user' end as is_user, (conv_id + turn) % 4 = 0 as is_system, ['narrator', '', 'assistant_message', 'comment', ' Narrator '][1 + (conv_id * 2 + turn) % 5] as kind,
  turn % 5 = 1 as reply_marks, conv_id % 7 = 0 as system_marks, case when turn % 2 = 0 then text end as content, case when conv_id % 2 = 0 then 'm ' || text end as mes from conversations)"""
_ROLE = "case when coalesce(own_role = 'user', false) or coalesce(is_user, false) then 'user' when coalesce(own_role = 'assistant', false) or (coalesce(not is_user, false) and not is_system) then 'assistant' else 'system' end"
_SYSTEM = _LIST(chat.SYSTEM_TYPES)


@query(f"""select conv_id, turn, {_ROLE} as role, case when is_system or coalesce(own_role = 'system', false) then 'system' when coalesce(is_user, false) or coalesce(own_role = 'user', false) then 'user' else 'assistant' end as shown,
case when not is_system then {_ROLE} when system_marks or list_contains({_SYSTEM}, lower(trim(kind))) then 'system' when coalesce(is_user, false) or coalesce(own_role = 'user', false) then 'user'
  when coalesce(own_role = 'assistant', false) or lower(trim(kind)) = 'assistant_message' or reply_marks then 'assistant' else 'system' end as hidden,
not is_system and not coalesce(is_user, false) and lower(trim(kind)) = 'narrator' as narrator, md5(coalesce(content, mes, text)) as text_md5, md5(coalesce(mes, content, text)) as host_md5 from {_HOST}""")
def message_roles(spark, d):
    c, t = F.col("chat"), F.col("pos")
    rows = messages(spark, d).select(
        "chat", "pos", "text", F.when(t % 3 != 0, F.col("role")).alias("own"), F.when(c % 3 == 0, F.col("role") == "user").alias("is_user"), ((c + t) % 4 == 0).alias("is_system"),
        F.element_at(lexical.listed(("narrator", "", "assistant_message", "comment", " Narrator ")), (1 + (c * 2 + t) % 5).cast("int")).alias("kind"), F.when(t % 2 == 0, F.col("text")).alias("content"), F.when(c % 2 == 0, F.concat(F.lit("m "), "text")).alias("mes"),
    )
    own, user, system, kind, said = F.col("own"), F.col("is_user"), F.col("is_system"), F.col("kind"), (F.col("content"), F.col("mes"), F.col("text"))
    md5 = lambda x: F.md5(x.cast("binary"))
    return rows.select(
        F.col("chat").alias("conv_id"), F.col("pos").alias("turn"), chat.message_role(own, user, system).alias("role"), chat.visible_role(own, user, system).alias("shown"), chat.hidden_role(own, user, system, kind, c % 7 == 0, t % 5 == 1).alias("hidden"),
        chat.is_narrator(user, system, kind).alias("narrator"), md5(chat.message_text(*said)).alias("text_md5"), md5(chat.host_message_text(*said)).alias("host_md5"),
    )


_ESC = "replace(replace(replace(replace({0}, '%', '%25'), ' ', '%20'), ':', '%3A'), '#', '%23')"


@query(f"""with k as (select p_partkey, case p_partkey % 3 when 0 then 'group' when 1 then 'chat' else 'room' end as kind, trim(p_name) as owner, trim(regexp_replace(p_brand || ' 50%: ' || p_partkey || '.JSONL', '(?i)\\.jsonl$', '')) as chat from part)
select p_partkey, case when kind = 'room' then '' else kind || ':' || {_ESC.format('owner')} || ':' || {_ESC.format('chat')} end as key, case when kind <> 'room' then kind end as back_kind, case when kind <> 'room' then owner end as back_owner, case when kind <> 'room' then chat end as back_chat from k""")
def chat_keys(spark, d):
    k = F.col("p_partkey") % 3
    key = chat.chat_key(F.when(k == 0, "group").when(k == 1, "chat").otherwise("room"), F.col("p_name"), F.concat("p_brand", F.lit(" 50%: "), "p_partkey", F.lit(".JSONL")))
    rows = read(spark, d, "part").select("p_partkey", key.alias("key")).withColumn("back", chat.parsed_chat_key(F.col("key")))
    return rows.select("p_partkey", "key", F.col("back.kind").alias("back_kind"), F.col("back.owner").alias("back_owner"), F.col("back.chat").alias("back_chat"))


@query(f"""with o as (select o_orderkey, o_custkey, o_orderstatus, case o_orderkey % 4 when 0 then 'rebuild:' || o_custkey || ':7:' || o_orderkey when 1 then 'rebuild:1:2:' || o_custkey || ':x' when 2 then 'rebuild:1:2:' || o_custkey || 'x' else 'capture:1' end as op from orders)
select o_orderkey, 'wsr_' || {fnv("(o_custkey || '|' || o_orderkey || '|' || o_orderstatus || '|0')")} as record_id, 'wse_' || {fnv("(o_custkey || '|r|' || o_orderkey || '|' || o_orderstatus || '|1|' || op)")} as evidence_id, 'wsl_' || {fnv("(o_custkey || '|a|b|related|' || o_orderkey || '|' || o_orderstatus)")} as link_id,
case o_orderkey % 4 when 0 then o_orderkey when 1 then o_custkey end as rebuild_start, greatest(1, case when o_orderkey % 3 = 0 then -1 else o_custkey % 5 end + 1) as earliest from o""")
def entity_ids(spark, d):
    k, who, lit = F.col("o_orderkey"), F.col("o_custkey"), F.lit
    op = F.when(k % 4 == 0, F.concat(lit("rebuild:"), who, lit(":7:"), k)).when(k % 4 == 1, F.concat(lit("rebuild:1:2:"), who, lit(":x"))).when(k % 4 == 2, F.concat(lit("rebuild:1:2:"), who, lit("x"))).otherwise("capture:1")
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", op.alias("op"))
    state = F.col("o_orderstatus")
    return orders.select(
        "o_orderkey", chat.record_id(who, k, state, lit(0)).alias("record_id"), chat.evidence_id(who, lit("r"), k, state, lit(1), F.col("op")).alias("evidence_id"), chat.link_id(who, lit("a"), lit("b"), lit("related"), k, state).alias("link_id"),
        chat.rebuild_start(F.col("op")).alias("rebuild_start"), chat.earliest_partial_start(F.when(k % 3 != 0, who % 5)).alias("earliest"),
    )


@query("""with v as (select o_orderkey as k, case o_orderkey % 6 when 0 then '' when 1 then cast(o_totalprice as varchar) when 2 then '-3.7' when 3 then 'x' when 4 then '0.5' end as v from orders), n as (select k, try_cast(v as double) as n from v)
select k, cast(case when n is null then 5 else greatest(1, least(100, trunc(n))) end as bigint) as whole, cast(case when n >= 1 then least(2400, floor(n)) else 300 end as bigint) as tokens from n""")
def bounded_numbers(spark, d):
    k = F.col("o_orderkey")
    value = F.when(k % 6 == 0, "").when(k % 6 == 1, F.col("o_totalprice").cast("string")).when(k % 6 == 2, "-3.7").when(k % 6 == 3, "x").when(k % 6 == 4, "0.5")
    return read(spark, d, "orders").select(k.alias("k"), chat.bounded_int(value, 5, 1, 100).alias("whole"), chat.budget(value, 300).alias("tokens"))


_LINEAGE = "with f as (select conv_id, turn, {1} as role, '{{\"content\":' || cast(to_json(coalesce(text, '')) as varchar) || ',\"is_system\":' || {0} || ',\"is_user\":' || (role = 'user') || ',\"name\":\"\",\"role\":' || cast(to_json({1}) as varchar) || '}}' as j from conversations)"


@query(f"""with recursive {_LINEAGE.format("(role = 'system')", "coalesce(role, '')")[5:]}, n as (select conv_id, {fnv('j')} as f, row_number() over (partition by conv_id order by turn) as k from f),
c as (select conv_id, k, 'ln_' || {fnv("('root|' || f)")} as key from n where k = 1 union all select n.conv_id, n.k, 'ln_' || {fnv("(c.key || '|' || n.f)")} from c join n on n.conv_id = c.conv_id and n.k = c.k + 1)
select conv_id, max(k) || ':' || arg_max(key, k) as head from c group by conv_id""")
def chat_heads(spark, d):
    return log.heads(log.lineage(messages(spark, d))).withColumnRenamed("chat", "conv_id")


@query(f"""with recursive {_LINEAGE.format("'false'", "coalesce(role, '')")[5:]}, n as (select conv_id, turn, {fnv('j')} as f, row_number() over (partition by conv_id order by turn) as k from f),
c as (select conv_id, turn, k, 'cl_' || {fnv("('root|' || f)")} as key from n where k = 1 union all select n.conv_id, n.turn, n.k, 'cl_' || {fnv("(c.key || '|' || n.f)")} from c join n on n.conv_id = c.conv_id and n.k = c.k + 1)
select conv_id, turn, key as content_key from c""")
def content_lineage(spark, d):
    return log.content_lineage(messages(spark, d)).select(F.col("chat").alias("conv_id"), F.col("pos").alias("turn"), "content_key")


#: Sentences about places made of parts by a rule.
_PLACES = """(select p_partkey, p_name, p_name || ' lies at ' || case p_partkey % 4 when 0 then '[' || p_size || ', -' || p_partkey || '.5]' when 1 then '(' || p_partkey || ' , +' || p_size || ')' when 2 then '**x**: ' || p_size || ', **y**: ' || p_partkey else 'no place' end
  || ', ' || case p_partkey % 3 when 0 then '1,250.5 km north as the crow flies' when 1 then p_size || ' kilometers by road' else p_size || ' km away' end || '.' as said from part)"""
_NUM = r"([+-]?\d+(?:\.\d+)?)"


@query(rf"""with c as (select p_partkey, 0 as f, unnest(regexp_extract_all(said, '\[\s*{_NUM}\s*,\s*{_NUM}\s*\]')) as m from {_PLACES} union all select p_partkey, 1, unnest(regexp_extract_all(said, '\(\s*{_NUM}\s*,\s*{_NUM}\s*\)')) from {_PLACES}
  union all select p_partkey, 2, unnest(regexp_extract_all(said, '(?i)\*\*x\*\*:\s*{_NUM},\s*\*\*y\*\*:\s*{_NUM}')) from {_PLACES})
select p_partkey, cast(regexp_extract_all(m, '[+-]?\d+(?:\.\d+)?')[1] as double) as x, cast(regexp_extract_all(m, '[+-]?\d+(?:\.\d+)?')[2] as double) as y from c""")
def coordinates_in_text(spark, d):
    return spatial_text.coordinates(_said(spark, d), "p_partkey", "said").select("p_partkey", "x", "y")


def _said(spark, d):
    k, size, lit = F.col("p_partkey"), F.col("p_size"), F.lit
    where = F.when(k % 4 == 0, F.concat(lit("["), size, lit(", -"), k, lit(".5]"))).when(k % 4 == 1, F.concat(lit("("), k, lit(" , +"), size, lit(")"))).when(k % 4 == 2, F.concat(lit("**x**: "), size, lit(", **y**: "), k)).otherwise("no place")
    far = F.when(k % 3 == 0, "1,250.5 km north as the crow flies").when(k % 3 == 1, F.concat(size, lit(" kilometers by road"))).otherwise(F.concat(size, lit(" km away")))
    return read(spark, d, "part").select("p_partkey", "p_name", "p_size", F.concat("p_name", lit(" lies at "), where, lit(", "), far, lit(".")).alias("said"))


@query(f"""select p_partkey, case p_partkey % 3 when 0 then 1250.5 else cast(size as double) end as km, case p_partkey % 3 when 0 then 'straight_line' when 1 then 'route' else 'unspecified' end as mode
from (select p.p_partkey, p_size as size from {_PLACES} s join part p using (p_partkey))""")
def distances_in_text(spark, d):
    rows = _said(spark, d).withColumn("km", F.element_at(spatial_text.distances(F.col("said")), 1))
    return rows.select("p_partkey", "km", spatial_text.distance_mode(F.lit("straight_line"), F.col("km"), F.array("said")).alias("mode"))


@query(f"""with n as (select p_partkey, p_name, {canon('p_name')} as c, {canon('said')} as hay, case p_partkey % 5 when 0 then 'the road' when 1 then 'A clearing' when 2 then '' else p_name end as place from {_PLACES})
select p_partkey, length({canon('place')}) < 2 or list_contains({_LIST(spatial_text.SCENERY)}, {canon('place')}) as scenery,
  case when {canon('place')} = '' then 0 when {holds_sql('hay', canon('place'))} then 10 + least(2, length({canon('place')}) / 10) when len(string_split({canon('place')}, ' ')) > 1 and len(list_filter(string_split({canon('place')}, ' '), lambda w: not list_contains(string_split(hay, ' '), w))) = 0 then 6 else 0 end as strength,
  {canon('place')} <> '' and ((length({canon('place')}) >= 2 and {holds_sql('hay', canon('place'))}) or (len(string_split({canon('place')}, ' ')) between 2 and 4 and len(list_filter(string_split({canon('place')}, ' '), lambda w: not list_contains(string_split(hay, ' '), w))) = 0
  and len(list_filter(string_split({canon('place')}, ' '), lambda w: length(w) >= 3 and not list_contains({_LIST(spatial_text.PLACE_WORDS)}, w))) > 0)) as grounded from n""")
def place_names(spark, d):
    k = F.col("p_partkey")
    rows = _said(spark, d).withColumn("place", F.when(k % 5 == 0, "the road").when(k % 5 == 1, "A clearing").when(k % 5 == 2, "").otherwise(F.col("p_name")))
    name, said = F.col("place"), F.col("said")
    return rows.select("p_partkey", spatial_text.is_scenery(name).alias("scenery"), spatial_text.name_strength(name, said).alias("strength"), spatial_text.name_grounded(name, F.array("said"), F.array("said")).alias("grounded"))
