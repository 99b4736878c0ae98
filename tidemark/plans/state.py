"""Queries of place retrieval, journals, parking and checks of state, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import elapsed, lexical
from tidemark.operators import evolution, journal, place_search, places
from tidemark.plans.catalogue import canon, messages, query, read
from tidemark.plans.texts import holds_sql
from tidemark.plans.views import _FN
from tidemark.sources import envelopes

_PL = "sp as (select p_partkey as id, p_name || case when p_partkey % 9 = 0 then ' über ' || p_brand else '' end as name, p_type || ' by the ' || p_brand as context, [p_name || ' way', 'The ' || p_brand] as routes from part)"


def _places(spark, d):
    k = F.col("p_partkey")
    name = F.concat("p_name", F.when(k % 9 == 0, F.concat(F.lit(" über "), "p_brand")).otherwise(""))
    return read(spark, d, "part").select(k.alias("id"), name.alias("name"), F.concat("p_type", F.lit(" by the "), "p_brand").alias("context"), F.array(F.concat("p_name", F.lit(" way")), F.concat(F.lit("The "), "p_brand")).alias("routes"))


def _content(column: str) -> str:
    return f"list_distinct(list_filter(string_split({canon(column)}, ' '), lambda w: w <> '' and not list_contains({_FN}, w)))"


_COMPACT = f"replace({canon('name')}, ' ', '')"
_PAIRS = f"list_distinct(list_filter(list_transform(range(1, length({_COMPACT})), lambda i: substr({_COMPACT}, i, 2)), lambda g: regexp_matches(g, '[^\\x00-\\x7F]')))"
_POST = f"""post as (select id, 'name' as kind, {canon('name')} as term from sp union all select id, 'route', unnest(list_transform(routes, lambda r: {canon('r')})) from sp union all select id, 'pair', unnest({_PAIRS}) from sp
  union all select id, 'name_word', unnest({_content('name')}) from sp union all select id, 'context_word', unnest({_content('context')}) from sp)"""


@query(f"with {_PL}, {_POST} select id, kind, term from post")
def place_postings(spark, d):
    return place_search.postings(_places(spark, d))


@query(f"""with {_PL.replace('from part)', "from part where p_partkey % 7 <> 1)").replace("p_name || case when", "case when p_partkey % 5 = 0 then 'New ' else '' end || p_name || case when")}, {_POST} select id, kind, term from post""")
def place_postings_updated(spark, d):
    """After every fifth place was renamed and every seventh removed."""
    own = _places(spark, d)
    changed = own.filter("id % 5 = 0").withColumn("name", F.concat(F.lit("New "), "name"))
    return place_search.updated(place_search.postings(own), changed, own.filter("id % 7 = 1").select("id"))


_RECENT, _LORE = "they rode from the small ring way to brand 17 and a red widget über all", "the blue bolt by brand 4"


def _phrases(text: str) -> list[str]:
    own = text.split()
    return sorted({" ".join(own[i : i + k]) for i in range(len(own)) for k in range(1, 5) if i + k <= len(own)})


def _wanted() -> str:
    rows = []
    for text, side in ((_RECENT, 0), (_LORE, 1)):
        own, joined = [w for w in dict.fromkeys(text.split()) if w not in lexical.FUNCTION_WORDS], text.replace(" ", "")
        terms = {"name": _phrases(text), "route": _phrases(text), "pair": sorted({joined[i : i + 2] for i in range(len(joined) - 1) if not joined[i : i + 2].isascii()}), "name_word": own, "context_word": own}
        rows += [f"('{k}', '{t}', {place_search.WEIGHTS[k][side]})" for k, ts in terms.items() for t in ts if place_search.WEIGHTS[k][side]]
    return "want(kind, term, weight) as (values " + ", ".join(rows) + ")"


def _strength(text: str) -> str:
    name, said = canon("name"), "['" + "', '".join(text.split()) + "']"
    return f"case when {holds_sql(repr(text), name)} then 10 + least(2, length({name}) / 10) when contains({name}, ' ') and len(list_filter(string_split({name}, ' '), lambda w: not list_contains({said}, w))) = 0 then 6 else 0 end"


@query(f"""with {_PL}, {_POST}, {_wanted()}, s as (select id, sum(cast(weight as double)) as seed, bool_or(kind in ('name', 'route')) as phrase, count(distinct case when kind not in ('name', 'route') then term end) as words from post join want using (kind, term) group by id),
n as (select s.*, {_strength(_RECENT)} * 10 + {_strength(_LORE)} * 4 as named from s join sp using (id))
select id, round(seed + named, 6) as score from n where named > 0 or (seed >= 24 and (phrase or words >= 2)) order by score desc, id limit 6""")
def places_found(spark, d):
    own = _places(spark, d)
    return place_search.find(own, place_search.postings(own), _RECENT, _LORE)


@query("""with o as (select s_suppkey as id, case when s_suppkey % 3 = 0 then s_suppkey % 40 end as base_id from supplier)
select id, case when base_id < 25 then base_id else id end as effective_id from o""")
def effective_place_ids(spark, d):
    own = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") % 40).alias("base_id"))
    return places.effective_ids(own, read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id")))


@query(f"""with recursive m as (select p_partkey as id, {canon("p_brand || ' ' || (p_partkey % 30)")} as k, case when p_partkey % 3 = 0 then 'active' else 'archived' end as status, case when p_partkey % 3 = 1 and p_partkey > 1 then p_partkey - 1 when p_partkey % 6 = 2 then p_partkey - 1 end as into_ from part),
f as (select k, min(id) as start from m where status = 'archived' and into_ is not null and k not in (select k from m where status = 'active') group by k), c as (select k, start as cur, 0 as n from f union all select c.k, m.into_, n + 1 from c join m on c.cur = m.id where m.into_ is not null and n < 8),
e as (select k, arg_max(cur, n) as id from c group by k) select e.k as name_key, e.id from e join m on m.id = e.id where m.status = 'active'""")
def merge_targets(spark, d):
    k = F.col("p_partkey")
    into = F.when((k % 3 == 1) & (k > 1), k - 1).when(k % 6 == 2, k - 1)
    return places.merge_targets(read(spark, d, "part").select(k.alias("id"), F.concat("p_brand", F.lit(" "), (k % 30).cast("string")).alias("name"), F.when(k % 3 == 0, "active").otherwise("archived").alias("status"), into.alias("merged_into")))


@query(f"select {canon('p_name')} as name_key, arg_min(p_partkey, -p_partkey) as id from part group by 1")
def routes_named(spark, d):
    return places.routes_by_name(read(spark, d, "part").select((-F.col("p_partkey")).alias("place"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query("""with e as (select vec_id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, vec_id % 4 as k from embeddings)
select vec_id as effective_id, case when k = 1 then round(x + 1, 9) else x end as x, case when k = 1 then round(y - 1, 9) else y end as y from e""")
def coordinates_now(spark, d):
    """A quarter of the places has moved, another one has an archived entry, another one an entry without a coordinate."""
    own = read(spark, d, "embeddings").select(F.col("vec_id").alias("effective_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    k = F.col("effective_id") % 4
    moved = own.select("effective_id", F.when(k == 2, "archived").otherwise("active").alias("status"), F.when(k != 3, F.round(F.col("x") + 1, 9)).alias("x"), F.round(F.col("y") - 1, 9).alias("y")).filter("effective_id % 4 > 0")
    return places.current_coordinates(own, moved)


@query("select count(*) as n from part where p_size % 4 = 0")
def places_active(spark, d):
    return places.active_count(read(spark, d, "part").select(F.when(F.col("p_size") % 4 == 0, "active").otherwise("archived").alias("status")))


def _orders(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("place"), F.col("o_orderstatus").alias("status"))


def _after(before):
    return before.filter("o_orderkey % 13 <> 0").withColumn("status", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("status"))).unionByName(before.filter("o_orderkey % 17 = 0").withColumn("o_orderkey", -F.col("o_orderkey") - 1).withColumn("place", F.col("place") + 10_000_000))


@query("""select o_orderkey, case when o_orderkey % 13 = 0 then 'removed' else 'changed' end as change, case when o_orderkey % 13 = 0 then o_orderkey end as "at", o_orderstatus as before_status from orders where o_orderkey % 13 = 0 or (o_orderkey % 7 = 0 and o_orderstatus <> 'X')
union all select -o_orderkey - 1, 'added', null, null from orders where o_orderkey % 17 = 0""")
def positioned_diff(spark, d):
    before = _orders(spark, d)
    return journal.positioned_undo(before, _after(before), "o_orderkey").select("o_orderkey", "change", "at", F.col("before.status").alias("before_status"))


@query("select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as place, o_orderstatus as status, o_custkey from orders")
def positioned_round_trip(spark, d):
    """The orders of each customer as a list."""
    from pyspark.sql import Window

    place = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long")
    before = read(spark, d, "orders").select("o_orderkey", place.alias("place"), F.col("o_orderstatus").alias("status"), "o_custkey")
    after = _after(before)
    return journal.restore_positioned(after, journal.positioned_undo(before, after, "o_orderkey"), "o_orderkey", of="o_custkey").select("o_orderkey", "place", "status", "o_custkey")


@query("""with e as (select user_id as chat, event_id as seq, event_id - 1 as prev_seq, event_id % 90 - 5 as b, row_number() over (partition by user_id order by event_id desc) as n from events), k as (select *, row_number() over (partition by chat order by seq) as r from e where n <= 20)
select chat, seq, case when r = 1 then 0 else prev_seq end as prev_seq, b as before_message, greatest(-1, first_value(b) over (partition by chat order by seq)) as floor from k""")
def journal_trimmed(spark, d):
    k = F.col("event_id")
    return journal.trim_journal(read(spark, d, "events").select(F.col("user_id").alias("chat"), k.alias("seq"), (k - 1).alias("prev_seq"), (k % 90 - 5).alias("before_message")), newest=20)


@query("""with l as (select conv_id as chat, turn as pos, 'k' || turn || '-' || (conv_id % 3) as lineage_key from conversations),
p as (select conv_id as chat, turn as park, turn - 1 as base, case when turn = 0 then 'root' else 'k' || (turn - 1) || '-' || (conv_id % 3) end as base_key, 'k' || turn || '-' || (turn % 3) as first_key, 'h' || (turn % 2) as base_hash from conversations),
s as (select distinct conv_id as chat, 'h' || (conv_id % 2) as hash, conv_id % 4 as top from conversations)
select p.chat, max(park) as park from p join s on p.chat = s.chat join l b on b.chat = p.chat and b.pos = p.base + 1 left join l a on a.chat = p.chat and a.pos = p.base where b.lineage_key = first_key and (base < 0 or a.lineage_key = base_key) and top <= base and hash = base_hash group by p.chat""")
def branches_resumable(spark, d):
    c, t, text = F.col("conv_id"), F.col("turn"), lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    own = read(spark, d, "conversations").select("conv_id", "turn")
    lineage = own.select(c.alias("chat"), t.alias("pos"), text("k", t, "-", c % 3).alias("lineage_key"))
    parks = own.select(c.alias("chat"), t.alias("park"), (t - 1).alias("base"), F.when(t == 0, "root").otherwise(text("k", t - 1, "-", c % 3)).alias("base_key"), text("k", t, "-", t % 3).alias("first_key"), text("h", t % 2).alias("base_hash"))
    states = own.select(c.alias("chat"), text("h", c % 2).alias("hash"), (c % 4).alias("journal_top")).distinct()
    return journal.resumable(parks, lineage, states)


@query("""with j as (select o_custkey, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' as j from orders)
select o_custkey, count(*) || ':' || cast(sum(cast('0x' || substr(md5(j), 1, 12) as bigint)) as bigint) as hash from j group by o_custkey""")
def state_hashes(spark, d):
    return journal.content_hashes(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey")


@query("""with r as (select p_partkey as id, [p_partkey, p_partkey + 3] as ev, [p_partkey * 2] as ca from part), e as (select p_partkey as id, [p_partkey + 1] as re from part where p_partkey % 5 > 0 union all select p_partkey, [p_partkey] from part where p_partkey % 11 = 1), l as (select l_partkey as f, l_orderkey as t from lineitem)
select distinct kind, cast(id as varchar) as id, cast(other as varchar) as other from (select 'repeated evidence' as kind, id, null as other from e group by id having count(*) > 1 union all select 'no evidence', id, o from (select id, unnest(ev) as o from r) where o not in (select id from e)
union all select 'no cause', id, o from (select id, unnest(ca) as o from r) where o not in (select id from r) union all select 'no record', id, o from (select id, unnest(re) as o from e) where o not in (select id from r) union all select 'no end', f, o from (select f, unnest([f, t]) as o from l) where o not in (select id from r))""")
def integrity_faults(spark, d):
    k = F.col("p_partkey")
    part = read(spark, d, "part")
    records = part.select(k.alias("id"), F.array(k, k + 3).alias("evidence_ids"), F.array(k * 2).alias("caused_by"))
    evidence = part.filter(k % 5 > 0).select(k.alias("id"), F.array(k + 1).alias("record_ids")).unionByName(part.filter(k % 11 == 1).select(k.alias("id"), F.array(k).alias("record_ids")))
    links = read(spark, d, "lineitem").select(F.col("l_partkey").alias("from"), F.col("l_orderkey").alias("to"))
    return journal.integrity_faults(records, evidence, links)


@query("""with e as (select o_orderkey, unnest([o_orderkey % 12000, (o_orderkey * 7) % 11000, o_orderkey % 12000]) as id from orders), s as (select event_id as id, case event_type when 'view' then 'time' when 'click' then 'current' else 'historical' end as type, event_id % 2 = 0 as m from events),
x as (select distinct o_orderkey, e.id, type, m from e left join s on e.id = s.id)
select o_orderkey, count(id) = count(type) as known, count(*) filter (type in ('time', 'current')) as triggers, coalesce(bool_or(type = 'current'), false) or (coalesce(bool_or(type = 'time' and m), false) and coalesce(bool_or(type = 'historical'), false)) as supported from x group by o_orderkey""")
def change_support(spark, d):
    k, kind = F.col("o_orderkey"), F.col("event_type")
    rows = read(spark, d, "orders").select(k.alias("evaluation"), F.array(k % 12000, (k * 7) % 11000, k % 12000).alias("support_ids"))
    supports = read(spark, d, "events").select(F.col("event_id").alias("id"), F.when(kind == "view", "time").when(kind == "click", "current").otherwise("historical").alias("type"), (F.col("event_id") % 2 == 0).alias("meaningful"))
    return evolution.causal_support(rows, supports).withColumnRenamed("evaluation", "o_orderkey")


#: What is told after each turn: a phrase, and what it says (amount, unit, whether it is meaningful); some tell nothing.
_TOLD = (
    ("Two days later, they left", "Two days later", 2, "day", True), ("After three weeks the road was open", "After three weeks", 3, "week", True), ("He waits after two weeks of rain", None, None, None, None), ("Weeks later nobody knew", "Weeks later", None, "week", True),
    ("A fortnight has passed", "A fortnight has passed", 2, "week", True), ("twenty-five hours on.", "twenty-five hours on", 25, "hour", False), ("a week on foot", None, None, None, None), ("The next month came", "The next month", 1, "month", True), ("the following day", "the following day", 1, "day", False),
    ("60 hours had gone by", "60 hours had gone by", 60, "hour", True), ("a few days later", "few days later", None, "day", True), ("someday laterally", None, None, None, None),
)
_TOLD_SQL = ", ".join("(" + ", ".join([str(k), *("null" if v is None else repr(v) if isinstance(v, str) else str(v).lower() for v in row[1:])]) + ")" for k, row in enumerate(_TOLD) if row[1])


@query(f"""select conv_id, turn, raw, cast(amount as int) as amount, unit, meaningful from conversations join (values {_TOLD_SQL}) t(k, raw, amount, unit, meaningful) on k = (conv_id * 5 + turn) % {len(_TOLD)}""")
def elapsed_phrases(spark, d):
    """Turns, which tell of no time by themselves, with a phrase after each."""
    told = F.element_at(lexical.listed(tuple(x[0] for x in _TOLD)), (1 + (F.col("chat") * 5 + F.col("pos")) % len(_TOLD)).cast("int"))
    rows = messages(spark, d).select("chat", "pos", F.explode(elapsed.phrases_of_time(F.concat("text", F.lit("\n"), told))).alias("p"))
    return rows.select(F.col("chat").alias("conv_id"), F.col("pos").alias("turn"), "p.raw", F.col("p.amount").cast("int").alias("amount"), "p.unit", "p.meaningful")


_EV = '"evidence":[{"sourceMessageId":1,"claim":"it is so"}]'
#: Rows of replies, and why each isn't taken (none: it is) and how many names were repaired.
_REPLIES = (
    ('{"action":"create","kind":"fact","summary":"S",' + _EV + "}", None, 0), ('{"action":"create","category":"development","description":"S",' + _EV + "}", None, 2), ('{"action":"create","kind":"fact","category":"development","summary":"S",' + _EV + "}", "conflicting names", 0),
    ('{"action":"create","kind":"fact","summary":"S"}', "no evidence", 0), ('{"action":"create","kind":"rumour","summary":"S",' + _EV + "}", "needs kind and summary", 0), ('{"action":"create","kind":"fact","summary":"S","recordId":"r",' + _EV + "}", "a new record has no id yet", 0),
    ('{"action":"create","kind":"fact","summary":"S","status":"superseded",' + _EV + "}", "unsupported status", 0), ('{"action":"update","summary":"S",' + _EV + "}", "needs a record", 0), ('{"action":"update","recordId":"r",' + _EV + "}", "nothing to update", 0),
    ('{"action":"update","recordId":"r","trend":"rising",' + _EV + "}", None, 0), ('{"action":"resolve","recordId":"r","evidence":[{"sourceMessageId":-1,"claim":"x"}]}', "evidence without message or claim", 0), ('{"action":"noop"}', None, 0), ('{"action":"forget"}', "unsupported action", 0),
)
_REPLY_SQL = ", ".join(f"({k}, {'null' if r[1] is None else repr(r[1])}, {r[2]})" for k, r in enumerate(_REPLIES))


@query(f"""with o as (select o_orderkey as id, unnest(range(0, cast(1 + o_orderkey % 11 as bigint))) as ordinal from orders where o_orderkey % 7 <> 3), v(k, reason, repairs) as (values {_REPLY_SQL})
select id, cast(ordinal as int) as ordinal, case when ordinal >= 8 then 'capped' else reason end as reason, repairs from o join v on k = (id + ordinal * 5) % {len(_REPLIES)} union all select o_orderkey, -1, 'not one object with mutations', null from orders where o_orderkey % 7 = 3""")
def replies_checked(spark, d):
    """Replies of one to eleven rows by a rule on the order's key, some in a code fence, some with prose around."""
    k = F.col("o_orderkey")
    rows = F.transform(F.sequence(F.lit(0).cast("long"), k % 11), lambda i: F.element_at(lexical.listed(tuple(r[0] for r in _REPLIES)), (1 + (k + i * 5) % len(_REPLIES)).cast("int")))
    body = F.concat(F.lit('{"mutations":['), F.array_join(rows, ","), F.lit("]}"))
    reply = F.when(k % 7 == 3, F.concat(F.lit("Here it is: "), body)).when(k % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return envelopes.parse_replies(read(spark, d, "orders").select(k.alias("id"), reply.alias("reply"))).select("id", "ordinal", "reason", "repairs")
