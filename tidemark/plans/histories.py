"""Queries of whole batches, restoring and parking, and their SQL.

The events are the log: a user is a chat, an event type a key of its state, the event's properties the value.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import lexical, narrative, placing
from tidemark.operators import days, derivation, derived, rendering, restore, transactions
from tidemark.plans.catalogue import messages, query, read
from tidemark.sources import envelopes


@query(f"""with e as (select *, event_id // 6 as batch, case when event_id % 7 < 3 then 'create' when event_id % 7 = 6 then 'resolve' else 'update' end as action, (event_id // 6) % 11 = 3 as refused from events),
f as (select *, min(case when action = 'create' and not refused then event_id end) over (partition by user_id, event_type) as born from e),
g as (select *, min(case when action = 'resolve' and not refused and event_id > born then event_id end) over (partition by user_id, event_type, batch) as ended from f),
o as (select *, case when refused then '{transactions.REFUSED}' when action = 'create' then case when event_id = born then 'applied' else 'record exists' end when born is null or event_id < born then 'no such record' when event_id > ended then 'ended in this batch' else 'applied' end as outcome from g),
v as (select user_id, min(born) as view_born from o where event_type = 'view' group by user_id)
select user_id, event_type, count(*) filter (outcome = 'applied') as n_applied, count(*) filter (outcome = '{transactions.REFUSED}') as n_refused, count(*) filter (outcome = 'ended in this batch') as n_late,
  arg_max(props, case when outcome = 'applied' then event_id end) as summary, case when bool_or(outcome = 'applied' and action = 'resolve') then 'resolved' else 'active' end as status, min(born) // 6 as created,
  max(case when outcome = 'applied' then batch end) as evaluated, least(32, count(*) filter (outcome = 'applied')) as n_evidence, coalesce(bool_or(event_type <> 'view' and outcome = 'applied' and event_id > view_born), false) as linked
from o left join v using (user_id) group by all having count(*) filter (outcome = 'applied') > 0""")
def batches_reduced(spark, d):
    """Batches of six events: a chat's events create, update and resolve a record for each event type; every eleventh batch lacks its lineage."""
    k, none = F.col("event_id"), lambda kind="string": F.lit(None).cast(kind)
    batch = F.floor(k / 6).cast("long")
    claim = F.struct(F.concat_ws(" ", "props", k.cast("string")).alias("claim"), none().alias("source_class"), none("long").alias("message"), none().alias("lineage"), none().alias("time_anchor"))
    given = {
        "chat": F.col("user_id"), "batch": batch, "ordinal": k, "message": batch, "lineage": F.when(batch % 11 != 3, F.concat(F.lit("l"), batch.cast("string"))), "action": F.when(k % 7 < 3, "create").when(k % 7 == 6, "resolve").otherwise("update"), "record": F.col("event_type"),
        "kind": F.lit("fact"), "summary": F.col("props"), "related": F.array(F.lit("view")), "evidence": F.array(claim),
    }
    rows = read(spark, d, "events").select(*((given[c] if c in given else none("array<string>" if c in transactions.LISTS else "string")).alias(c) for c in ("chat", *transactions.COLUMNS)))
    found = transactions.transact(rows)
    counts = found.outcomes.groupBy("chat", "record").agg(*(F.count_if(F.col("outcome") == x).alias(n) for n, x in (("n_applied", "applied"), ("n_refused", transactions.REFUSED), ("n_late", "ended in this batch"))))
    linked = found.links.select("chat", F.explode(F.array("from", "to")).alias("record")).filter("record <> 'view'").distinct().withColumn("linked", F.lit(True))
    both = found.records.join(counts, ["chat", "record"]).join(linked, ["chat", "record"], "left")
    return both.select(F.col("chat").alias("user_id"), F.col("record").alias("event_type"), "n_applied", "n_refused", "n_late", "summary", "status", "created", "evaluated", F.size("evidence_ids").cast("long").alias("n_evidence"), F.coalesce("linked", F.lit(False)).alias("linked"))


_NEWEST, _POINTS = 40, 25


def _history(spark, d) -> dict:
    """A chat's events as messages: each changes one key. The newest entries are kept, a snapshot stands at every 25th message; some chains are broken, some messages were edited unseen."""
    own = Window.partitionBy("chat").orderBy("pos")
    rows = read(spark, d, "events").select(F.col("user_id").alias("chat"), F.col("event_id").alias("pos0"), F.col("event_type").alias("key"), F.col("props").alias("value"))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("chat").orderBy("pos0")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("chat")))
    # A log whose edits nothing recorded: the key of the last message but one isn't what its entry was written with.
    edited = (F.col("chat") % 11 == 5) & (F.col("pos") == F.col("n") - 2)
    lineage = rows.select("chat", "pos", F.concat(F.when(edited, "x").otherwise("k"), F.col("pos0").cast("string")).alias("lineage_key"))
    written = rows.select("chat", (F.col("pos") + 1).cast("long").alias("seq"), F.col("pos").cast("long").alias("prev_seq"), F.col("pos").alias("message"), (F.col("pos") - 1).alias("before_message"), F.concat(F.lit("k"), F.col("pos0").cast("string")).alias("lineage_key"), "n", "key", F.lag("value").over(Window.partitionBy("chat", "key").orderBy("pos")).alias("before"))
    written = written.filter((F.col("seq") > F.col("n") - _NEWEST) & ~((F.col("chat") % 7 == 2) & (F.col("seq") == F.col("n") - 3)))
    heads = rows.groupBy("chat").agg(F.max("n").cast("long").alias("head_seq"), (F.max("n") - 1).alias("head_message"), F.greatest(F.lit(-1), F.max("n") - _NEWEST - 1).alias("floor"))
    cuts = rows.select("chat", F.greatest(F.lit(0), F.col("n") - 1 - F.col("chat") % 50).cast("long").alias("cut")).distinct()
    state = rows.groupBy("chat", "key").agg(F.max_by("value", "pos").alias("value"))
    points = rows.filter(F.col("pos") % _POINTS == 0).select("chat", F.col("pos").alias("message"), F.concat(F.lit("k"), F.col("pos0").cast("string")).alias("lineage_key"))
    held = points.join(rows.select("chat", "key", "value", "pos"), "chat").filter("pos <= message").groupBy("chat", "message", "key").agg(F.max_by("value", "pos").alias("value"))
    return {"entries": written.drop("n", "key", "before"), "undo": written.select("chat", "seq", "key", "before"), "heads": heads, "cuts": cuts, "lineage": lineage, "state": state, "snapshots": points, "snapshot_rows": held, "rows": rows}


_HISTORY = f"""h as (select user_id, event_type, props, row_number() over (partition by user_id order by event_id) - 1 as pos, count(*) over (partition by user_id) as n from events),
c as (select distinct user_id, n, greatest(0, n - 1 - user_id % 50) as cut from h),
p as (select *, user_id % 7 = 2 and n - 4 >= cut and n > 3 as broken, user_id % 11 = 5 and n >= 2 and n - 2 >= cut as edited, cut - 1 >= greatest(-1, n - {_NEWEST} - 1) as near from c),
a as (select *, case when near and not broken and not edited then '{restore.JOURNAL}' when cut > 0 and (cut - 1) % {_POINTS} = 0 and not (user_id % 11 = 5 and cut - 1 = n - 2) then '{restore.SNAPSHOT}' else '{restore.FAIL}' end as action from p)"""


def _plan(h: dict):
    walk = transactions._kept(restore.walked(h["entries"], h["heads"], h["cuts"], h["lineage"]))
    return walk, transactions._kept(restore.plan(walk, h["entries"], h["heads"], h["cuts"], h["lineage"], h["state"], h["snapshots"], h["snapshot_rows"]))


@query(f"""with {_HISTORY} select user_id, cut, action, case when near and edited then n - 1 when near and broken then n - 3 end as broken_at from a""")
def restore_plans(spark, d):
    """How each chat gets back to before its cut, and where the chain of its journal breaks."""
    return _plan(_history(spark, d))[1].withColumnRenamed("chat", "user_id")


@query(f"""with {_HISTORY} select h.user_id, h.event_type, arg_max(props, pos) as value from h join a using (user_id) where action = '{restore.FAIL}' or pos < cut group by all""")
def states_restored(spark, d):
    """The state of all chats after going back: that of the log's rows before the cut."""
    h = _history(spark, d)
    walk, plan = _plan(h)
    return restore.restored(h["state"], h["undo"], walk, plan, h["snapshot_rows"]).select(F.col("chat").alias("user_id"), F.col("key").alias("event_type"), "value")


@query(f"""with {_HISTORY}, l as (select h.user_id, event_type, arg_max(props, pos) as v from h group by all), r as (select h.user_id, event_type, arg_max(props, pos) as v from h join a using (user_id) where pos < cut group by all),
x as (select l.user_id, l.event_type, l.v from l join a using (user_id) left join r on r.user_id = l.user_id and r.event_type = l.event_type where action <> '{restore.FAIL}' and l.v is distinct from r.v)
select user_id, cut - 1 as base, count(*) as n_keys from x join a using (user_id) group by all""")
def branches_parked(spark, d):
    """What chats that go back give up: the keys that change."""
    h = _history(spark, d)
    walk, plan = _plan(h)
    after = restore.restored(h["state"], h["undo"], walk, plan, h["snapshot_rows"])
    parks, rows, _ = restore.parked(h["state"], after, plan, h["lineage"])
    return parks.join(rows.groupBy("chat").agg(F.count("*").alias("n_keys")), "chat").select(F.col("chat").alias("user_id"), "base", "n_keys")


@query(f"""with {_HISTORY}, l as (select h.user_id, event_type, arg_max(props, pos) as value from h group by all) select user_id, event_type, value from l""")
def branches_resumed(spark, d):
    """Going back, and then on with the same messages: the parked rows give the state that was there before."""
    h = _history(spark, d)
    walk, plan = _plan(h)
    after = transactions._kept(restore.restored(h["state"], h["undo"], walk, plan, h["snapshot_rows"]))
    parks, rows, contents = restore.parked(h["state"], after, plan, h["lineage"])
    from tidemark.operators.journal import content_hashes

    hashes = content_hashes(after.select("chat", "key", "value"), "chat")
    top = restore.kept_heads(restore.kept_entries(h["entries"], plan), h["heads"], plan).select("chat", F.col("head_message").alias("journal_top"))
    states = h["heads"].select("chat").join(hashes, "chat", "left").join(top, "chat", "left").select("chat", F.coalesce("hash", F.lit("")).alias("hash"), "journal_top")
    _, found = restore.resumed(after, parks.withColumn("park", F.lit(1)), rows.withColumn("park", F.lit(1)), contents, h["lineage"], states)
    return found.select(F.col("chat").alias("user_id"), F.col("key").alias("event_type"), "value")


#: What is told after each turn: a phrase, whether it is a meaningful skip, and the day's step that it tells.
_DAYS = (("The next morning, the fog lifts.", False, "the next morning"), ("Nothing moves.", False, ""), ("The following day, the pass opens.", False, "the following day"), ("Three days later, the ford is reached.", True, ""), ("We leave the next day if it clears.", False, ""), ("After a day the rain stops.", False, "after a day"))


@query(f"""with recursive d(k, skip, step) as (values {", ".join(f"({k}, {str(x[1]).lower()}, '{x[2]}')" for k, x in enumerate(_DAYS))}),
r as (select conv_id, turn, case when role = 'user' then 'user' else 'assistant' end as role, skip, step, row_number() over (partition by conv_id order by turn) as k from conversations join d on d.k = (conv_id * 5 + turn * (conv_id % 4 + 1)) % {len(_DAYS)} where role <> 'system'),
e as (select *, false as f, 'x' as p, false as c0, '' as e0 from r),
w as (select conv_id, turn, k, role, case when step <> '' and not skip then 1 else 0 end as n, cast(null as bigint) as fired_at, skip or step <> '' as counted, role = 'assistant' and step <> '' as told, '' as echo from r where k = 1
  union all select conv_id, turn, k, role, case when skip or full_ then 0 when counts then n + 1 else n end, case when skip then null when full_ then turn else fired_at end, c or skip or repeats or counts, case when role = 'assistant' then says else told end, case when echoes then step else e end from (
    select *, counts and n + 1 >= 2 as full_ from (select *, says and not echoes and not repeats and not c as counts from (select *, says and not echoes and role = 'assistant' and e <> '' and step = e as repeats from (select *, says and fresh and told as echoes from (
      select r.conv_id, r.turn, r.k, r.role, r.skip, r.step, w.n, w.fired_at, w.told, r.role = 'user' and w.role = 'assistant' as fresh, not r.skip and r.step <> '' as says, not (r.role = 'user' and w.role = 'assistant') and w.counted as c, case when r.role = 'user' and w.role = 'assistant' then '' else w.echo end as e
      from w join r on r.conv_id = w.conv_id and r.k = w.k + 1)))))) select conv_id, turn, cast(fired_at as bigint) as fired_at, cast(2 as bigint) as n_days from w where fired_at is not null""")
def days_added(spark, d):
    """Where two day's steps have added up, as seen from each turn; turns tell of no time by themselves, so each gets a phrase."""
    told = F.element_at(lexical.listed(tuple(x[0] for x in _DAYS)), (1 + (F.col("chat") * 5 + F.col("pos") * (F.col("chat") % 4 + 1)) % len(_DAYS)).cast("int"))
    log = messages(spark, d).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), told))
    return days.accumulated(days.told_steps(log)).select(F.col("chat").alias("conv_id"), F.col("pos").alias("turn"), "fired_at", "n_days")


def _stripped(column: str) -> str:
    for name in narrative.BLOCKS:
        for pattern in (rf"<{name}(\s[^>]*)?/>", rf"<{name}(\s+[^>]*)?>.*?(</{name}\s*>|$)"):
            column = f"regexp_replace({column}, '{pattern}', '', 'gis')"
    return column


@query(f"""with p as (select page_id, page_id % 6 as f, coalesce(html, '') as h from pages),
t as (select page_id, case f when 0 then '<writer_state mode="x" />' || h when 1 then 'A<CYOA>' || h || '</CYOA >B<Inventory/>' when 2 then h || '<Arc_Phase>' || h when 3 then '<think>a<CYOA>b</think>' || h || '</CYOA>c' when 4 then h || '<Planted_Seeds x="1">' || h || '</Planted_Seeds>' || h else h end as t from p),
n as (select page_id, trim({_stripped('t')}, E' \t\n\x0B\f\r') as n from t) select page_id, length(n) as n_chars, md5(n) as narration_md5 from n""")
def narration_kept(spark, d):
    """Pages as replies, with blocks around and within them."""
    h, f = F.coalesce("html", F.lit("")), F.col("page_id") % 6
    forms = ((0, ('<writer_state mode="x" />', h)), (1, ("A<CYOA>", h, "</CYOA >B<Inventory/>")), (2, (h, "<Arc_Phase>", h)), (3, ("<think>a<CYOA>b</think>", h, "</CYOA>c")), (4, (h, '<Planted_Seeds x="1">', h, "</Planted_Seeds>", h)), (5, (h,)))
    text = F.coalesce(*(F.when(f == k, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))) for k, parts in forms))
    own = narrative.sanitized(text)
    return read(spark, d, "pages").select("page_id", own.alias("n")).select("page_id", F.length("n").cast("long").alias("n_chars"), F.md5(F.col("n").cast("binary")).alias("narration_md5"))


_BUDGET, _SHARE = 900, 250


@query(f"""with t as (select conv_id as chat, turn, trim(coalesce(text, ''), ' ') as t from conversations), n as (select *, least(length(t), {_SHARE}) + 1 as takes from t where t <> ''),
l as (select *, least({_SHARE}, {_BUDGET} - coalesce(sum(takes) over (partition by chat order by turn desc, t desc rows between unbounded preceding and 1 preceding), 0)) as most from n),
h as (select *, floor((most - 7) * 55 / 100) as head from l where most > 0)
select chat as conv_id, turn, case when length(t) <= most then t when most <= 7 then substr(t, 1, cast(most as bigint)) else substr(t, 1, cast(head as bigint)) || E'\\n[...]\\n' || right(t, cast(most - 7 - head as bigint)) end as text from h""")
def newest_texts(spark, d):
    """What of each conversation goes into a budget of characters, newest first."""
    own = messages(spark, d).select("chat", F.col("pos").alias("place"), "text")
    return rendering.newest_within(own, _BUDGET, _SHARE).select(F.col("chat").alias("conv_id"), F.col("place").alias("turn"), "text")


#: Fixed values of the text: what stands above the lines.
_HEADER = "Private notes. They tell what holds now:"


@query()
def notes_rendered(spark, d):
    """The turns of each conversation as lines of notes under a budget of 300 tokens; SQL doesn't express the cut of a line that doesn't fit."""
    k = F.col("chat") * 3 + F.col("pos")
    rows = messages(spark, d).select("chat", F.col("pos").alias("place"), F.concat(F.lit("t"), F.col("pos").cast("string")).alias("id"), F.when(k % 3 == 0, "development").otherwise("fact").alias("kind"), F.when(k % 2 == 0, "rising").alias("trend"), F.when(k % 7 == 0, "resolved").otherwise("active").alias("status"), F.col("text").alias("summary"))
    return rendering.rendered(rows, _HEADER, 300).select(F.col("chat").alias("conv_id"), "text", "tokens", F.array_join("included", ",").alias("included"))


_D = 0.7071067811865475
_SIDES = {"north": (0, 1), "northeast": (_D, _D), "east": (1, 0), "southeast": (_D, -_D), "south": (0, -1), "southwest": (-_D, -_D), "west": (-1, 0), "northwest": (-_D, _D)}


@query(f"""with recursive s(k, dx, dy) as (values {", ".join(f"({k}, cast({x} as double), cast({y} as double))" for k, (x, y) in enumerate(_SIDES.values()))}),
r as (select p_partkey as id, p_partkey // 3 as up, (1 + p_size % 5) * dx as dx, (1 + p_size % 5) * dy as dy from part join s on k = p_partkey % 8),
w as (select p_partkey as id, cast(p_size as double) as x, cast(p_partkey as double) as y, 0 as depth, cast(null as bigint) as via from part where p_partkey < 3
  union all select r.id, round(floor((w.x + r.dx) / 0.01 + 1e-12 + 0.5) * 0.01, 12), round(floor((w.y + r.dy) / 0.01 + 1e-12 + 0.5) * 0.01, 12), depth + 1, w.id from w join r on r.up = w.id where r.id >= 3)
select id, round(x, 6) as x, round(y, 6) as y, depth, via from w""")
def points_derived(spark, d):
    """Places of which each lies in some direction from another, and the first two have points; every third relation is told from the other end."""
    k, part = F.col("p_partkey"), read(spark, d, "part")
    at = k < 3
    places = part.select(k.alias("id"), F.when(at, F.col("p_size").cast("double")).alias("x"), F.when(at, k.cast("double")).alias("y"), F.lit("base_canonical").alias("authority"), F.lit(False).alias("locked"))
    up, names = F.floor(k / 3).cast("long"), list(_SIDES)
    told = F.element_at(lexical.listed(tuple(names)), (1 + k % 8).cast("int"))
    back = F.element_at(lexical.listed(tuple(names)), (1 + (k + 4) % 8).cast("int"))
    turned = (k % 3 == 0) & (k >= 3)
    relations = part.filter(k >= 3).select(F.when(turned, k).otherwise(up).alias("from"), F.when(turned, up).otherwise(k).alias("to"), F.when(turned, back).otherwise(told).alias("direction"), (1 + F.col("p_size") % 5).cast("double").alias("km"))
    found = derivation.derived_points(places, relations)
    return found.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "depth", "via")


@query("""with recursive s as (select distinct id, cause from (select p_partkey as id, unnest([p_partkey // 2, p_partkey // 3]) as cause from part) where id <> cause and cause > 0),
w as (select id, cause, 1 as depth from s union select w.id, s.cause, depth + 1 from w join s on s.id = w.cause where s.cause <> w.id)
select id, cause, cast(min(depth) as int) as depth from w group by all""")
def causes_closed(spark, d):
    """What each record follows from, through its causes' causes."""
    k = F.col("p_partkey")
    up = F.filter(F.array(F.floor(k / 2).cast("long"), F.floor(k / 3).cast("long")), lambda x: x > 0)
    return derived.all_causes(read(spark, d, "part").select(k.alias("id"), up.alias("caused_by")))


@query("""with s as (select p_partkey as id, p_partkey % 4 as f, p_partkey % 90 as x, p_size as y from part)
select id, case when f < 3 then x end as x, case when f < 3 then y end as y, case f when 0 then 'north' when 1 then 'south' when 2 then 'northeast' else 'west' end as direction from s""")
def places_told(spark, d):
    """Sentences of two places each: what point and direction they give the first. In a quarter the sentence has two pairs as near to its name."""
    k = F.col("p_partkey")
    first, second = F.concat(F.lit("Ashby"), k.cast("string")), F.concat(F.lit("Brin"), (k + 1).cast("string"))
    pair = lambda x, y: F.concat(F.lit("["), x.cast("string"), F.lit(", "), y.cast("string"), F.lit("]"))
    own, other = pair(k % 90, F.col("p_size")), pair(k % 7 + 100, F.lit(3))
    forms = (
        (first, " stands at ", own, ", north of ", second, " at ", other, "."),
        (second, " stands at ", other, ", north of ", first, " at ", own, "."),
        ("Due north-east of ", second, ", which is at ", other, ", the north wind meets ", first, " (", own, ")."),
        (own, " ", first, " ", other, " lies west of ", second, "."),
    )
    text = F.coalesce(*(F.when(k % 4 == n, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))) for n, parts in enumerate(forms)))
    rows = read(spark, d, "part").select(k.alias("id"), text.alias("text"), first.alias("a"), second.alias("b"))
    told = rows.select("id", placing.points_given(F.col("text"), F.col("a")).alias("p"), placing.directions_given(F.col("text"), F.col("a"), F.col("b")).alias("d"))
    return told.select("id", F.get("p", F.lit(0))["x"].cast("long").alias("x"), F.get("p", F.lit(0))["y"].cast("long").alias("y"), F.array_join("d", ",").alias("direction"))


#: Rows of replies, and why each isn't taken (none: it is).
_EVALUATED = (
    ('{"recordId":"r","outcome":"Stable","reason":"calm"}', None), ('{"recordId":"r","outcome":"update","reason":"so"}', "nothing to update"), ('{"recordId":"r","outcome":"update","reason":"so","trend":"rising"}', None), ('{"recordId":"r","outcome":"resolve","reason":"so"}', "needs a summary"),
    ('{"outcome":"stable","reason":"so"}', "needs a record"), ('{"recordId":"r","outcome":"grow","reason":"so"}', "unsupported outcome"), ('{"recordId":"r","outcome":"stable"}', "needs a reason"), ("null", "no object"),
)
_EVALUATED_SQL = ", ".join(f"({k}, {'null' if r is None else repr(r)})" for k, (_, r) in enumerate(_EVALUATED))


@query(f"""with v(k, reason) as (values {_EVALUATED_SQL}), o as (select o_orderkey as id, cast(1 + o_orderkey % 7 as int) as n, o_orderkey % 5 as d from orders), e as (select id, unnest(range(0, n)) as ordinal from o where n <= 6 and d < 3)
select id, 'evaluations' as section, cast(ordinal as int) as ordinal, reason from e join v on k = (id + ordinal * 3) % {len(_EVALUATED)} union all select id, 'derived', 0, case when d = 1 then 'needs summary and reason' end from o where n <= 6 and d in (1, 2)
union all select id, null, -1, case when n > 6 then 'too many evaluations' else 'too many derived' end from o where n > 6 or d >= 3""")
def evaluations_checked(spark, d):
    """Replies of one to seven evaluations and up to two derived developments, some in a code fence."""
    k = F.col("o_orderkey")
    rows = F.transform(F.sequence(F.lit(0).cast("long"), k % 7), lambda i: F.element_at(lexical.listed(tuple(r[0] for r in _EVALUATED)), (1 + (k + i * 3) % len(_EVALUATED)).cast("int")))
    new = F.element_at(lexical.listed(("null", '[{"summary":"S"}]', '[{"summary":"S","reason":"so"}]', '[{"summary":"S","reason":"so"},{}]', "[{},{}]")), (1 + k % 5).cast("int"))
    body = F.concat(F.lit('{"evaluations":['), F.array_join(rows, ","), F.lit('],"derived":'), new, F.lit("}"))
    reply = F.when(k % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return envelopes.parse_evaluations(read(spark, d, "orders").select(k.alias("id"), reply.alias("reply"))).select("id", "section", "ordinal", "reason")


@query()
def time_told(spark, d):
    """What the newest exchange of each conversation says of time, in turns with a phrase each; held against cases made by hand, as SQL has it only for days_added and newest_elapsed."""
    told = F.element_at(lexical.listed(tuple(x[0] for x in _DAYS)), (1 + (F.col("chat") * 5 + F.col("pos") * (F.col("chat") % 4 + 1)) % len(_DAYS)).cast("int"))
    log = messages(spark, d).withColumn("text", F.concat(F.coalesce(F.col("text"), F.lit("")), F.lit("\n"), told))
    return days.continuity_hints(log).withColumnRenamed("chat", "conv_id")
