"""Registered queries and their SQL.

The tables stand in for the engine's own: documents are records (summary = text, kind and status = lang, changed = n_chars),
conversations the message log, events a keyed changelog, orders keyed state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry, lexical, text
from tidemark.operators import branch, evolution, journal, log, oplog, places, records, reducer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CANON = r"trim(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
FNV = "lpad(printf('%x', list_reduce([cast({1} as bigint)] || list_transform(list_filter(string_split({0}, ''), lambda c: c <> ''), lambda c: cast(unicode(c) as bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)), 8, '0')"


def canon(column: str) -> str:
    return CANON.format(column)


def fnv(column: str) -> str:
    return "(" + " || ".join(FNV.format(column, seed) for seed in text.FNV_SEEDS) + ")"


def query(sql: str | None = None):  # noqa: ANN201
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.lit("active").alias("status"), F.col("text").alias("summary"), F.col("n_chars").alias("changed"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat"), F.col("turn").alias("pos"), "role", "text")


_HIT = f"lang in ('en', 'fr') and contains(' ' || {canon('text')}, ' th') and contains(' ' || {canon('text')}, ' an')"


@query(f"select doc_id, lang, n_chars from documents where {_HIT} order by coalesce(n_chars, -1) desc, cast(doc_id as varchar) limit 30")
def search_prefix_topk(spark, d):
    return records.search(documents(spark, d), "Th an", kinds=("en", "fr")).select(F.col("id").alias("doc_id"), F.col("kind").alias("lang"), F.col("changed").alias("n_chars"))


@query(f"select count(*) as total_matched from documents where {_HIT}")
def search_total(spark, d):
    return records.matches(documents(spark, d), "Th an", kinds=("en", "fr")).agg(F.count("*").alias("total_matched"))


@query("select o_orderstatus as status, count(*) as n, count(*) filter (o_totalprice > 100000) as n_large, max(o_orderkey) as newest from orders group by 1")
def state_summary(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("n_large"), F.max("o_orderkey").alias("newest"))


@query("select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by user_id")
def latest_per_key(spark, d):
    return records.latest_per_key(read(spark, d, "events"), "user_id", "event_id", "event_type")


@query("""with m as (select max(event_id) as top from events)
select case when top - event_id <= 10 then 'recent' when event_type in ('click', 'view') then 'ongoing' else 'facts' end as bucket, count(*) as n, count(distinct user_id) as n_users
from events, m group by 1""")
def recent_buckets(spark, d):
    events = read(spark, d, "events")
    top = events.agg(F.max("event_id").alias("top"))
    bucket = F.when(F.col("top") - F.col("event_id") <= 10, "recent").when(F.col("event_type").isin("click", "view"), "ongoing").otherwise("facts")
    return events.join(F.broadcast(top)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


_WORDS = f"list_filter(string_split({canon('text')}, ' '), lambda w: w <> '')"


@query(f"select doc_id, md5({canon('text')}) as canonical_md5, len({_WORDS}) as n_words, len(list_distinct({_WORDS})) as n_distinct from documents")
def canonical_tokens(spark, d):
    own = text.canonical_text(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.md5(own.cast("binary")).alias("canonical_md5"), F.size(text.words(own)).cast("long").alias("n_words"), F.size(F.array_distinct(text.words(own))).cast("long").alias("n_distinct"))


@query(r"""select doc_id, cast(ceil((coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: ceil(length(w) / 3.5))), 0)
  + length(regexp_replace(text, '[A-Za-z0-9_\s]+', '', 'g'))) * 1.12) as bigint) as n_tokens from documents""")
def token_budget(spark, d):
    return read(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("n_tokens"))


def _strip_sql(column: str, tag: str) -> str:
    out = column
    for pattern in (rf"<{tag}\b[^>]*/>", rf"<{tag}\b[^>]*>.*?</{tag}\s*>", rf"<{tag}\b[^>]*>.*$"):
        out = f"regexp_replace({out}, '{pattern}', '', 'gis')"
    return out


_CLEAN = _strip_sql(_strip_sql(_strip_sql("coalesce(html, '')", "script"), "style"), "nav")


@query(f"select page_id, length({_CLEAN}) as n_chars, md5({_CLEAN}) as clean_md5 from pages")
def sanitize_blocks(spark, d):
    own = F.col("html")
    for tag in ("script", "style", "nav"):
        own = text.strip_tagged_block(own, tag)
    return read(spark, d, "pages").select("page_id", F.length(own).cast("long").alias("n_chars"), F.md5(own.cast("binary")).alias("clean_md5"))


_EX = """with e as (select *, min(case when role = 'assistant' then turn end) over (partition by conv_id order by turn rows between current row and unbounded following) as end_turn from conversations),
x as (select * from e where end_turn is not null and role <> 'system')"""


@query(f"{_EX} select conv_id, end_turn, min(turn) as start_turn, count(*) as n_rows from x group by all")
def exchange_windows(spark, d):
    return log.exchange_windows(messages(spark, d)).select(F.col("chat").alias("conv_id"), F.col("end_pos").alias("end_turn"), F.col("start_pos").alias("start_turn"), "n_rows")


@query(f"{_EX} select * from (select conv_id, end_turn, turn, role, row_number() over (partition by conv_id, end_turn order by turn desc) as rank from x) where rank <= 4")
def exchange_newest4(spark, d):
    return log.newest_rows(messages(spark, d)).select(F.col("chat").alias("conv_id"), F.col("end_pos").alias("end_turn"), F.col("pos").alias("turn"), "role", F.col("rank").cast("long").alias("rank"))


@query(f"{_EX}, w as (select conv_id, end_turn, count(*) as n from x group by all) select conv_id, count(*) as n_windows, min(end_turn) as first_end, max(end_turn) as last_end, cast(sum(n) as bigint) as n_rows, count(*) > 1024 as over_limit from w group by conv_id")
def rebuild_plan(spark, d):
    return log.rebuild_plan(messages(spark, d)).select(F.col("chat").alias("conv_id"), "n_windows", F.col("first_end").alias("first_end"), F.col("last_end").alias("last_end"), "n_rows", "over_limit")


_FP = "with f as (select conv_id, turn, '{\"content\":' || cast(to_json(coalesce({0}, '')) as varchar) || ',\"is_system\":' || (role = 'system') || ',\"is_user\":' || (role = 'user') || ',\"name\":\"\",\"role\":' || cast(to_json(coalesce(role, '')) as varchar) || '}' as j from conversations)".replace("{0}", "text")
_PRINT = f"{_FP}, p as (select conv_id, turn, {fnv('j')} as fingerprint from f)"


@query(f"{_PRINT} select conv_id, turn, fingerprint from p")
def fingerprints(spark, d):
    return messages(spark, d).select(F.col("chat").alias("conv_id"), F.col("pos").alias("turn"), log.fingerprint(F.col("role"), F.col("text")).alias("fingerprint"))


@query(f"""with recursive {_PRINT[5:]}, n as (select *, row_number() over (partition by conv_id order by turn) as k from p),
c as (select conv_id, turn, k, 'root' as parent_key, 'ln_' || {fnv("('root|' || fingerprint)")} as lineage_key from n where k = 1
  union all select n.conv_id, n.turn, n.k, c.lineage_key, 'ln_' || {fnv("(c.lineage_key || '|' || n.fingerprint)")} from c join n on n.conv_id = c.conv_id and n.k = c.k + 1)
select conv_id, turn, parent_key, lineage_key from c""")
def lineage_chain(spark, d):
    return log.lineage(messages(spark, d)).select(F.col("chat").alias("conv_id"), F.col("pos").alias("turn"), "parent_key", "lineage_key")


@query("""with a as (select conv_id, turn, role || '|' || text as k from conversations),
b as (select conv_id, turn, role || '|' || text || case when (conv_id * 7 + turn) % 11 = 0 then '!' else '' end as k from conversations where not (conv_id % 5 = 0 and turn > 2))
select conv_id, coalesce(min(case when a.k is distinct from b.k then turn end), -1) as diverges_at from a full join b using (conv_id, turn) group by conv_id""")
def lineage_divergence(spark, d):
    own = messages(spark, d).withColumn("k", F.concat_ws("|", "role", "text"))
    mark = F.when((F.col("chat") * 7 + F.col("pos")) % 11 == 0, "!").otherwise("")
    edited = own.filter(~((F.col("chat") % 5 == 0) & (F.col("pos") > 2))).withColumn("k", F.concat("k", mark))
    return log.divergence(own, edited, "k").withColumnRenamed("chat", "conv_id")


@query(f"""with s as (select item_id * 100000 + i as claim_id, {canon('s')} as needle from (select item_id, unnest(string_split(text, '.')) as s, generate_subscripts(string_split(text, '.'), 1) - 1 as i from benchmark)),
c as (select * from s where length(needle) >= 8 and len(list_filter(string_split(needle, ' '), lambda w: length(w) > 1)) >= 2), d as (select doc_id, ' ' || {canon('text')} || ' ' as hay from documents)
select claim_id, doc_id as source_id from c, d where contains(hay, ' ' || needle || ' ')""")
def grounded_claims(spark, d):
    parts = read(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", r"\.", -1)).alias("i", "text"))
    claims = parts.select((F.col("item_id") * 100000 + F.col("i")).alias("claim_id"), "text")
    return records.grounded(claims, read(spark, d, "documents").select(F.col("doc_id").alias("source_id"), "text"))


_RECENT = "the thing and when of threading ing tion der chen"
_FUNCTION = "[" + ", ".join(f"'{w}'" for w in lexical.FUNCTION_WORDS) + "]"
_OWN = f"list_distinct({_WORDS})"


@query(f"""with r as (select doc_id, n_chars, length({canon('lang')}) as al, list_contains(string_split('{_RECENT}', ' '), {canon('lang')}) as a, {_OWN} as own, list_filter(list_intersect({_OWN}, string_split('{_RECENT}', ' ')), lambda w: not list_contains({_FUNCTION}, w)) as sh from documents),
s as (select doc_id, n_chars, case when a then 5 * (1 + least(1.5, al / 24)) else 0 end + 2.5 * case when len(sh) = 0 then 0 when len(sh) = 1 then case when length(sh[1]) >= 7 and len(own) <= 3 then least(0.7, length(sh[1]) / 16) else 0 end
  else least(1.0, len(sh) / greatest(2, least(len(own), 8))) end as raw from r),
t as (select doc_id, n_chars, floor(case when raw > 0 then raw + case when 20000 - n_chars < 0 then 0 when 20000 - n_chars <= 4 then 0.8 when 20000 - n_chars <= 16 then 0.45 when 20000 - n_chars <= 48 then 0.2 else 0 end else 0 end * 1000 + 0.5) / 1000 as score from s)
select doc_id, score from t where score >= 0.9 order by score desc, n_chars desc, cast(doc_id as varchar) limit 6""")
def relevance_topk(spark, d):
    scored = records.relevance(documents(spark, d).withColumn("anchors", F.array("kind")), _RECENT, now=20000)
    return records.top_relevant(scored).select(F.col("id").alias("doc_id"), "score")


@query(f"""with k as (select doc_id, lang, {canon('text')} as c from documents), f as (select coalesce(lang, '') as lang, c, min(doc_id) as first_id, count(*) as n_copies from k group by all)
select doc_id, first_id, n_copies from k join f on coalesce(k.lang, '') = f.lang and k.c = f.c""")
def exact_duplicates(spark, d):
    return records.exact_duplicates(documents(spark, d)).withColumnRenamed("id", "doc_id")


@query(f"""with k as (select doc_id, lang, list_sort({_OWN}) as own from documents), s as (select lang, own, min(doc_id) as id from k where len(own) > 0 group by all),
p as (select a.id as left_id, b.id as right_id, len(list_intersect(a.own, b.own)) as n, len(a.own) + len(b.own) as m from s a join s b on a.lang = b.lang and a.id < b.id and least(len(a.own), len(b.own)) >= 0.78 * greatest(len(a.own), len(b.own)))
select left_id, right_id, round(n / (m - n), 9) as similarity from p where n / (m - n) >= 0.78""")
def near_duplicates(spark, d):
    return records.similar_records(documents(spark, d)).withColumn("similarity", F.round("similarity", 9))


@query("""with a as (select o_orderkey, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as st from orders where o_orderkey % 13 <> 0
  union all select o_orderkey + 100000000, o_orderstatus from orders where o_orderkey % 17 = 0)
select o_orderkey, case when o.o_orderstatus is null then 'added' when a.st is null then 'removed' else 'changed' end as change, o.o_orderstatus as before_status
from orders o full join a using (o_orderkey) where o.o_orderstatus is distinct from a.st""")
def keyed_diff(spark, d):
    before = read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("st"))
    after = before.filter("o_orderkey % 13 <> 0").withColumn("st", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("st"))).unionByName(before.filter("o_orderkey % 17 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 100000000))
    return journal.keyed_undo(before, after, "o_orderkey").select("o_orderkey", "change", F.col("before.st").alias("before_status"))


@query("select user_id, arg_max(event_type, event_id) as event_type from events where event_id <= (select max(event_id) // 2 from events) group by user_id")
def state_as_of(spark, d):
    own = journal.changelog(read(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")
    half = read(spark, d, "events").agg(F.expr("max(event_id) div 2")).first()[0]
    return journal.state_as_of(own, "user_id", "event_id", "event_type", half)


@query("select p_partkey, p_name from part where p_partkey in (select l_partkey from lineitem where l_quantity >= 49)")
def compact_refs(spark, d):
    return journal.referenced(read(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", read(spark, d, "lineitem").filter("l_quantity >= 49"), "l_partkey")


@query("""select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) as r, min(event_id) over (partition by user_id) as root from events) where r <= 5 or event_id = root""")
def trim_pinned(spark, d):
    from pyspark.sql import Window

    rooted = read(spark, d, "events").select("user_id", "event_id").withColumn("root", F.min("event_id").over(Window.partitionBy("user_id")))
    return records.keep_newest(rooted, "user_id", "event_id", 5, F.col("event_id") == F.col("root")).select("user_id", "event_id")


_XY = "cast(embedding[1] as double) as x, cast(embedding[2] as double) as y"
_POINT = "(['north', 'northeast', 'east', 'southeast', 'south', 'southwest', 'west', 'northwest'])"


def _points(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query(f"select vec_id, case when x = 0 and y = 0 then null else {_POINT}[1 + cast(floor((((degrees(atan2(x, y)) + 360) % 360) + 22.5) / 45) as int) % 8] end as direction from (select vec_id, {_XY} from embeddings)")
def compass(spark, d):
    return _points(spark, d).select("vec_id", geometry.direction_from_delta(F.col("x"), F.col("y")).alias("direction"))


@query(f"""with p as (select vec_id, {_XY}, {_POINT}[1 + vec_id % 8] as dir, 1 + vec_id % 5 as km from embeddings),
q as (select vec_id, x + km / 2.0 * case when dir = 'east' then 1 when dir = 'west' then -1 when dir in ('northeast', 'southeast') then 0.7071067811865475 when dir in ('northwest', 'southwest') then -0.7071067811865475 else 0 end as rx,
  y + km / 2.0 * case when dir = 'north' then 1 when dir = 'south' then -1 when dir in ('northeast', 'northwest') then 0.7071067811865475 when dir in ('southeast', 'southwest') then -0.7071067811865475 else 0 end as ry from p),
r as (select vec_id, round(floor(rx / 0.05 + 1e-12 + 0.5) * 0.05, 6) as x, round(floor(ry / 0.05 + 1e-12 + 0.5) * 0.05, 6) as y from q)
select vec_id, case when x between -2 and 2 and y between -2 and 2 then x end as x, case when x between -2 and 2 and y between -2 and 2 then y end as y from r""")
def derive_point(spark, d):
    points = _points(spark, d).withColumns({"dir": F.element_at(F.array(*map(F.lit, geometry.COMPASS)), (1 + F.col("vec_id") % 8).cast("int")), "km": (1 + F.col("vec_id") % 5).cast("double")})
    x, y = geometry.derive_point(F.col("x"), F.col("y"), F.col("dir"), F.col("km"), 2.0, 0.05, (-2, 2, -2, 2))
    return points.select("vec_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("""with o as (select n_nationkey + 1000 as id, n_nationkey as base_id, 'New ' || n_name as name, cast(null as int) as region from nation where n_nationkey % 3 = 0
  union all select 2000, null, 'Own', 1 union all select 3000, 999, 'Lost', 2)
select cast(n_nationkey as int) as id, coalesce(o.name, n_name) as name, coalesce(o.region, n_regionkey) as region, case when o.id is null then 'base' else 'override' end as origin from nation left join o on o.base_id = n_nationkey
union all select id, name, region, case when base_id is null then 'own' else 'orphan' end from o where base_id is null or base_id = 999""")
def overlay(spark, d):
    nation = read(spark, d, "nation")
    base = nation.select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    over = base.filter("id % 3 = 0").select((F.col("id") + 1000).alias("id"), F.col("id").alias("base_id"), F.concat(F.lit("New "), "name").alias("name"), F.lit(None).cast("int").alias("region"))
    more = spark.createDataFrame([(2000, None, "Own", 1), (3000, 999, "Lost", 2)], "id int, base_id int, name string, region int")
    return places.effective_places(base, over.unionByName(more), ["name", "region"])


@query(f"""with n as (select p_partkey as id, {canon('p_name')} as name from part union all select -n_nationkey - 1, {canon("split_part(p, ' ', 1)")} from (select n_nationkey, (select min(p_name) from part where p_partkey % 25 = n_nationkey) as p from nation)),
f as (select name, min(id) as pid from n where name <> '' group by name), s as (select id, i, array_to_string(string_split(name, ' ')[1:i], ' ') as st from (select id, name, unnest(range(1, len(string_split(name, ' ')))) as i from n))
select s.id, arg_max(pid, i) as parent_id from s join f on s.st = f.name where pid <> s.id group by s.id""")
def name_parents(spark, d):
    part = read(spark, d, "part")
    own = part.select(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("name"))
    heads = part.groupBy((F.col("p_partkey") % 25).alias("k")).agg(F.min("p_name").alias("p")).select((-F.col("k") - 1).cast("long").alias("id"), F.split("p", " ")[0].alias("name"))
    return records.name_parents(own.unionByName(heads))


@query("""with r as (select user_id, max(event_id) as last from events where event_type = 'purchase' group by user_id)
select e.user_id, e.event_id from events e left join r on r.user_id = e.user_id where event_type = 'error' and (last is null or event_id > last)""")
def unrecovered_failures(spark, d):
    return oplog.unrecovered(read(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "error", F.col("event_type") == "purchase").select("user_id", "event_id")


@query("""with recursive m as (select p_partkey as id, case when p_partkey % 4 <> 0 and p_partkey > 4 then p_partkey - 3 end as into_ from part),
c as (select id, id as cur, 0 as n from m union all select c.id, m.into_, n + 1 from c join m on c.cur = m.id where m.into_ is not null and n < 8)
select id, arg_max(cur, n) as final_id from c group by id""")
def follow_merges(spark, d):
    own = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when((F.col("p_partkey") % 4 != 0) & (F.col("p_partkey") > 4), F.col("p_partkey") - 3).alias("merged_into"))
    return places.follow_merges(own)


@query(f"""with w as (select conv_id, turn, {_WORDS} as w from conversations)
select conv_id, turn, cast(len(list_distinct(flatten(list_transform([1, 2, 3, 4, 5, 6], lambda k: list_transform(range(1, greatest(1, len(w) - k + 2)), lambda i: array_to_string(w[i:i + k - 1], ' ')))))) as bigint) as n_phrases from w""")
def phrase_counts(spark, d):
    own = messages(spark, d).select(F.col("chat").alias("conv_id"), F.col("pos").alias("turn"), text.canonical_text(F.col("text")).alias("c"))
    return own.select("conv_id", "turn", F.size(text.phrases(F.col("c"))).cast("long").alias("n_phrases"))


@query("""select user_id as chat, event_type as record, arg_max(props, event_id) as summary, min(event_id) as created, max(event_id) as evaluated, count(*) as n_mutations from events group by all""")
def reducer_last_write(spark, d):
    """The fold over events: the first of a user and type creates its record, later ones update it."""
    from pyspark.sql import Window

    events = read(spark, d, "events")
    first = F.min("event_id").over(Window.partitionBy("user_id", "event_type")) == F.col("event_id")
    none = F.lit(None).cast("string")
    mutations = events.select(
        F.col("user_id").alias("chat"), F.col("event_type").alias("record"), F.col("event_id").alias("message"), F.lit(0).cast("long").alias("ordinal"), F.lit("l").alias("lineage"), F.when(first, "create").otherwise("update").alias("action"),
        F.lit("fact").alias("kind"), F.col("props").alias("summary"), none.alias("status"), none.alias("trend"), none.alias("time_anchor"),
    )
    outcomes = reducer.reduce_mutations(mutations)
    counts = outcomes.filter("outcome = 'applied'").groupBy("chat", "record").agg(F.count("*").alias("n_mutations"))
    return reducer.current_records(outcomes).join(counts, ["chat", "record"]).select("chat", "record", "summary", "created", "evaluated", "n_mutations")


_EDITED = """edited as (select conv_id, turn, case when (conv_id * 3 + turn) % 7 = 0 then 'system' else role end as role, case when (conv_id + turn) % 13 = 0 then text || ' changed' else '* ' || text end as text
  from conversations where not (conv_id % 5 = 0 and turn > 2))"""
_VERSIONS = f"""with {_EDITED}, a as (select conv_id, turn, role, {canon('text')} as said from conversations), b as (select conv_id, turn, role, {canon('text')} as said from edited),
j as (select conv_id, turn, a.role as l, b.role as r, a.said as ls, b.said as rs from a full join b using (conv_id, turn))"""


def _edited(spark, d):
    own, chat, pos = messages(spark, d), F.col("chat"), F.col("pos")
    role = F.when((chat * 3 + pos) % 7 == 0, "system").otherwise(F.col("role"))
    said = F.when((chat + pos) % 13 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.concat(F.lit("* "), "text"))
    return own.filter(~((chat % 5 == 0) & (pos > 2))).withColumns({"role": role, "text": said})


@query(f"""{_VERSIONS}, k as (select conv_id, turn, case when l is null or r is null then 2 when ls is distinct from rs then 2 when l is distinct from r then 1 else 0 end as level from j)
select conv_id, ['none', 'rebase', 'destructive'][1 + max(level)] as plan, coalesce(min(case when level > 0 then turn end), -1) as first_change from k group by conv_id""")
def rewrite_plan(spark, d):
    return branch.rewrite_plan(messages(spark, d), _edited(spark, d)).withColumnRenamed("chat", "conv_id")


@query(f"""{_VERSIONS}, k as (select conv_id, coalesce(min(case when l is distinct from r or ls is distinct from rs then turn end), -1) as d, max(case when l is not null then turn end) as last from j group by conv_id)
select conv_id, d as diverges_at, case when d < 0 then 'same' when last is null or d > last then 'forward' when conv_id % 4 <> 3 and conv_id % 4 <= d then 'journal' when conv_id % 2 = 1 and 0 < d then 'checkpoint' else 'fail' end as plan from k""")
def branch_plan(spark, d):
    chats = messages(spark, d).select("chat").distinct()
    floors = chats.filter("chat % 4 <> 3").withColumn("floor", F.col("chat") % 4)
    points = chats.filter("chat % 2 = 1").withColumn("pos", F.lit(0))
    return branch.branch_plan(messages(spark, d), _edited(spark, d), floors, points).withColumnRenamed("chat", "conv_id")


@query("""with l as (select conv_id, max(turn) as turn, arg_max(role, turn) as role, arg_max(coalesce(text, ''), turn) as text from conversations group by conv_id)
select conv_id, turn from l where role = 'assistant' and trim(text) <> '' and (conv_id % 2 = 1 or conv_id % 3 < turn)""")
def capture_due(spark, d):
    own = messages(spark, d)
    captured = own.select("chat", (F.col("chat") % 3).alias("pos")).distinct().filter("chat % 2 = 0")
    return branch.capture_due(own, captured).select(F.col("chat").alias("conv_id"), F.col("pos").alias("turn"))


_EVENT = "events where event_type = '{0}'"


@query(f"""with r as (select user_id, cast(floor(value) as bigint) % 40 as id, max(event_id) as b from {_EVENT.format('view')} group by all), t as (select user_id, max(event_id) as step from {_EVENT.format('signup')} and event_id % 3 = 0 group by 1),
s as (select user_id, cast(floor(value) as bigint) % 40 as id, max(event_id) as seen from {_EVENT.format('click')} group by all),
w as (select r.user_id, r.id, case when step > b then 'time' when seen > b then 'evidence' end as reason from r left join t using (user_id) left join s using (user_id, id))
select user_id, id, reason from (select *, row_number() over (partition by user_id order by id) as k from w where reason is not null) where k <= 6""")
def evaluations_due(spark, d):
    events = read(spark, d, "events").select(F.col("user_id").alias("chat"), (F.floor("value").cast("long") % 40).alias("id"), F.col("event_id").alias("pos"), "event_type")
    of = lambda kind: events.filter(F.col("event_type") == kind)
    own = of("view").groupBy("chat", "id").agg(F.max("pos").alias("boundary"))
    return evolution.due(own, of("signup").filter("pos % 3 = 0"), of("click")).withColumnRenamed("chat", "user_id")


@query("""with r as (select c_nationkey as chat, c_custkey as id, coalesce(case when c_custkey % 4 = 0 then c_custkey * 7 % 1000 end, case when c_custkey % 3 = 0 then c_custkey * 11 % 1000 end, -1) as b from customer),
p as (select *, row_number() over (partition by chat order by id) - 1 as k, count(*) over (partition by chat) as n from r), s as (select * from p where ((k - 10) % n + n) % n < 32)
select chat, id from (select *, row_number() over (partition by chat order by b, id) as o from s) where o <= 3""")
def background_turn(spark, d):
    key = F.col("c_custkey")
    own = read(spark, d, "customer").select(F.col("c_nationkey").alias("chat"), key.alias("id"), F.when(key % 4 == 0, key * 7 % 1000).alias("evaluated"), F.when(key % 3 == 0, key * 11 % 1000).alias("changed"), F.lit(None).cast("long").alias("created"))
    return evolution.background(own.withColumn("boundary", evolution.boundary()), cursor=10)


@query("""with n as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id desc) as k from events where event_type in ('click', 'purchase'))
select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as place from n where k <= 4""")
def evidence_newest4(spark, d):
    rows = read(spark, d, "events").select("user_id", "event_id", "event_type")
    return evolution.allowed_evidence(rows, "user_id", "event_id", "event_type", ("click", "purchase")).withColumn("place", F.col("place").cast("long"))


@query("""with p as (select user_id, event_id from events where event_type = 'purchase'), s as (select user_id, event_id, props from events where event_type = 'view')
select p.user_id, p.event_id, s.props from p asof left join s on p.user_id = s.user_id and p.event_id >= s.event_id""")
def timeline_as_of(spark, d):
    events = read(spark, d, "events").select("user_id", "event_id", "event_type", "props")
    return evolution.as_of(events.filter("event_type = 'purchase'"), events.filter("event_type = 'view'"), "user_id", "event_id", "props")


@query("""with c as (select user_id, event_id, event_id // 200 as boundary, event_type, lag(event_type) over (partition by user_id order by event_id) as b from events),
e as (select user_id, boundary, first(b order by event_id) as before, first(event_type order by event_id desc) as after from c group by all),
n as (select *, row_number() over (partition by user_id order by boundary) as seq, count(*) over (partition by user_id) as n from e)
select user_id, boundary, seq, before, after from n where seq > n - 20""")
def journal_entries(spark, d):
    rows = read(spark, d, "events").select("user_id", "event_id", "event_type", F.expr("event_id div 200").alias("boundary"))
    own = journal.changelog(rows, "user_id", "event_id", "event_type")
    return journal.coalesce_boundaries(own, "user_id", "boundary", "event_id", "event_type", newest=20).withColumn("seq", F.col("seq").cast("long"))


@query("select o_orderkey, o_orderstatus as status from orders")
def undo_round_trip(spark, d):
    before = read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    after = before.filter("o_orderkey % 13 <> 0").withColumn("status", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("status"))).unionByName(before.filter("o_orderkey % 17 = 0").withColumn("o_orderkey", -F.col("o_orderkey") - 1))
    return journal.apply_undo(after, journal.keyed_undo(before, after, "o_orderkey"), "o_orderkey")


@query("""select s_suppkey as id, s_name as name, 'base' as origin from supplier where s_suppkey % 9 <> 0
union all select s_suppkey, 'By ' || s_name, 'own' from supplier where s_suppkey % 9 = 0 union all select s_suppkey + 1000000, 'By ' || s_name, 'own' from supplier where s_suppkey % 10 = 0""")
def routes_overlay(spark, d):
    base = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    named = base.withColumn("name", F.concat(F.lit("By "), "name"))
    return places.effective_routes(base, named.filter("id % 9 = 0").unionByName(named.filter("id % 10 = 0").withColumn("id", F.col("id") + 1000000)))


_SOURCES = ("campaign_override", "base_canonical", "narrative_explicit", "manual", "derived", "relative", "none")


@query(f"""with c as (select l_partkey, l_orderkey, l_linenumber, ({list(_SOURCES)})[1 + l_orderkey % 7] as authority, l_linestatus = 'O' as locked from lineitem),
r as (select *, case when authority = 'manual' and locked then 100 else case authority when 'campaign_override' then 90 when 'base_canonical' then 80 when 'narrative_explicit' then 60 when 'manual' then 55 when 'derived' then 50 when 'relative' then 40 else 0 end end as rank from c)
select l_partkey, l_orderkey, l_linenumber, authority, locked, rank from (select *, row_number() over (partition by l_partkey order by rank desc, l_orderkey desc, l_linenumber desc) as k from r) where k = 1""")
def strongest_claims(spark, d):
    authority = F.element_at(F.array(*map(F.lit, _SOURCES)), (1 + F.col("l_orderkey") % 7).cast("int"))
    claims = read(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", authority.alias("authority"), (F.col("l_linestatus") == "O").alias("locked"))
    return places.strongest_claims(claims, "l_partkey", ["l_orderkey", "l_linenumber"])


@query("select least(l_partkey, l_suppkey) as low, greatest(l_partkey, l_suppkey) as high, min(l_orderkey) as source from lineitem where l_partkey <> l_suppkey group by all")
def undirected_links(spark, d):
    return records.undirected_links(read(spark, d, "lineitem").select(F.col("l_partkey").alias("from"), F.col("l_suppkey").alias("to"), F.col("l_orderkey").alias("source")))


@query(f"""with p as (select doc_id, unnest(list_distinct({_WORDS})) as term from documents) select term, count(*) as n_records, min(doc_id) as first_id from p group by term""")
def term_frequencies(spark, d):
    return records.term_frequencies(documents(spark, d))


_STEP = "c{0} as (select id, neighbour from e join s using (id) where rank = {0} and neighbour not in (select id from s){1} order by neighbour limit 3)"
_STEPS = ", ".join(_STEP.format(k, "".join(f" and neighbour not in (select neighbour from c{j})" for j in range(1, k))) for k in range(1, 5))


@query(f"""with e as (select distinct l_partkey as id, l_orderkey as neighbour from lineitem), s as (select p_partkey as id, row_number() over (order by p_retailprice desc, p_partkey) as rank from part order by p_retailprice desc, p_partkey limit 4),
{_STEPS} select * from c1 union all select * from c2 union all select * from c3 union all select * from c4""")
def one_hop(spark, d):
    """Four seeds, as the feature has it, and their neighbours."""
    top = read(spark, d, "part").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(4)
    seeds = top.select(F.col("p_partkey").alias("id"), F.struct(-F.col("p_retailprice"), "p_partkey").alias("rank"))
    edges = read(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("neighbour"))
    return records.expand_one_hop(seeds, edges)


@query("""select event_id as "at", user_id, event_type from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as k from events) where k = 1 order by event_id desc limit 80""")
def operations_merged(spark, d):
    """The newest 80 operations of two logs that overlap."""
    rows = read(spark, d, "events").select(F.col("event_id").alias("at"), "user_id", "event_type")
    return oplog.merge_rows(rows.filter("at % 3 <> 0"), rows.filter("at % 2 = 0 or at % 3 = 0"), ["user_id", "event_type"], 80)


_ONE_LINE = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


@query(f"""with t as (select doc_id, {_ONE_LINE} as line, coalesce(text, '') as text from documents)
select doc_id, md5(line) as line_md5, md5(trim(substr(trim(text), 1, 700))) as bounded_md5, md5(case when length(line) <= 400 then line else substr(line, 1, 216) || chr(10) || '[...]' || chr(10) || substr(line, length(line) - 176) end) as clipped_md5 from t""")
def text_bounds(spark, d):
    line = text.single_line(F.col("text"))
    digest = lambda c: F.md5(c.cast("binary"))
    return read(spark, d, "documents").select("doc_id", digest(line).alias("line_md5"), digest(text.bounded_text(F.col("text"), 700)).alias("bounded_md5"), digest(text.clip_middle(line, 400)).alias("clipped_md5"))
