"""Chat formatting: preference pairs, with DataFrame functions only.

A turn says which sides have it. The first turn that only one side has ends the common prefix: what comes before is rendered once, as
the prompt, the rest as two completions with the spans that count for the loss. A pair is rendered in blocks of turns, so that no row
grows with a conversation's length. Ordinary pairs are one block, whose turns meet in one group: their texts are shuffled once. Turns of pairs
with more get their places from sorted ranges, in which a long conversation is spread over tasks, and from sums over those ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, partitions, table

#: Fixed values of the format.
OPEN, BREAK, CLOSE, END = "<|im_start|>", "\n", "<|im_end|>", "\n"
BLOCK_TURNS = 256
#: Of pairs, to tell which may have more turns than a block; and a turn after all others.
BUCKETS, LAST = 1024, 2**63 - 1


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(BREAK), turn["text"], F.lit(CLOSE + END))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _spans(turns: Column, trained: str) -> Column:
    """Code point ranges (start, end) of the trained role's texts and their closing marks."""
    span = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    zero = F.struct(F.lit(0).alias("at"), F.slice(F.array(span), 1, 0).alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(turn["role"]) + len(OPEN + BREAK)
        end = start + F.length(turn["text"]) + len(CLOSE)
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(turn["role"] == trained, F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step)["spans"]


def preference_pairs(turns: DataFrame, pair: Column, chosen: Column, rejected: Column | None = None, turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """A row (pair_id, block, n_common, prompt, chosen, chosen_spans, rejected, rejected_spans) for each pair and block of turns.

    pair: the pair that a turn's conversation belongs to; chosen: whether it is the chosen one, else the rejected one; where `rejected` is given,
    a row may be in both. The texts of a pair's blocks, one after the other, are its prompt and completions; spans count within their
    block. Turns come in the order of (turn, role, text); turn numbers are longs (null and others count as -1), null roles and texts are empty; a turn
    that repeats exactly counts once. A missing side has an empty completion and no common prefix. Rows of null pairs and sides belong to no pair.
    n_common counts the block's turns in the prompt. A block has block_turns turns, whatever their numbers; a very long text makes its
    row long. Other columns are left out, so that no name clashes; an empty table gives an empty table.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(pair.alias("pair_id"), chosen.alias("in_chosen"), (~chosen if rejected is None else rejected).alias("in_rejected"), F.coalesce(F.col(turn_col).try_cast("long"), F.lit(-1)).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    rows = rows.filter("pair_id is not null and (in_chosen or in_rejected)").fillna(False, ["in_chosen", "in_rejected"])
    sizes = rows.groupBy("pair_id").count().filter(F.col("count") > block_turns)
    found = {r[0] for r in sizes.select(_bucket()).distinct().collect()}
    if not found:
        return _rendered_blocks(_whole(rows), trained)
    long = F.get(F.lit([k in found for k in range(BUCKETS)]), _bucket())
    return _rendered_blocks(_whole(rows.filter(~long)).unionByName(_by_ranges(rows.filter(long), block_turns)), trained)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("pair_id"), F.lit(BUCKETS)).cast("int")


def _whole(rows: DataFrame) -> DataFrame:
    """(pair_id, block, turns) of pairs that are one block each."""
    said = F.collect_list(F.struct("turn", "role", "text", "in_chosen", "in_rejected"))
    both = rows.groupBy("pair_id").agg(said.alias("said"))
    each = F.array_sort(F.array_distinct(F.transform("said", lambda t: F.struct(t["turn"], t["role"], t["text"]))))

    def sides(key: Column, _: Column) -> Column:
        has = lambda side: F.exists("said", lambda t: t[side] & (F.struct(t["turn"], t["role"], t["text"]) == key))
        return F.struct(key["turn"].alias("turn"), key["role"].alias("role"), key["text"].alias("text"), has("in_chosen").alias("in_chosen"), has("in_rejected").alias("in_rejected"))

    turns = both.select("pair_id", F.transform(each, sides).alias("turns"))
    apart = F.array_min(F.transform(F.filter("turns", lambda t: t["in_chosen"] != t["in_rejected"]), lambda t: t["turn"]))
    placed = turns.withColumn("parts_at", F.coalesce(apart, F.lit(LAST)))
    marked = F.transform("turns", lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text"), t["in_chosen"].alias("in_chosen"), t["in_rejected"].alias("in_rejected"), (t["turn"] < F.col("parts_at")).alias("common")))
    return placed.select("pair_id", F.lit(0).alias("block"), marked.alias("turns"))


def _by_ranges(rows: DataFrame, block_turns: int) -> DataFrame:
    """(pair_id, block, turns) of pairs of any length."""
    each = rows.groupBy("pair_id", "turn", "role", "text").agg(F.max("in_chosen").alias("in_chosen"), F.max("in_rejected").alias("in_rejected"))
    order = ["pair_id", "turn", "role", "text"]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    # Kept, so that the places are those of one evaluation.
    sorted_ = cut(each.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), place.alias("place")))
    # A row for each pair and range that has some of it.
    ranges = sorted_.groupBy("pair_id", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.min(F.when(F.col("in_chosen") != F.col("in_rejected"), F.col("turn"))).alias("apart"))
    own = Window.partitionBy("pair_id")
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("pair_id", "part", (before - F.col("first")).alias("shift"), F.min("apart").over(own).alias("parts_at"))
    turn = F.struct("turn", "role", "text", "in_chosen", "in_rejected", (F.col("turn") < F.coalesce("parts_at", F.lit(LAST))).alias("common"))
    block = F.floor((F.col("place") + F.col("shift")) / block_turns).cast("int")
    return sorted_.join(ranges, ["pair_id", "part"]).groupBy("pair_id", block.alias("block")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def _rendered_blocks(blocks: DataFrame, trained: str) -> DataFrame:
    common = F.filter("turns", lambda t: t["common"])
    parts = blocks.select("pair_id", "block", common.alias("common"), F.filter("turns", lambda t: ~t["common"] & t["in_chosen"]).alias("c"), F.filter("turns", lambda t: ~t["common"] & t["in_rejected"]).alias("r"))
    return parts.select("pair_id", "block", F.size("common").alias("n_common"), _joined(F.col("common")).alias("prompt"), _joined(F.col("c")).alias("chosen"), _spans(F.col("c"), trained).alias("chosen_spans"), _joined(F.col("r")).alias("rejected"), _spans(F.col("r"), trained).alias("rejected_spans"))


def shared_turns(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected, turn, role, text): each conversation as both sides of a pair, in which another reply stands for the rejected side's last one.

    That is the last reply of the conversation with the next id, empty if there is none; if it is the own one, the sides are equal and have no
    completion. Ids that aren't integers, and null ids, have no next one; turns that aren't integers are null and come first. Rows that repeat stay; an empty table gives an empty one.
    """
    said = turns.select("conv_id", F.col("turn").try_cast("long").alias("turn"), "role", "text")
    key = F.col("conv_id").try_cast("long")
    last = said.filter("role = 'assistant' and conv_id is not null").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select((key - 1).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("last.text").alias("other")).filter("conv_id is not null")
    own = last.select("conv_id", F.col("last.turn").alias("at"), F.sha2(F.col("last.text").cast("binary"), 256).alias("own"))
    # A row for each conversation; kept, so that the join can split a very long one.
    replies = cut(own.join(other, "conv_id", "left").select("conv_id", F.lit(True).alias("replies"), "at", "own", F.coalesce("other", F.lit("")).alias("other")))
    is_last = (F.col("role") == "assistant") & F.col("replies") & F.col("turn").eqNullSafe(F.col("at")) & F.sha2(F.col("text").cast("binary"), 256).eqNullSafe(F.col("own"))
    side = lambda chosen, rejected, text: F.struct(F.lit(chosen).alias("chosen"), F.lit(rejected).alias("rejected"), text.alias("text"))
    sides = F.when(is_last, F.array(side(True, False, F.col("text")), side(False, True, F.col("other")))).otherwise(F.array(side(True, True, F.col("text"))))
    rows = said.join(replies, "conv_id", "left").select("conv_id", "turn", "role", F.explode(sides).alias("s"))
    return rows.select(F.col("conv_id").alias("pair_id"), "s.chosen", "s.rejected", "turn", "role", "s.text")


def with_other_replies(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, turn, role, text): the rows of shared_turns(), one for each side that has them."""
    sides = F.array_compact(F.array(F.when(F.col("chosen"), True), F.when(F.col("rejected"), False)))
    return shared_turns(turns).withColumn("chosen", F.explode(sides)).select("pair_id", "chosen", "turn", "role", "text")


def op2_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair for each conversation, of itself and itself with another last reply."""
    pairs = preference_pairs(shared_turns(table(spark, sf_dir, "conversations")), F.col("pair_id"), F.col("chosen"), F.col("rejected"))

    def text(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ",")

    return pairs.select("pair_id", "block", F.col("n_common").cast("long").alias("n_common"), "prompt", "chosen", text("chosen_spans").alias("chosen_mask"), "rejected", text("rejected_spans").alias("rejected_mask"))


ORACLE = """
with last as (select conv_id, turn, text from (select *, row_number() over (partition by conv_id order by turn desc, text desc) as k from conversations where role = 'assistant') where k = 1),
sides as (select conv_id as pair_id, true as chosen, turn, role, text from conversations
  union all select c.conv_id, false, c.turn, c.role, case when c.role = 'assistant' and c.turn = l.turn and c.text = l.text then coalesce(o.text, '') else c.text end
  from conversations c left join last l on c.conv_id = l.conv_id left join last o on o.conv_id = c.conv_id + 1),
each as (select pair_id, coalesce(turn, -1) as turn, coalesce(role, '') as role, coalesce(text, '') as text, bool_or(chosen) as c, bool_or(not chosen) as r from sides where pair_id is not null group by all),
apart as (select pair_id, min(turn) as d from each where c <> r group by pair_id),
t as (select e.*, (row_number() over (partition by pair_id order by turn, role, text) - 1) // 256 as block, turn < coalesce(d, 9223372036854775807) as common,
  '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as s from each e left join apart using (pair_id)),
parts as (select pair_id, block, turn, role, text, s, 'p' as part from t where common
  union all select pair_id, block, turn, role, text, s, 'c' from t where not common and c
  union all select pair_id, block, turn, role, text, s, 'r' from t where not common and r),
placed as (select *, coalesce(sum(length(s)) over (partition by pair_id, block, part order by turn, role, text rows between unbounded preceding and 1 preceding), 0) + 13 + length(role) as a from parts),
masked as (select *, case when role = 'assistant' then cast(a as bigint) || '-' || cast(a + length(text) + 10 as bigint) end as m from placed)
select pair_id, cast(block as int) as block, count(*) filter (part = 'p') as n_common,
  coalesce(string_agg(s, '' order by turn, role, text) filter (part = 'p'), '') as prompt,
  coalesce(string_agg(s, '' order by turn, role, text) filter (part = 'c'), '') as chosen,
  coalesce(string_agg(m, ',' order by turn, role, text) filter (part = 'c'), '') as chosen_mask,
  coalesce(string_agg(s, '' order by turn, role, text) filter (part = 'r'), '') as rejected,
  coalesce(string_agg(m, ',' order by turn, role, text) filter (part = 'r'), '') as rejected_mask
from masked group by pair_id, block
"""
