"""Long chats, common words and many ranges: linear where one group holds all rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import journal, log, oplog, views


def test_one_long_chat_of_exchanges(spark):
    rows = spark.range(40_000).select(F.lit(1).alias("chat"), F.col("id").alias("pos"), F.when(F.col("id") % 3 == 2, "assistant").otherwise("user").alias("role"), F.lit("x").alias("text"))
    log.exchange_windows(rows.limit(100)).collect()
    began = time.time()
    found = log.exchange_windows(rows).agg(F.count("*"), F.sum("n_rows")).first()
    assert tuple(found) == (13333, 39999) and time.time() - began < 12


def test_ranges_make_up_a_span(spark):
    rng = random.Random(1)
    spans = [(0, 0), (0, 2**40 - 1), (1, 6), (5, 5), (7, 8), *((a, a + rng.randint(0, 200)) for a in (rng.randint(0, 300) for _ in range(60)))]
    rows = spark.createDataFrame(spans, "a long, b long").select("a", "b", oplog._cover(F.col("a"), F.col("b")).alias("c")).collect()
    for r in rows:
        own = sorted((x["index"] << x.level, (x["index"] + 1) << x.level) for x in r.c)
        assert own[0][0] == r.a and own[-1][1] == r.b + 1 and all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))
        assert all([x.level for x in r.c].count(k) <= 2 for k in range(41))


def test_failures_and_rebuilds_of_one_chat(spark):
    rng = random.Random(2)
    rows = [(1, at, "capture", "failed", rng.randint(0, 60), rng.choice(("", "l")), None) for at in range(400)] + [(1, rng.randint(0, 400), "rebuild", "rebuild-completed", rng.choice((None, rng.randint(0, 60))), "", rng.randint(0, 60)) for _ in range(6)]
    df = spark.createDataFrame(rows, "chat long, at long, label string, outcome string, message long, lineage string, start long")
    last = {}
    for _, at, label, _, message, lineage, _ in rows:
        if label == "capture":
            last[message, lineage] = max(at, last.get((message, lineage), -1))
    want = {(m, k, at) for (m, k), at in last.items() if not any(r[2] == "rebuild" and r[1] >= at and r[6] <= m and (r[4] is None or m <= r[4]) for r in rows)}
    assert {(r.message, r.lineage, r["at"]) for r in oplog.capture_failures(df).collect()} == want and len(want) > 5


def test_common_words_in_names_bring_nothing_together(spark):
    places = spark.range(1500).select("id", F.concat(F.lit("the hall of "), F.col("id").cast("string")).alias("name"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    records = spark.range(1500).select("id", F.lit("active").alias("status"), F.col("id").alias("changed"), F.concat(F.lit("in the hall of "), F.col("id").cast("string"), F.lit(" it rains")).alias("summary"), F.array().cast("array<string>").alias("anchors"))
    found = views.place_mentions(places, records)
    assert found.filter("place_id = id and total = 1").count() == found.count() == 1500
    assert views.possible_duplicates(places).count() == 0


def test_names_that_lie_in_others(spark):
    names = ["old north hall", "hall north", "north hall", "the keep", "keep the", "north", "", None, "old north hall", "keep the gate"]
    places = spark.createDataFrame([(k, n, None, None) for k, n in enumerate(names)], "id long, name string, x double, y double")
    found = {r.id: (r.same_name, r.contained, r.same_point) for r in views.possible_duplicates(places).collect()}
    assert found == {0: (True, True, False), 1: (False, True, False), 2: (False, True, False), 3: (False, True, False), 4: (False, True, False), 8: (True, True, False), 9: (False, True, False)}


@pytest.mark.parametrize("seed", [1, 2])
def test_lists_come_back_in_order(spark, seed):
    rng, before, after = random.Random(seed), [], []
    for chat in range(5):
        own = [f"{chat}-{k}" for k in range(rng.randint(0, 12))]
        before += [(k, p, chat, rng.randint(0, 3)) for p, k in enumerate(own)]
        kept = [r for r in before if r[2] == chat and rng.random() < 0.6]
        now = [(k, rng.choice((v, 9))) for k, _, _, v in kept] + [(f"{chat}+{k}", 1) for k in range(rng.randint(0, 3))]
        after += [(k, p, chat, v) for p, (k, v) in enumerate(now)]
    kind = "key string, place long, chat long, v long"
    left, right = spark.createDataFrame(before, kind), spark.createDataFrame(after, kind)
    back = journal.restore_positioned(right, journal.positioned_undo(left, right, "key"), "key", of="chat")
    assert sorted((r.key, r.place, r.chat, r.v) for r in back.collect()) == sorted(before)


def test_repeated_keys_are_refused(spark):
    one, two = spark.createDataFrame([(1, "a")], "k long, v string"), spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    for pair in ((one, two), (two, one)):
        with pytest.raises(Exception, match="repeated key 1"):
            journal.keyed_undo(*pair, "k").collect()
    none = spark.createDataFrame([(None, "a")], "k long, v string")
    assert journal.keyed_undo(none, none, "k").count() == 0
