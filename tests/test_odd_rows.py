"""Nulls, empty texts, ties, repeats, empty tables and other scripts, for operators whose tables have none of them."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import chat, elapsed, lexical, spatial_text
from tidemark.operators import consolidation, journal, log, oplog, place_search, places, records, views

RECORD = "id long, kind string, status string, summary string, anchors array<string>, changed long"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_words_and_pairs(spark):
    none = F.lit(None).cast("string")
    row = one(spark, lexical.significant(none), lexical.spaceless_pairs(none), lexical.non_ascii_pairs(F.lit("")), lexical.phrase_candidates(none), lexical.bounded_excerpt(none, 5), lexical.hearsay(none))
    assert list(row) == [[], [], [], [], "", False]
    row = one(spark, lexical.significant(F.lit("The Bridges, berries and glass; was it ok")), lexical.phrase_candidates(F.lit("a b a b"), 2), lexical.bounded_excerpt(F.lit("one two three four"), 10), lexical.bounded_excerpt(F.lit("x" * 30), 10))
    assert list(row) == [["bridge", "berry", "glas"], ["a b", "b a", "a", "b"], "one two", "x" * 10]
    row = one(spark, lexical.shared_spaceless(F.lit("王都の門"), F.lit("王都の人")), lexical.shared_content(F.lit("王都の門"), F.lit("王都の人")), lexical.shared_spaceless(F.lit("きのうの"), F.lit("きのうは")), lexical.spaceless_pairs(F.lit("서울에서")))
    assert list(row) == [2, 2, 0, []]


@pytest.mark.parametrize(
    ("statement", "claim", "want"),
    [
        ("Northbridge has collapsed", "Northbridge has not collapsed", (True, False)),
        ("Northbridge has collapsed", "Northbridge collapsed because the engineers did not reinforce it", (False, False)),
        ("The garrison occupies Northbridge", "The garrison still occupies Northbridge", (False, True)),
        (None, None, (False, False)),
        ("rain", "no rain", (False, False)),
    ],
)
def test_polarity(spark, statement, claim, want):
    a, b = (F.lit(x).cast("string") for x in (statement, claim))
    assert tuple(one(spark, lexical.contradicts(a, b), lexical.states_continuation(a, b))) == want


def test_affinity_of_nothing(spark):
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    assert list(one(spark, lexical.lexical_affinity(none, none, empty), lexical.target_affinity(none, empty, none), lexical.anchor_supported(none, empty, empty, none))) == [False, False, False]
    assert one(spark, lexical.anchor_supported(F.lit("Old Gate"), F.array(F.lit("the gate fell")), empty, F.lit("")))[0]
    assert not one(spark, lexical.anchor_supported(F.lit("rat"), F.array(F.lit("a pirate came")), empty, F.lit("rat")))[0]


def test_roles_numbers_and_keys(spark):
    none = F.lit(None)
    text, flag = none.cast("string"), none.cast("boolean")
    row = one(spark, chat.message_role(text, flag, flag), chat.visible_role(text, flag, flag), chat.hidden_role(text, flag, F.lit(True), text, flag, flag), chat.bounded_int(text, 3, 1, 9), chat.budget(F.lit(" "), 7), chat.budget(F.lit("Infinity"), 7), chat.chat_key(F.lit("chat"), F.lit(" "), F.lit("x")), chat.parsed_chat_key(F.lit("chat:a:%zz")), chat.rebuild_start(text))
    assert list(row) == ["system", "assistant", "system", 3, 7, 7, "", None, None]
    key = chat.chat_key(F.lit("group"), F.lit("Ä: b/+"), F.lit("c%.jsonl"))
    assert tuple(one(spark, chat.parsed_chat_key(key))[0]) == ("group", "Ä: b/+", "c%")


def test_time_and_places_in_texts(spark):
    none = F.lit(None).cast("string")
    row = one(spark, elapsed.phrases_of_time(none), spatial_text.coordinate_pairs(F.lit("[1,2] (3, -4) x=5 y:6")), spatial_text.distances(F.lit("1,250 km, 3.5 kilometres, 7 kmh")), spatial_text.distance_mode(none, F.lit(None).cast("double"), F.array(F.lit("5 km by road"))), spatial_text.is_scenery(none), spatial_text.name_grounded(F.lit("Oak"), F.array(F.lit("a cloak")), F.array(F.lit("a cloak"))))
    assert row[0] == [] and [tuple(p) for p in row[1]] == [(1, 2), (3, -4), (5, 6)] and row[2] == [1250.0, 3.5] and list(row[3:]) == ["unspecified", True, False]
    assert spatial_text.coordinates(spark.createDataFrame([(1, None), (2, "no")], "id long, said string"), "id", "said").count() == 0


def test_lineage_of_ties_and_hidden_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "b"), (1, 1, "assistant", None), (None, 0, "user", "x")]
    made = [spark.createDataFrame(x, "chat long, pos int, role string, text string") for x in (rows, rows[::-1])]
    assert log.lineage(made[0]).exceptAll(log.lineage(made[1])).isEmpty()
    assert {r.chat: r.head.split(":")[0] for r in log.heads(log.lineage(made[0])).collect()} == {1: "3", None: "1"}
    hidden = [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    shown, other = (spark.createDataFrame(x, "chat long, pos int, role string, text string") for x in (hidden, [hidden[0], (1, 1, "assistant", "c")]))
    assert log.content_lineage(shown).exceptAll(log.content_lineage(other)).count() == 1
    assert log.content_lineage(shown.limit(0)).count() == 0


def test_views_of_odd_rows(spark):
    rows = [(1, "fact", "active", None, None, None), (2, None, "resolved", "At the Old Mill.", ["Old Mill"], 3), (3, "fact", "active", "the old millers", [], 3), (4, "fact", "active", "old mill", None, 3)]
    own = spark.createDataFrame(rows, RECORD)
    named = spark.createDataFrame([(1, "Old Mill", 0.0, 0.0), (2, None, 0.0, 0.0), (3, "", None, None), (4, "old  mill!", 0.04, 0.0), (5, "ox", 9.0, 9.0), (6, "Old Mill Gate", 9.0, 9.0), (7, "Gate Old Mill", 9.0, 9.02)], "id long, name string, x double, y double")
    assert sorted((r.place_id, r["rank"], r.id, r.total) for r in views.place_mentions(named, own).collect()) == [(1, 1, 4, 2), (1, 2, 2, 2), (4, 1, 4, 2), (4, 2, 2, 2)]
    assert {r.id: (r.same_name, r.contained, r.same_point) for r in views.possible_duplicates(named).collect()} == {1: (True, True, True), 4: (True, True, True), 6: (False, True, True), 7: (False, True, True)}
    assert {(r.id, r.depth, r.shown) for r in views.place_tree(named).collect() if r.id in (3, 6)} == {(3, 0, ""), (6, 1, "gate")}
    linked = own.withColumns({"caused_by": F.array(F.lit(2), F.lit(2), F.col("id")), "affects": F.lit(None).cast("array<long>")})
    edges = spark.createDataFrame([(0, 1, 2), (1, 2, 1), (2, 1, 1), (3, None, 1), (4, 1, 99)], "place long, from long, to long")
    assert sorted((r.place, r.relation, r.other, r.status) for r in views.relations(linked, edges).filter("id = 1").collect()) == [(1, "caused by", 2, "resolved"), (2, "related", 2, "resolved"), (3, "related", 99, None)]
    found = views.inspect(spark.createDataFrame([(1,), (77,)], "id long"), own.withColumn("evidence_ids", F.array(F.lit(5), F.lit(6))), spark.createDataFrame([(6, "six")], "id long, claim string"), edges.drop("place"))
    (row,) = found.collect()
    assert (row.id, row.evidence, len(row.links)) == (1, ["six"], 5)
    for df in (views.place_mentions(named.limit(0), own), views.possible_duplicates(named.limit(0)), views.place_tree(named.limit(0)), views.relations(linked.limit(0), edges)):
        assert df.count() == 0


def test_relevance_of_odd_rows(spark):
    rows = [(1, "fact", "active", "a river and the old stone bridge", ["Will"], 5), (2, "development", "active", None, [], None), (3, "development", "resolved", "stone bridge over the river", ["王都"], 9), (4, "development", "active", "river stone bridge", ["will"], 9)]
    own = spark.createDataFrame(rows, RECORD)
    scores = {r.id: r.score for r in records.relevance(own, "will the and of a", now=9).collect()}
    assert scores == {1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0}  # function words tell nothing, as anchors neither
    assert {r.id: r.score for r in records.relevance(own, "王都の門", now=9).collect()}[3] == pytest.approx(5 * (1 + 2 / 24) + 0.8, abs=1e-3)
    assert [r.id for r in records.tombstones(own, "the stone bridge", now=9).collect()] == [3]
    found = records.lifecycle_candidates(own, "the river stone bridge", "the river stone bridge ", now=9).collect()
    assert [(r.id, r.source, r.place) for r in found] == [(4, "current", 1)]
    assert records.lifecycle_candidates(own, " ", "", now=9).count() == 0 and records.tombstones(own.limit(0), "x").count() == 0


def test_consolidation_of_odd_rows(spark):
    own = spark.createDataFrame([(1, "fact", "active", "The gate is shut", ["Gate"], 1), (2, "fact", "resolved", "the gate is SHUT!", None, 1), (3, None, "active", "the gate is shut", [], 1), (4, "fact", "active", None, None, None), (5, "fact", "active", "The gate is shut", [], 1)], RECORD)
    new = spark.createDataFrame([(10, "fact", "", "the gate is shut", None, None), (11, None, "", "the gate is shut", [], None), (12, "fact", "", None, None, None), (13, "fact", "", "else", ["gate"], None)], RECORD)
    got = {r.candidate_id: (r.decision, r.id, r.score) for r in consolidation.decide(new, own).collect()}
    assert got == {10: ("update", 1, 1.0), 11: ("create", None, None), 12: ("create", None, None), 13: ("create", None, None)}
    assert consolidation.decide(new.limit(0), own).count() == 0 and {r.decision for r in consolidation.decide(new, own.limit(0)).collect()} == {"create"}


def test_logs_and_journals_of_odd_rows(spark):
    rows = [(1, 1, "capture", "failed", 5, "a", None), (1, 1, "capture", "applied", 5, "a", None), (1, 2, "capture", "failed", 6, None, None), (1, 3, "capture", "failed", 6, "b", None), (1, 4, "capture", "stale", 7, "", None), (1, 9, "rebuild", "rebuild-completed", None, None, None), (None, 1, "capture", "failed", 5, "a", None)]
    ops = spark.createDataFrame(rows, "chat long, at long, label string, outcome string, message long, lineage string, start long")
    assert sorted((r.message, r.lineage, r["at"]) for r in oplog.capture_failures(ops).filter("chat = 1").collect()) == [(6, "", 2), (6, "b", 3)]
    assert oplog.capture_failures(ops.limit(0)).count() == 0
    before = spark.createDataFrame([(i, i, "v") for i in range(6)], "id long, place long, v string")
    after = spark.createDataFrame([(9, 0, "n"), (1, 1, "v"), (4, 2, "w")], "id long, place long, v string")
    assert sorted(map(tuple, journal.restore_positioned(after, journal.positioned_undo(before, after, "id"), "id").collect())) == [(i, i, "v") for i in range(6)]
    assert journal.restore_positioned(before, journal.positioned_undo(before, before, "id"), "id").exceptAll(before).isEmpty()
    a, b = (journal.content_hashes(spark.createDataFrame(x, "k long, v string"), "k").collect() for x in ([(1, "x"), (1, None)], [(1, None), (1, "x")]))
    assert a == b and len(a) == 1
    faults = journal.integrity_faults(spark.createDataFrame([(1, [None, 7], [])], "id long, evidence_ids array<long>, caused_by array<long>"), spark.createDataFrame([(7, [1])], "id long, record_ids array<long>"), spark.createDataFrame([(1, 1)], "from long, to long")).collect()
    assert [(r.kind, r.id, r.other) for r in faults] == [("no evidence", "1", None)]


def test_place_search_of_odd_rows(spark):
    own = spark.createDataFrame([(1, None, "x", []), (2, "Old Mill", None, None), (3, "The Inn", "by the old river", ["River Way", ""])], "id long, name string, context string, routes array<string>")
    known = place_search.postings(own)
    assert {r.id for r in known.collect()} == {2, 3} and known.filter("kind = 'route'").count() == 1
    assert [r.id for r in place_search.find(own, known, "the old man came").collect()] == []
    assert [r.id for r in place_search.find(own, known, "down the River Way", "old mill").collect()] == [2, 3]
    assert place_search.find(own, known, "", "").count() == 0
    assert {r.id for r in place_search.updated(known, own.filter("id = 2"), own.filter("id = 3").select("id")).collect()} == {2}
    ids = places.effective_ids(spark.createDataFrame([(1, None), (2, 8), (3, 9)], "id long, base_id long"), spark.createDataFrame([(8,), (8,)], "id long"))
    assert sorted(map(tuple, ids.collect())) == [(1, 1), (2, 8), (3, 3)]
