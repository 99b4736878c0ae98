"""Different subjects, statements that are alike, and what becomes of creations."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import subjects
from tidemark.operators import consolidation

RECORD = "id long, kind string, status string, summary string, anchors array<string>"

#: Two statements, and whether they are about different subjects.
PAIRS = [
    ("Southport north gate is sealed after damage", "Southport south gate is sealed after damage", True), ("The Iron Watch blockades the Brindle bridge", "The Iron Watch tightens the Brindle bridge blockade", False),
    ("The 1st Battalion holds the ford", "The 2nd Battalion holds the ford", True), ("Grain prices are high in Millbrook", "Grain prices are low in Millbrook", False), ("The siege of Karth has lasted 3 days", "The siege of Karth has lasted 4 days", False),
    ("The harbor is sealed. Guards patrol the docks", "The harbor is sealed. Soldiers patrol the docks", False), ("Squad 12 guards the river ford", "Squad 14 guards the river ford", True), ("Gate 3 is barred", "Gate 5 is barred", True),
    ("Bandits raid Harrow 3 times a week", "Bandits raid Harrow 5 times a week", False), ("Tolls 5 silver per wagon at the bridge", "Tolls 3 silver per wagon at the bridge", False), ("Ravenford is besieged by the Iron Legion", "Stonehaven is besieged by the Iron Legion", True),
    ("Bandits hold the pass", "the bandits hold the pass", False), ("Sickness spreads through the city", "Plague spreads through the city", False), ("Ravenford's gates are shut", "Ravenford gates are shut", False), ("北門が閉ざされた", "南門が閉ざされた", True),
    ("門が閉ざされた", "門が開かれた", False), ("第一部隊", "第二部隊", True), ("", "", False), (None, "Gate 3", False), ("First squad and third squad hold", "third squad and first squad hold", False),
]


def test_different_subjects(spark):
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(PAIRS)], "k int, a string, b string")
    both = rows.select("k", subjects.profile(F.col("a"), F.lit(None).cast("array<string>")).alias("a"), subjects.profile(F.col("b"), F.array()).alias("b"))
    for left, right in (("a", "b"), ("b", "a")):
        found = {r.k: r.x for r in both.select("k", subjects.distinct(F.col(left), F.col(right)).alias("x")).collect()}
        assert found == {k: x for k, (_, _, x) in enumerate(PAIRS)}


def test_a_name_that_the_anchors_mention_is_known(spark):
    df = spark.createDataFrame([("Ravenford is besieged", ["r"], "Stonehaven is besieged", ["Ravenford"])], "a string, x array<string>, b string, y array<string>")
    read = df.select(subjects.profile(F.col("a"), F.col("x")).alias("a"), subjects.profile(F.col("b"), F.col("y")).alias("b"))
    assert [r.d for r in read.select(subjects.distinct(F.col("a"), F.col("b")).alias("d")).collect()] == [False]


def _plain(a, b):
    words = lambda t: set("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    canon = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    jac = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    keys = lambda r: {canon(x) for x in r[4] or []} - {""}
    if canon(a[3]) and canon(a[3]) == canon(b[3]):
        return 1.0
    by_words = jac(words(a[3]), words(b[3]))
    return 0.6 * jac(keys(a), keys(b)) + 0.4 * by_words if keys(a) and keys(b) else by_words


@pytest.mark.parametrize("least", [0.55, 0.7, 0.9])
def test_alike_finds_all_pairs(spark, least):
    """Against all pairs, with copies, statements without words, and words that all have."""
    rng = random.Random(int(least * 100))
    pick = lambda: " ".join(["the", *(rng.choice("ash birch cedar dew elm".split()) for _ in range(rng.randint(0, 4)))])
    rows = [(i, rng.choice(("fact", "development", None)), rng.choice(("active", "resolved")), rng.choice((pick(), pick().upper(), "", None)), rng.choice((None, [], ["a b"], ["a b", "c"], ["c", "d", "C!"]))) for i in range(120)]
    df = spark.createDataFrame(rows, RECORD)
    found = {(r.candidate_id, r.id): (r.n, r.score) for r in consolidation.pool(df.filter("id % 2 = 0"), df, least).collect()}
    want = {}
    for a, b in itertools.product(rows[::2], rows):
        if a[1] is not None and a[1] == b[1] and (score := _plain(a, b)) >= least - 1e-9:
            want.setdefault((a[0], b[2] == "active", b[3] or "", tuple(b[4] or ())), []).append((b[0], round(score, 9)))
    assert found == {(k[0], min(i for i, _ in x)): (len(x), x[0][1]) for k, x in want.items()}


def test_alike_long_statements(spark, monkeypatch):
    """Sets on both sides of the size from which single words are keys."""
    monkeypatch.setattr(consolidation, "PAIRED", 12)
    rng, rows = random.Random(9), []
    for i in range(60):
        base = [f"w{k}" for k in range(rng.randint(6, 24))]
        rows.append((i, "fact", "active", " ".join(rng.sample(base, max(1, len(base) - rng.randint(0, 4)))), None))
    df = spark.createDataFrame(rows, RECORD)
    found = {(r.candidate_id, r.id) for r in consolidation.pool(df, df, 0.75).collect()}
    firsts = {}
    for r in rows:
        firsts.setdefault(r[3], r[0])
    assert found == {(a[0], firsts[b[3]]) for a, b in itertools.product(rows, rows) if _plain(a, b) >= 0.75 - 1e-9}


def test_records_that_share_a_common_word_are_no_pairs(spark):
    rows = spark.range(3000).select("id", F.lit("fact").alias("kind"), F.lit("active").alias("status"), F.concat(F.lit("the thing a"), "id", F.lit(" b"), "id", F.lit(" c"), "id").alias("summary"), F.array().cast("array<string>").alias("anchors"))
    right = consolidation._statements(rows, True)
    rarity = consolidation._tokens(right).groupBy("token").agg(F.count("*").alias("df"))
    assert consolidation._keys(right, rarity, 0.7, True).groupBy("key").count().agg(F.max("count")).first()[0] <= 1
    assert consolidation.decide(rows, rows).filter("decision = 'update' and candidate_id = id").count() == 3000


def test_consolidated_creations(spark):
    records = spark.createDataFrame([(1, "fact", "active", "The north gate is sealed", ["north gate"]), (2, "fact", "resolved", "The mill burned down", ["mill"]), (3, "fact", "active", "The ford is held", ["ford", "Ford!", "river"])], RECORD)
    new = spark.createDataFrame([
        (10, "fact", None, "The north gate is sealed", ["Gate", "north gate"]), (11, "fact", None, "The south gate is sealed", ["north gate"]), (12, "fact", "resolved", "The ford is held", ["ford"]), (13, "fact", None, "The mill burned down", ["mill"]),
        (14, "fact", "resolved", "Something else", None), (15, "development", None, "The ford is held", None), (16, "fact", None, None, None), (17, None, None, "The ford is held", None), (10, "fact", None, "The north gate is sealed", ["Gate", "north gate"]),
    ], RECORD)
    found = {r.candidate_id: (r.action, r.record_id, r.anchors) for r in consolidation.consolidate(new, records).collect()}
    assert found == {
        10: ("update", 1, ["north gate", "Gate"]), 11: ("create", None, ["north gate"]), 12: ("resolve", 3, ["ford"]), 13: ("reject", 2, ["mill"]), 14: ("reject", None, []), 15: ("create", None, []), 16: ("create", None, []), 17: ("create", None, []),
    }
    assert consolidation.consolidate(new.limit(0), records).count() == 0


@pytest.mark.parametrize("carried", [0, 4, 9])
def test_alike_short_and_long_statements(spark, monkeypatch, carried):
    """Statements that travel with their keys, and those that are fetched, against all pairs."""
    monkeypatch.setattr(consolidation, "CARRIED", carried)
    rng = random.Random(carried)
    pick = lambda: " ".join(rng.choice("ash birch cedar dew elm fir".split()) for _ in range(rng.randint(0, 7)))
    rows = [(i, "fact", rng.choice(("active", "resolved")), pick(), rng.choice((None, ["a b"], ["a b", "c"], ["c", "d", "e f"]))) for i in range(90)]
    df = spark.createDataFrame(rows, RECORD)
    for least in (0.55, 0.7):
        found = {(r.candidate_id, r.id): (r.n, r.score) for r in consolidation.pool(df.filter("id % 2 = 0"), df, least).collect()}
        want = {}
        for a, b in itertools.product(rows[::2], rows):
            if (score := _plain(a, b)) >= least - 1e-9:
                want.setdefault((a[0], b[2] == "active", b[3], tuple(b[4] or ())), []).append((b[0], round(score, 9)))
        assert found == {(k[0], min(i for i, _ in x)): (len(x), x[0][1]) for k, x in want.items()}


def test_best_of_another_subject_leaves_the_next(spark):
    """The most similar record of the first is about another gate; the next is not."""
    records = spark.createDataFrame([(1, "fact", "active", "Gate 3 is barred now", None), (2, "fact", "active", "the gate is barred now", None), (3, "fact", "resolved", "Gate 6 is barred now", None)], RECORD)
    new = spark.createDataFrame([(10, "fact", None, "Gate 5 is barred now", None), (11, "fact", None, "gate is barred now", None), (12, "fact", None, "Gate 3 is barred now", None)], RECORD)
    found = {r.candidate_id: (r.decision, r.id) for r in consolidation.decide(new, records, 0.5, 0.5).collect()}
    assert found == {10: ("update", 2), 11: ("update", 1), 12: ("update", 1)}


def test_decisions_list_no_pairs(spark):
    """Many statements of the same anchors: what leaves the tasks where they meet is a row of each statement, not of each pair."""
    n = 150
    rows = spark.range(n).select("id", F.lit("fact").alias("kind"), F.lit("active").alias("status"), F.concat(F.lit("old mill number "), "id").alias("summary"), F.array(F.lit("Brand"), F.lit("mill")).alias("anchors"))
    found = consolidation.decide(rows, rows)
    assert {(r.candidate_id, r.id) for r in found.collect()} == {(k, k) for k in range(n)}
    cuts = []
    real = consolidation.cut
    try:
        consolidation.cut = lambda df: (cuts.append(df), real(df))[1]
        consolidation.decide(rows, rows).collect()
    finally:
        consolidation.cut = real
    cuts[0].collect()
    assert 0 < _written(cuts[0]._jdf.queryExecution().executedPlan()) <= 20 * n


def _written(plan) -> int:
    """The most rows that an exchange of a plan wrote."""
    name = plan.getClass().getSimpleName()
    own = plan.metrics().get("shuffleRecordsWritten").get().value() if name == "ShuffleExchangeExec" else 0
    below = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(k) for k in range(plan.children().size())]
    return max([own, *map(_written, below)])
