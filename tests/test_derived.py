"""Proposals of what follows: rules, inherited evidence, causes of causes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import derived

PROPOSAL = "id long, causes array<long>, supports array<string>, summary string, anchors array<string>"
SUPPORT = "id string, type string, meaningful boolean, record_ids array<long>, message long, lineage string, source_class string, claim string, time_anchor string"
RECORD = "id long, kind string, status string, summary string, anchors array<string>"


def test_rules(spark):
    supports = [
        ("c1", "current", None, [1], 5, "l5", "user_narration", "the gate is sealed", None), ("h1", "historical", None, [1], 2, "l2", "assistant_narration", "the gate was damaged", "spring"), ("h2", "historical", None, [2], 3, "l3", "manual", "the mill burned", None),
        ("t", "time", True, None, 6, "l6", None, "two weeks later", None), ("t0", "time", False, None, 6, "l6", None, "an hour later", None), ("r1", "current", None, [1], 7, "l7", "user_narration", "rumour has it the gate is sealed", None), ("c3", "current", None, [3], 8, "l8", None, "the ford is held", None),
    ]
    records = [(1, "fact", "active", "The gate is sealed", None), (2, "fact", "active", "The mill is gone", None), (3, "fact", "active", "A rumour tells of the ford", None), (8, "development", "active", "Grain runs short in the town", None), (9, "development", "resolved", "Traders leave the market", None)]
    proposals = [
        (1, [1], ["c1"], "Trade slows", None), (2, [], ["c1"], "Trade slows", None), (3, [1, 7], ["c1"], "Trade slows", None), (4, [1], ["c1", "x"], "Trade slows", None), (5, [1], ["c1", "h2"], "Trade slows", None), (6, [1, 2], ["c1"], "Trade slows", None),
        (7, [1], ["h1", "t"], "Trade slows", None), (8, [1, 2], ["h1", "h2", "t"], "Trade slows", None), (9, [1, 2], ["h1", "h2", "t0"], "Trade slows", None), (10, [1], ["r1"], "Trade slows", None), (11, [1], ["r1"], "Trade is said to slow, rumours say", None),
        (12, [3], ["c3"], "Trade slows", None), (13, [1], ["c1"], "Grain runs short in the town", None), (14, [1], ["c1"], "Traders leave the market", None), (15, None, None, None, None), (16, [1, 1], ["c1", "c1"], "Trade slows", None),
    ]
    found = derived.judged(spark.createDataFrame(proposals, PROPOSAL), spark.createDataFrame(supports, SUPPORT), spark.createDataFrame([r[:4] for r in records], "id long, kind string, status string, summary string"), spark.createDataFrame(records, RECORD))
    assert {r.id: (r.reason, r.duplicate) for r in found.collect()} == {
        1: (None, None), 2: ("causes are no targets", None), 3: ("causes are no targets", None), 4: ("unknown support", None), 5: ("support of no cause", None), 6: ("cause without support", None), 7: ("too few causes", None), 8: (None, None),
        9: ("no causal support", None), 10: ("only hearsay", None), 11: (None, None), 12: ("only hearsay", None), 13: ("already there", 8), 14: ("was there before", 9), 15: ("causes are no targets", None), 16: (None, None),
    }
    assert derived.judged(spark.createDataFrame([], PROPOSAL), spark.createDataFrame(supports, SUPPORT), spark.createDataFrame(records, RECORD), spark.createDataFrame(records, RECORD)).count() == 0


def test_inherited_evidence(spark):
    supports = [("h", "historical", None, [1], 2, "l2", "manual", "x", "spring"), ("c", "current", None, [1], 2, "l2", "user_narration", "x", None), ("t", "time", True, None, 2, "l2", None, "x", None), ("d", "current", None, [1], 3, "l3", None, "y", "old"), ("o", "other", None, [1], 3, "l3", None, "z", None)]
    found = derived.inherited_evidence(spark.createDataFrame([(1, None, ["c", "h", "t", "d", "d", "o", "?"], None, None), (2, None, ["h", "c"], None, None), (3, None, None, None, None)], PROPOSAL), spark.createDataFrame(supports, SUPPORT), "noon")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, 2, "l2", "user_narration", "x", ""), (1, 1, 2, "l2", "elapsed_hint", "x", "noon"), (1, 2, 3, "l3", None, "y", ""), (2, 0, 2, "l2", "manual", "x", "spring")]


def test_causes_of_causes(spark):
    rng = random.Random(4)
    edges = {i: [rng.randint(0, 60) for _ in range(rng.choice((0, 1, 1, 2)))] for i in range(60)}
    found = {(r.id, r.cause): r.depth for r in derived.all_causes(spark.createDataFrame([(i, x or None) for i, x in edges.items()], "id long, caused_by array<long>")).collect()}
    want = {}
    for i in edges:
        depth, now = 0, {i}
        while now:
            depth, now = depth + 1, {c for x in now for c in edges.get(x, ())} - {i} - {c for (a, c) in want if a == i}
            want |= {(i, c): depth for c in now}
    assert found == want and max(found.values()) > 3
    assert derived.all_causes(spark.createDataFrame([], "id long, caused_by array<long>")).count() == 0


def test_causes_of_layers(spark, monkeypatch):
    """Records above a core with cycles, of which some are deeper by one cause than by another."""
    monkeypatch.setattr(derived, "SMALL", 20)
    rng = random.Random(8)
    edges = {i: sorted({i // 2, i // 3, rng.randint(0, max(0, i - 1))}) for i in range(8, 160)} | {i: [(i + 1) % 8] for i in range(8)}
    rows = spark.createDataFrame(list(edges.items()), "id long, caused_by array<long>")
    layers, rest = derived._layers(rows.select("id", F.explode("caused_by").alias("cause")), sum(map(len, edges.values())))
    assert len(layers) > 1 and 0 < rest.count() < 160
    found = {(r.id, r.cause): r.depth for r in derived.all_causes(rows).collect()}
    want = {}
    for i in edges:
        depth, now = 0, {i}
        while now:
            depth, now = depth + 1, {c for x in now for c in edges[x]} - {i} - {c for (a, c) in want if a == i}
            want |= {(i, c): depth for c in now}
    assert found == want and derived.all_causes(rows).count() == len(want)
    most = max(want.values())
    assert derived.all_causes(rows, most).count() == len(want)
    with pytest.raises(ValueError):
        derived.all_causes(rows, most - 1)


def test_cut_leaves_no_shuffle_files(spark):
    from tidemark.operators.shared import SHUFFLES_GO, cut

    held = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")
    before = held()
    kept = cut(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    for _ in range(100):  # files go a little later
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before and spark.conf.get(SHUFFLES_GO) == "false" and kept.count() == 10
