"""Base maps with faults as rows, and bundles of which two writers can't write one revision."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest

from tidemark.operators.log import _fnv
from tidemark.sources import base_maps, bundles


def _id(*parts):
    return f"{parts[0]}_" + _fnv("|".join(map(str, parts[1:])))


def test_base_maps(spark):
    place = lambda **x: x
    good = {"name": " Vale ", "version": "2", "locations": [
        place(name="Mill", coord=[1, "2.5"]), place(name="Mill"), place(id="gate", name="Gate", type="fort", coordinate={"x": "3", "y": 4}, context=" old "), place(name="  "), place(name="Ford", coord=["", 2]), place(name="Moor", coordinate={"x": None, "y": 1}), place(name="Mill", coord=[5]),
    ], "routes": [{"name": "Road", "endpoints": ["gate", "nowhere"], "waypoints": [" gate "]}, {"name": "Road"}, {"type": "x"}]}
    bad = {"id": "b", "locations": [{"id": "x", "name": "A"}, {"id": "x", "name": "B"}], "routes": [{"id": "r", "name": "A"}, {"id": "r", "name": "B"}]}
    rows = [("good", json.dumps(good)), ("bad", json.dumps(bad)), ("list", "[1]"), ("broken", '{"name": '), ("null", None), ("empty", "{}")]
    found = base_maps.parse_base_maps(spark.createDataFrame(rows, "source string, text string").repartition(2))
    vale = _id("bmap", "Vale")
    assert {tuple(r) for r in found.maps.collect()} == {("good", vale, "Vale", "2", 6, 2), ("empty", _id("bmap", "Base Map"), "Base Map", "", 0, 0)}
    assert {(r.id, r.name, r.type, r.context, r.x, r.y, r.authority, r.locked) for r in found.places.collect()} == {
        (_id("bloc", vale, "Mill"), "Mill", "landmark", "", 1.0, 2.5, "base_canonical", True), (_id("bloc", vale, "Mill", 1), "Mill", "landmark", "", None, None, "unknown", False), (_id("bloc", vale, "Mill", 2), "Mill", "landmark", "", None, None, "unknown", False),
        ("gate", "Gate", "fort", "old", 3.0, 4.0, "base_canonical", True), (_id("bloc", vale, "Ford"), "Ford", "landmark", "", None, None, "unknown", False), (_id("bloc", vale, "Moor"), "Moor", "landmark", "", None, None, "unknown", False),
    }
    assert {(r.id, r.type, tuple(r.endpoints), tuple(r.waypoints)) for r in found.routes.collect()} == {(_id("brt", vale, "Road"), "corridor", ("gate",), ("gate",)), (_id("brt", vale, "Road", 1), "corridor", (), ())}
    assert {tuple(r) for r in found.faults.collect()} == {("bad", "repeated place", "x"), ("bad", "repeated route", "r"), ("list", "no object", None), ("broken", "no object", None), ("null", "no object", None)}
    assert [x.count() for x in base_maps.parse_base_maps(spark.createDataFrame([], "source string, text string"))] == [0, 0, 0, 0]


def test_two_writers_of_one_revision(spark, tmp_path):
    at, rows = f"{tmp_path}/b", spark.range(10)
    assert bundles.newest_revision(spark, at) == 0 and bundles.swap_bundle(rows, at, "me", 0) == 1

    def write(n):
        try:
            return bundles.swap_bundle(spark.range(n), at, "me", 1)
        except bundles.StaleRevision:
            return None

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(write, (20, 30, 40, 50)))
    assert sorted(x for x in done if x) == [2] and bundles.newest_revision(spark, at) == 2
    assert bundles.read_bundle(spark, at, "me", 2).count() == (20, 30, 40, 50)[done.index(2)]
    with pytest.raises(bundles.StaleRevision, match="newest revision is 2"):
        bundles.swap_bundle(rows, at, "me", 0)


def test_a_writer_that_died(spark, tmp_path):
    at, rows = f"{tmp_path}/b", spark.range(3)
    claim, files = bundles._files(spark, f"{at}/claims/000000001")
    files.mkdirs(claim.getParent())
    files.create(claim, False).close()
    with pytest.raises(bundles.StaleRevision, match="another writer"):
        bundles.swap_bundle(rows, at, "me", 0)
    bundles.abandon(spark, at, 1)
    assert bundles.swap_bundle(rows, at, "me", 0) == 1
    bundles.abandon(spark, at, 1)
    assert bundles.read_bundle(spark, at, "me", 1).count() == 3


def test_evaluations_of_replies(spark):
    from tidemark.sources.envelopes import parse_evaluations

    sound = {"recordId": " r ", "outcome": "Stable", "reason": "calm", "supportIds": ["a", " a ", "", "b"], "summary": "ignored", "trend": "rising"}
    rows = [
        sound, {**sound, "outcome": "update", "summary": " ", "trend": "odd", "anchors": []}, {**sound, "outcome": "update", "trend": None, "summary": None, "anchors": ["x", "x"]}, {**sound, "outcome": "resolve", "summary": None}, {**sound, "outcome": "supersede"}, None,
    ]
    other = [{"outcome": "stable", "reason": "x"}, {"recordId": "r", "outcome": "grow", "reason": "x"}, {"recordId": "r", "outcome": "stable", "reason": " "}]
    derived = {"summary": "New", "reason": "so", "causeRecordIds": ["1", "2", "3", "4", "5"], "anchors": None, "trend": "falling"}
    texts = [
        (1, "```json\n" + json.dumps({"evaluations": rows, "derived": [derived]}) + "\n```"), (2, json.dumps({"evaluations": other, "derived": None})), (3, json.dumps({"evaluations": [], "derived": [{"summary": "New"}]})), (4, json.dumps({"evaluations": [sound] * 7})),
        (5, json.dumps({"evaluations": [], "derived": [derived] * 2})), (6, "Here: {}"), (7, "{}"), (8, None), (9, '{"evaluations": ['), (10, json.dumps({"evaluations": []})),
    ]
    found = parse_evaluations(spark.createDataFrame(texts, "id long, reply string"))
    assert {(r.id, r.section, r.ordinal): r.reason for r in found.collect()} == {
        (1, "evaluations", 0): None, (1, "evaluations", 1): "nothing to update", (1, "evaluations", 2): None, (1, "evaluations", 3): "needs a summary", (1, "evaluations", 4): None, (1, "evaluations", 5): "no object", (1, "derived", 0): None,
        (2, "evaluations", 0): "needs a record", (2, "evaluations", 1): "unsupported outcome", (2, "evaluations", 2): "needs a reason", (3, "derived", 0): "needs summary and reason", (4, None, -1): "too many evaluations", (5, None, -1): "too many derived",
        **{(i, None, -1): "not one object with evaluations" for i in (6, 7, 8, 9)},
    }
    own = {(r.section, r.ordinal): r for r in found.filter("id = 1").collect()}
    first, second, new = own["evaluations", 0], own["evaluations", 2], own["derived", 0]
    assert (first.record, first.outcome, first.summary, first.trend, first.anchors, first.supports) == ("r", "stable", None, None, None, ["a", "b"])
    assert (second.anchors, second.summary) == (["x"], None) and (new.causes, new.trend, new.anchors) == (["1", "2", "3", "4"], "falling", [])
    assert parse_evaluations(spark.createDataFrame([], "id long, reply string")).count() == 0
