"""Lines and texts within a budget, and points that follow from points: brute force and odd rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.geometry import AUTHORITY, COMPASS
from tidemark.functions.text import token_estimate
from tidemark.operators import derivation, rendering

ENTRY = "chat string, place long, id string, kind string, trend string, status string, summary string"
HEADER = "[STATE]\nWhat holds now:"


def test_estimates_add_up(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab_1 .,\n\té漢🙂-") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    found = [r.n for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(token_estimate(F.col("t")).alias("n")).collect()]
    assert found == [rendering.tokens(rendering.units(t)) for t in texts]


@pytest.mark.parametrize(("text", "size", "want"), [("The bridge collapsed", 14, "The bridge"), ("at 12.45 km", 6, "at"), ("at the place [12, 4] now", 16, "at the place"), ("日本語の文章がここにある", 5, "日本語の文"), ("word", 4, "word"), ("a longword", 5, "a lon"), ("x 123456", 5, "x"), ("", 0, "")])
def test_cuts_spare_words_numbers_and_brackets(text, size, want):
    assert rendering.shortened(text, size) == want


def _packed(entries, budget):
    """Line by line, trying all cuts."""
    cost = lambda t: math.ceil(rendering.units(t) * 1.12)
    text, ids = HEADER, []
    for _, _, i, kind, trend, status, summary in entries:
        line = " ".join((summary or "").split())
        if status != "active" or not line:
            continue
        line = f"- {line}" + (f" [trend: {trend}]" if kind == "development" and trend else "")
        if cost(f"{text}\n{line}") > budget:
            cuts = [c for n in range(len(line) - 2) if cost(f"{text}\n" + (c := f"- {rendering.shortened(line[2:], n)}…")) <= budget]
            line = max(cuts, key=len, default="")
            if len(line) - 3 < 8:
                continue
        text += f"\n{line}"
        ids.append(i)
    return (text, cost(text), ids) if ids else None


@pytest.mark.parametrize(("budget", "reserved"), [(30, 0), (60, 0), (60, 25), (2000, 0)])
def test_lines_are_packed_under_the_budget(spark, budget, reserved):
    rng, rows = random.Random(budget), []
    said = lambda: " ".join(rng.choice(("gate", "collapsed", "12.5", "[3, 4]", "old", "漢字", "bridge,", "\n")) for _ in range(rng.randint(0, 30)))
    for chat in range(25):
        rows += [(f"c{chat}", k, f"r{k}", rng.choice(("fact", "development")), rng.choice((None, "rising")), rng.choice(("active", "active", "resolved", None)), rng.choice((said(), None))) for k in range(rng.randint(0, 12))]
    found = {r.chat: (r.text, r.tokens, r.included) for r in rendering.rendered(spark.createDataFrame(rows, ENTRY).repartition(3), HEADER, budget, reserved).collect()}
    want = {c: x for c in {r[0] for r in rows} if (x := _packed([r for r in rows if r[0] == c], budget - reserved))}
    assert found == want and all(t <= budget - reserved for _, t, _ in found.values())


def test_rendering_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, None, "fact", None, "active", "A plain line"), (None, 1, "b", "fact", None, "active", "Another line")], ENTRY).withColumn("text", F.lit(1))
    found = rendering.rendered(rows, HEADER).collect()
    assert [(r.chat, r.included) for r in found] == [(None, [None, "b"])]
    assert rendering.rendered(rows, HEADER, budget=3).count() == 0 and rendering.rendered(rows.limit(0), HEADER).count() == 0


@pytest.mark.parametrize(("budget", "share"), [(100, 40), (57, 30), (5, 3), (10_000, 10_000)])
def test_newest_texts(spark, budget, share):
    rng, rows = random.Random(budget), []
    for chat in range(20):
        rows += [(chat, k, rng.choice((None, " ", "x" * rng.randint(1, 60), f" {k} " * rng.randint(1, 20)))) for k in range(rng.randint(0, 9))]
    found = {(r.chat, r.place): r.text for r in rendering.newest_within(spark.createDataFrame(rows, "chat long, place int, text string").repartition(3), budget, share).collect()}
    want = {}
    for chat in range(20):
        left = budget
        for _, k, text in sorted((r for r in rows if r[0] == chat and (r[2] or "").strip()), reverse=True):
            text, most = text.strip(), min(share, left)
            if most <= 0:
                break
            left -= min(len(text), share) + 1
            if len(text) > most:
                room = most - 7
                text = text[:most] if room <= 0 else text[: room * 55 // 100] + "\n[...]\n" + text[len(text) - (room - room * 55 // 100) :]
            want[chat, k] = text
    assert found == want


def _spread(places, relations):
    """Round by round over all relations."""
    rank = lambda a, locked: 100 if a == "manual" and locked else AUTHORITY.get(a, 0)
    found = {i: (x, y, rank(a, locked), 0, None) for i, x, y, a, locked in places if x is not None}
    there, d = {p[0] for p in places}, 0.7071067811865475
    step = {"north": (0, 1), "south": (0, -1), "east": (1, 0), "west": (-1, 0), "northeast": (d, d), "northwest": (-d, d), "southeast": (d, -d), "southwest": (-d, -d)}
    near = lambda v: round(math.floor(v / 0.01 + 1e-12 + 0.5) * 0.01, 12)
    both = [(a, b, w, km) for a, b, w, km in relations] + [(b, a, COMPASS[(COMPASS.index(w) + 4) % 8] if w in step else None, km) for a, b, w, km in relations]
    last, depth = set(found), 0
    while last:
        depth, new = depth + 1, {}
        for a, b, w, km in both:
            if a in last and b in there and b not in found and a != b and w in step and km and km > 0:
                x, y, r = found[a][:3]
                new.setdefault(b, []).append((-r, a, near(x + km * step[w][0]), near(y + km * step[w][1])))
        for b, own in new.items():
            _, a, x, y = min(own)
            found[b] = (x, y, 0, depth, a)
        last = set(new)
    return {i: (x, y, n, a) for i, (x, y, _, n, a) in found.items()}


PLACE, RELATION = "id long, x double, y double, authority string, locked boolean", "from long, to long, direction string, km double"


@pytest.mark.parametrize("seed", [1, 2])
def test_points_spread_over_relations(spark, seed):
    """Random graphs with cycles, a hub, repeated and odd relations."""
    rng = random.Random(seed)
    places = [(i, *((float(i), float(-i), rng.choice(("base_canonical", "manual", "derived", None)), rng.choice((True, False, None))) if i % 17 == 0 else (None, None, None, None))) for i in range(120)]
    relations = [(rng.choice((5, rng.randint(0, 130))), rng.randint(0, 130), rng.choice((*COMPASS, "up", None)), rng.choice((1.0, 2.5, 0.0, None))) for _ in range(260)]
    found = {r.id: (r.x, r.y, r.depth, r.via) for r in derivation.derived_points(spark.createDataFrame(places, PLACE), spark.createDataFrame(relations + relations[:20], RELATION)).collect()}
    assert found == _spread(places, relations) and max(n for _, _, n, _ in found.values()) >= 3


def test_points_of_odd_graphs(spark):
    ring = [(i, (i + 1) % 5, "n", 1.0) for i in range(5)]
    places = spark.createDataFrame([(i, 0.0 if i == 0 else None, 0.0 if i == 0 else None, None, None) for i in range(6)], PLACE)
    found = {r.id: (r.x, r.y, r.depth) for r in derivation.derived_points(places, spark.createDataFrame(ring, RELATION)).collect()}
    assert found == {0: (0.0, 0.0, 0), 1: (0.0, 1.0, 1), 2: (0.0, 2.0, 2), 4: (0.0, -1.0, 1), 3: (0.0, -2.0, 2)}
    with pytest.raises(ValueError, match="1 rounds"):
        derivation.derived_points(places, spark.createDataFrame(ring, RELATION), rounds=1)
    near = derivation.derived_points(places, spark.createDataFrame(ring, RELATION), bounds=(-9.0, 9.0, -1.0, 1.0))
    assert {r.id for r in near.collect()} == {0, 1, 4}
    assert derivation.derived_points(places.limit(0), spark.createDataFrame(ring, RELATION)).count() == 0
    told = spark.createDataFrame([(0, 1, "north", 1.0), (0, 1, "s", 1.0), (0, 1, "up", 1.0), (0, 9, "south", 1.0)], RELATION)
    at = spark.createDataFrame([(0, 0.0, 0.0, None, None), (1, 0.0, 3.0, None, None)], PLACE)
    assert [r.direction for r in derivation.contradicted(at, told).collect()] == ["s"]
