"""Points and directions that sentences give places, by where words and numbers stand."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import placing

POINTS = [
    ("Northford stands at [1, 2], while Southford stands at [5, 6].", "Northford", [(1, 2)]), ("Northford stands at [1, 2], while Southford stands at [5, 6].", "Southford", [(1, 2)]), ("Northford: [1, 2]; Southford: [5, 6]", "Northford", [(1, 2)]), ("Northford: [1, 2] - and there - Southford: [5, 6]", "Southford", [(5, 6)]),
    ("Northford, a mill town, lies at (1.5, -2), while the ford is at (5, 6).", "Northford", [(1.5, -2)]), ("The mill is at [1, 2].", "Northford", []), ("Northford is at [1, 2].", "northford", [(1, 2)]), ("[1, 2] Northford [3, 4]", "Northford", []),
    ("[1, 2] Northford  [3, 4]", "Northford", [(1, 2)]), ("Falcon Fortress at [1, 2]; the Falcon Peak at [3, 4]", "Falcon Peak", [(3, 4)]), ("The Falcon rises at [1, 2] above the Old Mill at [3, 4]", "Falcon Gate", [(1, 2)]), ("The fort at [1, 2] and [3, 4]", "Falcon Peak", []),
    ("Northford: x=12.4, y=45; Southford **x**: 1 | **y**: +2", "Northford", [(12.4, 45)]), ("Northford: x=12.4, y=45; Southford **x**: 1 | **y**: +2", "Southford", [(1, 2)]), ('Ford {"x": 3, "y": 4}', "Ford", [(3, 4)]), ("Ford [1 2] (3,) [4, 5)", "Ford", []), ("", "Ford", []), ("Ford [1, 2]", "", []), (None, None, []),
]
DIRECTIONS = [
    ("Ashby lies north of Brin.", "Ashby", "Brin", ["north"]), ("Brin lies north of Ashby.", "Ashby", "Brin", ["south"]), ("The north wind blows from Ashby to Brin.", "Ashby", "Brin", []), ("Ashby lies to the north-east, where the road ends", "Ashby", "Brin", ["northeast"]), ("Ashby is 12 km north", "Ashby", "Brin", ["north"]),
    ("They walked southwards from the north gate of Ashby", "Ashby", "Brin", ["north"]), ("Ashby stands south west of Brin; east of Ashby is a mill", "Ashby", "Brin", ["southwest", "west"]), ("north of Mill Town stands the Mill", "Mill", "Mill Town", ["north"]), ("north of Mill Town stands the Mill", "Mill Town", "Mill", ["south"]),
    ("Ashby lies west of the river. Brin is east of Ashby", "Ashby", "Brin", ["west", "west"]), ("northern Ashby", "Ashby", "Brin", []), ("", "a", "b", []), (None, None, None, []),
]


def test_points_given(spark):
    rows = spark.createDataFrame([(k, t, n) for k, (t, n, _) in enumerate(POINTS)], "k int, t string, n string").repartition(3)
    found = {r.k: [(p.x, p.y) for p in r.p] for r in rows.select("k", placing.points_given(F.col("t"), F.col("n")).alias("p")).collect()}
    assert found == {k: x for k, (_, _, x) in enumerate(POINTS)}


def test_directions_given(spark):
    rows = spark.createDataFrame([(k, *x[:3]) for k, x in enumerate(DIRECTIONS)], "k int, t string, a string, b string")
    found = {r.k: list(r.d) for r in rows.select("k", placing.directions_given(F.col("t"), F.col("a"), F.col("b")).alias("d")).collect()}
    assert found == {k: x[3] for k, x in enumerate(DIRECTIONS)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="xy[](),:=|*\"' 12.-+aé", max_size=40))
def test_any_text_is_read(text):
    for start, end, _, _ in placing.pairs_in(text):
        assert 0 <= start < end <= len(text)
    placing.directions_of(text + " north", "a", "x")


@pytest.mark.parametrize("text", ["[" * 50_000, "x" * 50_000, "[1," * 20_000, "x=1" * 20_000])
def test_long_odd_texts_take_linear_time(text):
    assert placing.pairs_in(text) == []
