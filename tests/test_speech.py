"""Quotations, sentences, reports and the admission of changes on texts made by hand, odd ones included."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import elapsed, speech
from tidemark.operators import admission, log


def texts(spark, column, *values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("t"))).collect()]


def test_quotations(spark):
    found = texts(
        spark, speech.quotations, 'He said "The gate is sealed." and left', 'the "Black Gull" anchors', "he is 6'2\" tall \"and now 20\" ok", "we drove 'em off and 'tis fine",
        "'The soldiers' horses are gone,' Mira said.", "“one\ntwo” rest\n\n“open to\n\nnext", 'The sentry yelled "Bandits"', "「門が」 «oui»", "", None, '"' * 3,
    )
    assert found == [["The gate is sealed."], [], ["and now 20"], [], ["The soldiers' horses are gone,"], ["one\ntwo", "open to"], ["Bandits"], ["門が", "oui"], [], [], []]
    assert texts(spark, speech.narration, 'A "b c" d', None) == ["A   d", ""]


def test_long_texts(spark):
    long = "word 'tis \"said\" " * 60_000
    assert len(texts(spark, speech.quotations, long)[0]) == 60_000
    assert len(texts(spark, speech.sentences, "One. " * 100_000)[0]) == 100_000


def test_sentences_and_clauses(spark):
    assert texts(spark, speech.sentences, 'Lt. Varro came. He left! "Done." Two\nlines\n\n x', " \n ", None) == [["Lt. Varro came.", "He left!", '"Done."', "Two", "lines", "x"], [], []]
    assert [tuple(c) for c in texts(spark, speech.clauses, "x, but y while z; w: v")[0]] == [("x", False), ("but y", False), ("z", True), ("w", True), ("v", False)]
    assert texts(spark, speech.clauses, None, " , ") == [[], []]


CASES = [
    ("the bridge has collapsed", "The bridge has collapsed.", False, False),
    ("the bridge has collapsed", "The scout reports that the bridge has collapsed.", True, True),
    ("the bridge has collapsed", 'A trader says, "The bridge has collapsed."', True, True),
    ("the valley will flood", "Everyone fears the valley will flood.", False, True),
    ("Will Turner left the port", "Will Turner left the port.", False, False),
    ("the dam breaks tonight", "If the dam breaks tonight, run.", False, True),
    ("every vendor pay the toll", "They demand that every vendor pay the toll.", True, True),
    ("soldiers barred the gates", "The captain announced the curfew, soldiers barred the gates.", False, False),
    ("the bridge burned down", "The bridge burned down, the trader said.", True, True),
    ("threatened to burn the granary", "He threatened to burn the granary.", True, True),
    ("threatened the villagers and burned the granary", "He threatened the villagers and burned the granary.", False, False),
    ("the city is under quarantine", "The inn offers no rooms; the city is under quarantine.", False, False),
    ("the strike ended at dawn", "Rumour has it the strike ended at dawn. The strike ended at dawn.", False, False),
    ("the mine is closed", "According to the scouts, the mine is closed while the inn is open.", True, True),
    ("the inn is open", "According to the scouts, the mine is closed while the inn is open.", False, False),
    ("that night the river flooded", "He said nothing, but that night the river flooded.", False, False),
    ("The river flooded. Scouts say the mine is closed.", "The river flooded. Scouts say the mine is closed.", False, False),
    (None, None, False, False),
    ("", "x", False, False),
]


def test_status_of_evidence(spark):
    rows = spark.createDataFrame([(i, c, t, "") for i, (c, t, *_) in enumerate(CASES)], "i int, claim string, text string, focus string")
    got = {r.i: (r.reported, r.attributed) for r in admission.evidence_status(rows).collect()}
    assert [got[i] for i in range(len(CASES))] == [tuple(c[2:]) for c in CASES]
    focused = spark.createDataFrame([(CASES[-3][0], CASES[-3][1], "the mine is closed")], "claim string, text string, focus string")
    assert admission.evidence_status(focused).first().reported
    assert admission.evidence_status(rows.limit(0)).count() == 0


@pytest.fixture(scope="module")
def gate(spark):
    def run(proposals, evidence, messages, records):
        p = spark.createDataFrame(proposals, "proposal_id long, action string, record_id long, summary string, status string, anchors array<string>, episode_of long, related array<long>, bound_id long")
        e = spark.createDataFrame(evidence, "proposal_id long, place int, message_id long, claim string")
        m = spark.createDataFrame(messages, "message_id long, role string, text string")
        r = spark.createDataFrame(records, "id long, status string, summary string, anchors array<string>")
        return {x.proposal_id: (x.reason, x.anchors) for x in admission.admitted(p, e, m, r).collect()}

    return run


def test_gate_of_odd_rows(gate):
    said = "the old bridge has collapsed"
    proposals = [
        (1, "create", None, said, None, ["Old Bridge", "Old Bridge", "Moon"], None, [], None),
        (2, "create", None, None, None, None, None, None, None),
        (3, "resolve", 7, None, None, ["Moon"], None, [7, 7], None),
        (4, "create", None, "A rumour tells of the old bridge", None, [], None, [7], None),
        (5, None, None, None, None, None, None, None, None),
        (6, "noop", None, None, None, None, None, None, None),
        (7, "create", None, said, None, None, None, None, None),
        (8, "create", None, said, None, None, 7, None, None),
    ]
    evidence = [(1, 0, 1, said), (1, 0, 1, said), (2, 0, 1, None), (3, 0, 1, said), (4, 0, 2, said), (7, 1, 99, said), (7, 0, 1, "the moon has fallen"), (8, 0, 1, said), (99, 0, 1, said)]
    messages = [(1, "assistant", "The old bridge has collapsed."), (2, "user", "Rumour has it the old bridge has collapsed."), (3, None, None)]
    got = gate(proposals, evidence, messages, [(7, "active", "The old bridge stands", None)])
    assert got == {
        1: (None, ["Old Bridge", "Old Bridge"]), 2: ("evidence not grounded", None), 3: (None, None), 4: (None, []), 5: ("no evidence", None), 6: (None, None), 7: ("evidence not grounded", None), 8: ("episode not ended", None),
    }


def test_gate_of_nothing(gate):
    assert gate([], [], [], []) == {}
    assert gate([(1, "update", 1, "x", None, None, None, None, None)], [], [], []) == {1: ("target not in context", None)}


TIMES = [
    ("Three weeks later, the bridge that would never be rebuilt fell.", ["Three weeks later"]), ("Two weeks later, we'll be gone.", []), ("We could reach the pass two days later.", []), ("Three days later she could walk again.", ["Three days later"]),
    ('"Two months later," he said. A month has passed.', ["A month has passed"]), ("If the rains come, three weeks later we go.", []), ("As if two days later nothing was lost.", ["two days later"]), ("He left next week.", []),
    ("With all their might they rose, and a year later they won.", ["a year later"]), ("A year later. They plan to go.", ["A year later"]), ("", []), (None, []),
]


def test_established_time(spark):
    found = texts(spark, lambda t: F.transform(elapsed.established(t), lambda p: p["raw"]), *(t for t, _ in TIMES))
    assert found == [x for _, x in TIMES]


def test_newest_time_of_odd_rows(spark):
    rows = [(1, 0, "user", "A month has passed. An hour later she left."), (1, 1, None, "Two hours later he came."), (1, 2, "system", "A year later."), (1, None, "user", "A year later."), (2, 0, "user", None), (None, 0, "user", "An hour later."), (None, 0, "user", "An hour later.")]
    df = spark.createDataFrame(rows, "chat long, pos int, role string, text string")
    assert {(r.chat, r.raw, r.meaningful) for r in log.newest_elapsed(df).collect()} == {(1, "A month has passed", True), (None, "An hour later", False)}
    assert log.newest_elapsed(df.limit(0)).count() == 0
