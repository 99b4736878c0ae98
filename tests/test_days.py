"""Phrases of time, tags of replies, and days that add up: tables of cases, and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import elapsed, narrative
from tidemark.operators import days


def _values(spark, column, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r.x for r in rows.select("k", column(F.col("t")).alias("x")).orderBy("k").collect()]


PHRASES = {
    "Five weeks later, she returns.": [("Five weeks later", 5, "week", True)],
    "Three hours later, the shift changes.": [("Three hours later", 3, "hour", False)],
    "48 hours later, the crew returns.": [("48 hours later", 48, "hour", True)],
    "A couple of weeks later, the convoy returns.": [("couple of weeks later", 2, "week", True)],
    "The following day, classes resume.": [("The following day", 1, "day", False)],
    "the next semester began": [("the next semester", 1, "term", True)],
    "The next term began; following   season came": [("The next term", 1, "term", True), ("following   season", 1, "season", True)],
    "twenty-five   days      later": [("twenty-five   days      later", 25, "day", True)],
    "twenty five days later": [("twenty five days later", 25, "day", True)],
    "Several months later, I return.": [("Several months later", None, "month", True)],
    "“      After two days” they left": [("After two days", 2, "day", True)],
    "He waited after two days": [],
    "and then, *after a fortnight* passed": [("after a fortnight", 2, "week", True)],
    "The pass is a week on foot from here.": [],
    "Two days on, the caravan": [("Two days on", 2, "day", True)],
    "two days on": [("two days on", 2, "day", True)],
    "Weeks had passed. Many years went by": [("Weeks had passed", None, "week", True), ("Many years went by", None, "year", True)],
    "The weeks of rain; of weeks later": [],
    "a day has gone by; one decade elapsed": [("a day has gone by", 1, "day", False), ("one decade elapsed", 10, "year", True)],
    "two days_later two_days later": [],
    "sixty minutes afterwards": [("sixty minutes afterwards", 60, "minute", False)],
    "hundred": [], "two": [], "after two": [], "the": [], "": [], None: [],
}


def test_phrases_of_time(spark):
    found = _values(spark, elapsed.phrases_of_time, PHRASES)
    assert [[(p.raw, p.amount, p.unit, p.meaningful) for p in x] for x in found] == list(PHRASES.values())


ESTABLISHED = {
    "Five weeks later, the caravan returns.": 1, "Next week, I return to Southport.": 0, "I will come back next week, but today I stay here.": 0, "If five weeks later the gate is still shut, I might leave.": 0,
    'The clerk writes "Five weeks later" in the draft, but no time passes.': 0, "The ferry only leaves after two weeks of waiting.": 0, "The city lies three days on horseback to the north.": 0,
    "If two weeks later it rains we go. Two weeks later it rained.": 1, "Two weeks later it rained. If two weeks later it rains we go.": 1, "two weeks later we plan to go, and two weeks later we went": 1,
    "The planned assault began two days later.": 1, "We planned it: two days later they came.": 1, "We plan that two days later they come.": 0, "It fell against their will two days later.": 1, "I'll be there two days later.": 0,
    "Two days later she would walk.": 1, "She would walk two days later.": 0, "Mr. Hale, unless two days later he came": 0, "Even if two days later he came": 1, "In theory, two days later it ends.": 0,
    "As planned by Dr. Moss two days later": 0, "As agreed with Dr. Moss two days later": 1, "Should it rain: two days later we go.": 0,
}


def test_what_is_narrated_as_past(spark):
    found = _values(spark, elapsed.established, ESTABLISHED)
    assert {t: len(x) for t, x in zip(ESTABLISHED, found, strict=True)} == ESTABLISHED


STEPS = {
    "The next morning, fog lifts.": "the next morning", "It is  The   following\tday.": "the following day", "We will set out the next morning. The next day, we did.": "the next day", "the day after tomorrow": "", "the day after, rain": "the day after", "A day later, the pass opens.": "a day later",
    "After one day the rain stopped": "after one day", "kills after one day": "", "another full day had passed": "another full day had passed", "If the rain stops, the following day would be clear.": "", '"The next morning," he said.': "", "Next morning it snowed": "next morning", "We go tomorrow or the next day": "", "Tomorrow, the next day, we go": "the next day", "": "", None: "",
}


def test_steps_of_a_day(spark):
    assert dict(zip(STEPS, _values(spark, elapsed.day_step, STEPS), strict=True)) == STEPS


REPLIES = {
    '<writer_state mode="brief" />The bridge falls.': "The bridge falls.", "<CYOA />The gate opens.": "The gate opens.", "<CYOA/>x": "x", "Before.<writer_state>plan</writer_state>After.": "Before.After.", "a<Inventory>b": "a",
    "a<think>b<CYOA>c</CYOA>d</think >e": "ae", "a<CYOA>b<think>c</CYOA>d</think>e": "e", "reason</think>The gate.": "The gate.", "one</think>two</reasoning>Three.</think>": "Three.", "only planning</think>": "", "a<thinker>b": "a<thinker>b",
    "x<!-- INVENTORY_BLOCK a --> y <!-- kept --> z<!--inventory_block w": "x y <!-- kept --> z",
    "<World_State>\n**Location:** Mill\nPlanted Seeds:\n- a\n1. Duke: b\nOff-Screen:\n- c\n</World_State> Story.": "<World_State>\n**Location:** Mill\nOff-Screen:\n- c\n</World_State> Story.",
    "<World_State>\n- **Consequence_Timers:** soon\n- a: b\n---\nkept\n": "<World_State>\n---\nkept", "<World_State>\nInventory list of Sera: x\n**Unresolved:**\ny": "<World_State>\n**Unresolved:**\ny", "plain": "plain", "": "", None: "",
    "<Consequence_Timers>Five weeks later</Consequence_Timers> Same morning.": "Same morning.", "<a b> < writer_state > c": "<a b> < writer_state > c",
}


def test_narration_of_replies(spark):
    assert dict(zip(REPLIES, _values(spark, narrative.sanitized, REPLIES), strict=True)) == REPLIES
    kept = spark.createDataFrame([("user", "<CYOA>x"), ("assistant", "<CYOA>x"), (None, "<CYOA>x")], "role string, t string").select(narrative.sanitized(F.col("t"), F.col("role")).alias("x"))
    assert [r.x for r in kept.collect()] == ["<CYOA>x", "", ""]


def _plain(rows, end, since=-1, lookback=40, threshold=2):
    """The walk, row by row. rows: (role, blank, skip, step) by place."""
    steps, fired, counted, before, told, echo = [], None, False, "", False, ""
    for at in range(max(0, since + 1, end - lookback + 1), end + 1):
        role, blank, skip, step = rows[at]
        if role == "system":
            continue
        if role == "user" and before == "assistant":
            counted, echo = False, ""
        follows, before = role == "user" and before == "assistant" and told, role
        if role == "assistant":
            told = False
        if blank:
            continue
        if skip:
            steps, fired, counted = [], None, True
            continue
        if not step:
            continue
        if role == "assistant":
            told = True
        if follows:
            echo = step
            continue
        if role == "assistant" and echo and step == echo:
            counted = True
            continue
        if counted:
            continue
        counted = True
        steps.append(at)
        if len(steps) >= threshold:
            fired, steps = (at, len(steps)), []
    return fired


@pytest.mark.parametrize(("lookback", "threshold", "since"), [(40, 2, None), (7, 2, None), (40, 3, 5)])
def test_days_that_add_up(spark, lookback, threshold, since):
    rng = random.Random(lookback + threshold)
    said = [("The next morning, fog.", False, "the next morning"), ("The following day, rain.", False, "the following day"), ("Three days later, sun.", True, ""), ("Nothing.", False, ""), (" ", False, ""), (None, False, "")]
    rows, chats = [], {}
    for chat in range(40):
        own = []
        for pos in range(rng.randint(1, 30)):
            role, (text, skip, step) = rng.choice(("user", "assistant", "assistant", "system")), rng.choice(said)
            own.append((role, not (text or "").strip(), skip, step))
            rows.append((chat, pos, role, text))
        chats[chat] = own
    log = spark.createDataFrame(rows, "chat long, pos int, role string, text string").repartition(3)
    limits = None if since is None else spark.createDataFrame([(c, since) for c in chats], "chat long, since int")
    found = {(r.chat, r.pos): (r.fired_at, r.n_days) for r in days.accumulated(days.told_steps(log), limits, lookback, threshold).collect()}
    want = {(c, e): x for c, own in chats.items() for e in range(len(own)) if own[e][0] != "system" and e > (since or -1) and (x := _plain(own, e, -1 if since is None else since, lookback, threshold))}
    assert found == want and len(want) > 5


def test_days_of_odd_rows(spark):
    log = spark.createDataFrame([(None, 0, "user", "The next morning I rode."), (None, 1, None, "x"), (None, 2, "user", "The next day I rode."), (1, None, "user", "The next day."), (2, 0, None, None)], "chat long, pos int, role string, text string")
    found = days.accumulated(days.told_steps(log))
    assert [(r.chat, r.pos, r.fired_at, r.n_days) for r in found.collect()] == [(None, 2, 2, 2)]
    assert days.accumulated(days.told_steps(log.limit(0))).count() == 0


def test_what_an_exchange_says_of_time(spark):
    chats = {
        1: [("user", "I ride."), ("assistant", "The next morning, the wagon rolls out."), ("user", "I ride on."), ("assistant", "A day later, the pass opens. Twenty minutes later the mules rest.")],
        2: [("user", "I ride."), ("assistant", "The next morning, fog."), ("user", "I ride."), ("assistant", "Three weeks later, snow. An hour later, sun.")],
        3: [("user", "I wait."), ("assistant", "An hour later, rain.")],
        4: [("user", "I wait."), ("assistant", "Nothing.")],
        5: [("user", "I ride."), ("assistant", "The next morning, fog."), ("user", "I ride."), ("assistant", "The following day, sun."), ("user", "I rest."), ("assistant", "Nothing moves.")],
        None: [("assistant", "Two days later, dawn."), ("user", "An hour later I rise.")],
    }
    log = spark.createDataFrame([(c, k, r, t) for c, rows in chats.items() for k, (r, t) in enumerate(rows)], "chat long, pos int, role string, text string")
    found = {r.chat: (r.kind, r["at"], r.amount, r.unit, r.meaningful) for r in days.continuity_hints(log).collect()}
    assert found == {1: ("accumulated", 3, 2, "day", True), 2: ("explicit", 3, 3, "week", True), 3: ("explicit", 1, 1, "hour", False), None: ("explicit", 0, 2, "day", True)}
    assert days.continuity_hints(log, spark.createDataFrame([(1, 1)], "chat long, since int")).filter("chat = 1").first().kind == "explicit"
    assert days.continuity_hints(log.limit(0)).count() == 0
