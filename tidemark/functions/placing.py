"""Which place a sentence gives a point to, and in which direction it says that one place lies from another: read by where words and numbers stand."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.geometry import COMPASS
from tidemark.functions.spatial_text import PLACE_WORDS

_WORD = re.compile(r"[^\W_]+")
_NUMBER = re.compile(r"[+-]?\d+(?:\.\d+)?")
_CLOSES = {"[": "]", "(": ")"}
#: Words after a compass word that leave it a direction; others name something ("the north wind").
FOLLOWERS = frozenset("of from by along across beyond past then at as toward towards into to over through on in for about some while where when but so until before after whereas yet".split())
#: Characters in which "north of ..." names what it is north of.
REACH = 120


class Scan:
    """A place in a text that moves on over what is expected there."""

    def __init__(self, text: str, at: int):
        self.text, self.at = text, at

    def skip(self, chars: str) -> None:
        while self.at < len(self.text) and (self.text[self.at] in chars or (" " in chars and self.text[self.at].isspace())):
            self.at += 1

    def take(self, options: str) -> bool:
        there = self.at < len(self.text) and self.text[self.at] in options
        self.at += there
        return there

    def number(self) -> float | None:
        found = _NUMBER.match(self.text, self.at)
        if found is None:
            return None
        self.at = found.end()
        return float(found.group())

    def axis(self, name: str) -> float | None:
        """The number of an axis: its name, perhaps in quotes or bold, a colon or equals sign, and the number."""
        self.skip("*\"'")
        if not self.take(name + name.upper()):
            return None
        self.skip("*\"'")
        self.skip(" ")
        if not self.take(":="):
            return None
        self.skip("*")
        self.skip(" ")
        return self.number()


def _pair_at(text: str, i: int) -> tuple[int, float, float] | None:
    """(end, x, y) of the pair of numbers that begins at a place: [x, y], (x, y), or x and y by their names."""
    scan = Scan(text, i)
    if text[i] in _CLOSES:
        scan.at += 1
        scan.skip(" ")
        x = scan.number()
        scan.skip(" ")
        if x is None or not scan.take(","):
            return None
        scan.skip(" ")
        y = scan.number()
        scan.skip(" ")
        return (scan.at, x, y) if y is not None and scan.take(_CLOSES[text[i]]) else None
    if i and text[i - 1].isalnum():
        return None
    x = scan.axis("x")
    if x is None:
        return None
    before = scan.at
    scan.skip(" ")
    if not scan.take(",|") and scan.at == before:
        return None
    scan.skip(" ")
    y = scan.axis("y")
    return None if y is None else (scan.at, x, y)


def pairs_in(text: str) -> list[tuple[int, int, float, float]]:
    """(start, end, x, y) of the pairs in a text, in reading order."""
    out, i = [], 0
    while i < len(text):
        found = _pair_at(text, i) if text[i] in "[(xX*\"'" else None
        if found is None:
            i += 1
        else:
            out.append((i, *found))
            i = found[0]
    return out


def mentions(text: str, name: str) -> list[tuple[int, int]]:
    """Where a text names a place: its whole name, else the first of its words that isn't common among names; none unless all of those are there."""
    words = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
    own, said = [m.group().lower() for m in _WORD.finditer(name)], [w for w, _, _ in words]
    if not own:
        return []
    n = len(own)
    whole = [(words[i][1], words[i + n - 1][2]) for i in range(len(words) - n + 1) if said[i : i + n] == own]
    if whole:
        return whole
    telling = [w for w in own if len(w) >= 3 and w not in PLACE_WORDS]
    return [(a, b) for w, a, b in words if w == telling[0]] if telling and set(telling) <= set(said) else []


def points_of(text: str, name: str) -> list[tuple[float, float]]:
    """The pairs that a sentence gives a place: its only one, or of several those that a mention of the place is nearest to; a mention as near to two gives none."""
    named, pairs = mentions(text, name), pairs_in(text)
    if not named or len(pairs) < 2:
        return [p[2:] for p in pairs] if named else []
    owned = set()
    for start, end in named:
        gaps = [a - end if a >= end else max(0, start - b) for a, b, _, _ in pairs]
        least = min(gaps)
        if gaps.count(least) == 1:
            owned.add(gaps.index(least))
    return [pairs[k][2:] for k in sorted(owned)]


def _compass(words: list[str], i: int) -> tuple[str, int, bool] | None:
    """(direction, place after it, whether it ends in -ward) of the compass word, of one or two words, at word i."""
    two = words[i] + words[i + 1] if i + 1 < len(words) else ""
    if words[i] in ("north", "south") and two in COMPASS:
        return two, i + 2, False
    for end in ("wards", "ward", ""):
        stem = words[i].removesuffix(end) if end and words[i].endswith(end) else words[i] if not end else ""
        if stem in COMPASS and (not end or len(stem) < 6):
            return stem, i + 1, bool(end)
    return None


def directions_of(text: str, subject: str, reference: str) -> list[str]:
    """The directions that a sentence states for the subject as seen from the reference; one told the other way round ("south of <subject>") is turned."""
    found = list(_WORD.finditer(text))
    words, out, i = [m.group().lower() for m in found], [], 0
    while i < len(words):
        there = _compass(words, i)
        if there is None:
            i += 1
            continue
        direction, end, ward = there
        mark = text[found[end - 1].end() : found[end].start() if end < len(words) else len(text)]
        follows = words[end] if end < len(words) and mark.isspace() else None
        if ward or follows is None or follows in FOLLOWERS or follows[0].isdigit():
            turned = False
            if follows in ("of", "from"):
                tail = re.split(r"[.;!?]", text[found[end].end() :], maxsplit=1)[0][:REACH]
                places = [min((a for a, _ in mentions_whole(tail, x)), default=None) for x in (subject, reference)]
                if places[0] is not None:
                    longer = len(subject) > len(reference)
                    turned = places[1] is None or places[0] < places[1] or (places[0] == places[1] and longer)
            out.append(COMPASS[(COMPASS.index(direction) + 4) % 8] if turned else direction)
        i = end
    return out


def mentions_whole(text: str, name: str) -> list[tuple[int, int]]:
    own = [m.group().lower() for m in _WORD.finditer(name)]
    words = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
    n = len(own)
    return [(words[i][1], words[i + n - 1][2]) for i in range(len(words) - n + 1) if [w for w, _, _ in words[i : i + n]] == own] if own else []


def _udf(read, kind: str, *columns: Column) -> Column:  # noqa: ANN001
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for own in parts:
            yield pd.Series([read(*(x or "" for x in row)) for row in zip(*own, strict=True)], dtype=object)

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)(*columns)


def points_given(sentence: Column, name: Column) -> Column:
    """Array of (x, y) that a sentence gives the place of that name. Nulls are empty: nothing."""
    return _udf(lambda text, own: [{"x": x, "y": y} for x, y in points_of(text, own)], "array<struct<x: double, y: double>>", F.coalesce(sentence, F.lit("")), F.coalesce(name, F.lit("")))


def directions_given(sentence: Column, subject: Column, reference: Column) -> Column:
    """Array of compass points at which a sentence puts the subject, as seen from the reference. Nulls are empty: nothing."""
    own = (F.coalesce(c, F.lit("")) for c in (sentence, subject, reference))
    return _udf(directions_of, "array<string>", *own)
