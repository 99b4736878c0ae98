"""Narration of a reply: without blocks of planning and reasoning, and without the planning sections of its state block.

Tags are read once, with their places. Each kind of block, in turn, takes out spans; tags within what is out already don't count. What is left
between the spans is the narration.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocks that are never narration, those of them that hold reasoning, and sections of a state block that plan.
BLOCKS = ("writer_state", "NPC_Inner_Chatter", "CYOA", "Skill_Mastery", "Inventory", "Planted_Seeds", "Consequence_Timers", "Arc_Phase", "Scene_Phase", "think", "thinking", "reasoning")
REASONING = ("think", "thinking", "reasoning")
STATE_BLOCK, COMMENT = "world_state", "inventory_block"
SECTIONS = ("planted seed", "planted seeds", "consequence timer", "consequence timers", "arc phase", "scene phase", "cyoa", "npc inner chatter", "inner chatter", "skill mastery", "inventory")
BULLETS = "-*•+‣◦▪●"

_TAG = re.compile(r"<(/?)([A-Za-z_]+)(\s[^>]*)?(/?)>")


class Tag:
    def __init__(self, match: re.Match):
        close, name, rest, slash = match.groups()
        self.name, self.start, self.end = name.lower(), match.start(), match.end()
        self.closes = bool(close) and not (rest or "").strip() and not slash
        self.empty = not close and (bool(slash) or (rest or "").endswith("/"))
        self.opens = not close and not self.empty


def _tags(text: str) -> list[Tag]:
    return [Tag(m) for m in _TAG.finditer(text)]


def _spans(tags: list[Tag], name: str, size: int) -> list[tuple[int, int]]:
    """Blocks of a name: from an opening tag to the first closing one after it, or to the text's end; an empty tag by itself."""
    out, begun = [], None
    for tag in tags:
        if tag.name != name:
            continue
        if begun is not None:
            if tag.closes:
                out.append((begun, tag.end))
                begun = None
        elif tag.empty:
            out.append((tag.start, tag.end))
        elif tag.opens:
            begun = tag.start
    return out if begun is None else [*out, (begun, size)]


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at : max(at, start)])
        at = max(at, end)
    return "".join([*out, text[at:]])


def _within(tag: Tag, spans: list[tuple[int, int]]) -> bool:
    return any(start <= tag.start < end for start, end in spans)


def _blocks(text: str) -> str:
    tags, out = _tags(text), []
    for name in BLOCKS:
        tags = [t for t in tags if not _within(t, out)]
        # A block that runs over spans that are out already takes them in.
        out += _spans(tags, name.lower(), len(text))
    return _without(text, out)


def _after_reasoning(text: str) -> str:
    """What follows reasoning whose beginning isn't there: after the last closing tag with narration behind it, else after the last one."""
    lone = [t for t in _tags(text) if t.closes and t.name in REASONING]
    if not lone:
        return text
    behind = lambda t: _without(text, [(0, t.end), *((x.start, x.end) for x in lone)]).strip()
    end = next((t for t in reversed(lone) if behind(t)), lone[-1])
    return _without(text, [(0, end.end), *((x.start, x.end) for x in lone)])


def _comments(text: str) -> str:
    spans, at = [], 0
    while (start := text.find("<!--", at)) >= 0:
        at = start + 4
        if text[at:].lstrip()[: len(COMMENT)].lower() == COMMENT:
            end = text.find("-->", at)
            at = len(text) if end < 0 else end + 3
            spans.append((start, at))
    return _without(text, spans)


def _label(line: str) -> str | None:
    """What stands before a line's colon, in lower case and single spaces, without marks at its start; None without a colon."""
    label, colon, _ = line.partition(":")
    return re.sub(r"^[\W_]+", "", label).replace("_", " ").lower() if colon else None


def _plans(line: str) -> bool:
    label = _label(line)
    return label is not None and any(label == s or (label.startswith(s) and not label[len(s)].isalnum() and len(label) - len(s) <= 40) for s in SECTIONS)


def _heads_section(line: str) -> bool:
    """Whether a line begins a section: a bold label after a bullet, or a label that is no entry of a list."""
    own = line.strip()
    if own[:1] and own[0] in BULLETS and own[1:2].isspace():
        bold = re.match(r"\*\*[^*\n]{1,80}?:\s*\*\*", own[1:].lstrip())
        return bold is not None
    if not own or own[0] in BULLETS or re.match(r"\d+[.)]\s", own):
        return False
    return 2 <= own.find(":") <= 81


def _state_narration(body: str) -> str:
    kept, planning = [], False
    for line in body.splitlines(keepends=True):
        bare = line.replace("**", "")
        if _plans(bare):
            planning = True
            continue
        if planning and (re.fullmatch(r"\s*---+\s*", line) or _heads_section(line) or _heads_section(bare)):
            planning = False
        if not planning:
            kept.append(line)
    return "".join(kept)


def _states(text: str) -> str:
    out, at = [], 0
    tags = _tags(text)
    for start, end in _spans(tags, STATE_BLOCK, len(text)):
        own = [t for t in tags if t.name == STATE_BLOCK and start <= t.start < end]
        if own[0].empty:
            continue
        close = own[-1].start if own[-1].closes else end
        out += [text[at : own[0].end], _state_narration(text[own[0].end : close])]
        at = close
    return "".join([*out, text[at:]])


def narration_of(reply: str) -> str:
    return _states(_comments(_after_reasoning(_blocks(reply)))).strip()


def sanitized(text: Column, role: Column | None = None) -> Column:
    """The narration of replies; with a role given, texts of users stay as they are. Null texts are empty.

    A block that never closes runs to the end. Reasoning whose opening tag is missing ends at its lone closing tag; a reply that ends there has no narration.
    """

    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(narration_of)

    clean.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    own = F.coalesce(text, F.lit(""))
    done = F.pandas_udf(clean, "string")(own)
    return done if role is None else F.when(role == "user", own).otherwise(done)
