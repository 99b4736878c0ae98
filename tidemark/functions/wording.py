"""What a piece of text is worded as: a report, a speech act, a plan, a condition. Each piece is read once, word by word, against tables of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _forms(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: Words that report, by themselves.
REPORTS = _forms(
    """report reports reported reportedly reporting rumor rumors rumour rumours rumored rumoured claimed claiming allege alleges alleged allegedly warn warns warned believe believes believed
    belief beliefs suspect suspects suspected predict predicts predicted prediction predictions forecast forecasts forecasted stated announce announces announced declare declares declared confesses
    confessed admit admits admitted denies denied accuse accuses accused proclaim proclaims proclaimed vow vows vowed gossip hearsay"""
)
#: Words that report where a statement follows, and the words that begin one.
REPORTS_BEFORE = _forms("claim claims states")
STATEMENT = _forms("that to the a an this these those his her their its our my he she they it we i you there someone everyone no")
#: Words of saying, but for those that say nothing; of swearing, before what is sworn.
SAYS, SAYS_NOTHING = _forms("say says said"), _forms("nothing little")
SWEARS, SWORN = _forms("swear swears swore"), _forms("that to on by he she they it we i you the his her their")
#: Reports of two words.
PAIRS = {"according": _forms("to"), "said": _forms("to"), "word": _forms("is was has"), "news": _forms("of that about"), "account": _forms("of that"), "accounts": _forms("of that"), "talk": _forms("of")}
#: Words that tell of speech.
TELLS = _forms(
    """insist insists insisted tell tells told explain explains explained mention mentions mentioned whisper whispers whispered inform informs informed shouts shouted yells yelled cried screamed
    muttered murmured replied exclaimed"""
)
#: Words of demands, threats, promises and offers; nouns that are acts too, and what follows one in a summary.
ACTS = _forms(
    """demand demands demanded demanding ordered ordering threaten threatens threatened threatening promise promises promised promising offer offers offered offering ask asks asked asking
    requested requesting insist insists insisted"""
)
ACT_NOUNS, OBJECT = _forms("orders requests"), _forms("that to the a an all every each his her their its them him us everyone everybody anyone no any some")
THREATENS, PROMISES = _forms("threaten threatens threatened threatening"), _forms("promise promises promised promising vow vows vowed")
#: Words of accounts that nobody vouches for, and warnings before what they are of.
UNSURE, WARNINGS = _forms("supposedly purportedly unconfirmed unverified"), _forms("warning warnings")
#: Words that turn to another statement, that coordinate acts, that begin a clause of a noun or time, and times that "that" may point at.
TURNS, COORDINATES = _forms("while whereas but although though meanwhile yet"), _forms("and then or but before after while yet")
SUBORDINATE = _forms("who whom whose which where having after before when once since until")
TIMES = _forms("night day morning evening afternoon dawn dusk week month year time moment hour winter summer spring autumn season same")
#: Words of plans, with "to" and alone; modal verbs, what may stand after them, and owners that make them nouns.
PLANS_TO = _forms("plan plans planned planning plotting intend intends intended intending aim aims hope hopes expect expects expected prepare prepares preparing")
PLANNED = _forms("plan plans planned planning plotting intend intends intended intending intention aim aims expect expects expected expecting prepare prepares preparing if unless threat threatened tomorrow tonight")
MODALS, BETWEEN, OWNERS = _forms("will shall might"), _forms("not never soon surely likely"), _forms("their his her its my our your the own free good ill all")
NOT_VERBS = _forms("the a an his her their its my our your this that these those")
CONDITIONS = _forms("if unless lest suppose supposing should")

_WORD = re.compile(r"[^\W_]+")


class Piece:
    """Words of a text, as written and in lower case, and what stands between them."""

    def __init__(self, text: str):
        found = list(_WORD.finditer(text))
        self.raw, self.words = [m.group() for m in found], [m.group().lower() for m in found]
        ends = [m.end() for m in found]
        self.before = [text[a:m.start()] for a, m in zip([0, *ends], found, strict=False)]

    def next(self, i: int, among: frozenset[str]) -> bool:
        """Whether the next word, after nothing but white space, is one of these."""
        return i + 1 < len(self.words) and self.before[i + 1].isspace() and self.words[i + 1] in among

    def reports(self, i: int) -> int:
        """The place after a report at word i, or 0."""
        w = self.words[i]
        if w in PAIRS and self.next(i, PAIRS[w]):
            return i + 2
        if w in REPORTS or (w in REPORTS_BEFORE and self.next(i, STATEMENT)):
            return i + 1
        if w in SAYS and not self.next(i, SAYS_NOTHING) and not (self.next(i, _forms("no")) and self.next(i + 1, _forms("more"))):
            return i + 1
        oath = self.next(i, _forms("a an")) and self.next(i + 1, _forms("oath"))
        return i + 1 if w in SWEARS and (oath or self.next(i, SWORN)) else 0

    def attributes(self, i: int) -> int:
        """The place after a report or a word of speech at word i, or 0."""
        w = self.words[i]
        if w == "called" and self.next(i, _forms("out")):
            return i + 2
        told_all = w == "told" and i and self.words[i - 1] == "all" and self.before[i].isspace()
        return self.reports(i) or (i + 1 if w in TELLS and not told_all else 0)

    def acts(self, i: int) -> bool:
        return self.words[i] in ACTS or self.words[i] in ACT_NOUNS

    def first(self) -> int:
        return next((end for i in range(len(self.words)) if (end := self.attributes(i))), 0)

    def size(self, n: int) -> int:
        """Characters of the first n words with single spaces between."""
        return sum(map(len, self.words[:n])) + max(0, n - 1)

    def complement(self) -> int:
        """The place after the "that" of the first report that has one within a dozen words, or 0."""
        for i in range(len(self.words)):
            start = self.attributes(i)
            for k in range(start, min(start + 13, len(self.words))) if start else ():
                if self.words[k] == "that" and not self.next(k, TIMES):
                    return k + 1
                if self.words[k] in TURNS or self.words[k] in ("and", "then"):
                    break
        return 0

    def governed(self) -> list[int]:
        """Places that an act at most four words before governs."""
        out = set()
        for i in range(len(self.words)):
            if self.acts(i):
                for k in range(i + 1, min(i + 5, len(self.words)) + 1):
                    out.add(k)
                    if k < len(self.words) and self.words[k] in COORDINATES:
                        break
        return sorted(out)

    def act_content(self) -> bool:
        """Whether a threat or promise is told with what it is of, and no second act after it."""
        n = len(self.words)
        for i, w in enumerate(self.words):
            ends = [i + 2] if w in THREATENS and i + 2 < n and self.words[i + 1] == "to" else [k + 1 for k in range(i + 1, min(i + 5, n)) if self.words[k] in ("to", "that") and k + 1 < n] if w in PROMISES else []
            if ends:
                return not any(x in COORDINATES for x in self.words[ends[0] + 1 :])
        return False

    def _noun(self, i: int) -> bool:
        before = self.words[i - 1] if i and self.before[i].isspace() else ""
        return before in OWNERS or (before == "s" and self.before[i - 1] in ("'", "’"))

    def _goes(self, i: int) -> bool:
        """Whether "going" at word i leads to a verb."""
        return self.next(i, _forms("to")) and not self.next(i + 1, NOT_VERBS) and not (i + 2 < len(self.raw) and self.before[i + 2].isspace() and self.raw[i + 2][0].isupper())

    def prospective(self) -> bool:
        for i, w in enumerate(self.raw):
            if w in MODALS and not self._noun(i):
                k = i + 1 if self.next(i, BETWEEN) and self.raw[i + 1] in BETWEEN and i + 2 < len(self.raw) and self.before[i + 2].isspace() else i
                if k + 1 < len(self.raw) and self.before[k + 1].isspace() and self.raw[k + 1][0].islower():
                    return True
            if (w == "going" and self._goes(i)) or (w == "about" and self.next(i, _forms("to"))) or (w in PLANS_TO and self.next(i, _forms("to"))) or w in ("tomorrow", "Tomorrow"):
                return True
        return False

    def planned(self) -> bool:
        for i, w in enumerate(self.raw):
            own = w[0].lower() + w[1:]
            if w in MODALS or w in ("hope", "hopes") or own in PLANNED or (own == "going" and self._goes(i)) or (own == "about" and self.next(i, _forms("to"))):
                return True
        return False

    def condition(self) -> bool:
        own = self.words[1:] if self.words[:1] == ["even"] and self.words[1:2] and self.words[1] in CONDITIONS | {"in"} else self.words
        return bool(own) and (own[0] in CONDITIONS or own[:2] == ["in", "case"])

    def account(self) -> bool:
        return any(self.reports(i) or w in UNSURE or (w in WARNINGS and self.next(i, _forms("of that about"))) for i, w in enumerate(self.words))

    def act_summary(self) -> bool:
        return any(w in ACTS or w in ("request", "requests") or (w in ("order", "orders") and self.next(i, OBJECT)) for i, w in enumerate(self.words))


#: What is told of a piece: whether it attributes and how many words there are through the first attribution and after it, whether that is framed by its words, the length through a complement's "that", and so on.
FACTS = "struct<says: boolean, frames: boolean, words: int, complement: int, subordinate: boolean, acts: boolean, governed: array<int>, content: boolean, prospective: boolean, condition: boolean>"


def facts(text: str) -> dict:
    piece = Piece(text)
    end = piece.first()
    rest = piece.words[end:]
    frames = bool(end) and (not rest or rest == ["that"] or piece.words[max(0, end - 2) : end] == ["according", "to"] or len(piece.words) <= 4)
    return {
        "says": bool(end), "frames": frames, "words": len(piece.words), "complement": piece.size(piece.complement()), "subordinate": bool(piece.words) and piece.words[0] in SUBORDINATE, "acts": any(map(piece.acts, range(len(piece.words)))),
        "governed": piece.governed(), "content": piece.act_content(), "prospective": piece.prospective(), "condition": piece.condition(),
    }


def _told(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for lists in parts:
        yield pd.Series([[[facts(x or "") for x in texts] for texts in own] for own in lists], dtype=object)


_told.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}


def told_of(lists: Column) -> Column:
    """Facts of each text of each list (an array of arrays of texts)."""
    return F.pandas_udf(_told, f"array<array<{FACTS}>>")(lists)


def _summaries(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in parts:
        own = [Piece(x or "") for x in texts]
        yield pd.DataFrame([(p.account(), p.act_summary(), p.planned(), p.prospective()) for p in own], columns=["account", "acts", "planned", "prospective"])


_summaries.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}


def of_summary(text: Column) -> Column:
    """(account, acts, planned, prospective): whether a text is worded as a report, a speech act, a plan or condition, or an expectation."""
    return F.pandas_udf(_summaries, "struct<account: boolean, acts: boolean, planned: boolean, prospective: boolean>")(F.coalesce(text, F.lit("")))
