"""Whether two statements are about different subjects: heads with other modifiers, or names that only one of them has.

A statement is read once, word by word, into a profile of sets; two profiles are compared by column expressions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.lexical import _SPACELESS, listed
from tidemark.functions.text import canonical_text, words

#: Words that join, that tell one thing from another of its kind, that count something after a number, and that open a sentence without naming.
_STOP = frozenset("the a an is are was were of to and or in on at for with by".split())
DISTINGUISHING = frozenset(
    """north south east west northern southern eastern western northeast northwest southeast southwest upper lower inner outer left right front rear
    first second third fourth fifth last main side central middle""".split()
)
QUANTITIES = frozenset(
    """time times per percent more less fewer x second seconds minute minutes hour hours day days night nights week weeks month months season seasons year years
    mile miles league leagues km kilometers kilometres meter meters metre metres foot feet yard yards pace paces coin coins gold silver copper crown crowns mark marks
    man men people person persons""".split()
)
DETERMINERS = frozenset("the a an this that these those its his her their our my your some many several all most few no every each both another other any there it they he she we one now still after before since during".split())
#: Endings of common nouns; a plural's s counts after other letters than these.
COMMON_ENDINGS, BEFORE_S = ("ness", "ing", "tion", "sion", "ment", "ity", "ance", "ence", "ism", "ship", "hood", "age", "ure", "ery"), "aiosu"
#: Characters that tell subjects apart in scripts without spaces.
SPACELESS_SIGNS = frozenset("北南東西东上下左右前後后内外第一二三四五六七八九十百千0123456789０１２３４５６７８９")

_SENTENCE, _PLAIN, _WORD = re.compile(r"[.!?;]+"), re.compile(r"[^\W_]+"), re.compile(r"[^\W_]+(?:['’-]+[^\W_]+)*")
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th)")


def _heads(sentence: str) -> Iterator[tuple[str, str]]:
    """(head, modifier): a numbered name ("Gate 3"), and what stands before a noun and tells it from others ("north gate", "1st battalion", "Karth gate")."""
    own = _PLAIN.findall(sentence)
    for i in range(len(own) - 1):
        word, lower, following = own[i], own[i].lower(), own[i + 1].lower()
        counted = own[i + 2].lower() if i + 2 < len(own) else ""
        if following.isdecimal() and word[0].isupper() and lower not in _STOP and counted not in QUANTITIES and not counted[:1].isnumeric():
            yield lower, following
        if following in _STOP or lower in _STOP:
            continue
        if lower in DISTINGUISHING or _ORDINAL.fullmatch(lower) or (i and word[0].isupper()):
            yield following, lower


def _common(word: str) -> bool:
    return word.endswith(COMMON_ENDINGS) or (len(word) > 1 and word[-1] == "s" and word[-2] not in BEFORE_S)


def _names(sentences: list[str]) -> Iterator[str]:
    """Words in capitals that may name someone: within a sentence any, of opening ones only the text's first, if it isn't shaped like a common noun."""
    for k, sentence in enumerate(sentences):
        for i, word in enumerate(_WORD.findall(sentence)):
            if not word[0].isupper() or (i == 0 and k > 0):
                continue
            for own in _PLAIN.findall(re.sub(r"['’]s?$", "", word).lower()):
                if len(own) >= 2 and own not in _STOP and own not in DETERMINERS and not (i == 0 and _common(own)):
                    yield own


_PROFILE = "struct<heads: array<struct<head: string, modifier: string>>, names: array<string>>"


def _profiled(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in parts:
        rows = []
        for text in texts:
            sentences = _SENTENCE.split(unicodedata.normalize("NFKC", text or ""))
            rows.append(([{"head": h, "modifier": m} for h, m in dict.fromkeys(x for s in sentences for x in _heads(s))], list(dict.fromkeys(_names(sentences)))))
        yield pd.DataFrame(rows, columns=["heads", "names"])


_profiled.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}


def profile(summary: Column, anchors: Column) -> Column:
    """(heads, names, vocabulary, tokens, chars) of a statement; vocabulary also has the anchors' words, chars are there for scripts without spaces. Null texts are empty."""
    read = F.pandas_udf(_profiled, _PROFILE)(F.coalesce(summary, F.lit("")))
    norm = canonical_text(summary)
    said = F.flatten(F.transform(F.coalesce(anchors, F.array().cast("array<string>")), lambda a: words(canonical_text(a))))
    chars = F.when(norm.rlike(f"[{_SPACELESS}]"), F.filter(F.split(norm, ""), lambda c: c != ""))
    return F.struct(read["heads"].alias("heads"), read["names"].alias("names"), F.array_distinct(F.concat(words(norm), said)).alias("vocabulary"), F.array_distinct(words(norm)).alias("tokens"), chars.alias("chars"))


def _alike_ends(a: Column, b: Column) -> tuple[Column, Column]:
    """What differs of two arrays between their common start and their common end."""
    n = F.least(F.size(a), F.size(b))
    upto = lambda x, y, most: F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.lit(0), lambda k, i: F.when((k == i - 1) & (i <= most) & (F.get(x, i - 1) == F.get(y, i - 1)), i).otherwise(k))
    start = upto(a, b, n)
    end = upto(F.reverse(a), F.reverse(b), n - start)
    rest = lambda x: F.slice(x, start + 1, F.greatest(F.size(x) - start - end, F.lit(0)))
    return rest(a), rest(b)


def distinct(left: Column, right: Column) -> Column:
    """Whether two statements, given as columns of profiles, have different subjects: where that is uncertain they have.

    A head that both have differs if no modifier of it is in both; only modifiers count that the other statement doesn't have at all. Names differ if each
    has one that the other's words and anchors don't mention. In scripts without spaces a short difference with a sign of place or number does.
    """
    own = lambda a, b: F.filter(a["heads"], lambda h: F.array_contains(b["tokens"], h["head"]) & ~F.array_contains(b["tokens"], h["modifier"]))
    mine, theirs = own(left, right), own(right, left)
    of = lambda heads, head: F.transform(F.filter(heads, lambda x: x["head"] == head), lambda x: x["modifier"])
    heads = F.array_intersect(F.transform(mine, lambda x: x["head"]), F.transform(theirs, lambda x: x["head"]))
    modified = F.exists(heads, lambda h: ~F.arrays_overlap(of(mine, h), of(theirs, h)))
    exclusive = lambda a, b: F.size(F.array_except(a["names"], b["vocabulary"])) > 0
    spaced = left["chars"].isNull() & right["chars"].isNull()
    named = spaced & exclusive(left, right) & exclusive(right, left)
    a, b = _alike_ends(left["chars"], right["chars"])
    sign = lambda x: F.size(x).between(1, 3) & F.exists(x, lambda c: F.array_contains(listed(tuple(sorted(SPACELESS_SIGNS))), c))
    signs = F.coalesce(sign(a) & sign(b), F.lit(False))
    return F.coalesce(modified, F.lit(False)) | F.coalesce(named, F.lit(False)) | signs
