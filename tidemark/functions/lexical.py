"""Words that carry content, pairs of characters, and how well a claim fits a text; all column expressions.

Null texts are empty. Words are those of the canonical text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import canonical_text, let, on_word_boundaries, words

#: Words that say nothing of a topic, for ranking.
FUNCTION_WORDS = tuple(
    """a an the and or but nor so yet of to in on at by for from with into onto over under up down out off about as than then that
    this these those there here it its is are was were be been being am do does did has have had will would can could should may might
    must shall not no i me my we us our you your he him his she her they them their what which who whom when where why how all any
    some each if while still now just very too also""".split()
)
#: Words that don't support a claim.
SUPPORT_STOPS = tuple(
    """the and that this with from into onto over under after before while where when then than they them their there here have has
    had was were are is been being will would could should about among through around still current currently now near behind outside""".split()
)
#: Words that turn a statement round, and patterns of them.
NEGATIONS = tuple("not never cannot nor neither none nobody nothing nowhere longer anymore".split())
_NEGATED = r"not|never|cannot|nor|neither|none|no|nobody|nothing|nowhere"
_CONTINUES = r"still|remains?|remained|continues?|continued|persists?|persisted|keeps?|kept|yet"
#: Where a clause ends.
CLAUSE_ENDS = r"(?i)[;,:—–()]|\s(?:and|but|while|whereas|though|although|because|since|until|unless|after|before|when|whenever|where|which|who|whom|whose|that)\s|[.!?]\s+"
#: Wording of hearsay.
_HEARSAY = (
    r"reports?|reported|reportedly|rumou?rs?|rumou?red|allegedly|supposedly|purportedly|unconfirmed|unverified|gossip|hearsay|"
    r"word\s+(?:is|has\s+it)|it\s+is\s+said|heard\s+that|claims?\s+that|claimed\s+that|says?\s+that|said\s+that"
)


def as_words(alternatives: str) -> str:
    """A pattern of whole words, whose ends are ASCII letters, digits and underscores."""
    return rf"(?i)(?<![A-Za-z0-9_])(?:{alternatives})(?![A-Za-z0-9_])"


NEGATED = as_words(_NEGATED) + r"|n['’]t(?![A-Za-z0-9_])"
CONTINUES, HEARSAY = as_words(_CONTINUES), as_words(_HEARSAY)
_SPACELESS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_CONTENT = r"[\p{IsHan}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def listed(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def significant(text: Column, stops: tuple[str, ...] = SUPPORT_STOPS) -> Column:
    """Words of three letters and more that aren't stops, with plural endings folded; repeats stay."""
    n = F.length
    fold = lambda w: F.when((n(w) > 5) & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), n(w) - 3), F.lit("y"))).when((n(w) > 4) & w.endswith("s"), F.substring(w, F.lit(1), n(w) - 1)).otherwise(w)
    return F.transform(F.filter(words(canonical_text(text)), lambda w: (n(w) >= 3) & ~F.array_contains(listed(stops), w)), fold)


def spaceless_pairs(text: Column) -> Column:
    """Different pairs of neighbours within runs of scripts that are written without spaces."""
    runs = F.regexp_extract_all(canonical_text(text), F.lit(rf"([{_SPACELESS}ー]{{2,}})"))
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))))


def shared_spaceless(left: Column, right: Column) -> Column:
    """Pairs of both texts; none unless one of them carries content (is not of syllables only)."""
    shared = F.array_intersect(spaceless_pairs(left), spaceless_pairs(right))
    return F.when(F.exists(shared, lambda p: p.rlike(_CONTENT)), F.size(shared)).otherwise(0)


def shared_content(left: Column, right: Column) -> Column:
    """Pairs of both texts that carry content."""
    return F.size(F.filter(F.array_intersect(spaceless_pairs(left), spaceless_pairs(right)), lambda p: p.rlike(_CONTENT)))


def non_ascii_pairs(text: Column, most: int = 64, newest_first: bool = False) -> Column:
    """The first (or last) different pairs of neighbours, spaces left out, of which one isn't ASCII; of one character it alone."""
    own = F.replace(canonical_text(text), F.lit(" "), F.lit(""))
    chars = F.filter(F.split(own, ""), lambda c: c != "")
    n = F.greatest(F.size(chars) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n), lambda a, b: F.concat(a, b))  # linear in the text
    pairs = F.reverse(pairs) if newest_first else pairs
    some = own.rlike(r"[^\x00-\x7F]")
    none = F.array().cast("array<string>")
    return F.when(~some, none).when(F.length(own) < 2, F.array(own)).otherwise(F.slice(F.array_distinct(F.filter(pairs, lambda p: p.rlike(r"[^\x00-\x7F]"))), 1, most))


def phrase_candidates(text: Column, longest: int = 6, most: int = 384) -> Column:
    """The first different runs of 1 to `longest` words, by their start, then the longest first."""

    def runs(own: Column) -> Column:
        starts = F.when(F.size(own) > 0, F.sequence(F.lit(1), F.size(own))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(own) - s + 1)), lambda k: F.array_join(F.slice(own, s, k), " "))))

    first = F.slice(F.array_distinct(let(words(canonical_text(text)), runs)), 1, most)
    keyed = F.transform(first, lambda p, i: F.struct((-F.size(F.split(p, " "))).alias("w"), i.alias("i"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda x: x["p"])


def bounded_excerpt(text: Column, most: int) -> Column:
    """At most so many characters, cut where a word ends."""
    own = F.trim(F.coalesce(text, F.lit("")))
    head = F.substring(own, 1, most)
    # \z, as $ also stands before a last line's end.
    within = F.substring(own, most + 1, 1).rlike(r"[\p{L}\p{N}]") & head.rlike(r"[\p{L}\p{N}]\z")
    shorter = F.regexp_replace(head, r"\s\S*\z", "")
    return F.when(F.length(own) <= most, own).when(within & head.rlike(r"\s") & (F.length(shorter) > most / 2), F.trim(shorter)).otherwise(F.trim(head))


def _shared(left: Column, right: Column) -> tuple[Column, Column, Column]:
    a, b = F.array_distinct(significant(left)), F.array_distinct(significant(right))
    return a, b, F.array_intersect(a, b)


def _named(anchor: Column) -> Column:
    """Anchors of three characters, or of two in a script without spaces, name something."""
    return (F.length(anchor) >= 3) | ((F.length(anchor) >= 2) & anchor.rlike(f"[{_SPACELESS}]"))


def lexical_affinity(left: Column, right: Column, anchors: Column) -> Column:
    """Whether two texts tell of the same: one holds the other, they share two words, three pairs, an anchor, or one long word."""
    a, b = canonical_text(left), canonical_text(right)
    _, _, both = _shared(left, right)
    held = ((F.length(a) >= 8) & on_word_boundaries(b, a)) | ((F.length(b) >= 8) & on_word_boundaries(a, b))
    anchored = F.exists(F.transform(anchors, canonical_text), lambda x: _named(x) & on_word_boundaries(a, x) & on_word_boundaries(b, x))
    one = (F.size(both) == 1) & (F.length(F.get(both, F.lit(0))) >= 6)
    return (a != "") & (b != "") & (held | (F.size(both) >= 2) | (shared_spaceless(left, right) >= 3) | anchored | F.coalesce(one, F.lit(False)))


def target_affinity(summary: Column, anchors: Column, text: Column) -> Column:
    """Whether a text identifies an existing record: stricter than lexical_affinity()."""
    a, b, both = _shared(summary, text)
    least = F.least(F.size(a), F.size(b))
    one = (F.size(both) == 1) & (F.length(F.get(both, F.lit(0))) >= 6) & (F.size(both) / F.greatest(least, F.lit(1)) >= 0.5)
    hay = canonical_text(text)
    named = F.filter(F.transform(anchors, canonical_text), _named)
    met = F.filter(named, lambda x: on_word_boundaries(hay, x))
    first = F.get(met, F.lit(0))
    alone = (F.size(named) == 1) & (F.size(met) == 1) & ((F.length(first) >= 5) | first.rlike(f"[{_SPACELESS}]"))
    by_anchor = F.exists(met, lambda x: x.contains(" ")) | (F.size(met) >= 2) | F.coalesce(alone, F.lit(False))
    return (F.size(both) >= 2) | F.coalesce(one, F.lit(False)) | ((hay != "") & ((shared_spaceless(summary, text) >= 3) | by_anchor))


def anchor_supported(anchor: Column, claims: Column, known: Column, assertion: Column) -> Column:
    """Whether an anchor stands: known already, in a claim, half of its words in a claim, or in the assertion with a long word in a claim.

    claims, known: arrays of texts."""
    own, need = canonical_text(anchor), significant(anchor)
    of = lambda c: F.filter(need, lambda w: F.array_contains(significant(c), w))
    half = lambda c: (F.size(need) > 0) & (F.size(of(c)) >= F.ceil(F.size(need) / 2)) & F.exists(of(c), lambda w: F.length(w) >= 4)
    in_claim = F.exists(claims, lambda c: on_word_boundaries(canonical_text(c), own) | half(c))
    asserted = on_word_boundaries(canonical_text(assertion), own) & F.exists(claims, lambda c: F.exists(of(c), lambda w: F.length(w) >= 5))
    return (own != "") & (F.exists(known, lambda k: canonical_text(k) == own) | in_claim | asserted)


def hearsay(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(HEARSAY)


def _carrying(statement: Column, claim: Column) -> Column:
    """Clauses of the claim that hold all content words of the statement; none if those are fewer than two."""
    need = F.filter(F.array_distinct(significant(statement)), lambda w: ~F.array_contains(listed(NEGATIONS), w))
    clauses = F.split(F.coalesce(claim, F.lit("")), CLAUSE_ENDS)
    held = F.filter(clauses, lambda c: F.size(F.array_except(need, significant(c))) == 0)
    return F.when(F.size(need) < 2, F.array().cast("array<string>")).otherwise(held)


def contradicts(statement: Column, claim: Column) -> Column:
    """Whether every clause of the claim that carries the statement has the other polarity."""
    clauses, negated = _carrying(statement, claim), F.coalesce(statement, F.lit("")).rlike(NEGATED)
    return (F.size(clauses) > 0) & F.forall(clauses, lambda c: c.rlike(NEGATED) != negated)


def states_continuation(summary: Column, claim: Column) -> Column:
    """Whether a clause carries the summary with its polarity and more words of continuation than it has."""
    clauses, own = _carrying(summary, claim), F.coalesce(summary, F.lit(""))
    return F.exists(clauses, lambda c: (F.regexp_count(c, F.lit(CONTINUES)) > F.regexp_count(own, F.lit(CONTINUES))) & (c.rlike(NEGATED) == own.rlike(NEGATED)))
