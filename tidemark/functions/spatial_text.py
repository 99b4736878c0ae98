"""What a text says of places: written coordinates, distances, names. Null texts say nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lexical import as_words, listed
from tidemark.functions.text import canonical_text, on_word_boundaries, words

#: Names that are scenery, not places.
SCENERY = (
    "clearing", "a clearing", "the clearing", "road", "a road", "the road", "dirt road", "forest", "a forest", "the forest", "forest path", "woods", "the woods", "some woods", "trees", "the trees", "some trees", "trail", "a trail", "the trail",
    "path", "a path", "the path", "riverbank", "the riverbank", "a riverbank", "scenery", "generic scenery", "campsite", "a campsite", "the campsite", "room", "a room", "the room", "hallway", "a hallway", "the hallway", "field", "a field", "the field",
    "street", "a street", "the street",
)
#: Words that don't tell one place from another.
PLACE_WORDS = tuple("road street lane trail path track bridge ford culvert ditch ditchline river stream canal harbor harbour yard stockyard market square gate hall inn tavern village town city camp ruin shrine".split())
#: Wording of travel, and of straight distance.
TRAVEL = "road|route|trail|path|river|sea|sail|sailing|travel|travelled|traveled|journey|along|ride|riding|rode|walk|walking|march|marching|hike|hiking|trek|trekking|voyage|winding"
STRAIGHT = "straight line|straightline|direct distance|as the crow flies"
_NUMBER = r"([+-]?\d+(?:\.\d+)?)"
_MARK = r"(?:\*\*)?"
_AXIS = lambda a: rf"{_MARK}[\"']?{a}[\"']?{_MARK}\s*[:=]{_MARK}\s*"
#: The written forms of a pair: in brackets, in parentheses, by the names of axes.
FORMS = (rf"\[\s*{_NUMBER}\s*,\s*{_NUMBER}\s*\]", rf"\(\s*{_NUMBER}\s*,\s*{_NUMBER}\s*\)", rf"(?i){_AXIS('x')}{_NUMBER}\s*(?:,|\||\s+)\s*{_AXIS('y')}{_NUMBER}")
_DISTANCE = r"(?i)(?<![\d.,])(-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?)\s*(?:km(?![A-Za-z0-9_])|kilomet(?:er|re)s?(?![A-Za-z0-9_]))"


def coordinate_pairs(text: Column) -> Column:
    """Array of (x, y) that a text states, form by form."""

    def of(form: str) -> Column:
        xs, ys = (F.regexp_extract_all(text, F.lit(form), F.lit(i)) for i in (1, 2))
        return F.transform(F.arrays_zip(xs.alias("a"), ys.alias("b")), lambda p: F.struct(p["a"].cast("double").alias("x"), p["b"].cast("double").alias("y")))

    return F.concat(*map(of, FORMS))


def coordinates(rows: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, place, x, y): a row for each pair that a row's text states."""
    pairs = coordinate_pairs(F.coalesce(F.col(text_col), F.lit("")))
    return rows.select(key, F.posexplode(pairs).alias("place", "p")).select(key, "place", "p.x", "p.y")


def distances(text: Column) -> Column:
    """Kilometres that a text states; commas may part thousands."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_DISTANCE), F.lit(1)), lambda x: F.replace(x, F.lit(",")).cast("double"))


def distance_sentences(km: Column, sentences: Column) -> Column:
    """Of the sentences those that state the distance."""
    near = F.greatest(F.lit(0.01), F.abs(km) * 1e-6)
    found = F.filter(sentences, lambda s: F.exists(distances(s), lambda v: F.abs(v - km) <= near))
    return F.when(km.isNotNull() & (km >= 0), found).otherwise(F.array().cast("array<string>"))


def distance_mode(proposed: Column, km: Column, sentences: Column) -> Column:
    """straight_line only where the sentence says so, route where it tells of travel; the proposal decides where it says both."""
    own = F.transform(distance_sentences(km, sentences), canonical_text)
    says = lambda pattern: F.exists(own, lambda s: s.rlike(as_words(pattern)))
    kept = F.when(proposed.isin("route", "straight_line"), proposed).otherwise("unspecified")
    return F.when(says(STRAIGHT) & ~says(TRAVEL), "straight_line").when(says(STRAIGHT), kept).when(says(TRAVEL) | (proposed == "route"), "route").otherwise("unspecified")


def is_scenery(name: Column) -> Column:
    own = canonical_text(name)
    return (F.length(own) < 2) | own.isin(*SCENERY)


def name_strength(name: Column, text: Column) -> Column:
    """10 and up to 2 for its length where the whole name stands in the text, 6 where all words of several do."""
    own, hay = canonical_text(name), canonical_text(text)
    parts, have = words(own), words(hay)
    every = (F.size(parts) > 1) & F.forall(parts, lambda w: F.array_contains(have, w))
    return F.when(own == "", 0.0).when(on_word_boundaries(hay, own), 10 + F.least(F.lit(2.0), F.length(own) / 10)).when(every, 6.0).otherwise(0.0)


def name_grounded(name: Column, sources: Column, claims: Column) -> Column:
    """Whether a source has the whole name, or a claim all of its two to four words, of which one tells places apart. sources, claims: arrays of texts."""
    own = canonical_text(name)
    parts = words(own)
    telling = F.exists(parts, lambda w: (F.length(w) >= 3) & ~F.array_contains(listed(PLACE_WORDS), w))
    whole = (F.length(own) >= 2) & F.exists(sources, lambda s: on_word_boundaries(canonical_text(s), own))
    built = F.size(parts).between(2, 4) & telling & F.exists(claims, lambda c: F.size(F.array_except(parts, words(canonical_text(c)))) == 0)
    return (own != "") & (whole | built)
