"""Finding places that a text tells of: postings of their terms, scores, and keeping postings up to date.

Places have id, name, context (a text) and routes (an array of names). Null names have no postings, null contexts no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lexical import FUNCTION_WORDS, listed, non_ascii_pairs
from tidemark.functions.spatial_text import name_strength
from tidemark.functions.text import canonical_text, phrases, words

#: What a term of a kind adds, in the recent text and in the lore.
WEIGHTS = {"name": (100.0, 40.0), "route": (60.0, 20.0), "pair": (50.0, 0.0), "name_word": (30.0, 15.0), "context_word": (12.0, 6.0)}


def _content(text: Column) -> Column:
    return F.array_distinct(F.filter(words(canonical_text(text)), lambda w: ~F.array_contains(listed(FUNCTION_WORDS), w)))


def _of_kind(kind: str, terms: Column, *more: Column) -> Column:
    return F.transform(terms, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term"), *more))


def postings(places: DataFrame) -> DataFrame:
    """(id, kind, term): whole names, routes, pairs of characters that aren't ASCII, words of names and contexts without function words; each once."""
    own = places.filter(canonical_text(F.col("name")) != "")
    routes = F.filter(F.transform(F.coalesce("routes", F.array().cast("array<string>")), canonical_text), lambda r: r != "")
    of = {"name": F.array(canonical_text(F.col("name"))), "route": F.array_distinct(routes), "pair": non_ascii_pairs(F.col("name")), "name_word": _content(F.col("name")), "context_word": _content(F.col("context"))}
    return own.select("id", F.explode(F.concat(*(_of_kind(kind, terms) for kind, terms in of.items()))).alias("p")).select("id", "p.kind", "p.term")


def updated(known: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """Postings after places changed (or came new) and others went (a column id). Only their rows are made anew."""
    gone = changed.select("id").unionByName(removed.select("id")).distinct()
    return known.join(gone, "id", "left_anti").unionByName(postings(changed.join(removed.select("id"), "id", "left_anti")))


def find(places: DataFrame, known: DataFrame, recent: str, lore: str = "", most: int = 6) -> DataFrame:
    """(id, score): the places that the recent text and the lore tell of, best first, ties by id; at most 16.

    A term adds its kind's weight, a name that stands in the text ten times its strength (four times in the lore). Without such a name a
    place needs 24 points, and a whole name or route or two different words.
    """
    spark = places.sparkSession
    rows = []
    for text, side in ((recent, 0), (lore, 1)):
        own = F.lit(text)
        whole = F.array_distinct(phrases(canonical_text(own), 4))
        terms = {"name": whole, "route": whole, "pair": non_ascii_pairs(own, newest_first=True), "name_word": _content(own), "context_word": _content(own)}
        each = F.concat(*(_of_kind(kind, x, F.lit(WEIGHTS[kind][side]).alias("weight")) for kind, x in terms.items()))
        rows.append(spark.range(1).select(F.explode(each).alias("t")).select("t.*").filter("weight > 0"))
    # As many rows as the two texts have terms.
    wanted = F.broadcast(rows[0].unionByName(rows[1]))
    met = known.join(wanted, ["kind", "term"])
    by_word = F.col("kind").isin("name_word", "context_word", "pair")
    sums = met.groupBy("id").agg(F.sum("weight").alias("seed"), F.max(~by_word).alias("phrase"), F.size(F.collect_set(F.when(by_word, F.col("term")))).alias("words"))
    strength = lambda text, weight: name_strength(F.col("name"), F.lit(text)) * weight
    scored = sums.join(places.select("id", "name"), "id").withColumn("named", strength(recent, 10.0) + strength(lore, 4.0))
    kept = scored.filter((F.col("named") > 0) | ((F.col("seed") >= 24) & (F.col("phrase") | (F.col("words") >= 2))))
    return kept.select("id", F.round(F.col("seed") + F.col("named"), 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(max(1, min(most, 16)))
