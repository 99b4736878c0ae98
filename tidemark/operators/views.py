"""Read side: one record with what belongs to it, counts and buckets, relations, mentions of places, the tree of place names.

Null names and summaries are empty; equal rows count each. Results have an order only where a place column says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import canonical_text, on_word_boundaries, words
from tidemark.operators.shared import shuffled


def state_summary(records: DataFrame) -> DataFrame:
    """(status, n, newest) of each status: how many records, and the newest change."""
    return records.groupBy("status").agg(F.count("*").alias("n"), F.max("changed").alias("newest"))


def record_groups(records: DataFrame, now: int, recent: int = 10) -> DataFrame:
    """active records with `bucket`: recent (changed within so many messages), ongoing developments, facts."""
    age = F.lit(now) - F.coalesce("changed", "created", F.lit(-1))
    return records.filter("status = 'active'").withColumn("bucket", F.when(age.between(0, recent), "recent").when(F.col("kind") == "development", "ongoing").otherwise("facts"))


def inspect(ids: DataFrame, records: DataFrame, evidence: DataFrame, links: DataFrame) -> DataFrame:
    """(id, evidence, links) for each id (a column `id`) that is a record.

    evidence: the record's claims in the order of its references (evidence_ids), those that are missing left out; evidence: id, claim.
    links: both ends' ids of what it is linked with, sorted; links: from, to.
    """
    own = records.join(ids.select("id").distinct(), "id", "left_semi")
    refs = own.select("id", F.posexplode("evidence_ids").alias("place", "ref"))
    claims = refs.join(evidence.select(F.col("id").alias("ref"), "claim"), "ref").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "claim"))).alias("c"))
    ends = links.select(F.col("from").alias("id"), "from", "to").unionByName(links.filter(~F.col("from").eqNullSafe(F.col("to"))).select(F.col("to").alias("id"), "from", "to"))
    edges = ends.join(own.select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("links"))
    found = own.select("id").join(claims, "id", "left").join(edges, "id", "left")
    none = F.array().cast("array<string>")
    return found.select("id", F.coalesce(F.transform("c", lambda x: x["claim"]), none).alias("evidence"), F.coalesce("links", F.slice(F.array(F.struct(F.lit(None).cast(links.schema["from"].dataType).alias("from"), F.lit(None).cast(links.schema["to"].dataType).alias("to"))), 1, 0)).alias("links"))


def relations(records: DataFrame, links: DataFrame, most: int = 24) -> DataFrame:
    """(id, place, relation, other, status) of each record: what caused it, what it affects, what it is linked with; each once, the first `most`.

    records: id, status, caused_by and affects (arrays of ids). links: place, from, to. status is null for what is no record.
    """
    listed = lambda c, name, k: records.select("id", F.posexplode(c).alias("at", "other")).select("id", "other", F.lit(name).alias("relation"), F.struct(F.lit(k).alias("k"), F.col("at").cast("long").alias("at")).alias("o"))
    ends = [links.select(F.col(a).alias("id"), F.col(b).alias("other"), F.lit("related").alias("relation"), F.struct(F.lit(3).alias("k"), F.col("place").cast("long").alias("at")).alias("o")) for a, b in (("from", "to"), ("to", "from"))]
    rows = listed("caused_by", "caused by", 1).unionByName(listed("affects", "affects", 2)).unionByName(ends[0]).unionByName(ends[1]).filter(F.col("other") != F.col("id"))
    first = rows.groupBy("id", "relation", "other").agg(F.min("o").alias("o")).join(records.select("id"), "id", "left_semi")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("o", "other"))).filter(F.col("place") <= most)
    return placed.join(records.select(F.col("id").alias("other"), "status"), "other", "left").select("id", "place", "relation", "other", "status")


def place_mentions(places: DataFrame, records: DataFrame, most: int = 6) -> DataFrame:
    """(place_id, rank, id, total): records with the place's name as an anchor or, from four characters on, in their summary as whole words.

    Active ones first, then those changed last, then by id. Names of two characters and fewer are never mentioned. Different texts meet different names by the
    name's rarest word: a common word in a name brings nothing together. Places of a name share its mentions, which are ranked once.
    """
    named = places.select(F.col("id").alias("place_id"), canonical_text(F.col("name")).alias("name")).filter(F.length("name") >= 3)
    names = named.select("name").distinct()
    by_anchor = records.select("id", F.explode(F.transform("anchors", canonical_text)).alias("name")).distinct().join(shuffled(names), "name", "left_semi")
    said = records.select("id", canonical_text(F.col("summary")).alias("said"))
    texts = said.select("said").distinct()
    parts = names.filter(F.length("name") >= 4).select("name", F.explode(F.array_distinct(words(F.col("name")))).alias("word"))
    having = texts.select("said", F.explode(F.array_distinct(words(F.col("said")))).alias("word")).join(shuffled(parts.select("word").distinct()), "word", "left_semi")
    rarity = having.groupBy("word").agg(F.count("*").alias("df"))
    # A name with a word that no record has is in none.
    rarest = parts.join(shuffled(rarity), "word", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("w")).filter("w.df > 0").select("name", F.col("w.word").alias("word"))
    met = having.join(shuffled(rarest), "word").filter(on_word_boundaries(F.col("said"), F.col("name"))).select("said", "name").distinct()
    by_text = said.join(shuffled(met), "said").select("id", "name")
    found = by_anchor.select("id", "name").unionByName(by_text).distinct().join(shuffled(records.select("id", "status", "changed")), "id")
    order = Window.partitionBy("name").orderBy((F.col("status") == "active").desc(), F.coalesce("changed", F.lit(-1)).desc(), "id")
    first = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    ranked = first.join(shuffled(found.groupBy("name").agg(F.count("*").alias("total"))), "name")
    return shuffled(named).join(ranked, "name").select("place_id", "rank", "id", "total")


def name_ancestors(places: DataFrame, deepest: int = 8) -> DataFrame:
    """(name, ancestor, distance): names that are whole-word beginnings of others, by how many names lie between."""
    names = places.select(canonical_text(F.col("name")).alias("name")).filter("name <> ''").distinct()
    starts = names.select("name", F.explode(F.expr("transform(sequence(1, size(split(name, ' '))), k -> array_join(slice(split(name, ' '), 1, k), ' '))")).alias("ancestor")).filter("ancestor <> name")
    found = starts.join(names.withColumnRenamed("name", "ancestor"), "ancestor")
    distance = F.row_number().over(Window.partitionBy("name").orderBy(F.length("ancestor").desc()))
    return found.withColumn("distance", distance).filter(F.col("distance") <= deepest).select("name", "ancestor", "distance")


def place_tree(places: DataFrame) -> DataFrame:
    """(id, depth, shown, path): places under the longest beginning of their name that is a name; depth is 3 at most.

    shown is what a name adds to its parent's. path sorts a place right after its parent: the names from the root on, and the id. Of
    several places of a name the smallest id is the parent.
    """
    named = places.select("id", canonical_text(F.col("name")).alias("name"))
    up = name_ancestors(places).groupBy("name").agg(F.count("*").alias("above"), F.min_by("ancestor", "distance").alias("parent"), F.array_sort(F.collect_list("ancestor")).alias("line"))
    out = named.join(up, "name", "left")
    shown = F.when(F.col("parent").isNull(), F.col("name")).otherwise(F.trim(F.expr("substring(name, length(parent) + 1)")))
    line = F.concat(F.coalesce("line", F.array().cast("array<string>")), F.array("name"))
    return out.select("id", F.least(F.coalesce("above", F.lit(0)), F.lit(3)).cast("int").alias("depth"), shown.alias("shown"), F.concat_ws("/", line).alias("path"))


def possible_duplicates(places: DataFrame, near: float = 0.05) -> DataFrame:
    """(id, same_name, contained, same_point) of places that may be the same as another.

    same_name: another has its name. contained: a name of other words, of which the smaller set has two at least and lies in the other; none
    if one name begins the other (they are nested). same_point: another within `near` on both axes, with two words in common, not nested.
    Names are compared once each, whatever number of places has them.
    """
    own = places.select("id", "x", "y", canonical_text(F.col("name")).alias("name")).filter("name <> ''")
    names = own.groupBy("name").agg(F.count("*").alias("n")).withColumn("w", F.array_distinct(words(F.col("name"))))
    nested = lambda a, b: F.concat(b, F.lit(" ")).startswith(F.concat(a, F.lit(" "))) | F.concat(a, F.lit(" ")).startswith(F.concat(b, F.lit(" ")))
    # A name lies in others that have its rarest word.
    each = names.select("name", F.explode("w").alias("word"))
    rarity = each.groupBy("word").agg(F.count("*").alias("df"))
    rarest = each.join(rarity, "word").groupBy("name").agg(F.min(F.struct("df", "word")).alias("k")).select("name", F.col("k.word").alias("word")).join(names.filter(F.size("w") >= 2).select("name", "w"), "name")
    around = each.select(F.col("name").alias("other"), "word").join(rarest, "word").filter("name <> other").join(names.select(F.col("name").alias("other"), F.col("w").alias("wo")), "other")
    lies = around.filter((F.size(F.array_except("w", "wo")) == 0) & ~nested(F.col("name"), F.col("other")))
    contained = lies.select(F.explode(F.array("name", "other")).alias("name")).distinct().withColumn("contained", F.lit(True))
    # A point meets those of its own cell and the cells beside it.
    cell = lambda c, step: F.floor(F.col(c) / near).cast("long") + step
    points = own.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select("id", "name", "x", "y", cell("x", 0).alias("cx"), cell("y", 0).alias("cy"))
    around = points.select(F.col("id").alias("other_id"), F.col("name").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.explode(F.array(*(F.struct(cell("x", i).alias("cx"), cell("y", j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("c")).select("other_id", "other", "ox", "oy", "c.*")
    close = points.join(around, ["cx", "cy"]).filter((F.col("id") != F.col("other_id")) & (F.abs(F.col("x") - F.col("ox")) <= near) & (F.abs(F.col("y") - F.col("oy")) <= near))
    two = F.size(F.array_intersect(F.split("name", " "), F.split("other", " "))) >= 2
    at_point = close.filter(two & ((F.col("name") == F.col("other")) | ~nested(F.col("name"), F.col("other")))).select("id").distinct().withColumn("same_point", F.lit(True))
    flags = own.join(names.select("name", (F.col("n") > 1).alias("same_name")), "name").join(contained, "name", "left").join(at_point, "id", "left")
    flags = flags.select("id", "same_name", F.coalesce("contained", F.lit(False)).alias("contained"), F.coalesce("same_point", F.lit(False)).alias("same_point"))
    return flags.filter("same_name or contained or same_point")
