"""Places: an overlay of base places and a campaign's own, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def effective_places(base: DataFrame, own: DataFrame, fields: list[str]) -> DataFrame:
    """Base places with the fields that an override names, and the campaign's own places.

    own has base_id, null for a place of its own. Overrides of a base place that isn't there stay, under their own id. Of
    several overrides of a base place that with the smallest id holds.
    """
    first = own.filter("base_id is not null").groupBy("base_id").agg(F.min_by(F.struct("id", *fields), "id").alias("o"))
    both = base.select(F.col("id").alias("base_id"), F.struct(*fields).alias("b")).join(first, "base_id", "full")
    over = both.select(F.when(F.col("b").isNotNull(), F.col("base_id")).otherwise(F.col("o.id")).alias("id"), *(F.coalesce(F.col(f"o.{f}"), F.col(f"b.{f}")).alias(f) for f in fields), F.when(F.col("o").isNull(), "base").when(F.col("b").isNull(), "orphan").otherwise("override").alias("origin"))
    return over.unionByName(own.filter("base_id is null").select("id", *fields, F.lit("own").alias("origin")))


def follow_merges(places: DataFrame, hops: int = 8) -> DataFrame:
    """(id, final_id): where merged_into leads in so many steps. Each id is there once: of a repeated one each way is followed."""
    out = places.select("id", F.coalesce("merged_into", "id").alias("final_id"))
    step = places.filter("merged_into is not null").select(F.col("id").alias("final_id"), F.col("merged_into").alias("next"))
    for _ in range(hops - 1):
        out = out.join(step, "final_id", "left").select("id", F.coalesce("next", "final_id").alias("final_id"))
    return out


def by_name(places: DataFrame) -> DataFrame:
    """(name_key, id, ambiguous) of folded names."""
    from tidemark.functions.text import canonical_text

    keyed = places.select("id", canonical_text(F.col("name")).alias("name_key")).filter("name_key <> ''")
    return keyed.groupBy("name_key").agg(F.min("id").alias("id"), (F.count("*") > 1).alias("ambiguous"))


def effective_routes(base: DataFrame, own: DataFrame) -> DataFrame:
    """All routes; a campaign's route replaces the base route of the same id."""
    kept = base.join(own.select("id"), "id", "left_anti").select(base.columns)
    return kept.withColumn("origin", F.lit("base")).unionByName(own.select(base.columns).withColumn("origin", F.lit("own")))


def strongest_claims(claims: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key's claim with the strongest source (claims: authority, locked), the newest of equal ones, with its rank, which replaces a column of that name."""
    from tidemark.functions.geometry import authority_rank

    ranked = claims.withColumn("rank", authority_rank(F.col("authority"), F.col("locked")))
    rest = [c for c in ranked.columns if c != key]
    return ranked.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("rank", *order)).alias("r")).select(key, "r.*")


def effective_ids(own: DataFrame, base: DataFrame) -> DataFrame:
    """(id, effective_id): an override answers to its base place's id while that is there, any other place to its own. own: id, base_id; base: id."""
    there = base.select(F.col("id").alias("base_id")).distinct().withColumn("__there", F.lit(True))
    return own.join(there, "base_id", "left").select("id", F.when(F.col("__there"), F.col("base_id")).otherwise(F.col("id")).alias("effective_id"))


def merge_targets(places: DataFrame) -> DataFrame:
    """(name_key, id): the active place that a merged-away place of a name ended up in, for names that no active place has.

    places: id, name, status, merged_into. Of several merged-away places of a name that with the smallest id counts; chains of more than eight lead nowhere.
    """
    from tidemark.functions.text import canonical_text

    keyed = places.withColumn("name_key", canonical_text(F.col("name"))).filter("name_key <> ''")
    active = keyed.filter("status = 'active'").select("name_key").distinct()
    first = keyed.filter("status = 'archived' and merged_into is not null").groupBy("name_key").agg(F.min("id").alias("start")).join(active, "name_key", "left_anti")
    ends = follow_merges(places)
    live = places.filter("status = 'active'").select(F.col("id").alias("final_id"))
    return first.join(ends, first.start == ends.id).join(live, "final_id", "left_semi").select("name_key", F.col("final_id").alias("id"))


def routes_by_name(routes: DataFrame) -> DataFrame:
    """(name_key, id): the first route, by place, of each folded name. routes: place, id, name."""
    from tidemark.functions.text import canonical_text

    keyed = routes.select("place", "id", canonical_text(F.col("name")).alias("name_key")).filter("name_key <> '' and id is not null")
    return keyed.groupBy("name_key").agg(F.min_by("id", "place").alias("id"))


def current_coordinates(effective: DataFrame, own: DataFrame) -> DataFrame:
    """(effective_id, x, y): the coordinate of the campaign's own active place, else that of the effective one. effective: effective_id, x, y; own: effective_id, status, x, y."""
    live = own.filter("status = 'active' and x is not null and y is not null").groupBy("effective_id").agg(F.min(F.struct("x", "y")).alias("o"))
    both = effective.join(live, "effective_id", "left")
    return both.select("effective_id", F.coalesce("o.x", "x").alias("x"), F.coalesce("o.y", "y").alias("y"))


def active_count(places: DataFrame) -> DataFrame:
    """(n): how many places are active; one row, also for an empty table. Null statuses aren't."""
    return places.agg(F.count_if(F.col("status") == "active").alias("n"))
