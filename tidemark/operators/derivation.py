"""Points that follow from other points: places that are told of only by where they lie from another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geometry import COMPASS, authority_rank, canonical_direction, derive_point, direction_from_delta
from tidemark.operators.shared import cut, of_round, shuffled


def opposite(direction: Column) -> Column:
    own = canonical_direction(direction)
    return F.coalesce(*(F.when(own == name, COMPASS[(k + 4) % 8]) for k, name in enumerate(COMPASS)))


def derived_points(places: DataFrame, relations: DataFrame, unit_km: float = 1.0, step: float = 0.01, bounds: tuple[float, float, float, float] | None = None, rounds: int = 64) -> DataFrame:
    """(id, x, y, depth, via): all places with a point, their own (depth 0) or one that follows from relations, and the place that it was last taken from.

    places: id (each once), x, y (null: not known), authority, locked. relations: from, to, direction, km: `to` lies so far in that direction from `from`, and the other
    way round. Points spread in rounds from the places that have one; a point once taken stays, so that cycles end. Of several in a round that
    with the strongest source counts (its authority, locked ones first; derived ones below all), then that from the smallest id, then the smallest point. Points outside
    the bounds, unknown directions and relations to places that aren't there give nothing; null distances neither. Only the places of the last round meet relations, so a
    round's work is that of its new points; a hub's relations are spread by the join. More than `rounds` rounds fail.
    """
    own = places.select("id", "x", "y", authority_rank(F.col("authority"), F.coalesce("locked", F.lit(False))).alias("rank"))
    found = own.filter("x is not null and y is not null").select("id", "x", "y", "rank", F.lit(0).alias("depth"), F.lit(None).cast(places.schema["id"].dataType).alias("via"))
    ways = relations.select("from", "to", canonical_direction(F.col("direction")).alias("direction"), "km").filter("`from` <> `to`")
    both = cut(ways.unionByName(ways.select(F.col("to").alias("from"), F.col("from").alias("to"), opposite(F.col("direction")).alias("direction"), "km")).join(shuffled(own.select(F.col("id").alias("to"))), "to", "left_semi"))
    known = frontier = cut(found)
    n = frontier.count()
    for k in range(1, rounds + 2):
        met = both.join(of_round(frontier.select(F.col("id").alias("from"), "x", "y", "rank"), n), "from")
        x, y = derive_point(F.col("x"), F.col("y"), F.col("direction"), F.col("km"), unit_km, step, bounds)
        new = met.select(F.col("to").alias("id"), x.alias("x"), y.alias("y"), "rank", F.col("from").alias("via")).filter("x is not null and y is not null").join(shuffled(known.select("id")), "id", "left_anti")
        best = new.groupBy("id").agg(F.min(F.struct((-F.col("rank")).alias("r"), "via", "x", "y")).alias("b"))
        frontier = cut(best.select("id", "b.x", "b.y", F.lit(0).alias("rank"), F.lit(k).alias("depth"), "b.via"))
        n = frontier.count()
        if not n:
            return known.select("id", "x", "y", "depth", "via")
        if k > rounds:
            break
        known = known.unionByName(frontier)
    raise ValueError(f"points still spread after {rounds} rounds")


def contradicted(places: DataFrame, relations: DataFrame) -> DataFrame:
    """The relations between places with points whose stated compass direction isn't that of the points; other directions contradict nothing."""
    at = lambda end: places.filter("x is not null and y is not null").select(F.col("id").alias(end), F.col("x").alias(f"{end}_x"), F.col("y").alias(f"{end}_y"))
    met = relations.join(at("from"), "from").join(at("to"), "to")
    actual, told = direction_from_delta(F.col("to_x") - F.col("from_x"), F.col("to_y") - F.col("from_y")), canonical_direction(F.col("direction"))
    return met.filter(told.isin(*COMPASS) & (actual != told)).select(relations.columns)
