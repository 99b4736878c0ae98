"""Base maps: JSON texts of places and routes, read as rows, with what is wrong with them as rows too."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import bounded_text, deterministic_id

#: The most characters of names, types, contexts and versions.
NAME, KIND, CONTEXT, VERSION, ID = 120, 60, 600, 40, 120
_PLACE = "struct<id: string, name: string, type: string, context: string, coordinate: struct<x: string, y: string>, coord: array<string>, routeRefs: array<string>>"
_ROUTE = "struct<id: string, name: string, type: string, context: string, endpoints: array<string>, waypoints: array<string>>"
_MAP = f"struct<id: string, name: string, version: string, locations: array<{_PLACE}>, routes: array<{_ROUTE}>, damaged: string>"


class BaseMaps(NamedTuple):
    """maps (source, id, name, version, n_places, n_routes), places (source, id, name, type, context, x, y, authority, locked, route_refs), routes (source, id, name, type, context, endpoints, waypoints), faults (source, fault, id)."""

    maps: DataFrame
    places: DataFrame
    routes: DataFrame
    faults: DataFrame


def _axis(value: Column) -> Column:
    """A number, also from a text; null for what is none."""
    own = F.trim(value).try_cast("double")
    return F.when(F.isnan(own) | (F.abs(own) == float("inf")), F.lit(None)).otherwise(own)


def _identified(rows: DataFrame, prefix: str) -> DataFrame:
    """rows with ids: their own, else one from the map's id and the name, and from its place among those of the name without one."""
    own = bounded_text(F.col("i.id"), ID)
    order = Window.partitionBy("source", "name", (own == "")).orderBy("at")
    seen = F.row_number().over(order) - 1
    made = F.when(seen > 0, deterministic_id(prefix, F.col("map_id"), F.col("name"), seen)).otherwise(deterministic_id(prefix, F.col("map_id"), F.col("name")))
    return rows.withColumn("id", F.when(own != "", own).otherwise(made))


def parse_base_maps(texts: DataFrame) -> BaseMaps:
    """Base maps of texts (source, text), each source once.

    Places and routes without a name are left out; a point has base authority and is locked, without one its authority is unknown. Points are {x, y} or [x, y], of numbers or texts of
    numbers. Routes keep only ends that are places of the map. A map that is no JSON object, or has an id twice among its places or its routes, is a fault and gives
    nothing else: a row in faults (no object, repeated place, repeated route). Null texts are no objects. Empty tables give empty ones. The places of one name are numbered in
    one task, in their order.
    """
    text = F.coalesce("text", F.lit(""))
    read = F.from_json(text, _MAP, {"columnNameOfCorruptRecord": "damaged"})
    raw = texts.select("source", F.when(F.trim(text).startswith("{"), read).alias("m"))
    whole = raw.filter("m is not null and m.damaged is null")
    broken = raw.filter("m is null or m.damaged is not null").select("source", F.lit("no object").alias("fault"), F.lit(None).cast("string").alias("id"))
    named = F.coalesce(F.nullif(bounded_text(F.col("m.name"), NAME), F.lit("")), F.lit("Base Map"))
    maps = whole.withColumn("name", named).withColumn("map_id", F.coalesce(F.nullif(bounded_text(F.col("m.id"), ID), F.lit("")), deterministic_id("bmap", F.col("name"))))

    def each(column: str, prefix: str) -> DataFrame:
        rows = maps.select("source", "map_id", F.posexplode(f"m.{column}").alias("at", "i")).withColumn("name", bounded_text(F.col("i.name"), NAME)).filter("name <> ''")
        return _identified(rows, prefix)

    places, routes = each("locations", "bloc"), each("routes", "brt")
    twice = lambda rows, fault: rows.groupBy("source", "id").count().filter("count > 1").select("source", F.lit(fault).alias("fault"), "id")
    faults = broken.unionByName(twice(places, "repeated place")).unionByName(twice(routes, "repeated route"))
    bad = faults.select("source").distinct()
    kind = lambda other: F.coalesce(F.nullif(bounded_text(F.col("i.type"), KIND), F.lit("")), F.lit(other))
    point = lambda k, axis: F.when(F.col("i.coordinate").isNotNull(), _axis(F.col(f"i.coordinate.{axis}"))).when(F.size("i.coord") >= 2, _axis(F.get(F.col("i.coord"), F.lit(k))))
    good = places.join(bad, "source", "left_anti").select("source", "id", "name", kind("landmark").alias("type"), bounded_text(F.col("i.context"), CONTEXT).alias("context"), point(0, "x").alias("x"), point(1, "y").alias("y"), F.coalesce("i.routeRefs", F.array().cast("array<string>")).alias("route_refs"))
    there = F.col("x").isNotNull() & F.col("y").isNotNull()
    good = good.withColumns({"authority": F.when(there, "base_canonical").otherwise("unknown"), "locked": there, "x": F.when(there, F.col("x")), "y": F.when(there, F.col("y"))})
    roads = routes.join(bad, "source", "left_anti")
    ends = lambda c: F.coalesce(f"i.{c}", F.array().cast("array<string>"))
    said = roads.select("source", "id", F.explode(F.concat(F.transform(ends("endpoints"), lambda x, k: F.struct(F.lit("e").alias("side"), k.alias("k"), F.trim(x).alias("place"))), F.transform(ends("waypoints"), lambda x, k: F.struct(F.lit("w").alias("side"), k.alias("k"), F.trim(x).alias("place"))))).alias("s")).select("source", "id", "s.*")
    kept = said.join(good.select("source", F.col("id").alias("place")), ["source", "place"], "left_semi")
    lists = kept.groupBy("source", "id").agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("k", "place")))), lambda x: x["place"]).alias(c) for side, c in (("e", "endpoints"), ("w", "waypoints"))))
    none = F.array().cast("array<string>")
    ways = roads.join(lists, ["source", "id"], "left").select("source", "id", "name", kind("corridor").alias("type"), bounded_text(F.col("i.context"), CONTEXT).alias("context"), F.coalesce("endpoints", none).alias("endpoints"), F.coalesce("waypoints", none).alias("waypoints"))
    counts = [rows.groupBy("source").agg(F.count("*").alias(c)) for rows, c in ((good, "n_places"), (ways, "n_routes"))]
    heads = maps.join(bad, "source", "left_anti").select("source", F.col("map_id").alias("id"), "name", bounded_text(F.col("m.version"), VERSION).alias("version"))
    for own in counts:
        heads = heads.join(own, "source", "left")
    return BaseMaps(heads.fillna(0, ["n_places", "n_routes"]), good.select("source", "id", "name", "type", "context", "x", "y", "authority", "locked", "route_refs"), ways, faults)
