"""Coordinates on a plane with named axes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The compass points, clockwise from north, and their short forms.
COMPASS = ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")
SHORT = {"n": "north", "ne": "northeast", "e": "east", "se": "southeast", "s": "south", "sw": "southwest", "w": "west", "nw": "northwest"}
#: How strong a coordinate's source is; a locked manual one is 100.
AUTHORITY = {"campaign_override": 90, "base_canonical": 80, "narrative_explicit": 60, "manual": 55, "derived": 50, "relative": 40}


def direction_from_delta(dx: Column, dy: Column) -> Column:
    """Compass point of a step with north along +y and east along +x; null for no step."""
    angle = F.pmod(F.degrees(F.atan2(dx, dy)) + 360, F.lit(360.0))
    sector = (F.floor((angle + 22.5) / 45) % 8).cast("int")
    return F.when((dx == 0) & (dy == 0), F.lit(None)).otherwise(F.element_at(F.array(*map(F.lit, COMPASS)), sector + 1))


def canonical_direction(text: Column) -> Column:
    joined = F.regexp_replace(F.lower(F.trim(text)), r"^(north|south)[\s-]+(east|west)$", "$1$2")
    short = F.create_map(*(F.lit(x) for pair in SHORT.items() for x in pair))
    return F.coalesce(F.try_element_at(short, joined), joined)


def round_decimal(value: Column, step: float) -> Column:
    """To the nearest multiple of step, halves upward, without binary noise."""
    return F.round(F.floor(value / step + 1e-12 + 0.5) * step, 12)


def derive_point(x: Column, y: Column, direction: Column, km: Column, unit_km: float, step: float = 0.01, bounds: tuple[float, float, float, float] | None = None) -> tuple[Column, Column]:
    """The point `km` away in a direction; nulls for an unknown direction, no distance, or a point outside bounds (x from, x to, y from, y to)."""
    own = canonical_direction(direction)
    diagonal = 0.7071067811865475
    side = lambda plus, minus, d: F.when(own.isin(*plus), d).when(own.isin(*minus), -d)
    east = F.coalesce(side(["east"], ["west"], 1.0), side(["northeast", "southeast"], ["northwest", "southwest"], diagonal), F.lit(0.0))
    north = F.coalesce(side(["north"], ["south"], 1.0), side(["northeast", "northwest"], ["southeast", "southwest"], diagonal), F.lit(0.0))
    nx, ny = round_decimal(x + km / unit_km * east, step), round_decimal(y + km / unit_km * north, step)
    fits = own.isin(*COMPASS) & (km > 0)
    if bounds:
        fits = fits & nx.between(bounds[0], bounds[1]) & ny.between(bounds[2], bounds[3])
    return F.when(fits, nx), F.when(fits, ny)


def authority_rank(authority: Column, locked: Column) -> Column:
    rank = F.create_map(*(F.lit(x) for pair in AUTHORITY.items() for x in pair))
    return F.when((authority == "manual") & locked, 100).otherwise(F.coalesce(F.try_element_at(rank, authority), F.lit(0)))
