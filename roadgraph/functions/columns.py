"""Column expressions: ids, coordinates, widths, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: road width in pixels by OSM highway type, and the width of any other type
ROAD_WIDTHS = {
    "motorway": 10, "motorway_link": 7, "trunk": 9, "trunk_link": 6, "primary": 8, "primary_link": 6, "secondary": 7,
    "secondary_link": 5, "tertiary": 6, "tertiary_link": 4, "residential": 5, "living_street": 4, "service": 4, "unclassified": 5,
}
DEFAULT_WIDTH = 5
# fixed values: patterns of the file names that must be accepted: the collection's prefix, the product's name
NAME_PREFIX = r"(?i)^SN3_roads_(train|test)_"
NAME_PRODUCT = r"(?i)_(PS-(RGB|MS)|geojson_roads)"
# fixed values: channel means and deviations of the usual image normalisation
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)


def stem(path: Column) -> Column:
    """File name without folders and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Last extension with its dot, lower case; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def image_id(name: Column) -> Column:
    """Normalised id of an image or vector file from its stem: the collection's prefix and the product's name go."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(name, NAME_PREFIX, ""), NAME_PRODUCT, ""), F.lit("_")))


def road_width(types: Column) -> Column:
    """Width of a list of road types: the first known one counts, else the default. Null types: the default."""
    table = F.create_map(*(F.lit(x) for kv in ROAD_WIDTHS.items() for x in kv))
    known = F.filter(F.transform(types, lambda t: table[t]), lambda w: w.isNotNull())
    return F.coalesce(F.get(known, 0), F.lit(DEFAULT_WIDTH))


def latlon_to_pixel(lat: Column, lon: Column, north: Column, south: Column, west: Column, east: Column, size: int) -> tuple[Column, Column]:
    """(x, y) by the fraction of the bounds, towards zero; y grows to the south."""
    x = ((lon - west) / (east - west) * size).cast("int")
    y = ((north - lat) / (north - south) * size).cast("int")
    return x, y


def lonlat_to_tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Web-mercator tile (x, y) of a point."""
    n = float(2**zoom)
    s = F.sin(F.radians(lat))
    x = F.floor((lon / 360.0 + 0.5) * n)
    y = F.floor((0.5 - 0.25 * F.log((1 + s) / (1 - s)) / F.pi()) * n)
    clamp = lambda v: F.greatest(F.lit(0), F.least(F.lit(int(n) - 1), v)).cast("long")
    return clamp(x), clamp(y)


def tile_corner(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """(lon, lat) of a tile's north-west corner."""
    n = float(2**zoom)
    return x / n * 360.0 - 180.0, F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * y / n))))


def clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def band(percent: Column) -> Column:
    """Resilience band of a score from 0 to 100."""
    p = clamped(percent, 0.0, 100.0)
    return F.when(p >= 70, "high").when(p >= 40, "medium").otherwise("low")


def angular_cost(dir_a: Column, dir_b: Column, bridge: Column) -> Column:
    """Turn that a bridge asks for at both its ends; an end without direction adds nothing. Directions: structs (r, c) of length 1."""
    angle = lambda d: F.coalesce(F.acos(clamped(F.abs(d["r"] * bridge["r"] + d["c"] * bridge["c"]), -1.0, 1.0)), F.lit(0.0))
    return angle(dir_a) + angle(dir_b)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
