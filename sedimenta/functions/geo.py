"""Grid cells and boxes (F24-F27, F37-F39, F49) as Column expressions.

Cells are of a latitude-longitude grid, `g<step>:<row>:<column>`; no parity with hexagonal indexes is claimed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_range(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def cell(lat: Column, lon: Column, step: int) -> Column:
    """The cell of a point; null outside the globe. The north and east borders belong to the last cells."""
    row = F.least(F.floor((lat + 90) / step), F.lit(180 // step - 1))
    column = F.least(F.floor((lon + 180) / step), F.lit(360 // step - 1))
    return F.when(in_range(lat, lon), F.concat_ws(":", F.lit(f"g{step}"), row.cast("string"), column.cast("string")))


def parent(cell_id: Column, step: int, to: int) -> Column:
    """The coarser cell that holds a cell; `to` is a multiple of `step`."""
    if to % step:
        raise ValueError("the coarser step must be a multiple of the finer one")
    part = lambda n: F.floor(F.split_part(cell_id, F.lit(":"), F.lit(n)).cast("long") * step / to).cast("string")
    return F.concat_ws(":", F.lit(f"g{to}"), part(2), part(3))


def centre(cell_id: Column, step: int) -> Column:
    part = lambda n: F.split_part(cell_id, F.lit(":"), F.lit(n)).cast("double")
    return F.struct(((part(2) + 0.5) * step - 90).alias("lat"), ((part(3) + 0.5) * step - 180).alias("lon"))


def boundary(cell_id: Column, step: int) -> Column:
    """The closed ring of a cell's corners, as array(struct(lon, lat))."""
    part = lambda n: F.split_part(cell_id, F.lit(":"), F.lit(n)).cast("double") * step
    s, w = part(2) - 90, part(3) - 180
    corner = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    return F.array(corner(w, s), corner(w + step, s), corner(w + step, s + step), corner(w, s + step), corner(w, s))


def decimal_text(x: Column) -> Column:
    """Up to eight decimals without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.8f", x), "0+$", ""), r"\.$", "")


def bbox_text(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.concat_ws(",", *map(decimal_text, (west, south, east, north)))


def bbox_valid(west: Column, south: Column, east: Column, north: Column) -> Column:
    return west.between(-180, 180) & east.between(-180, 180) & south.between(-90, 90) & north.between(-90, 90) & (west < east) & (south < north)


def bbox_contains(lat: Column, lon: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def project(lat: Column, lon: Column, width: int, height: int) -> Column:
    """Linear projection to a viewport, y downwards."""
    return F.struct(((lon + 180) / 360 * width).alias("x"), ((90 - lat) / 180 * height).alias("y"))


def rounded(x: Column, places: int = 6) -> Column:
    return F.round(x, places)
