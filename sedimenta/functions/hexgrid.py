"""A hexagonal grid as Column expressions: cells, parents, children, centres and boundaries.

Centres of resolution 0 are a triangular lattice of spacing SPACING on an equal-area cylinder (x the longitude in radians, y the
sine of the latitude); a step finer multiplies the lattice by 1 / (2 + e^(i pi/3)), which shrinks it by the square root
of 7 and turns it by about 19 degrees. So a cell's centre belongs to exactly one cell of the coarser lattice, with the six
around it, and parents are exact in whole numbers. A cell is named by its resolution and two whole numbers, its axial
coordinates. All cells of a resolution have one area. What differs from an index on an icosahedron: cells are stretched
towards the poles, don't join over the 180th meridian, and carry other names. As there, a point's coarser cell
isn't always the parent of its finer one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distance of neighbouring centres at resolution 0, and the finest resolution.
SPACING, FINEST = 0.25, 15
#: Neighbours of a cell, in axial coordinates.
AROUND = ((1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1))


def _scale(res: int) -> complex:
    """From the plane to lattice units of a resolution."""
    return complex(2.5, math.sqrt(3) / 2) ** res / SPACING


def _times(x: Column, y: Column, z: complex) -> tuple[Column, Column]:
    return x * z.real - y * z.imag, x * z.imag + y * z.real


def cell(lon: Column, lat: Column, res: int) -> Column:
    """Degrees to a struct (res, q, r); null outside the world and for nulls. A point on an edge goes to one of its cells."""
    if not 0 <= res <= FINEST:
        raise ValueError(f"no resolution {res}")
    x, y = _times(F.radians(lon), F.sin(F.radians(lat)), _scale(res))
    r = y * (2 / math.sqrt(3))
    q = x - y * (1 / math.sqrt(3))
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(-q - r + 0.5)
    eq, er, es = F.abs(rq - q), F.abs(rr - r), F.abs(rs + q + r)
    # of three rounded coordinates that must add up to 0 the one that moved most follows from the others
    q_out = F.when((eq > er) & (eq > es), -rr - rs).otherwise(rq)
    r_out = F.when((eq > er) & (eq > es), rr).when(er > es, -rq - rs).otherwise(rr)
    inside = lon.between(-180, 180) & lat.between(-90, 90)
    return F.when(inside, F.struct(F.lit(res).alias("res"), q_out.cast("long").alias("q"), r_out.cast("long").alias("r")))


def parent(c: Column) -> Column:
    """The cell one step coarser that holds the centre; null at resolution 0."""
    near = lambda x: F.floor((2 * x + 7) / 14).cast("long")
    up = F.struct((c["res"] - 1).alias("res"), near(3 * c["q"] + c["r"]).alias("q"), near(2 * c["r"] - c["q"]).alias("r"))
    return F.when(c["res"] > 0, up)


def children(c: Column) -> Column:
    """The seven cells one step finer whose centres the cell holds; the first has the same centre."""
    q, r = 2 * c["q"] - c["r"], c["q"] + 3 * c["r"]
    return F.array(*[F.struct((c["res"] + 1).alias("res"), (q + a).alias("q"), (r + b).alias("r")) for a, b in ((0, 0), *AROUND)])


def _place(c: Column, res: int, dx: float = 0.0, dy: float = 0.0) -> Column:
    x, y = _times(c["q"] + c["r"] * 0.5 + dx, c["r"] * (math.sqrt(3) / 2) + dy, 1 / _scale(res))
    # beyond the poles a cell ends at them
    return F.struct(F.degrees(x).alias("lon"), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y)))).alias("lat"))


def centre(c: Column, res: int) -> Column:
    """A struct (lon, lat) of a cell whose resolution is known."""
    return _place(c, res)


def boundary(c: Column, res: int) -> Column:
    """The six corners, counter-clockwise."""
    corner = lambda k: (math.cos(math.pi / 6 + k * math.pi / 3) / math.sqrt(3), math.sin(math.pi / 6 + k * math.pi / 3) / math.sqrt(3))
    return F.array(*[_place(c, res, *corner(k)) for k in range(6)])


def name(c: Column) -> Column:
    """res:q:r."""
    return F.concat_ws(":", c["res"].cast("string"), c["q"].cast("string"), c["r"].cast("string"))
