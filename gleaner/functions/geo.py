"""Distances and space-filling-curve cells as Column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
# Longest side of the grid in cells is 2**MAX_BITS; two such numbers interleave into 2*MAX_BITS bits.
MAX_BITS = 24


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null when any coordinate is null."""
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.when(a > 1, 1.0).otherwise(F.sqrt(a)))  # least() would skip a null


def grid_x(lon: Column, bits: int) -> Column:
    """Column number of a longitude on a grid of 2**bits columns round the earth."""
    cell = F.floor((lon + 180.0) / 360.0 * float(1 << bits))
    return F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), cell)).cast("long")


def grid_y(lat: Column, bits: int) -> Column:
    """Row number of a latitude on a grid of 2**bits rows from pole to pole."""
    cell = F.floor((lat + 90.0) / 180.0 * float(1 << bits))
    return F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), cell)).cast("long")


def _spread_bits(v: Column) -> Column:
    """Puts a zero before each bit: the binary digits of `v` read as digits of base 4."""
    return F.conv(F.bin(v), 4, 10).cast("long")


def cell_code(lat: Column, lon: Column, bits: int) -> Column:
    """Morton (Z-order) code of the cell that holds a position; null when a coordinate is null."""
    x, y = _spread_bits(grid_x(lon, bits)), _spread_bits(grid_y(lat, bits))
    return x + y * 2


def meant_position(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """Position as meant: latitude and longitude delivered in each other's place are put right.

    `box` is (lowest latitude, highest latitude, lowest longitude, highest longitude) of the
    covered area; a position missing in part, NaN, or outside the box either way round is null.
    """
    la0, la1, lo0, lo1 = box
    straight = lat.between(la0, la1) & lon.between(lo0, lo1)
    swapped = lon.between(la0, la1) & lat.between(lo0, lo1)
    return (
        F.when(straight, lat).when(swapped, lon).cast("double"),
        F.when(straight, lon).when(swapped, lat).cast("double"),
    )
