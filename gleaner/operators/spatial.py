"""Points near points, and points in regions, by cell ranges on a space-filling curve.

Every position gets the Morton code of its grid cell. A disc or region is covered by the cells it
can touch, the sorted codes of these cells are merged into ranges, and ranges are cut at the
borders of coarse buckets (a bucket is an aligned run of codes). The join is then
`bucket = bucket AND code BETWEEN lo AND hi`, followed by the exact test.

* The points are never shuffled when the ranges are provably few (`max_broadcast_rows`, counted
  before the decision). Otherwise both sides shuffle on (bucket, salt): buckets holding more than
  `hot_rows` points are split over salts, and only the ranges of those buckets are repeated.
* Nulls and NaN in coordinates: the row finds nothing. Repeated rows: each is treated by itself,
  the result holds each pair of keys once. Empty tables give an empty result. Further columns on
  either side are ignored, whatever their names. Poles and the date line are covered: a disc that
  touches them is covered by whole rows of cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.geo import EARTH_RADIUS_KM, MAX_BITS, cell_code, haversine_km
from gleaner.session import at_most, cut, fits_broadcast

_KM_PER_DEGREE = math.pi * EARTH_RADIUS_KM / 180.0


def bits_for_radius(radius_km: float, cells_across: int = 12) -> int:
    """Grid resolution at which a disc of this radius is about `cells_across` rows high."""
    if radius_km <= 0:
        return MAX_BITS
    bits = math.log2(180.0 * _KM_PER_DEGREE * cells_across / (2 * radius_km))
    return max(1, min(MAX_BITS, int(bits)))


def _interleave(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    def spread(v: np.ndarray) -> np.ndarray:
        v = v.astype(np.uint64)
        for s, m in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = (v | (v << np.uint64(s))) & np.uint64(m)
        return v

    return (spread(x) | (spread(y) << np.uint64(1))).astype(np.int64)


def cover_box(south: float, north: float, west: float, east: float, bits: int, bucket_bits: int, keep=None) -> list[tuple[int, int, int]]:
    """(bucket, lo, hi) ranges of the cells that a latitude/longitude box touches.

    `keep(lat0, lat1, lon0, lon1)` may drop cells of the box that the shape can't touch.
    """
    n = 1 << bits
    y0, y1 = (int(np.clip(math.floor((v + 90.0) / 180.0 * n), 0, n - 1)) for v in (south, north))
    spans = [(west, east)]
    if east - west >= 360.0:
        spans = [(-180.0, 180.0)]
    elif west < -180.0:
        spans = [(west + 360.0, 180.0), (-180.0, east)]
    elif east > 180.0:
        spans = [(west, 180.0), (-180.0, east - 360.0)]
    codes = []
    for w, e in spans:
        x0, x1 = (int(np.clip(math.floor((v + 180.0) / 360.0 * n), 0, n - 1)) for v in (w, e))
        gx, gy = np.meshgrid(np.arange(x0, x1 + 1), np.arange(y0, y1 + 1))
        gx, gy = gx.ravel(), gy.ravel()
        if keep is not None:
            ok = keep(gy / n * 180.0 - 90.0, (gy + 1) / n * 180.0 - 90.0, gx / n * 360.0 - 180.0, (gx + 1) / n * 360.0 - 180.0)
            gx, gy = gx[ok], gy[ok]
        codes.append(_interleave(gx, gy))
    code = np.unique(np.concatenate(codes))
    if not len(code):
        return []
    bucket = code >> bucket_bits
    first = np.flatnonzero(np.r_[True, (np.diff(code) > 1) | (np.diff(bucket) != 0)])
    last = np.r_[first[1:] - 1, len(code) - 1]
    return list(zip(bucket[first].tolist(), code[first].tolist(), code[last].tolist()))


def cover_disc(lat: float, lon: float, radius_km: float, bits: int, bucket_bits: int) -> list[tuple[int, int, int]]:
    """(bucket, lo, hi) ranges of the cells that a disc can touch (a small margin included)."""
    r = radius_km * (1 + 1e-9) + 1e-6
    dlat = r / _KM_PER_DEGREE
    south, north = lat - dlat, lat + dlat
    if south <= -90.0 or north >= 90.0:
        return cover_box(max(south, -90.0), min(north, 90.0), -180.0, 180.0, bits, bucket_bits)
    dlon = math.degrees(math.asin(min(1.0, math.sin(r / EARTH_RADIUS_KM) / math.cos(math.radians(lat)))))

    def keep(la0, la1, lo0, lo1):
        # nearest latitude of the cell, and its nearest meridian: a lower bound of the distance
        near_lat = np.clip(lat, la0, la1)
        mid = (lo0 + lo1) / 2
        off = np.maximum(0.0, np.abs((mid - lon + 180.0) % 360.0 - 180.0) - (lo1 - lo0) / 2)
        top = np.radians(np.maximum(np.abs(la0), np.abs(la1)))
        a = np.sin(np.radians(near_lat - lat) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(top) * np.sin(np.radians(off) / 2) ** 2
        return 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(a))) <= r

    return cover_box(south, north, lon - dlon, lon + dlon, bits, bucket_bits, keep)


def cover_ring(ring: list[tuple[float, float]], bits: int, bucket_bits: int) -> Iterator[tuple[int, int, int, bool]]:
    """(bucket, lo, hi, inner) ranges of the cells that a ring of (lat, lon) covers.

    Cells are quartered from the whole earth down to `bits`, only where the ring's line passes: what lies
    inside of it is one range of any size, marked `inner`, in which every point is in the region. The work
    grows with the length of the line, not with the area; each level is done at once.
    """
    lat, lon = (np.array([p[k] for p in ring] + [ring[0][k]], float) for k in (0, 1))
    la0, la1, lo0, lo1 = lat[:-1], lat[1:], lon[:-1], lon[1:]
    margin = 1e-9

    def inside(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(y), bool)
        for at in range(0, len(y), 4096):
            part = slice(at, at + 4096)
            for a, b, c, d in zip(la0, la1, lo0, lo1):
                if a != b:
                    crosses = (a > y[part]) != (b > y[part])
                    out[part] ^= crosses & (x[part] < c + (y[part] - a) / (b - a) * (d - c))
        return out

    found: list[tuple[int, int, bool]] = []

    def emit(x: np.ndarray, y: np.ndarray, level: int, inner: bool) -> None:
        free = 2 * (bits - level)
        low = _interleave(x, y) << free
        found.extend(zip(low.tolist(), (low + (1 << free) - 1).tolist(), [inner] * len(low)))

    cells = np.zeros((1, 2), np.int64)  # x, y
    at, edges = np.zeros(len(ring), np.int64), np.arange(len(ring))  # pairs of a cell (its row) and an edge
    for level in range(bits + 1):
        height, width = 180.0 / (1 << level), 360.0 / (1 << level)
        west, south = cells[:, 0] * width - 180.0, cells[:, 1] * height - 90.0
        w, e, s_, n = west[at] - margin, west[at] + width + margin, south[at] - margin, south[at] + height + margin
        a, b, c, d = la0[edges], la1[edges], lo0[edges], lo1[edges]
        near = (np.minimum(a, b) <= n) & (np.maximum(a, b) >= s_) & (np.minimum(c, d) <= e) & (np.maximum(c, d) >= w)
        # all corners on one side of the edge's line: it passes by
        sides = [(b - a) * (x - c) - (d - c) * (y - a) for y in (s_, n) for x in (w, e)]
        passes = np.all([v > 0 for v in sides], axis=0) | np.all([v < 0 for v in sides], axis=0)
        at, edges = at[near & ~passes], edges[near & ~passes]
        crossed = np.zeros(len(cells), bool)
        crossed[at] = True
        free = cells[~crossed]
        full = free[inside(south[~crossed] + height / 2, west[~crossed] + width / 2)]
        emit(full[:, 0], full[:, 1], level, True)
        if level == bits:
            emit(cells[crossed, 0], cells[crossed, 1], level, False)
            break
        row = np.cumsum(crossed) - 1
        cells = np.concatenate([2 * cells[crossed] + (dx, dy) for dx in (0, 1) for dy in (0, 1)])
        at, edges = np.concatenate([row[at] + k * crossed.sum() for k in range(4)]), np.tile(edges, 4)
    found.sort()
    merged: list[list] = []
    for lo, hi, inner in found:
        if merged and merged[-1][2] == inner and merged[-1][1] + 1 == lo:
            merged[-1][1] = hi
        else:
            merged.append([lo, hi, inner])
    for lo, hi, inner in merged:
        for bucket in range(lo >> bucket_bits, (hi >> bucket_bits) + 1):
            first = bucket << bucket_bits
            yield bucket, max(lo, first), min(hi, first + (1 << bucket_bits) - 1), inner


def _ranges(centers: DataFrame, radius_km: float, bits: int, bucket_bits: int) -> DataFrame:
    """Centres (c_key, c_lat, c_lon) → one row per range of their covers."""
    key_type = centers.schema["c_key"].dataType.simpleString()

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (key, la, lo, b, a, z)
                for key, la, lo in zip(pdf["c_key"], pdf["c_lat"], pdf["c_lon"])
                for b, a, z in cover_disc(la, lo, radius_km, bits, bucket_bits)
            ]
            yield pd.DataFrame(rows, columns=["c_key", "c_lat", "c_lon", "bucket", "lo", "hi"])

    return centers.mapInPandas(cover, f"c_key {key_type}, c_lat double, c_lon double, bucket long, lo long, hi long")


def _clean(df: DataFrame, key: str, lat: str, lon: str, names: tuple[str, str, str]) -> DataFrame:
    k, la, lo = names
    out = df.select(F.col(key).alias(k), F.col(lat).cast("double").alias(la), F.col(lon).cast("double").alias(lo))
    return out.where(F.col(la).between(-90.0, 90.0) & F.col(lo).between(-180.0, 180.0))  # NaN sorts above 180


def range_join(points: DataFrame, ranges: DataFrame, refine: Column, *, max_broadcast_rows: int, hot_rows: int) -> DataFrame:
    """`points(bucket, code, …)` with `ranges(bucket, lo, hi, …)`: equal bucket, code in range, `refine`."""
    inside = F.col("code").between(F.col("lo"), F.col("hi")) & refine
    if at_most(ranges, max_broadcast_rows):
        return points.join(F.broadcast(ranges), "bucket").where(inside)
    counts = points.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # buckets over hot_rows points: there are at most (all points / hot_rows) of them
    hot = counts.where(F.col("n") > hot_rows).select("bucket", F.ceil(F.col("n") / hot_rows).cast("int").alias("salts"))
    left = points.join(hot, "bucket", "left").withColumn(
        "salt", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("p_key", "code"), F.col("salts")).cast("int"))
    ).drop("salts")
    right = (
        ranges.join(hot, "bucket", "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)))
        .drop("salts")
    )
    return left.join(right, ["bucket", "salt"]).where(inside)


def points_within(
    points: DataFrame,
    centers: DataFrame,
    radius_km: float,
    *,
    point: tuple[str, str, str] = ("id", "lat", "lon"),
    center: tuple[str, str, str] = ("id", "lat", "lon"),
    out: tuple[str, str] = ("point_id", "center_id"),
    distinct: bool = True,
    max_broadcast_rows: int = 200_000,
    hot_rows: int = 500_000,
) -> DataFrame:
    """All (point, centre) pairs at most `radius_km` apart (great circle, limit included).

    `point` and `center` name the key, latitude and longitude columns. With `distinct` each pair of
    keys appears once, however many rows share a key. The pairs of a table with itself come from
    passing it on both sides.
    """
    bits = bits_for_radius(radius_km)
    bucket_bits = min(6, 2 * bits)
    p = _clean(points, *point, ("p_key", "p_lat", "p_lon"))
    c = _clean(centers, *center, ("c_key", "c_lat", "c_lon"))
    p = p.withColumn("code", cell_code(F.col("p_lat"), F.col("p_lon"), bits)).withColumn("bucket", F.shiftright("code", bucket_bits))
    near = haversine_km(F.col("p_lat"), F.col("p_lon"), F.col("c_lat"), F.col("c_lon")) <= radius_km
    pairs = range_join(p, _ranges(c, radius_km, bits, bucket_bits), near, max_broadcast_rows=max_broadcast_rows, hot_rows=hot_rows)
    pairs = pairs.select(F.col("p_key").alias(out[0]), F.col("c_key").alias(out[1]))
    return pairs.distinct() if distinct else pairs


def _in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd rule over the edges of a closed ring of struct<lat, lon>; an edge point may be either."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    crossings = F.aggregate(
        F.zip_with(ring, following, lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        F.lit(0),
        lambda n, e: n
        + F.when(
            ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat))
            & (lon < (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) / (e["b"]["lat"] - e["a"]["lat"]) + e["a"]["lon"]),
            F.lit(1),
        ).otherwise(F.lit(0)),
    )
    return F.pmod(crossings, F.lit(2)) == 1


def points_in_regions(
    points: DataFrame,
    regions: DataFrame,
    *,
    point: tuple[str, str, str] = ("id", "lat", "lon"),
    region: tuple[str, str] = ("region_id", "ring"),
    out: tuple[str, str] = ("point_id", "region_id"),
    bits: int = 14,
    max_broadcast_rows: int = 200_000,
    hot_rows: int = 500_000,
) -> DataFrame:
    """(point, region) for every region whose ring (array<struct<lat,lon>>) contains the point.

    Points in cells that lie inside a ring need no further test; those in cells on its line are tested exactly.
    Rings of fewer than three points, null rings, rings with null points and regions crossing the date
    line contain nothing.
    """
    bucket_bits = min(8, 2 * bits)
    p = _clean(points, *point, ("p_key", "p_lat", "p_lon"))
    p = p.withColumn("code", cell_code(F.col("p_lat"), F.col("p_lon"), bits)).withColumn("bucket", F.shiftright("code", bucket_bits))
    closed = F.transform(F.col(region[1]), lambda q: F.struct(q["lat"].cast("double").alias("lat"), q["lon"].cast("double").alias("lon")))
    r = regions.select(F.col(region[0]).alias("c_key"), closed.alias("ring")).where(F.size("ring") >= 3)
    r = r.where(~F.exists("ring", lambda q: q.isNull() | q["lat"].isNull() | q["lon"].isNull()))
    key_type = r.schema["c_key"].dataType.simpleString()

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        columns = ["c_key", "bucket", "lo", "hi", "inner"]
        for pdf in batches:
            for k, ring in zip(pdf["c_key"], pdf["ring"]):
                for found in cover_ring([(q["lat"], q["lon"]) for q in ring], bits, bucket_bits):
                    rows.append((k, *found))
                    if len(rows) == 100_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        yield pd.DataFrame(rows, columns=columns)

    ranges = r.mapInPandas(cover, f"c_key {key_type}, bucket long, lo long, hi long, inner boolean")
    pairs = range_join(p, ranges, F.lit(True), max_broadcast_rows=max_broadcast_rows, hot_rows=hot_rows)
    tested = _in_ring(F.col("p_lat"), F.col("p_lon"), F.col("ring"))
    if fits_broadcast(r):
        hits = pairs.join(F.broadcast(r), "c_key").where(F.col("inner") | tested)
    else:  # only points on a line meet its ring
        pairs = cut(pairs.select("p_key", "p_lat", "p_lon", "c_key", "inner"))
        hits = pairs.where("inner").select("p_key", "c_key").unionByName(pairs.where("NOT inner").join(r, "c_key").where(tested).select("p_key", "c_key"))
    return hits.select(F.col("p_key").alias(out[0]), F.col("c_key").alias(out[1])).distinct()
