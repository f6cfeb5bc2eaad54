"""Geo functions as Column expressions (all null if an argument is null), and joins by distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kilometres.
EARTH_RADIUS = 6371.0


def geo_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres (haversine)."""
    half = lambda a, b: F.sin((F.radians(b) - F.radians(a)) / 2)
    h = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2)
    return F.lit(2 * EARTH_RADIUS) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def geo_bbox_contains(min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column, lat: Column, lon: Column) -> Column:
    """1 if the point is in the box or on its edge, else 0; boxes do not cross the antimeridian."""
    return ((lat >= min_lat) & (lat <= max_lat) & (lon >= min_lon) & (lon <= max_lon)).cast("int")


def geo_within_radius(center_lat: Column, center_lon: Column, lat: Column, lon: Column, km: Column) -> Column:
    return (geo_distance(center_lat, center_lon, lat, lon) <= km).cast("int")


def geo_join(left: DataFrame, right: DataFrame, km: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Pairs at most ``km`` apart, with ``distance``; the right side's columns get the prefix ``r_``.

    Both sides get cells of bands of latitude and, within each, of longitude; left rows go to their own
    and all neighbouring cells, so the join is an equality on the cell and the distance is only worked
    out within cells. Near the poles and across the antimeridian longitudes wrap.
    """
    import math

    size = max(km / (EARTH_RADIUS * math.pi / 180), 1e-6) * 1.000001  # degrees of latitude
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    band = lambda x: F.floor((x + 90) / size)

    def width(b: Column) -> Column:
        """Cells of longitude in a band: each is as wide as ``km`` where the band is narrowest, or there is one."""
        edge = F.least(F.greatest(F.abs(b * size - 90), F.abs((b + 1) * size - 90)) + size, F.lit(90.0))
        return F.greatest(F.lit(1), F.floor(F.lit(360 / size) * F.cos(F.radians(edge)))).cast("long")

    cell = lambda x, b: F.pmod(F.floor((x + 180) / 360 * width(b)), width(b))
    r = right.filter(F.col(f"r_{lat}").isNotNull() & F.col(f"r_{lon}").isNotNull()).withColumn("_b", band(F.col(f"r_{lat}"))).withColumn("_c", cell(F.col(f"r_{lon}"), F.col("_b")))
    near = left.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("_b", F.explode(F.array(*[band(F.col(lat)) + i for i in (-1, 0, 1)])))
    near = near.withColumn("_w", width(F.col("_b")))
    near = near.withColumn("_c", F.explode(F.array_distinct(F.array(*[F.pmod(cell(F.col(lon), F.col("_b")) + i, F.col("_w")) for i in (-1, 0, 1)])))).drop("_w")
    # Not broadcast: the optimiser's estimate does not count the neighbouring cells, and a sort can spill.
    out = near.join(r.hint("merge"), ["_b", "_c"]).withColumn("distance", geo_distance(F.col(lat), F.col(lon), F.col(f"r_{lat}"), F.col(f"r_{lon}")))
    return out.filter(F.col("distance") <= km).drop("_b", "_c")


def box_join(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs of boxes (``min_x, max_x, min_y, max_y``) that overlap or touch; the right side's columns get the prefix ``r_``.

    Every box goes to the grid cells of side ``cell`` that it touches, and a pair is found in the lowest cell
    that both touch, so it comes once. Boxes much larger than a cell go to many cells: choose it by them.
    """
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    at = lambda c: F.floor(F.col(c) / cell).cast("long")

    def cells(df: DataFrame, p: str) -> DataFrame:
        df = df.withColumn("_cx", F.explode(F.sequence(at(f"{p}min_x"), at(f"{p}max_x"))))
        return df.withColumn("_cy", F.explode(F.sequence(at(f"{p}min_y"), at(f"{p}max_y"))))

    out = cells(left, "").join(cells(right, "r_").hint("merge"), ["_cx", "_cy"])
    out = out.filter((F.col("_cx") == F.greatest(at("min_x"), at("r_min_x"))) & (F.col("_cy") == F.greatest(at("min_y"), at("r_min_y"))))
    return out.filter("min_x <= r_max_x AND r_min_x <= max_x AND min_y <= r_max_y AND r_min_y <= max_y").drop("_cx", "_cy")
