"""Spatial operators: stations near capitals, weights, point in polygon, weather per county.

(C2, C9-C12, D1, D5, D6).  Distance joins use cells of the sphere as an
equi-join key (a point is compared only with the 3 x 3 neighbouring cells), then
the exact haversine filter; polygons are covered with grid cells, of which the inner ones need no edges
and the others only the edges that pass through them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast

EARTH_RADIUS_KM = 6371.0088  # mean Earth radius (IUGG)
UNKNOWN_COUNTY = 12  # county id used for rows whose county is unknown


def haversine_km(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_KM) -> F.Column:
    """Great-circle distance in km between two points given in degrees."""
    dphi = F.radians(lat2 - lat1)
    dlam = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlam / 2), 2)
    return 2 * radius * F.asin(F.sqrt(a))


class _Sphere:
    """Cells on the sphere: latitude rows of the search radius, each cut into its own number of longitude cells.

    Two points closer than ``max_km`` lie in the same or neighbouring rows, and in the same or neighbouring cells of either's
    row.  Cells wrap at +/-180 degrees; a row that comes near a pole is one cell.
    """

    def __init__(self, max_km: float, radius: float):
        self.angle = max_km / radius * (1 + 1e-9)
        self.height = math.degrees(self.angle)

    def row(self, lat: F.Column) -> F.Column:
        return F.floor(lat / self.height)

    def cells(self, row: F.Column) -> F.Column:
        """How many cells a row has: each is as wide as any pair with a point in the row can be apart."""
        far = F.greatest(F.abs(row - 1), F.abs(row + 2)) * self.height
        s = F.lit(math.sin(self.angle / 2)) / F.cos(F.radians(far))
        wide = F.degrees(2 * F.asin(F.least(s, F.lit(1.0))))
        return F.when((far >= 89.9) | (s >= 1), F.lit(1)).otherwise(F.greatest(F.floor(360 / wide), F.lit(1))).cast("long")

    def cell(self, lon: F.Column, cells: F.Column) -> F.Column:
        return F.least(F.floor(F.pmod(lon, F.lit(360.0)) * cells / 360), cells - 1)


def stations_within_km(capitals: DataFrame, stations: DataFrame, max_km: float = 100.0, swap_axes: bool = True,
                       radius: float = EARTH_RADIUS_KM) -> DataFrame:
    """Capital x station pairs closer than ``max_km`` (C9, theta join as an equi-join on cells of the sphere).

    ``capitals``: county, latitude, longitude.  ``stations``: latitude, longitude.
    ``swap_axes=True`` reproduces the reference, which hands (lon, lat) to a
    function expecting (lat, lon), so distances are those of swapped coordinates.
    Returns county, longitude float, latitude float, dist double.  Pairs across +/-180 degrees and the poles are found.
    """
    st = stations.select("latitude", "longitude").distinct()
    cap = capitals.select("county", F.col("latitude").alias("c_lat"), F.col("longitude").alias("c_lon"))
    # Coordinates as the distance function sees them.
    if swap_axes:
        s_phi, s_lam, c_phi, c_lam = F.col("longitude"), F.col("latitude"), F.col("c_lon"), F.col("c_lat")
    else:
        s_phi, s_lam, c_phi, c_lam = F.col("latitude"), F.col("longitude"), F.col("c_lat"), F.col("c_lon")
    grid = _Sphere(max_km, radius)
    st = st.withColumns({"_phi": s_phi, "_lam": s_lam}).withColumn("_ci", grid.row(F.col("_phi")))
    st = st.withColumn("_cj", grid.cell(F.col("_lam"), grid.cells(F.col("_ci"))))
    cap = cap.withColumns({"_cphi": c_phi, "_clam": c_lam})
    cap = cap.withColumn("_ci", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: grid.row(F.col("_cphi")) + d)))
    cap = cap.withColumn("_n", grid.cells(F.col("_ci")))
    around = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(grid.cell(F.col("_clam"), F.col("_n")) + d, F.col("_n")))
    cap = cap.withColumn("_cj", F.explode(F.array_distinct(around)))
    pairs = st.join(cap, on=["_ci", "_cj"], how="inner")
    d = haversine_km(F.col("_cphi"), F.col("_clam"), F.col("_phi"), F.col("_lam"), radius)
    return pairs.select(
        F.col("county").cast("long").alias("county"),
        F.col("longitude").cast("float").alias("longitude"),
        F.col("latitude").cast("float").alias("latitude"),
        d.alias("dist"),
    ).filter(F.col("dist") < max_km)


def distance_weights(near: DataFrame, weighting: str = "distance") -> DataFrame:
    """Weight of each station within its county.

    ``"distance"`` (reference parity, Q4): dist / sum(dist), so farther stations
    weigh more.  ``"inverse"``: (1/dist) / sum(1/dist).  The station table is
    bounded (counties x stations), so the per-county window is small.
    """
    w = Window.partitionBy("county")
    raw = F.col("dist") if weighting == "distance" else F.lit(1.0) / F.col("dist")
    return near.withColumn("weights", raw / F.sum(raw).over(w))


def unknown_county_weights(near: DataFrame, county: int = UNKNOWN_COUNTY) -> DataFrame:
    """All distinct stations for the unknown county, weight 1/N."""
    pts = near.select("longitude", "latitude").distinct()
    n = pts.count()
    return pts.select(
        F.lit(county).cast("long").alias("county"), "longitude", "latitude",
        F.lit(0.0).alias("dist"), F.lit(1.0 / n if n else None).cast("double").alias("weights"),
    )


def stations_with_weights(capitals: DataFrame, stations: DataFrame, max_km: float = 100.0, swap_axes: bool = True,
                          weighting: str = "distance", land_cells: DataFrame | None = None) -> DataFrame:
    """Full station table: near stations (optionally on land only), weights, plus the unknown county."""
    near = stations_within_km(capitals, stations, max_km, swap_axes)
    if land_cells is not None:
        near = land_semi_join(near, land_cells)
    weighted = distance_weights(near, weighting)
    return weighted.unionByName(unknown_county_weights(near))


def land_semi_join(points: DataFrame, land_cells: DataFrame, digits: int = 1) -> DataFrame:
    """Keep points whose rounded coordinates are a land cell.

    ``land_cells``: lat_cell, lon_cell at ``digits`` decimals (caller supplied).
    """
    keyed = points.withColumns({
        "lat_cell": F.round(F.col("latitude").cast("double"), digits),
        "lon_cell": F.round(F.col("longitude").cast("double"), digits),
    })
    cells = land_cells.select("lat_cell", "lon_cell").distinct()
    return keyed.join(bounded_broadcast(cells, 1_000_000), ["lat_cell", "lon_cell"], "left_semi").drop(
        "lat_cell", "lon_cell")


def _left(x: F.Column, y: F.Column) -> F.Column:
    """Whether (x, y) lies left of the edge x1, y1 - x2, y2 (on it: no); horizontal edges have no left."""
    d = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) - (F.col("y2") - F.col("y1")) * (x - F.col("x1"))
    return F.when(F.col("y2") > F.col("y1"), d > 0).otherwise(d < 0)


def _below(x: F.Column, y: F.Column) -> F.Column:
    """Whether (x, y) lies below the edge, decided by the same side as ``_left``."""
    rises = (F.col("y2") > F.col("y1")) == (F.col("x2") > F.col("x1"))
    return F.when(F.col("y1") == F.col("y2"), y < F.col("y1")).when(rises, ~_left(x, y)).otherwise(_left(x, y))


def polygon_cover(edges: DataFrame, cell: float, region: str = "county") -> tuple[DataFrame, DataFrame]:
    """Grid cells that cover each polygon: ``(cells, cell_edges)``.

    ``cells``: region, _cx, _cy, base (whether the cell's centre is inside) and _mixed (an edge passes through).  A cell
    without an edge is inside or outside as a whole.  ``cell_edges``: the edges that pass through each mixed cell.
    """
    size = F.lit(float(cell))
    e = edges.select(region, *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = e.withColumn("_cy", F.explode(F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))))

    def x_at(y: F.Column) -> F.Column:
        return (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")

    flat = F.col("y1") == F.col("y2")
    ends = [F.when(flat, F.col(x)).otherwise(x_at(F.greatest(low, F.least(high, y))))
            for x, y in (("x1", F.col("_cy") * size), ("x2", (F.col("_cy") + 1) * size))]
    slack = size * 1e-6  # a cell too many costs a comparison, a cell too few an answer
    first, last = F.floor((F.least(*ends) - slack) / size), F.floor((F.greatest(*ends) + slack) / size)
    e = e.withColumns({"_from": first.cast("long"), "_to": last.cast("long")})
    cell_edges = e.withColumn("_cx", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")
    middle = (F.col("_cy") + 0.5) * size
    crossing = e.filter((F.col("y1") > middle) != (F.col("y2") > middle)).withColumn("_cx", F.floor(x_at(middle) / size).cast("long"))
    crossing = crossing.withColumn("_own", _left((F.col("_cx") + 0.5) * size, middle).cast("long"))
    crossing = crossing.groupBy(region, "_cx", "_cy").agg(F.count("*").alias("_n"), F.sum("_own").alias("_own"))
    span = e.groupBy(region, "_cy").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    cells = span.select(region, "_cy", F.explode(F.sequence("_from", "_to")).alias("_cx")).join(crossing, [region, "_cx", "_cy"], "left")
    right = Window.partitionBy(region, "_cy").orderBy(F.col("_cx").desc()).rowsBetween(Window.unboundedPreceding, -1)
    crossed = F.coalesce(F.sum("_n").over(right), F.lit(0)) + F.coalesce("_own", F.lit(0))
    cells = cells.withColumn("base", crossed % 2 == 1).select(region, "_cx", "_cy", "base")
    mixed = cell_edges.select(region, "_cx", "_cy").distinct().withColumn("_mixed", F.lit(True))
    cells = cells.join(mixed, [region, "_cx", "_cy"], "left").withColumn("_mixed", F.coalesce("_mixed", F.lit(False)))
    return cells.filter(F.col("base") | F.col("_mixed")), cell_edges


def point_in_polygon(points: DataFrame, edges: DataFrame, band: float = 0.1, x: str = "longitude",
                     y: str = "latitude", region: str = "county") -> DataFrame:
    """Region containing each point by crossing parity, null if none (C11).

    ``edges``: region, x1, y1, x2, y2 (unordered edges of each polygon).  Points meet the grid cells (of size ``band``) that
    cover the polygons: a cell without edges answers at once, in another one the way from the cell's centre to the point, up or
    down and then across, is checked against the edges of that cell alone.  If several regions contain a point, the smallest id is kept and
    ``n_regions`` tells how many there were (the reference asserts at most one).
    """
    size = F.lit(float(band))
    px, py = F.col(x), F.col(y)
    pts = points.select(x, y).distinct()
    keyed = pts.withColumns({"_cx": F.floor(px / size).cast("long"), "_cy": F.floor(py / size).cast("long")})
    cells, cell_edges = polygon_cover(edges, band, region)
    met = keyed.join(cells, ["_cx", "_cy"])
    cx, cy = (F.col("_cx") + 0.5) * size, (F.col("_cy") + 0.5) * size
    point_left = px < (F.col("x2") - F.col("x1")) * (py - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    across = ((F.col("y1") > py) != (F.col("y2") > py)) & (_left(cx, py) != point_left)
    upright = ((F.col("x1") > cx) != (F.col("x2") > cx)) & (_below(cx, cy) != _below(cx, py))
    turns = F.sum(across.cast("long") + upright.cast("long"))
    decided = met.filter(~F.col("_mixed")).select(x, y, region)
    checked = met.filter("_mixed").join(cell_edges, [region, "_cx", "_cy"]).groupBy(x, y, region, "base").agg(turns.alias("_n"))
    checked = checked.filter((F.col("_n") + F.col("base").cast("long")) % 2 == 1).select(x, y, region)
    inside = decided.unionByName(checked).groupBy(x, y).agg(F.min(region).alias(region), F.count("*").alias("n_regions"))
    return pts.join(inside, on=[x, y], how="left").select(x, y, region, F.coalesce(F.col("n_regions"), F.lit(0)).alias("n_regions"))


def weather_to_county(weather: DataFrame, stations_w: DataFrame, cols: Sequence[str],
                      ts: str = "datetime", dealt: Sequence[str] = ()) -> DataFrame:
    """Weighted sum per (time, county) of weather columns: sum(x * w), no division by sum(w).

    Coordinates are cast to float on both sides before the equi-join (reference
    parity).  The station table is broadcast behind a row bound; the weather side,
    which grows with time, is never broadcast.  It is dealt by time before a station's row
    becomes one for each of its counties, so these copies are summed where they are made; rows that the caller has ``dealt``
    by other columns stay where they lie, and their groups have these columns, too.
    """
    st = stations_w.select(
        F.col("longitude").cast("float").alias("longitude"), F.col("latitude").cast("float").alias("latitude"),
        "county", "weights")
    wx = weather.select(
        *dealt, ts, *cols, F.col("longitude").cast("float").alias("longitude"),
        F.col("latitude").cast("float").alias("latitude"))
    if not dealt:
        wx = wx.repartition(ts)
    joined = wx.join(bounded_broadcast(st, 1_000_000), on=["longitude", "latitude"], how="inner")
    return joined.groupBy(*dealt, ts, "county").agg(*[F.sum(F.col(c) * F.col("weights")).alias(c) for c in cols])


def weighted_mean_by(df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str | None = None) -> DataFrame:
    """Weighted average with division by the weights of rows where the value is present."""
    present = F.col(value).isNotNull()
    return df.groupBy(*keys).agg(
        (F.sum(F.col(value) * F.col(weight)) / F.sum(F.when(present, F.col(weight)))).alias(out or value))


def naive_county_weather(weather: DataFrame, station_county: DataFrame, cols: Sequence[str],
                         ts: str = "datetime") -> DataFrame:
    """Plain mean per (county, time) after mapping each station to its county."""
    m = station_county.filter(F.col("county").isNotNull()).select("latitude", "longitude", "county")
    j = weather.join(bounded_broadcast(m, 1_000_000), on=["latitude", "longitude"], how="inner")
    return j.groupBy("county", ts).agg(*[F.avg(c).alias(c) for c in cols])
