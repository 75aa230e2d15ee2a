"""Postal-code lookup and nearest addresses."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import BRAZIL, EARTH_RADIUS, grid, haversine, utm
from ..functions.text import cep as standard_cep

IN_LIST = 1000
#: Metres by which a distance may differ when it is computed again; more than enough, as what is kept too many is compared exactly.
SAME = 1e-3
CEP_COLUMNS = "cep estado municipio logradouro localidade lon lat".split()


def by_cep(table: DataFrame, codes: Iterable[str] | DataFrame) -> DataFrame:
    """Streets of postal codes; a code that is not found is a row of nulls.

    Raises if none is found.  Up to ``IN_LIST`` codes become an IN list that the scan can use,
    more are joined.
    """
    spark = table.sparkSession
    if not isinstance(codes, DataFrame):
        codes = spark.createDataFrame([(c,) for c in codes], "cep string")
    wanted = codes.select(standard_cep(F.col(codes.columns[0])).alias("cep")).where("cep is not null").distinct()
    head = [r[0] for r in wanted.limit(IN_LIST + 1).collect()]
    rows = table.select(CEP_COLUMNS)
    if len(head) <= IN_LIST:
        rows = rows.where(F.col("cep").isin(head))
        wanted = spark.createDataFrame([(c,) for c in head], "cep string")
    else:
        rows = rows.join(wanted, "cep", "left_semi")
    if not head or rows.isEmpty():
        raise ValueError("none of the postal codes was found")
    return wanted.join(rows, "cep", "left").select(CEP_COLUMNS)


def check_points(points: DataFrame, lat: str = "lat", lon: str = "lon") -> None:
    """All points lie in the bounding box of Brazil."""
    west, south, east, north = BRAZIL
    r = points.agg(F.min(lon), F.min(lat), F.max(lon), F.max(lat)).first()
    if r[0] is None:
        raise ValueError("there are no points")
    if r[0] < west or r[1] < south or r[2] > east or r[3] > north:
        raise ValueError("a point lies outside Brazil")


def in_boxes(points: DataFrame, boxes: DataFrame, cell: float = 1.0) -> DataFrame:
    """Pairs of a point (lat, lon) and a box (xmin, ymin, xmax, ymax) that holds it.

    Boxes are spread over the cells of a grid (in degrees) that they touch, and meet the points of each cell:
    an equi-join, whose build side Spark chooses by its size.
    """

    def span(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))

    some = boxes.where("xmin <= xmax and ymin <= ymax")
    spread = some.withColumn("_x", span("xmin", "xmax")).withColumn("_y", span("ymin", "ymax"))
    here = points.withColumn("_x", F.floor(F.col("lon") / cell)).withColumn("_y", F.floor(F.col("lat") / cell))
    inside = F.col("lon").between(F.col("xmin"), F.col("xmax")) & F.col("lat").between(F.col("ymin"), F.col("ymax"))
    return here.join(spread, ["_x", "_y"]).where(inside).drop("_x", "_y")


def boxes_of(addresses: DataFrame, pad_metres: float = 0.0) -> DataFrame:
    """Bounding box of each municipality of a gazetteer table, padded."""
    pad = pad_metres / EARTH_RADIUS * 57.29577951308232
    wide = pad / F.cos(F.radians(F.greatest(F.abs(F.min("lat")), F.abs(F.max("lat")))))
    return addresses.groupBy("estado", "municipio").agg(
        (F.min("lon") - wide).alias("xmin"), (F.min("lat") - pad).alias("ymin"),
        (F.max("lon") + wide).alias("xmax"), (F.max("lat") + pad).alias("ymax"),
    )


def within(points: DataFrame, addresses: DataFrame, metres: float, *, planar: bool = False) -> DataFrame:
    """Pairs of a point (tempid, lat, lon) and an address (columns a_*) at most ``metres`` apart, with distancia.

    Both sides are put on a grid of cells at least ``metres`` wide; a point looks into its own cell
    and the eight around it, so this is an equi-join.  Distances are great-circle, or planar in UTM
    zone 23S if asked for.
    """
    top = 40.0  # latitude up to which cells are wide enough; Brazil ends before
    gx, gy = grid(F.col("lat"), F.col("lon"), metres, top)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = points.withColumn("_d", around).withColumn("_y", gx + F.col("_d.i")).withColumn("_x", gy + F.col("_d.j")).drop("_d")
    right = addresses.select([F.col(c).alias(f"a_{c}") for c in addresses.columns])
    hy, hx = grid(F.col("a_lat"), F.col("a_lon"), metres, top)
    right = right.withColumn("_y", hy).withColumn("_x", hx)
    return left.join(right, ["_y", "_x"]).withColumn("distancia", _distance(planar)).where(F.col("distancia") <= metres).drop("_x", "_y")


def _distance(planar: bool) -> Column:
    if not planar:
        return haversine(F.col("lat"), F.col("lon"), F.col("a_lat"), F.col("a_lon"))
    (e1, n1), (e2, n2) = utm(F.col("lat"), F.col("lon")), utm(F.col("a_lat"), F.col("a_lon"))
    return F.sqrt(F.pow(e1 - e2, 2) + F.pow(n1 - n2, 2))


def nearest(points: DataFrame, addresses: DataFrame, metres: float, *, planar: bool = False) -> DataFrame:
    """The nearest address of each point within ``metres``; points without one are left out.

    The distances come first: one number for each point, which is reduced by hashing before it moves, so that no task sorts
    or holds the pairs, however many addresses are near a point.  Then only the pairs at that distance are told apart.
    """
    first = within(points.select("tempid", "lat", "lon"), addresses.select("lat", "lon"), metres, planar=planar)
    least = first.groupBy("tempid").agg(F.min("distancia").alias("_least"))
    pairs = within(points.join(least, "tempid"), addresses, metres, planar=planar)
    pairs = pairs.where(F.col("distancia") <= F.col("_least") + SAME).drop("_least")
    rest = [c for c in pairs.columns if c != "tempid"]
    order = F.struct("distancia", F.col("a_endereco_completo").isNull(), "a_endereco_completo", "a_lat", "a_lon")
    best = pairs.groupBy("tempid").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("_best"))
    return best.select("tempid", *[F.col(f"_best.`{c}`").alias(c) for c in rest])
