"""What callers use: addresses to coordinates, points to addresses, postal codes to streets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fields import ROLES, AddressFields, check_flag, check_h3
from .functions import text
from .functions.ambiguity import is_ambiguous
from .functions.geo import h3_cell, point_wkb, point_wkt
from .operators import lookup, results, ties
from .plans import cascade
from .plans.steps import CL, NCL
from .sources import checkpoints
from .sources.gazetteer import Gazetteer, scope

SRID = 4674
STANDARD = {
    "logradouro": text.street, "numero": text.number, "cep": text.cep, "localidade": text.district,
    "municipio": text.city, "estado": text.state,
}


def standardise(df: DataFrame, fields: AddressFields | dict[str, str], *, keep: Iterable[str] = ()) -> DataFrame:
    """The mapped roles as columns of their names, standardised, and the columns to keep."""
    mapping = AddressFields.of(fields).mapping()
    return df.select(*keep, *[STANDARD[r](F.col(c)).alias(r) for r, c in mapping.items()])


def prepared(df: DataFrame, fields: AddressFields | dict[str, str], *, standard: bool = True) -> DataFrame:
    """Standardised roles of rows that have ``tempid``, with the flag of ambiguous streets."""
    mapping = AddressFields.of(fields).mapping()
    if standard:
        x = standardise(df, fields, keep=["tempid"])
    else:
        x = df.select("tempid", *[F.col(c).alias(r) for r, c in mapping.items()])
    street = F.col("logradouro") if "logradouro" in mapping else F.lit(None).cast("string")
    return x.withColumn("log_causa_confusao", is_ambiguous(street))


class Geocoder:
    """Queries over one gazetteer."""

    def __init__(self, spark: SparkSession, gazetteer: Gazetteer) -> None:
        self.spark, self.gazetteer = spark, gazetteer
        checkpoints.ensure(spark)

    def geocode(
        self,
        df: DataFrame,
        fields: AddressFields | dict[str, str],
        *,
        complete: bool = False,
        resolve_ties: bool = True,
        keep_largest: bool = False,
        standard: bool = True,
        h3: int | list[int] | None = None,
        geometry: bool | str = False,
    ) -> DataFrame:
        """Coordinates of addresses: the input's columns, in its order, and the results.

        ``complete`` adds the matched parts; without ``resolve_ties`` a row has all its candidates
        and ``empate``; ``standard=False`` is for inputs that are standardised already.  ``geometry`` adds the
        point as well-known text, or as well-known binary if it is "wkb".
        """
        for name, value in (("complete", complete), ("resolve_ties", resolve_ties), ("standard", standard)):
            check_flag(name, value)
        cells = check_h3(h3)
        fields = AddressFields.of(fields)
        fields.check(df)
        rows = results.with_row_ids(df.checkpoint()).checkpoint()
        x = prepared(rows, fields, standard=standard).checkpoint()
        found = cascade.staged(x, self.gazetteer.scoped(x))
        found = ties.resolve(found, keep_largest=keep_largest) if resolve_ties else ties.flag(found)
        out = results.merge(rows, found, complete=complete, ties=not resolve_ties)
        return self._extras(out, cells, geometry)

    def _extras(self, out: DataFrame, cells: list[int], geometry: bool | str) -> DataFrame:
        for res in cells:
            out = out.withColumn(f"h3_{res:02d}", h3_cell(F.col("lat"), F.col("lon"), res))
        if geometry:
            point = point_wkb if geometry == "wkb" else point_wkt
            out = out.withColumn("geometry", point(F.col("lat"), F.col("lon"))).withMetadata("geometry", {"srid": SRID})
        return out

    def reverse(self, points: DataFrame, *, metres: float = 1000, planar: bool = False, srid: int = SRID) -> DataFrame:
        """The nearest address of each point (lat, lon) within ``metres``; points without one are left out.

        ``srid`` is the reference system that the points are in; it has to be that of the gazetteer.
        """
        if srid != SRID:
            raise ValueError(f"points must be in the reference system {SRID}, not {srid}")
        if isinstance(metres, bool) or not 500 <= metres <= 100_000:
            raise ValueError("the distance is from 500 to 100000 metres")
        missing = [c for c in ("lat", "lon") if c not in points.columns]
        if missing:
            raise ValueError(f"points need the columns {', '.join(missing)}")
        lookup.check_points(points)
        rows = results.with_row_ids(points.checkpoint()).checkpoint()
        addresses = self.gazetteer(NCL)
        boxes = lookup.boxes_of(addresses, metres).checkpoint()
        places = lookup.in_boxes(rows.select("lat", "lon"), boxes).select("estado", "municipio").distinct()
        near = lookup.nearest(rows, scope(addresses, places), metres, planar=planar).checkpoint()
        if near.isEmpty():
            raise ValueError("no point has an address within the distance")
        keep = [c for c in points.columns]
        parts = [F.col(f"a_{c}").alias(f"{c}_encontrado" if c != "localidade" else "localidade_encontrada") for c in ROLES]
        return near.orderBy("tempid").select(
            *keep, *parts, F.col("a_endereco_completo").alias("endereco_completo"), F.col("a_lat").alias("lat_endereco"),
            F.col("a_lon").alias("lon_endereco"), F.round("distancia", 3).alias("distancia_metros"),
        )

    def by_cep(self, codes, *, h3: int | list[int] | None = None, geometry: bool | str = False) -> DataFrame:
        """Streets of postal codes; codes that are not found are rows of nulls."""
        cells = check_h3(h3)
        return self._extras(lookup.by_cep(self.gazetteer(CL), codes), cells, geometry)
