"""The gazetteer: eight tables of one address base, aggregated at falling detail."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..plans.steps import CL, KEYS, NCL, NL, TABLES, L

#: Key columns of each table besides estado and municipio.
TABLE_KEYS = {
    NCL: KEYS["n01"],
    NL: KEYS["n03"],
    CL: KEYS["l01"],
    L: KEYS["l03"],
    "municipio_cep_localidade": KEYS["c01"],
    "municipio_cep": KEYS["c02"],
    "municipio_localidade": KEYS["b01"],
    "municipio": (),
}
VALUES = "endereco_completo string, lat double, lon double, desvio_metros int, n_casos int, cod_setor string"
#: Bytes of the places of an input that are broadcast, at most.
MAX_BROADCAST = 16 << 20


def schema_of(name: str) -> str:
    """DDL of a table."""
    keys = ", ".join(f"{k} {'int' if k == 'numero' else 'string'}" for k in ("estado", "municipio", *TABLE_KEYS[name]))
    return f"{keys}, {VALUES}"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file of the cache; a damaged one says how to get it anew."""
    try:
        return spark.read.parquet(path)
    except (AnalysisException, Py4JJavaError) as e:  # the latter for a footer that can't be read
        raise RuntimeError(f"{path} can't be read; delete it and fetch the release again") from e


class Gazetteer:
    """Tables by name, each read once; ``scoped`` limits them to the places of an input."""

    def __init__(self, tables: dict[str, DataFrame]) -> None:
        unknown = set(tables) - set(TABLES)
        if unknown:
            raise ValueError(f"unknown tables: {', '.join(sorted(unknown))}")
        self.tables = tables

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Gazetteer:
        return cls({name: read_table(spark, f"{folder}/{name}.parquet") for name in TABLES})

    def __call__(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"the gazetteer has no table {name}")
        return self.tables[name]

    def scoped(self, inputs: DataFrame) -> Gazetteer:
        places = inputs.select("estado", "municipio").dropna().distinct().checkpoint()
        size = places.agg(F.sum(F.octet_length("estado") + F.octet_length("municipio") + 32)).first()[0] or 0
        few = size <= MAX_BROADCAST
        return Gazetteer({n: scope(t, F.broadcast(places) if few else places) for n, t in self.tables.items()})

    def register(self, spark: SparkSession) -> None:
        """A temporary view for each table."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)

    def write(self, folder: str) -> None:
        """Each table as Parquet, laid out by state and city so that scans of places read little."""
        for name, df in self.tables.items():
            df.repartition("estado", "municipio").sortWithinPartitions("estado", "municipio").write.mode(
                "overwrite"
            ).option("compression", "zstd").parquet(f"{folder}/{name}.parquet")


def scope(table: DataFrame, places: DataFrame) -> DataFrame:
    """Rows in the (estado, municipio) pairs of places."""
    return table.join(places, ["estado", "municipio"], "left_semi")


def label(keys: tuple[str, ...]) -> Column:
    """Display form of an address: STREET, NUM - DISTRICT, CITY - UF, CEP, as far as the keys go."""
    street = F.col("logradouro") if "logradouro" in keys else None
    head = F.concat_ws(", ", street, F.col("numero").cast("string")) if "numero" in keys else street
    place = F.concat_ws(" - ", "municipio", "estado")
    middle = F.concat_ws(", ", F.col("localidade") if "localidade" in keys else F.lit(None).cast("string"), place)
    out = F.concat_ws(" - ", head, middle) if head is not None else middle
    return F.concat_ws(", ", out, F.col("cep")) if "cep" in keys else out


def coarser(table: DataFrame, name: str) -> DataFrame:
    """A table of fewer keys out of one of more: means weighted by records, tract only if it is one."""
    keys = ("estado", "municipio", *TABLE_KEYS[name])
    n = F.sum("n_casos")
    tract = F.when(F.min("cod_setor") == F.max("cod_setor"), F.min("cod_setor"))
    out = table.groupBy(*keys).agg(
        (F.sum(F.col("lat") * F.col("n_casos")) / n).alias("lat"),
        (F.sum(F.col("lon") * F.col("n_casos")) / n).alias("lon"),
        F.max("desvio_metros").cast("int").alias("desvio_metros"),
        n.cast("int").alias("n_casos"),
        F.when(F.count("cod_setor") == F.count("*"), tract).alias("cod_setor"),
    )
    return out.withColumn("endereco_completo", label(TABLE_KEYS[name]))


def trimmed(points: DataFrame, keys: list[str], share: float = 0.95) -> DataFrame:
    """Representative point of each group of records (lat, lon, cod_setor).

    Mean point, distance of each record to it, records beyond the given percentile of distance (by more than a
    micrometre, so that rounding decides nothing)
    left out, mean of the rest; ``desvio_metros`` is that percentile.
    """
    w = Window.partitionBy(*keys)
    d = points.withColumn("_la", F.avg("lat").over(w)).withColumn("_lo", F.avg("lon").over(w))
    d = d.withColumn("dist", haversine(F.col("lat"), F.col("lon"), F.col("_la"), F.col("_lo"))).drop("_la", "_lo")
    cut = d.groupBy(*keys).agg(F.percentile("dist", share).alias("_cut"))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    kept = d.alias("d").join(cut.alias("c"), same).where("dist <= _cut + 1e-6").select("d.*", "_cut")
    tract = F.when((F.min("cod_setor") == F.max("cod_setor")) & (F.count("cod_setor") == F.count("*")), F.min("cod_setor"))
    return kept.groupBy(*keys).agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.bround(F.first("_cut")).cast("int").alias("desvio_metros"),
        F.count("*").cast("int").alias("n_casos"), tract.alias("cod_setor"),
    )


def build(points: DataFrame) -> Gazetteer:
    """All tables from address records: the six roles, lat, lon and cod_setor."""
    tables = {}
    for name in TABLES:
        keys = ["estado", "municipio", *TABLE_KEYS[name]]
        rows = points
        for k in keys:
            rows = rows.where(F.col(k).isNotNull())
        tables[name] = trimmed(rows, keys).withColumn("endereco_completo", label(TABLE_KEYS[name]))
    return Gazetteer(tables)


def from_finest(finest: DataFrame) -> Gazetteer:
    """All tables by aggregating the finest one."""
    return Gazetteer({NCL: finest, **{n: coarser(finest, n) for n in TABLES if n != NCL}})


def views(spark: SparkSession, folder: str) -> Iterator[str]:
    """Register every Parquet file of a folder as a view of its name."""
    for path in sorted(Path(folder).glob("*.parquet")):
        read_table(spark, str(path)).createOrReplaceTempView(path.stem)
        yield path.stem
