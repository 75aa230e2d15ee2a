"""A gazetteer and an input made of the driver's tables, which hold no addresses.

The texts are SQL that Spark and DuckDB read alike: tables are views in DuckDB and temporary
views here.  Coordinates have an odd last digit, so that means don't fall between two rounded values.  Regions play states, nations cities, part names streets, sizes house numbers,
brands postal codes and types districts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ambiguity import is_ambiguous
from ..sources.gazetteer import Gazetteer, from_finest
from .steps import CL, NCL, NL

_TABLES = "region nation customer supplier part orders lineitem documents".split()
#: Tables that grow and pack so well that Spark would take a few million rows for a small side and gather them on the driver.
_HASHED = "customer part".split()

FINEST = """
SELECT r_name AS estado, n_name AS municipio, upper(p_name) AS logradouro, p_size AS numero, p_brand AS cep,
  p_type AS localidade,
  round(avg(cast(-30.00000013 as double) + (s_suppkey % 100) * cast(0.2 as double) + p_size * cast(0.001 as double)), 9) AS lat,
  round(avg(cast(-70.00000013 as double) + (s_suppkey % 37) * cast(0.3 as double) + p_size * cast(0.001 as double)), 9) AS lon,
  cast(max(l_linenumber) * 5 + p_size % 7 AS int) AS desvio_metros,
  cast(count(*) AS int) AS n_casos,
  CASE WHEN min(s_suppkey) = max(s_suppkey) THEN cast(min(s_suppkey) AS varchar(20)) END AS cod_setor,
  upper(p_name) || ', ' || cast(p_size AS varchar(20)) || ' - ' || p_type || ', ' || n_name || ' - ' || r_name || ', '
    || p_brand AS endereco_completo
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name, n_name, upper(p_name), p_size, p_brand, p_type
"""

INPUTS = """
SELECT o_orderkey AS tempid, r_name AS estado, n_name AS municipio,
  CASE WHEN o_orderkey % 4 = 0 THEN replace(upper(p_name), 'I', 'Y') ELSE upper(p_name) END AS logradouro,
  CASE WHEN o_orderkey % 5 = 0 THEN cast(NULL AS int) WHEN o_orderkey % 3 = 0 THEN p_size + 60 ELSE p_size END AS numero,
  CASE WHEN o_orderkey % 7 <> 0 THEN p_brand END AS cep,
  CASE WHEN o_orderkey % 6 <> 0 THEN p_type END AS localidade
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)
"""


def _label(keys: tuple[str, ...]) -> str:
    street = "logradouro || ', ' || cast(numero AS varchar(20)) || ' - '" if "numero" in keys else "logradouro || ' - '"
    out = [street] if "logradouro" in keys else []
    if "localidade" in keys:
        out.append("localidade || ', '")
    out.append("municipio || ' - ' || estado")
    if "cep" in keys:
        out.append("', ' || cep")
    return " || ".join(out)


def coarser_sql(keys: tuple[str, ...], source: str = "ncl") -> str:
    """A coarser table, for the oracle."""
    cols = ", ".join(("estado", "municipio", *keys))
    return f"""SELECT {cols}, sum(lat * n_casos) / sum(n_casos) AS lat, sum(lon * n_casos) / sum(n_casos) AS lon,
  cast(max(desvio_metros) AS int) AS desvio_metros, cast(sum(n_casos) AS int) AS n_casos,
  CASE WHEN count(cod_setor) = count(*) AND min(cod_setor) = max(cod_setor) THEN min(cod_setor) END AS cod_setor,
  {_label(keys)} AS endereco_completo
FROM {source} GROUP BY {cols}"""


def register(spark: SparkSession, sf_dir: str) -> None:
    for t in _TABLES:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        (df.hint("shuffle_hash") if t in _HASHED else df).createOrReplaceTempView(t)


def finest(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(FINEST)


_BUILT: dict[tuple[str, ...], DataFrame] = {}


class _Built(Gazetteer):
    """Tables of a folder, each checkpointed once in a session, when it is first asked for.

    A table that is kept in memory instead has as many partitions as shuffles have, however few its rows, and steps that
    run together wait for each other while it is filled.  The finer tables are the smaller side of joins with the inputs,
    which then needn't be sorted.
    """

    def __init__(self, tables: dict[str, DataFrame], key: tuple[str, ...]) -> None:
        super().__init__(tables)
        self.key = key

    def __call__(self, name: str) -> DataFrame:
        key = (*self.key, name)
        if key not in _BUILT:
            _BUILT[key] = super().__call__(name).checkpoint()
        return _BUILT[key].hint("shuffle_hash") if name in (NCL, NL, CL) else _BUILT[key]


def gazetteer(spark: SparkSession, sf_dir: str) -> Gazetteer:
    """The finest table, built and checkpointed once in a session, and the others out of it."""
    key = spark.sparkContext.applicationId, sf_dir
    if (*key, NCL) not in _BUILT:
        _BUILT[*key, NCL] = finest(spark, sf_dir).checkpoint()
    return _Built(from_finest(_BUILT[*key, NCL]).tables, key)


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(INPUTS).withColumn("log_causa_confusao", is_ambiguous(F.col("logradouro")))
