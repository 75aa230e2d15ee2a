"""From candidates to the caller's table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.steps import PRECISION
from .matching import FOUND

NARROW = "lat lon precisao tipo_resultado desvio_metros endereco_encontrado".split()
COMPLETE = [*FOUND.values(), *"similaridade_logradouro contagem_cnefe empate cod_setor".split()]


def precision(code: Column) -> Column:
    """Precision class of a step code."""
    kind = F.substring(code, 2, 1)
    out = F.lit(None).cast("string")
    for letter, name in PRECISION.items():
        out = F.when(kind == letter, name).otherwise(out)
    return out


def with_row_ids(df: DataFrame, name: str = "tempid") -> DataFrame:
    """Dense numbers from 1 in the order of the input.

    Rows are numbered within partitions and the partitions' sizes are added up: one small
    aggregate, no sort and no shuffle of the rows.  The frame must read the same rows in the
    same order each time; checkpoint it otherwise.
    """
    raw = df.withColumn("_raw", F.monotonically_increasing_id())
    part = F.shiftright("_raw", 33)
    sizes = raw.groupBy(part.alias("p")).count().collect()  # one row for each partition
    starts, at = {}, 1
    for row in sorted(sizes, key=lambda r: r.p):
        starts[row.p] = at
        at += row["count"]
    if not starts:
        return raw.withColumn(name, F.col("_raw")).drop("_raw")
    table = df.sparkSession.createDataFrame(list(starts.items()), "_p bigint, _start bigint")
    inside = F.col("_raw").bitwiseAND((1 << 33) - 1)
    return (
        raw.withColumn("_p", part)
        .join(F.broadcast(table), "_p")
        .withColumn(name, F.col("_start") + inside)
        .drop("_raw", "_p", "_start")
    )


def complete_similarity(found: DataFrame) -> DataFrame:
    """Deterministic matches are similar to 1."""
    return found.withColumn("similaridade_logradouro", F.coalesce("similaridade_logradouro", F.lit(1.0)))


def merge(original: DataFrame, found: DataFrame, *, complete: bool, ties: bool, key: str = "tempid", on: str | None = None) -> DataFrame:
    """Each row of the input, in its order, with its results; nulls where nothing was found.

    ``on`` is the input's column that has the key of the row whose results are its own too (``repeats.marked``), if not
    its own key: results then needn't be spread over all rows before.
    """
    on = on or key
    if "empate" not in found.columns:
        found = found.withColumn("empate", F.lit(False))
    found = found.withColumn("precisao", precision(F.col("tipo_resultado")))
    if complete:
        found = complete_similarity(found)
    columns = [*NARROW, *(COMPLETE if complete else (["empate"] if ties else []))]
    inputs = [c for c in original.columns if c not in (key, on)]
    clash = set(inputs) & set(columns)
    if clash:
        raise ValueError(f"the input has columns named like results: {', '.join(sorted(clash))}")
    joined = original.join(found.select(F.col(key).alias(on), *columns), on, "left").orderBy(key)
    return joined.select(*inputs, *columns)
