"""Rows with several candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ambiguity import DATED, SPELLED_HIGH
from ..functions.geo import haversine

NEAR = 300.0
FAR = 1000.0


def _order(keep_largest: bool) -> list[Column]:
    tail = [F.col(c) for c in ("endereco_encontrado", "lat", "lon")]
    if keep_largest:
        return [F.col("contagem_cnefe"), F.desc("desvio_metros"), *tail]
    return [F.desc("contagem_cnefe"), F.col("desvio_metros"), *tail]


def tied(candidates: DataFrame) -> DataFrame:
    """(tempid) the rows with more than one candidate."""
    return candidates.groupBy("tempid").count().where("count > 1").select("tempid")


def count_ties(candidates: DataFrame) -> DataFrame:
    """(n_ties) how many rows have more than one candidate."""
    return tied(candidates).agg(F.count("*").alias("n_ties"))


def flag(candidates: DataFrame) -> DataFrame:
    """All candidates, with ``empate`` where a row has several."""
    return candidates.withColumn("empate", F.count("*").over(Window.partitionBy("tempid")) > 1)


def distances(candidates: DataFrame, *, keep_largest: bool = False) -> DataFrame:
    """With ``dist``, the metres from each candidate to the next of its row (null for the last)."""
    w = Window.partitionBy("tempid").orderBy(*_order(keep_largest))
    return (
        candidates.withColumn("_lat", F.lead("lat").over(w))
        .withColumn("_lon", F.lead("lon").over(w))
        .withColumn("dist", haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")))
        .drop("_lat", "_lon")
    )


def survivors(candidates: DataFrame, *, keep_largest: bool = False) -> DataFrame:
    """Without candidates that have another within 300 m; with the class of the row.

    ``classe``: sem_empate (one candidate is left), perdidos (some are lost: the one of most records
    among these stands for them) or salvos (their mean does).  A candidate is lost (``_lost``) if the row's are
    far apart or its street ambiguous, unless the matched street is named after a date.
    """
    w = Window.partitionBy("tempid")
    kept = distances(candidates, keep_largest=keep_largest).where(F.col("dist").isNull() | (F.col("dist") > NEAR))
    kept = kept.withColumn("empate", F.count("*").over(w) > 1).withColumn("max_dist", F.max("dist").over(w))
    dated = F.coalesce(F.col("logradouro_encontrado").rlike(DATED), F.lit(False))
    vague = F.col("log_causa_confusao") | F.coalesce(F.col("endereco_encontrado").rlike(SPELLED_HIGH), F.lit(False))
    kept = kept.withColumn("_lost", ((F.coalesce(F.col("max_dist"), F.lit(0.0)) > FAR) | vague) & ~dated)
    lost = F.max("_lost").over(w)
    return kept.withColumn(
        "classe", F.when(~F.col("empate"), "sem_empate").when(lost, "perdidos").otherwise("salvos")
    )


def resolve(candidates: DataFrame, *, keep_largest: bool = False) -> DataFrame:
    """One candidate for each row, with ``empate``.

    ``keep_largest`` keeps, of candidates within 300 m of each other, the one of most records;
    otherwise the last in the order of records stays.
    """
    lost = F.when(F.col("classe") == "perdidos", F.col("_lost")).otherwise(False)
    top = Window.partitionBy("tempid").orderBy(lost.desc(), *_order(False))
    whole = Window.partitionBy("tempid")
    rows = survivors(candidates, keep_largest=keep_largest)
    n = F.sum("contagem_cnefe").over(whole)

    def mean(c: str) -> Column:
        m = F.try_divide(F.sum(F.col(c) * F.col("contagem_cnefe")).over(whole), n)
        return F.when(F.col("classe") == "salvos", m).otherwise(F.col(c))

    rows = rows.withColumn("_k", F.row_number().over(top)).withColumn("_lat", mean("lat")).withColumn("_lon", mean("lon"))
    rows = rows.where("_k = 1").withColumn("lat", F.col("_lat")).withColumn("lon", F.col("_lon"))
    return rows.drop("_k", "_lat", "_lon", "_lost", "dist", "max_dist", "classe")
