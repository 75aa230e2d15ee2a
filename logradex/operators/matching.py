"""Joins of standardised addresses with gazetteer tables.

Inputs have ``tempid``, the role columns and ``log_causa_confusao``; all functions return
candidate rows of one layout (``CANDIDATE``), which can be united.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fields import ROLES
from ..functions.similarity import jaro_similarity, reachable
from ..plans.steps import MatchStep

FOUND = {r: r + ("_encontrada" if r == "localidade" else "_encontrado") for r in ROLES}
BLOCK = tuple("estado municipio cep localidade".split())
CANDIDATE = [
    "tempid", "ordem", "tipo_resultado", "lat", "lon", "endereco_encontrado", "desvio_metros", "log_causa_confusao",
    *FOUND.values(), "similaridade_logradouro", "contagem_cnefe", "cod_setor",
]


def have_keys(x: DataFrame, step: MatchStep, street: str = "logradouro") -> DataFrame:
    """Inputs in which every key of the step has a value."""
    tests = [F.col(street if k == "logradouro" else k).isNotNull() for k in step.keys]
    return x.where(reduce(Column.__and__, tests))


def _joined(x: DataFrame, table: DataFrame, step: MatchStep) -> DataFrame:
    """x (with the street to look for in ``logradouro``) and what it matches, as columns g_*."""
    g = table.select([F.col(c).alias(f"g_{c}") for c in table.columns])
    if step.interpolated:
        g = g.where(F.col("g_numero").isNotNull())
    return x.join(g, [F.col(k) == F.col(f"g_{k}") for k in step.join_keys], "inner")


def _found(columns: list[str], step: MatchStep) -> list[Column]:
    """The address parts that the step matched; others are null."""
    kinds = {"numero": "int"}
    out = []
    for role in ROLES:
        value = F.col(f"g_{role}") if role in step.keys and f"g_{role}" in columns else F.lit(None)
        out.append(value.cast(kinds.get(role, "string")).alias(FOUND[role]))
    return out


def _exact(j: DataFrame, step: MatchStep) -> DataFrame:
    return j.select(
        "tempid",
        F.lit(step.order).alias("ordem"),
        F.lit(step.code).alias("tipo_resultado"),
        F.col("g_lat").alias("lat"),
        F.col("g_lon").alias("lon"),
        F.col("g_endereco_completo").alias("endereco_encontrado"),
        F.col("g_desvio_metros").cast("int").alias("desvio_metros"),
        "log_causa_confusao",
        *_found(j.columns, step),
        F.col("similaridade").cast("double").alias("similaridade_logradouro"),
        F.col("g_n_casos").cast("int").alias("contagem_cnefe"),
        F.col("g_cod_setor").alias("cod_setor"),
    )


def approximate_label(label: Column, number: Column) -> Column:
    """The first ", 123 -" of a label with the number asked for instead."""
    new = F.concat(F.lit("$1, "), number.cast("string"), F.lit(" (aprox) -"))
    return F.regexp_replace(label, F.lit(r"^(.*?), \d+ -"), new)


def _interpolated(j: DataFrame, step: MatchStep) -> DataFrame:
    """Mean of the matched coordinates, weighted by the inverse distance between house numbers.

    A number found exactly (possible as steps read different tables) decides alone.
    """
    gap = F.abs(F.col("numero") - F.col("g_numero"))
    j = j.withColumn("gap", gap).withColumn("w", F.try_divide(F.lit(1.0), F.col("gap")))
    j = j.withColumn("label", approximate_label(F.col("g_endereco_completo"), F.col("numero")))
    hit = F.max(F.when(F.col("gap") == 0, 1).otherwise(0)) == 1

    def mean(c: str) -> Column:
        exact = F.avg(F.when(F.col("gap") == 0, F.col(c)))
        return F.when(hit, exact).otherwise(F.try_divide(F.sum(F.col("w") * F.col(c)), F.sum("w")))

    rank = F.struct("g_n_casos", -F.col("gap"), "g_endereco_completo", "g_lat", "g_lon", F.coalesce("g_cod_setor", F.lit("")))
    pick = lambda c: F.max_by(c, rank)
    parts = [c for c in j.columns if c in {f"g_{r}" for r in ROLES}]
    out = j.groupBy("tempid", "label").agg(
        mean("g_lat").alias("g_lat"),
        mean("g_lon").alias("g_lon"),
        F.bround(F.avg("g_desvio_metros")).cast("int").alias("g_desvio_metros"),
        F.first("log_causa_confusao").alias("log_causa_confusao"),
        F.first("numero").alias("asked"),
        *[pick(c).alias(c) for c in parts if c != "g_numero"],
        F.first("similaridade").alias("similaridade"),
        F.max("g_n_casos").alias("g_n_casos"),
        pick("g_cod_setor").alias("g_cod_setor"),
    )
    out = out.withColumnRenamed("label", "g_endereco_completo").withColumnRenamed("asked", "g_numero")
    return _exact(out, step)


def match(x: DataFrame, table: DataFrame, step: MatchStep) -> DataFrame:
    """Candidates of one step.

    A fuzzy step looks for the street in ``temp_lograd_determ`` (see ``street_matches``), with its
    similarity in ``similaridade_logradouro``; other steps look for the input's own.
    """
    if step.fuzzy:
        x = have_keys(x, step, "temp_lograd_determ")
        x = x.withColumn("logradouro", F.col("temp_lograd_determ")).withColumn("similaridade", F.col("similaridade_logradouro"))
    else:
        x = have_keys(x, step).withColumn("similaridade", F.lit(None).cast("double"))
    x = x.drop("similaridade_logradouro", "temp_lograd_determ")
    j = _joined(x, table, step)
    return _interpolated(j, step) if step.interpolated else _exact(j, step)


def unmatched(x: DataFrame, table: DataFrame, step: MatchStep) -> DataFrame:
    """The inputs that a step which compares no streets has no candidate for, by its keys alone."""
    g = table.where("numero is not null") if step.interpolated else table
    g = g.select([F.col(k).alias(f"g_{k}") for k in step.join_keys])
    tests = [F.col(k) == F.col(f"g_{k}") for k in step.join_keys] + [F.col(k).isNotNull() for k in step.keys if k not in step.join_keys]
    return x.join(g, reduce(Column.__and__, tests), "left_anti")


def street_dictionary(table: DataFrame, step: MatchStep) -> DataFrame:
    """Distinct streets with the keys that limit the comparison."""
    return table.select(*step.block_keys, "logradouro").where("logradouro is not null").distinct()


def street_matches(x: DataFrame, tables: Callable[[str], DataFrame], attempts: Iterable[MatchStep]) -> DataFrame:
    """(tempid, street, similarity, since): for each input and comparison of streets the most similar
    street above the cutoff, and the order of the first step that makes the comparison.

    Inputs with an ambiguous street, or without one of a step's keys, aren't compared.  Steps
    that share blocking keys, dictionary and cutoff share one comparison; all comparisons run
    as one plan, over pairs of streets whose lengths allow the cutoff.  A pair that occurs in many blocks
    isn't shuffled to be told apart: each batch compares its distinct pairs once.
    """
    kinds: dict[tuple, list[MatchStep]] = {}
    for step in attempts:
        kinds.setdefault((step.block_keys, step.dictionary, step.cutoff), []).append(step)
    asked, pairs = [], []
    for number, ((block, name, cutoff), steps) in enumerate(kinds.items()):
        since = F.lit(None).cast("int")
        for step in sorted(steps, key=lambda s: -s.order):
            test = reduce(Column.__and__, [F.col(k).isNotNull() for k in step.keys])
            since = F.when(test, F.lit(step.order)).otherwise(since)
        parts = [(F.col(k) if k in block else F.lit(None).cast("string")).alias(k) for k in BLOCK]
        rows = x.where(~F.col("log_causa_confusao")).withColumn("since", since).where("since is not null")
        rows = rows.select("tempid", "since", F.lit(number).alias("kind"), *parts, "logradouro")
        streets = street_dictionary(tables(name), steps[0]).withColumnRenamed("logradouro", "street")
        both = rows.select("kind", *block, "logradouro").distinct().join(streets, list(block))
        both = both.where(reachable(F.col("logradouro"), F.col("street"), cutoff))
        asked.append(rows)
        pairs.append(both.select("kind", F.lit(cutoff).alias("cutoff"), *parts, "logradouro", "street"))
    every, wanted = reduce(DataFrame.unionByName, pairs), reduce(DataFrame.unionByName, asked)
    key = ["kind", *BLOCK, "logradouro"]
    least = min(cutoff for _, _, cutoff in kinds)
    same = jaro_similarity(F.col("logradouro"), F.col("street"), least - 0.001).cast("decimal(5,3)")
    found = every.withColumn("similarity", same).where(F.col("similarity") > F.col("cutoff").cast("decimal(5,3)"))
    top = found.groupBy(*key).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "street")).alias("best"))
    top = top.select(*[F.col(k).alias(f"t_{k}") for k in key], "best")
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in key])
    return wanted.join(top, on).select(
        "tempid", F.col("best.street").alias("street"), (-F.col("best.s")).cast("decimal(5,3)").alias("similarity"), "since"
    )
