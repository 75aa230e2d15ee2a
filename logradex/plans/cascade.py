"""The cascade of match steps.

A row's result is the candidates of the first step that has any for it, and no row's
result depends on another row's.  ``rank_union`` says just that.  ``settle`` gives the same rows,
but looks for each row's first step by keys alone, counted together before they move, and then makes
candidates for that step only; ``staged`` does so group by group, and keeps settled rows out of
the looser joins that follow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.matching import CANDIDATE, have_keys, match, street_matches
from .steps import ATTEMPTS, STEPS, MatchStep

Tables = Callable[[str], DataFrame]

#: Steps that are evaluated together; what they settle leaves before the next group.
STAGES = tuple(
    tuple(line.split())
    for line in (
        "dn01 da01",
        "pn01 pa01 dn02 da02 pn02 pa02",
        "dn03 da03 pn03 pa03",
        "dn04 da04",
        "dl01 pl01 dl02 pl02 dl03 pl03 dl04",
        "dc01 dc02 db01 dm01",
    )
)


def applicable(x: DataFrame, steps: Iterable[MatchStep]) -> list[MatchStep]:
    """The steps whose keys are all columns of the input."""
    return [s for s in steps if set(s.keys) <= set(x.columns)]


def first_step(candidates: DataFrame) -> DataFrame:
    """Of each row's candidates those of its first step."""
    w = Window.partitionBy("tempid")
    return candidates.withColumn("_first", F.min("ordem").over(w)).where("ordem = _first").drop("_first")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def attach_streets(x: DataFrame, tables: Tables, attempts: Iterable[MatchStep]) -> DataFrame:
    """x with the street of the earliest comparison that found one, which then stays.

    Adds temp_lograd_determ, similaridade_logradouro and ``_since``, the order of that step.
    """
    attempts = list(attempts)
    if not attempts:
        return x.withColumns(
            {
                "temp_lograd_determ": F.lit(None).cast("string"),
                "similaridade_logradouro": F.lit(None).cast("decimal(5,3)"),
                "_since": F.lit(None).cast("int"),
            }
        )
    found = street_matches(x, tables, attempts)
    best = found.groupBy("tempid").agg(F.min_by(F.struct("street", "similarity", "since"), "since").alias("b"))
    best = best.select(
        "tempid",
        F.col("b.street").alias("temp_lograd_determ"),
        F.col("b.similarity").alias("similaridade_logradouro"),
        F.col("b.since").alias("_since"),
    )
    return x.join(best, "tempid", "left")


def _candidates(x: DataFrame, tables: Tables, step: MatchStep) -> DataFrame:
    if step.fuzzy:
        x = x.where(F.col("_since") <= step.order)
    return match(x.drop("_since"), tables(step.table), step).select(CANDIDATE)


def rank_union(x: DataFrame, tables: Tables, steps: Iterable[MatchStep] = STEPS) -> DataFrame:
    """All steps at once, then each row's first."""
    steps = applicable(x, steps)
    x = attach_streets(x, tables, [s for s in ATTEMPTS if s in steps])
    return first_step(_union([_candidates(x, tables, s) for s in steps]))


def _hits(x: DataFrame, tables: Tables, step: MatchStep) -> DataFrame:
    """(tempid, ordem) for each row that a step matches, once; reads nothing of the table but its keys."""
    street = F.col("logradouro")
    if step.fuzzy:
        x, street = x.where(F.col("_since") <= step.order), F.col("temp_lograd_determ")
    keys = step.join_keys
    x = have_keys(x, step, "temp_lograd_determ" if step.fuzzy else "logradouro")
    x = x.select("tempid", *[(street if k == "logradouro" else F.col(k)).alias(k) for k in keys])
    g = tables(step.table)
    if step.interpolated:
        g = g.where("numero is not null")
    return x.join(g.select(*keys), list(keys), "left_semi").select("tempid", F.lit(step.order).alias("ordem"))


def settle(x: DataFrame, tables: Tables, now: Iterable[MatchStep]) -> tuple[DataFrame, DataFrame]:
    """Candidates of each row's first step of these, and the rows that have none.

    The rows with their step are checkpointed, which cuts the lineage and survives lost executors.
    """
    now = list(now)
    first = _union([_hits(x, tables, s) for s in now]).groupBy("tempid").agg(F.min("ordem").alias("_ordem"))
    rows = x.join(first, "tempid", "left").checkpoint()
    found = [_candidates(rows.where(F.col("_ordem") == s.order).drop("_ordem"), tables, s) for s in now]
    return _union(found), rows.where("_ordem is null").drop("_ordem")


def at_once(x: DataFrame, tables: Tables, steps: Iterable[MatchStep] = STEPS) -> DataFrame:
    """The same as ``rank_union``, by ``settle``."""
    steps = applicable(x, steps)
    return settle(attach_streets(x, tables, [s for s in ATTEMPTS if s in steps]), tables, steps)[0]


def staged(x: DataFrame, tables: Tables, steps: Iterable[MatchStep] = STEPS) -> DataFrame:
    """Group after group of steps; rows that a group settles leave before the next."""
    steps = applicable(x, steps)
    codes = {s.code: s for s in steps}
    attempts = [s for s in ATTEMPTS if s in steps]
    groups = [now for group in STAGES if (now := [codes[c] for c in group if c in codes])]
    left, compared = attach_streets(x, tables, []), False
    out = []
    for number, now in enumerate(groups):
        if not compared and any(s.fuzzy for s in now):  # what a comparison finds stays, so all run here
            left = left.drop("temp_lograd_determ", "similaridade_logradouro", "_since")
            left, compared = attach_streets(left, tables, attempts).checkpoint(), True
        found, left = settle(left, tables, now)
        out.append(found)
        if number < len(groups) - 1 and left.isEmpty():
            break
    return _union(out)
