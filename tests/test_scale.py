"""That work and memory follow the distinct addresses and the tables, not pairs or repeated rows."""

import os
import re

import pytest
from pyspark.sql import functions as F

from logradex.operators import lookup, results, ties
from logradex.operators.matching import match, unmatched
from logradex.operators.repeats import firsts, for_all, marked, once_each
from logradex.plans import cascade, fixture, queries
from logradex.plans.steps import NCL, STEP

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
INPUT = "tempid long, estado string, municipio string, logradouro string, numero int, cep string, localidade string, log_causa_confusao boolean"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_address_is_looked_up_once_for_all_its_rows(spark):
    rows = [(i, "A", "B", "RUA X" if i % 2 else None, None, "c", None, False) for i in range(1, 7)]
    x, every = once_each(spark.createDataFrame(rows, INPUT))
    assert sorted(r.tempid for r in x.collect()) == [1, 2]
    got = for_all(x.select("tempid", "logradouro"), every).collect()
    assert sorted((r.tempid, r.logradouro) for r in got) == [(r[0], r[3]) for r in rows]


@needs_tables
def test_inputs_broadcast_no_table_that_grows(spark):
    text = plan(fixture.inputs(spark, SF))
    assert text.count("ShuffledHashJoin") == 2, text  # customer and part; nation and region are small


@needs_tables
def test_hits_are_one_for_each_row_and_step(spark):
    g, x = fixture.gazetteer(spark, SF), fixture.inputs(spark, SF)
    hits = cascade._hits(x, g, STEP["dl03"])
    assert hits.count() == hits.select("tempid").distinct().count() > 0
    assert "left_semi" in plan(hits).lower().replace("leftsemi", "left_semi")


@needs_tables
def test_ties_of_repeated_addresses_are_counted_for_each_row(spark):
    g, x = fixture.gazetteer(spark, SF), fixture.inputs(spark, SF).checkpoint()
    twice = x.union(x.withColumn("tempid", F.col("tempid") + 10_000_000)).checkpoint()
    steps = [STEP[c] for c in ("dn01", "dl03")]
    once, rows = once_each(twice)
    got = for_all(ties.tied(cascade.at_once(once, g, steps)), rows).count()
    assert got == 2 * ties.tied(cascade.at_once(x, g, steps)).count() > 0


@needs_tables
def test_unmatched_is_one_join_by_keys(spark):
    g, x = fixture.gazetteer(spark, SF), fixture.inputs(spark, SF).checkpoint()
    rest = unmatched(x, g(NCL), STEP["dn01"])
    assert plan(rest).count("ShuffledHashJoin") == 1 and "SortMergeJoin" not in plan(rest)
    assert rest.count() == x.count() - match(x, g(NCL), STEP["dn01"]).select("tempid").distinct().count()


@needs_tables
@pytest.mark.parametrize("name", ["interp_da02", "match_pn03"])
def test_steps_look_up_an_address_once(spark, name, monkeypatch):
    seen = []
    monkeypatch.setattr(queries, "once_each", lambda x: seen.append(x.columns) or once_each(x))
    queries.QUERIES[name](spark, SF)
    assert seen == [["tempid", *STEP[name[-4:]].keys, "log_causa_confusao"]]


def test_results_join_the_rows_once(spark):
    x = [(i, "A", "B", "RUA X" if i % 2 else None, None, "c", None, False) for i in range(1, 7)]
    rows = marked(spark.createDataFrame(x, INPUT))
    found = firsts(rows).where("tempid = 1").selectExpr(
        "tempid", "1.0D lat", "2.0D lon", "'dn01' tipo_resultado", "3 desvio_metros", "'X' endereco_encontrado"
    )
    out = results.merge(rows.drop("log_causa_confusao"), found, complete=False, ties=False, on="_same")
    assert plan(out).count("Join ") == 1 and "_same" not in out.columns and "tempid" not in out.columns
    assert [(r.logradouro, r.lat, r.precisao) for r in out.collect()] == [("RUA X", 1.0, "numero"), (None, None, None)] * 3


@needs_tables
@pytest.mark.parametrize("name", ["merge_to_input", "geocode_end_to_end"])
def test_merged_results_are_not_spread_before(spark, name, monkeypatch):
    monkeypatch.setattr(queries, "for_all", lambda *_: pytest.fail("results were spread over all rows"))
    queries.QUERIES[name](spark, SF)


def test_nearest_reduces_distances_by_hashing(spark):
    p = spark.createDataFrame([(1, -10.0, -50.0), (2, -20.0, -50.0), (3, -25.0, -50.0)], "tempid long, lat double, lon double")
    near = [("b", -10.001, -50.0), ("a", -10.001, -50.0), (None, -10.001, -50.0), ("c", -10.002, -50.0), ("d", -20.003, -50.0)]
    found = lookup.nearest(p, spark.createDataFrame(near, "endereco_completo string, lat double, lon double"), 500)
    text = plan(found)
    assert text.count("functions=[min(distancia") == 1 and text.count("functions=[partial_min(distancia") == 1, text
    assert sorted((r.tempid, r.a_endereco_completo) for r in found.collect()) == [(1, "a"), (2, "d")]


@needs_tables
@pytest.mark.parametrize("name", ["nearest_within", "within_distance"])
def test_places_are_looked_up_once(spark, name, monkeypatch):
    seen = []
    monkeypatch.setattr(queries, "once_each", lambda x: seen.append(x.columns) or once_each(x))
    queries.QUERIES[name](spark, SF)
    assert seen == [["tempid", "lat", "lon"]]


@needs_tables
def test_plain_steps_sort_nothing(spark):
    text = plan(queries.QUERIES["match_dl03"](spark, SF))
    assert text.count("ShuffledHashJoin") == 3 and "Sort " not in text and "SortMergeJoin" not in text, text


@needs_tables
@pytest.mark.parametrize("name", ["precision_label", "precision_shares", "interp_pa03", "match_pl02"])
def test_named_queries_look_up_an_address_once(spark, name, monkeypatch):
    seen = []
    monkeypatch.setattr(queries, "once_each", lambda x: seen.append(x.columns) or once_each(x))
    queries.QUERIES[name](spark, SF)
    assert len(seen) == 1 and seen[0][0] == "tempid"


@needs_tables
@pytest.mark.parametrize("name", ["precision_shares", "precision_label", "match_dl03", "interp_pa03", "match_pl02"])
def test_named_queries_broadcast_neither_customer_nor_part(spark, name, monkeypatch):
    seen, frame = [], type(spark.range(1))
    checkpoint = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda df, *a, **k: seen.append(plan(df)) or checkpoint(df, *a, **k))
    monkeypatch.setattr(fixture, "_BUILT", {})
    seen.append(plan(queries.QUERIES[name](spark, SF)))
    joins = re.findall(r"\w*Join .*(?:p_partkey|c_custkey).*", "\n".join(seen))  # supplier is small
    assert len(joins) >= 3 and all(j.startswith("ShuffledHashJoin") for j in joins), joins
