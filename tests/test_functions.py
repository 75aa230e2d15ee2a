import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logradex.fields import AddressFields, check_h3
from logradex.functions import text
from logradex.functions.ambiguity import is_ambiguous
from logradex.functions.geo import haversine, utm
from logradex.functions.similarity import jaro, jaro_pairs, jaro_similarity

_con = duckdb.connect()


@settings(max_examples=300, deadline=None)
@given(st.text("ABCDEéã ", max_size=12), st.text("ABCDEéã ", max_size=12))
def test_jaro_agrees_with_duckdb(a, b):
    want = _con.execute("SELECT jaro_similarity(?, ?)", [a, b]).fetchone()[0]
    assert jaro(a.encode(), b.encode()) == pytest.approx(want, abs=1e-12)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ABCDEéã ", max_size=12), st.text("ABCDEéã ", max_size=70)), max_size=40), st.sampled_from([0.0, 0.6, 0.85]))
def test_batches_of_pairs_agree(pairs, cutoff):
    a, b = [x.encode() for x, _ in pairs], [y.encode() for _, y in pairs]
    for x, y, got in zip(a, b, jaro_pairs(a, b, cutoff)):
        want = jaro(x, y)
        assert got == pytest.approx(want, abs=1e-12) or got == 0 and want <= cutoff


def test_jaro_of_long_texts():
    rng = __import__("random").Random(3)
    for n in (300, 3000):
        a, b = ("".join(rng.choice("abcde f") for _ in range(n)) for _ in range(2))
        assert jaro(a.encode(), b.encode()) == pytest.approx(_con.execute("SELECT jaro_similarity(?, ?)", [a, b]).fetchone()[0], abs=1e-12)
    assert jaro(b"ab" * 200_000, b"ba" * 200_000) == pytest.approx(5 / 6)  # all match, all out of place


def test_jaro_column(spark):
    rows = [("MARTHA", "MARHTA"), ("A", None), (None, None), ("", "X"), ("SAME", "SAME"), ("MARTHA", "MARHTA")]
    got = [r.x for r in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(jaro_similarity(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [pytest.approx(17 / 18), None, None, 0.0, 1.0, pytest.approx(17 / 18)]


def test_ambiguous_streets(spark):
    cases = {
        "RUA A": True, "RUA 10": True, "RUA 10-B": True, "ESTRADA B-12 KM 3": True, "RUA DOIS": True,
        "NOVA RUA DEZ": True, "RUA QUATRO": False, "RUA 15 DE NOVEMBRO": False, "AVENIDA BRASIL": False,
        "RUA ABC": False, None: False, "BLOCO 3 2": False, "RUA 10 20": False, "RUA 10A 7": False, "BECO C KM": True, "RUA 5 KM 7 8": False,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.f for r in df.select("s", is_ambiguous(F.col("s")).alias("f")).collect()}
    assert got == cases


def test_standardisers(spark):
    def one(f, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r.x for r in df.orderBy("i").select(f(F.col("v")).alias("x")).collect()]

    assert one(text.state, "AC", "Acre", "são paulo", "35", "XX", None) == ["AC", "AC", "SP", "SP", None, None]
    assert one(text.number, "17", "0", "S/N", "10a", "", None, " 8 ", "12.0") == [17, None, None, None, None, None, 8, 12]
    assert one(text.cep, "70390-025", "70390025", "1310100", "abc", None) == ["70390-025"] * 2 + ["01310-100", None, None]
    assert one(text.street, "R. Dr. João  Paulo", "Av Brasil", "S/N", "", None) == [
        "RUA DOUTOR JOAO PAULO", "AVENIDA BRASIL", None, None, None,
    ]
    assert one(text.district, "Jd. América", "centro") == ["JARDIM AMERICA", "CENTRO"]
    assert one(text.city, "Olho d'Água") == ["OLHO D AGUA"]


def test_distances(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (-23.5, -46.6, -23.5, -46.6), (90.0, 0.0, -90.0, 0.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(haversine(*[F.col(c) for c in "abcd"])).collect()]
    assert got[0] == pytest.approx(111319.49, abs=0.01) and got[1] == 0 and got[2] == pytest.approx(20037508.34, abs=0.01)
    e, n = utm(F.lit(-23.0), F.lit(-45.0))
    assert spark.range(1).select(e, n).first()[0] == pytest.approx(500000)
    # northing at 23 degrees south: scaled length of the meridian arc on GRS80
    assert spark.range(1).select(n).first()[0] == pytest.approx(10_000_000 - 0.9996 * 2544562.6, abs=30)


def test_arguments():
    with pytest.raises(ValueError):
        AddressFields()
    with pytest.raises(ValueError):
        AddressFields(logradouro="a", cep="a")
    with pytest.raises(ValueError):
        AddressFields.of({"street": "a"})
    with pytest.raises(TypeError):
        AddressFields(logradouro=3)
    assert check_h3([9, 7, 9]) == [7, 9] and check_h3(None) == []
    for bad in (-1, 16, [1, "a"], True):
        with pytest.raises(ValueError):
            check_h3(bad)
