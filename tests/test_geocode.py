import random
import struct

import pytest

from logradex.api import Geocoder
from logradex.operators import lookup, ties
from logradex.operators.blocks import balanced
from logradex.operators.matching import CANDIDATE
from logradex.plans import cascade
from logradex.sources.cache import Cache, directory_provider, http_provider
from logradex.sources.gazetteer import Gazetteer, build

FIELDS = {"logradouro": "rua", "numero": "num", "cep": "postal", "localidade": "bairro", "municipio": "cidade", "estado": "uf"}
RECORDS = [
    # estado, municipio, logradouro, numero, cep, localidade, lat, lon, cod_setor
    ("RJ", "NOVA IGUACU", "RUA MARIA LUCIA PACIFICO", 17, "26042-730", "SANTA RITA", -22.70, -43.45, "1"),
    ("RJ", "NOVA IGUACU", "RUA MARIA LUCIA PACIFICO", 21, "26042-730", "SANTA RITA", -22.71, -43.46, "1"),
    ("RJ", "NOVA IGUACU", "RUA MARIA LUCIA PACIFICO", 29, "26042-730", "SANTA RITA", -22.73, -43.48, "2"),
    ("RJ", "NOVA IGUACU", "RUA DOS ANJOS", 5, "26000-000", "CENTRO", -22.80, -43.40, "3"),
    ("RJ", "NOVA IGUACU", "RUA DOS ANJOS", 5, "26111-000", "VILA", -22.90, -43.40, "3"),
    ("AC", "RIO BRANCO", "RUA PRINCESA ISABEL", 263, "69900-000", "ESTACAO", -9.97, -67.80, "4"),
]


@pytest.fixture(scope="module")
def geocoder(spark):
    schema = "estado string, municipio string, logradouro string, numero int, cep string, localidade string, lat double, lon double, cod_setor string"
    g = build(spark.createDataFrame(RECORDS, schema))
    return Geocoder(spark, Gazetteer({n: t.persist() for n, t in g.tables.items()}))


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "rua string, num string, postal string, bairro string, cidade string, uf string").coalesce(1)


INPUTS = [
    ("Rua Maria Lucia Pacifico", "17", "26042-730", "Santa Rita", "Nova Iguacu", "RJ"),  # dn01
    ("Rua Maria Lucia Pacifico", "25", "26042-730", "Santa Rita", "Nova Iguaçu", "RJ"),  # da01
    ("Rua Maria Lucya Pacifico", "17", "26042-730", "Santa Rita", "Nova Iguacu", "RJ"),  # pn01
    ("Rua Maria Lucya Pacifico", "25", "26042-730", None, "Nova Iguacu", "RJ"),  # pa02
    ("Rua Princesa Isabel", "263", None, None, "Rio Branco", "Acre"),  # dn04
    ("Rua Princesa Isabel", "S/N", None, None, "Rio Branco", "AC"),  # dl04
    (None, None, "26000-000", None, "Nova Iguacu", "RJ"),  # dc02
    (None, None, None, "Centro", "Nova Iguacu", "RJ"),  # db01
    ("Rua Que Nao Existe", "1", None, None, "Rio Branco", "AC"),  # dm01
    ("Rua X", "1", None, None, "Cidade Nenhuma", "SP"),  # nothing
]


def test_steps_and_order(spark, geocoder):
    out = geocoder.geocode(rows_of(spark, INPUTS), FIELDS, complete=True).collect()
    assert [r.tipo_resultado for r in out] == ["dn01", "da01", "pn01", "pa02", "dn04", "dl04", "dc02", "db01", "dm01", None]
    assert [r.rua for r in out] == [r[0] for r in INPUTS]
    assert out[0].precisao == "numero" and out[1].precisao == "numero_aproximado" and out[9].lat is None
    # 25 lies 4 from 21, 4 from 29 and 8 from 17
    assert out[1].lat == pytest.approx((-22.71 / 4 - 22.73 / 4 - 22.70 / 8) / (1 / 4 + 1 / 4 + 1 / 8))
    assert out[1].endereco_encontrado == "RUA MARIA LUCIA PACIFICO, 25 (aprox) - SANTA RITA, NOVA IGUACU - RJ, 26042-730"
    assert out[0].similaridade_logradouro == 1.0 and 0.85 < out[2].similaridade_logradouro < 1
    assert out[2].logradouro_encontrado == "RUA MARIA LUCIA PACIFICO" and not out[0].empate


def test_ties_kept_or_resolved(spark, geocoder):
    tie = [("Rua dos Anjos", "5", None, None, "Nova Iguacu", "RJ"), INPUTS[0]]
    kept = geocoder.geocode(rows_of(spark, tie), FIELDS, resolve_ties=False).collect()
    assert [r.empate for r in kept] == [True, True, False]
    one = geocoder.geocode(rows_of(spark, tie), FIELDS).collect()
    assert len(one) == 2 and one[0].lat in (-22.8, -22.9)  # 11 km apart: the one of most records


def test_both_plans_agree(spark, geocoder):
    from logradex.api import prepared
    from logradex.operators.results import with_row_ids

    x = prepared(with_row_ids(rows_of(spark, INPUTS * 3)), FIELDS).checkpoint()
    assert [r.tempid for r in x.select("tempid").orderBy("tempid").collect()] == list(range(1, 31))
    a = cascade.rank_union(x, geocoder.gazetteer).select("tempid", "tipo_resultado", "endereco_encontrado")
    for plan in (cascade.staged, cascade.at_once):
        b = plan(x, geocoder.gazetteer).select("tempid", "tipo_resultado", "endereco_encontrado")
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def candidates(spark, rows):
    schema = (
        "tempid long, ordem int, tipo_resultado string, lat double, lon double, endereco_encontrado string, desvio_metros int,"
        "log_causa_confusao boolean, logradouro_encontrado string, numero_encontrado int, cep_encontrado string,"
        "localidade_encontrada string, municipio_encontrado string, estado_encontrado string,"
        "similaridade_logradouro double, contagem_cnefe int, cod_setor string"
    )
    full = [(i, 1, "dn01", lat, 0.0, f"{street}, {k} - X", 5, flag, street, 1, "c", "l", "m", "e", None, n, "s") for k, (i, lat, n, flag, street) in enumerate(rows)]
    df = spark.createDataFrame(full, schema)
    assert df.columns == CANDIDATE
    return df


def test_tie_classes(spark):
    d = 1 / 111319.49  # degrees in a metre
    df = candidates(
        spark,
        [
            (1, 0.0, 9, False, "RUA X"), (1, 100 * d, 1, False, "RUA X"),  # near: one is left
            (2, 0.0, 1, False, "RUA X"), (2, 600 * d, 3, False, "RUA X"),  # weighted mean
            (3, 0.0, 1, False, "RUA X"), (3, 5000 * d, 3, False, "RUA X"),  # far: most records
            (4, 0.0, 1, True, "RUA A"), (4, 600 * d, 3, True, "RUA A"),  # ambiguous: most records
            (5, 0.0, 1, False, "RUA QUINZE"), (5, 600 * d, 3, False, "RUA QUINZE"),
            (6, 0.0, 1, False, "RUA QUINZE DE MAIO"), (6, 600 * d, 3, False, "RUA QUINZE DE MAIO"),
            (7, 1.0, 1, False, None),
            (8, 0.0, 1, True, "RUA 7 DE ABRIL"), (8, 5000 * d, 3, True, "RUA 7 DE ABRIL"),  # a date: the mean in any case
            (9, 0.0, 1, False, "RUA X"), (9, 3000 * d, 5, False, "RUA 7 DE ABRIL"), (9, 8000 * d, 2, False, "RUA X"),  # the lost one of most records
        ],
    )
    got = {r.tempid: (round(r.lat / d), r.empate) for r in ties.resolve(df).collect()}
    assert got == {
        1: (100, False), 2: (450, True), 3: (5000, True), 4: (600, True), 5: (600, True), 6: (450, True), 7: (111319, False),
        8: (3750, True), 9: (8000, True),
    }
    largest = {r.tempid: round(r.lat / d) for r in ties.resolve(df, keep_largest=True).collect()}
    assert largest[1] == 0
    assert ties.count_ties(df).first().n_ties == 8


def test_reverse_and_cep(spark, geocoder):
    points = spark.createDataFrame([("a", -22.7001, -43.4501), ("b", -22.75, -43.0), ("c", -9.9701, -67.8001)], "id string, lat double, lon double")
    out = geocoder.reverse(points, metres=1000).collect()
    assert [(r.id, r.numero_encontrado) for r in out] == [("a", 17), ("c", 263)]
    planar = geocoder.reverse(points.where("id = 'a'"), metres=1000, planar=True).first()
    assert planar.distancia_metros == pytest.approx(out[0].distancia_metros, rel=0.01)
    for bad in (100, 200_000, True):
        with pytest.raises(ValueError):
            geocoder.reverse(points, metres=bad)
    with pytest.raises(ValueError):
        geocoder.reverse(spark.createDataFrame([(25.6, 53.1)], "lat double, lon double"))
    with pytest.raises(ValueError):
        geocoder.reverse(points.where("id = 'b'"))
    got = geocoder.by_cep(["26042730", "99999-999"]).collect()
    assert sorted((r.cep, r.logradouro) for r in got if r.logradouro) == [("26042-730", "RUA MARIA LUCIA PACIFICO")]
    assert [r.cep for r in got if not r.logradouro] == ["99999-999"]
    with pytest.raises(ValueError):
        geocoder.by_cep(["99999-999"])


def test_input_checks(spark, geocoder):
    df = rows_of(spark, INPUTS[:1])
    with pytest.raises(ValueError):
        geocoder.geocode(df, {**FIELDS, "cep": "nada"})
    with pytest.raises(ValueError):
        geocoder.geocode(df, {"logradouro": "rua"})
    with pytest.raises(TypeError):
        geocoder.geocode(df, FIELDS, complete=1)
    out = geocoder.geocode(df.select("cidade", "uf"), {"municipio": "cidade", "estado": "uf"}, geometry=True).first()
    assert out.tipo_resultado == "dm01" and out.geometry.startswith("POINT (")
    raw = geocoder.geocode(df.select("cidade", "uf"), {"municipio": "cidade", "estado": "uf"}, geometry="wkb").first()
    assert struct.unpack("<BIdd", raw.geometry) == (1, 1, raw.lon, raw.lat)
    with pytest.raises(ValueError, match="reference system"):
        geocoder.reverse(spark.createDataFrame([(-22.7, -43.4)], "lat double, lon double"), srid=4326)


def test_cache(tmp_path):
    cache = Cache(tmp_path / "conf" / "path", tmp_path / "default")
    assert cache.folder() == tmp_path / "default"
    cache.set_folder(tmp_path / "mine")
    assert cache.folder() == tmp_path / "mine" and cache.files() == []
    source = tmp_path / "source"
    source.mkdir()
    (source / "municipio.parquet").write_bytes(b"x")
    folder = cache.fetch(directory_provider(source), "municipio")
    assert [p.name for p in cache.files()] == ["municipio.parquet"] and "municipio.parquet" in cache.tree()
    with pytest.raises(ValueError):
        cache.fetch(directory_provider(source), "munic")
    with pytest.raises(RuntimeError):
        cache.fetch(directory_provider(source), "municipio_cep")
    assert not cache.invalidate()
    (folder.parent / "gazetteer_release_v0.0.1").mkdir()
    assert cache.invalidate() and not cache.folder().exists()
    cache.set_folder(None)
    assert cache.folder() == tmp_path / "default"


def test_http_provider(tmp_path):
    import http.server
    import threading

    body = bytes(range(256)) * 5000
    broken = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path != "/base/municipio.parquet":
                self.send_error(404)
                return
            start = int((self.headers.get("Range") or "bytes=0-").split("=")[1].rstrip("-"))
            self.send_response(206 if start else 200)
            self.send_header("Content-Length", str(len(body) - start))
            self.end_headers()
            part = body[start:]
            if not broken:  # the first transfer breaks off
                broken.append(start)
                part = part[:700_000]
            self.wfile.write(part)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        cache = Cache(tmp_path / "conf", tmp_path / "cache")
        get = http_provider(f"http://127.0.0.1:{server.server_port}/base/")
        folder = cache.fetch(get, "municipio")
        assert (folder / "municipio.parquet").read_bytes() == body and broken == [0]
        with pytest.raises(RuntimeError):
            cache.fetch(get, "municipio_cep")
        assert [p.name for p in cache.files()] == ["municipio.parquet"]
    finally:
        server.shutdown()


def test_files_of_a_gazetteer(spark, geocoder, tmp_path):
    from logradex.sources.gazetteer import read_table, schema_of, views
    from logradex.plans.steps import TABLES

    geocoder.gazetteer.write(str(tmp_path))
    again = Gazetteer.read(spark, str(tmp_path))
    for name in TABLES:
        want = geocoder.gazetteer(name)
        assert sorted(map(str, again(name).collect())) == sorted(map(str, want.collect()))
        assert sorted(spark.createDataFrame([], schema_of(name)).dtypes) == sorted(want.dtypes)
    assert sorted(views(spark, str(tmp_path))) == sorted(TABLES) and spark.table("municipio").count() == 2
    again.register(spark)
    (tmp_path / "bad.parquet").write_bytes(b"no parquet")
    with pytest.raises(RuntimeError, match="delete it and fetch"):
        read_table(spark, str(tmp_path / "bad.parquet"))
    with pytest.raises(RuntimeError, match="delete it and fetch"):
        read_table(spark, str(tmp_path / "none.parquet"))


def test_checkpoints_need_a_shared_folder():
    from types import SimpleNamespace as N

    from logradex.sources import checkpoints

    folder = N(isEmpty=lambda: True)
    spark = N(sparkContext=N(master="spark://host:7077", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: folder))), conf=N(get=lambda *_: None))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        checkpoints.ensure(spark)


def test_balanced_blocks(spark):
    rows = [(f"E{i % 3}", f"M{i % 17}") for i in range(400)] + [("E0", "M0")] * 90 + [(None, None)] * 5
    df = spark.createDataFrame(rows, "estado string, municipio string")
    got = balanced(df, 4).collect()
    sizes = {}
    for r in rows:
        sizes[r] = sizes.get(r, 0) + 1
    loads, want = [0] * 4, {}
    for place in sorted(sizes, key=lambda p: (-sizes[p], p[0] is not None, p[0] or "", p[1] or "")):
        want[place] = loads.index(min(loads)) + 1
        loads[want[place] - 1] += sizes[place]
    assert len(got) == len(rows) and {(r.estado, r.municipio): r.bloco for r in got} == want
    with pytest.raises(ValueError):
        balanced(df, 0)


def test_boxes_and_nearest(spark):
    rng = random.Random(5)
    points = [(i, rng.uniform(-30, 0), rng.uniform(-70, -40)) for i in range(200)]
    boxes = [(f"b{i}", *sorted((rng.uniform(-70, -40), rng.uniform(-70, -40))), *sorted((rng.uniform(-30, 0), rng.uniform(-30, 0)))) for i in range(20)]
    p = spark.createDataFrame(points, "tempid long, lat double, lon double")
    b = spark.createDataFrame(boxes, "name string, xmin double, xmax double, ymin double, ymax double")
    joined = lookup.in_boxes(p, b)
    assert "NestedLoop" not in joined._jdf.queryExecution().toString()
    want = {(i, n) for i, y, x in points for n, x0, x1, y0, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1}
    got = [(r.tempid, r.name) for r in joined.collect()]
    assert len(got) == len(want) and set(got) == want
    near = spark.createDataFrame([(f"a{i}", y + 0.001 * (i % 3), x) for i, y, x in points for _ in (0, 1)], "endereco_completo string, lat double, lon double")
    found = lookup.nearest(p, near, 500).collect()
    assert len(found) == 200 and all(r.a_endereco_completo == f"a{r.tempid}" for r in found)


def test_stream(spark, geocoder, tmp_path):
    from logradex.streaming.addresses import geocode_stream

    rows_of(spark, INPUTS[:2]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("rua string, num string, postal string, bairro string, cidade string, uf string").parquet(str(tmp_path / "in"))
    seen = []
    q = geocode_stream(stream, geocoder, FIELDS, lambda df, n: seen.extend(r.tipo_resultado for r in df.collect()), checkpoint=str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert seen == ["dn01", "da01"]
