import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_pipeline(spark):
    import corpus_pipeline as p
    from logradex.llm import bpe, decontam, neardup, pii
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "byte_bpe"]
    seen = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF).checkpoint()
        assert name == "byte_bpe" or out.columns == docs.columns
        seen[name], docs = out, out
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen["quality"].select("doc_id").collect()}
    good = [i for i, v in labels.items() if v == (1, 0)]
    assert sum(i in kept for i in good) >= 0.9 * len(good)
    one = neardup.clusters(seen["near_dedup"], words=5).where("doc_id <> component_id")
    assert one.count() == 0
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontam.find_hits(seen["decontamination"], items).where("n_hit > 0").count() == 0
    before = {e for r in seen["decontamination"].select(pii.entities(F.col("text")).alias("e")).collect() for e in r.e}
    assert not any(e in r.text for r in seen["pii"].collect() for e in before)
    path, pattern = bpe.public_vocabulary()
    c = bpe.codec(path, pattern)
    want = {r.doc_id: r.text for r in seen["pii"].collect()}
    last = seen["byte_bpe"].collect()
    assert {r.doc_id: r.text for r in last} == want
    assert all(r.token_ids == c.single.encode_ordinary(r.text) and r.n_tokens == len(r.token_ids) for r in last)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, row int, n_tokens int"


def tables(spark, folder, rows, items, labels):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline as p
    from .test_llm import ODD, sample_documents

    texts, truth = sample_documents()
    item = " ".join(f"item{i}" for i in range(30))
    wide = lambda i, t: (i, t, "en", "s", len(t or ""), "x", 1, 2)
    rows = [wide(i, t) for i, t in texts] + [wide(1000 + k, t) for k, (_, t) in enumerate(ODD)] + [wide(None, None)]
    rows += [wide(*texts[0])] * 2 + [wide(None, texts[1][1])] + [wide(5000, texts[1][1]), wide(6000, f"{texts[2][1]} {item}")]
    folder = tables(spark, tmp_path / "a", rows, [("i", item), (None, None)], [(i, int(g), 0) for i, g in truth.items()])
    out = p.run(spark, folder)
    assert out.columns == [*rows_columns(), "_n_tokens", "token_ids", "ids_sha256"]
    got = out.collect()
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 0 in ids and 1 in ids and 5000 not in ids
    assert not any("item3" in r.text for r in got) and all(r.n_chars == len(r.text) and r.id == "x" for r in got)
    assert sum(truth[i] for i in ids if i in truth) >= 0.95 * sum(truth.values())
    for name, stage in p.STAGES:  # each takes what the first would have dropped
        odd = spark.createDataFrame([wide(i, t) for i, t in ODD], DOCS)
        assert stage(spark, odd, folder).count() <= len(ODD), name


def rows_columns():
    return [c.split()[0] for c in DOCS.split(", ")]


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    assert p.run(spark, tables(spark, tmp_path / "a", [], [], [])).count() == 0
