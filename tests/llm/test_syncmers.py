import hashlib
import random
import struct

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from logradex.llm import syncmers

from .test_llm import ODD, frame

K, S = syncmers.K, syncmers.S
SF = "/root/testdata/sf0.001"


def chain(values):
    """Spark's xxhash64 of longs."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed & (2**64 - 1))
        seed -= (seed >> 63) << 64
    return seed


def one(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - ((h >> 63) << 64)


def brute_anchors(text):
    """Closed syncmers by the definition."""
    h = [one(u) for u in regex.findall(syncmers.UNIT, text)]
    if len(h) < K:
        return [(0, chain(h))] if h else []
    inner = [chain(h[i : i + S]) for i in range(len(h) - S + 1)]
    w = K - S + 1
    return [(i, chain(h[i : i + K])) for i in range(len(h) - K + 1) if min(inner[i : i + w]) in (inner[i], inner[i + w - 1])]


def brute_text(found):
    return "".join(f"{h & (2**64 - 1):016x}" for _, h in found)


def brute_likeness(a, b):
    """From the fingerprints as returned."""
    x, y = ([s[i : i + 16] for i in range(0, len(s), 16)] for s in (a, b))
    if not x and not y:
        return 1.0
    places = sorted((x.index(h), y.index(h)) for h in set(x) & set(y))
    ok = sum(k == 0 or q > places[k - 1][1] for k, (_, q) in enumerate(places))
    return 2 * ok / (len(set(x)) + len(set(y)))


def check(docs, got):
    """docs: (id, text) in the order of ids."""
    prints = {t: brute_text(brute_anchors(t)) for _, t in docs}
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == prints[text] and r.edited_fingerprint == brute_text(brute_anchors(edited))
        assert r.near_edited == brute_likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == brute_likeness(r.fingerprint, prints[after])


def test_op4_agrees_with_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check(sorted((r.doc_id, r.text or "") for r in rows), {r.doc_id: r for r in syncmers.op4(spark, SF).collect()})


def test_odd_texts_agree_with_brute_force(spark):
    rng = random.Random(1)
    alphabet = ["ab", "wonderful ", "x", " ", "\n", "日本", "語", "ไทย", "é", "😀", "same words again and again, same words again and again. "]
    docs = [(i, "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 3, 9, 30, 200])))) for i in range(120)]
    docs += [(200, ""), (201, "a"), (202, "word " * 3000), (203, "y" * 9000), (204, "日" * 900), (205, docs[5][1]), (206, docs[5][1])]
    check(docs, {r.doc_id: r for r in syncmers.fingerprints(frame(spark, docs)).collect()})


def test_likeness(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(4000)}" for _ in range(900)]
    text, other = " ".join(words), " ".join(f"v{rng.randrange(4000)}" for _ in range(900))
    moved = " ".join([f"u{i}" for i in range(40)] + words)
    turned = " ".join(reversed([" ".join(words[i : i + 30]) for i in range(0, 900, 30)]))
    df = frame(spark, [(1, text), (2, text), (3, moved), (4, other), (5, ""), (6, "short text"), (7, "日" * 900), (8, turned)])
    fp = df.withColumn("fp", syncmers.fingerprint(F.col("text")))
    pairs = fp.alias("l").join(fp.alias("r"), F.lit(True)).select(
        F.col("l.doc_id").alias("a"), F.col("r.doc_id").alias("b"), syncmers.likeness(F.col("l.fp"), F.col("r.fp")).alias("x"),
    )
    got = {(r.a, r.b): r.x for r in pairs.collect()}
    assert got[1, 2] == 1 and got[1, 3] > 0.9 and got[1, 4] < 0.05 and 0.4 < got[1, 8] < 0.95
    assert got[5, 5] == 1 and got[5, 1] == 0 and got[6, 6] == 1 and got[7, 7] == 1 and all(0 <= x <= 1 for x in got.values())


def test_anchors_are_context_free_and_dense():
    rng = random.Random(9)
    words = [rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(400)]
    a, b = brute_anchors(" ".join(words)), brute_anchors(" ".join(words[100:300]))
    assert [(x - 100, h) for x, h in a if 100 <= x <= 300 - K] == b
    assert all(q - p <= K - S + 1 for (p, _), (q, _) in zip(a, a[1:]))


@pytest.mark.parametrize(("size", "segments"), [(16 << 20, 256), (300, 8), (70, 2)])
def test_next_rows(spark, monkeypatch, size, segments):
    monkeypatch.setattr(syncmers, "RANGE_BYTES", size)
    monkeypatch.setattr(syncmers, "SEGMENTS", segments)
    rng = random.Random(3)
    rows = [(i * 7 % 1000, f"t{i}") for i in range(300)] + [(None, f"n{i}") for i in range(40)] + [(2000, f"dup {i}") for i in range(90)]
    rows += [(10**12, None), (-5, "low"), (2**62, "high"), (7, "x" * 5000), (2000, "dup 1")]
    rng.shuffle(rows)
    wide = frame(spark, [(*r, "keep", k) for k, r in enumerate(rows)], "doc_id long, text string, before string, range int")
    got = syncmers.with_next(wide)
    assert got.columns == ["doc_id", "text", "before", "range", "next"]
    got = got.collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, one(r[1] or ""), r[1] or ""))
    want = sorted((str(i), t or "", order[(k + 1) % len(order)][1] or "") for k, (i, t) in enumerate(order))
    assert sorted((str(r.doc_id), r.text or "", r.next.text) for r in got) == want
    assert {r.range for r in got} == set(range(len(rows))) and {r.before for r in got} == {"keep"}


def test_few_rows(spark):
    alone = syncmers.fingerprints(frame(spark, [(3, "a b")])).collect()
    assert [(r.near_next, r.near_edited, r.n_chars) for r in alone] == [(1.0, 1.0, 3)]
    assert syncmers.fingerprints(frame(spark, [])).count() == 0
    odd = syncmers.fingerprints(frame(spark, ODD)).collect()
    assert len(odd) == len(ODD) and len({r.fingerprint for r in odd if r.doc_id == 4}) == 1
