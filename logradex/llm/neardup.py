"""MinHash near-deduplication by an inverted join over signature coordinates.

Each distinct shingle set gets a signature of ``COORDINATES`` minima.  Sets are posted
under the (coordinate, value) pairs of a prefix of the signature, postings of one pair
meet, and collisions over all coordinates are counted: a pair of sets is a candidate if
at least ``least_matches`` coordinates agree.  Candidates are confirmed on the full sets.

What is missed: two sets at the least similarity agree in one coordinate with
probability 0.8, so they share none of ``POSTED`` posted values with probability
0.2 ** 10, and agree in fewer than ``least_matches`` coordinates with probability ``MISS``.

How it stays linear:

* Prefix: only ``POSTED`` of the coordinates are posted, and values that no two sets
  share are skipped before anything but (value, id) has moved.
* Copies: rows with equal sets are one node from the start.
* First round (a forest): within each posting list a set is paired only with its best
  earlier partner.  Confirmed pairs give components, which settles groups of thousands
  of near copies with a few pairs each.  Lists above ``HOT`` are salted.
* Second round (the rest): lists whose members are in one component are skipped.  In the
  others every pair from different components is counted, over ``FINE_COORDINATES`` made
  for these members alone, so no link is lost.  A list
  above ``HOT`` is refined: a pair in it also shares another posted value (all but
  0.2 ** 9 do), so its members are posted again under pairs of values; lists still above
  ``HOT`` are cut into blocks and each pair of blocks meets once.  No task ever holds
  more than about ``HOT`` members of a list.

Edge cases: null or wordless text has an empty set, which is linked with nothing and is
its own component; fewer words than a shingle form one shingle; rows that share an id
count as one document; a null id is a component of its own (null) and is kept, whatever its
text; of equal texts the smallest id stays; very long texts are read whole; an empty table gives
an empty result; columns of any other name stay as they are.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

COORDINATES = 64
FINE_COORDINATES = 512
POSTED = 10
MISS = 2e-7
HOT = 4000
CACHED_HASHES = 2_000_000



@functools.cache
def least_matches(n: int, similarity: float = 0.8, miss: float = MISS) -> int:
    """The most matches of n coordinates that a pair of the least similarity falls short of with a
    probability of at most ``miss``."""
    total = 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k)
        if total > miss:
            return k
    return n


_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 1 << 63, FINE_COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, FINE_COORDINATES, dtype=np.uint64)
_C = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    parts = text.translate(_FOLD).split() if text else []
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, n)
    size = min(words, n)
    h = np.full(n - size + 1, size * int(_C[63]) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(size):
        h += w[i : n - size + 1 + i] * _C[i % 63]
        if size > 1:
            h = (h << np.uint64(7)) | (h >> np.uint64(57))
    return np.unique(_mix(h))


def signature(s: np.ndarray, n: int = COORDINATES) -> np.ndarray:
    """Minimum of each coordinate's permutation over a non-empty set, mixed with the coordinate's number."""
    low = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(s), 2048):
        part = s[at : at + 2048]
        for c in range(0, n, 64):
            rows = slice(c, min(c + 64, n))
            np.minimum(low[rows], (part[None, :] * _A[rows, None] + _B[rows, None]).min(axis=1), out=low[rows])
    return _mix(low ^ _PLACE[:n])


_PLACE = np.arange(1, FINE_COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def sketch_of(low: np.ndarray) -> bytes:
    """A byte of each coordinate."""
    return (low >> np.uint64(56)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Per row: id, n (set size), set_key, posted values, and a byte of each coordinate."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, key, posted, sketch = [], [], [], []
        for text in common.binaries(batch.column(1)):
            s = shingle_set(text, words)
            n.append(len(s))
            if not len(s):
                key.append(None)
                posted.append(None)
                sketch.append(None)
                continue
            key.append(xxhash.xxh3_128_digest(s.tobytes()))
            low = signature(s)
            posted.append(low[:POSTED].view(np.int64))
            sketch.append(sketch_of(low))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
             pa.array(posted, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
            ["id", "n", "set_key", "posted", "sketch"],
        )

    fields = f"id {kind}, n bigint, set_key binary, posted array<bigint>, sketch binary"
    return common.map_batches(docs, [id_col, text_col], rows, fields)


# posting lists


def _runs(batches: Iterator[pa.RecordBatch], head: int) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns and the bounds of the runs of equal leading ``head`` columns; a run is never cut."""
    rest: dict[str, np.ndarray] | None = None

    def bounds(cols: dict[str, np.ndarray]) -> np.ndarray:
        lead = list(cols.values())[:head]
        new = np.ones(len(lead[0]), bool)
        new[1:] = False
        for c in lead:
            new[1:] |= c[1:] != c[:-1]
        return np.append(np.flatnonzero(new), len(new))

    for batch in batches:
        cols = {}
        for name, col in zip(batch.schema.names, batch.columns):
            if name == "sketch":
                flat = np.frombuffer(b"".join(col.to_pylist()), np.uint8)
                cols[name] = flat.reshape(len(col), -1)
            else:
                cols[name] = col.to_numpy(zero_copy_only=False)
        if rest is not None:
            cols = {k: np.concatenate([rest[k], v]) for k, v in cols.items()}
        if not len(cols["n"]):
            continue
        at = bounds(cols)
        rest = {k: v[at[-2] :] for k, v in cols.items()}
        if len(at) > 2:
            yield {k: v[: at[-2]] for k, v in cols.items()}, at[:-1]
    if rest is not None:
        yield rest, bounds(rest)


def _matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Coordinates that agree, for each row of a against each of b."""
    return (a[:, None, :] == b[None, :, :]).sum(axis=2, dtype=np.int16)


def _pairs(step: Callable, kind: pa.DataType, head: int) -> Callable:
    """A mapInArrow function that runs ``step`` on each posting list of two or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, at in _runs(batches, head):
            a: list = []
            b: list = []
            for k in np.flatnonzero(np.diff(at) > 1).tolist():
                part = slice(at[k], at[k + 1])
                for x, y in step({name: col[part] for name, col in cols.items()}):
                    a.append(x)
                    b.append(y)
            if a:
                x, y = np.concatenate(a), np.concatenate(b)
                low, high = np.minimum(x, y), np.maximum(x, y)
                yield pa.RecordBatch.from_arrays([pa.array(low, kind), pa.array(high, kind)], ["a", "b"])

    return run


def _forest(cols: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each member with the earlier member that most coordinates agree with."""
    ids, n, sketch = cols["id"], cols["n"], cols["sketch"]
    least = least_matches(sketch.shape[1])
    for at in range(0, len(ids), 64):
        end = min(at + 64, len(ids))
        low = int(np.searchsorted(n, 0.8 * n[at] - 1))
        m = _matches(sketch[at:end], sketch[low:end])
        row, col = np.arange(at, end)[:, None], np.arange(low, end)[None, :]
        m[(col >= row) | (5 * n[None, low:end] < 4 * n[at:end, None])] = 0
        best = m.shape[1] - 1 - m[:, ::-1].argmax(axis=1)  # the latest of the best
        good = np.flatnonzero(m[np.arange(end - at), best] >= least)
        if len(good):
            yield ids[at + good], ids[low + best[good]]


def _across(cols: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs from different components on which enough coordinates agree."""
    ids, n, sketch, comp = cols["id"], cols["n"], cols["sketch"], cols["component"]
    block, least = cols.get("block"), least_matches(sketch.shape[1])
    for at in range(0, len(ids), 64):
        end = min(at + 64, len(ids))
        low = int(np.searchsorted(n, 0.8 * n[at] - 1))
        row, col = np.arange(at, end)[:, None], np.arange(low, end)[None, :]
        ok = (comp[at:end, None] != comp[None, low:end]) & (col < row) & (5 * n[None, low:end] >= 4 * n[at:end, None])
        if block is not None and cols["x"][0] != cols["y"][0]:
            ok &= block[at:end, None] != block[None, low:end]
        if not ok.any():
            continue
        i, j = np.nonzero(ok)
        for cut in range(0, len(i), 1 << 14):
            x, y = i[cut : cut + (1 << 14)] + at, j[cut : cut + (1 << 14)] + low
            good = (sketch[x] == sketch[y]).sum(axis=1) >= least
            if good.any():
                yield ids[x[good]], ids[y[good]]


def _candidates(lists: DataFrame, head: list[str], step: Callable, kind: str) -> DataFrame:
    """Candidate pairs out of posting lists, each pair once."""
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    ordered = lists.repartition(*head).sortWithinPartitions(*head, "n", "id")
    ordered = ordered.select(*head, *[c for c in lists.columns if c not in head])
    return ordered.mapInArrow(_pairs(step, arrow, len(head)), f"a {kind}, b {kind}").distinct()


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the ids given; only those ids move if they are few bytes, else texts are shuffled."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return texts.join(_few(ids), "id", "left_semi")


def fine_sketches(texts: DataFrame, words: int) -> DataFrame:
    """(id, sketch) with ``FINE_COORDINATES`` bytes each."""
    kind = texts.schema["id"].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [sketch_of(signature(shingle_set(t, words), FINE_COORDINATES)) for t in common.binaries(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "sketch"])

    return common.map_batches(texts, ["id", "text"], rows, f"id {kind}, sketch binary")


def confirm(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    ends = ends.groupBy("id").agg(F.count("*").alias("n")).checkpoint()
    texts = texts_of(docs, ends.select("id"), id_col, text_col).checkpoint()
    n_a, n_b = (ends.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}")) for c in ("a", "b"))
    # the text of the document with fewer pairs moves with each of them; that of the other, which can have any
    # number, moves once, to where its pairs meet
    a_moves = F.col("n_a") <= F.col("n_b")
    ways = pairs.select("a", "b").join(n_a, "a").join(n_b, "b").select(
        "a", "b", F.when(a_moves, F.col("a")).otherwise(F.col("b")).alias("leaf"),
        F.when(a_moves, F.col("b")).otherwise(F.col("a")).alias("hub"),
    )
    both = ways.join(texts.select(F.col("id").alias("leaf"), F.col("text").alias("text_leaf")), "leaf").join(
        texts.select(F.col("id").alias("hub"), F.col("text").alias("text_hub")), "hub"
    )
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict = {}
        held = 0

        def set_of(i, text: bytes | None) -> np.ndarray:  # an id comes in many pairs
            nonlocal held
            if i not in sets:
                if held > CACHED_HASHES:
                    sets.clear()
                    held = 0
                sets[i] = shingle_set(text, words)
                held += len(sets[i])
            return sets[i]

        for whole in batches:
            for batch in common.slices(whole):
                keep = []
                ids = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                texts = zip(common.binaries(batch.column(2)), common.binaries(batch.column(3)))
                for (i, j), (x, y) in zip(ids, texts):
                    s, t = set_of(i, x), set_of(j, y)
                    inter = int((s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t).sum()) if len(s) else 0
                    keep.append(100 * inter >= percent * (len(s) + len(t) - inter))
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    out = both.select("leaf", "hub", "text_leaf", "text_hub").mapInArrow(run, f"a {kind}, b {kind}")
    out = out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return out.distinct().checkpoint()


def clusters(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 80, hot: int = HOT
) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id that links lead to)."""
    if percent < 80:
        raise ValueError("the signature's parameters hold for a similarity of 0.8 or more")
    spark = docs.sparkSession
    common.prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    sig = signatures(docs, id_col, text_col, words).checkpoint()
    nodes = (
        sig.where("n > 0 and id is not null")
        .groupBy("set_key")
        .agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("posted").alias("posted"),
             F.first("sketch").alias("sketch"))
    )
    copies = nodes.select("set_key", F.col("id").alias("node"))
    # one node for each id, should an id occur with different texts
    nodes = nodes.drop("set_key").checkpoint()
    posted = nodes.select("id", F.explode("posted").alias("value"))

    # first round: a forest
    shared = posted.groupBy("value").agg(F.count("*").alias("size")).where("size > 1")
    salt = F.pmod(F.xxhash64("id", "value"), F.ceil(F.col("size") / hot)).alias("salt")
    lists = posted.join(shared, "value").select("id", "value", salt).join(nodes.drop("posted"), "id")
    pairs = _candidates(lists.select("value", "salt", "id", "n", "sketch"), ["value", "salt"], _forest, kind)
    same_id = nodes.sparkSession.createDataFrame([], f"a {kind}, b {kind}")
    links = confirm(docs, pairs.checkpoint(), id_col, text_col, words, percent).union(same_id)
    found = components(links)

    # second round: what is left between components
    labelled = (
        nodes.join(found.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
        .checkpoint()
    )

    def mixed(rows: DataFrame, keys: list[str]) -> DataFrame:
        lists = rows.groupBy(*keys).agg(
            F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")
        )
        return lists.where("lo <> hi").drop("lo", "hi")

    value = labelled.select("id", "component", F.explode("posted").alias("value"))
    value = value.join(mixed(value, ["value"]), "value").checkpoint()
    # few are left: they get long sketches, which tell pairs below the similarity from those above
    open_ = value.select("id").distinct()
    fine_sketch = fine_sketches(texts_of(docs, open_, id_col, text_col), words).dropDuplicates(["id"])
    payload = labelled.select("id", "n", "component").join(fine_sketch, "id").checkpoint()
    plain = value.where(F.col("size") <= hot).select("value", "id").join(payload, "id")
    rest = _candidates(plain.select("value", "id", "n", "sketch", "component"), ["value"], _across, kind)
    hot_lists = value.where(F.col("size") > hot).select("id", "component", "value")
    if not hot_lists.isEmpty():
        fine = (
            hot_lists.join(labelled.select("id", F.explode("posted").alias("second")), "id")
            .where("second <> value")
            .select("id", "component", F.xxhash64(F.least("value", "second"), F.greatest("value", "second")).alias("value"))
            .distinct()
        )
        fine = fine.join(mixed(fine, ["value"]), "value")
        n_blocks = F.greatest(F.lit(1), F.ceil(2 * F.col("size") / hot)).cast("int")
        fine = fine.withColumn("blocks", n_blocks).withColumn(
            "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        )
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        fine = fine.select("id", "value", "block", other)
        fine = fine.select(
            "id", "value", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")
        ).join(payload, "id")
        cols = ["value", "x", "y", "id", "n", "sketch", "component", "block"]
        rest = rest.union(_candidates(fine.select(*cols), ["value", "x", "y"], _across, kind)).distinct()
    rest = rest.checkpoint()
    if not rest.isEmpty():
        links = links.union(confirm(docs, rest, id_col, text_col, words, percent))
        found = components(links)

    groups = copies.join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("root"))
    return sig.join(groups, "set_key", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component_id"),
    )


def _few(ids: DataFrame) -> DataFrame:
    """Broadcast a column of ids if its bytes are few enough."""
    ids = ids.checkpoint()
    return common.broadcast_if_small(ids, F.octet_length(F.col(ids.columns[0]).cast("string")))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 80):
    """One document of each component (the one of the smallest id), with all columns; rows that repeat an
    id leave one."""
    found = clusters(docs, id_col=id_col, text_col=text_col, words=words, percent=percent)
    gone, twice = common.free_name(docs, "id_gone"), common.free_name(docs, "id_twice")
    me = F.col(f"`{id_col}`")
    found = found.select(F.col(id_col).alias("id"), "component_id").checkpoint()
    out = docs.join(_few(found.where("id <> component_id").select(F.col("id").alias(gone)).distinct()),
                    me == F.col(gone), "left_anti")
    repeats = found.where("id = component_id").groupBy("id").count().where("count > 1").select(F.col("id").alias(twice))
    repeats = _few(repeats)
    if repeats.isEmpty():
        return out
    again = out.join(repeats, me == F.col(twice), "left_semi").dropDuplicates([id_col])
    return out.join(repeats, me == F.col(twice), "left_anti").union(again)


def op3(spark, sf_dir: str) -> DataFrame:
    out = clusters(common.table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ')
                               ELSE array_to_string(ws[i : i + 3], ' ') END AS g
  FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) AS r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.a = d.doc_id
"""
