"""URL filters probed in a sorted array of digests.

Rules are compiled into index files: the 64-bit xxhash keys of their strings, sorted,
then the offsets of the strings, the verdicts, and the strings themselves.  The files are
shipped with the job and memory-mapped by the workers, so probing takes no heap whatever
the number of rules.  A batch of urls is probed at once: each url gives the key of every
rule that could fit it (a suffix of its host and a prefix of its path, at the lengths
that occur among the rules), the keys are looked up by one vectorised binary search, and
a hit counts only if the stored string equals the probed one.

A rule is ``host/path``: it fits a url whose host is the rule's host or a subdomain of
it, and whose path starts with the rule's path.  The longest fitting rule decides; of two
of one length (different hosts or repeated with both verdicts) ``block`` decides, then
the smaller string.  A url that no rule fits is allowed.

Edge cases: a null url or one without ``://`` has an empty host and path and fits no rule;
no rules at all means all is allowed; repeated rows and rows without an id are judged each; very long urls
are probed at the lengths of the rules alone; an empty table gives an empty result; columns of any other
name, ``host`` and ``rule`` among them, play no part.
"""

from __future__ import annotations

import mmap
import os
import re
import struct
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Rules that the driver holds at once while it compiles them.
SHARD_RULES = 500_000
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    m = _URL.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


class Index:
    """One memory-mapped shard."""

    HEAD = struct.Struct("<8sQQ")

    @staticmethod
    def build(rules: Iterable[tuple[str, str]]) -> bytes:
        merged: dict[str, bool] = {}
        for verdict, rule in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"a rule allows or blocks, not {verdict!r}")
            host, slash, path = rule.partition("/")
            text = host.translate(_LOWER) + slash + path
            merged[text] = merged.get(text, False) or verdict == "block"
        texts = [t.encode() for t in merged]
        keys = np.fromiter(map(xxhash.xxh64_intdigest, texts), "<u8", len(texts))
        order = np.argsort(keys, kind="stable")
        texts = [texts[i] for i in order]
        blocked = np.fromiter(merged.values(), np.uint8, len(texts))[order]
        offsets = np.zeros(len(texts) + 1, "<u8")
        offsets[1:] = np.cumsum([len(t) for t in texts]) if texts else []
        # lengths at which hosts and paths of the rules end, to limit the probes
        lengths = sorted({len(t.decode().partition("/")[2]) + 1 if b"/" in t else 0 for t in texts})
        labels = max((t.decode().partition("/")[0].count(".") + 1 for t in texts), default=0)
        tail = np.array([labels, *lengths], "<u4")
        return b"".join(
            [Index.HEAD.pack(b"urlrules", len(texts), len(tail)), keys[order].tobytes(), offsets.tobytes(),
             tail.tobytes(), blocked.tobytes(), b"".join(texts)]
        )

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        _, n, m = self.HEAD.unpack_from(self.map, 0)
        at = self.HEAD.size
        self.keys = np.frombuffer(self.map, "<u8", n, at)
        at += 8 * n
        self.offsets = np.frombuffer(self.map, "<u8", n + 1, at)
        at += 8 * (n + 1)
        self.labels, *self.path_lengths = np.frombuffer(self.map, "<u4", m, at).tolist()
        at += 4 * m
        self.blocked = np.frombuffer(self.map, np.uint8, n, at)
        self.text_at = at + n

    def probe(self, keys: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Place of each text among the rules, or -1."""
        n = len(self.keys)
        found = np.full(len(keys), -1, np.int64)
        if not n or not len(keys):
            return found
        at = np.searchsorted(self.keys, keys)
        inside = at < n
        live = np.flatnonzero(inside)
        live = live[self.keys[at[live]] == keys[live]]
        for i in live.tolist():
            k = int(at[i])
            while k < n and self.keys[k] == keys[i]:  # digests can collide
                a, b = int(self.offsets[k]), int(self.offsets[k + 1])
                if self.map[self.text_at + a : self.text_at + b] == texts[i]:
                    found[i] = k
                    break
                k += 1
        return found

    def text(self, k: int) -> str:
        a, b = int(self.offsets[k]), int(self.offsets[k + 1])
        return self.map[self.text_at + a : self.text_at + b].decode()


_OPEN: dict[str, Index] = {}


def _index(name: str) -> Index:
    path = SparkFiles.get(name)
    if path not in _OPEN:
        _OPEN[path] = Index(path)
    return _OPEN[path]


def ship(spark: SparkSession, data: bytes) -> str:
    """Write a file into the shared folder and register it with the job; returns its name."""
    folder = common.shared_folder(spark)
    name = f"urlrules-{uuid.uuid4().hex}.idx"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder, name)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path)
    try:
        for at in range(0, len(data), 8 << 20):
            out.write(data[at : at + (8 << 20)])
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def compile_rules(spark: SparkSession, rules: Iterable[tuple[str, str]] | DataFrame, shard_rules: int = SHARD_RULES):
    """Index files of at most ``shard_rules`` rules each, built one at a time from (verdict, rule) rows."""
    source = rules.select("verdict", "rule").toLocalIterator() if isinstance(rules, DataFrame) else rules
    names, part = [], []
    for verdict, rule in source:
        part.append((verdict, rule))
        if len(part) == shard_rules:
            names.append(ship(spark, Index.build(part)))
            part = []
    if part or not names:
        names.append(ship(spark, Index.build(part)))
    return names


def candidates(host: str, path: str, path_lengths: list[int], labels: int) -> list[str]:
    """Every rule string that could fit, at the path lengths given (0: a rule without a slash) and up to so
    many labels of the host."""
    if not host:
        return []
    last = host.rsplit(".", labels)
    # the first part holds what is before the labels, or is the first label of a short host
    suffixes = [".".join(last[i:]) for i in range(1 if len(last) > labels else 0, len(last))]
    tails = [path[:n] for n in path_lengths if n <= len(path)]
    return [h + t for h in suffixes for t in tails]


def judge(urls: DataFrame, rules, *, id_col: str = "page_id", url_col: str = "url",
          shard_rules: int = SHARD_RULES) -> DataFrame:
    """Per url: id, host, path, the deciding rule (or null) and the verdict."""
    spark = urls.sparkSession
    common.prepare(spark)
    names = compile_rules(spark, rules, shard_rules)
    kind = urls.schema[id_col].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [split_url(u) for u in batch.column(1).to_pylist()]
        best: list[tuple | None] = [None] * len(parts)
        for name in names:
            index = _index(name)
            owner, texts = [], []
            for i, (host, path) in enumerate(parts):
                for c in candidates(host, path, index.path_lengths, index.labels):
                    owner.append(i)
                    texts.append(c.encode())
            keys = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
            found = index.probe(keys, texts)
            for at in np.flatnonzero(found >= 0).tolist():
                text = index.text(int(found[at]))
                # longest first, then block, then the smaller string
                order = (-len(text), 1 - int(index.blocked[found[at]]), text)
                if best[owner[at]] is None or order < best[owner[at]]:
                    best[owner[at]] = order
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([h for h, _ in parts], pa.string()),
                pa.array([p for _, p in parts], pa.string()),
                pa.array([b and b[2] for b in best], pa.string()),
                pa.array(["block" if b and not b[1] else "allow" for b in best], pa.string()),
            ],
            [id_col, "host", "path", "rule", "verdict"],
        )

    fields = f"`{id_col}` {kind}, host string, path string, rule string, verdict string"
    return common.map_batches(urls, [id_col, url_col], rows, fields)


def op2(spark, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"), RULES)


SQL = r"""
WITH cut AS (
  SELECT page_id,
         CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
rules(verdict, h, p) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fit AS (
  SELECT page_id, h || p AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, verdict DESC, h || p) AS k
  FROM (SELECT DISTINCT page_id, host, path FROM parts) u JOIN rules r
    ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fit f ON p.page_id = f.page_id AND f.k = 1
"""
