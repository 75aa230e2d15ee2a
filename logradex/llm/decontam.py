"""Benchmark decontamination with a generalised suffix automaton.

The normalised benchmark items form one generalised suffix automaton over words.
Training text is streamed through it; the length of the longest suffix that the
automaton matches is tracked at each word.  Where it reaches the window, the words
of the window are hit.  Items shorter than the window are one window as a whole.

Only stretches of text that could match are streamed: a window of w words holds
w - 1 consecutive word pairs of the benchmark, so a bitmap over hashed pairs (no
false negatives) discards the rest in bulk.

The benchmark is a stated query set.  It is shipped in blocks of at most
``block_words`` words, so a worker's memory is bounded whatever its size; with more
than one block, rows are numbered, each block passes over all of them in turn, and the
hits are merged by row before anything is counted, cut or dropped, so the number of
blocks doesn't show in any result.

Edge cases: null or empty text has no words; null or empty items match nothing;
a repeated item id counts once; a null item id is written as an empty string;
an empty benchmark hits nothing; an empty table gives an empty result; rows of one id, and
rows without an id, are judged each by itself; very long texts are read whole; columns of
any other name stay as they are.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 8
BLOCK_WORDS = 200_000
MAX_COVERAGE = 0.5

_KEEP = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_FOLD = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b) if ((b + 32 if 0x41 <= b <= 0x5A else b) in _KEEP) else 0x20
    for b in range(256)
)
_PAIR_BITS = 22


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case A-Z and split at every ASCII character that is no letter or digit."""
    return text.translate(_FOLD).split() if text else []


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets [start, end) of the words of a UTF-8 text."""
    flat = np.frombuffer(text.translate(_FOLD), np.uint8)
    inside = np.concatenate(([False], flat != 0x20, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


class SuffixAutomaton:
    """Generalised suffix automaton over items given as lists of word numbers."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.len: list[int] = [0]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, item: Iterable[int]) -> int:
        """Add an item; returns the state of the whole item."""
        last = 0
        for c in item:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
                continue
            cur = self._state(self.len[last] + 1, 0, {})
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p != -1:
                q = self.next[p][c]
                self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
            last = cur
        return last

    def lengths(self, stream: list[int]) -> Iterator[tuple[int, int]]:
        """State and longest matched length after each symbol."""
        nxt, link, size = self.next, self.link, self.len
        state = length = 0
        for c in stream:
            while state and c not in nxt[state]:
                state = link[state]
                length = size[state]
            to = nxt[state].get(c)
            if to is None:
                state = length = 0
            else:
                state = to
                length += 1
            yield state, length


class Matcher:
    """One block of the benchmark, ready to scan documents."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.sam = SuffixAutomaton()
        self.ids: list[str] = []
        self.owners: dict[tuple[int, ...], set[int]] = {}
        short: list[tuple[tuple[int, ...], int]] = []
        least = window
        pairs: set[tuple[int, int]] = set()
        for item, text in items:
            seq = tuple(self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text))
            if not seq:
                continue
            n = len(self.ids)
            self.ids.append(item)
            self.sam.add(seq)
            pairs.update(zip(seq, seq[1:]))
            if len(seq) < window:
                short.append((seq, n))
                least = min(least, len(seq))
            for i in range(max(1, len(seq) - window + 1)):
                self.owners.setdefault(seq[i : i + window], set()).add(n)
        self.least = least
        self.short_lengths = sorted({len(s) for s, _ in short})
        self.pairs = np.zeros(1 << _PAIR_BITS, bool)
        if pairs:
            a = np.array(list(pairs), np.int64)
            self.pairs[self._slot(a[:, 0], a[:, 1])] = True

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 0x9E3779B1 + b * 0x85EBCA6B) ^ (a >> 3)) & ((1 << _PAIR_BITS) - 1)

    def _stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Word ranges [from, to) that could hold a window."""
        if self.least == 1:
            ok = ids >= 0
            need, more = 1, 0
        else:
            known = ids >= 0
            ok = known[:-1] & known[1:]
            at = np.flatnonzero(ok)
            if len(at) < self.least - 1:
                return []
            ok[at] = self.pairs[self._slot(ids[at].astype(np.int64), ids[at + 1].astype(np.int64))]
            need, more = self.least - 1, 1
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= need
        return list(zip(begin[long].tolist(), (end[long] + more).tolist()))

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Words in the text, merged hit ranges of word numbers [from, to), items found."""
        words = words_of(text)
        n = len(words)
        if n < self.least or not self.ids:
            return n, [], set()
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, n)
        hits: list[tuple[int, int]] = []
        found: set[int] = set()
        w = self.window
        for begin, end in self._stretches(ids):
            part = ids[begin:end].tolist()
            for at, (_, length) in enumerate(self.sam.lengths(part), 1):
                for size in (*[s for s in self.short_lengths if s <= length], *((w,) if length >= w else ())):
                    owners = self.owners.get(tuple(part[at - size : at]))
                    if owners:
                        found |= owners
                        a, b = begin + at - size, begin + at
                        if hits and a <= hits[-1][1]:
                            while hits and a <= hits[-1][1]:
                                a = min(a, hits.pop()[0])
                        hits.append((a, b))
        return n, hits, found


_MATCHERS: dict[tuple[str, int], Matcher] = {}


def _matcher(block: tuple[str, list[tuple[str, bytes]]], window: int) -> Matcher:
    """A worker builds each block's automaton once and keeps the last one."""
    key = block[0], window
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(block[1], window)
    return _MATCHERS[key]


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list]:
    """The items in blocks of at most ``block_words`` words (or one longer item), fetched one block at a time."""
    rows = benchmark.select(
        F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"),
    )
    block: list[tuple[str, bytes]] = []
    size = 0
    for row in rows.toLocalIterator():
        text = bytes(row.text)
        n = len(words_of(text))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((row.item, text))
        size += n
    if block:
        yield block


def _shipped(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[Broadcast]:
    """Each block under a name of its own, one at a time; there is one at least."""
    sc = benchmark.sparkSession.sparkContext
    blocks = benchmark_blocks(benchmark, item_col, text_col, block_words)
    for block in chain([next(blocks, [])], blocks):
        yield sc.broadcast((uuid.uuid4().hex, block))


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per row: id, n_words, n_hit, items (sorted), spans (word ranges, merged).

    With several blocks, rows are numbered and the blocks' hits are merged by number, so ids may be null
    or repeat.
    """
    common.prepare(docs.sparkSession)
    shipped = _shipped(benchmark, item_col, item_text_col, block_words)
    first = next(shipped)
    second = next(shipped, None)
    if second is None:
        return _scan(docs, first, id_col, text_col, window)
    row = common.free_name(docs, "row")
    # row numbers must not change between the reads
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.monotonically_increasing_id().alias(row)).checkpoint()
    ids = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(row).alias("number"))
    found = _all_blocks(rows, chain([first, second], shipped), row, text_col, window, every=True)
    return ids.join(found.withColumnRenamed("id", "number"), "number").drop("number")


def _all_blocks(
    docs: DataFrame, shipped: Iterable[Broadcast], row: str, text_col: str, window: int, every: bool = False
) -> DataFrame:
    """The hits of all blocks by row number, of which an executor holds one block at a time; rows without a
    hit only if ``every`` row is asked for."""
    found = None
    for block in shipped:
        out = _scan(docs, block, row, text_col, window)
        if found is not None or not every:
            out = out.where("n_hit > 0")
        out = out.checkpoint()
        block.destroy()
        found = out if found is None else found.union(out)
    merged = found.groupBy("id").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [merge_ranges([(x["a"], x["b"]) for x in s]) for s in batch.column(3).to_pylist()]
        n_hit = [sum(b - a for a, b in s) for s in spans]
        cols = [batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), batch.column(2), _span_array(spans)]
        return pa.RecordBatch.from_arrays(cols, _NAMES)

    return common.map_batches(merged, ["id", "n_words", "items", "spans"], rows, f"id bigint, {_FIELDS}")


_NAMES = ["id", "n_words", "n_hit", "items", "spans"]
_FIELDS = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<a:bigint,b:bigint>>"


def _span_array(spans: list[list[tuple[int, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    return pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], kind)


def _scan(docs: DataFrame, shipped: Broadcast, id_col: str, text_col: str, window: int) -> DataFrame:
    """The hits of one block, a row for each document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = _matcher(shipped.value, window)
        n_words, n_hit, items, spans = [], [], [], []
        for text in common.binaries(batch.column(1)):
            n, hits, found = m.scan(text)
            n_words.append(n)
            n_hit.append(sum(b - a for a, b in hits))
            items.append(sorted({m.ids[i] for i in found}))
            spans.append(hits)
        cols = [
            batch.column(0),
            pa.array(n_words, pa.int64()),
            pa.array(n_hit, pa.int64()),
            pa.array(items, pa.list_(pa.string())),
            _span_array(spans),
        ]
        return pa.RecordBatch.from_arrays(cols, _NAMES)

    return common.map_batches(docs, [id_col, text_col], rows, f"id {kind}, {_FIELDS}")


def merge_ranges(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of sorted [a, b) ranges."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def without(text: bytes, hits: list[tuple[int, int]]) -> bytes:
    """The text without the words of the hit ranges and what lies between them."""
    starts, ends = word_spans(text)
    out, at = [], 0
    for a, b in hits:
        out.append(text[at : starts[a]])
        at = int(ends[b - 1])
    out.append(text[at:])
    return b"".join(out)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_coverage: float = MAX_COVERAGE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Remove matched spans of at least ``window`` words; drop documents of which such spans cover more
    than ``max_coverage`` of the words.  All other columns stay as they are.

    The result doesn't depend on ``block_words``: see ``_in_rounds``.
    """
    common.prepare(docs.sparkSession)

    def blocks() -> Iterator[Broadcast]:
        return _shipped(benchmark, item_col, item_text_col, block_words)

    shipped, second = (list(islice(blocks(), 2)) + [None])[:2]
    if second is not None:
        return _in_rounds(docs, blocks, text_col, window, max_coverage)
    at = docs.columns.index(text_col)

    def run(batches):
        m = _matcher(shipped.value, window)
        for whole in batches:
            for batch in common.slices(whole):
                keep, texts = [], []
                for text in common.binaries(batch.column(at)):
                    total, hits, _ = m.scan(text)
                    covered = 0
                    while hits:  # what a cut joins may match again
                        covered += sum(b - a for a, b in hits)
                        text = without(text, hits)
                        _, hits, _ = m.scan(text)
                    keep.append(covered <= max_coverage * total)
                    texts.append(text)
                column = pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)
                yield batch.set_column(at, batch.schema.field(at), column).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _in_rounds(
    docs: DataFrame, blocks: Callable[[], Iterator[Broadcast]], text_col: str, window: int, max_coverage: float
) -> DataFrame:
    """The same for a benchmark of several blocks, of which a worker holds one at a time.

    In each round all blocks look at the same text and their hits are cut together; what was cut goes
    through another round, until no block hits.  Coverage counts the words cut in all rounds, of the
    words that the document had at first.
    """
    row, total, covered, hit = (common.free_name(docs, x) for x in ("row", "total", "covered", "hit"))
    zero = F.lit(0).cast("bigint")
    # row numbers must not change between the reads
    left = docs.select(
        "*", F.monotonically_increasing_id().alias(row), zero.alias(total), zero.alias(covered)
    ).checkpoint()
    schema = left.schema

    def cut(batches):
        for whole in batches:
            for batch in common.slices(whole):
                at = {name: i for i, name in enumerate(batch.schema.names)}
                texts, totals, counts = [], [], []
                found = batch.column(at[hit]).to_pylist()
                for text, n, c, h in zip(
                    common.binaries(batch.column(at[text_col])), batch.column(at[total]).to_pylist(),
                    batch.column(at[covered]).to_pylist(), found,
                ):
                    texts.append(without(text, [(s["a"], s["b"]) for s in h["spans"]]))
                    totals.append(n or h["n_words"])
                    counts.append(c + h["n_hit"])
                new = {text_col: pa.array(texts, pa.binary()), total: pa.array(totals), covered: pa.array(counts)}
                fields = [batch.schema.field(at[name]) for name in schema.names]
                columns = [new[f.name].cast(f.type) if f.name in new else batch.column(at[f.name]) for f in fields]
                keep = [c <= max_coverage * n for n, c in zip(totals, counts)]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields)).filter(pa.array(keep, pa.bool_()))

    names = [F.col(f"`{c}`") for c in docs.columns]
    out = None
    while True:
        found = _all_blocks(left, blocks(), row, text_col, window)
        found = found.select(F.col("id").alias(row), F.struct("n_words", "n_hit", "spans").alias(hit)).checkpoint()
        settled = left.join(found, row, "left_anti").select(*names)
        out = settled if out is None else out.union(settled)
        if found.isEmpty():
            return out
        left = left.join(found, row).mapInArrow(cut, schema).checkpoint()


def verdicts(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts of ``find_hits``, the digest of the items, and whether two items or more occur."""
    return found.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    """Documents against the benchmark, one row each."""
    docs = common.table(spark, sf_dir, "documents")
    return verdicts(find_hits(docs, common.table(spark, sf_dir, "benchmark")))


def brute_force(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> dict:
    """The contract read literally, for tests."""
    words = words_of(None if text is None else text.encode())
    hit: set[int] = set()
    found: set[str] = set()
    for item, body in items:
        seq = words_of(None if body is None else body.encode())
        if not seq:
            continue
        size = min(window, len(seq))
        for i in range(len(seq) - size + 1):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == seq[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(item)
    ids = ",".join(sorted(found, key=lambda s: s.encode()))
    return {
        "n_words": len(words),
        "n_hit": len(hit),
        "n_items": len(found),
        "items_sha256": hashlib.sha256(ids.encode()).hexdigest(),
        "contaminated": len(found) >= 2,
    }
