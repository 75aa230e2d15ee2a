"""Document fingerprints of closed syncmers, in DataFrame functions alone.

A text is read as units: words between white space, and single characters of scripts that don't part
words (Han, kana, Thai, ...).  A run of K units
is an anchor if, among the hashes of its inner runs of S units, the smallest stands at either
end.  Whether a run is an anchor depends on the run alone, so anchors survive whatever happens
elsewhere in the text, and any K - S + 1 neighbouring runs hold at least one (ties aside, which
only add anchors).  The same holds for every length of text; one of fewer than K units is one
anchor as a whole.

A fingerprint is the anchors' 64-bit hashes in the order of their places.  The likeness of two
fingerprints matches anchors by place: of the hashes that both have, taken by the first place of
each in the one, those count whose first place in the other comes after that of the one before.
It is 2 * those / all, over distinct hashes, from 0 to 1.

Since anchors are context-free, those of an edited text are those of the original up to the
edit, and only the rest is searched again.

``with_next`` gives each document its successor by id without a global sort in one task: ids are
cut into ranges of about as many bytes each, texts move once, to their range, and the first row of
each range also goes to the range before.  Segments between percentiles of the ids have their
bytes counted, and are cut evenly by id; what holds a single id (or none), however many rows it has,
is cut by a hash of the text.

Edge cases: null text is empty; an empty text has an empty fingerprint, which is alike to
1 to another empty one and 0 to all others; null ids come first, rows of one id are in the order of
a hash of their texts; the successor of the last row is the first; a single row is its own
successor; very long texts are read whole; an empty table gives an empty result; columns of any other
name stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

K, S = 8, 2
_SPACE = " \\t\\n\\x0B\\f\\r"
_ALONE = "".join(f"{chr(a)}-{chr(b)}" for a, b in (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF),
))
UNIT = f"[{_ALONE}]|[^{_SPACE}{_ALONE}]+"

RANGE_BYTES = 16 << 20
RANGES_PER_TASK = 8
SEGMENTS = 256


def _bound(v: Column, f: Callable[[Column], Column]) -> Column:
    """f(v) with v evaluated once, not once for each use or element."""
    return F.element_at(F.transform(F.array(v), lambda x: f(x)), 1)


def units(text: Column) -> Column:
    """Hashes of the units of a text."""
    # a split is quicker, and gives the same where no character stands alone
    words = F.filter(F.split(text, f"[{_SPACE}]+"), lambda w: w != "")
    found = F.when(text.rlike(f"[{_ALONE}]"), F.regexp_extract_all(text, F.lit(f"({UNIT})"), F.lit(1))).otherwise(words)
    return F.transform(found, lambda u: F.xxhash64(u))


def anchors(h: Column) -> Column:
    """Places (from 0) and hashes of the closed syncmers of an array of hashes, evaluated once."""
    empty = F.array().cast("array<struct<at:int,hash:bigint>>")
    whole = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(h).alias("hash")))
    return F.when(F.size(h) == 0, empty).when(F.size(h) < K, whole).otherwise(
        _bound(_inner(h), lambda inner: _chosen(h, inner, K - S + 1))
    )


def _inner(h: Column) -> Column:
    """Hashes of the runs of S units, the last ones cut short (they are in no window)."""
    return F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, S)]))


def _chosen(h: Column, inner: Column, w: int) -> Column:
    def at_edge(i: Column) -> Column:
        low = F.array_min(F.slice(inner, i + 1, w))
        return _bound(low, lambda m: (m == F.get(inner, i)) | (m == F.get(inner, i + (w - 1))))

    places = F.filter(F.sequence(F.lit(0), F.size(h) - K), at_edge)
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(h, i + 1, K)).alias("hash")))


def fingerprint(text: Column) -> Column:
    """The anchors of a text, in order."""
    return _bound(units(text), anchors)


def fingerprint_of_edit(old: Column, old_units: Column, new_units: Column) -> Column:
    """``fingerprint`` of the new units, given the anchors and units of the old ones.

    Runs within the leading units that both have are anchors in both or neither.
    """

    def of(x: Column) -> Column:
        a, b = x["a"], x["b"]
        shared = F.least(F.size(a), F.size(b))
        differ = F.filter(F.sequence(F.lit(1), F.greatest(shared, F.lit(1))), lambda i: ~F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)))
        same = F.coalesce(F.get(differ, F.lit(0)) - 1, shared)
        # places from here on can see what differs; of a text of fewer than K units nothing is kept
        begin = F.when(F.size(a) < K, 0).otherwise(F.greatest(same - K + 1, F.lit(0)))
        begin = F.least(begin, F.greatest(F.size(b) - K, F.lit(0)))
        return _bound(begin, lambda n: F.concat(
            F.filter(old, lambda e: e["at"] < n),
            F.transform(
                _bound(F.slice(b, n + 1, F.greatest(F.size(b) - n, F.lit(0))), anchors),
                lambda e: F.struct((e["at"] + n).alias("at"), e["hash"].alias("hash")),
            ),
        ))

    return _bound(F.struct(old_units.alias("a"), new_units.alias("b")), of)


def as_text(fp: Column) -> Column:
    """Anchors in the order of their places, 16 hex digits each."""
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x["hash"]), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1."""

    def places(v: Column, side: int) -> Column:
        # of equal hashes the first place in a stands last, that in b first, so the two are neighbours
        return F.transform(v, lambda e, i: F.struct(e["hash"].alias("h"), F.lit(side).alias("s"), (i if side else -i).alias("i")))

    def matched(x: Column) -> Column:
        def both(e: Column, i: Column) -> Column:
            n = F.get(x, i + 1)
            return F.when((e["s"] == 0) & (n["s"] == 1) & (n["h"] == e["h"]), F.struct((-e["i"]).alias("a"), n["i"].alias("b")))

        return F.sort_array(F.filter(F.transform(x, both), lambda p: p.isNotNull()))

    def in_order(p: Column) -> Column:
        return F.size(F.filter(F.transform(p, lambda e, i: F.coalesce(e["b"] > F.get(p, i - 1)["b"], i == 0)), lambda ok: ok))

    kinds = F.size(F.array_distinct(F.transform(a, lambda e: e["hash"]))) + F.size(F.array_distinct(F.transform(b, lambda e: e["hash"])))
    pairs = _bound(F.sort_array(F.concat(places(a, 0), places(b, 1))), matched)
    return _bound(kinds, lambda n: F.when(n == 0, F.lit(1.0)).otherwise(2.0 * _bound(pairs, in_order) / n))


def _range_of(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """The range of a row, rising with the id (null first) and, within one id, with a hash of the text."""
    v, text = F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`")
    shares = [i / SEGMENTS for i in range(SEGMENTS + 1)]
    cuts = docs.agg(F.percentile_approx(v, shares, 10_000)).first()[0] or []
    # an id that makes up a segment or more has one of its own
    hot = {x for x, y in zip(cuts, cuts[1:]) if x == y and x < (1 << 63) - 1}
    bounds = sorted({*cuts, *(x + 1 for x in hot)})
    low = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    # approximate percentiles can lie above the least id: what is below belongs to the first segment
    seg = F.when(v.isNull(), 0).otherwise(F.greatest(F.size(F.filter(low, lambda b: b <= v)), F.lit(1)))
    found = docs.groupBy(seg.alias("seg")).agg(F.sum(F.octet_length(text).cast("bigint") + 64)).collect()  # SEGMENTS or so
    size = {r[0]: r[1] for r in found}
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * RANGES_PER_TASK
    target = max(1, min(RANGE_BYTES, sum(size.values()) // parts))
    n = [max(1, -(-size.get(s, 0) // target)) for s in range(len(bounds) + 1)]
    start = [sum(n[:s]) for s in range(len(n))]
    widths = [1, *(min(b - a, 1 << 62) for a, b in zip(bounds, bounds[1:])), 1][: len(n)]
    hashed = F.xxhash64(text).cast("double") / float(1 << 64) + 0.5

    def longs(values: list[int]) -> Column:
        return F.array(*[F.lit(x).cast("bigint") for x in values])

    def inside(s: Column) -> Column:
        width, many = F.get(longs(widths), s), F.get(longs(n), s)
        least = F.get(low, s - 1)
        alone = F.when(v > least, 1.0).when(v < least, 0.0).otherwise(hashed)
        share = F.when(width == 1, alone).otherwise((v.cast("double") - least) / width)
        return F.get(longs(start), s) + F.greatest(F.lit(0), F.least(many - 1, F.floor(share * many)))

    return _bound(seg, inside)


def with_next(
    docs: DataFrame, carry: Callable[[DataFrame], DataFrame] = lambda d: d, ahead: tuple[str, ...] = (), *,
    id_col: str = "doc_id", text_col: str = "text", next_col: str = "next",
) -> DataFrame:
    """All rows with their columns and those that ``carry`` adds, and a struct of the text (null: empty) and the
    columns ``ahead`` of the row of the next id."""
    names = {x: common.free_name(docs, x) for x in ("range", "guest", "places", "first", "before", "r")}
    c = {x: F.col(n) for x, n in names.items()}
    me, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    ranged = docs.withColumn(names["range"], _range_of(docs.withColumn(text_col, text), id_col, text_col))
    firsts = ranged.groupBy(names["range"]).agg(F.min(me).alias(names["first"])).checkpoint()
    step, whole = Window.partitionBy(F.lit(0)).orderBy(names["range"]), Window.partitionBy(F.lit(0))
    firsts = firsts.select(
        c["range"].alias(names["r"]), names["first"],
        F.coalesce(F.lag(names["range"]).over(step), F.max(names["range"]).over(whole)).alias(names["before"]),
    )  # one row a range
    rows = ranged.join(common.broadcast_if_small(firsts, F.lit(24)), c["range"] == c["r"])
    here = F.struct(c["range"].alias("to"), F.lit(0).alias("guest"))
    guest = F.struct(c["before"].alias("to"), F.lit(1).alias("guest"))
    # of rows with the least id of a range, all are guests: which is the next is settled by the order there
    places = F.when(me.eqNullSafe(c["first"]), F.array(here, guest)).otherwise(F.array(here))
    rows = rows.select(*[F.col(f"`{x}`") for x in docs.columns], F.explode(places).alias(names["places"]))
    rows = rows.withColumns({names["range"]: c["places"]["to"], names["guest"]: c["places"]["guest"]}).drop(names["places"])
    rows = carry(rows.repartitionByRange(names["range"]))
    sequel = F.struct(text.alias("text"), *[F.col(f"`{x}`") for x in ahead])
    step = Window.partitionBy(names["range"]).orderBy(names["guest"], me.asc_nulls_first(), F.xxhash64(text), text)
    return rows.withColumn(next_col, F.lead(sequel).over(step)).where(c["guest"] == 0).drop(names["range"], names["guest"])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its fingerprint, that of the text whose last quarter is the beginning of the next document, and
    how alike its own is to that and to the next document's."""
    some = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def carry(rows: DataFrame) -> DataFrame:
        return rows.withColumn("units", units(F.col("text"))).withColumn("fp", _bound(F.col("units"), anchors))

    rows = with_next(some, carry, ("fp",))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next.text", F.lit(1), cut))
    rows = rows.withColumn("edited", edited)
    rows = rows.withColumn("edited_fp", fingerprint_of_edit(F.col("fp"), F.col("units"), units(F.col("edited"))))
    return rows.select(
        F.col("doc_id").alias(id_col),
        n.cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next.fp")).alias("near_next"),
    )


def op4(spark, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))
