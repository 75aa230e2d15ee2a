"""Token counts through an exact histogram of encoded lengths.

Documents are encoded and aggregated by (group, encoded length).  Everything that a
choice of context limit asks for follows from the histogram by suffix sums: how many
documents reach a length, how many tokens they hold, and the tokens that remain if each
document is cut at that length.

The histogram has one row per length that occurs, far fewer than documents, but no bound:
suffix sums run in two levels, within buckets of ``BUCKET`` lengths and over the totals
of the buckets, so no task holds all lengths.

Texts are encoded once: the histogram is checkpointed before its two levels are summed.

Edge cases: null and empty text has length 0; a null group is a group of its own; an
empty table has an empty histogram; repeated rows count each; very long texts are encoded
whole; columns of any other name play no part, and key columns may have any name but those of
the result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, common

BUCKET = 4096


def token_lengths(docs: DataFrame, path: str, pattern: str, *, keys: list[str], text_col: str = "text") -> DataFrame:
    """The key columns and ``n_tokens`` of each document."""
    common.prepare(docs.sparkSession)
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = bpe.codec(path, pattern)
        n = [len(c.encode(t)) if t else 0 for t in batch.column(len(keys)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*keys, "n_tokens"])

    return common.map_batches(docs, [*keys, text_col], rows, (kinds + ", " if kinds else "") + "n_tokens bigint")


def histogram(lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Documents by group and length, written down, so that what follows doesn't encode again."""
    return lengths.groupBy(*[F.col(f"`{k}`") for k in keys], "n_tokens").agg(F.count("*").alias("n_docs")).checkpoint()


def suffix_sums(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and length L: documents and tokens at L, at L or more, the tokens left after cutting
    at L, and the share of documents that are no longer than L (so each quantile is a lookup)."""
    own = [f"key_{i}" for i in range(len(keys))]
    h = hist.select(
        *[F.col(f"`{k}`").alias(o) for k, o in zip(keys, own)], "n_tokens", "n_docs",
        F.floor(F.col("n_tokens") / BUCKET).alias("bucket"), (F.col("n_docs") * F.col("n_tokens")).alias("tokens"),
    )
    inner = Window.partitionBy(*own, "bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(*own).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*own)
    totals = h.groupBy(*own, "bucket").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    totals = totals.select(
        *[F.col(o).alias(f"of_{o}") for o in own],
        F.col("bucket").alias("of_bucket"),
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(whole).alias("docs_all"),
        F.sum("t").over(whole).alias("tokens_all"),
    )
    on = F.col("bucket") == F.col("of_bucket")
    for o in own:
        on = on & F.col(o).eqNullSafe(F.col(f"of_{o}"))
    out = (
        h.withColumn("docs_in", F.sum("n_docs").over(inner))
        .withColumn("tokens_in", F.sum("tokens").over(inner))
        .join(totals, on)
    )
    ge, tokens_ge = F.col("docs_in") + F.col("docs_above"), F.col("tokens_in") + F.col("tokens_above")
    return out.select(
        *[F.col(o).alias(k) for k, o in zip(keys, own)],
        "n_tokens",
        "n_docs",
        F.col("tokens").alias("tokens_at"),
        ge.alias("docs_ge"),
        tokens_ge.alias("tokens_ge"),
        (F.col("tokens_all") - tokens_ge + F.col("n_tokens") * ge).alias("truncated_total"),
        F.col("docs_all"),
        F.col("tokens_all"),
        ((F.col("docs_all") - ge + F.col("n_docs")) / F.col("docs_all")).alias("share_le"),
    )


def truncated_totals(sums: DataFrame, keys: list[str], limits: list[int]) -> DataFrame:
    """Tokens left for arbitrary context limits: the nearest length at or above a limit answers it."""
    parts = []
    for limit in limits:
        at = F.col("n_tokens") >= limit
        parts.append(
            sums.groupBy(*keys).agg(
                F.max("tokens_all").alias("all"),
                F.min_by(F.when(at, F.col("tokens_ge")), F.when(at, F.col("n_tokens"))).alias("t"),
                F.min_by(F.when(at, F.col("docs_ge")), F.when(at, F.col("n_tokens"))).alias("d"),
            ).select(
                *keys,
                F.lit(limit).cast("bigint").alias("context_limit"),
                (F.col("all") - F.coalesce("t", F.lit(0)) + limit * F.coalesce("d", F.lit(0))).alias("tokens_left"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def quantiles(sums: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """The smallest length that at least the given share of documents don't exceed."""
    return sums.groupBy(*keys).agg(
        *[F.min(F.when(F.col("share_le") >= q, F.col("n_tokens"))).alias(f"q{q:g}".replace(".", "_")) for q in shares]
    )


def op6(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("lang", "text")
    lengths = token_lengths(docs, *bpe.public_vocabulary(), keys=["lang"])
    return suffix_sums(histogram(lengths, ["lang"]), ["lang"])
