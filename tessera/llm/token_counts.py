"""Exact token counts of a corpus for every context limit, from one histogram of encoded lengths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, checkpointed, keyed_text
from .tokens import encoder

#: Lengths in a block of the suffix sums.
BLOCK = 1_024


def lengths(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every whole text; null and empty texts have none."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        encode = encoder(tokenizer_path).encode
        for doc_id, text in rows:
            yield doc_id, len(encode(text)) // 4

    return arrow_rows(keyed_text(docs, id_col, text_col), "doc_id long, n_tokens long", run)


def histogram(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs): documents by encoded length. Null texts count as empty, repeated rows as often as they stand, ids don't matter."""
    return lengths(docs, tokenizer_path, id_col=id_col, text_col=text_col).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_limits(counts: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit, what the suffix sums of a histogram answer.

    Input (n_tokens, n_docs). Output per limit: n_tokens, n_docs (of this length), docs_fit and docs_cut (no longer,
    longer), tokens_kept (if every longer document is cut there), tokens_lost, tokens_fit (of documents that fit),
    share_fit (docs_fit of all: the quantile that this length is). Between two lengths that occur, docs_fit is
    that of the lower one and tokens_kept is linear. Sums run in blocks of lengths, then over the blocks' totals.
    An empty histogram gives no rows; a length that stands in several rows is several documents' length, so ties add up.
    The histogram is written to the checkpoint folder first, as it is read twice: documents are encoded once.
    """
    counts = checkpointed(counts.select("n_tokens", "n_docs"))
    blocks = counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    totals = blocks.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later = totals.select(
        "block",
        F.coalesce(F.sum("block_docs").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("block_tokens").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("block_docs").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_docs"),
        F.sum("block_tokens").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_tokens"),
    )
    longer = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.join(later, "block").select(
        "n_tokens",
        "n_docs",
        "all_docs",
        "all_tokens",
        (F.col("docs_after") + F.coalesce(F.sum("n_docs").over(longer), F.lit(0))).alias("docs_cut"),
        (F.col("tokens_after") + F.coalesce(F.sum("tokens").over(longer), F.lit(0))).alias("tokens_longer"),
    )
    kept = F.col("all_tokens") - F.col("tokens_longer") + F.col("docs_cut") * F.col("n_tokens")
    return sums.select(
        "n_tokens",
        "n_docs",
        (F.col("all_docs") - F.col("docs_cut")).alias("docs_fit"),
        "docs_cut",
        kept.alias("tokens_kept"),
        (F.col("all_tokens") - kept).alias("tokens_lost"),
        (F.col("all_tokens") - F.col("tokens_longer")).alias("tokens_fit"),
        ((F.col("all_docs") - F.col("docs_cut")) / F.col("all_docs")).alias("share_fit"),
    )


def at_limits(counts: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(limit, docs_fit, docs_cut, tokens_kept, tokens_lost) for any limits, one row each, from a histogram.

    Sums over lengths, in one pass: a length adds to each limit by itself, so nothing is joined. An empty histogram gives zeros.
    """
    n, docs = F.col("n_tokens"), F.col("n_docs")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    sums = []
    for i, limit in enumerate(limits):
        cut = F.when(n > limit, docs).otherwise(0)
        sums += [total(docs - cut).alias(f"fit{i}"), total(cut).alias(f"cut{i}"), total(F.least(n, F.lit(limit)) * docs).alias(f"kept{i}")]
    each = [F.struct(F.lit(int(x)).cast("long").alias("limit"), F.col(f"fit{i}").alias("docs_fit"), F.col(f"cut{i}").alias("docs_cut"), F.col(f"kept{i}").alias("tokens_kept"), (F.col("all") - F.col(f"kept{i}")).alias("tokens_lost")) for i, x in enumerate(limits)]
    return counts.agg(total(n * docs).alias("all"), *sums).select(F.inline(F.array(*each)))


def quantiles(counts: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the least length that so many of the documents don't exceed, exactly; null for an empty histogram."""
    sums = context_limits(counts)
    least = sums.agg(*(F.min(F.when(F.col("share_fit") >= share, F.col("n_tokens"))).alias(f"q{i}") for i, share in enumerate(shares)))
    return least.select(F.inline(F.array(*(F.struct(F.lit(float(x)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, x in enumerate(shares)))))
