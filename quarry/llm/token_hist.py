"""Exact length histogram of encoded documents.

Documents are aggregated by their number of tokens (map-side first, so the
shuffle carries a row for each task, scope and length).  Suffix sums over the
lengths then answer, for every context limit at once, how many documents and
tokens are longer, what is left after truncation, and which quantile it is.
Sums run in two levels: totals of blocks of lengths, then lengths inside their
block, so no task sees more than a block or the short list of blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.bpe import token_counts
from quarry.llm.common import written

#: Lengths in a block.
BLOCK = 512


def length_histogram(docs: DataFrame, scope: str = "lang", path: str | None = None) -> DataFrame:
    """scope, every, n_tokens, n_docs: one row per scope and encoded length, and with ``every`` the same over all rows (scope '*').

    A null text counts as empty (length 0); a null scope is the scope ''.  A scope that is named '*' itself has rows of its
    own, without ``every``.  Rows that repeat count each.
    """
    lengths = token_counts(docs.select(F.coalesce(F.col(scope).cast("string"), F.lit("")).alias("scope"), "text"), ["scope"], path)
    by = lengths.groupBy("scope", "n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    own = F.struct(F.col("scope"), F.lit(False).alias("every"))
    all_ = F.struct(F.lit("*").alias("scope"), F.lit(True).alias("every"))
    both = by.select(F.explode(F.array(own, all_)).alias("s"), "n_tokens", "n_docs")
    return both.groupBy("s.scope", "s.every", "n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each scope (and for every row, where ``every`` holds) and length as context limit:

    n_docs (of this length), n_longer, n_tokens_total (whole scope), tokens_in_longer,
    truncated_tokens (sum of min(length, limit) over the scope), lost_tokens,
    quantile (share of documents not longer).  An empty histogram gives no rows.
    """
    h = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("t", F.col("n_docs") * F.col("n_tokens"))
    blocks = h.groupBy("scope", "every", "block").agg(F.sum("n_docs").alias("d"), F.sum("t").alias("s"))
    over = Window.partitionBy("scope", "every").orderBy(F.desc("block"))
    later = over.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("scope", "every")
    blocks = blocks.select(
        "scope", "every", "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"), F.coalesce(F.sum("s").over(later), F.lit(0)).alias("s_later"),
        F.sum("d").over(whole).alias("d_all"), F.sum("s").over(whole).alias("s_all"),
    )
    inside = Window.partitionBy("scope", "every", "block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    h = h.join(blocks, ["scope", "every", "block"]).select(
        "scope", "every", "n_tokens", "n_docs", "d_all", "s_all",
        (F.col("d_later") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).alias("n_longer"),
        (F.col("s_later") + F.coalesce(F.sum("t").over(inside), F.lit(0))).alias("tokens_in_longer"),
    )
    kept = F.col("s_all") - F.col("tokens_in_longer") + F.col("n_longer") * F.col("n_tokens")
    return h.select(
        "scope", "every", F.col("n_tokens").alias("context_limit"), "n_docs", "n_longer", "tokens_in_longer",
        F.col("d_all").alias("n_docs_total"), F.col("s_all").alias("n_tokens_total"),
        kept.alias("truncated_tokens"), (F.col("s_all") - kept).alias("lost_tokens"),
        ((F.col("d_all") - F.col("n_longer")) / F.col("d_all")).alias("quantile"),
    )


def limit_report(table: DataFrame, limits: list[int]) -> DataFrame:
    """Answers for context limits that need not be lengths: from the longest length at or below each limit.

    Between two lengths only truncated_tokens grows, by n_longer a token; below the shortest length
    every document is longer.  One row per scope and limit.
    """
    spark = table.sparkSession
    asked = F.broadcast(spark.createDataFrame([(int(x),) for x in limits], "limit long"))
    scopes = table.groupBy("scope", "every").agg(F.first("n_docs_total").alias("d"), F.first("n_tokens_total").alias("s"))
    below = table.join(asked, F.col("context_limit") <= F.col("limit")).groupBy("scope", "every", "limit").agg(F.max_by(F.struct("context_limit", "n_longer", "truncated_tokens"), "context_limit").alias("at"))
    grid = scopes.withColumn("limit", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
    return grid.join(below, ["scope", "every", "limit"], "left").select(
        "scope", "every", "limit",
        F.coalesce("at.n_longer", "d").alias("n_longer"),
        F.coalesce(F.col("at.truncated_tokens") + F.col("at.n_longer") * (F.col("limit") - F.col("at.context_limit")), F.col("d") * F.col("limit")).alias("truncated_tokens"),
    )


def quantile(table: DataFrame, q: float) -> DataFrame:
    """scope, every and the smallest length at which at least a share q of its documents is not longer."""
    return table.filter(F.col("quantile") >= q).groupBy("scope", "every").agg(F.min("context_limit").alias("n_tokens"))


def token_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """suffix_sums() of the histogram by lang, which is written first: its two levels read it twice, and texts are encoded once."""
    return suffix_sums(written(length_histogram(docs, "lang", path), "lengths"))
