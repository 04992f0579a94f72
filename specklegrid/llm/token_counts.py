"""Exact token counts from a histogram of encoded lengths.

Documents are counted by the number of tokens of their whole text; suffix sums of that histogram then answer, for
each length as a context limit, how many documents reach it, how many tokens remain if every document is cut there,
and which quantile it is. The histogram is far smaller than the corpus, and its sums run in two levels (spans of
lengths, then lengths within a span), so no task sees all of it.

Cases: a null or empty text has no tokens (a row for length 0); a very long text is encoded whole; documents of equal
length are one row; repeated rows count each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import written
from .kernels import pieces

RANKS, SPAN = "byte_bpe_50k.tiktoken", 512


@cache
def _encoding(ranks: str, pattern: str | None):
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks if "/" in ranks else public_tokenizers.path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def encoded_lengths(docs: DataFrame, ranks: str = RANKS, pattern: str | None = None) -> DataFrame:
    """n_tokens of each row of docs(text)."""

    def run(batches):
        e = _encoding(ranks, pattern)
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.record_batch([pa.array([len(e.encode_ordinary(t)) if t else 0 for t in part.column(0).to_pylist()], pa.int64())], ["n_tokens"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n_tokens long")


def length_totals(lengths: DataFrame, span: int = SPAN) -> DataFrame:
    """For each length n_tokens that occurs: n_docs of it, docs_at_least, tokens_up_to (of documents no longer), truncated_total (with all cut to it), cum_share (of documents no longer)."""
    # written, as two branches read it and the texts are to be encoded once
    hist = written(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "histogram").withColumn("span", F.floor(F.col("n_tokens") / span))
    spans = hist.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spans = spans.select("span", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.sum("d").over(whole).alias("docs"))
    up_to = Window.partitionBy("span").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    x = hist.join(spans, "span").withColumns({"below": F.col("d0") + F.sum("n_docs").over(up_to), "tokens_up_to": F.col("t0") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(up_to)})
    return x.select(
        "n_tokens", "n_docs", (F.col("docs") - F.col("below") + F.col("n_docs")).alias("docs_at_least"), "tokens_up_to",
        (F.col("tokens_up_to") + (F.col("docs") - F.col("below")) * F.col("n_tokens")).alias("truncated_total"), (F.col("below") / F.col("docs")).alias("cum_share"),
    )


def quantile(totals: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share q of the documents doesn't pass."""
    return totals.where(F.col("cum_share") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def at_limits(totals: DataFrame, limits: list[int]) -> dict[int, int]:
    """The tokens that remain with all documents cut to each limit, whether or not a document has that length; one aggregate over the totals."""
    reach = lambda k: F.max(F.when(F.col("n_tokens") <= k, F.struct("n_tokens", "tokens_up_to", (F.col("docs_at_least") - F.col("n_docs")).alias("over"))))
    row = totals.agg(F.max("docs_at_least").alias("docs"), *[reach(k).alias(f"l{i}") for i, k in enumerate(limits)]).first()
    return {k: (row[f"l{i}"]["tokens_up_to"] + row[f"l{i}"]["over"] * k) if row[f"l{i}"] else (row["docs"] or 0) * k for i, k in enumerate(limits)}


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return length_totals(encoded_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")))
