"""A corpus pipeline of the llm operators: STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.

Every stage works on all rows that the one before it kept; all but the last return the columns of documents.
SQL can't express the first stage (learned machines) nor the last (a tokenizer), so ORACLE_SQL is None, and
tests/llm hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specklegrid.llm import exchange, language_id, ngram_join, sentence_pieces, source_mixing, substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def small_batches(spark) -> None:
    """Texts come to Python by 2,048 rows, here and when a stage's result is written: a batch of 10,000, the default, is 30 to 60 MB on either side."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")


def identify_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a language; lang becomes the predicted one. A text without a letter, or with a score below what learned rows reach, goes; without any label to learn from, all texts with letters stay as they are."""
    small_batches(spark)
    model = language_id.fit(docs, limit=True)
    if model is None:
        return docs.where(F.col("text").rlike("\\p{L}")).select(*COLUMNS)
    found = language_id.identify(docs, model, carry=tuple(COLUMNS))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= model.limit))
    return kept.select("doc_id", "rest.text", F.col("lang_pred").alias("lang"), "rest.source", "rest.n_chars")


def join_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by word 5-grams at 0.8, the one of least doc_id stays (of rows of equal doc_id and text one, the least by its columns); rows without doc_id stay, and so do texts without words."""
    small_batches(spark)
    groups = ngram_join.ngram_join(docs, width=5, num=80, den=100)
    other = (F.col("component_id") != F.col("doc_id")) | (F.col("component_key") != F.col("key"))
    gone = groups.where("doc_id is not null").where(other).select("doc_id", "key").distinct()
    kept = docs.select(*COLUMNS, ngram_join.text_key().alias("key")).join(gone, ["doc_id", "key"], "left_anti")
    if groups.where("doc_id is not null").groupBy("doc_id", "key").count().where("count > 1").take(1):
        only = kept.where("doc_id is not null").groupBy("doc_id", "key").agg(F.min(F.struct(*[c for c in COLUMNS if c != "doc_id"])).alias("r")).select("doc_id", "r.*")
        kept = only.select(*COLUMNS).unionByName(kept.where("doc_id is null").select(*COLUMNS))
    return kept.select(*COLUMNS)


def remove_repeated_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 35-word windows that occur elsewhere are cut; n_chars follows."""
    small_batches(spark)
    found = substring_dedup.substring_dedup(docs, carry=("lang", "source", "n_chars"), joined=False)
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row once at least, those of small sources up to twice, in weights that the temperature gives; copies keep their columns. Each part of the result stands in the order of the mixture's blocks, and of its permutation within them.

    A row is known by its doc_id, source and text; of rows equal in these, as many are copied in an epoch as it takes of them.
    """
    name = lambda text: F.md5(F.concat_ws("/", F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("")), F.coalesce(F.concat(F.lit("s"), F.md5("source")), F.lit("")), text))
    taken = source_mixing.mix_sources(docs, entropy=None, repeats=2.0, budget=None).select(name(F.col("key")).alias("row"), "epoch", "block", "place")
    epochs = taken.groupBy("row", "epoch").agg(F.count("*").alias("n"), F.min("block").alias("block"), F.min("place").alias("place"))
    copies = epochs.groupBy("row").agg(F.collect_list(F.struct("epoch", "n", "block", "place")).alias("copies"))  # two epochs at most
    each = docs.select(*COLUMNS, name(source_mixing.text_key()).alias("row"))
    each = each.withColumn("k", F.row_number().over(Window.partitionBy("row").orderBy("n_chars", "lang")) - 1)
    # the join lies as the numbering does, so texts are shuffled once
    out = each.join(copies, "row", "left").withColumn("copy", F.explode_outer(F.filter("copies", lambda c: F.col("k") < c["n"])))
    return out.sortWithinPartitions("copy.block", "copy.place").select(*COLUMNS)


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids with the byte spans of their pieces."""
    small_batches(spark)
    return sentence_pieces.encode(docs, carry=("lang", "source")).select("doc_id", "lang", "source", "ids", "starts", "ends")


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_duplicates),
    ("substring dedup", remove_repeated_passages),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs, others = spark.read.parquet(f"{sf_dir}/documents.parquet"), exchange.made()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = exchange.written(docs, "stage")
            exchange.swept(docs, *others)  # the stage's own tables, and the one before it
    return docs
