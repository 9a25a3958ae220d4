"""Exact dedup by content sort: sampled splitters deal the texts to ranges, sorting puts equals side by side.

The order of contents is that of (the first characters of the text in lower case, a hash of it, the normalised text).
Spark samples the first two for its splitters, so splitters stay short, and texts that share their beginning are still
dealt evenly. Each range is sorted (outside memory where it has to be), and a text that differs from the one before it,
compared in full, begins a run of equals. A content with more rows than a share of the table is hot: it is counted
beforehand and dealt in shares, and the shares' runs, one row each, are merged by full comparison again.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.base import materialize, read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a text that splitters are made of.
BEGINNING = 64
#: A hot content has more rows than the table's divided by SHARES, and than LEAST; so there are fewer than SHARES of them.
SHARES, LEAST = 1000, 256


def _hot(rows: DataFrame) -> DataFrame:
    """(_h, _shares): the hot contents by hash, fewer than SHARES, and in how many shares each is dealt."""
    counts = rows.groupBy("_h").count()
    n = rows.count()
    share = max(LEAST, n // SHARES)
    return materialize(counts.where(F.col("count") > share).select("_h", F.ceil(F.col("count") / share).alias("_shares")), "hot")


def exact_groups(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256, and _uid, the row's number in the scan.

    Texts are equal if they are the same but for the case of A to Z; a null text is an empty one. Of equals the row with
    the largest doc_id stays, a null one only if there is no other, and of repeated ids the first read: exactly one row of
    each group. An empty table gives none; further columns count for nothing. docs has to be files or a settled table.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_uid"), "doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    # texts that differ in the case of A to Z only are the same in lower case; other letters are told apart below
    rows = rows.withColumn("_h", F.xxhash64(F.lower("_text")))
    rows = rows.join(F.broadcast(_hot(rows)), "_h", "left")
    rows = rows.withColumn("_share", F.pmod(F.xxhash64("_uid"), "_shares")).withColumn("_begin", F.substring(F.lower("_text"), 1, BEGINNING))
    dealt = rows.repartitionByRange("_begin", "_h", "_share").withColumn("_t", F.translate("_text", UPPER, LOWER)).drop("_text")

    # the dealing holds all rows of such a key together, so that the windows need no further shuffle
    key = ["_begin", "_h", "_share"]
    sort = Window.partitionBy(*key).orderBy("_t", F.desc_nulls_last("doc_id"), "_uid")
    differs = F.when(F.col("_t") == F.lag("_t").over(sort), 0).otherwise(1)
    runs = dealt.withColumn("_first", differs).withColumn("_run", F.sum("_first").over(sort))
    runs = runs.withColumn("text_sha256", F.sha2("_t", 256)).withColumn("_head", F.when((F.col("_first") == 1) & F.col("_shares").isNotNull(), F.col("_t"))).drop("_t")
    run = Window.partitionBy(*key, "_run")
    # of equal ids the smallest row number, as a minimum of negatives
    top = F.max(F.struct("doc_id", (-F.col("_uid")).alias("at"))).over(run)
    hot = F.col("_shares").isNotNull()
    runs = runs.withColumn("_top", top).withColumn("_size", F.count("*").over(run)).withColumn("_begin", F.when(hot, F.col("_begin")))
    runs = materialize(runs.select("_uid", "doc_id", "text_sha256", *key, "_run", "_head", "_top", "_size"), "runs")

    heads = runs.where("_head is not null")
    same = heads.groupBy("_h", "_head").agg(F.max("_top").alias("_top"), F.sum("_size").alias("_size"))
    named = heads.select(*key, "_run", "_head").join(same, ["_h", "_head"]).drop("_head")
    split = runs.where("_share is not null").drop("_top", "_size").join(named, [*key, "_run"])
    out = runs.where("_share is null").unionByName(split, allowMissingColumns=True)
    return out.select("doc_id", F.col("_top.doc_id").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_top.at") == -F.col("_uid")).alias("kept"), "text_sha256", "_uid")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each group of equal texts, their columns unchanged; rows as in exact_groups."""
    gone = exact_groups(docs).where("not kept").select("_uid")
    # the number as a struct's field, so that a column of docs may have its name
    rows = docs.select(F.monotonically_increasing_id().alias("_n"), F.struct(*docs.columns).alias("_d"))
    return rows.join(gone, rows["_n"] == gone["_uid"], "left_anti").select("_d.*")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents")).drop("_uid")
