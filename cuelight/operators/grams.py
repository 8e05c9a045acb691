"""Substring search over stored lists of trigrams.

A document that contains a phrase contains every trigram of it. The lists of a phrase's rarest trigrams are intersected block by block,
and only the documents that stay are read and compared. A block holds some ``BLOCK_DOCS`` documents, so a list is bounded however common
its trigram, and a common trigram is as many rows as there are blocks. Lists are sorted small integers, which Parquet stores as deltas.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelight.functions.text import strip
from cuelight.operators import lexical as L

BLOCK_DOCS = 16_384
#: folders of the stored documents; a search opens those of its candidates
FOLDERS = 64
#: trigrams of a phrase whose lists are intersected
RAREST = 4
GRAM = 3


@dataclass
class GramIndex:
    """docs: the documents with folder, block, no; lists: gram, block, n, nos; stats: gram, n (documents that contain it)."""

    docs: DataFrame
    lists: DataFrame
    stats: DataFrame


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case, overlapping."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def write_gram_index(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS) -> None:
    """Rows without a text are no documents. Rows of one ``doc`` are documents of their own."""
    spark, kept = docs.sparkSession, docs.filter(F.col(text).isNotNull())
    blocks = max(1, kept.select(F.lit(1)).count() // block_docs)
    # the text spreads the rows of one key
    block = F.pmod(F.xxhash64(doc, text), F.lit(blocks))
    order = Window.partitionBy("block").orderBy(doc)
    numbered = kept.withColumn("block", block).withColumn("no", F.row_number().over(order) - 1)
    # the numbers are decided once, by this file
    numbered.withColumn("folder", F.pmod("block", F.lit(FOLDERS))).write.mode("overwrite").partitionBy("folder").parquet(f"{path}/docs")
    lists = (
        spark.read.parquet(f"{path}/docs").select("block", "no", F.explode(grams(F.col(text))).alias("gram"))
        .groupBy("gram", "block").agg(F.array_sort(F.collect_list("no")).alias("nos")).withColumn("n", F.size("nos"))
    )
    lists.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.mode("overwrite").option(
        "parquet.writer.version", "v2").option("parquet.enable.dictionary#nos.list.element", "false").parquet(f"{path}/lists")
    spark.read.parquet(f"{path}/lists").groupBy("gram").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{path}/stats")


def read_gram_index(spark: SparkSession, path: str) -> GramIndex:
    return GramIndex(*[spark.read.parquet(f"{path}/{t}") for t in ("docs", "lists", "stats")])


def candidates(phrases: DataFrame, index: GramIndex) -> DataFrame:
    """_phrase, folder, block, no: the documents that hold the rarest trigrams of a phrase (column _phrase, of three letters or more)."""
    parts = phrases.select("_phrase", F.explode(grams(F.col("_phrase"))).alias("gram"))
    rarity = Window.partitionBy("_phrase").orderBy("_n", "gram")
    # a trigram of no document comes first and leaves its phrase without a list
    chosen = parts.join(index.stats.select("gram", F.col("n").alias("_n")), "gram", "left").withColumn(
        "_at", F.row_number().over(rarity)).filter(F.col("_at") <= RAREST)
    wanted = chosen.withColumn("_lists", F.count(F.lit(1)).over(Window.partitionBy("_phrase"))).filter("_n is not null")
    met = (
        index.lists.join(wanted.select("gram", "_phrase", "_lists"), "gram")
        .groupBy("_phrase", "block", "_lists").agg(F.collect_list("nos").alias("_nos")).filter(F.size("_nos") == F.col("_lists"))
    )
    common = F.aggregate(F.slice("_nos", 2, RAREST), F.element_at("_nos", 1), F.array_intersect)
    return met.select("_phrase", F.pmod("block", F.lit(FOLDERS)).alias("folder"), "block", F.explode(common).alias("no"))


def phrase_hits(keywords: DataFrame, index: GramIndex, text: str = "text") -> DataFrame:
    """:func:`operators.lexical.phrase_hits` from a stored index: the rows of ``keywords`` with each document that contains the keyword.

    Blank keywords hit nothing. Those of one or two letters have no trigram and are looked for in all stored documents.
    """
    wanted = keywords.withColumn("_phrase", F.lower(strip("keyword")))
    phrases = wanted.select("_phrase").filter("_phrase != ''").distinct()
    columns = [c for c in index.docs.columns if c not in ("folder", "block", "no")]
    found = index.docs.join(candidates(phrases.filter(F.length("_phrase") >= GRAM), index), ["folder", "block", "no"]).filter(
        F.contains(F.lower(text), F.col("_phrase"))).select("_phrase", *columns)
    short = phrases.filter(F.length("_phrase") < GRAM).select(F.col("_phrase").alias("keyword"), "_phrase")
    scanned = L.phrase_hits(short.select("keyword"), index.docs, text).select(F.col("keyword").alias("_phrase"), *columns)
    return wanted.join(found.unionByName(scanned), "_phrase").drop("_phrase")
