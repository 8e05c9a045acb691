"""BM25 over postings in blocks that carry upper bounds.

A block holds the postings of one term in about ``BLOCK_DOCS`` documents of similar length. The bounds of a query's terms add up to a
bound for every document of a block, from two numbers a block and without its postings. A search opens each query's most promising
blocks first; their kth score is the threshold for the second round, and blocks whose bound lies below every query's are never opened.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cuelight.operators import lexical as L
from cuelight.session import reliable

BLOCK_DOCS = 64
#: blocks that a query opens at first for each block that its k documents would fill: a threshold from few blocks closes none
FIRST_BLOCKS = 16
#: scores lie on a grid of 1e-9; bounds are sums of the same doubles in another order
SLACK = 1e-6


@dataclass
class BlockIndex:
    """blocks: term, block, max_tf, min_dl, postings (doc, dl, tf); term_stats: term, df; corpus: one row, n_docs and avgdl."""

    blocks: DataFrame
    term_stats: DataFrame
    corpus: DataFrame


def block_index(docs: DataFrame, doc: str = "doc_id", block_docs: int = BLOCK_DOCS) -> BlockIndex:
    """Documents fall into blocks by half octaves of their length and then by a hash, so a block's shortest document is like its others.

    Each half octave has as many blocks as its own documents fill: lengths may be spread in any way (most documents of one word), and a
    block of few documents is no better than postings without blocks. No block or term is gathered beyond its documents.
    """
    tokens = L.tokens_of(docs, doc)
    octave = F.floor(2 * F.log2(F.greatest("dl", F.lit(1))))
    # one row per half octave
    sizes = tokens.groupBy(octave.alias("octave")).agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("words")).collect()
    n_docs = sum(r["n"] for r in sizes)
    parts = F.lit(1)
    for r in sizes:
        parts = F.when(octave == r["octave"], max(1, r["n"] // block_docs)).otherwise(parts)
    block = octave * (1 + n_docs // block_docs) + F.pmod(F.xxhash64(doc), parts)
    tf = reliable(L.counted_terms(tokens, doc))
    blocks = tf.groupBy("term", block.cast("bigint").alias("block")).agg(
        F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.collect_list(F.struct(F.col(doc).alias("doc"), "dl", "tf")).alias("postings"))
    avgdl = sum(r["words"] for r in sizes) / n_docs if n_docs else None
    corpus = docs.sparkSession.createDataFrame([(n_docs, avgdl)], "n_docs long, avgdl double")
    return BlockIndex(blocks, L.document_frequencies(tf), corpus)


def _weights(queries: DataFrame, index: BlockIndex) -> DataFrame:
    """query_id, term, weight and the mean length: the small side of every join below."""
    stats = index.corpus.select(F.struct("n_docs", "avgdl")).scalar()
    idf = F.log((stats["n_docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    return L.query_terms(queries).join(index.term_stats, "term").select(
        "query_id", "term", (F.col("qtf") * idf).alias("weight"), F.greatest(F.lit(1e-6), stats["avgdl"]).alias("_avgdl"))


def bounds(weights: DataFrame, index: BlockIndex) -> DataFrame:
    """query_id, block, bound: no document of the block scores more. The postings are not read."""
    tops = index.blocks.select("term", "block", F.col("max_tf").alias("tf"), F.col("min_dl").alias("dl"))
    return tops.join(weights, "term").groupBy("query_id", "block").agg(
        F.sum(F.col("weight") * L._tf_norm(F.col("_avgdl"))).alias("bound"))


def _scores(chosen: DataFrame, asked: L.Asked, queries: DataFrame, index: BlockIndex, k: int, doc: str) -> DataFrame:
    """query_id, doc, score: the best ``k`` of each query and task out of the documents in the chosen blocks.

    The postings of a block meet in one task and its documents are scored there; no (query, document) pair is shuffled but the best.
    """
    from cuelight.operators import dense as D

    element = index.blocks.schema["postings"].dataType.elementType["doc"].dataType
    id_type, doc_type = D._arrow(queries, "query_id"), to_arrow_type(element)
    terms = pa.array(asked.terms, pa.string())

    def score(batches):
        best: dict = {}
        for table in L._whole_documents(batches, "block"):
            lists = table.column("postings").combine_chunks()
            docs, dl, tf = lists.flatten().flatten()
            docs = docs.dictionary_encode()
            term = pc.index_in(table.column("term").combine_chunks(), value_set=terms).to_numpy()[pc.list_parent_indices(lists).to_numpy()]
            row = docs.indices.to_numpy()
            by_doc = np.argsort(row, kind="stable")
            keys = np.array(docs.dictionary.to_pylist())
            asked.score(best, row[by_doc], term[by_doc], tf.to_numpy()[by_doc], dl.to_numpy()[by_doc], keys, k)
        yield from asked.found(best, doc, id_type, doc_type)

    opened = index.blocks.filter(F.col("term").isin(asked.terms)).join(chosen.select("block").distinct(), "block", "left_semi")
    # by a hash of the block: a repartition by the join's own key is dropped, and a join that turns into a broadcast then leaves blocks in parts
    rows = opened.select("block", "term", "postings").repartition(F.xxhash64("block")).sortWithinPartitions("block")
    return rows.mapInArrow(score, f"query_id {D._typed(queries, 'query_id')}, `{doc}` {element.simpleString()}, score double")


def rounds(queries: DataFrame, index: BlockIndex, k: int = 300, doc: str = "doc_id", block_docs: int = BLOCK_DOCS):
    """The scores of both rounds, and every (query_id, block, bound, opened)."""
    from cuelight.operators import dense as D

    stats = index.corpus.select("n_docs", "avgdl").first()
    ahead = -(-k // block_docs) * FIRST_BLOCKS
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), F.asc("block"))
    marks = []

    def one_pass(rows: list) -> DataFrame:
        asked = L.Asked(rows)
        df = dict(index.term_stats.filter(F.col("term").isin(asked.terms)).select("term", "df").collect())
        asked.weigh(np.array([df.get(t, 0) for t in asked.terms], dtype=np.float64), stats["n_docs"], stats["avgdl"] or 0.0)
        mine = queries.filter(F.col("query_id").isin(asked.ids)) if asked.ids else queries.limit(0)
        weights = reliable(_weights(mine, index))
        ranked = reliable(bounds(weights, index).withColumn("_no", F.row_number().over(order)))
        early = ranked.filter(F.col("_no") <= ahead)
        first = reliable(_scores(early, asked, queries, index, k, doc))
        kth = L.rank_hits(first, k, doc).filter(F.col("rank") == k).select("query_id", F.col("score").alias("_kth"))
        # a query with fewer than k documents so far has no threshold
        marked = ranked.join(kth, "query_id", "left").withColumn(
            "opened", (F.col("_no") <= ahead) | F.col("_kth").isNull() | (F.col("bound") + SLACK >= F.col("_kth")))
        marks.append(marked.select("query_id", "block", "bound", "opened"))
        # a block that one query opened in the first round is read for all of them there
        late = marked.filter("opened").join(early.select("block").distinct(), "block", "left_anti")
        return first.unionByName(_scores(late, asked, queries, index, k, doc))

    found = D.in_passes(L.query_terms(queries), "query_id", L.TERM_ROWS, one_pass)
    return found, reduce(DataFrame.unionByName, marks)


def search(queries: DataFrame, index: BlockIndex, k: int = 300, doc: str = "doc_id") -> DataFrame:
    """The top ``k`` documents per query, equal to the sum over all postings."""
    scores, _ = rounds(queries, index, k, doc)
    return L.rank_hits(scores, k, doc)
