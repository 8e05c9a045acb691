"""Ranked lexical search over impact lists by the Best Position Algorithm.

Documents become bags of the queries' terms in one pass over the texts. Terms get their weights from counts over all of them. Then each
shard of documents, a task's rows up to a fixed size, holds its impact lists: per term the documents by falling impact. A query goes
down all its lists at once; every document met is looked up in the query's other lists (direct accesses), which gives its whole score
and its position there. The best position of a list is the last one up to which all are seen, by either way, so the sum of the impacts
there bounds every unseen document from above, more tightly than the positions last read. A query stops where this bound lies strictly
below its kth score, so equal scores at the end are all met. The best of all shards are ranked by a window that keeps k rows a task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelight.llm.tables import registered, stored, table
from cuelight.llm.words import SLICE_BYTES, Words, list_array, slices

#: bytes that part terms: all of ASCII but digits and letters
APART = np.ones(256, bool)
APART[128:] = False
for _first, _last in (b"09", b"AZ", b"az"):
    APART[_first : _last + 1] = False
#: queries answered in one pass over the documents, and postings in a shard
QUERIES, SHARD = 4096, 1 << 20
#: list positions read before the first test of the bound; doubled from test to test
DEPTH = 32


def _terms(texts: list[str]) -> list[np.ndarray]:
    """Hashes of the terms of each text, repeats included."""
    words = Words(pa.array(texts, pa.large_string()), lower=True, blank=APART)
    hashes = words.hashes()
    return [hashes[words.row(r)] for r in range(len(texts))]


def bags(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n (terms with repeats), terms (places in the sorted vocabulary of hashes) and tfs of every row with a term."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(vocabulary)
        for batch in slices(batches, limit=4 * SLICE_BYTES):
            words = Words(batch.column(1), lower=True, blank=APART)
            hashes, n = words.hashes(), np.diff(words.first)
            at = np.minimum(np.searchsorted(vocabulary, hashes), size - 1)
            known = vocabulary[at] == hashes
            pair, tf = np.unique(np.repeat(np.arange(len(words)), n)[known] * size + at[known], return_counts=True)
            cut = np.searchsorted(pair, np.arange(len(words) + 1) * size)
            rows = np.flatnonzero(n)
            parts = [slice(cut[r], cut[r + 1]) for r in rows.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(n[rows], pa.int64()),
                 list_array([(pair[p] % size).astype(np.int32) for p in parts], pa.int32()),
                 list_array([tf[p].astype(np.int32) for p in parts], pa.int32())],
                ["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, tfs array<int>")


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Found:
    """What a query gives in one shard, and how far it went: rows with their scores, list positions read, bound at the end."""

    rows: np.ndarray
    scores: np.ndarray
    read: int
    bound: int


class Shard:
    """Impact lists of some documents, and each document's postings for direct accesses."""

    def __init__(self, n: np.ndarray, first: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        """Row r of the shard has postings first[r]:first[r + 1]; ``weights`` is by term, ``n_terms`` counts all terms with repeats."""
        doc = np.repeat(np.arange(len(n)), np.diff(first))
        norm = 100 - 75 + 75 * n * n_docs // n_terms
        self.first, self.terms = first, terms
        self.impact = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * norm[doc]))
        order = np.lexsort((doc, -self.impact, terms))
        self.doc, self.by_impact = doc[order], self.impact[order]
        self.begin = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.place -= self.begin[terms]
        #: which of a query's lists a term is, -1 for none; and the rows met by the query
        self.slot, self.met = np.full(len(weights), -1, np.int64), np.zeros(len(n), bool)

    def look_up(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Postings of the rows in the query's lists, and for each the place of its row in ``rows``."""
        length = self.first[rows + 1] - self.first[rows]
        upto = np.cumsum(length)
        at = np.repeat(self.first[rows] - upto + length, length) + np.arange(upto[-1] if len(rows) else 0)
        of = np.repeat(np.arange(len(rows)), length)
        held = self.slot[self.terms[at]] >= 0
        return at[held], of[held]

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, depth: int = DEPTH) -> Found:
        """The rows of the k highest scores above 0, and all whose score equals the last of them."""
        size = self.begin[terms + 1] - self.begin[terms]
        terms, times, size = terms[size > 0], times[size > 0], size[size > 0]
        begin = self.begin[terms]
        self.slot[terms] = np.arange(len(terms))
        seen = [np.zeros(s, bool) for s in size.tolist()]
        best = np.zeros(len(terms), np.int64)
        rows, scores = [], []
        read, last, kth, bound = 0, 0, 0, 0
        top = np.zeros(0, np.int64)
        while True:
            new = np.concatenate([self.doc[b + min(last, s) : b + min(depth, s)] for b, s in zip(begin.tolist(), size.tolist())] or [np.zeros(0, np.int64)])
            read += len(new)
            new = np.unique(new)
            new = new[~self.met[new]]
            self.met[new] = True
            at, of = self.look_up(new)
            slot = self.slot[self.terms[at]]
            score = np.zeros(len(new), np.int64)
            np.add.at(score, of, self.impact[at] * times[slot])
            rows.append(new)
            scores.append(score)
            place = self.place[at]
            for i, (s, mark) in enumerate(zip(size.tolist(), seen)):
                mark[place[slot == i]] = True
                if best[i] < s:
                    ahead = ~mark[best[i] :]
                    gap = int(ahead.argmax())
                    best[i] = best[i] + gap if ahead[gap] else s
            top = np.concatenate([top, score[score > 0]])
            if len(top) >= k:
                top = np.partition(top, len(top) - k)[len(top) - k :]
                kth = int(top[0])
            # a list seen to its end holds no unseen row
            open_ = best < size
            bound = int((self.by_impact[begin + best - 1] * times)[open_].sum())
            if not open_.any() or (len(top) >= k and bound < kth):
                break
            last, depth = depth, depth * 2
        self.slot[terms] = -1
        rows, scores = np.concatenate(rows), np.concatenate(scores)
        self.met[rows] = False
        keep = (scores > 0) & (scores >= (kth if len(top) >= k else 1))
        return Found(rows[keep], scores[keep], read, bound)


def _answers(found: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """query, doc_id and score of the k best of each query in each shard."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def answer(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids, terms = rows["doc_id"].combine_chunks(), rows["terms"].combine_chunks()
        first = terms.offsets.to_numpy().astype(np.int64)
        shard = Shard(rows["n"].to_numpy(), first - first[0], terms.flatten().to_numpy().astype(np.int64),
                      rows["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64), weights, n_docs, n_terms)
        # the order of ids, those without one first
        place = np.empty(len(ids), np.int64)
        place[pa.compute.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        out = []
        for q, (own, times) in enumerate(queries):
            hit = shard.search(own, times, k)
            cut = np.lexsort((place[hit.rows], -hit.scores))[:k]
            out.append((np.full(len(cut), q, np.int32), hit.rows[cut], hit.scores[cut]))
        q, row, score = (np.concatenate(c) for c in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(q), ids.take(pa.array(row)), pa.array(score)], ["query", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten()) + batch.num_rows
            if size >= SHARD:
                yield answer(held)
                held, size = [], 0
        if size:
            yield answer(held)

    return found.select("doc_id", "n", "terms", "tfs").mapInArrow(run, f"query int, doc_id {kind}, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of the k best rows of ``docs`` for every item (item_id, text).

    Repeated items (equal id and text) are one; items of one id and different texts are ranked each on its own. An item without terms
    known to the documents, a null one among them, has no rows. Rows of ``docs`` without terms are no documents; repeated rows are
    documents of their own. Equal scores go by ascending doc_id, those without one first. Only doc_id and text are read. Items are
    taken in blocks of about 4,096, one pass over the documents each, so what a task holds of them is bounded.
    """
    spark = docs.sparkSession
    items = stored(items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct())
    blocks = -(-items.count() // QUERIES)
    kinds = f"query int, item_id {items.schema['item_id'].dataType.simpleString()}"
    answers = spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint")
    for block in range(blocks):
        asked = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        hashes = _terms([r.text for r in asked])
        vocabulary = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
        if not len(vocabulary):
            continue
        found = stored(bags(docs, vocabulary))
        total = found.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not total.docs:
            continue
        # one number per term of the block's queries
        df = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
        weights = np.zeros(len(vocabulary), np.int64)
        for r in df:
            weights[r.term] = weight(r.df, total.docs)
        queries = []
        for h in hashes:
            times = Counter(np.searchsorted(vocabulary, h).tolist())
            own = np.array([t for t in sorted(times) if weights[t] > 0], np.int64)
            queries.append((own, np.array([times[t] for t in own.tolist()], np.int64)))
        best = _answers(found, queries, weights, total.docs, total.terms, k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(asked)], kinds)
        ranked = ranked.join(names, "query").select("item_id", "rank", "doc_id", "score")
        answers = answers.unionByName(stored(ranked) if blocks > 1 else ranked)
    return answers


_SQL = r"""
with lowered as (select doc_id, row_number() over () as row, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
words as (select doc_id, row, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from lowered),
post as (select doc_id, row, term, count(*)::bigint as tf from words group by all),
lens as (select row, sum(tf)::bigint as n from post group by row),
whole as (select count(*)::bigint as nd, sum(n)::bigint as l from lens),
stats as (select term, floor(1000 * ln((2 * any_value(nd) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from post, whole group by term),
asked as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select distinct item_id, text from benchmark)),
times as (select item_id, term, count(*)::bigint as q from asked group by all),
scored as (select item_id, post.row, any_value(doc_id) as doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nd) // l)))))::bigint as score
  from times join stats using (term) join post using (term) join lens on lens.row = post.row, whole group by item_id, post.row),
placed as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls first)::int as rank from scored where score > 0)
select item_id, rank, doc_id, score from placed where rank <= 10
"""


@registered("op13_best_position_search", _SQL)
def op13(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
