"""Lexical retrieval: term statistics, BM25 over documents and over videos, phrases."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelight.functions import text as T
from cuelight.functions.text import strip
from cuelight.functions.numeric import on_grid
from cuelight.operators.ordered import top_k
from cuelight.session import reliable

K1, B = 1.5, 0.75
#: query terms that one pass may carry to the tasks, and scores that a task holds at once
TERM_ROWS, SCORES = 100_000, 1 << 20


@dataclass
class Index:
    """An inverted index as plain tables."""

    postings: DataFrame  # term, doc_id, tf, dl
    term_stats: DataFrame  # term, df
    corpus: DataFrame  # one row: n_docs, avgdl


def tokens_of(docs: DataFrame, doc: str = "doc_id", tokenizer=T.tokenize, keep=()) -> DataFrame:
    """doc, tokens, dl; rows without text are no documents."""
    return (
        docs.filter(strip("text") != "")
        .select(doc, *keep, tokenizer("text").alias("tokens"))
        .withColumn("dl", F.size("tokens").cast("bigint"))
    )


def term_frequencies(tokens: DataFrame, doc: str = "doc_id", vocabulary: DataFrame | None = None) -> DataFrame:
    """doc, term, dl, tf. With a vocabulary only its terms leave the map side."""
    # the outer form: explode alone makes Catalyst add a filter that tokenises every text a second time
    terms = tokens.select(doc, "dl", F.explode_outer("tokens").alias("term")).filter("term is not null")
    if vocabulary is not None:
        terms = terms.join(vocabulary, "term", "left_semi")
    return terms.groupBy(doc, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def counted_terms(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """term, doc, tf, dl of all terms, counted where the documents lie: a row is one document."""
    schema = f"term string, `{doc}` {tokens.schema[doc].dataType.simpleString()}, tf long, dl long"

    def count(batches):
        for batch in batches:
            words = batch.column("tokens").flatten().dictionary_encode()
            width = max(1, len(words.dictionary))
            row = pc.list_parent_indices(batch.column("tokens")).to_numpy()
            cell, tf = np.unique(row * width + words.indices.to_numpy(), return_counts=True)
            row = pa.array(cell // width)
            columns = [words.dictionary.take(pa.array(cell % width)), batch.column(doc).take(row), pa.array(tf), batch.column("dl").take(row)]
            yield pa.RecordBatch.from_arrays(columns, ["term", doc, "tf", "dl"])

    return tokens.select(doc, "tokens", "dl").mapInArrow(count, schema)


def document_frequencies(tf: DataFrame) -> DataFrame:
    # counting by tf keeps the column alive, so the shuffled counts are built once and reused
    return tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def build_index(docs: DataFrame, doc: str = "doc_id") -> Index:
    tokens = tokens_of(docs, doc)
    tf = counted_terms(tokens, doc)
    return Index(tf, document_frequencies(tf), corpus_stats(tokens))


def query_terms(queries: DataFrame, tokenizer=T.tokenize, stopwords: bool = True) -> DataFrame:
    """query_id, term, qtf: repeated query tokens count as often as they occur."""
    tokens = tokenizer("text")
    if stopwords:
        tokens = T.drop_stopwords(tokens)
    return (
        queries.select("query_id", F.explode(tokens).alias("term"))
        .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    )


def _tf_norm(avgdl: Column) -> Column:
    tf = F.col("tf").cast("double")
    return tf * (K1 + 1.0) / (tf + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * (F.col("dl") / avgdl)))


def score_postings(q_terms: DataFrame, index: Index, doc: str = "doc_id") -> DataFrame:
    """query_id, doc, score. Query terms are the small side: the postings stay where they are."""
    stats = index.corpus.select(F.struct("n_docs", "avgdl")).scalar()
    # term statistics meet the query terms first, so postings are joined once
    n, df = stats["n_docs"], F.col("df")
    weights = q_terms.join(index.term_stats, "term").select(
        "query_id", "term",
        (F.col("qtf") * F.log((n - df + 0.5) / (df + 0.5) + 1.0)).alias("weight"),
    )
    avgdl = F.greatest(F.lit(1e-6), stats["avgdl"])
    return (
        index.postings.join(weights, "term")
        .groupBy("query_id", doc)
        .agg(on_grid(F.sum(F.col("weight") * _tf_norm(avgdl))).alias("score"))
    )


def bm25(queries: DataFrame, docs: DataFrame, k: int = 300, doc: str = "doc_id") -> DataFrame:
    """Top ``k`` documents per query. Only the terms of the queries are counted.

    A row is one document. The terms of a query batch travel with the tasks; one
    pass over the texts stores their counts by document as numbers, which are
    added up and then scored where they lie: only the best ``k`` per query and
    task are shuffled.
    """
    from cuelight.operators import dense as D

    tokens = tokens_of(docs, doc).select(doc, "tokens", "dl")
    id_type, doc_type = D._arrow(queries, "query_id"), D._arrow(docs, doc)
    schema = f"query_id {D._typed(queries, 'query_id')}, `{doc}` {D._typed(docs, doc)}, score double"

    def one_pass(rows: list) -> DataFrame:
        asked = Asked(rows)
        terms = asked.terms

        def gather(batches):
            for batch in batches:
                row, term, tf = _counts(batch, terms)
                ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(doc), batch.column("dl"), *lists], [doc, "dl", "term", "tf"])

        # cutting texts into words is most of the work, so it is done once for both readers
        held = reliable(tokens.mapInArrow(gather, f"`{doc}` {D._typed(docs, doc)}, dl long, term array<int>, tf array<int>"))

        def count(batches):
            found = np.zeros(len(terms) + 2, dtype=np.int64)  # documents of a term; then all, and their length
            for batch in batches:
                found[: len(terms)] += np.bincount(batch.column("term").flatten().to_numpy(), minlength=len(terms))
                found[len(terms) :] += batch.num_rows, batch.column("dl").to_numpy().sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), pa.array(found)], ["i", "n"])

        # one number per term of the batch
        counted = dict(held.select("dl", "term").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n")).collect())
        total = np.array([counted.get(i, 0) for i in range(len(terms) + 2)], dtype=np.float64)
        n_docs = total[len(terms)]
        asked.weigh(total[: len(terms)], n_docs, total[-1] / max(1.0, n_docs))

        def score(batches):
            best: dict = {}
            for batch in batches:
                row = pc.list_parent_indices(batch.column("term")).to_numpy()
                term, tf = (batch.column(c).flatten().to_numpy() for c in ("term", "tf"))
                asked.score(best, row, term, tf, batch.column("dl").to_numpy()[row], np.array(batch.column(doc).to_pylist()), k)
            yield from asked.found(best, doc, id_type, doc_type)

        return held.mapInArrow(score, schema)

    found = D.in_passes(query_terms(queries), "query_id", TERM_ROWS, one_pass)
    return rank_hits(found, k, doc)


class Asked:
    """The terms of a batch of queries (rows of query_id, term, qtf), which score whole documents where they lie."""

    def __init__(self, rows: list):
        self.terms = sorted({r["term"] for r in rows})
        self.ids = sorted({r["query_id"] for r in rows})
        at_term, at_query = {t: i for i, t in enumerate(self.terms)}, {q: i for i, q in enumerate(self.ids)}
        rows = sorted((at_term[r["term"]], at_query[r["query_id"]], r["qtf"]) for r in rows)
        of_term, self.of_query, self.qtf = (np.array(x, dtype=np.int64) for x in (zip(*rows) if rows else ((), (), ())))
        self.of_term, self.starts = of_term, np.searchsorted(of_term, np.arange(len(self.terms) + 1))

    def weigh(self, df: np.ndarray, n_docs: float, avgdl: float) -> None:
        self.avgdl = max(1e-6, avgdl)
        self.weight = self.qtf * np.log((n_docs - df + 0.5) / (df + 0.5) + 1.0)[self.of_term]

    def score(self, best: dict, row, term, tf, dl, keys: np.ndarray, k: int) -> None:
        """Adds documents ``keys`` to the best ``k`` of each query; row (ascending), term, tf, dl: their postings."""
        from cuelight.operators import dense as D

        # most documents may hold none of the terms
        held, row = np.unique(row, return_inverse=True)
        keys = keys[held]
        norm = tf * (K1 + 1.0) / (tf + K1 * ((1.0 - B) + B * (dl / self.avgdl)))
        step = max(1, SCORES // max(1, len(self.ids)))
        for low in range(0, len(keys), step):
            here = keys[low : low + step]
            a, b = np.searchsorted(row, [low, low + len(here)])
            # each posting meets the queries of its term
            times = self.starts[term[a:b] + 1] - self.starts[term[a:b]]
            pair = np.repeat(np.arange(a, b), times)
            use = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times) + self.starts[term[pair]]
            cell = self.of_query[use] * len(here) + row[pair] - low
            shape = len(self.ids), len(here)
            s = D._grid(np.bincount(cell, self.weight[use] * norm[pair], len(self.ids) * len(here))).reshape(shape)
            hit = np.bincount(cell, minlength=s.size).reshape(shape) > 0
            for q in np.flatnonzero(hit.any(axis=1)):
                best[q] = D._keep(best.get(q), s[q][hit[q]], here[hit[q]], None, k)

    def found(self, best: dict, doc: str, id_type: pa.DataType, doc_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        for q, (scores, keys, _) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.ids[q]] * len(scores), id_type), pa.array(keys.tolist(), doc_type), pa.array(scores)], ["query_id", doc, "score"])


def _counts(batch: pa.RecordBatch, terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of the known terms in the column ``tokens``."""
    tokens = batch.column("tokens")
    place = pc.index_in(tokens.flatten(), value_set=pa.array(terms, pa.string()))
    known = place.is_valid().to_numpy(zero_copy_only=False)
    row = pc.list_parent_indices(tokens).to_numpy()[known]
    width = max(1, len(terms))
    cell, tf = np.unique(row * width + place.drop_null().to_numpy(), return_counts=True)
    return cell // width, cell % width, tf


def search_index(queries: DataFrame, index: Index, k: int = 300, doc: str = "doc_id") -> DataFrame:
    """The same from a stored index: postings of the queries' terms are gathered by document and scored there.

    No (query, document) pair is shuffled but the best ``k`` per query and task.
    """
    from cuelight.operators import dense as D

    id_type, doc_type = D._arrow(queries, "query_id"), D._arrow(index.postings, doc)
    schema = f"query_id {D._typed(queries, 'query_id')}, `{doc}` {D._typed(index.postings, doc)}, score double"
    stats = index.corpus.select("n_docs", "avgdl").first()

    def one_pass(rows: list) -> DataFrame:
        asked = Asked(rows)
        terms = pa.array(asked.terms, pa.string())
        mine = F.col("term").isin(asked.terms)
        df = dict(index.term_stats.filter(mine).select("term", "df").collect())
        asked.weigh(np.array([df.get(t, 0) for t in asked.terms], dtype=np.float64), stats["n_docs"], stats["avgdl"] or 0.0)

        def score(batches):
            best: dict = {}
            for table in _whole_documents(batches, doc):
                keys = np.array(table.column(doc).to_pylist())
                first = np.r_[True, keys[1:] != keys[:-1]]
                term = pc.index_in(table.column("term"), value_set=terms).to_numpy()
                asked.score(best, np.cumsum(first) - 1, term, table.column("tf").to_numpy(), table.column("dl").to_numpy(), keys[first], k)
            yield from asked.found(best, doc, id_type, doc_type)

        postings = index.postings.filter(mine).select(doc, "term", "tf", "dl")
        return postings.repartition(doc).sortWithinPartitions(doc).mapInArrow(score, schema)

    return rank_hits(D.in_passes(query_terms(queries), "query_id", TERM_ROWS, one_pass), k, doc)


def _whole_documents(batches: Iterator[pa.RecordBatch], doc: str) -> Iterator[pa.Table]:
    """Tables that cut no document in two, from batches in the order of ``doc``."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        if table.num_rows:
            # the last document may go on in the next batch
            whole = pc.sum(pc.not_equal(table.column(doc), table.column(doc)[-1])).as_py()
            if whole:
                yield table.slice(0, whole)
            rest = table.slice(whole)
    if rest is not None and rest.num_rows:
        yield rest


def rank_hits(scores: DataFrame, k: int, doc: str = "doc_id") -> DataFrame:
    return top_k(scores, ["query_id"], [F.desc("score"), F.asc(doc)], k)


def okapi(queries: DataFrame, pieces: DataFrame, k: int = 50, group: str = "video_id", eps: float = 0.25) -> DataFrame:
    """BM25 over groups of text pieces (a video's title, speech, screen text, ...).

    Counts add up over pieces, so the long text of a group is never assembled.
    A negative idf becomes ``eps`` times the mean idf of the whole vocabulary.
    """
    # a null text is an empty one: its group counts as a document without words
    tokens = pieces.select(group, T.tokenize_words(F.coalesce("text", F.lit(""))).alias("tokens"))
    lengths = tokens.groupBy(group).agg(F.sum(F.size("tokens")).alias("dl"))
    tf = (
        tokens.select(group, F.explode_outer("tokens").alias("term")).filter("term is not null")
        .groupBy(group, "term").agg(F.count(F.lit(1)).alias("tf"))
    )
    corpus = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    return okapi_hits(queries, tf, lengths, Index(tf, document_frequencies(tf), corpus), k, group, eps)


def okapi_hits(
    queries: DataFrame, tf: DataFrame, lengths: DataFrame, index: Index, k: int = 50, group: str = "video_id", eps: float = 0.25,
) -> DataFrame:
    """The same from counts (term, group, tf), lengths (group, dl) and the statistics of ``index``."""
    stats = index.corpus.select(F.struct("n_docs", "avgdl")).scalar()
    df = F.col("df")
    idf = index.term_stats.select(
        "term", (F.log(stats["n_docs"] - df + 0.5) - F.log(df + 0.5)).alias("idf")
    )
    floor = idf.select(F.avg("idf") * eps).scalar()
    weights = query_terms(queries, T.tokenize_words, stopwords=False).join(idf, "term").select(
        "query_id", "term",
        (F.col("qtf") * F.when(F.col("idf") < 0, floor).otherwise(F.col("idf"))).alias("weight"),
    )
    scores = (
        tf.join(weights, "term").join(lengths, group)
        .groupBy("query_id", group)
        .agg(on_grid(F.sum(F.col("weight") * _tf_norm(stats["avgdl"]))).alias("score"))
        .filter(F.col("score") > 0)
    )
    return rank_hits(scores, k, group)


def phrase_hits(keywords: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents that contain a keyword as a substring, whatever the case.

    There is no key to join on, so the distinct phrases are looked for in one
    pass over the documents: a few by plain containment, more by one automaton
    that reads a text once for all of them. They travel with the tasks; their
    number is checked and larger sets take several passes.
    """
    found = phrases_in(keywords.select(F.lower(strip("keyword")).alias("_phrase")), docs, text)
    return keywords.withColumn("_phrase", F.lower(strip("keyword"))).join(found, "_phrase").drop("_phrase")


def phrases_in(wanted: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each ``_phrase`` (in lower case, not blank) of ``wanted`` that they contain."""
    from cuelight.operators.dense import in_passes

    def one_pass(rows: list) -> DataFrame:
        phrases = sorted(r[0] for r in rows)
        if len(phrases) <= 16:
            hits = F.array(*[F.when(F.contains(F.lower(F.col(text)), F.lit(p)), F.lit(p)) for p in phrases])
            return docs.withColumn("_phrase", F.explode(F.filter(hits.cast("array<string>"), lambda p: p.isNotNull())))
        return docs.withColumn("_phrase", F.explode(_finder(phrases)(F.lower(F.col(text)))))

    return in_passes(wanted.filter("_phrase != ''").distinct(), "_phrase", 20_000, one_pass)


def _finder(phrases: list[str]):
    """A vectorised function from texts to the phrases that occur in them."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            import ahocorasick
        except ImportError:
            for texts in batches:
                yield pd.Series([[p for p in phrases if t is not None and p in t] for t in texts])
            return
        automaton = ahocorasick.Automaton()
        for p in phrases:
            automaton.add_word(p, p)
        automaton.make_automaton()
        for texts in batches:
            yield pd.Series([sorted({p for _, p in automaton.iter(t)}) if t else [] for t in texts])

    return run
