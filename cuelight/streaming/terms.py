"""Term statistics that grow with a stream: stored counts are added up, the corpus is not counted again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cuelight.functions import text as T
from cuelight.operators import lexical as L
from cuelight.streaming.jobs import _read_or_none


def _join(left: DataFrame, right: DataFrame, columns: list[str], how: str) -> DataFrame:
    """A join on ``columns`` in which rows without a key meet as well."""
    other = right.withColumnsRenamed({c: f"_{c}" for c in columns})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
    return left.join(other, same, how).drop(*[f"_{c}" for c in columns])


@dataclass
class StoredTerms:
    """Tables with a folder per batch. postings: term, key, tf; lengths: key, dl; new_pairs: term, df; new_keys: n_docs, dl."""

    postings: DataFrame
    lengths: DataFrame
    new_pairs: DataFrame
    new_keys: DataFrame
    key: str

    def counts(self, vocabulary: DataFrame | None = None) -> DataFrame:
        """term, key, tf; with a vocabulary (column term) only its terms are added up."""
        postings = self.postings if vocabulary is None else self.postings.join(vocabulary, "term", "left_semi")
        return postings.groupBy("term", self.key).agg(F.sum("tf").alias("tf"))

    def totals(self) -> DataFrame:
        return self.lengths.groupBy(self.key).agg(F.sum("dl").alias("dl"))

    def index(self, vocabulary: DataFrame | None = None) -> L.Index:
        """The index of all batches, or its part for a vocabulary; the statistics are those of all texts."""
        n = self.new_keys.agg(F.sum("n_docs").alias("n_docs"), (F.sum("dl") / F.sum("n_docs")).alias("avgdl"))
        postings = _join(self.counts(vocabulary), self.totals(), [self.key], "inner")
        return L.Index(postings, self.term_stats(), n)

    def term_stats(self) -> DataFrame:
        return self.new_pairs.groupBy("term").agg(F.sum("df").alias("df"))


def append_terms(pieces: DataFrame, path: str, checkpoint: str, key: str = "doc_id", tokenizer=T.tokenize, blank: bool = False) -> StreamingQuery:
    """Add a stream of texts (``key``, text) to the stored counts in ``path``.

    Texts of one key may come in any number of batches: counts add up, and a batch adds to the document frequencies only the pairs of
    key and term, and to the corpus only the keys, that no other batch has stored. Each batch has its own folder, so one that is replayed
    after a failure overwrites itself. Without ``blank`` rows with a blank text are no documents. A null text has no terms; rows with a null key are one document.
    """
    spark = pieces.sparkSession

    def batch(df: DataFrame, batch_id: int) -> None:
        def stored(table: str) -> DataFrame | None:
            found = _read_or_none(spark, f"{path}/{table}")
            return None if found is None else found.filter(F.col("batch") != batch_id)

        def put(table: str, rows: DataFrame) -> None:
            rows.write.mode("overwrite").parquet(f"{path}/{table}/batch={batch_id}")

        def unseen(table: str, columns: list[str]) -> DataFrame:
            mine, others = spark.read.parquet(f"{path}/{table}/batch={batch_id}"), stored(table)
            return mine if others is None else _join(mine, others.select(columns), columns, "left_anti")

        rows = df if blank else df.filter(T.strip("text") != "")
        tokens = rows.select(key, F.coalesce(tokenizer("text"), F.array().cast("array<string>")).alias("tokens"))
        terms = tokens.select(key, F.explode("tokens").alias("term"))
        put("postings", terms.groupBy("term", key).agg(F.count(F.lit(1)).alias("tf")).repartitionByRange("term").sortWithinPartitions("term"))
        put("lengths", tokens.groupBy(key).agg(F.sum(F.size("tokens")).alias("dl")))
        # written counts are the batch's input from here on, so its texts are read twice and no more
        put("new_pairs", unseen("postings", ["term", key]).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
        length = spark.read.parquet(f"{path}/lengths/batch={batch_id}").agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("dl"))
        put("new_keys", unseen("lengths", [key]).agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(length))  # one row each

    return pieces.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_terms(spark: SparkSession, path: str, key: str = "doc_id") -> StoredTerms:
    return StoredTerms(*[spark.read.parquet(f"{path}/{t}") for t in ("postings", "lengths", "new_pairs", "new_keys")], key)


def search_terms(queries: DataFrame, stored: StoredTerms, k: int = 300) -> DataFrame:
    """BM25 over the stored counts: only the postings of the queries' terms are added up."""
    terms = L.query_terms(queries)
    index = stored.index(terms.select("term").distinct())
    return L.rank_hits(L.score_postings(terms, index, stored.key), k, stored.key)


def okapi_terms(queries: DataFrame, stored: StoredTerms, k: int = 50, eps: float = 0.25) -> DataFrame:
    """:func:`operators.lexical.okapi` over the stored counts; the mean idf reads the vocabulary, not the texts."""
    wanted = L.query_terms(queries, T.tokenize_words, stopwords=False).select("term").distinct()
    counts = stored.counts(wanted)
    return L.okapi_hits(queries, counts, stored.totals(), stored.index(wanted), k, stored.key, eps)
