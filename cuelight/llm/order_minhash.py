"""Document fingerprints by Order MinHash.

The units are k-mers of words, numbered by occurrence, so a repeated k-mer is as many units. Each of ``SIGNATURES`` random orders selects
its ``TUPLE`` least units; their k-mers, in the order in which they stand in the text, are hashed to one number. Equal numbers at equal
places of two fingerprints so witness common units in common order, which edit distance rewards and a set of units does not.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.tables import registered, table
from cuelight.llm.words import U, Words, mix, slices, span_hashes

SIGNATURES = 64
TUPLE = 2
KMER = 3
FACTORS = (mix(np.arange(1, SIGNATURES + 1, dtype=U)) | U(1))[:, None]
EDGE = mix(np.array([0x5E, 0x24], U))
#: units that one step of the selection holds at a time
CHUNK = 1 << 14
LEAST = -(1 << 63)


def _units(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """k-mers of a text, padded at both ends, and their hashes with occurrence numbers."""
    padded = np.concatenate([np.repeat(EDGE[:1], KMER - 1), words, np.repeat(EDGE[1:], KMER - 1)])
    at = np.arange(len(words) + KMER - 1)
    kmers = span_hashes(padded, at, at + KMER)
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    heads = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    occurrence = np.empty(len(kmers), U)
    occurrence[order] = np.arange(len(kmers)) - np.repeat(heads, np.diff(np.append(heads, len(kmers))))
    return kmers, mix(kmers + occurrence * U(0xD1B54A32D192ED03))


def signature(words: np.ndarray) -> np.ndarray:
    """``SIGNATURES`` 32-bit numbers of a text's word hashes; a text without words has zeros."""
    if not len(words):
        return np.zeros(SIGNATURES, np.uint32)
    kmers, units = _units(words)
    best = np.zeros((SIGNATURES, 0), U)
    place = np.zeros((SIGNATURES, 0), np.int64)
    for start in range(0, len(units), CHUNK):  # a long text is selected from chunk by chunk
        values = units[None, start : start + CHUNK] * FACTORS
        rows = np.arange(SIGNATURES)
        for _ in range(min(TUPLE, values.shape[1])):
            at = values.argmin(1)
            best = np.append(best, values[rows, at][:, None], 1)
            place = np.append(place, at[:, None] + start, 1)
            values[rows, at] = U(0xFFFFFFFFFFFFFFFF)
        if best.shape[1] > TUPLE:
            keep = np.argsort(best, 1, kind="stable")[:, :TUPLE]
            best, place = np.take_along_axis(best, keep, 1), np.take_along_axis(place, keep, 1)
    in_order = kmers[np.sort(place, 1)].reshape(-1)
    ends = np.arange(1, SIGNATURES + 1) * place.shape[1]
    return np.maximum(span_hashes(in_order, ends - place.shape[1], ends) >> U(32), U(1)).astype(np.uint32)


def signatures(texts: list[str]) -> np.ndarray:
    words = Words(pa.array(texts, pa.large_string()))
    hashes = words.hashes()
    return np.array([signature(hashes[words.row(r)]) for r in range(len(texts))], np.uint32).reshape(-1, SIGNATURES)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common units. If a share j of the union is common, ``j ** TUPLE`` of the tuples agree; the units that both
    have are then ``2 j / (1 + j)`` of each. 1 for equal fingerprints."""
    j = (a == b).mean(-1) ** (1 / TUPLE)
    return 2 * j / (1 + j)


def _hex(rows: np.ndarray) -> list[str]:
    return [r.astype(">u4").tobytes().hex() for r in rows]


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """``(id, text, bucket, guest)``: documents in buckets of the descending order of ids, and with each bucket, as its guest, the first
    document after it. The first document of all is the guest of the last bucket."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / buckets for i in range(1, buckets)]
    bounds = rows.agg(F.percentile_approx("id", shares, 10 * buckets)).first()[0] if shares else []
    edges = spark.sparkContext.broadcast(np.unique(np.array(bounds or [], np.int64)))  # one number per bucket

    @F.arrow_udf("int")
    def bucket(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(edges.value, ids.to_numpy(), "right").astype(np.int32))

    tops = {r["bucket"]: r["id"] for r in rows.select(bucket("id").alias("bucket"), "id").groupBy("bucket").agg(F.max("id").alias("id")).collect()}
    full = sorted(tops, reverse=True)
    before = {tops[b]: full[i - 1] for i, b in enumerate(full)}
    hosts = spark.sparkContext.broadcast(before)

    @F.arrow_udf("array<struct<bucket: int, guest: boolean>>")
    def places(ids: pa.Array) -> pa.Array:
        own = np.searchsorted(edges.value, ids.to_numpy(), "right").tolist()
        return pa.array([[{"bucket": b, "guest": False}] + ([{"bucket": hosts.value[i], "guest": True}] if i in hosts.value else [])
                         for i, b in zip(ids.to_pylist(), own)], pa.list_(pa.struct([("bucket", pa.int32()), ("guest", pa.bool_())])))

    return rows.select("id", "doc_id", "text", F.explode(places("id")).alias("p")).select("id", "doc_id", "text", "p.bucket", "p.guest")


SCHEMA = ("doc_id {}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _compare(batches):
    """Rows sorted by bucket, guests last, ids falling: each document with its next one."""
    held = None  # the last row read and its signature
    for batch in slices(batches):
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text"))))
        marks = signatures([r[3] for r in rows])
        if held:
            rows, marks = [held[0], *rows], np.concatenate([held[1][None], marks])
        held = rows[-1], marks[-1]
        pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        if not pairs:
            continue
        edited = []
        for i in pairs:
            text, follow = rows[i][3], rows[i + 1][3]
            half = len(text) // 2
            edited.append(text[: len(text) - half] + follow[:half])
        after = signatures(edited)
        at = np.array(pairs)
        yield pa.RecordBatch.from_arrays([
            pa.array([rows[i][2] for i in pairs], batch.schema.field("doc_id").type), pa.array([len(rows[i][3]) for i in pairs], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(_hex(marks[at])), pa.array(_hex(after)),
            pa.array(likeness(marks[at], after)), pa.array(likeness(marks[at], marks[at + 1]))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edit_probe(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half gives way to the start of the next document's text.

    Next is the next smaller doc_id, after the last document the first one. A null text counts as empty; texts without words share one
    fingerprint. Rows without a doc_id come last; rows of one doc_id follow one another by text. A single document follows itself.
    Other columns are ignored. ``buckets`` (the session's shuffle partitions if not given) doesn't change the result.
    """
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, buckets).repartition(buckets, "bucket").sortWithinPartitions(
        F.col("bucket"), F.col("guest"), F.col("id").desc(), F.col("text"))
    return rows.select("bucket", "guest", "doc_id", "text").mapInArrow(_compare, SCHEMA.format(docs.schema["doc_id"].dataType.simpleString()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)``: 64 numbers of eight hexadecimal digits. Equal texts have equal fingerprints."""

    @F.arrow_udf("string")
    def mark(text: pa.Array) -> pa.Array:
        out = [h for b in slices([pa.RecordBatch.from_arrays([text], ["text"])]) for h in _hex(signatures(b.column(0).to_pylist()))]
        return pa.array(out, pa.string())

    return docs.select("doc_id", mark("text").alias("fingerprint"))


@registered("op9_order_minhash")
def op9(spark, sf_dir):
    return edit_probe(table(spark, sf_dir, "documents"))
