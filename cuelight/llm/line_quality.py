"""Quality rules: base counts of a text, and a linear-chain CRF that labels its lines as content or boilerplate.

The field is trained here on a bounded sample of the labelled documents (all lines of a document of quality 1 are content, all lines
of one of quality 0 are boilerplate) and decoded by Viterbi. A document stays if the base rules pass and enough of its words lie in
content lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.crf import Crf, train
from cuelight.llm.tables import registered, table
from cuelight.llm.words import BYTE_CODE, Words, grams, slices, span_hashes

SYMBOLS = b"#*$%&|<>"
RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
          "content_share double")


def _bytes(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


IS_SYMBOL, IS_BANG, IS_UPPER, IS_DIGIT, IS_STOP = (_bytes(v) for v in (SYMBOLS, b"!", bytes(range(65, 91)), b"0123456789", b".?!:"))
IS_LETTER = _bytes(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))


def _totals(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


class Lines:
    """The lines with a word of each text, their features, and the base counts of each text."""

    def __init__(self, col: pa.Array):
        w = Words(col)
        n, data = len(w), w.data
        row = np.repeat(np.arange(n), np.diff(w.first))
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, w.start)
        new = np.ones(len(w.start), bool)
        new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
        at = np.flatnonzero(new)
        self.row = row[at]
        self.words = np.diff(np.append(at, len(w.start)))
        hashes = w.hashes()
        # a line runs between the breaks around it, within its text
        lo = np.maximum(w.offsets[self.row], np.append(-1, breaks)[line[at]] + 1) if len(at) else np.zeros(0, np.int64)
        hi = np.minimum(w.offsets[self.row + 1], np.append(breaks, len(data))[line[at]]) if len(at) else np.zeros(0, np.int64)
        lines = span_hashes(BYTE_CODE[data], lo, hi)
        order = np.lexsort((np.arange(len(at)), lines, self.row))
        same = np.zeros(len(at), bool)
        same[order[1:]] = (lines[order[1:]] == lines[order[:-1]]) & (self.row[order[1:]] == self.row[order[:-1]])
        self.lengths = np.bincount(self.row, minlength=n)
        self.n_words = np.diff(w.first)
        self.word_chars = np.bincount(row, w.chars(), n).astype(np.int64)
        symbols = _totals(IS_SYMBOL[data])
        self.n_symbols = symbols[w.offsets[1:]] - symbols[w.offsets[:-1]]
        self.n_dup_lines = np.bincount(self.row, same, n).astype(np.int64)
        self.n_repeat_words = np.array([_repeated(hashes[w.row(r)]) for r in range(n)], np.int64)
        self.features = self._features(w, hashes, at, lo, hi, same, symbols)

    def _features(self, w, hashes, at, lo, hi, same, symbols) -> np.ndarray:
        if not len(at):
            return np.zeros((0, 12))
        data, size = w.data, np.maximum(np.add.reduceat(w.end - w.start, at), 1)
        share = lambda total: (total[hi] - total[lo]) / size
        letters = np.maximum((t := _totals(IS_LETTER[data]))[hi] - t[lo], 1)
        upper = (t := _totals(IS_UPPER[data]))[hi] - t[lo]
        of_line = np.repeat(np.arange(len(at)), self.words)
        order = np.lexsort((hashes, of_line))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (of_line[order[1:]] != of_line[order[:-1]])
        distinct = np.bincount(of_line[order], fresh, len(at))
        again = np.zeros(len(hashes))
        again[1:] = (hashes[1:] == hashes[:-1]) & (of_line[1:] == of_line[:-1])
        last = data[w.end[np.append(at[1:], len(w.end)) - 1] - 1]
        single = np.bincount(of_line, (w.end - w.start) == 1, len(at)) / self.words
        n = self.words
        return np.stack([
            np.log1p(n), np.log1p(size / n), share(symbols), share(_totals(IS_BANG[data])), upper / letters, share(_totals(IS_DIGIT[data])),
            distinct / n * np.minimum(n, 20) / 20, np.bincount(of_line, again, len(at)) / n, same.astype(float), IS_STOP[last].astype(float),
            single, share(_totals(data >= 128))], 1)


def _repeated(hashes: np.ndarray, n: int = 3) -> int:
    """Words in n-word windows that the text has twice or more."""
    if len(hashes) <= n:
        return 0
    _, which, counts = np.unique(grams(hashes, n), return_inverse=True, return_counts=True)
    edge = np.zeros(len(hashes) + 1, np.int64)
    hit = np.flatnonzero(counts[which] > 1)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + n, -1)
    return int((np.cumsum(edge) > 0).sum())


def fit(docs: DataFrame, labels: DataFrame, max_documents: int = 2000, max_lines: int = 200) -> Crf:
    """Train on at most ``max_documents`` labelled documents, those with the least hashes of their ids, of at most ``max_lines`` lines."""
    sample = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_documents)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("quality", "text")

    def rows(batches):
        for batch in slices(batches):
            lines = Lines(batch.column("text"))
            ends = np.cumsum(lines.lengths)
            keep = [r for r in range(batch.num_rows) if 0 < lines.lengths[r] <= max_lines]
            yield pa.RecordBatch.from_arrays([
                batch.column("quality").cast(pa.int32()).take(pa.array(keep, pa.int64())),
                pa.array([lines.features[ends[r] - lines.lengths[r] : ends[r]].ravel() for r in keep], pa.list_(pa.float64()))], ["quality", "x"])

    got = chosen.mapInArrow(rows, "quality int, x array<double>").toArrow()
    got = sorted(zip(got["quality"].to_pylist(), got["x"].to_pylist()), key=lambda p: (p[0], p[1]))
    xs = [np.array(x).reshape(-1, 12) for _, x in got]
    return train(xs or [np.zeros((0, 12))], [np.full(len(x), int(q > 0)) for (q, _), x in zip(got, xs)] or [np.zeros(0)])


def verdicts(model: Crf, min_words: int = 50, repeat_percent: int = 50, content_percent: int = 50):
    """A function of the text column giving the struct :data:`RESULT`."""

    @F.arrow_udf(RESULT)
    def verdict(text: pa.Array) -> pa.Array:
        out = [_judge(b.column(0), model, min_words, repeat_percent, content_percent) for b in slices([pa.RecordBatch.from_arrays([text], ["text"])])]
        return pa.concat_arrays(out) if out else _judge(text.cast(pa.large_string()), model, min_words, repeat_percent, content_percent)

    return verdict.asNondeterministic()


def _judge(col, model, min_words, repeat_percent, content_percent) -> pa.Array:
    lines = Lines(col)
    content = model.viterbi(lines.features, lines.lengths)
    held = np.bincount(lines.row, lines.words * content, len(col))
    share = np.where(lines.n_words > 0, held / np.maximum(lines.n_words, 1), 0.0)
    failed = (lines.n_words < min_words) | (100 * lines.n_repeat_words > repeat_percent * lines.n_words)
    kept = ~failed & (100 * held >= content_percent * lines.n_words)
    values = [lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words, failed, kept, share]
    names = [f.split()[0] for f in RESULT.split(", ")]
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v)) for v in values], names)


def line_quality(docs: DataFrame, labels: DataFrame, **rules) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share)`` of every row.

    Words are runs other than 0x20, 0x09-0x0D. A null or blank text has no words, fails the base rules and has share 0. Lines without
    words are no part of the sequence. Repeated rows get equal verdicts. Without usable labels every line counts as content.
    """
    return docs.select("doc_id", verdicts(fit(docs, labels), **rules)(F.col("text")).alias("_verdict")).select("doc_id", "_verdict.*")


def keep_good(docs: DataFrame, labels: DataFrame, **rules) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    own = [F.col(f"_doc.`{c}`").alias(c) for c in docs.columns]
    judged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), verdicts(fit(docs, labels), **rules)(F.col("text")).alias("_verdict"))
    return judged.where("_verdict.kept").select(*own)


@registered("op5_line_quality")
def op5(spark, sf_dir):
    return line_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
