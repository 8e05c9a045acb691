"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lowers case, drops accents, and maps homoglyphs and digit substitutions to the letters they stand for, one character for one,
so that places in the folded text are places in the text. The lexicon holds word beginnings of 4 to 8 letters and whole words, weighted
by their log-odds in toxic documents; it is learned from a bounded sample of the labelled documents. Exception phrases swallow the
matches inside them. The summed weight, normalised by length, becomes a probability by a logistic curve fitted on the same sample.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelight.llm.tables import registered, table
from cuelight.llm.words import slices

# Letters that look like Latin ones, digits and signs that stand for letters, and phrases in which a term is harmless.
LOOKALIKES = dict(zip("авекмнорстухіјѕԁԛԝһӏαβεικνορτυχ", "abekmhopctyxijsdqwhlabeiknoptux"))
STAND_INS = dict(zip("013457@$", "oieastas"))
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "soap scum", "idiot proof")

SHORTEST, LONGEST = 4, 8
END = "\x00"


@lru_cache(maxsize=1)
def _table() -> dict[int, str]:
    """Lower case without accents or compatibility forms, where that is one character."""
    out = {}
    for code in [*range(0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        base = base if len(base) == 1 else c.lower() if len(c.lower()) == 1 else c
        base = STAND_INS.get(base, LOOKALIKES.get(base, base))
        if base != c:
            out[code] = base
    return out


def fold(text: str) -> str:
    """The folded text, as long as the text."""
    return text.translate(_table())


def _starts(folded: str) -> list[str]:
    """Words of a folded text: runs of letters."""
    return "".join(c if c.isalpha() else " " for c in folded).split()


@dataclass
class Lexicon:
    """Weights of word beginnings, and of whole words (ending in ``END``); the curve's slope and level."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 1.0
    level: float = -2.0

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        uses: dict[str, list[tuple[float, bool]]] = {}  # a word beginning, the same whole word and an exception may be one key
        for term, weight in self.weights.items():
            uses.setdefault(term.rstrip(END), []).append((weight, term.endswith(END)))
        for phrase in self.exceptions:
            uses.setdefault(fold(phrase), []).append((0.0, True))
        for key, kinds in uses.items():
            found.add_word(key, (len(key), kinds))
        if len(found):
            found.make_automaton()
        return found


def evidence(text: str, automaton: ahocorasick.Automaton) -> float:
    """Weight of the matches per length. A match starts a word; a word counts once, by its heaviest match, and not at all inside an
    exception phrase."""
    if not text or not len(automaton):
        return 0.0
    folded = fold(text)
    best: dict[int, float] = {}
    harmless = []
    for last, (size, kinds) in automaton.iter(folded):
        start = last + 1 - size
        if start and text[start - 1].isalnum():
            continue
        inner = last + 1 < len(text) and text[last + 1].isalnum()
        for weight, whole in kinds:
            if whole and inner:
                continue
            if weight:
                best[start] = max(best.get(start, 0.0), weight)
            else:
                harmless.append((start, last))
    total = sum(w for at, w in best.items() if not any(a <= at <= b for a, b in harmless))
    return total / (1 + math.log1p(len(text) / 1000))


def _scores(col: pa.Array, lexicon: Lexicon, automaton) -> np.ndarray:
    x = np.array([evidence(t, automaton) for t in col.to_pylist()])
    return 1 / (1 + np.exp(-np.clip(lexicon.slope * x + lexicon.level, -50, 50)))


def learn(docs: DataFrame, labels: DataFrame, max_documents: int = 12000, max_terms: int = 2000) -> Lexicon:
    """A lexicon from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``: at most half of ``max_documents`` labels of each kind, those
    of the least hashes of their ids.

    A term needs documents of at least max(4, 1 % of the toxic ones) and log-odds of 3. Of nested terms the shortest stays that is
    about as heavy, and of more than ``max_terms`` the heaviest stay. The terms come from the ``20 * max_terms`` of most toxic documents.
    Without labelled documents of both kinds the lexicon is empty and all scores are equal.
    """
    def sample(label):
        kept = labels.where((F.col("toxic") > 0) == F.lit(bool(label)))
        return kept.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents // 2).select("doc_id", F.lit(label).alias("toxic"))

    chosen = docs.join(F.broadcast(sample(1).unionByName(sample(0))), "doc_id").select("text", "toxic")  # max_documents ids

    def count(batches):
        seen = (Counter(), Counter())
        n = [0, 0]
        for batch in slices(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                n[toxic] += 1
                words = set(_starts(fold(text)))
                terms = {w[:k] for w in words for k in range(SHORTEST, min(LONGEST, len(w)) + 1)} | {w + END for w in words if 2 < len(w) <= 24}
                seen[toxic].update(terms)
        terms = [*seen[0].keys() | seen[1].keys(), ""]
        yield pa.RecordBatch.from_arrays([
            pa.array(terms), pa.array([seen[0][t] if t else n[0] for t in terms], pa.int64()),
            pa.array([seen[1][t] if t else n[1] for t in terms], pa.int64())], ["term", "clean", "toxic"])

    counts = chosen.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    kept = counts.where((F.col("term") == "") | ((F.col("toxic") >= 4) & (F.col("toxic") * 4 > F.col("clean"))))
    rows = kept.orderBy(F.col("term") != "", F.col("toxic").desc(), "term").limit(20 * max_terms).collect()
    totals = next((r for r in rows if r["term"] == ""), None)
    if totals is None or not totals["clean"] or not totals["toxic"]:
        return Lexicon({})
    scored = {}
    for r in rows:
        if r["term"] and r["toxic"] >= max(4, totals["toxic"] / 100):
            odds = math.log((r["toxic"] + 0.5) / (totals["toxic"] + 1)) - math.log((r["clean"] + 0.5) / (totals["clean"] + 1))
            if odds >= 3:
                scored[r["term"]] = (odds, r["toxic"])
    weights: dict[str, float] = {}
    for term, (odds, _) in sorted(scored.items(), key=lambda x: (len(x[0]), x[0])):
        nested = [weights[term[:k]] for k in range(SHORTEST, len(term)) if term[:k] in weights]
        if not nested or odds > max(nested) + 1:
            weights[term] = odds
    lexicon = Lexicon(dict(sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:max_terms]))

    def look(batches):
        automaton = lexicon.automaton()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([
                pa.array([evidence(t, automaton) for t in batch.column("text").to_pylist()], pa.float64()), batch.column("toxic")], ["x", "toxic"])

    # the sample has its own balance: a clean document stands for as many as it does among all labelled ones
    seen = chosen.mapInArrow(look, "x double, toxic int").toArrow()
    all_clean, all_toxic = labels.agg(F.sum((F.col("toxic") <= 0).cast("long")), F.sum((F.col("toxic") > 0).cast("long"))).first()
    x, y = seen["x"].to_numpy(), seen["toxic"].to_numpy().astype(float)
    w = np.where(y > 0, all_toxic / max(y.sum(), 1), all_clean / max((1 - y).sum(), 1))
    lexicon.slope, lexicon.level = _logistic(x, y, w)
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one feature by Newton's method, with a slight ridge."""
    theta = np.array([1.0, -2.0])
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        grad = design.T @ (w * (y - p)) - 1e-2 * theta
        curve = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        theta = theta + np.clip(np.linalg.solve(curve, grad), -2, 2)
    return float(max(theta[0], 1e-3)), float(theta[1])


def scores(lexicon: Lexicon):
    """A function of the text column giving the probability of label 1; null and empty texts have no evidence."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        automaton = lexicon.automaton()
        parts = [_scores(b.column(0), lexicon, automaton) for b in slices([pa.RecordBatch.from_arrays([text], ["text"])])]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score.asNondeterministic()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **bounds) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs(doc_id, text)``.

    Labels (``doc_id, toxic``) are learned from rows that are not held out (crc32 of the doc_id as text, modulo 4, is 2); null labels and
    labels without a doc_id are left out. A null or empty text scores as one without matches. Repeated rows score alike. Other columns
    are no input.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    lexicon = learn(docs.select("doc_id", "text"), known, **bounds)
    score = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scores(lexicon)(F.col("text")).alias("score"))
    return score.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))



@registered("op2_toxicity")
def op2(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
