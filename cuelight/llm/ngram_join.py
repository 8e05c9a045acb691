"""N-gram Jaccard join by vertical partitioning.

All n-grams get one global order, rare ones first, and the order is cut into fragments. A document becomes one sorted segment per
fragment. Overlaps of a pair are counted within each fragment on its own and summed per pair; the sum decides exactly.

* **Order.** Every n-gram's 64-bit hash falls into one of 2^18 bins; the bins are counted over all documents and ranked by count. The
  rank replaces the bin in the hash, so hashes compare in the global order. Any order gives the same links; this one keeps common
  n-grams out of the prefixes. The table of bins has a fixed size.
* **Candidates.** Two sets with Jaccard >= t share k n-grams among the first ``n - ceil(t n) + k`` of each (prefix), lie within t of each
  other's size (length), and leave enough n-grams after the first shared one (position). k is 8, less for the smallest sets.
* **Copies and near copies.** Equal sets are one node. Each shared prefix n-gram first links its nodes to one hub, the node that it
  stands earliest in; verified links make classes; then only nodes of different classes meet. A tight group of G near copies so costs
  about G pairs instead of G^2, and no link between two classes is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelight.llm.graph import components
from cuelight.llm.tables import registered, stored, table
from cuelight.llm.words import Words, grams, list_array, slices, U

BIN_BITS = 18
SHARED = 8
FILTER_BITS = 1 << 23
LOW = U(64 - BIN_BITS)


def _sets(batches, n):
    """(slice of the batch, distinct n-gram hashes of each of its texts), lower-case A-Z."""
    for batch in slices(batches):
        words = Words(batch.column("text"), lower=True)
        hashes = words.hashes()
        yield batch, [np.unique(grams(hashes[words.row(r)], n)) for r in range(len(words))]


def bin_counts(texts: DataFrame, n: int) -> np.ndarray:
    """Number of (document, n-gram) pairs per bin over all documents: 2^18 numbers, whatever the input."""

    def count(batches):
        total = np.zeros(1 << BIN_BITS, np.int64)
        for _, sets in _sets(batches, n):
            for s in sets:
                np.add.at(total, (s >> LOW).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bin", "n"])

    summed = texts.mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BIN_BITS, np.int64)
    out[summed["bin"].to_numpy()] = summed["n"].to_numpy()
    return out


class GramOrder:
    """The global order and its fragments, from the counts of the bins."""

    def __init__(self, counts: np.ndarray, fragments: int):
        by_count = np.argsort(counts, kind="stable")
        self.rank = np.empty(len(counts), U)
        self.rank[by_count] = np.arange(len(counts), dtype=U)
        before = np.cumsum(counts[by_count])
        share = before[-1] / fragments
        self.cuts = np.searchsorted(before, share * np.arange(1, fragments)).astype(U) << LOW

    def apply(self, hashes: np.ndarray) -> np.ndarray:
        """The hashes relabelled so that their order is the global one, sorted."""
        return np.sort((self.rank[(hashes >> LOW).astype(np.int64)] << LOW) | (hashes & ((U(1) << LOW) - U(1))))

    def segments(self, ordered: np.ndarray) -> list[tuple[int, np.ndarray]]:
        edges = [0, *np.searchsorted(ordered, self.cuts), len(ordered)]
        return [(f, ordered[a:b]) for f, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]


def _node(ordered: np.ndarray) -> int:
    """A 64-bit name of a set; 0 is the empty set."""
    return int(grams(ordered, len(ordered))[0].view(np.int64)) if len(ordered) else 0


def _nodes(texts, order, n, percent):
    """doc_id, set size, node and prefix of every document."""

    def rows(batches):
        for batch, sets in _sets(batches, n):
            ordered = [order.value.apply(s) for s in sets]
            prefix = [o[: len(o) - -(-percent * len(o) // 100) + SHARED] for o in ordered]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(o) for o in ordered], pa.int64()), pa.array([_node(o) for o in ordered], pa.int64()),
                list_array(prefix, pa.int64())], ["doc_id", "n", "node", "prefix"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(rows, f"doc_id {kind}, n long, node long, prefix array<long>")


def _segments(texts, order, n):
    def rows(batches):
        for batch, sets in _sets(batches, n):
            want = batch.column("node").to_numpy()
            node, frag, toks = [], [], []
            for s, w in zip(sets, want):
                ordered = order.value.apply(s)
                if _node(ordered) == w:
                    for f, seg in order.value.segments(ordered):
                        node.append(int(w))
                        frag.append(f)
                        toks.append(seg)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(frag, pa.int32()), list_array(toks, pa.int64())], ["node", "frag", "grams"])

    return texts.mapInArrow(rows, "node long, frag int, grams array<long>")


def _fits(percent, nx, ny, px, py) -> F.Column:
    """Length and position filter: if it is the first that the two share, the n-grams from the shared one on are enough for
    the overlap that the sizes need."""
    x, y, i, j = (F.col(c) for c in (nx, ny, px, py))
    return (F.least(x - i, y - j) * (100 + percent) >= percent * (x + y)) & (F.least(x, y) * 100 >= F.greatest(x, y) * percent)


def _sharing(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes share as many n-grams as those of linked sets do: all others that two sets have in common lie after the
    prefix of the one whose prefix ends first."""
    left, right = (prefixes.select(F.col("node").alias(s), F.col("grams").alias("g" + s)) for s in "ab")
    rest = lambda c: F.greatest(F.ceil(F.col(c) * percent / 100) - SHARED, F.lit(0))
    most = F.size(F.array_intersect("ga", "gb")) + F.greatest(rest("na"), rest("nb"))
    return pairs.join(left, "a").join(right, "b").where(most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).drop("ga", "gb")


def _maybe(ids: DataFrame):
    """A test that holds for every hash in ``ids(h)`` and for few others: one bit for each of 2^23 remainders, 1 MB for any input.
    Beyond about as many ids it holds for all and spares nothing."""
    at = ids.select((F.pmod("h", F.lit(FILTER_BITS)) + 1).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS, bool)
    for p in parts:
        block = np.unpackbits(np.frombuffer(p["bits"], np.uint8), bitorder="little")
        bits[(p["bucket"] - 1) * len(block) : p["bucket"] * len(block)] = block
    sent = ids.sparkSession.sparkContext.broadcast(np.packbits(bits))

    @F.arrow_udf("boolean")
    def test(h: pa.Array) -> pa.Array:
        at = h.to_numpy() % FILTER_BITS
        return pa.array((sent.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))

    return test


def _linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose overlap, summed over the fragments, reaches the threshold. Neither side has a bounded size, so
    neither is broadcast."""
    left = segments.select(F.col("node").alias("a"), "frag", F.col("grams").alias("ga"))
    right = segments.select(F.col("node").alias("b"), "frag", F.col("grams").alias("gb"))
    partial = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), ["b", "frag"]).select("a", "b", "na", "nb", "frag", F.size(F.array_intersect("ga", "gb")).alias("part"))
    partial = partial.groupBy("a", "b", "na", "nb", "frag").agg(F.max("part").alias("part"))  # once, though a row may be repeated
    both = partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    return both.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b")


def _live(grams: DataFrame, percent: int) -> DataFrame:
    """The rows (node, n, at, gram) whose n-gram a node of fitting size has too, of the nodes that have enough such rows for a link."""
    by_size = Window.partitionBy("gram").orderBy("n", "node")
    fit = lambda a, b: a * 100 >= b * percent
    live = grams.withColumn("less", F.lag("n").over(by_size)).withColumn("more", F.lead("n").over(by_size)) \
        .where(fit(F.col("less"), F.col("n")) | fit(F.col("n"), F.col("more"))).select("gram", "node", "n", "at")
    live = stored(live)
    needs = F.greatest(F.lit(1), F.least(F.lit(SHARED), F.floor(F.col("n") * (percent / 100) ** 3)))
    alive = live.groupBy("node").agg(F.min("n").alias("n"), F.count("*").alias("c")).where(F.col("c") >= needs).select("node")
    return stored(live.join(alive, "node"))


def _components(docs: DataFrame, n: int, percent: int, fragments: int) -> tuple:
    """The order, every row with its node, every node with its component, and the node and doc_id of each component's least document."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    order = spark.sparkContext.broadcast(GramOrder(bin_counts(texts, n), fragments))  # 2^18 numbers
    rows = _nodes(texts, order, n, percent)
    classes = stored(rows.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("low"), F.min("n").alias("n"), F.first("prefix").alias("prefix")))

    spread = classes.select("node", "n", F.posexplode("prefix").alias("at", "gram"))
    live = _live(spread, percent)  # prefix n-grams that documents of like size share
    for _ in range(2):  # and again among the documents that are left: n-grams shared by chance go
        live = _live(live, percent)

    wanted = live.select("node").distinct().join(classes.select("node", "low"), "node")
    wanted = stored(wanted)
    near = texts.where(_maybe(wanted.select(F.xxhash64("low").alias("h")))(F.xxhash64("doc_id")))
    segments = stored(_segments(
        near.join(wanted, near["doc_id"].eqNullSafe(wanted["low"])).select("node", "text"), order, n))

    hub = live.groupBy("gram").agg(F.min(F.struct("at", "n", "node")).alias("h"))
    hubs = live.join(hub, "gram").select(
        F.col("node").alias("a"), F.col("h.node").alias("b"), F.col("n").alias("na"), F.col("h.n").alias("nb"), "at", F.col("h.at").alias("hat"))
    hubs = hubs.where("a <> b").where(_fits(percent, "na", "nb", "at", "hat")).select("a", "b", "na", "nb").distinct()
    prefixes = live.groupBy("node").agg(F.collect_list("gram").alias("grams"))
    hubs = stored(_sharing(hubs, prefixes, percent))
    first = stored(_linked(hubs, segments, percent))
    root = components(first)

    held = live.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = held.groupBy("gram").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("gram")
    held = held.join(mixed, "gram")
    side = lambda s: held.select("gram", *[F.col(c).alias(c + s) for c in ("node", "n", "at", "root")])
    cross = side("a").join(side("b"), "gram").where("nodea < nodeb and roota <> rootb").where(_fits(percent, "na", "nb", "ata", "atb"))
    cross = cross.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b"), "na", "nb").distinct()
    cross = stored(_sharing(cross, prefixes, percent))
    final = components(first.unionByName(_linked(cross, segments, percent)))

    named = classes.select("node", "low").join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"), F.min(F.struct(F.col("low").isNull(), "low", "node")).alias("best"))
    return order, rows, named.join(lows, "root").select("node", "component_id"), lows.select("best.node", "best.low")


def ngram_components(docs: DataFrame, n: int = 3, percent: int = 90, fragments: int = 8) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of ``docs(doc_id, text)``.

    Words are runs of bytes other than 0x20, 0x09-0x0D, lower-cased A-Z; the set of a text holds its distinct ``n``-word shingles, the
    whole sequence if it has fewer words. Documents link when ``100 * |A & B| >= percent * |A | B|``; ``component_id`` is the least
    doc_id reachable by links. A null or blank text has the empty set and links with nothing, so its component is its own doc_id.
    Repeated rows are copies. Rows without a doc_id take part; their component is null unless they reach a row with one. Other columns
    are ignored. The links hold whatever ``fragments`` is.
    """
    _, rows, named, _ = _components(docs, n, percent, fragments)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "node").join(named, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def without_near_copies(docs: DataFrame, n: int = 5, percent: int = 80, fragments: int = 8) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id, of equal ones the least text. Rows without words stay."""
    order, _, _, best = _components(docs, n, percent, fragments)

    @F.arrow_udf("long")
    def node(text: pa.Array) -> pa.Array:
        found = [_node(order.value.apply(s)) for _, sets in _sets([pa.RecordBatch.from_arrays([text], ["text"])], n) for s in sets]
        return pa.array(found, pa.int64())

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), node.asNondeterministic()(F.col("text")).alias("_node"))
    blank = rows.where("_node = 0").select("_doc")
    best = best.select(F.col("node").alias("_node"), F.col("low").alias("_low"))
    kept = rows.withColumn("_low", F.col("_doc.doc_id")).where("_node <> 0")
    kept = kept.join(best, (kept["_node"] == best["_node"]) & kept["_low"].eqNullSafe(best["_low"]), "left_semi").dropDuplicates(["_node", "_low"])
    return kept.select("_doc").unionByName(blank).select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


@registered("op1_ngram_jaccard_join")
def op1(spark, sf_dir):
    return ngram_components(table(spark, sf_dir, "documents"))
