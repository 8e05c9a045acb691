"""Best-fit packing of tokenised documents into sequences of a fixed capacity, in bulk-synchronous rounds.

A round takes the documents of one band of lengths, the longest first. Documents and gaps of open sequences stand in one order, by
size and then by rank; a gap larger than the band offers several slots. A sweep through that order from large to small keeps a stack
of slots: a document takes the top, its successor, which is the smallest slot left that holds it. Where more documents than slots
meet, rank decides, and the others go on to the next larger slots. How deep the stack is at each size follows from counts per size;
slots and documents are numbered by that depth, so a window per depth matches them all at once. Documents for which the stack is empty
open sequences and fill them in the order of their ranks. Then gaps are updated and the next band begins.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelight.llm.ranks import ranked, with_row_id
from cuelight.llm.tables import registered, stored, table
from cuelight.llm.words import Words, slices

CAPACITY = 4096
#: bands end at halves, quarters ... of the capacity, so two documents of the first never share a sequence; lengths up to SMALL are one band
SMALL = 64
#: numbers of sequences that are numbered together
CHUNK_BITS = 14


#: letters and digits of ASCII, and its other signs but the apostrophe (it may begin a token with the letters after it)
KINDS = np.zeros(256, np.uint8)
KINDS[0x21:0x7F] = 2
for _first, _last in (b"09", b"AZ", b"az"):
    KINDS[_first : _last + 1] = 1
KINDS[0x27] = 0


class WordIds:
    """Token ids of words, each distinct word encoded once.

    For tokenizers that drop white space and encode runs of letters, digits and other signs on their own; then a text's ids are its
    words' ids in order, and a full stop after a letter is a word of its own.
    Words are told apart by 64-bit hashes; ``keep`` bounds how many are remembered from one slice of texts to the next. With ``lower``
    the tokenizer lower-cases, so words may be lower-cased before they are told apart. Where a special token's name is near, words
    are left whole and as they are.
    """

    #: new words encoded in one call; beside them stands a character that the vocabulary holds as one token
    CALL, PARTS = 200, "€£♥★"

    def __init__(self, path: str, lower: bool = False, keep: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task is the unit of parallel work
        from tokenizers import Tokenizer

        self.tokenizer, self.lower, self.keep = Tokenizer.from_file(path), lower, keep
        self.names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        single = [(c, self._ids(c)) for c in self.PARTS]
        self.part, self.part_id = next(((c, i[0]) for c, i in single if len(i) == 1), (None, -1))
        self.clear()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def words(self, texts: pa.Array) -> Words:
        named = any(pc.any(pc.match_substring(texts, n, ignore_case=True)).as_py() for n in self.names)
        return Words(texts) if named else Words(texts, lower=self.lower, kinds=KINDS)

    def clear(self) -> None:
        #: sorted hashes of the words met, and where the ids of each lie in ``ids``
        self.known, self.start, self.length, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        found, lengths = [], []
        for i in range(0, len(texts), self.CALL):
            call = texts[i : i + self.CALL]
            joined = f" {self.part} ".join(call)
            if self.part and joined.count(self.part) == len(call) - 1 and not any(n in joined for n in self.names):
                ids = np.array(self._ids(joined), "<u4")
                between = ids == self.part_id
                found.append(ids[~between])
                lengths.append(np.diff(np.flatnonzero(between), prepend=-1, append=len(ids)) - 1)
            else:
                own = [np.array(self._ids(t), "<u4") for t in call]
                found += own
                lengths.append(np.array([len(o) for o in own]))
        length = np.concatenate(lengths).astype(np.int64)
        start = len(self.ids) + np.cumsum(length) - length
        self.ids = np.concatenate([self.ids, *found])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.start, self.length = np.concatenate([self.start, start])[order], np.concatenate([self.length, length])[order]

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where the ids of each word begin."""
        hashes, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.known) > self.keep:
            self.clear()
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[at] != hashes) if len(self.known) else np.arange(len(hashes))
        if len(new):
            data = words.data
            self._learn(hashes[new], [data[words.start[w] : words.end[w]].tobytes().decode() for w in first[new].tolist()])
            at = np.searchsorted(self.known, hashes)
        at = at[which]
        length = self.length[at]
        ends = np.concatenate([[0], np.cumsum(length)])
        return self.ids[np.repeat(self.start[at] - ends[:-1], length) + np.arange(ends[-1])], ends


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False, lower: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids``) of every piece of every row of ``docs``.

    A row's tokens are the ids of its whole text, without special ones, and ``end_id``; a null or blank text has ``end_id`` alone.
    Only longer rows are cut. ``lower``: the tokenizer lower-cases. Equal rows are rows of their own; other columns are not read; an empty table has no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = WordIds(path, lower), np.array([end_id], "<u4")
        for batch in slices(batches):
            words = coder.words(batch.column(1))
            flat, ends = coder.encode(words)
            rows, out = [], []
            for r in range(batch.num_rows):
                ids = np.concatenate([flat[ends[words.first[r]] : ends[words.first[r + 1]]], end])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append(r)
                    out.append((k, at, len(part), zlib.crc32(part.tobytes()), part.tolist() if with_ids else None))
            columns = list(zip(*out)) or [[]] * 5
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:4]]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(columns[4], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def sweep_depths(gaps: dict[int, int], docs: dict[int, int], high: int) -> tuple[dict[int, int], dict[int, tuple[int, int]]]:
    """The stack at each size, from large to small: its depth before the slots of a gap size are pushed, and for each length its depth
    before documents are matched and how many are. One entry per size at most."""
    depth, below, matched = 0, {}, {}
    for size in sorted({*gaps, *docs}, reverse=True):
        if size in gaps:
            below[size] = depth
            depth += gaps[size] * max(size // high, 1)
        if size in docs:
            matched[size] = depth, min(depth, docs[size])
            depth -= matched[size][1]
    return below, matched


#: of each length in a band: stack depth, matched documents, how many go to the sequence begun before, it and what it holds, the first new one
PLAN = "length long, _depth long, _taken long, _carry long, _begun long, _fill long, _opened long"


def openings(band: dict[int, tuple[int, int, int]], opened: int, capacity: int) -> tuple[list[tuple], list[tuple[int, int]], int]:
    """Sequences for the documents of a band (length: depth, matched, count) that found no gap, longest first.

    Gives the plan per length, the (sequence, free) of those not filled by one length, and the number of sequences now open.
    """
    plan, ended, begun, fill = [], [], -1, capacity
    for length in sorted(band, reverse=True):
        depth, taken, count = band[length]
        carry = min(count - taken, (capacity - fill) // length)
        plan.append((length, depth, taken, carry, begun, fill, opened))
        fill += carry * length
        rest = count - taken - carry
        if rest:
            if begun >= 0:
                ended.append((begun, capacity - fill))
            full, some = divmod(rest, capacity // length)
            opened += full + (some > 0)
            begun, fill = (opened - 1, some * length) if some else (-1, capacity)
    return plan, ended + ([(begun, capacity - fill)] if begun >= 0 else []), opened


def _slots(gaps: DataFrame, below: dict[int, int], high: int) -> DataFrame:
    """depth, at (size), seq, slot and free of every slot of the gaps: as many of the band's longest as a gap holds, one at least."""
    spark = gaps.sparkSession
    base = spark.createDataFrame(list(below.items()), "free long, _base long")
    gaps = gaps.withColumn("_k", F.greatest(F.floor(F.col("free") / high), F.lit(1))).withColumn("_chunk", F.shiftright("seq", CHUNK_BITS))
    counts = gaps.groupBy("free", "_chunk").agg(F.sum("_k").alias("_n"))
    before = Window.partitionBy("free").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("free", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("free", "_chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    numbered = gaps.withColumn("_inside", F.coalesce(F.sum("_k").over(inside), F.lit(0))).join(counts, ["free", "_chunk"]).join(base, "free")
    each = numbered.withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k"))))
    return each.select((F.col("_base") + F.col("_before") + F.col("_inside") + F.col("slot")).alias("depth"), F.col("free").alias("at"), "seq", "slot", "free")


def _matches(docs: DataFrame, slots: DataFrame) -> DataFrame:
    """_doc, seq and offset of the documents (depth, at, _doc): at one depth slots and documents take turns, so a document's slot is the
    row before it."""
    nothing = {c: F.lit(None).cast("long").alias(c) for c in ("seq", "slot", "free")}
    both = slots.withColumn("_doc", F.lit(None).cast(docs.schema["_doc"].dataType)).unionByName(docs.select("depth", "at", *nothing.values(), "_doc"))
    turn = Window.partitionBy("depth").orderBy(F.desc("at"), F.col("_doc").isNotNull())
    slot = F.lag(F.struct("seq", "slot", "free")).over(turn)
    met = both.select("_doc", slot.alias("_slot")).where("_doc is not null").select("_doc", "_slot.*")
    upto = Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return met.select("_doc", "seq", "free", F.coalesce(F.sum("_doc.length").over(upto), F.lit(0)).alias("_before"))


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``parts`` as ``_doc``, each with its ``sequence_id`` and its ``offset`` there.

    ``parts`` has a ``length`` from 1 to the capacity. Sequences are gapless from offset 0. Rows of one length are placed in the order
    they were stored in; equal rows are rows of their own.
    """
    spark = parts.sparkSession
    rows = with_row_id(parts.select(F.struct(*[F.col(f"`{c}`") for c in parts.columns]).alias("_doc"), F.col("length").cast("long").alias("length")))
    rows = stored(ranked(rows, "length", [F.col("_row")]).drop("_row", "size"))
    # at most one entry per length up to the capacity, here and in the counts of gaps below
    left = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 1 <= n <= capacity for n in left):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    placed, gaps, sizes, opened = [], None, {}, 0
    while left:
        high = max(left)
        low = capacity
        while low >= high:
            low //= 2
        low = low if high > SMALL else 0
        band = {n: left.pop(n) for n in list(left) if n > low}
        below, matched = sweep_depths({n: c for n, c in sizes.items() if n > low}, band, high)
        plan, ended, opened = openings({n: (*matched[n], c) for n, c in band.items()}, opened, capacity)
        plan = spark.createDataFrame(plan, PLAN)
        docs = rows.where((F.col("length") > low) & (F.col("length") <= high)).join(plan, "length")
        fits = gaps
        if sum(taken for _, taken in matched.values()):
            waiting = docs.where("rank < _taken").select((F.col("_depth") - F.col("rank")).alias("depth"), F.col("length").alias("at"), "_doc")
            met = stored(_matches(waiting, _slots(gaps.where(F.col("free") > low), below, high)))
            placed.append(met.select("_doc", F.col("seq").alias("sequence_id"), (capacity - F.col("free") + F.col("_before")).alias("offset")))
            used = met.groupBy("seq").agg(F.sum("_doc.length").alias("_used"))
            fits = gaps.join(used, "seq", "left").select("seq", (F.col("free") - F.coalesce("_used", F.lit(0))).alias("free"))
        # the documents of a length that open sequences: some fill the sequence begun by longer ones, the others full ones and one more
        each, i = F.floor(F.lit(capacity) / F.col("length")), F.col("rank") - F.col("_taken")
        placed.append(docs.where((i >= 0) & (i < F.col("_carry"))).select("_doc", F.col("_begun").alias("sequence_id"), (F.col("_fill") + i * F.col("length")).alias("offset")))
        i = i - F.col("_carry")
        new = docs.where(i >= 0).select("_doc", "length", (F.col("_opened") + F.floor(i / each)).alias("seq"), (i % each).alias("_slot"),
                                        (i % each == each - 1).alias("_full"))
        placed.append(new.select("_doc", F.col("seq").alias("sequence_id"), (F.col("_slot") * F.col("length")).alias("offset")))
        if left:
            # a gap below the least length left is full
            fresh = [new.where("_full").select("seq", (capacity - F.col("length") * (F.col("_slot") + 1)).alias("free")),
                     spark.createDataFrame(ended, "seq long, free long"), *([fits] if fits else [])]
            gaps = stored(reduce(DataFrame.unionByName, fresh).where(F.col("free") >= min(left)))
            sizes = {r["free"]: r["n"] for r in gaps.groupBy("free").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not placed:
        return rows.select("_doc", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return reduce(DataFrame.unionByName, placed)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` with their places in sequences."""
    return pack(pieces(docs, path, capacity, end_id, with_ids), capacity).select("_doc.*", "sequence_id", "offset")


def sequences(places: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and the joined ids of each sequence of :func:`packed` rows with ids."""
    part = F.struct("offset", "ids")
    return places.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["ids"])).alias("ids"))


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@registered("op12_best_fit_packing")
def op12(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"), public_vocabulary())
