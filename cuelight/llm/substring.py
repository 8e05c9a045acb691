"""Substring dedup by FM-indexes of shards.

A window is ``width`` consecutive words. Windows are dealt to shards by content, so that equal windows meet whatever their documents:
a window's shard key is the least hash of its six-word grams, and neighbouring windows with one least gram travel as one segment. A key
that occurs once cannot repeat. Equal segments are one class; every occurrence but the first is a repeat as a whole. The first ones of keys
with several classes are indexed, shard by shard, and streamed against their shard's FM-index: backward search gives the matches of
``width`` words, and a window whose match has an earlier occurrence is a repeat.

Keys are counted first, in bins of fixed number. Those of crowded bins are neither sorted in one place nor indexed: the first of equal
segments, and where a key has many classes the first of equal windows, is a partial aggregation by the hash of the whole; a join marks the
others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelight.llm.fm_index import FmIndex
from cuelight.llm.tables import registered, stored, table
from cuelight.llm.words import Words, list_array, mix, slices, span_hashes

GRAM = 6
#: words of one FM-index
SHARD_WORDS = 1 << 17
#: a bin of keys with more segments than this, and than twice the mean above it, is crowded; a crowded key with more classes than this is
#: dealt window by window, by the hash of the whole window
CROWDED = 2048
BIN_BITS = 18
MAX = (1 << 63) - 1


def _windows(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments: first window, number of windows, shard key."""
    n = len(hashes)
    if n < width:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(n - GRAM + 1)
    low = span_hashes(hashes, at, at + GRAM)
    span, size, best = width - GRAM + 1, 1, at
    steps = []
    while size * 2 <= span:
        steps.append(size)
        size *= 2
    for step in [*steps, span - size]:  # the least gram of each window, the leftmost of equal ones
        left = low[: len(low) - step] <= low[step:]
        low, best = np.where(left, low[: len(low) - step], low[step:]), np.where(left, best[: len(best) - step], best[step:])
    row = np.repeat(np.arange(len(words)), np.diff(words.first))
    fits = row[: len(low)] == row[width - 1 :]
    new = np.ones(len(low), bool)
    new[1:] = (best[1:] != best[:-1]) | (row[1 : len(low)] != row[: len(low) - 1]) | ~fits[:-1]
    start = np.flatnonzero(new & fits)
    edge = np.append(np.flatnonzero(new | ~fits), len(low))
    count = edge[np.searchsorted(edge, start) + 1] - start
    return start, count, low[start].view(np.int64)


def _parts(batches, width: int):
    """Of each slice of the batches: the slice, its word hashes, and its segments (row, text_key, place, start, windows, key, same, inside)."""
    for batch in slices(batches):
        words = Words(batch.column("text"))
        hashes = words.hashes()
        start, count, key = _windows(words, hashes, width)
        row = np.searchsorted(words.first, start, "right") - 1
        place = start - words.first[row]
        text_key = batch.column("text_key").to_numpy()[row]
        same = span_hashes(hashes, start, start + count + width - 1).view(np.int64)
        # a segment that its own document has before is a repeat: neighbouring ones become one row, under a key of its own
        order = np.lexsort((start, same, row))
        inside = np.zeros(len(start), bool)
        inside[order[1:]] = (same[order[1:]] == same[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
        joins = np.zeros(len(start), bool)
        joins[1:] = inside[1:] & inside[:-1] & (row[1:] == row[:-1]) & (start[1:] == start[:-1] + count[:-1])
        head = np.flatnonzero(~joins)
        count = np.add.reduceat(count, head) if len(head) else count
        own = inside[head]
        key = np.where(own, mix(text_key[head] + place[head] + (row[head] << 32)).view(np.int64), key[head])
        yield batch, hashes, row[head], text_key[head], place[head], start[head], count, key, same[head], own


def _bin(key: np.ndarray) -> np.ndarray:
    return key & ((1 << BIN_BITS) - 1)


def crowded_bins(texts: DataFrame, width: int) -> np.ndarray:
    """Which of the 2^18 bins of shard keys hold so many segments that one of their keys may crowd a task."""

    def count(batches):
        total = np.zeros(1 << BIN_BITS, np.int64)
        for *_, key, _, own in _parts(batches, width):
            total += np.bincount(_bin(key[~own]), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bin", "n"])

    summed = texts.mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << BIN_BITS, np.int64)
    total[summed["bin"].to_numpy()] = summed["n"].to_numpy()
    return total > CROWDED + 2 * (int(total.sum()) >> BIN_BITS)


def _segments(width: int, crowded, wanted: bool):
    """The segments of the crowded bins with the hashes of their windows, or the others and those that their document has before."""

    def rows(batches):
        for batch, hashes, row, text_key, place, start, count, key, same, own in _parts(batches, width):
            at = np.flatnonzero((crowded.value[_bin(key)] & ~own) == wanted)
            cols = [pa.array(key[at]), pa.array(same[at]), batch.column("id").take(pa.array(row[at])), pa.array(text_key[at]), pa.array(place[at]),
                    pa.array(count[at].astype(np.int32))]
            if wanted:
                first = np.repeat(start[at] - np.cumsum(count[at]) + count[at], count[at]) + np.arange(count[at].sum())
                names = span_hashes(hashes, first, first + width)
                last = list_array(np.split(names, np.cumsum(count[at])[:-1]) if len(at) else [], pa.int64())
            else:
                last = pa.array(own[at])
            yield pa.RecordBatch.from_arrays([*cols, last], ["key", "same", "id", "text_key", "place", "windows", "names" if wanted else "inside"])

    return rows


def _shard_rows(width: int):
    """The words of the wanted segments."""

    def rows(batches):
        for batch in slices(batches):
            words = Words(batch.column("text"))
            hashes = words.hashes()
            ids, text_keys = (batch.column(c).to_pylist() for c in ("id", "text_key"))
            out = []
            for r, wanted in enumerate(batch.column("wanted").to_pylist()):
                own = hashes[words.row(r)]
                for w in wanted:
                    out.append((w["key"], ids[r], text_keys[r], w["place"], own[w["place"] : w["place"] + w["windows"] + width - 1]))
            cols = list(zip(*out)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array([x.view(np.int64) for x in cols[4]], pa.list_(pa.int64()))],
                ["key", "id", "text_key", "place", "words"])

    return rows


def repeated_in_shard(
    ids: np.ndarray, text_keys: np.ndarray, places: np.ndarray, texts: list[np.ndarray], width: int
) -> list[tuple[int, int, int, int]]:
    """Build the shard's index over the segments, stream them against it; (id, text_key, first word, end) of the words repeats cover."""
    sizes = np.array([len(t) for t in texts])
    _, names = np.unique(np.concatenate(texts), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    symbols = np.zeros(int((sizes + 1).sum()), np.int64)
    inside = np.ones(len(symbols), bool)
    inside[begin + sizes] = False
    symbols[inside] = names + 1
    of = np.repeat(np.arange(len(texts)), sizes + 1)
    offset = np.arange(len(symbols)) - begin[of]
    order = np.lexsort((text_keys, ids))
    doc = np.zeros(len(texts), np.int64)
    fresh = (ids[order[1:]] != ids[order[:-1]]) | (text_keys[order[1:]] != text_keys[order[:-1]])
    doc[order[1:]] = np.cumsum(fresh)
    key = (doc[of] << 40) | (places[of] + offset)
    index = FmIndex(symbols, width)
    found = index.matches(symbols, begin, begin + sizes)
    hit = np.flatnonzero(found >= 0)
    late = hit[index.least(key)[found[hit]] < key[hit]]
    out = []
    for run in np.split(late, np.flatnonzero((np.diff(late) > width) | (np.diff(of[late]) > 0)) + 1) if len(late) else []:
        s = of[run[0]]
        base = int(places[s]) - int(begin[s])
        out.append((int(ids[s]), int(text_keys[s]), base + int(run[0]), base + int(run[-1]) + width))
    return out


def _search(width: int):
    """Rows sorted by key: each run of whole keys of about SHARD_WORDS words is one index."""

    def rows(batches):
        held, size = [], 0

        def flush():
            got = repeated_in_shard(*(np.array([h[c] for h in held]) for c in (1, 2, 3)), [h[4] for h in held], width) if len(held) > 1 else []
            held.clear()
            cols = list(zip(*got)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "text_key", "start", "end"])

        for batch in batches:
            words = batch.column("words")
            flat, offsets = words.values.to_numpy(zero_copy_only=False), words.offsets.to_numpy()
            for i, name in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "id", "text_key", "place")))):
                if held and held[-1][:4] == name:
                    continue  # of a repeated row
                if size >= SHARD_WORDS and held and held[-1][0] != name[0]:
                    yield flush()
                    size = 0
                held.append((*name, flat[offsets[i] : offsets[i + 1]].copy()))
                size += len(held[-1][4])
        yield flush()

    return rows


def _named(docs: DataFrame) -> DataFrame:
    """``(id, text_key, doc_id, text)``: a row is named by its doc_id and a hash of its text, and ordered so, those without a doc_id last."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX)).alias("id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    half = F.shiftrightunsigned(F.xxhash64("text"), 1)  # below zero with a doc_id, so that MAX is no other row's id
    return texts.select("id", F.when(F.col("doc_id").isNull(), half).otherwise(F.bitwise_not(half)).alias("text_key"), "doc_id", "text")


def repeated_spans(docs: DataFrame, width: int = 20) -> DataFrame:
    """``docs(doc_id, text)`` as ``(id, text_key, doc_id, text, spans)``: spans of words (start, end) that repeats cover."""
    texts = _named(docs)
    name = ["id", "text_key"]
    at = F.struct(*name, "place")
    inputs = texts.select(*name, "text")
    bins = crowded_bins(inputs, width)
    crowded = docs.sparkSession.sparkContext.broadcast(bins)  # 2^18 flags
    columns = "key long, same long, id long, text_key long, place long, windows int, "

    segments = inputs.mapInArrow(_segments(width, crowded, False), columns + "inside boolean")
    by = Window.partitionBy("key", "inside").orderBy("same", *name, "place")
    equal = Window.partitionBy("key", "inside", "same").orderBy(*name, "place")
    segments = segments.withColumn("less", F.lag("same").over(by)).withColumn("more", F.lead("same").over(by))
    # a repeated row has its segments at the same places: they count once
    segments = segments.withColumn("copy", F.lag(at).over(equal) == at).withColumn("least", F.first(at).over(equal))
    segments = segments.where("(inside or less is not null or more is not null) and copy is not true").select(
        "key", *name, "place", "windows", (~F.col("inside") & (F.col("least") == at)).alias("first"))
    segments = stored(segments)

    span = lambda start, windows: [*name, start.alias("start"), (start + windows + (width - 1)).alias("end")]
    whole = segments.where("not first").select(*span(F.col("place"), F.col("windows")))
    first = segments.where("first")
    classes = first.groupBy("key").agg(F.count("*").alias("classes")).where("classes > 1")
    first = first.join(classes, "key").select("key", *name, "place", "windows")
    if bins.any():
        segments = stored(inputs.mapInArrow(_segments(width, crowded, True), columns + "names array<long>"))
        least = stored(segments.groupBy("key", "same").agg(
            F.min(F.struct(*name, "place", "windows", "names")).alias("least"), F.count("*").alias("n")).select("key", "same", "least.*", "n"))
        classes = least.groupBy("key").agg(F.count("*").alias("classes")).where("classes > 1")
        later = segments.drop("names").join(least.where("n > 1").select("key", "same", at.alias("least")), ["key", "same"]).where(at > F.col("least"))
        whole = whole.unionByName(later.select(*span(F.col("place"), F.col("windows"))))
        first = first.unionByName(least.join(classes.where(F.col("classes") <= CROWDED), "key").select(*first.columns))

        windows = least.join(classes.where(F.col("classes") > CROWDED), "key").select(*name, "place", F.posexplode("names").alias("k", "window"))
        windows = windows.select("window", *name, (F.col("place") + F.col("k")).alias("place"))
        least = windows.groupBy("window").agg(F.min(at).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
        whole = whole.unionByName(windows.join(least, "window").where(at > F.col("least")).select(*span(F.col("place"), F.lit(1))))
    wanted = first.groupBy(*name).agg(F.collect_list(F.struct("key", "place", "windows")).alias("wanted"))

    dealt = texts.repartition(*name)  # both joins read this one exchange
    shards = dealt.join(wanted, name).select(*name, "text", "wanted").mapInArrow(
        _shard_rows(width), "key long, id long, text_key long, place long, words array<long>")
    shards = shards.repartition("key").sortWithinPartitions("key", *name, "place")
    found = shards.mapInArrow(_search(width), "id long, text_key long, start long, end long")
    spans = whole.unionByName(found).groupBy(*name).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return dealt.join(spans, name, "left")


def _cut():
    @F.arrow_udf("kept string, n_words long, n_removed long")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(text, spans):
            raw = t.as_py().encode()
            words = raw.split()
            gone = 0
            if s.is_valid and words:
                edge = np.zeros(len(words) + 1, np.int64)
                parts = s.values
                start, end = (parts.field(i).to_numpy() for i in range(2))
                np.add.at(edge, start, 1)
                np.add.at(edge, end, -1)
                covered = np.cumsum(edge[:-1]) > 0
                gone = int(covered.sum())
                if gone:
                    words = [w for w, c in zip(words, covered.tolist()) if not c]
            out.append((b" ".join(words).decode(), len(words) + gone, gone))
        cols = list(zip(*out)) or [[], [], []]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64()))], ["kept", "n_words", "n_removed"])

    return cut.asNondeterministic()


def dedup_substrings(docs: DataFrame, width: int = 20) -> DataFrame:
    """``(doc_id, kept, n_words, n_removed)`` of every row of ``docs(doc_id, text)``; ``kept`` joins the words left by one space.

    Words are runs of bytes other than 0x20, 0x09-0x0D, unchanged. A word goes if a window of ``width`` words that covers it also starts
    earlier (smaller doc_id, or the same document and an earlier start), judged on the input. Null, empty and short texts have no
    window and keep all words. Documents without a doc_id come last. Rows equal in doc_id and text are one document and are decided
    alike; rows of one doc_id and different texts are ordered by a hash of the text. Other columns are ignored.
    """
    rows = repeated_spans(docs, width)
    return rows.select("doc_id", _cut()(F.col("text"), F.col("spans")).alias("_cut")).select("doc_id", "_cut.*")


@registered("op6_substring_dedup")
def op6(spark, sf_dir):
    rows = dedup_substrings(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
