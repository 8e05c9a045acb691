"""Line dedup by overlapping windows of three consecutive lines.

Each run of three lines is hashed; equal windows are found over all documents; every window but the first (least doc_id, then least
position) is a repeat, and the lines that repeats cover are removed, overlapping positions merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.tables import registered, table

WORD = r"[^\x20\x09-\x0D]"


def _key(docs: DataFrame) -> list:
    """A row is named by its doc_id and its text: rows equal in both are one document."""
    return [docs["doc_id"].alias("_id"), F.xxhash64(docs["text"]).alias("_text")]


def repeated_windows(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(_id, _text, starts)``: for each document with repeats, where its repeated windows start (lines count from 0)."""
    lines = docs.where("text is not null").select(*_key(docs), F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= width)
    lines = lines.select("_id", "_text", F.transform("lines", lambda x: F.struct(
        F.xxhash64(x).alias("a"), F.xxhash64(F.lit(width), x).alias("b"), F.rlike(x, F.lit(WORD)).alias("w"))).alias("h"))
    cells = lambda part, i: [F.element_at(F.col("h"), i + F.lit(k))[part] for k in range(1, width + 1)]

    def window(i):
        some = cells("w", i)[0]
        for c in cells("w", i)[1:]:
            some = some | c
        return F.struct(i.alias("at"), F.xxhash64(*cells("a", i)).alias("a"), F.xxhash64(*cells("b", i)).alias("b"), some.alias("w"))

    windows = lines.select("_id", "_text", F.inline(F.transform(F.sequence(F.lit(0), F.size("h") - width), window))).where("w")
    windows = windows.select("a", "b", F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_text", "at").alias("place"))
    first = windows.groupBy("a", "b").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(first, ["a", "b"]).where("place > first")
    return later.groupBy("place._id", "place._text").agg(F.collect_set("place.at").alias("starts"))


def _cut(width: int):
    @F.arrow_udf("kept string, n_lines long, n_removed long")
    def cut(text: pa.Array, starts: pa.Array) -> pa.Array:
        kept, count, gone = [], [], []
        for t, at in zip(text, starts):
            t = t.as_py()
            if t is None or not at.is_valid:
                kept.append(t)
                count.append(0 if t is None else t.count("\n") + 1)
                gone.append(0)
                continue
            lines = t.split("\n")
            covered = np.zeros(len(lines) + 1, np.int64)
            at = at.values.to_numpy()
            covered[at] += 1
            covered[at + width] -= 1
            covered = np.cumsum(covered[:-1]) > 0
            kept.append("\n".join(x for x, c in zip(lines, covered) if not c))
            count.append(len(lines))
            gone.append(int(covered.sum()))
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(count, pa.int64()), pa.array(gone, pa.int64())], ["kept", "n_lines", "n_removed"])

    return cut.asNondeterministic()


def dedup_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """The rows of ``docs`` as ``_doc``, with ``_lines`` (``kept`` text, ``n_lines``, ``n_removed``).

    Lines are what ``\\n`` parts, compared as they are. A text of fewer lines than ``width`` has no window and stays; windows without a
    word don't count. Texts without a doc_id come after all others. Rows equal in doc_id and text are one document and are decided
    alike. A null text stays null, with 0 lines. Windows are judged on the input, not on what is left.
    """
    starts = repeated_windows(docs, width)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *_key(docs))
    joined = rows.join(starts, rows["_id"].eqNullSafe(starts["_id"]) & (rows["_text"] == starts["_text"]), "left")
    return joined.select("_doc", _cut(width)(F.col("_doc.text"), F.col("starts")).alias("_lines"))


def with_lines_removed(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` with repeated lines cut from ``text`` (and ``n_chars`` counted anew); texts of which no word is left go."""
    new = {"text": F.col("_lines.kept"), "n_chars": F.length("_lines.kept").cast("long")}
    kept = dedup_lines(docs, width).where((F.col("_lines.n_removed") == 0) | F.rlike(F.col("_lines.kept"), F.lit(WORD)))
    return kept.select(*[(new[c] if c in new else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


@registered("op7_line_dedup", r"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
  from documents where text is not null),
w as (
  select doc_id, pos, line, lead(line, 1) over d as l2, lead(line, 2) over d as l3 from l window d as (partition by doc_id order by pos)),
r as (
  select doc_id, pos, row_number() over (partition by line, l2, l3 order by doc_id, pos) as occurrence from w
  where l3 is not null and regexp_matches(line || l2 || l3, '[^\x20\x09-\x0D]')),
gone as (select distinct doc_id, pos + k as pos from r, (values (0), (1), (2)) as t(k) where occurrence > 1),
kept as (
  select l.doc_id, count(*) as n_lines, count(gone.pos) as n_removed,
         coalesce(string_agg(l.line, chr(10) order by l.pos) filter (where gone.pos is null), '') as kept
  from l left join gone on l.doc_id = gone.doc_id and l.pos = gone.pos group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join kept using (doc_id)
""")
def op7(spark, sf_dir):
    rows = dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("_doc.doc_id", "_lines.n_lines", "_lines.n_removed", F.sha2(F.coalesce("_lines.kept", F.lit("")), 256).alias("kept_sha256"))
