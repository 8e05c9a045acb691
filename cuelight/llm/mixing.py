"""Mixing sources to target weights by temperature.

A source's weight is its share of the tokens raised to an exponent. The exponent is bisected, on the table of sources alone: the
largest one whose weights reach a target entropy, but not below the least one that keeps repetition within its limit. The budget is
the least that gives every source all its documents once. Weights are realised as block permutations: each source passes through
whole permutations of its documents, and the last, partial block takes documents in the block's order while its budget lasts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelight.llm.tables import registered, stored, table

#: each round narrows the exponent's bracket this many times
SECTIONS, ROUNDS = 32, 4
SEED = "block"


def n_tokens(text: Column) -> Column:
    """Words of the text; one for a text without words, so that its row has a weight."""
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)), F.lit(1)).cast("long")


def exponent(shares: DataFrame, entropy: float, repeats: float) -> float:
    """The exponent for sources with shares ``p`` of the tokens.

    The entropy of the weights, as a part of that of equal weights, falls as the exponent grows from 0 to 1; so does the largest
    repetition, ``(max p / min p) ** (1 - exponent)``.
    """
    found = []
    for goal in ("entropy", "repeats"):
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            step = (high - low) / SECTIONS
            points = shares.select("p", F.explode(F.array(*[F.lit(low + step * i) for i in range(SECTIONS + 1)])).alias("x"))
            power = F.pow(F.col("p"), F.col("x"))
            by = points.groupBy("x").agg(
                F.sum(power).alias("z"), F.sum(power * F.ln("p")).alias("l"), F.count("*").alias("n"), F.max("p").alias("hi"), F.min("p").alias("lo"))
            h = (F.ln("z") - F.col("x") * F.col("l") / F.col("z")) >= F.ln("n") * entropy - 1e-9
            if goal == "entropy":
                at = by.where(h).agg(F.max("x")).first()[0]
                low, high = (0.0, 0.0) if at is None else (at, min(at + step, high))
            else:
                at = by.where(F.pow(F.col("hi") / F.col("lo"), 1 - F.col("x")) <= repeats + 1e-9).agg(F.min("x")).first()[0]
                low, high = (1.0, 1.0) if at is None else (max(at - step, low), at)
        found.append(low if goal == "entropy" else high)
    return max(found)


def copies(docs: DataFrame, entropy: float = 0.999, repeats: float = 2.0) -> DataFrame:
    """The rows of ``docs`` as ``_doc``, with ``n_tokens`` and ``n_copies`` (how often the mixture takes the row, at least once).

    Rows without a source are a source of their own; a null or blank text counts one token. A row's place in a
    permutation follows from its doc_id (its text, if it has none), then from all its columns but maps, so the order of the table does not
    matter; rows that are equal in all of these follow one another in any order. An empty table gives an empty table.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), n_tokens(F.col("text")).alias("n_tokens"),
                       F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_source"))
    sources = stored(rows.groupBy("_source").agg(F.sum("n_tokens").alias("t")))
    total = sources.agg(F.sum("t").alias("total"), F.max("t").alias("top"))
    shares = sources.crossJoin(F.broadcast(total)).select("_source", "t", "top", (F.col("t") / F.col("total")).alias("p"))  # one row
    x = exponent(shares, entropy, repeats)
    plan = shares.select("_source", "t", F.pow(F.col("top") / F.col("t"), F.lit(1 - x)).alias("r"))
    plan = plan.select("_source", F.floor("r").alias("_whole"), F.floor((F.col("r") - F.floor("r")) * F.col("t")).alias("_rest"))

    # a permutation of a source is cut into 4,096 bins, so a source of any size is many small running sums
    # rows without a doc_id are spread over the bins by their texts
    name = F.coalesce(F.col("_doc.doc_id").cast("string"), F.concat(F.lit("="), F.md5(F.coalesce(F.col("_doc.text"), F.lit("")))))
    tie = F.xxhash64(*[F.col(f"_doc.`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    rows = rows.withColumn("_key", F.md5(F.concat(F.lit(SEED), name))).withColumn("_tie", tie)
    rows = rows.withColumn("_bin", F.substring("_key", 1, 3))
    bins = rows.groupBy("_source", "_bin").agg(F.sum("n_tokens").alias("b"))
    before = Window.partitionBy("_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("_source", "_bin", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("_before")).join(plan, "_source")
    inside = Window.partitionBy("_source", "_bin").orderBy("_key", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(bins, ["_source", "_bin"]).withColumn("_upto", F.sum("n_tokens").over(inside) + F.col("_before"))
    return rows.select("_doc", "n_tokens", (F.col("_whole") + (F.col("_upto") <= F.col("_rest")).cast("long")).alias("n_copies"))


def mixed(docs: DataFrame, entropy: float = 0.999, repeats: float = 2.0) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as it is taken."""
    taken = copies(docs, entropy, repeats).select("_doc", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))).alias("_block"))
    return taken.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def _sections(goal: str, entropy: float, repeats: float) -> str:
    """The bracket after each round, as chained CTEs."""
    out = [f"{goal}0 as (select 0e0 as low, 1e0 as high)"]
    for i in range(ROUNDS):
        grid = (f"select low + (high - low) / {SECTIONS} * k as x, low, high, (high - low) / {SECTIONS} as step "
                f"from {goal}{i}, (select unnest(range({SECTIONS + 1})) as k)")
        if goal == "entropy":
            ok = f"ln(sum(pow(p, x))) - x * sum(pow(p, x) * ln(p)) / sum(pow(p, x)) >= ln(count(*)) * {entropy!r}e0 - 1e-9"
            new = "coalesce(max(x), 0e0) as low, coalesce(least(max(x) + max(step), max(high)), 0e0) as high"
        else:
            ok = f"pow(max(p) / min(p), 1 - x) <= {repeats!r}e0 + 1e-9"
            new = "coalesce(greatest(min(x) - max(step), max(low)), 1e0) as low, coalesce(min(x), 1e0) as high"
        out.append(f"{goal}{i + 1} as (select {new} from (select x, low, high, step from ({grid}), share group by all having {ok}))")
    return ",\n".join(out)


def _sql(entropy: float = 0.999, repeats: float = 2.0) -> str:
    return f"""
with d as (
  select doc_id, source, greatest(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0), 1)::bigint as n_tokens,
         md5('{SEED}' || coalesce(doc_id::varchar, '')) as k from documents),
s as (select source, sum(n_tokens)::bigint as t from d group by source),
share as (select source, t, t::double / (select sum(t) from s)::double as p from s),
{_sections("entropy", entropy, repeats)},
{_sections("repeats", entropy, repeats)},
x as (select greatest(a.low, b.high) as x from entropy{ROUNDS} a, repeats{ROUNDS} b),
plan as (select source, t, pow((select max(t) from s)::double / t::double, 1e0 - x) as r from s, x),
placed as (select *, sum(n_tokens) over (partition by source order by k rows unbounded preceding) as upto from d)
select doc_id, placed.source, n_tokens, (floor(r) + (upto <= floor((r - floor(r)) * t))::int)::bigint as n_copies
from placed join plan on placed.source is not distinct from plan.source
"""


@registered("op8_temperature_mixing", _sql())
def op8(spark, sf_dir):
    return copies(table(spark, sf_dir, "documents")).select("_doc.doc_id", "_doc.source", "n_tokens", "n_copies")
