"""Merkle manifest of a dataset by a nested-struct rollup.

Each document is a leaf. The leaves of a source, in the order of their ids, form a tree of arity three, and so do the tops of all
sources. A node's rank is written in digits of base three. Inside a block of 3 ** DIGITS ranks the digit columns are grouped away one
after the other, the lowest first: each grouping hashes up to three children and nests their structs, so a block ends as one row that
holds its subtree. Blocks are the nodes of the next tier, which is rolled up in the same way. Then the tiers are walked downwards: a
block receives the path above it by grouping it together with that path, and nested transforms and one explode emit its nodes, each
with the siblings on its whole way to the root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelight.llm.ranks import ranked, with_row_id
from cuelight.llm.tables import registered, stored, table

ARITY = 3
#: digits in a block: 729 nodes, about 200 KB
DIGITS = 6
BLOCK = ARITY**DIGITS
#: powers of the arity up to 2^63
POWERS = [ARITY**i for i in range(40)]
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    return digest(*[field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)])


def levels(size: Column) -> Column:
    """How often a group of that size is rolled up until one node is left."""
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in POWERS]), lambda p: p < size))


def nest(nodes: DataFrame) -> DataFrame:
    """Blocks (group, block, height, digest, below) of nodes (group, rank, height, digest, own).

    ``height`` is how many levels a group has from these nodes on; a level beyond it hands on its only child.
    """
    digits = [f"_d{i}" for i in range(DIGITS)]
    frame = nodes.select(
        "group", F.floor(F.col("rank") / BLOCK).alias("block"), "height",
        *[(F.floor(F.col("rank") / POWERS[i]) % ARITY).cast("tinyint").alias(d) for i, d in enumerate(digits)], "digest", F.col("own").alias("below"))
    # the one exchange: every later grouping keeps these keys
    frame = frame.repartition("group", "block")
    for i, d in enumerate(digits):
        child = F.struct(F.col(d).alias("at"), "digest", "below")
        frame = frame.groupBy("group", "block", "height", *digits[i + 1:]).agg(F.array_sort(F.collect_list(child)).alias("_kids"))
        hashed = F.sha2(F.array_join(F.transform("_kids", lambda k: k["digest"]), ""), 256)
        frame = frame.withColumn("digest", F.when(F.col("height") > i, hashed).otherwise(F.col("_kids")[0]["digest"])).withColumnRenamed("_kids", "below")
    return frame


def unnest(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """The nodes of nested blocks: group, own, path, top. ``above``: group, block, path, top of each block.

    ``path`` has a struct (left, right) of joined sibling digests per level, the node's own level first. A block and the path above it
    meet in one group.
    """
    both = blocks.select("group", "block", "height", "below", F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("string").alias("top"))
    both = both.unionByName(above.select("group", "block", "path", "top"), allowMissingColumns=True)
    met = both.groupBy("group", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("height", "below", "path", "top")])

    def joined(kids: Column, keep) -> Column:
        return F.array_join(F.transform(F.filter(kids, keep), lambda s: s["digest"]), "")

    def nodes(kids: Column, level: int, path: Column) -> Column:
        def one(k: Column) -> Column:
            step = F.struct(joined(kids, lambda s: s["at"] < k["at"]).alias("left"), joined(kids, lambda s: s["at"] > k["at"]).alias("right"))
            # ``path`` once, as every mention of it is evaluated
            here = F.concat(F.when(F.col("height") > level, F.array(step)).otherwise(F.array().cast(PATH)), path)
            if level == 0:
                return F.array(F.struct(k["below"].alias("own"), here.alias("path")))
            return nodes(k["below"], level - 1, here)

        return F.flatten(F.transform(kids, one))

    found = met.select("group", "top", F.explode(nodes(F.col("below"), DIGITS - 1, F.col("path"))).alias("_node"))
    return found.select("group", "_node.own", "_node.path", "top")


def proofs(nodes: DataFrame, finish) -> DataFrame:
    """group, own, path, top of every node (group, rank, size, digest, own).

    ``finish`` gets the last digest of each group (group, digest) and gives the path above it (group, path, top).
    """
    nodes = nodes.withColumn("height", levels(F.col("size"))).drop("size")
    tiers = []
    while True:
        tiers.append(stored(nest(nodes)))
        tall = tiers[-1].where(F.col("height") > DIGITS)
        if tall.isEmpty():
            break
        nodes = tall.select("group", F.col("block").alias("rank"), (F.col("height") - DIGITS).alias("height"), "digest", F.struct("block").alias("own"))
    done = [t.where(F.col("height") <= DIGITS).select("group", "digest", F.lit(i).alias("tier")) for i, t in enumerate(tiers)]
    done = stored(reduce(DataFrame.unionByName, done))
    ends = stored(finish(done))
    below = None
    for i in reversed(range(len(tiers))):
        above = ends.where(F.col("tier") == i).select("group", F.lit(0).cast("long").alias("block"), "path", "top")
        if below is not None:
            above = above.unionByName(below.select("group", F.col("own.block").alias("block"), "path", "top"))
        below = unnest(tiers[i], above)
        below = stored(below) if i else below
    return below


def _root(done: DataFrame) -> DataFrame:
    """The tree over the groups, by the order of their names; its one group has the root on top."""
    numbered = ranked(done.withColumn("_all", F.lit("")), "_all", [F.col("group")])
    nodes = numbered.select(F.col("_all").alias("group"), "rank", "size", "digest",
                            F.struct(F.col("group").alias("name"), "digest", "tier").alias("own"))
    over = proofs(nodes, lambda d: d.select("group", "tier", F.array().cast(PATH).alias("path"), F.col("digest").alias("top")))
    return over.select(F.col("own.name").alias("group"), F.col("own.tier").alias("tier"), "path", "top", F.col("own.digest").alias("subroot"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, altered, subroot, root and ``path`` of every row: siblings (left, right) level by level up to the root.

    ``altered`` is the leaf of the row with the line feeds taken from its text where two divides the crc32 of the decimal doc_id, else
    the leaf. Leaves of a source ascend by doc_id, rows without one first; rows of equal doc_id follow by leaf, and equal rows have
    equal leaves. Rows without a source are a source of their own, the first. Null fields are ``-`` in a leaf. Other columns are not
    read. An empty table has no rows.
    """
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    altered = F.when(even & F.col("text").contains("\n"), leaf(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    own = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("group"),
                      leaf(F.col("text")).alias("digest"), altered.alias("altered"))
    rows = ranked(with_row_id(own), "group", [F.asc_nulls_first("doc_id"), F.col("digest"), F.col("_row")])
    nodes = rows.select("group", "rank", "size", "digest",
                        F.struct("doc_id", F.col("digest").alias("leaf"), F.coalesce("altered", "digest").alias("altered")).alias("own"))

    def finish(done: DataFrame) -> DataFrame:
        tops = _root(done)
        # the source's own top travels on the path's way down
        return tops.select("group", "tier", "path", F.concat_ws(":", "subroot", "top").alias("top"))

    found = proofs(nodes, finish)
    return found.select("own.*", F.split_part("top", F.lit(":"), F.lit(1)).alias("subroot"), F.split_part("top", F.lit(":"), F.lit(2)).alias("root"), "path")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda acc, s: digest(s["left"], acc, s["right"]))


def siblings_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def verified(docs: DataFrame) -> DataFrame:
    """The manifest with each proof's digest, the root folded from the altered leaf, and whether it is the root."""
    rows = manifest(docs).withColumn("folded_root", folded(F.col("altered"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(source_levels: int = 16, top_levels: int = 12) -> str:
    """All levels of all trees by grouping, then each document's siblings by a join."""
    out = []

    def climb(name: str, n: int) -> None:
        for i in range(n):
            out.append(f"""{name}{i + 1} as (select g, r // 3 as r, (any_value(n) + 2) // 3 as n,
  case when any_value(n) > 1 then sha256(string_agg(h, '' order by r)) else any_value(h) end as h from {name}{i} group by g, r // 3)""")

    text = lambda t: " || ".join(
        f"case when {c} is null then '-' else strlen({c}::varchar)::varchar || ':' || {c}::varchar end" for c in ("doc_id", "source", "lang", "n_chars", t))
    crc = """xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, length(doc_id::varchar) + 1),
  lambda i: [ascii(substr(doc_id::varchar, i, 1))::bigint, 0, 0, 0, 0, 0, 0, 0]))),
  lambda x, y: xor(xor(x, y) >> 1, 3988292384 * (xor(x, y) & 1))), 4294967295)"""
    out.append(f"""d as (select doc_id, coalesce('=' || source, '') as g, sha256({text('text')}) as h,
  case when {crc} % 2 = 0 then sha256({text("replace(text, chr(10), '')")}) else sha256({text('text')}) end as altered from documents)""")
    out.append("a0 as (select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 as r, count(*) over (partition by g) as n from d)")
    climb("a", source_levels)
    out.append(f"b0 as (select 'top' as g, row_number() over (order by g) - 1 as r, count(*) over () as n, h, g as s from a{source_levels})")
    climb("b", top_levels)
    tree = lambda name, n, depth: " union all ".join(
        f"select {depth} + {i} as lvl, g, r, n, h from {name}{i}" for i in range(n))
    out.append(f"ta as ({tree('a', source_levels, 0)}), tb as ({tree('b', top_levels, 100)})")
    step = """select x.{key}, t.lvl, coalesce(string_agg(t.h, '' order by t.r) filter (t.r < x.r // p), '') as lo,
  coalesce(string_agg(t.h, '' order by t.r) filter (t.r > x.r // p), '') as hi
  from {nodes} x, (select unnest(range({n})) as i, 3 ** unnest(range({n})) as p), {tree} t
  where t.lvl = i + {depth} and t.g = x.g and t.n > 1 and t.r // 3 = (x.r // p::bigint) // 3 group by x.{key}, t.lvl"""
    step = step.replace("x.r // p)", "x.r // p::bigint)")
    out.append("docs as (select *, row_number() over () as id from a0)")
    out.append("pa as (" + step.format(key="id", nodes="docs", n=source_levels, depth=0, tree="ta") + ")")
    out.append("pb as (" + step.format(key="s", nodes="b0", n=top_levels, depth=100, tree="tb") + ")")
    out.append("path as (select id, lvl, lo, hi from pa union all select id, lvl, lo, hi from docs, pb where docs.g = pb.s)")
    out.append("""found as (select docs.id, any_value(doc_id) as doc_id, any_value(docs.h) as leaf, any_value(altered) as altered, any_value(g) as g,
  sha256(coalesce(string_agg(lo || hi, '' order by lvl), '')) as proof_sha256, list(lo || ':' || hi order by lvl) filter (lvl is not null) as steps
  from docs left join path on docs.id = path.id group by docs.id)""")
    return "with " + ",\n".join(out) + f""",
done as (select doc_id, leaf, b0.h as subroot, (select h from b{top_levels}) as root, proof_sha256,
  list_reduce(list_prepend(altered, coalesce(steps, [])), lambda x, y: sha256(split_part(y, ':', 1) || x || split_part(y, ':', 2))) as folded_root
  from found join b0 on found.g = b0.s)
select *, folded_root = root as verified from done"""


@registered("op11_merkle_manifest", _sql())
def op11(spark, sf_dir):
    return verified(table(spark, sf_dir, "documents"))
