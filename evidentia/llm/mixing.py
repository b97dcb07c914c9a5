"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents lie in blocks of their source by a hash of their id; the blocks of a source have a permuted order. A
source's target, in words, is as many whole passes over its blocks and, of one more pass, the first blocks in that
order, the last of them in part. Over the exact number of block draws of each source stands a tree: a node hands half
of its draws, in the order of their hashes, to its left child, so how many of each source these are is a
multivariate-hypergeometric draw. The leaves are output shards; each takes the next blocks of each source's order, so
the shards' blocks are disjoint, and shuffles its documents by a hash. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, shuffle_partitions, written

#: Weights by the sources' order, and what counts as a word.
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
SHARE, MOST = 1.5, 2.0
BLOCK_DOCS, SEED = 64, 7
#: A source has a block for so many documents, but no more blocks than this for each output shard: the plan stays small,
#: and a block stays a small part of a shard.
BLOCKS_PER_SHARD, LEAST_BLOCKS = 16, 4096
#: Output shards of the registered query.
OUTPUT_SHARDS = 16
#: A table of sources is broadcast up to so many rows (some tens of bytes each), else joined by shuffle.
BROADCAST_ROWS = 100_000


def _place(seed: int, *parts: Column | str) -> Column:
    """60 bits of an MD5 of the seed and the parts that are not null: an order that any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: no (0.. by code point, null last), source, source_size, n_docs, target.

    Handing excess on until no target is above its limit is filling vessels to one level: with sources sorted by
    limit / weight, the level is the largest (words - limits before) / (weights from here on).
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    numbered = per.withColumn("no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("no", F.lit(len(weights))) + 1).cast("int"))
    vessels = numbered.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order, every = Window.orderBy(F.col("limit") / F.col("weight"), "no"), Window.partitionBy()
    before = F.sum("limit").over(order) - F.col("limit")
    onward = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - before) / onward
    filled = vessels.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return filled.select("no", "source", "source_size", "n_docs", F.least("limit", F.greatest(F.lit(0.0), F.round(F.col("weight") * F.col("level"), 6))).alias("target"))


def _halved(quotas: DataFrame, seed: int) -> DataFrame:
    """The quotas (node, no, n) of each node's two children: of the node's draws the half with the smallest hashes goes
    left, one less than right if they are odd."""
    items = quotas.select("node", "no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    node = Window.partitionBy("node")
    ranked = items.withColumn("rank", F.row_number().over(node.orderBy(_place(seed, "node", "no", "i"), "no", "i"))).withColumn("total", F.count(F.lit(1)).over(node))
    goes = F.col("rank") <= F.floor(F.col("total") / 2)
    split = ranked.groupBy("node", "no").agg(F.count_if(goes).alias("left"), F.count_if(~goes).alias("right"))
    children = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("n")), F.struct((F.col("node") * 2 + 1).alias("node"), F.col("right").alias("n")))
    return split.select("no", F.inline(children)).where("n > 0").select("node", "no", "n")


def shard_quotas(draws: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(no, n_draws) per source -> (no, shard, n): how many of each source's draws each of ``shards`` (a power of two)
    gets; a row for each that gets any."""
    quotas, n = draws.where("n_draws > 0").select(F.lit(1).cast("long").alias("node"), "no", F.col("n_draws").cast("long").alias("n")), 1
    while n < shards:
        quotas, n = _halved(quotas, seed), n * 2
    return quotas.select("no", (F.col("node") - n).cast("int").alias("shard"), "n")


def default_shards(docs: DataFrame) -> int:
    return 1 << (shuffle_partitions(docs.sparkSession) - 1).bit_length()


def draws_of(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS, shards: int | None = None, seed: int = SEED):
    """The plan of a mix: a function that adds no, size, source_size, target, block and draws (of the block) to rows with
    doc_id, text and source. ``draws`` is an array of (copy, shard, words), null for a block that is never drawn.
    ``shards`` is a power of two; by default there are as many as shuffle partitions or up to twice that."""
    shards = shards or default_shards(docs)
    sizes = written(_sized(docs).select("doc_id", "source", "size"), "sizes")
    targets = written(source_targets(sizes, share, most, weights), "targets")
    small = targets.count() <= BROADCAST_ROWS
    n_blocks = F.least(F.lit(max(LEAST_BLOCKS, BLOCKS_PER_SHARD * shards)), F.ceil(F.col("n_docs") / BLOCK_DOCS)).cast("long")
    sources = targets.select("no", F.col("source").alias("_source"), "source_size", "target", n_blocks.alias("_blocks"))

    def placed(rows: DataFrame) -> DataFrame:
        found = rows.join(F.broadcast(sources) if small else sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        return found.withColumn("block", F.pmod(_place(seed, "doc_id"), "_blocks")).drop("_blocks")

    blocks = placed(sizes).groupBy("no", "block").agg(F.sum("size").alias("words"), F.max("source_size").alias("source_size"), F.max("target").alias("target"))
    order = Window.partitionBy("no").orderBy(_place(seed + 1, "no", "block"), "block")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ranked = blocks.withColumn("passes", passes).withColumn("before", F.sum("words").over(order) - F.col("words")).withColumn("place", F.row_number().over(order))
    rest = F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long") - F.col("before")
    ranked = ranked.withColumn("rest", F.least(F.col("words"), F.greatest(F.lit(0).cast("long"), rest)))
    # a whole draw for each pass, and one more for what is left of the target
    copies = F.transform(F.sequence(F.lit(1).cast("long"), F.col("passes") + 1), lambda c: F.struct(c.alias("copy"), F.when(c <= F.col("passes"), F.col("words")).otherwise(F.col("rest")).alias("words")))
    drawn = ranked.select("no", "block", "place", F.inline(copies)).where("words > 0")
    drawn = written(drawn.withColumn("at", F.row_number().over(Window.partitionBy("no").orderBy("copy", "place")) - 1), "draws")

    every = drawn.groupBy("no").agg(F.count(F.lit(1)).alias("n_draws"))
    upto = F.sum("n").over(Window.partitionBy("no").orderBy("shard"))
    ranges = shard_quotas(every, shards, seed + 2).withColumn("first", upto - F.col("n"))
    owner = ranges.select("no", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("at"))
    draws = written(drawn.join(owner, ["no", "at"]).groupBy("no", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard", "words"))).alias("draws")), "block-draws")

    def planned(rows: DataFrame) -> DataFrame:
        """``copies`` of each row: (copy, shard, words of the row that this copy takes)."""
        inside = Window.partitionBy("no", "block").orderBy(_place(seed + 3, "doc_id"), "doc_id", "size")
        before = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
        held = placed(_sized(rows)).join(draws, ["no", "block"], "left").withColumn("_before", before)
        taken = lambda d: F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), d["words"] - F.col("_before")))
        none = F.array().cast("array<struct<copy:bigint,shard:int,words:bigint>>")
        found = F.transform(F.coalesce("draws", none), lambda d: F.struct(d["copy"].alias("copy"), d["shard"].alias("shard"), taken(d).alias("words")))
        return held.withColumn("copies", F.filter(found, lambda d: d["words"] > 0)).drop("no", "block", "draws", "_before")

    return planned


def _sized(docs: DataFrame) -> DataFrame:
    return docs if "size" in docs.columns else docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken and ``copies``, an array of
    (copy, shard, words): the draws that have the document, where each goes and how many of its words that takes.

    A copy of fewer words than the document has takes its first words. Null texts have no words and are never taken;
    null is a source, the last. Rows that share an id lie in one block; each is taken for itself. An empty table gives
    no rows. A rerun gives the same rows. Other columns are not read. ``options``: those of ``draws_of``.
    """
    sizes = written(_sized(only(docs, doc_id=id_col, text=text_col, source=source_col)).drop("text"), "sizes")
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return draws_of(sizes, **options)(sizes).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "copies")


def mixed_documents(docs: DataFrame, shards: int | None = None, seed: int = SEED, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each copy of a document, cut after its first words where a
    copy takes only these (``n_chars`` follows), dealt to ``shards`` partitions and shuffled in each."""
    columns, shards = docs.columns, shards or default_shards(docs)
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), "doc_id", "text", "source")
    planned = draws_of(plain.select("doc_id", "text", "source"), shards=shards, seed=seed, **options)(plain)
    copies = planned.select("_row", "size", F.inline("copies"))
    part = F.array_join(F.slice(F.regexp_extract_all(F.col("_row.text"), F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    rows = copies.withColumn("_text", F.when(F.col("words") < F.col("size"), part).otherwise(F.col("_row.text")))
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64(F.lit(seed + 4), "_row.doc_id", "copy"))
    own = {"text": F.col("_text"), "n_chars": F.when(F.col("words") < F.col("size"), F.length("_text").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in columns else None}
    return rows.select(*[(own[c] if c in own else F.col(f"_row.`{c}`")).alias(c) for c in columns])


def _tree_sql(shards: int, seed: int) -> str:
    """CTEs t1, t2, ..: the quotas of each level of the tree, from quotas t1 (node, no, n)."""
    level, n, out = 1, 1, []
    while n < shards:
        rank = f"row_number() over (partition by node order by ('0x' || substr(md5('{seed}|' || node || '|' || no || '|' || i), 1, 15))::bigint, no, i)"
        out.append(f"i{level} as (select node, no, i, {rank} as k, count(*) over (partition by node) as total from (select node, no, unnest(range(1, n + 1)) as i from t{level}))")
        out.append(f"h{level} as (select node, no, count(*) filter (k <= total // 2) as l, count(*) filter (k > total // 2) as g from i{level} group by node, no)")
        out.append(f"t{level + 1} as (select node * 2 as node, no, l as n from h{level} where l > 0 union all select node * 2 + 1, no, g from h{level} where g > 0)")
        level, n = level + 1, n * 2
    return ",\n".join([*out, f"leaf as (select no, node - {n} as shard, n, sum(n) over (partition by no order by node) - n as first from t{level})"])


#: DuckDB SQL for ``op3_mixing``, for up to ``LEAST_BLOCKS`` blocks a source.
ORACLE_SQL = f"""
with sizes as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
s as (
    select source, sum(size) as source_size, count(*) as n, row_number() over (order by source nulls last) - 1 as no from sizes group by source
),
w as (select *, case no % 3 when 0 then {WEIGHTS[0]} when 1 then {WEIGHTS[1]} else {WEIGHTS[2]} end::double as weight, source_size * {MOST}::double as lim from s),
v as (
    select *, (sum(source_size) over () * {SHARE}::double - (sum(lim) over a - lim)) / (sum(weight) over () - sum(weight) over a + weight) as level
    from w window a as (order by lim / weight, no)
),
t as (
    select source, no, source_size::bigint as source_size, ceil(n / {BLOCK_DOCS})::bigint as blocks,
        least(lim, greatest(0, round(weight * max(level) over (), 6))) as target
    from v
),
d as (
    select z.*, t.no, t.source_size, t.target, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::varchar, '')), 1, 15))::bigint % t.blocks as block
    from sizes z join t on z.source is not distinct from t.source
),
b as (
    select no, block, sum(size)::bigint as words, any_value(source_size) as source_size, any_value(target) as target,
        ('0x' || substr(md5('{SEED + 1}|' || no || '|' || block), 1, 15))::bigint as place
    from d group by no, block
),
r as (
    select *, case when source_size > 0 then floor(target / source_size) else 0 end as passes, sum(words) over o - words as before, row_number() over o as rank
    from b window o as (partition by no order by place, block)
),
q as (select no, block, rank, passes, words, least(words, greatest(0, round(target - passes * source_size)::bigint - before)) as rest from r),
c as (select no, block, rank, copy, case when copy <= passes then words else rest end as words from (select *, unnest(range(1, passes::bigint + 2)) as copy from q)),
y as (select *, row_number() over (partition by no order by copy, rank) - 1 as at from c where words > 0),
t1 as (select 1::bigint as node, no, count(*) as n from y group by no),
{_tree_sql(OUTPUT_SHARDS, SEED + 2)},
z as (select y.no, y.block, y.copy, y.words, leaf.shard from y join leaf on y.no = leaf.no and y.at >= leaf.first and y.at < leaf.first + leaf.n),
e as (
    select *, row_number() over () as r, sum(size) over (partition by no, block order by ('0x' || substr(md5('{SEED + 3}|' || coalesce(doc_id::varchar, '')), 1, 15))::bigint, doc_id, size rows unbounded preceding) - size as before
    from d
),
x as (select e.r, z.copy, z.shard, least(e.size, greatest(0, z.words - e.before))::bigint as words from e join z on e.no = z.no and e.block = z.block),
m as (select r, sum(words)::bigint as taken, string_agg(copy || ':' || shard || ':' || words, ' ' order by copy) as shards from x where words > 0 group by r)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken, coalesce(shards, '') as shards from e left join m using (r)
"""
