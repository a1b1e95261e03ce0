"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

Documents are the leaves' stock of a tree domain > language > source. A token
budget flows from the root to the leaves: at every node it is shared among the
children in proportion to their weights, a child never gets more than its
subtree can supply (available tokens times ``epochs``), and what a child
cannot take goes to its siblings in proportion to their weights. Since a
node's budget never exceeds its supply, a shortage reaches an ancestor's other
children only after all siblings are full. All amounts are integers: shares
are floors, and the tokens left over go one each to the first children by
name.

Each leaf then takes a token-prefix of its seeded epochs: the documents in the
order of md5(seed, epoch, doc_id), epoch after epoch, until its budget is
spent; the last document may be cut. The order is split by the first three
digits of that digest (4096 parts per leaf and epoch), so running totals are
taken over part sums and inside single parts: a source that holds a third of
all rows is spread over as many tasks.

Tokens are words (runs of characters other than space and ``\\t``..``\\r``).

Defined results: null or empty texts have no tokens and are never taken; null
lang or source form leaves named ``''``. Repeated rows (same doc_id) are
separate stock, ordered by text after the digest; rows equal in every column
used are taken in an arbitrary but equal way. Leaves without a weight get weight
``default_weight``; weight 0 takes nothing unless nothing else is left. An empty
table gives an empty result. Only ``doc_id``, ``text``, ``lang`` and
``source`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.deploy import free_name, written

LEVELS = ["domain", "lang", "source"]


@dataclass(frozen=True)
class MixParams:
    """``budget``: tokens to select, or ``share`` of the available tokens when None."""

    budget: int | None = None
    share: float = 0.5
    epochs: int = 2
    seed: int = 17
    default_weight: int = 10
    # weight by (level, name); a child without an entry has default_weight
    weights: dict[tuple[str, str], int] = field(default_factory=lambda: {
        ("domain", "d0"): 40, ("domain", "d1"): 30, ("domain", "d2"): 20, ("domain", "d3"): 10,
        ("lang", "en"): 50, ("lang", "de"): 20, ("lang", "fr"): 20, ("lang", "es"): 10,
        ("source", "src0"): 5})


PRODUCTION = MixParams()
PIPELINE = MixParams(share=0.8, epochs=1)


def domain_of(source: Column) -> Column:
    """The domain of a source: d0..d3, by a checksum of its name."""
    return F.concat(F.lit("d"), (F.crc32(source.cast("binary")) % 4).cast("string"))


def _weight(level: str, params: MixParams) -> Column:
    out = None
    for (of, name), weight in params.weights.items():
        if of == level:
            hit = F.col(level) == name
            out = F.when(hit, F.lit(weight)) if out is None else out.when(hit, F.lit(weight))
    default = F.lit(params.default_weight)
    return (default if out is None else out.otherwise(default)).cast("decimal(20,0)")


def share_out(children: DataFrame, parent: list[str], level: str, params: MixParams) -> DataFrame:
    """One row per child with its integer ``budget``; ``children`` has the parent's
    columns, ``level`` (the child's name), ``supply`` and ``parent_budget``.

    Children are taken in the order of supply / weight. A child is full if its
    proportional share of what the full ones before it leave over reaches its
    supply; the children after the last full one share the rest.
    """
    rows = children.withColumn("weight", _weight(level, params))
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    # weight 0 sorts last: it only takes what nobody else can
    ratio = F.when(F.col("weight") > 0, F.col("supply") / F.col("weight").cast("double"))
    order = by.orderBy(ratio.asc_nulls_last(), level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    wide = "decimal(38,0)"
    zero = F.lit(0).cast(wide)
    rows = (rows
            .withColumn("spent", F.coalesce(F.sum(F.col("supply").cast("decimal(20,0)")).over(before), zero))
            .withColumn("rest_weight", F.sum("weight").over(after))
            .withColumn("rest", F.greatest(F.col("parent_budget") - F.col("spent"), zero).cast("decimal(18,0)"))
            .withColumn("full", F.when(F.col("weight") == 0, F.col("rest") >= F.col("supply")).otherwise(
                F.col("weight") * F.col("rest") >= F.col("supply") * F.col("rest_weight"))))
    # rows up to the first child that is not full
    rows = rows.withColumn("open", F.max((~F.col("full")).cast("int")).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first_open = by.orderBy(F.col("open").desc(), ratio.asc_nulls_last(), level)
    rows = (rows
            .withColumn("left_over", F.first("rest").over(first_open))
            .withColumn("left_weight", F.first("rest_weight").over(first_open)))
    share = F.expr("case when left_weight = 0 then least(cast(rest as decimal(38,0)), cast(supply as decimal(38,0)))"
                   " else cast(weight * left_over as decimal(38,0)) div cast(left_weight as decimal(38,0)) end")
    rows = rows.withColumn("share", F.when(F.col("open") == 0, F.col("supply")).otherwise(share).cast("long"))
    given = F.sum(F.when(F.col("open") == 1, F.col("share")).otherwise(0)).over(by)
    place = F.row_number().over(by.orderBy(
        (F.when((F.col("open") == 1) & (F.col("weight") > 0), 0).otherwise(1)), level))
    extra = F.when((F.col("open") == 1) & (F.col("left_weight") > 0) & (F.col("weight") > 0)
                   & (place <= F.col("left_over") - given), 1).otherwise(0)
    return rows.withColumn("budget", F.col("share") + extra).select(
        *parent, level, "supply", F.col("budget").cast("long").alias("budget"))


def leaf_budgets(stock: DataFrame, params: MixParams) -> DataFrame:
    """(domain, lang, source, supply, budget) for every leaf of ``stock`` (leaf, tokens)."""
    supply = F.sum("tokens") * F.lit(params.epochs)
    leaves = stock.groupBy(*LEVELS).agg(supply.alias("supply"))
    root = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("total"))
    wanted = (F.lit(params.budget) if params.budget is not None else
              F.floor(F.col("total") / params.epochs * params.share)).cast("long")
    root = root.select(F.least(wanted, F.col("total")).alias("parent_budget"))
    above: list[str] = []
    for level in LEVELS:
        nodes = leaves.groupBy(*above, level).agg(F.sum("supply").alias("supply"))
        if above:
            nodes = nodes.join(root.withColumnRenamed("budget", "parent_budget").drop("supply"), above)
        else:
            nodes = nodes.withColumn("parent_budget", root.select("parent_budget").scalar())
        root = share_out(nodes, above, level, params)
        above = [*above, level]
    return root


def stock_of(docs: DataFrame) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, text_key) per document with a token."""
    words = F.regexp_replace(F.coalesce("text", F.lit("")), r"^[ \t-\r]+|[ \t-\r]+$", "")
    count = F.when(F.length(words) == 0, 0).otherwise(F.size(F.split(words, r"[ \t-\r]+")))
    source = F.coalesce("source", F.lit(""))
    return docs.select(
        "doc_id", domain_of(source).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"),
        source.alias("source"), count.cast("long").alias("tokens"),
        F.xxhash64("text").alias("text_key")).where("tokens > 0")


def select_mix(docs: DataFrame, params: MixParams = PRODUCTION) -> DataFrame:
    """One row per selected document and epoch: doc_id, domain, lang, source, epoch,
    n_tokens, taken (the last document of a leaf may give only its first ones)."""
    stock = written(stock_of(docs), "stock")  # words are counted once, for four readers
    budgets = leaf_budgets(stock, params).where("budget > 0")
    digest = F.md5(F.concat_ws(":", F.lit(params.seed).cast("string"), F.col("epoch").cast("string"),
                               F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    passes = stock.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(params.epochs - 1))))
    passes = passes.withColumn("place", digest).withColumn("part", F.substring("place", 1, 3))
    # sums of 4096 parts per leaf and epoch, then their running totals
    parts = passes.groupBy(*LEVELS, "epoch", "part").agg(F.sum("tokens").alias("part_tokens"))
    in_order = Window.partitionBy(*LEVELS).orderBy("epoch", "part")
    parts = parts.withColumn("part_end", F.sum("part_tokens").over(in_order)).join(budgets, LEVELS)
    parts = parts.withColumn("part_start", F.col("part_end") - F.col("part_tokens")).where(
        "part_start < budget").select(*LEVELS, "epoch", "part", "part_start", "budget")
    inside = Window.partitionBy(*LEVELS, "epoch", "part").orderBy("place", "doc_id", "text_key")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = passes.join(parts, [*LEVELS, "epoch", "part"]).withColumn(
        "start", F.col("part_start") + F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    return rows.where("start < budget").select(
        "doc_id", *LEVELS, "epoch", F.col("tokens").alias("n_tokens"),
        F.least("tokens", F.col("budget") - F.col("start")).alias("taken"), "text_key")


def keep_mix(docs: DataFrame, params: MixParams = PIPELINE) -> DataFrame:
    """The rows of ``docs`` (all columns) that the mix selects, once each (``epochs``
    is 1); a document that would be cut is kept whole."""
    taken = select_mix(docs, params).select("doc_id", "text_key").distinct()
    owner, key = free_name(docs, "owner"), free_name(docs, "key")
    taken = taken.select(F.col("doc_id").alias(owner), F.col("text_key").alias(key))
    hit = F.col("doc_id").eqNullSafe(F.col(owner)) & (F.xxhash64("text") == F.col(key))
    return docs.join(taken, hit, "left_semi")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return select_mix(docs).drop("text_key")


def _share_out_sql(nodes: str, parent: str, level: str, p: MixParams) -> str:
    cases = " ".join(f"when {level} = '{n}' then {w}" for (of, n), w in p.weights.items()
                     if of == level)
    by = f"partition by {parent}" if parent else ""
    cols = f"{parent}, " if parent else ""
    ratio = "case when w > 0 then supply / w::double end"
    return f"""
(with n0 as (select *, (case {cases} else {p.default_weight} end)::hugeint w from {nodes}),
 n1 as (select *, greatest(parent_budget - coalesce(sum(supply) over ({by} order by {ratio} nulls last,
   {level} rows between unbounded preceding and 1 preceding), 0), 0)::hugeint rest, sum(w) over ({by} order by
   {ratio} nulls last, {level} rows between current row and unbounded following)::hugeint rw from n0),
 n2 as (select *, case when w = 0 then rest >= supply else w * rest >= supply * rw end is_full from n1),
 n3 as (select *, max((not is_full)::int) over ({by} order by {ratio} nulls last, {level}
   rows between unbounded preceding and current row) open from n2),
 n4 as (select *, first_value(rest) over ({by} order by open desc, {ratio} nulls last, {level}) lo,
   first_value(rw) over ({by} order by open desc, {ratio} nulls last, {level}) lw from n3),
 n5 as (select *, case when open = 0 then supply when lw = 0 then least(rest, supply)
   else (w * lo) // lw end share from n4),
 n6 as (select *, lo - sum(case when open = 1 then share else 0 end) over ({by or ''}) miss,
   row_number() over ({by} order by case when open = 1 and w > 0 then 0 else 1 end, {level}) place from n5)
 select {cols}{level}, supply, (share + case when open = 1 and lw > 0 and w > 0 and place <= miss
   then 1 else 0 end)::bigint budget from n6)"""


def mixing_sql(p: MixParams = PRODUCTION) -> str:
    """The mix in DuckDB SQL: one running total per leaf instead of parts. DuckDB has
    no crc32, so the domains of the (few) source names are written out."""
    import zlib

    names = ["", *(f"src{i}" for i in range(1000))]
    groups = {d: ",".join(f"'{n}'" for n in names if zlib.crc32(n.encode()) % 4 == d)
              for d in range(4)}
    domain = " ".join(f"when source in ({g}) then 'd{d}'" for d, g in groups.items())
    d = _share_out_sql("(select domain, sum(supply) supply, (select b from total) parent_budget"
                       " from leaves group by all)", "", "domain", p)
    lang = _share_out_sql("(select l.domain, lang, sum(l.supply) supply, any_value(budget) parent_budget"
                          " from leaves l join doms using (domain) group by all)", "domain", "lang", p)
    src = _share_out_sql("(select l.domain, l.lang, source, sum(l.supply) supply, any_value(budget)"
                         " parent_budget from leaves l join langs using (domain, lang) group by all)",
                         "domain, lang", "source", p)
    total = "sum(supply)" if p.budget is None else str(p.budget)
    budget = (f"floor(sum(supply) / {p.epochs} * {p.share})" if p.budget is None else total)
    return f"""
with base as (select doc_id, coalesce(lang, '') lang, coalesce(source, '') source,
   len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) tokens from documents),
 stock as (select *, case {domain} end as domain from base where tokens > 0),
 leaves as (select domain, lang, source, sum(tokens) * {p.epochs} supply from stock group by all),
 total as (select least({budget}, sum(supply))::hugeint b from leaves),
 doms as {d}, langs as {lang}, srcs as {src},
 passes as (select s.*, e.epoch, md5('{p.seed}:' || e.epoch || ':' || coalesce(doc_id::varchar, 'null')) place
   from stock s, (select unnest(range({p.epochs}))::int epoch) e),
 runs as (select p.*, b.budget, coalesce(sum(tokens) over (partition by p.domain, p.lang, p.source
   order by epoch, place, doc_id rows between unbounded preceding and 1 preceding), 0) st
   from passes p join srcs b using (domain, lang, source))
select doc_id, domain, lang, source, epoch, tokens::bigint n_tokens,
 least(tokens, budget - st)::bigint taken from runs where st < budget"""
