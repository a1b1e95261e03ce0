"""Connected components and the linking of items that share signatures."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.deploy import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label) for every node of ``edges`` (a, b): label = smallest id of its component.

    Distributed union-find by contraction: every node points at its smallest
    neighbour, pointers are followed once, and the edges between the remaining
    roots go into the next round, until none is left. A star takes one round,
    a chain of n nodes O(log n). Every step is a keyed min or an equi-join, so
    a hub needs no gathering, and each round ends in files of the shared folder.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select(
            "id", F.least("id", "low").alias("up"))
        over = up.select(F.col("id").alias("up"), F.col("up").alias("label"))
        step = written(up.join(over, "up").select("id", "label"), "roots")
        if labels is None:
            labels = step
        else:
            move = step.select(F.col("id").alias("label"), F.col("label").alias("to"))
            labels = written(labels.join(move, "label", "left").select(
                "id", F.coalesce("to", "label").alias("label")), "labels")
        left = step.select(F.col("id").alias("a"), F.col("label").alias("la"))
        right = step.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        edges = written(edges.join(left, "a").join(right, "b").where("la <> lb").select(
            F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels


def shared_signatures(postings: DataFrame) -> DataFrame:
    """The postings (sig, id, ...) of signatures that two different ids have, once each."""
    by_id = Window.partitionBy("sig").orderBy("id")
    of_sig = Window.partitionBy("sig")
    return (postings
            .withColumn("again", F.lag("id").over(by_id) == F.col("id"))
            .withColumn("low", F.min("id").over(of_sig))
            .withColumn("high", F.max("id").over(of_sig))
            .where("low < high and (again is null or not again)")
            .drop("again", "low", "high"))


Step = Callable[[DataFrame], DataFrame]
Decode = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
BLOCK_IDS, BLOCK_SIZE = 1024, 1_000_000  # members and tokens (or bytes) of a block of a family


def link_by_signatures(postings: DataFrame, promising: Step, possible: Step,
                       fits: Callable[[], Column], fetch: Step, similar: Step, decode: Decode,
                       least: tuple[int, int]) -> DataFrame:
    """Links (a, b) of a Jaccard similarity of ``least`` (a fraction) or more, enough to
    give the components of all such links among the ids that share a signature.

    ``postings`` (sig, id, ...) comes from ``shared_signatures``; ``fetch`` turns a
    table of ids into (id, content), ``decode`` the contents of a task into their
    sets (all tokens, and the offsets of each set), and ``similar`` keeps the pairs
    (a, b, content_a, content_b) that are similar enough. First, an id is compared
    with one representative per signature, the member that shares most postings
    with others (the original of a group of edited copies); of these pairs,
    ``promising`` ones are verified. Then all that is still apart is covered
    exactly. Even signatures are single tokens or bands: their pairs in different
    components are formed, if they fit (``fits``, a condition on the columns
    ``..._a`` and ``..._b``), counted (``shared``), and verified where ``possible``,
    all pairs of a signature together (``group_links``). Members of a signature's
    largest component are met by the others only, so that a large group of copies
    costs its size, not its square. Odd signatures are combinations, of which similar ids share
    hundreds: ids connected by them form families, and the members of a family
    are compared block by block, without forming their pairs.
    """
    of_sig, by_id = Window.partitionBy("sig"), Window.partitionBy("id")
    postings = written(postings.withColumn("crowd", F.count(F.lit(1)).over(of_sig)).withColumn(
        "weight", F.sum("crowd").over(by_id)).drop("crowd"), "postings")
    names = [c for c in postings.columns if c not in ("sig", "weight")]

    def verified(pairs: DataFrame, contents: DataFrame) -> DataFrame:
        left = contents.select(F.col("id").alias("a"), F.col("content").alias("content_a"))
        right = contents.select(F.col("id").alias("b"), F.col("content").alias("content_b"))
        return similar(pairs.select("a", "b").join(left, "a").join(right, "b")).select("a", "b")

    def sets(ids: DataFrame) -> DataFrame:
        ids = written(ids.distinct(), "wanted")
        return written(fetch(ids).groupBy("id").agg(F.any_value("content").alias("content")), "contents")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("id"))

    head = F.first(F.struct(*names)).over(of_sig.orderBy(F.desc("weight"), "id"))
    stars = postings.withColumn("head", head).where("head.id <> id").select(
        "sig", *[F.col(f"head.{c}").alias(f"{c}_a") for c in names],
        *[F.col(c).alias(f"{c}_b") for c in names])
    stars = written(promising(_counted(stars, names)), "stars")
    links = written(verified(stars, sets(ends(stars))), "links")

    comp = F.coalesce("label", "id") if not links.isEmpty() else F.col("id")
    rows = postings.drop("weight")
    if not links.isEmpty():
        rows = rows.join(connected_components(links), "id", "left")
    rows = rows.withColumn("comp", comp).drop("label")
    apart = written(rows.withColumn("low", F.min("comp").over(of_sig)).withColumn(
        "high", F.max("comp").over(of_sig)).where("low < high").drop("low", "high"), "apart")

    single = apart.where(F.col("sig").bitwiseAND(1) == 0)
    names = [*names, "comp"]
    single = single.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("sig", "comp")))
    main = F.max(F.struct("members", "comp")).over(of_sig)["comp"]
    single = single.withColumn("main", F.col("comp") == main).drop("members")
    left = single.where("not main").select("sig", *[F.col(c).alias(f"{c}_a") for c in names])
    right = single.select(F.col("sig").alias("sig_b"), "main", *[F.col(c).alias(f"{c}_b") for c in names])
    pairs = left.join(right, (F.col("sig") == F.col("sig_b")) & (F.col("main") | (F.col("id_a") < F.col("id_b")))
                      & (F.col("comp_a") != F.col("comp_b")) & fits())
    pairs = possible(_counted(pairs, names)).select("a", "b", "sig")
    pairs = written(pairs.join(stars.select("a", "b"), ["a", "b"], "left_anti"), "pairs")

    combined = apart.where(F.col("sig").bitwiseAND(1) == 1)
    bonds = combined.select(F.first("id").over(of_sig.orderBy("id")).alias("a"), F.col("id").alias("b"))
    members = connected_components(bonds).withColumnRenamed("label", "family").join(
        combined.groupBy("id").agg(F.first("comp").alias("comp")), "id")
    members = written(members, "members")
    contents = sets(ends(pairs).unionByName(members.select("id")))
    return links.unionByName(written(group_links(pairs, contents, decode, least), "links")).unionByName(
        written(_family_links(members.join(contents, "id"), decode, least), "links"))


def _counted(pairs: DataFrame, names: list[str]) -> DataFrame:
    """One row per pair a < b: ``shared`` single and any ``combined`` signatures, the
    smallest signature, and both sides' columns."""
    swap = F.col("id_a") > F.col("id_b")
    extra = [c for c in names if c != "id"]
    return pairs.groupBy(
        F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).agg(
        F.count_if(F.col("sig").bitwiseAND(1) == 0).alias("shared"),
        F.bool_or(F.col("sig").bitwiseAND(1) == 1).alias("combined"), F.min("sig").alias("sig"),
        *[F.max(F.when(swap, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a"))).alias(f"{c}_a") for c in extra],
        *[F.max(F.when(swap, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))).alias(f"{c}_b") for c in extra])


def group_links(pairs: DataFrame, contents: DataFrame, decode: Decode, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of ``pairs`` (a, b, sig) that are similar enough.

    The pairs of a signature are verified together, so a content is sent once per
    signature, not once per pair. A signature beyond ``BLOCK_IDS`` ids or ``BLOCK_SIZE``
    of content is dealt into blocks, and the pairs between two blocks are one task's;
    small signatures share tasks.
    """
    is_list = contents.schema["content"].dataType.typeName() == "array"
    size = F.size("content") if is_list else F.octet_length("content")
    ends = pairs.select("sig", F.explode(F.array("a", "b")).alias("id")).distinct()
    groups = ends.join(contents.select("id", size.cast("long").alias("size")), "id").groupBy("sig").agg(
        F.sum("size").alias("size"), F.greatest(
            F.ceil(F.count(F.lit(1)) / BLOCK_IDS), F.ceil(F.sum("size") / BLOCK_SIZE)).cast("int").alias("blocks"))
    groups = written(groups, "groups")
    small = groups.where("blocks <= 1").agg(F.sum("size")).first()[0] or 0
    tasks = max(1, -(-small // BLOCK_SIZE))
    alone = F.col("blocks") <= 1
    cells = pairs.join(groups.select("sig", "blocks"), "sig").select(
        F.when(alone, F.pmod(F.xxhash64("sig"), F.lit(tasks))).otherwise(F.col("sig")).alias("task"),
        *[F.when(alone, F.lit(-1)).otherwise(F.pmod(F.xxhash64(end), F.col("blocks")).cast("int")).alias(at)
          for end, at in (("a", "i"), ("b", "j"))], "a", "b")
    key = ["task", "i", "j"]
    to = [f"to_{c}" for c in key]
    sent = cells.select(*[F.col(c).alias(t) for c, t in zip(key, to)], F.explode(F.array("a", "b")).alias("id"))
    sent = sent.distinct().join(contents, "id")

    def verify(wanted, table):
        ids = table.column("id").to_numpy()
        order = np.argsort(ids)
        values, offsets = decode(table.column("content").combine_chunks().take(pa.array(order)))
        a, b = (np.searchsorted(ids[order], wanted.column(c).to_numpy()) for c in ("a", "b"))
        keep = similar_of(values, offsets, a, b, *least)
        return wanted.select(["a", "b"]).filter(pa.array(keep))

    return cells.groupBy(*key).cogroup(sent.groupBy(*to)).applyInArrow(verify, "a long, b long")


def similar_of(values: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray, similar: int, of: int):
    """Which of the pairs of positions (a, b) are similar sets: the tokens of one set are
    marked, and those of all its partners looked up, some at a time. Tokens of 32 bits
    are numbers from 0 already."""
    token = values if values.dtype == np.int32 else np.unique(values, return_inverse=True)[1]
    sizes = np.diff(offsets)
    keep = np.zeros(len(a), bool)
    # sizes alone rule a pair out: the overlap is the smaller set at most
    low, high = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    todo = np.flatnonzero(low * of >= high * similar)
    todo = todo[np.argsort(a[todo], kind="stable")]
    marked = np.zeros(int(token.max()) + 1 if len(token) else 0, bool)
    edges = np.flatnonzero(np.append(True, a[todo][1:] != a[todo][:-1])) if len(todo) else todo
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(todo)]):
        own = token[offsets[a[todo[lo]]]:offsets[a[todo[lo]] + 1]]
        marked[own] = True
        while lo < hi:  # partners of about a million tokens, one at least
            ends = np.cumsum(sizes[b[todo[lo:hi]]])
            part = todo[lo:lo + max(1, int(np.searchsorted(ends, 1 << 20)))]
            n = sizes[b[part]]
            begin = np.cumsum(n) - n
            at = np.arange(int(n.sum())) + np.repeat(offsets[b[part]] - begin, n)
            hits = np.concatenate(([0], np.cumsum(marked[token[at]])))
            common = hits[begin + n] - hits[begin]
            keep[part] = common * of >= (len(own) + n - common) * similar
            lo += len(part)
        marked[own] = False
    return keep


def _family_links(members: DataFrame, decode: Decode, least: tuple[int, int]) -> DataFrame:
    """Links between components inside families; ``members``: id, family, comp, content.

    A family beyond ``BLOCK_IDS`` members or ``BLOCK_SIZE`` of content is dealt into
    blocks, and every two blocks meet in one task; small families share tasks. Of
    the links that a task finds, it returns those that join components.
    """
    is_list = members.schema["content"].dataType.typeName() == "array"
    size = F.size("content") if is_list else F.octet_length("content")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = members.groupBy("family").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_IDS), F.ceil(F.sum(size) / BLOCK_SIZE))
        .cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(
        F.least(F.col("own"), other).alias("i"), F.greatest(F.col("own"), other).alias("j"))))
    rows = members.join(blocks, "family").withColumn("own", own).withColumn("cell", cell)
    alone = F.col("blocks") == 1
    rows = rows.select(
        F.when(alone, F.pmod(F.xxhash64("family"), F.lit(4 * parts))).otherwise(F.col("family")).alias("task"),
        F.when(alone, -1).otherwise(F.col("cell.i")).alias("i"), F.col("cell.j").alias("j"),
        "family", "id", "comp", "content")

    def compare(table):
        order = np.argsort(table.column("family").to_numpy(), kind="stable")
        table = table.combine_chunks()
        family, ids, comps = (table.column(c).to_numpy()[order] for c in ("family", "id", "comp"))
        values, offsets = decode(table.column("content").combine_chunks().take(pa.array(order)))
        out_a, out_b = [], []
        edges = np.append(np.flatnonzero(np.append(True, family[1:] != family[:-1])), len(family))
        for lo, hi in zip(edges[:-1], edges[1:]):
            a, b = similar_pairs(values[offsets[lo]:offsets[hi]], np.diff(offsets[lo:hi + 1]),
                                 comps[lo:hi], *least)
            out_a.append(ids[lo:hi][a])
            out_b.append(ids[lo:hi][b])
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return rows.groupBy("task", "i", "j").applyInArrow(compare, "a long, b long")


def similar_pairs(values: np.ndarray, sizes: np.ndarray, comps: np.ndarray, similar: int, of: int):
    """Positions of similar sets in different components, a spanning choice of them.

    Overlaps are counted as a product of 0/1 matrices, a chunk of tokens at a time,
    over the tokens that two sets have.
    """
    n = len(sizes)
    _, token, crowd = np.unique(values, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    live = crowd[token] > 1
    number = np.cumsum(crowd > 1) - 1
    owner, token = owner[live], number[token[live]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    overlap = np.zeros((n, n), np.int64)
    width = 4096
    total = int(token[-1]) + 1 if len(token) else 0
    for begin in range(0, total, width):
        lo, hi = np.searchsorted(token, (begin, begin + width))
        chunk = np.zeros((n, width), np.float32)
        chunk[owner[lo:hi], token[lo:hi] - begin] = 1
        overlap += (chunk @ chunk.T).astype(np.int64)  # at most 4096 in a chunk: exact
    union = sizes[:, None] + sizes[None, :] - overlap
    a, b = np.nonzero(np.triu(overlap * of >= union * similar, 1) & (comps[:, None] != comps[None, :]))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    chosen = []
    for k, (x, y) in enumerate(zip(comps[a].tolist(), comps[b].tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            chosen.append(k)
    return a[chosen], b[chosen]
