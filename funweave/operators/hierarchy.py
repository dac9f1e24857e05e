"""Parent-child links to full hierarchies (problem 1).

A term may have several parents, so the hierarchy is the unfolded forest: one occurrence of a term for each of its
paths up to a root. The size of a term's unfolded subtree is a property of the term alone; sizes go upward from the
leaves. Downward, each occurrence hands its children consecutive preorder ranges by the prefix sums of their sizes.
An occurrence's range [lo, hi) then holds exactly its descendants. Terms that the upward pass leaves unprocessed lie on
a loop or above one; what a downward pass over them leaves lies on or between loops, and is cut into its strongly
connected parts. Links inside a part are reported and taken out, and the sizes go on.

Rounds are distributed as long as each of them ends at least one in SLOW of the pending links; that takes the bulk of a
hierarchy, which is broad, in few rounds. What is left then, long thin chains and loops, is ended by one task over
arrays if it is no more than `tail_links`, counted before, with the same result, and by further rounds if it is more.

Sizes are exact 64-bit numbers that stay at FULL once they reach it; unfolding a hierarchy with so many paths raises
OverflowError, finding its loops does not.

Nulls, unknown parents and repeated links lead nowhere; a term without parents is a root of depth 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from funweave.scratch import cut

TAIL_LINKS = 2_000_000
SHIPPED_LINKS = 200_000  # links that are sent to every task to unfold the forest, some 30 MB; beyond, each level is a join
SLOW = 20
FULL = 1 << 62
RELATIONS = ("is_a", "part_of")


def first_token(c: Column) -> Column:
    """The id at the start of a cell: upper case, without blanks and without what follows it."""
    return F.regexp_extract(F.upper(c), r"^\s*([^\s!{]+)", 1)


def resolved_links(terms: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct child, parent over known terms, alternate ids replaced by the terms that list them."""
    ids = terms.filter("go_id is not null").select(first_token(F.col("go_id")).alias("name"), "go_id", F.lit(0).alias("alt"))
    alts = terms.select(F.explode("alt_id").alias("name"), "go_id").select(first_token(F.col("name")).alias("name"), "go_id", F.lit(1).alias("alt"))
    # an id of its own wins over an alternate id
    names = ids.union(alts).groupBy("name").agg(F.min_by("go_id", F.struct("alt", "go_id")).alias("term"))
    links = relations.filter(F.lower(F.trim("relation")).isin(*RELATIONS)).select(
        first_token(F.col("go_id")).alias("c"), first_token(F.col("related_id")).alias("p")
    )
    return (
        links.distinct()
        .join(names.select(F.col("name").alias("c"), F.col("term").alias("child")), "c")
        .join(names.select(F.col("name").alias("p"), F.col("term").alias("parent")), "p")
        .select("child", "parent")
        .distinct()
    )


# --- one task over a bounded number of links -------------------------------------------------------------------


def _codes(child: pd.Series, parent: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, codes = np.unique(np.concatenate([child.to_numpy(str), parent.to_numpy(str)]), return_inverse=True)
    return ids, codes[: len(child)], codes[len(child) :]


def _adjacent(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each node of a its nodes of b, as offsets and targets."""
    order = np.argsort(a, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]), b[order]


def _peel(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """True for the nodes that remain when nodes without an incoming link (a to b) are taken off again and again."""
    offset, to = _adjacent(a, b, n)
    missing = np.bincount(b, minlength=n)
    left, front = np.ones(n, bool), np.flatnonzero(missing == 0)
    while len(front):
        left[front] = False
        hit = np.concatenate([to[offset[v] : offset[v + 1]] for v in front])
        np.subtract.at(missing, hit, 1)
        hit = np.unique(hit)
        front = hit[missing[hit] == 0]
    return left


def _loops(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The strongly connected part of each node, by Tarjan's depth-first search without recursion."""
    offset, to = _adjacent(a, b, n)
    index, low, part = np.full(n, -1), np.zeros(n, int), np.full(n, -1)
    stack: list[int] = []
    count = parts = 0
    for start in range(n):
        if index[start] >= 0:
            continue
        work = [(start, offset[start])]
        while work:
            v, at = work.pop()
            if index[v] < 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
            if at > offset[v]:
                low[v] = min(low[v], low[to[at - 1]]) if part[to[at - 1]] < 0 else low[v]
            while at < offset[v + 1]:
                w = to[at]
                at += 1
                if index[w] < 0:
                    work += [(v, at), (w, offset[w])]
                    break
                if part[w] < 0:
                    low[v] = min(low[v], index[w])
            else:
                if low[v] == index[v]:
                    while True:
                        w = stack.pop()
                        part[w] = parts
                        if w == v:
                            break
                    parts += 1
    return part


def _loops_task(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, child, parent = _codes(pdf["child"], pdf["parent"])
    n = len(ids)
    left = _peel(n, child, parent)
    keep = left[child] & left[parent]
    left = ~left
    left[np.unique(np.concatenate([child[keep], parent[keep]]))] = True
    left = _peel(n, parent[keep], child[keep]) & left
    keep &= left[child] & left[parent]
    part = _loops(n, child[keep], parent[keep])
    inside = part[child[keep]] == part[parent[keep]]
    c, p = child[keep][inside], parent[keep][inside]
    return pd.DataFrame({"child": ids[c], "parent": ids[p]})


# --- distributed rounds ----------------------------------------------------------------------------------------


def _trim(links: DataFrame, bound: int, key: str, other: str, least_rounds: int = 0) -> tuple[DataFrame, int, bool]:
    """Take off, round by round, the links whose `key` node is no link's `other` node, until few or none go."""
    n, rounds = links.count(), 0
    while n and (rounds < least_rounds or n > bound):
        kept = cut(links.join(links.select(F.col(other).alias(key)).distinct(), key, "left_semi").select("child", "parent"), "trim")
        m, rounds = kept.count(), rounds + 1
        links = kept
        if m == n:
            return links, n, True
        n = m
    return links, n, n == 0


def loops_of(rest: DataFrame, tail_links: int = TAIL_LINKS) -> DataFrame:
    """The links on a loop among those that the upward pass left: both ends in one strongly connected part, a term that
    is its own parent included."""
    down, n, _ = _trim(rest, tail_links, "parent", "child")
    if n > tail_links:
        return _coloured(down, tail_links)
    return cut(down.groupBy().applyInPandas(lambda pdf: _loops_task(pdf), "child string, parent string"), "loops")


def _spread(links: DataFrame, colour: DataFrame) -> DataFrame:
    """The least colour that reaches each node from child to parent, and its own."""
    while True:
        sent = links.join(colour.withColumnRenamed("node", "child"), "child").select(F.col("parent").alias("node"), "colour")
        new = cut(colour.select("node", "colour", F.col("colour").alias("old")).unionByName(sent.withColumn("old", F.lit(None).cast("string")))
                  .groupBy("node").agg(F.min("colour").alias("colour"), F.min("old").alias("old")), "colour")
        if not new.filter("colour < old").limit(1).count():
            return new.select("node", "colour")
        colour = new.select("node", "colour")


def _coloured(links: DataFrame, tail_links: int) -> DataFrame:
    """Strongly connected parts over more links than one task takes: colour forward by the least id, then backward
    inside a colour; what both reach is one part. Repeats on the rest."""
    found = None
    rest = cut(links, "rest")
    while rest.limit(1).count():
        nodes = rest.select(F.col("child").alias("node")).union(rest.select("parent")).distinct()
        colour = _spread(rest, cut(nodes.withColumn("colour", F.col("node")), "nodes"))
        c, p = colour.toDF("child", "cc"), colour.toDF("parent", "pc")
        same = cut(rest.join(c, "child").join(p, "parent").filter("cc = pc").select("child", "parent", F.col("cc").alias("colour")), "same")
        back = cut(same.select(F.col("colour").alias("node"), "colour").distinct(), "back")
        front = back
        while front.limit(1).count():
            front = cut(same.join(front.withColumnRenamed("node", "parent"), ["parent", "colour"]).select(F.col("child").alias("node"), "colour")
                        .distinct().join(back, ["node", "colour"], "left_anti"), "front")
            back = back.union(front)
        back = cut(back, "part")
        inside = cut(same.join(back.withColumnRenamed("node", "child"), ["child", "colour"], "left_semi")
                     .join(back.withColumnRenamed("node", "parent"), ["parent", "colour"], "left_semi").select("child", "parent"), "loop")
        found = inside if found is None else found.union(inside)
        taken = back.select("node")
        rest = cut(same.select("child", "parent").join(taken.toDF("child"), "child", "left_anti").join(taken.toDF("parent"), "parent", "left_anti"), "rest")
        rest, _, _ = _trim(rest, 0, "child", "parent", 1)
    return found if found is not None else links.limit(0)


def loop_terms(terms: DataFrame, relations: DataFrame, tail_links: int = TAIL_LINKS) -> DataFrame:
    """go_id of each term that is reached again from itself: what the upward pass leaves unprocessed, cut into its loops."""
    nodes = terms.filter("go_id is not null").select(F.col("go_id").alias("term"))
    _, rest = subtree_sizes(nodes, cut(resolved_links(terms, relations), "links"), tail_links)
    inside = loops_of(rest, tail_links)
    return inside.select(F.col("child").alias("go_id")).union(inside.select("parent")).distinct()


def _sizes_task(pdf: pd.DataFrame) -> pd.DataFrame:
    """Subtree sizes of the parents of links that carry the size gathered so far of each end; null for what stays unprocessed."""
    ids, child, parent = _codes(pdf["child"], pdf["parent"])
    n = len(ids)
    size, rough = np.ones(n, np.int64), np.ones(n)
    for at, c in ((child, "child_size"), (parent, "parent_size")):
        size[at], rough[at] = pdf[c].to_numpy(np.int64), pdf[c].to_numpy(float)
    offset, to = _adjacent(child, parent, n)
    missing = np.bincount(parent, minlength=n)
    done, front = np.zeros(n, bool), np.flatnonzero(missing == 0)
    while len(front):
        done[front] = True
        # sums of 64-bit numbers may wrap; their doubles tell which have
        size[front] = np.where(rough[front] >= FULL, FULL, size[front])
        rough[front] = np.minimum(rough[front], float(FULL))
        reach = np.concatenate([to[offset[v] : offset[v + 1]] for v in front])
        many = offset[front + 1] - offset[front]
        np.add.at(size, reach, np.repeat(size[front], many))
        np.add.at(rough, reach, np.repeat(rough[front], many))
        np.subtract.at(missing, reach, 1)
        reach = np.unique(reach)
        front = reach[missing[reach] == 0]
    return pd.DataFrame({"term": ids, "size": pd.array(np.where(done, size, 0), "Int64").copy()}).assign(size=lambda d: d["size"].mask(~done))


def subtree_sizes(terms: DataFrame, links: DataFrame, tail_links: int = TAIL_LINKS, bulk: bool = True) -> tuple[DataFrame, DataFrame]:
    """term, size (occurrences in the unfolded subtree below and with the term) of the processed terms, and the links
    child, parent between the terms that stay unprocessed. Without bulk, no round goes before the one task."""
    whole = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(FULL)).cast("long")
    one = F.lit(1).cast("long")

    def waiting(pending: DataFrame, given: DataFrame | None) -> DataFrame:
        """The links with the size gathered by their child, and whether that waits for a child of its own."""
        waits = pending.select(F.col("parent").alias("child")).distinct().withColumn("waits", F.lit(True))
        got = pending.join(waits, "child", "left")
        if given is None:
            return cut(got, "pending")
        more = F.least(F.col("size") + F.coalesce("more", F.lit(0)), F.lit(FULL)).alias("size")
        return cut(got.join(given, "child", "left").select("child", "parent", more, "waits"), "pending")

    pending = links.select("child", "parent", one.alias("size"))
    handed = links.select(F.col("parent").alias("term"), one.alias("size")).limit(0)
    n = links.count()
    state, busy = None, n > 0 and (bulk or n > tail_links)
    if busy:
        state = waiting(pending, None)
    while busy:
        # links whose child waits for no child of its own hand their size up
        ready, pending = state.filter("waits is null"), state.filter("waits").select("child", "parent", "size")
        m = pending.count()
        up = ready.select(F.col("parent").alias("term"), "size")
        handed = handed.unionByName(up)
        busy = 0 < m < n and not ((n - m) * SLOW < n and m <= tail_links)
        stuck, n = m == n, m
        # a link carries the size of its child as gathered so far
        state = waiting(pending, up.groupBy(F.col("term").alias("child")).agg(whole("size").alias("more")))
        if stuck and n > tail_links:  # no round gets on: all that is pending is unprocessed
            break
        pending = state.select("child", "parent", "size")
    sizes = cut(terms.select("term").distinct().withColumn("size", one).unionByName(handed).groupBy("term").agg(whole("size").alias("size")), "sizes")
    if n == 0:
        return sizes, links.limit(0)
    if n > tail_links:
        open_ = pending.select(F.col("parent").alias("term")).distinct()
        return cut(sizes.join(open_, "term", "left_anti"), "sizes"), pending.join(open_.toDF("child"), "child", "left_semi").select("child", "parent")
    tail = pending.withColumnRenamed("size", "child_size").join(sizes.toDF("parent", "parent_size"), "parent")
    done = cut(tail.groupBy().applyInPandas(lambda pdf: _sizes_task(pdf), "term string, size long"), "tail")
    left = done.filter("size is null").select("term")
    rest = pending.join(left.toDF("child"), "child", "left_semi").join(left.toDF("parent"), "parent", "left_semi").select("child", "parent")
    return cut(sizes.join(done.select("term"), "term", "left_anti").union(done.filter("size is not null")), "sizes"), cut(rest, "unprocessed")


def occurrences(terms: DataFrame, relations: DataFrame, tail_links: int = TAIL_LINKS) -> DataFrame:
    """The occurrences of all terms over their is_a and part_of links."""
    nodes = terms.filter("go_id is not null").select(F.col("go_id").alias("term"))
    return unfold(nodes, resolved_links(terms, relations), tail_links)


def unfold(nodes: DataFrame, links: DataFrame, tail_links: int = TAIL_LINKS) -> DataFrame:
    """root, go_id, lo, hi, depth, path (from the root down): one row per path of a term; links on loops are left out.

    The links, with the offset of each child below its parent, are broadcast to the tasks only if they are no more
    than SHIPPED_LINKS; beyond that each level is a join.
    """
    links = cut(links, "links")
    sizes, rest = subtree_sizes(nodes, links, tail_links)
    if rest.limit(1).count():
        links = cut(links.join(loops_of(rest, tail_links), ["child", "parent"], "left_anti"), "acyclic")
        sizes, _ = subtree_sizes(nodes, links, tail_links, False)
    if (sizes.agg(F.max("size")).collect()[0][0] or 0) >= FULL:
        raise OverflowError("a term has more paths below it than a 64-bit preorder number can count")
    before = F.sum("size").over(W.partitionBy("parent").orderBy("child").rowsBetween(W.unboundedPreceding, -1))
    steps = cut(
        links.join(sizes.toDF("child", "size"), "child").withColumn("off", (F.lit(1) + F.coalesce(before, F.lit(0))).cast("long")), "steps"
    )
    roots = sizes.join(links.select(F.col("child").alias("term")).distinct(), "term", "left_anti")
    front = roots.select(
        F.col("term").alias("root"), F.col("term").alias("go_id"), F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi"),
        F.lit(0).alias("depth"), F.array("term").alias("path"),
    )
    if steps.count() <= min(tail_links, SHIPPED_LINKS):
        rows = steps.select("parent", "child", "off", "size").toPandas()
        table = {p: list(zip(g["child"], g["off"], g["size"])) for p, g in rows.groupby("parent", sort=False)}
        shared = nodes.sparkSession.sparkContext.broadcast(table)

        def expand(batches):  # noqa: ANN001, ANN202
            below = shared.value
            for b in batches:
                todo, out = [(*r, list(p)) for *r, p in b.itertuples(index=False)], []
                while todo:
                    root, t, lo, hi, depth, path = x = todo.pop()
                    out.append(x)
                    todo += [(root, c, lo + off, lo + off + size, depth + 1, [*path, c]) for c, off, size in below.get(t, ())]
                    if len(out) >= 5000:
                        yield pd.DataFrame(out, columns=b.columns)
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=b.columns)

        # one level down first, so that one great root is shared out among the tasks
        first = front.join(steps.withColumnRenamed("parent", "go_id"), "go_id").select(
            "root", F.col("child").alias("go_id"), (F.col("lo") + F.col("off")).alias("lo"), (F.col("lo") + F.col("off") + F.col("size")).alias("hi"),
            F.lit(1).alias("depth"), F.concat("path", F.array("child")).alias("path"),
        )
        width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return front.union(first.repartition(width, "go_id", "root").mapInPandas(expand, first.schema))
    out = front
    while front.limit(1).count():
        front = cut(front.join(steps.withColumnRenamed("parent", "go_id"), "go_id").select(
            "root", F.col("child").alias("go_id"), (F.col("lo") + F.col("off")).alias("lo"), (F.col("lo") + F.col("off") + F.col("size")).alias("hi"),
            (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("child")).alias("path")), "level")
        out = out.union(front)
    return out


def term_summary(occ: DataFrame) -> DataFrame:
    """go_id, n_paths, min_depth, max_depth, n_roots of each term."""
    return occ.groupBy("go_id").agg(
        F.count("*").alias("n_paths"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"), F.countDistinct("root").alias("n_roots")
    )


def descendants(occ: DataFrame, block: int = 64) -> DataFrame:
    """go_id, descendant (distinct, without the term itself), by range containment of preorder numbers.

    The first occurrence of a term holds its whole subtree. Ranges are cut into blocks of preorder numbers, so that
    the containment is an equality join on (root, block) whose groups are bounded by the block and the depth.
    """
    first = occ.filter("hi > lo + 1").groupBy("go_id").agg(F.min(F.struct("root", "lo", "hi")).alias("f")).select("go_id", "f.*")
    parts = first.withColumn("block", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))))
    inner = occ.select("root", F.col("go_id").alias("descendant"), F.col("lo").alias("at"), F.expr(f"lo div {block}").alias("block"))
    return parts.join(inner, ["root", "block"]).filter("at > lo and at < hi").select("go_id", "descendant").distinct()


def closure(links: DataFrame) -> DataFrame:
    """child, parent of all pairs of a term and a term above it, over links without loops, by doubling.

    After round r the pairs of all path lengths below 2^r are known, so a chain of n links takes log2(n) rounds; only new
    pairs are joined again. No path is carried: the work follows the number of pairs, not of paths.
    """
    known = new = cut(links.select("child", "parent").distinct(), "closure")
    while True:
        over = new.select("child", F.col("parent").alias("m")).join(known.select(F.col("child").alias("m"), "parent"), "m").select("child", "parent")
        fresh = cut(over.distinct().join(known, ["child", "parent"], "left_anti"), "closure")
        if not fresh.limit(1).count():
            return known
        known, new = known.unionByName(fresh), fresh


def acyclic(nodes: DataFrame, links: DataFrame, tail_links: int = TAIL_LINKS) -> DataFrame:
    """The links that lie on no loop."""
    links = cut(links, "links")
    _, rest = subtree_sizes(nodes, links, tail_links, False)
    return links.join(loops_of(rest, tail_links), ["child", "parent"], "left_anti") if rest.limit(1).count() else links
