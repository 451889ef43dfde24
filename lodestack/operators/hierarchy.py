"""Parent-child rows to full hierarchies.

Nodes are numbered in byte order, so that all rounds work on longs. Chains of nodes with one child
each are contracted; then leaves are peeled from below: a link whose children have all reported
sends its subtree size to its parent. What is never peeled lies on loops. In reverse peel order,
parents before children, each link gets root, depth and, where asked for, path; descendant lists go
up in peel order. No group is ever gathered: a parent's messages are combined before the shuffle,
and lists travel as blocks of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.records import keys_of, library_key
from lodestack.operators import bloom
from lodestack.operators.skew import hot_keys, salted_lookup
from lodestack.session import materialise, measured

#: Peel rounds per Spark job: what is peeled leaves the state after each job, so the first ones are short.
ROUNDS = (1, 2, 4, 8)
#: Levels of the reverse order per job; the plan of a job reads its first input 2**LEVELS - 1 times.
LEVELS = 2


def library_edges(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node) of all distinct soname keys, (node, parent) of the libraries whose ``needed`` may name one of them.

    A Bloom filter leaves out nearly all keys that are no soname; ``hierarchy`` drops the rest.
    """
    rows = reports.select(library_key(F.col("soname")).alias("node"), F.array_distinct(keys_of(F.col("needed"))).alias("keys"))
    rows = rows.where("node is not null")
    nodes = materialise(rows.select("node").distinct(), "sonames")
    words = bloom.words_for(nodes.count())
    named = rows.select("node", F.explode("keys").alias("parent")).distinct()
    return nodes, bloom.probe(named, "parent", bloom.build(nodes, "node", words), words).where("maybe").drop("maybe")


def numbered(nodes: DataFrame) -> DataFrame:
    """(id, node): distinct nodes with 64-bit numbers that are in byte order of the nodes; written, as numbers depend on the partitions."""
    return materialise(nodes.where("node is not null").distinct().orderBy("node").select(F.monotonically_increasing_id().alias("id"), "node"), "numbered")


def links(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, parent) as numbers; edges with an end that is no node are left out, of several parents the first in byte order stays."""
    edges = materialise(edges.where("node is not null and parent is not null"), "edges")
    up = salted_lookup(edges, ids.select(F.col("id").alias("above"), F.col("node").alias("parent")), "parent").where("above is not null")
    return materialise(up.join(ids, "node").groupBy("id").agg(F.min("above").alias("parent")), "links")


def chains(ids: DataFrame, up: DataFrame) -> DataFrame:
    """(id, chain, rank): runs of nodes that are the only child of their parent are one chain, named by its lowest node.

    ``rank`` counts from the top. Ranks come by doubling, log2(longest chain) joins, two a job; where a job
    resolves nothing the rest are loops without branches, whose nodes stay chains of their own.
    """
    only = up.groupBy("parent").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    state, seen = measured(
        only.select("id", F.col("parent").alias("jump"), F.lit(1).cast("bigint").alias("rank"), F.lit(True).alias("open")), "chain", n=F.count_if("open")
    )
    left = -1
    while seen["n"] not in (0, left):
        left = seen["n"]
        for _ in range(2):
            on = state.select(F.col("id").alias("jump"), F.col("jump").alias("after"), F.col("rank").alias("more"))
            state = state.join(on, "jump", "left").select("id", F.coalesce("after", "jump").alias("jump"), (F.col("rank") + F.coalesce("more", F.lit(0))).alias("rank"), F.col("after").isNotNull().alias("open"))
        state, seen = measured(state, "chain", n=F.count_if("open"))
    ranked = state.where("not open").select("id", F.col("jump").alias("top"), "rank")  # the tops have no row yet
    ranked = ranked.unionByName(ranked.select(F.col("top").alias("id"), "top", F.lit(0).cast("bigint").alias("rank")).distinct())
    low = ranked.groupBy("top").agg(F.max_by("id", "rank").alias("chain"))
    placed = salted_lookup(materialise(ranked, "ranked"), low, "top").select("id", "chain", "rank")
    alone = ids.select("id").join(placed, "id", "left")
    return materialise(alone.select("id", F.coalesce("chain", "id").alias("chain"), F.coalesce("rank", F.lit(0)).alias("rank")), "chains")


def _round(state: DataFrame) -> DataFrame:
    """One peel: leaves are marked and report to their parents; a single map-side combined shuffle of longs.

    The number of the round is a column, so that all rounds share the code that Spark generates.
    """
    leaf = (F.col("missing") == 0) & F.col("height").isNull()
    none, then = F.lit(None), (F.col("round") + 1).alias("round")
    own = F.struct("id", "parent", "missing", "size", F.when(leaf, F.col("round")).otherwise(F.col("height")).alias("height"), then)
    told = F.struct(
        F.when(leaf, F.col("parent")).alias("id"), none.cast("bigint").alias("parent"), F.lit(-1).cast("bigint").alias("missing"),
        F.col("size"), none.cast("int").alias("height"), then,
    )
    return (
        state.select(F.inline(F.array(own, told)))
        .where("id is not null")
        .groupBy("id")
        .agg(*[f(c).alias(c) for f, c in ((F.max, "parent"), (F.sum, "missing"), (F.sum, "size"), (F.max, "height"), (F.max, "round"))])
    )


def peel(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Peeled and residual ones of ``rows`` (id, parent, length), as (id, parent, missing, size, height)."""
    none = F.lit(None).cast("bigint")
    own = rows.select("id", "parent", F.lit(0).cast("bigint").alias("missing"), F.col("length").alias("size"))
    asked = rows.where("parent is not null").select(F.col("parent").alias("id"), none.alias("parent"), F.lit(1).cast("bigint").alias("missing"), F.lit(0).cast("bigint").alias("size"))
    state = own.unionByName(asked).groupBy("id").agg(F.max("parent").alias("parent"), F.sum("missing").alias("missing"), F.sum("size").alias("size"))
    state = state.withColumn("height", F.lit(None).cast("int")).withColumn("round", F.lit(0))
    peeled, number, jobs = [], 0, 0
    while True:
        for _ in range(ROUNDS[min(jobs, len(ROUNDS) - 1)]):
            state = _round(state)
            number += 1
        state, seen = measured(state, f"peel{jobs}", last=F.max("height"), left=F.count_if(F.col("height").isNull()))
        jobs += 1
        peeled.append(state.where("height is not null"))
        state = state.where("height is null")
        if not seen["left"] or seen["last"] != number - 1:
            break
    done = peeled[0]
    for x in peeled[1:]:
        done = done.unionByName(x)
    return done, state


def loops(residual: DataFrame) -> DataFrame:
    """(id, root) of ``residual`` (id, parent, least) on loops: the least of the loop, within 2, 4, 8 ... steps, until nothing changes."""
    state = materialise(residual.select("id", F.col("parent").alias("next"), F.col("least").alias("root")), "loop")
    while True:
        changed = F.lit(False)
        for _ in range(2):
            ahead = state.select(F.col("id").alias("next"), F.col("next").alias("after"), F.col("root").alias("other"))
            state = state.join(ahead, "next").select(
                "id", F.col("after").alias("next"), F.least("root", "other").alias("root"), ((F.col("other") < F.col("root")) | changed).alias("changed")
            )
            changed = F.col("changed")
        state, seen = measured(state, "loop", n=F.count_if("changed"))
        state = state.drop("changed")
        if not seen["n"]:
            return state.select("id", "root")


def _down(top: DataFrame, peeled: DataFrame, extra: dict[str, Column]) -> DataFrame:
    """Reverse peel order: each of ``peeled`` (id, parent, height, ...) takes over (root, state, below) from its parent.

    ``top`` (id, root, state, below, *extra) is done; ``below`` is the depth of an only child. ``extra`` makes
    further columns from those of the child and, as ``_name``, of the parent. Several levels per job.
    """
    columns = ["root", "state", "below", *extra]
    done, highest = materialise(top.select("id", *columns), "down"), peeled.agg(F.max("height")).first()[0]
    hot = materialise(hot_keys(peeled, "parent"), "hot")
    under = (lambda a, b: a.join(b, "parent")) if hot.isEmpty() else (lambda a, b: salted_lookup(a, b, "parent", hot))
    while highest is not None and highest >= 0:
        new, known = None, done
        for level in range(highest, max(-1, highest - LEVELS), -1):
            parents = known.select(F.col("id").alias("parent"), *[F.col(c).alias(f"_{c}") for c in columns])
            step = under(peeled.where(F.col("height") == level), parents).select(
                "id", F.col("_root").alias("root"), F.when(F.col("_state") == "cycle", "below_cycle").otherwise(F.col("_state")).alias("state"),
                (F.col("_below") + F.col("length")).alias("below"), *[c.alias(name) for name, c in extra.items()],
            )
            known, new = known.unionByName(step), step if new is None else new.unionByName(step)
        done, highest = done.unionByName(materialise(new, "down")), highest - LEVELS
    return done


class Hierarchy:
    """The steps that paths and descendants have in common; each is written once.

    ``ids`` (id, node), ``chain`` (id, chain, rank), ``links`` (id, parent, length, height, size) of the
    contracted tree, a link being a chain under the number of its lowest node, ``top`` those without
    a parent and those on loops.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.ids = numbered(nodes)
        up = links(edges, self.ids)
        self.chain = chains(self.ids, up)
        per_chain = self.chain.groupBy("chain").agg(F.count("*").alias("length"), F.min("id").alias("least"), F.min_by("id", "rank").alias("first"))
        rows = materialise(per_chain.join(up.select(F.col("id").alias("first"), "parent"), "first", "left").withColumnRenamed("chain", "id"), "contracted")
        self.peeled, residual = peel(rows)
        more = rows.select("id", "length", "least", "first")
        self.links = materialise(self.peeled.select("id", "parent", "height", "size").join(more, "id"), "peeled")
        top = self.links.where("parent is null").select("id", F.col("first").alias("root"), F.lit("tree").alias("state"), F.col("length").alias("below"), "size", "length")
        self.looped = materialise(residual.select("id", "parent", "size").join(more, "id"), "residual")
        if self.looped.limit(1).count():
            ring = self.looped.join(loops(self.looped), "id").select("id", "root", F.lit("cycle").alias("state"), F.lit(1).cast("bigint").alias("below"), "size", "length")
            top = top.unionByName(ring)
        self.top = materialise(top, "top")

    def names(self) -> DataFrame:
        """(id, names): the nodes of each chain from the top down; as long as the path of its lowest node. On loops the lowest node alone."""
        own = self.chain.join(self.ids, "id").groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("rank", "node"))).alias("list"))
        return materialise(own.select(F.col("chain").alias("id"), F.transform("list", lambda x: x["node"]).alias("names")), "names")

    def nodes(self, paths: bool) -> DataFrame:
        rest = self.links.where("parent is not null")
        columns, extra, top = [], {}, self.top
        if paths:
            names = self.names()
            rest, top = rest.join(names, "id"), top.join(names, "id")
            # on a loop, what hangs below begins with the node that it hangs from
            own = F.when(F.col("state") == "cycle", F.slice("names", -1, 1)).otherwise(F.col("names"))
            top = top.withColumn("above", F.array().cast("array<string>")).withColumn("way", own)
            extra = {"above": F.col("_way"), "way": F.concat("_way", "names")}
            columns = ["above", "way"]
        placed = _down(top, rest, extra)
        sizes = self.links.select("id", "size", "length").unionByName(self.looped.select("id", "size", "length"))
        placed = materialise(placed.join(sizes, "id"), "placed").withColumnRenamed("id", "chain")
        rows = salted_lookup(self.chain, placed, "chain")
        looped, last = F.col("state") == "cycle", F.col("rank") == F.col("length") - 1
        depth = F.when(looped, 0).otherwise(F.col("below") - F.col("length") + F.col("rank")).cast("int")
        # above a loop's lowest node of a chain nothing branches off
        below = F.when(~looped, F.col("size") - F.col("rank") - 1).when(last, F.col("size") - F.col("length")).otherwise(0)
        rows = rows.join(self.ids, "id").select("node", "root", depth.alias("depth"), "state", below.alias("descendants"), "rank", *columns)
        if paths:
            path = F.when(F.col("state") == "cycle", F.array("node")).otherwise(F.concat("above", F.slice("way", F.size("above") + 1, (F.col("rank") + 1).cast("int"))))
            rows = rows.withColumn("path", path).drop("above", "way")
        rows = materialise(rows.drop("rank"), "nodes")
        return salted_lookup(rows, self.ids.select(F.col("id").alias("root"), F.col("node").alias("_root")), "root").withColumn("root", F.col("_root")).drop("_root")

    def descendants(self) -> DataFrame:
        """(ancestor, descendant, distance). In peel order each link sends its list of links below to its parent, itself
        included; a list is rows, which are only addressed anew. At the end links are expanded to their nodes."""
        sent, done = None, None
        rows, highest = self.links.where("parent is not null").select("id", "parent", "height", "length"), self.links.agg(F.max("height")).first()[0]
        level = 0
        while highest is not None and level <= highest:
            held, job = sent, None
            for h in range(level, min(level + LEVELS, highest + 1)):
                mine = rows.where(F.col("height") == h)
                out = mine.select(F.col("parent").alias("holder"), F.col("id").alias("link"), F.lit(1).cast("bigint").alias("distance"))
                if held is not None:
                    lists = held.join(mine.withColumnRenamed("id", "holder"), "holder").select(F.col("parent").alias("holder"), "link", (F.col("distance") + F.col("length")).alias("distance"))
                    out = out.unionByName(lists)
                held, job = out if held is None else held.unionByName(out), out if job is None else job.unionByName(out)
            job = materialise(job, "lists")
            sent, level = job if sent is None else sent.unionByName(job), level + LEVELS
        names = self.names()
        lengths = self.links.select("id", "length").unionByName(self.looped.select("id", "length")).join(names, "id")
        steps = F.posexplode("names").alias("i", "descendant")
        inside = self.links.join(names, "id").select("names", steps).select(F.posexplode(F.slice("names", F.lit(1), F.col("i"))).alias("j", "ancestor"), "descendant", "i")
        done = inside.select("ancestor", "descendant", (F.col("i") - F.col("j")).cast("bigint").alias("distance"))
        if sent is None:
            return done
        heads = lengths.join(self.looped.select("id", F.lit(True).alias("looped")), "id", "left")
        # nothing hangs from the nodes of a loop but from the lowest one of a chain
        heads = heads.select(F.col("id").alias("holder"), F.when(F.col("looped"), F.slice("names", -1, 1)).otherwise(F.col("names")).alias("above"))
        below = salted_lookup(sent, heads, "holder").select("link", "distance", "above")
        below = salted_lookup(materialise(below, "addressed"), lengths.select(F.col("id").alias("link"), "names"), "link")
        below = below.select("distance", "above", steps).select("distance", "i", "descendant", F.size("above").alias("n"), F.posexplode("above").alias("j", "ancestor"))
        return done.unionByName(below.select("ancestor", "descendant", (F.col("n") - 1 - F.col("j") + F.col("distance") + F.col("i")).alias("distance")))


def hierarchy(nodes: DataFrame, edges: DataFrame, paths: bool = False) -> DataFrame:
    """(node, root, depth, state, descendants[, path]) for each distinct node.

    ``nodes`` (node) and ``edges`` (node, parent); edges with an end that is no node are left out, and
    of several parents of a node the first in byte order holds. ``tree``: root is the topmost ancestor. ``cycle``: the node lies on a loop (of one, too);
    root is the smallest node of the loop, depth 0. ``below_cycle``: depth counts the steps to the
    first node on the loop. ``path`` is the array from the root (or the first loop node) to the
    node; ``descendants`` counts the nodes below a node, for one on a loop those in the trees that
    hang from it. Null nodes are left out; an empty table gives no row.
    """
    return Hierarchy(nodes, edges).nodes(paths)


def descendants(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance): one row for each node and each node above it, up to the root or the first loop node."""
    return Hierarchy(nodes, edges).descendants()
