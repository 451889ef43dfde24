"""Dependency graphs of shared libraries: providers, closures, cycles, duplicates, mismatches, shadowing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.scalars import EXTRA_CUTS, bucket
from lodestack.operators.hierarchy import numbered
from lodestack.operators.skew import salted_lookup
from lodestack.session import materialise, measured

#: Stands for the path of all files without one while files are joined by path.
_NO_PATH = "\0"


def first_provider(libraries: DataFrame) -> DataFrame:
    """(soname, provider): of several files that provide a soname, the first path in byte order."""
    return libraries.where("soname is not null").groupBy("soname").agg(F.min("path").alias("provider"))


def conflicts(libraries: DataFrame, shown: int = 25) -> DataFrame:
    """(soname, n_paths, paths) of sonames with several providers.

    ``n_paths`` counts all distinct paths; ``paths`` lists the first ``shown`` of them, since a
    soname may be provided by any number of files.
    """
    distinct = libraries.where("soname is not null and path is not null").select("soname", "path").distinct()
    counted = distinct.groupBy("soname").agg(F.count("*").alias("n_paths")).where("n_paths > 1")
    rank = F.row_number().over(Window.partitionBy("soname").orderBy("path"))
    listed = distinct.withColumn("_r", rank).where(F.col("_r") <= shown).groupBy("soname").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return counted.join(listed, "soname")


def external(uses: DataFrame, libraries: DataFrame) -> DataFrame:
    """(soname, n_uses): needed sonames that nothing provides. Uses are counted first, so the join sees one row per soname."""
    counted = uses.groupBy("soname").agg(F.count("*").alias("n_uses"))
    return counted.join(libraries.where("soname is not null").select("soname").distinct(), "soname", "left_anti")


def in_degree(uses: DataFrame) -> DataFrame:
    """(soname, entries, files): occurrences in lists, repeated ones too, and distinct files."""
    per_file = uses.groupBy("soname", "path").agg(F.count("*").alias("_n"))
    return per_file.groupBy("soname").agg(F.sum("_n").alias("entries"), F.count("*").alias("files"))


def repeated_entries(uses: DataFrame) -> DataFrame:
    """(path, soname, times): a soname that one file lists more than once."""
    return uses.groupBy("path", "soname").agg(F.count("*").alias("times")).where("times > 1")


def version_mismatches(required: DataFrame, declared: DataFrame) -> DataFrame:
    """(soname, verset, n_files): requested versions that no provider of the soname declares.

    ``required`` (path, soname, verset), ``declared`` (soname, verset). Sonames whose providers
    declare no version at all are passed over.
    """
    asked = required.groupBy("soname", "verset").agg(F.count_distinct("path").alias("n_files"))
    own = declared.where("soname is not null and verset is not null").distinct()
    return asked.join(own.select("soname").distinct(), "soname", "left_semi").join(own, ["soname", "verset"], "left_anti")


def closure(edges: DataFrame) -> DataFrame:
    """(root, node, depth): what each source reaches along (src, dst), with the fewest steps.

    A node is in its own closure only where a cycle leads back to it. Reach is doubled: whatever
    lies up to 2k steps away lies up to k steps behind a node exactly k steps away, so a graph of
    depth d takes log2(d) joins; only those farthest nodes are looked up. Nodes that a large part of them
    are, are split by adaptive execution as they are met. Each result is written, which keeps the plan
    short; roots without a node k steps away are done and only looked up from then on.
    """
    reach = edges.where("src is not null and dst is not null").select(F.col("src").alias("root"), F.col("dst").alias("node")).distinct()
    active = materialise(reach.withColumn("depth", F.lit(1)), "reach")
    done, steps = None, 1
    while True:
        ends = active.where(F.col("depth") == steps)
        known = active if done is None else done.unionByName(active)
        on = known.select(F.col("root").alias("node"), F.col("node").alias("far"), F.col("depth").alias("more"))
        longer = ends.join(on, "node").select("root", F.col("far").alias("node"), (F.col("depth") + F.col("more")).alias("depth"))
        steps *= 2
        grown, seen = measured(active.unionByName(longer).groupBy("root", "node").agg(F.min("depth").alias("depth")), "reach", n=F.count_if(F.col("depth") == steps))
        if not seen["n"]:
            return grown if done is None else done.unionByName(grown)
        open_ = materialise(grown.where(F.col("depth") == steps).select("root").distinct(), "open")
        finished = grown.join(open_, "root", "left_anti")
        done = finished if done is None else done.unionByName(finished)
        active = materialise(grown.join(open_, "root", "left_semi"), "active")


def trimmed(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """``edges`` without most of those that can't lie on a cycle: from nodes that nothing leads to, or to nodes that lead nowhere.

    Trims go on while a job of ``rounds`` of them removes at least half of the edges.
    """
    edges, seen = measured(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "trimmed", n=F.count("*"))
    while seen["n"]:
        left, rest = seen["n"], edges
        for _ in range(rounds):
            rest = rest.join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            rest = rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        edges, seen = measured(rest.select("src", "dst"), "trimmed", n=F.count("*"))
        if seen["n"] * 2 > left:
            break
    return edges


def cycles(reach: DataFrame) -> DataFrame:
    """(node, component): strongly connected components of two nodes or more and self-loops, named by their smallest node.

    ``reach`` (root, node) is the closure over the nodes themselves: nodes that reach each other belong together.
    """
    there = reach.select("root", "node")
    back = reach.select(F.col("root").alias("node"), F.col("node").alias("root"))
    return there.join(back, ["root", "node"]).groupBy(F.col("root").alias("node")).agg(F.min("node").alias("component"))


def diamonds(reach: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, nodes, edges, extra): edges among what a root reaches, beyond those of a tree.

    ``edges`` are counted per source first, so the closure is joined with one number per node.
    """
    degree = edges.select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("_out"))
    nodes = reach.select("root", "node").unionByName(reach.select("root", F.col("root").alias("node"))).distinct()
    per_root = nodes.join(degree, F.col("node") == F.col("src"), "left").groupBy("root").agg(
        (F.count_if(F.col("node") != F.col("root"))).alias("nodes"), F.coalesce(F.sum("_out"), F.lit(0)).alias("edges")
    )
    return per_root.withColumn("extra", F.col("edges") - F.col("nodes"))


def shadowing(direct: DataFrame, reach: DataFrame, exports: DataFrame) -> DataFrame:
    """(root, symbol, n_direct, n_indirect): symbols that both a direct and an only indirect dependency define.

    ``direct`` (root, node), ``reach`` (root, node), ``exports`` (node, symbol).
    """
    own = direct.select("root", "node").distinct()
    indirect = reach.select("root", "node").where("root <> node").join(own, ["root", "node"], "left_anti")
    tagged = own.withColumn("near", F.lit(1)).unionByName(indirect.withColumn("near", F.lit(0)))
    counted = tagged.join(exports.distinct(), "node").groupBy("root", "symbol").agg(F.sum("near").alias("n_direct"), F.sum(1 - F.col("near")).alias("n_indirect"))
    return counted.where("n_direct > 0 and n_indirect > 0")


@dataclass
class FileGraph:
    """``files`` (id, path); ``edges`` (src, dst, times): what each file needs, by numbers; ``unresolved`` (id, soname), negative numbers."""

    files: DataFrame
    edges: DataFrame
    unresolved: DataFrame


def file_graph(libraries: DataFrame) -> FileGraph:
    """What each file needs, whether or not it has a soname itself.

    ``libraries`` (path, soname, needed). ``dst`` is the first provider of the soname by path, or the number of
    the soname where nothing provides it; ``times`` is how often one row of the file lists it at most.
    The rows of a path are one file, and so are all rows without a path. Files that need nothing have no edge.
    """
    path = F.coalesce("path", F.lit(_NO_PATH))
    files = numbered(libraries.select(path.alias("node"))).withColumnRenamed("node", "path")
    count = lambda k: F.struct(k.alias("soname"), F.size(F.filter("needed", lambda x: x == k)).alias("times"))
    listed = libraries.select(path.alias("path"), F.inline(F.transform(F.array_distinct("needed"), count))).join(files, "path")
    entries = materialise(listed.groupBy(F.col("id").alias("src"), "soname").agg(F.max("times").alias("times")), "entries")
    own = libraries.where("soname is not null").select("soname", path.alias("path")).distinct().join(files, "path")
    first = own.groupBy("soname").agg(F.min("id").alias("dst"))  # numbers are in the order of the paths
    asked = entries.select("soname").distinct().join(first, "soname", "left")
    asked = materialise(asked.withColumn("dst", F.coalesce("dst", -1 - F.monotonically_increasing_id())), "asked")
    edges = salted_lookup(entries, asked, "soname").groupBy("src", "dst").agg(F.sum("times").alias("times"))
    return FileGraph(files, materialise(edges, "file-edges"), asked.where("dst < 0").select(F.col("dst").alias("id"), "soname"))


def file_reach(graph: FileGraph, kept: DataFrame | None = None) -> DataFrame:
    """(src, dst, depth, out) for what each file reaches, itself left out, with the fewest steps; ``out`` counts the resolved entries of ``dst``.

    Sonames that nothing provides are ends. Only providers are walked from; a file has what its direct picks reach, one
    step further. With ``kept`` (dst), only these come out.
    """
    providers = graph.edges.where("dst >= 0").select(F.col("dst").alias("src")).distinct()
    reach = closure(graph.edges.select("src", "dst").join(providers, "src", "left_semi"))
    out = graph.edges.where("dst >= 0").groupBy(F.col("src").alias("dst")).agg(F.sum("times").alias("out"))
    direct, behind = graph.edges.select("src", "dst"), reach.select(F.col("root").alias("via"), F.col("node").alias("dst"), "depth")
    if kept is not None:
        direct, behind = direct.join(kept, "dst", "left_semi"), behind.join(kept, "dst", "left_semi")
    picks = graph.edges.where("dst >= 0").select("src", F.col("dst").alias("via"))
    behind = materialise(salted_lookup(materialise(behind, "behind"), out, "dst"), "behind")
    further = salted_lookup(picks, behind, "via").where("dst is not null").select("src", "dst", (F.col("depth") + 1).alias("depth"), "out")
    rows = salted_lookup(materialise(direct, "direct"), out, "dst").select("src", "dst", F.lit(1).alias("depth"), "out").unionByName(further).where("src <> dst")
    return rows.groupBy("src", "dst").agg(F.min("depth").alias("depth"), F.max("out").alias("out"))


def file_closures(graph: FileGraph) -> DataFrame:
    """(path, nodes, external, depth, edges, extra) of each file that needs anything.

    ``nodes`` counts the providers that it reaches, ``external`` the sonames that it or one of them needs and nothing
    provides, ``depth`` the steps to the farthest provider, ``edges`` the resolved entries of the file and of all that it reaches, as
    often as they are listed and those that lead back, too; ``extra`` are those beyond a tree.
    """
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    known = F.col("dst") >= 0
    sums = file_reach(graph).groupBy("src").agg(
        F.count_if(known).alias("nodes"), F.count_if(~known).alias("external"), F.max(F.when(known, F.col("depth"))).alias("depth"), F.sum(F.when(known, F.col("out"))).alias("below")
    )
    own = graph.edges.groupBy("src").agg(F.sum(F.when(known, F.col("times"))).alias("own"))
    rows = own.join(sums, "src", "left").join(graph.files.withColumnRenamed("id", "src"), "src")
    edges = zero("own") + zero("below")
    return rows.select(_path(), zero("nodes").alias("nodes"), zero("external").alias("external"), zero("depth").alias("depth"), edges.alias("edges"), (edges - zero("nodes")).alias("extra"))


def _path() -> Column:
    return F.nullif(F.col("path"), F.lit(_NO_PATH)).alias("path")


def file_shadowing(graph: FileGraph, exports: DataFrame) -> DataFrame:
    """(path, symbol, n_direct, n_indirect): symbols that both a direct and an only indirect provider of a file define.

    ``exports`` (path, symbol). A symbol that one file alone defines is passed over before the join.
    """
    defined = exports.where("symbol is not null").select(F.coalesce("path", F.lit(_NO_PATH)).alias("path"), "symbol").distinct()
    defined = defined.join(graph.files, "path").select(F.col("id").alias("dst"), "symbol")
    shared = materialise(defined.join(defined.groupBy("symbol").agg(F.count("*").alias("_n")).where("_n > 1"), "symbol", "left_semi"), "shared")
    reach = materialise(file_reach(graph, shared.select("dst").distinct()).select("src", "dst", "depth"), "file-reach")
    near = (F.col("depth") == 1).cast("bigint")
    counted = salted_lookup(reach, shared, "dst").groupBy("src", "symbol").agg(F.sum(near).alias("n_direct"), F.sum(1 - near).alias("n_indirect"))
    both = counted.where("n_direct > 0 and n_indirect > 0").join(graph.files.withColumnRenamed("id", "src"), "src")
    return both.select(_path(), "symbol", "n_direct", "n_indirect")


def diamond_totals(closures: DataFrame) -> DataFrame:
    """(bucket, files, extra) of ``file_closures``: files that reach anything, by what they have beyond a tree; ``tree`` without."""
    reached = closures.where("nodes > 0")
    name = F.when(F.col("extra") <= 0, "tree").otherwise(bucket(F.col("extra"), EXTRA_CUTS, ">10000"))
    return reached.groupBy(name.alias("bucket")).agg(F.count("*").alias("files"), F.sum(F.greatest("extra", F.lit(0))).alias("extra"))


def closure_ranks(closures: DataFrame, most: int = 25, least_edges: int = 50) -> DataFrame:
    """(ranking, place, path, nodes, edges, extra): the first ``most`` files by size of closure, by extra edges and by their share.

    Ties: by size to the smaller path, by extra edges to the larger share and then the larger path; the share is
    ranked among files with at least ``least_edges`` edges, ties to more extra edges, then the smaller path.
    """
    some, share = closures.where("nodes > 0"), F.col("extra") / F.col("edges")
    spread = some.where("extra > 0")
    orders = {
        "nodes": (some, [F.desc("nodes"), F.col("path")]),
        "extra": (spread, [F.desc("extra"), share.desc(), F.desc("path")]),
        "share": (spread.where(F.col("edges") >= least_edges), [share.desc(), F.desc("extra"), F.col("path")]),
    }
    parts = []
    for name, (rows, order) in orders.items():
        first = rows.orderBy(*order).limit(most)  # a heap per task; the window then sees ``most`` rows
        place = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order))
        parts.append(first.select(F.lit(name).alias("ranking"), place.alias("place"), "path", "nodes", "edges", "extra"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def package_picks(dependencies: DataFrame, providers: DataFrame) -> DataFrame:
    """(name, dep, pick, priority): for each dependency the provider with the highest priority, ties by name.

    ``dependencies`` (name, dep), ``providers`` (tag, provider, priority); unresolved ones keep a null pick.
    """
    best: Column = F.max_by("provider", F.struct("priority", "_order"))
    ranked = providers.withColumn("_order", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("provider"))))
    chosen = ranked.groupBy("tag").agg(best.alias("pick"), F.max("priority").alias("priority"))
    return dependencies.join(chosen, F.col("dep") == F.col("tag"), "left").select("name", "dep", "pick", "priority")


def package_graph(packages: DataFrame, providers: DataFrame) -> FileGraph:
    """Packages and, for each distinct dependency, the provider that ``package_picks`` takes, as a graph by numbers.

    ``packages`` (name, depends). Dependencies that nothing provides are negative numbers.
    """
    ids = numbered(packages.select(F.col("name").alias("node")))
    asked = packages.select("name", F.explode(F.array_distinct("depends")).alias("dep"))
    picks = materialise(package_picks(asked, providers).select("name", "dep", "pick"), "picks")
    lost = materialise(picks.where("pick is null").select("dep").distinct().select("dep", (-1 - F.monotonically_increasing_id()).alias("lost")), "lost")
    named = salted_lookup(picks, ids.select(F.col("node").alias("pick"), F.col("id").alias("dst")), "pick")
    ends = named.join(lost, "dep", "left").join(ids.select(F.col("node").alias("name"), F.col("id").alias("src")), "name")
    edges = ends.groupBy("src", F.coalesce("dst", "lost").alias("dst")).agg(F.count("*").alias("times"))
    return FileGraph(ids.withColumnRenamed("node", "path"), materialise(edges, "package-edges"), lost.select(F.col("lost").alias("id"), F.col("dep").alias("soname")))


def closure_conflicts(graph: FileGraph, declared: DataFrame) -> DataFrame:
    """(root, name, target): conflicts that bite, as both who declares one and its target are in the closure of ``root``.

    ``declared`` (name, target). A root belongs to its own closure.
    """
    numbers = declared.distinct().join(graph.files.select(F.col("path").alias("name"), F.col("id").alias("a")), "name")
    numbers = numbers.join(graph.files.select(F.col("path").alias("target"), F.col("id").alias("b")), "target")
    own = graph.files.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    members = materialise(file_reach(graph).where("dst >= 0").select("src", "dst").unionByName(own), "members")
    with_target = salted_lookup(members, numbers.withColumnRenamed("a", "dst"), "dst").where("b is not null")
    both = with_target.join(members.select("src", F.col("dst").alias("b")), ["src", "b"], "left_semi")
    return both.join(graph.files.select(F.col("id").alias("src"), F.col("path").alias("root")), "src").select("root", "name", "target")


def file_owners(files: DataFrame, last: bool = False) -> DataFrame:
    """(path, owner, n_owners): of the packages that hold a path the first (or last) in byte order; more than one is a collision."""
    owner = F.max("package") if last else F.min("package")
    per_package = files.where("path is not null and package is not null").select("path", "package").distinct()
    return per_package.groupBy("path").agg(owner.alias("owner"), F.count("*").alias("n_owners"))
