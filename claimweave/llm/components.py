"""Problem 6: consolidating pairwise matches into groups.

Seed-tree pruning (the method of Lulli et al., "Fast connected components computation in large graphs by vertex
pruning", 2017) on DataFrames: each round every vertex tells its neighbourhood the least vertex it knows, vertices that
are no one's least drop out into a propagation forest, and the seeds' identifiers flow down that forest at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.runtime import HOT_KEY, spread_join, stash

MAX_ROUNDS = 60


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def seed_tree_components(edges: DataFrame, a: str, b: str, label: str = "seedtree") -> DataFrame:
    """(id, group_id): every vertex of an edge between two different vertices, with the least vertex of its component.

    Null ends, self-links, repeats and reversed repeats add nothing; an edgeless table gives no rows. Neighbourhood minima
    are taken by map-side combined aggregates, and where minima and parents are joined back, vertices with very many edges
    or children are broadcast (spread_join), so that no task gathers a hot vertex.
    """
    links = (
        edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .toDF("u", "v", "ok")
        .where("ok")
        .select("u", "v")
        .distinct()
    )
    graph = stash(links, label + "-e")
    trees: DataFrame | None = None
    for k in range(MAX_ROUNDS):
        n = 2 * graph.count()
        if not n:
            break
        both = _directed(graph)
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # min selection: u tells itself and its neighbours its least; only distinct (vertex, minimum) pairs go on
        told = spread_join(both, least, "u", n, f"{label}-l{k}").select(F.col("v").alias("x"), "m").unionByName(least.select(F.col("u").alias("x"), "m")).distinct()
        told = stash(told, f"{label}-d{k}")
        mins = stash(told.groupBy("x").agg(F.min("m").alias("root"), F.max(F.expr("m = x")).alias("seed"), F.count("*").alias("k")), f"{label}-m{k}")
        # pruning: a vertex that no neighbourhood names as its least leaves the graph and hangs below its own least
        gone = mins.where("NOT seed").select(F.col("x").alias("child"), F.col("root").alias("parent"))
        trees = gone if trees is None else trees.unionByName(gone)
        # the minima a vertex has heard of stay connected through the least of them
        graph = stash(
            spread_join(told, mins.where("k > 1").select("x", "root", F.col("k").alias("n")), "x", 2 * n, f"{label}-r{k}").where("m <> root").select(F.col("root").alias("u"), F.col("m").alias("v")).distinct(),
            f"{label}-g{k}",
        )
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    if trees is None:
        return graph.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    # seed propagation: parents are replaced by their own parents until all are seeds
    below = stash(trees, label + "-t")
    vertices = below.count()
    for k in range(MAX_ROUNDS):
        up = below.select(F.col("child").alias("parent"), F.col("parent").alias("above"), F.lit(1).alias("n"))
        if vertices > HOT_KEY:  # every parent, with its own one where it has one and the number of its children
            up = below.groupBy("parent").agg(F.count("*").alias("n")).join(up.drop("n"), "parent", "left")
        step = stash(spread_join(below, up, "parent", vertices, f"{label}-u{k}", "left").select("child", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), f"{label}-p{k}")
        below = step.select("child", "parent")
        if not step.where("moved").limit(1).count():
            break
    else:
        raise RuntimeError(f"seeds did not reach all vertices in {MAX_ROUNDS} rounds")
    members = below.select(F.col("child").alias("id"), F.col("parent").alias("group_id"))
    return members.unionByName(below.select(F.col("parent").alias("id"), F.col("parent").alias("group_id")).distinct())


def normal_id(column: str):
    return F.lower(F.trim(F.col(column)))


def same_as_groups(relations: DataFrame, nodes: DataFrame, label: str = "sameas") -> DataFrame:
    """(id, group_id) over relations that read same_as between ids present in nodes.

    Case, padding, and blank or hyphen for underscore in the type are disregarded, as are case and padding of ids.
    Null types and ends, self-links and ids absent from nodes add nothing.
    """
    kind = F.regexp_replace(F.lower(F.trim(F.col("type"))), "[ -]", "_")
    links = relations.where(kind == "same_as").select(F.least(normal_id("src"), normal_id("dst")).alias("x"), F.greatest(normal_id("src"), normal_id("dst")).alias("y")).where("x <> y").distinct()
    known = nodes.select(F.col("id").alias("raw"), normal_id("id").alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.min("raw").alias("raw"))
    real = links.join(known.select(F.col("key").alias("x"), F.col("raw").alias("a")), "x").join(known.select(F.col("key").alias("y"), F.col("raw").alias("b")), "y")
    return seed_tree_components(real.select("a", "b"), "a", "b", label)
