"""Gain-loss scenarios of cognate sets on a tree of doculects, and what follows from them."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clusters, trees
from .graphs import kept
from .linkage import linked
from .table import distance_swadesh


def doculect_tree(df: DataFrame, method: str = "upgma", ref: str = "cogid") -> str:
    """Newick tree of the doculects from their distances; the matrix has a cell for each two doculects and comes to the driver."""
    rows = distance_swadesh(df, ref).collect()
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    at = {n: i for i, n in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    for r in rows:
        d[at[r["a"]], at[r["b"]]] = d[at[r["b"]], at[r["a"]]] = r["distance"]
    make = clusters.upgma_newick if method == "upgma" else clusters.neighbor_newick
    return make(d, [n.replace(" ", "_") for n in names])


def tree_edges(newick: str) -> list[tuple[str, str]]:
    """(node, parent) of every node of a tree but the root, as rows of a table."""
    return [(node, parent) for node, parent, _ in trees.edges(trees.parse(newick))]


def _preorder(tree: list[tuple[str, str]]) -> tuple[list[str], dict[str, list[str]], dict[str, str]]:
    """The nodes, each after its parent, the children of each inner node, and the parents."""
    children: dict[str, list[str]] = {}
    for node, parent in sorted(tree):
        children.setdefault(parent, []).append(node)
    parents = dict(tree)
    roots = sorted(set(children) - set(parents))
    if len(roots) != 1 or len(parents) != len(tree):
        raise ValueError("a tree has one root, and one parent for each other node")
    order, todo = [], roots
    while todo:
        order.append(todo.pop())
        todo += children.get(order[-1], [])
    if len(order) != len(tree) + 1:
        raise ValueError("some nodes do not hang on the root")
    return order, children, parents


def scenarios(paps: DataFrame, tree: str | list[tuple[str, str]], ref: str = "cogid", gain: float = 1.0, loss: float = 1.0, missing: int = -1) -> DataFrame:
    """For each set the cheapest scenario ("node:state,..." by name), its number of origins, and present, the nodes that have the set.

    paps: ref, doculect, state; tree: Newick (blanks in names as _) or the rows
    (node, parent). Costs of both states go up the tree and states come down
    (Sankoff), as two folds over its nodes for each distinct pattern: only the
    patterns are shuffled, and the tree, of the size of the doculects, is a
    constant of the plan. Of equally cheap scenarios that with later gains is
    taken. A doculect that is not in paps, or whose state is missing or null,
    may have either state.
    """
    order, children, parents = _preorder(tree_edges(tree) if isinstance(tree, str) else list(tree))
    at, last = {n: k for k, n in enumerate(order)}, len(order) - 1
    name = F.translate("doculect", " ", "_") if isinstance(tree, str) else F.col("doculect")
    cells = F.array_sort(F.collect_list(F.struct(name.alias("d"), F.col("state").cast("int").alias("s"))))
    patterns = paps.where("doculect is not null").groupBy(F.col(ref).alias("ref")).agg(cells.alias("pattern"))

    whole = lambda xs: F.array(*map(F.lit, xs)).cast("array<int>")
    # children before parents: a node's place among the costs counts from the last node on
    upward = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(n not in children).alias("tip"), whole(last - at[c] for c in children.get(n, [])).alias("below")) for n in reversed(order)])
    downward = F.array(*[F.struct(F.lit(last - k).alias("at"), F.lit(at[parents[n]] if n in parents else -1).alias("above")) for k, n in enumerate(order)])
    by_name = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(at[n]).alias("at"), F.lit(at[parents[n]] if n in parents else -1).alias("above")) for n in sorted(order)])

    def up(costs: Column, x: Column) -> Column:
        own = F.try_element_at("states", x["n"])

        def cost(same: str, other: str, change: float, forbidden: int) -> Column:
            below = F.aggregate(x["below"], F.lit(0.0), lambda sum_, c: sum_ + F.least(F.get(costs[same], c), F.get(costs[other], c) + change))
            return F.concat(costs[same], F.array(F.when(x["tip"], F.when(own == forbidden, float("inf")).otherwise(0.0)).otherwise(below)))

        return F.struct(cost("absent", "present", gain, 1).alias("absent"), cost("present", "absent", loss, 0).alias("present"))

    def down(costs: Column) -> Column:
        def step(states: Column, x: Column) -> Column:
            above = F.when(x["above"] >= 0, F.get(states, x["above"])).otherwise(0)
            absent = F.get(costs["absent"], x["at"]) + F.when(above == 1, loss).otherwise(0.0)
            present = F.get(costs["present"], x["at"]) + F.when(above == 0, gain).otherwise(0.0)
            # the present state only if it is cheaper
            return F.concat(states, F.array((absent > present).cast("int")))

        return F.aggregate(downward, F.array().cast("array<int>"), step)

    def named(states: Column) -> Column:
        above = lambda x: F.when(x["above"] >= 0, F.get(states, x["above"])).otherwise(0)
        return F.transform(by_name, lambda x: F.struct(x["n"].alias("n"), F.get(states, x["at"]).alias("s"), above(x).alias("above")))

    none = F.array().cast("array<double>")
    costs = F.aggregate(upward, F.struct(none.alias("absent"), none.alias("present")), up)
    # transform over an array of one: each fold is done once
    nodes = F.element_at(F.transform(F.transform(F.array(costs), down), named), 1)
    # written, so that no reader's filters copy the folds
    solved = kept(patterns.select("pattern").distinct().select("pattern", F.map_from_entries("pattern").alias("states")).select("pattern", nodes.alias("nodes")))
    changes = F.filter("nodes", lambda x: x["s"] != x["above"])
    solved = solved.select(
        "pattern",
        F.array_join(F.transform(changes, lambda x: F.concat_ws(":", x["n"], x["s"].cast("string"))), ",").alias("scenario"),
        F.size(F.filter(changes, lambda x: x["s"] == 1)).alias("origins"),
        F.transform(F.filter("nodes", lambda x: x["s"] == 1), lambda x: x["n"]).alias("present"),
    )
    return patterns.join(solved, "pattern").select(F.col("ref").alias(ref), "scenario", "origins", "present")


def origin_stats(found: DataFrame) -> DataFrame:
    """Sets, mean origins, most origins, and the share with more than one (one row)."""
    return found.agg(F.count("*").alias("sets"), F.avg("origins").alias("mean"), F.max("origins").alias("most"), F.avg((F.col("origins") > 1).cast("int")).alias("patchy"))


def vocabulary_sizes(found: DataFrame) -> DataFrame:
    """node and how many sets it has under the scenarios: ancestral and contemporary vocabulary sizes."""
    return found.select(F.explode("present").alias("node")).groupBy("node").agg(F.count("*").alias("sets"))


def inherited_sizes(found: DataFrame, tree: list[tuple[str, str]]) -> DataFrame:
    """node and how many of its sets its parent has, too: sizes of the inherited vocabulary."""
    parents = found.sparkSession.createDataFrame(tree, "node string, parent string")
    rows = found.select("present", F.explode("present").alias("node")).join(parents, "node").where(F.array_contains("present", F.col("parent")))
    return rows.groupBy("node").agg(F.count("*").alias("sets"))


def lateral_edges(found: DataFrame, tree: list[tuple[str, str]]) -> DataFrame:
    """Pairs of origins (a < b) in the spanning trees of the sets' origins, and in how many sets: the minimal lateral network.

    Two origins are the nearer, the more sets have both; then the fewer edges
    of the tree are between them, then by name. Sets with equal scenarios share
    one spanning tree.
    """
    origins = F.transform(F.filter(F.split("scenario", ","), lambda x: F.right(x, F.lit(2)) == ":1"), lambda x: F.regexp_replace(x, ":1$", ""))
    sets = kept(found.where("origins > 1").groupBy("scenario").agg(F.count("*").alias("n")).withColumn("o", F.array_sort(origins)))
    # origins are nodes of the tree: a scenario has few
    pairs = F.flatten(F.transform("o", lambda x: F.transform(F.filter("o", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    both = kept(sets.select(F.col("scenario").alias("block"), "n", F.explode(pairs).alias("p")).select("block", "n", "p.a", "p.b"))
    weights = both.groupBy("a", "b").agg(F.sum("n").alias("w"))
    up = {}
    for node, parent in tree:
        up[node] = parent
    def path(n: str) -> list[str]:
        return [n, *path(up[n])] if n in up else [n]
    lines = {n: path(n) for n in {*up, *up.values()}}
    steps = [(a, b, len(set(lines[a]) ^ set(lines[b]))) for a in lines for b in lines if a < b]
    apart = found.sparkSession.createDataFrame(steps, "a string, b string, steps int")
    cost = F.struct((-F.col("w")).alias("w"), "steps")
    edges = both.join(weights, ["a", "b"]).join(apart, ["a", "b"]).select("block", "a", "b", cost.alias("cost"))
    chosen = spanning_trees(edges)
    return chosen.join(sets.select(F.col("scenario").alias("block"), "n"), "block").groupBy("a", "b").agg(F.sum("n").alias("sets"))


def spanning_trees(edges: DataFrame) -> DataFrame:
    """block, a and b of the cheapest spanning forest of every block; edges: block, a, b (a < b, each pair once) and cost (anything that has an order).

    Boruvka's rounds for all blocks at once: every component takes the cheapest
    edge that leaves it (ties by a, then b), and what these join is one
    component in the next round. A round at least halves the components.
    """
    live = kept(edges.select("block", "a", "b", "cost", F.col("a").alias("x"), F.col("b").alias("y")))
    chosen = edges.select("block", "a", "b").limit(0)
    while True:
        leaving = live.select("block", F.explode(F.array("x", "y")).alias("node"), F.struct("cost", "a", "b", "x", "y").alias("e"))
        new = kept(leaving.groupBy("block", "node").agg(F.min("e").alias("e")).select("block", "e.a", "e.b", "e.x", "e.y").distinct())
        if new.isEmpty():
            return chosen
        chosen = chosen.union(new.select("block", "a", "b"))
        joined = linked(new.select("block", F.col("x").alias("a"), F.col("y").alias("b")))
        to = lambda c: joined.select("block", F.col("node").alias(c), F.col("root").alias(f"to_{c}"))
        moved = live.join(to("x"), ["block", "x"], "left").join(to("y"), ["block", "y"], "left")
        moved = moved.withColumns({"x": F.coalesce("to_x", "x"), "y": F.coalesce("to_y", "y")}).where("x <> y")
        live = kept(moved.select("block", "a", "b", "cost", "x", "y"))


def spanning_tree(nodes: list[str], weights: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """Edges of the heaviest tree over nodes (Kruskal); ties by name."""
    parent = {n: n for n in nodes}

    def find(x: str) -> str:
        while parent[x] != x:
            x = parent[x]
        return x

    out = []
    for a, b in sorted(combinations(sorted(nodes), 2), key=lambda e: (-weights.get(e, 0.0), e)):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            out.append((a, b))
    return out
