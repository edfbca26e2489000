"""Dependency closure, its tree and its status.

The closure is a loop of joins, one for each level down to ``max_depth``: the frontier joins the edges on
its keys, so a level's cost follows its size and the packages of all roots move together. Paths are arrays of
zero-padded child ordinals; sorted, they are the pre-order of the tree. Which visit of a package is the first is found for
all roots together, by a fixpoint over least paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut

MAX_DEPTH = 5
SAFE = ("safe", "first-encounter-accepted")


def closure(roots: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(root, node, depth): every package that a root reaches in at most ``max_depth`` steps, at its least depth.

    ``roots``: node. ``edges``: parent, child. Packages that were reached before are not expanded again.
    """
    frontier = cut(roots.select(F.col("node").alias("root"), "node").distinct().withColumn("depth", F.lit(0)))
    reached = frontier
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, frontier.node == edges.parent).select("root", F.col("child").alias("node")).distinct()
        # each level is written, so that the plan doesn't double with the levels
        frontier = cut(step.join(reached.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


#: Digits of a child's number in a path.
_DIGITS = 6
_ROOT = "0" * _DIGITS


def first_visits(roots: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(root, node, path): where a walk in pre-order, which expands a package at its first visit only, first meets each package.

    A path is the ordinals of the children on the way, so paths sort as the walk goes. Each round expands what is held to be
    first visits and takes each package's least path; what was expanded at a path that is no longer the least is not there in
    the next round. Whether a visit is there and is the first depends on smaller paths alone, so where nothing changes any more it is the walk.
    All roots move together, and a round is one join and one aggregate; a package that very many trees have is split by the join.
    """
    start = roots.select(F.col("node").alias("root"), "node", F.lit(_ROOT).alias("path")).distinct()
    held = cut(start.withColumn("before", F.lit(None).cast("string")))
    edges = cut(edges.select("parent", "ordinal", "child"))
    while True:
        found = held.where("path IS NOT NULL").select("root", "node", "path")
        visits = start.unionByName(_children(found, edges, max_depth).select("root", "node", "path"))
        both = visits.withColumn("before", F.lit(None).cast("string")).unionByName(found.select("root", "node", F.lit(None).cast("string").alias("path"), F.col("path").alias("before")))
        new = cut(both.groupBy("root", "node").agg(F.min("path").alias("path"), F.max("before").alias("before")))
        if new.where("NOT path <=> before").isEmpty():
            return new.where("path IS NOT NULL").select("root", "node", "path")
        held = new


def _depth() -> Column:
    return F.floor(F.length("path") / (_DIGITS + 1)).cast("int")


def _children(first: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(root, node, path, parent) of the children of first visits above ``max_depth``."""
    open_ = first.where(_depth() < max_depth).select("root", F.col("node").alias("parent"), F.col("path").alias("above"))
    return open_.hint("merge").join(edges, "parent").select("root", F.col("child").alias("node"), F.concat("above", F.lit("."), F.lpad(F.col("ordinal").cast("string"), _DIGITS, "0")).alias("path"), "parent")


def tree(roots: DataFrame, edges: DataFrame, statuses: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row a node of each root's tree: root, path, node, parent, depth, cycle, truncated, status.

    The first visit of a package is expanded, later ones are marked as cycle, also where they are diamonds; first visits at
    ``max_depth`` are truncated, unless they are errors: of these nothing is known that could be cut. ``edges``: parent, ordinal, child; an ordinal is under a million. ``statuses``: node, status, and ``leaf`` where
    nodes can be visited again and again as they stand for nothing that was audited.
    """
    first = cut(first_visits(roots, edges, max_depth))
    visits = first.where(F.col("path") == _ROOT).withColumn("parent", F.lit(None).cast(first.schema["node"].dataType))
    visits = visits.unionByName(_children(first, edges, max_depth))
    known = statuses.withColumn("leaf", F.coalesce("leaf", F.lit(False)) if "leaf" in statuses.columns else F.lit(False)).select("node", "status", "leaf")
    rows = visits.hint("merge").join(first.select("root", "node", F.col("path").alias("_first")), ["root", "node"]).hint("merge").join(known, "node", "left")
    cycle = (F.col("path") != F.col("_first")) & ~F.coalesce("leaf", F.lit(False))
    # written once: what is read from a tree reads it several times
    return cut(rows.select("root", "path", "node", "parent", _depth().alias("depth"), cycle.alias("cycle"), (~cycle & (_depth() >= max_depth) & ~F.coalesce(F.col("status") == "error", F.lit(False))).alias("truncated"), F.when(~cycle, F.col("status")).alias("status")))


def composed_status(tree_rows: DataFrame) -> DataFrame:
    """(root, composed_status): the root's own status if it blocks, else the way to the first blocking node in pre-order.

    Cycle and truncated nodes count as safe. Nodes are called by their column ``name`` where the tree has one.
    """
    label = F.col("name" if "name" in tree_rows.columns else "node")
    own = F.when(F.col("cycle") | F.col("truncated"), "safe").otherwise(F.coalesce("status", F.lit("unknown")))
    rows = tree_rows.withColumn("own", own)
    bad = rows.where(~F.col("own").isin(*SAFE)).groupBy("root").agg(F.min(F.struct("path", "own")).alias("b"))
    # names along the path of the first blocking node
    along = rows.join(bad, "root").where(F.col("b.path").startswith(F.concat(F.col("path"), F.lit("."))) | (F.col("b.path") == F.col("path")))
    names = along.where("depth > 0").groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", label.alias("label")))), lambda x: F.concat(F.lit("blocked-via:"), x["label"], F.lit("="))), "").alias("way"))
    return rows.where("depth = 0").select("root").join(bad, "root", "left").join(names, "root", "left").select("root", F.coalesce(F.concat(F.coalesce("way", F.lit("")), "b.own"), F.lit("safe")).alias("composed_status"))


def accept_closure(tree_rows: DataFrame) -> DataFrame:
    """(root, refused, pending): a closure with an error, a low score or drift is refused; else its needs-accept nodes are to be written."""
    hard = F.col("status").isin("error", "low-score", "drift")
    return tree_rows.where("NOT cycle").groupBy("root").agg(
        F.coalesce(F.bool_or(hard), F.lit(False)).alias("refused"),
        F.array_sort(F.collect_set(F.when(F.col("status") == "first-encounter-needs-accept", F.col("node")))).alias("pending"),
    ).withColumn("pending", F.when(F.col("refused"), F.array().cast("array<string>")).otherwise(F.col("pending")))


def render(tree_rows: DataFrame) -> DataFrame:
    """(root, path, line): the tree as text, a node a line, indented by its depth; order by path."""
    mark = F.when(F.col("cycle"), " (cycle)").when(F.col("truncated"), " (truncated)").otherwise(F.concat(F.lit(" ["), F.coalesce("status", F.lit("unknown")), F.lit("]")))
    return tree_rows.select("root", "path", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.when(F.col("depth") > 0, "- ").otherwise(""), "node", mark).alias("line"))
