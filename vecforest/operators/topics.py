"""Topic trees from linkage: the merges of a group's parts, cut to a bounded depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecforest.operators.clustering import numbered_parts, part_linkage, protected_groups
from vecforest.operators.tree import node_table
from vecforest.sources.tables import materialize

DEPTH = 7


def kept_levels(merges: DataFrame, tops: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(g, node, path, score, open) of the nodes down to `depth` below the top of each binary tree; open ones lie at that depth and have more below them.

    merges: (g, node, left, right, score); tops: (g, node, path). A level is one join,
    and has at most 2 ** depth nodes for each group. A top without merges is a leaf below itself.
    """
    halves = merges.select("g", "node", "score", F.posexplode(F.array("left", "right")).alias("side", "child"))
    alone = tops.join(merges.select("g", "node"), ["g", "node"], "left_anti")
    levels = [alone.select("g", "node", F.concat("path", F.lit("/0")).alias("path"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("open"))]
    at = tops.select("g", "node", "path")
    for level in range(depth + 1):
        met = at.join(merges.select("g", "node", "score"), ["g", "node"], "left")
        here = met.select("g", "node", "path", "score", (F.col("score").isNotNull() & F.lit(level == depth)).alias("open"))
        levels.append(here if level else here.filter("score is not null"))
        if level < depth:
            at = materialize(at.join(halves, ["g", "node"]).select("g", F.col("child").alias("node"), F.concat("path", F.lit("/"), F.col("side").cast("string")).alias("path")))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return materialize(out)


def contracted(merges: DataFrame, kept: DataFrame) -> DataFrame:
    """(g, node, to) for each node that was cut away: the kept node above it, by pointer jumping.

    A node points to its parent; in a round, every pointer that has not reached a kept
    node takes over the pointer of the node it points to, so the rounds grow as the
    logarithm of the tree's height. Pointers that have arrived take no part any more.
    """
    parents = merges.select("g", F.explode(F.array("left", "right")).alias("node"), F.col("node").alias("to"))
    ends = kept.select("g", F.col("node").alias("to"), F.lit(True).alias("end"))
    below = parents.join(kept.select("g", "node"), ["g", "node"], "left_anti").join(ends, ["g", "to"], "left")
    pointers = materialize(below.select("g", "node", "to", F.coalesce("end", F.lit(False)).alias("end")))
    arrived = pointers.filter("end")
    while True:
        going = pointers.filter("not end")
        if going.isEmpty():
            return arrived.select("g", "node", "to")
        further = pointers.select("g", F.col("node").alias("to"), F.col("to").alias("next"), F.col("end").alias("next_end"))
        moved = materialize(going.join(further, ["g", "to"]).select("g", "node", F.col("next").alias("to"), F.col("next_end").alias("end")))
        arrived = materialize(arrived.unionByName(moved.filter("end")))
        pointers = arrived.unionByName(moved.filter("not end"))


def topic_tree(vecs: DataFrame, group: str, tau: float, least: int, depth: int = DEPTH, most: int = 400) -> tuple[DataFrame, DataFrame]:
    """The tree of topics of each group: members (doc_id, path) and nodes (node, kind, depth, root, parent, n, score).

    The protected groups of a group are merged by the mean similarity of their members.
    A merge down to `depth` is a branch with its two halves below it; what lies deeper is
    one leaf. A group of one part is a root with one leaf. A path holds the group and, at
    each level, 0 for the half with the smaller number; blanks and slashes in the group's
    name are encoded. A null group is named "-".
    """
    of = materialize(protected_groups(vecs, group, tau, least, most))  # read twice
    sized = vecs.select("doc_id", "vector").join(of, "doc_id")
    parts = numbered_parts(sized, group, "part")
    rows = materialize(parts.groupBy("g").agg(F.count("*").alias("rows")))
    merges = part_linkage(parts, most).join(rows, "g")
    merges = materialize(merges.select("g", (F.col("rows") + F.col("step")).cast("int").alias("node"), "left", "right", "score"))
    name = F.when(F.col("g") == "", "-").otherwise(F.url_encode(F.expr("substring(g, 2)")))
    tops = rows.select("g", (2 * F.col("rows") - 2).cast("int").alias("node"), F.concat(F.lit("t:"), name).alias("path"))
    kept = kept_levels(merges, tops, depth)
    to = kept.select("g", "node", F.col("node").alias("to")).unionByName(contracted(merges, kept))
    leaf_of = to.join(kept.select("g", F.col("node").alias("to"), "path"), ["g", "to"]).select("g", "node", "path")
    placed = parts.select("g", "part", F.col("number").cast("int").alias("node")).join(leaf_of, ["g", "node"])
    own = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    members = materialize(of.select("doc_id", own.alias("g"), "part").join(placed, ["g", "part"]).select("doc_id", "path"))
    nodes = node_table(members).join(kept.select(F.col("path").alias("node"), F.round("score", 9).alias("score")), "node", "left")
    return members, nodes
