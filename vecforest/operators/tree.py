"""Nodes of the forest, their checks, scopes and views.

A tree is a table of document paths such as r/3/1/system: a node is a prefix, a
document belongs to each prefix of its path. Ancestors come from the path, so no
walk over the tree is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vecforest.functions.scalars import fnv1a32
from vecforest.functions.vectors import distance3
from vecforest.operators.stats import ranks
from vecforest.sources.tables import materialize


def prefixes(path: Column) -> Column:
    """All nodes on the way to a path, the root first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def parent_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", ""))


def node_table(members: DataFrame) -> DataFrame:
    """(node, kind, depth, root, parent, n) over members (doc_id, path). Leaves are counted first, and only they are spread over their ancestors."""
    leaves = members.groupBy("path").agg(F.count("*").alias("m"))
    each = leaves.select("path", "m", F.explode(prefixes(F.col("path"))).alias("node"))
    nodes = each.groupBy("node").agg(F.sum("m").alias("n"), F.max(F.col("node") == F.col("path")).alias("leaf"))
    depth = F.size(F.split("node", "/")) - 1
    kind = F.when(F.col("leaf"), "leaf").when(depth == 0, "root").otherwise("branch")
    return nodes.select("node", kind.alias("kind"), depth.alias("depth"), F.split_part("node", F.lit("/"), F.lit(1)).alias("root"), parent_of(F.col("node")).alias("parent"), "n")


def path_of(nodes: DataFrame) -> DataFrame:
    """(node, step, ancestor): the way from the root to each node."""
    return nodes.select("node", F.posexplode(prefixes(F.col("node"))).alias("step", "ancestor"))


def descendants(nodes: DataFrame, node: str) -> DataFrame:
    return nodes.filter(F.col("node").startswith(node + "/"))


def matching_nodes(members: DataFrame, matches: Column) -> DataFrame:
    """(node, n): nodes with documents that match, and how many."""
    leaves = members.filter(matches).groupBy("path").agg(F.count("*").alias("m"))
    return leaves.select("m", F.explode(prefixes(F.col("path"))).alias("node")).groupBy("node").agg(F.sum("m").alias("n"))


def representatives(children: DataFrame, parent: str, score: Column, n: int, match: Column | None = None) -> DataFrame:
    """The first n children of each parent by score, count and id."""
    rows = children if match is None else children.filter(match)
    w = W.partitionBy(parent).orderBy(score.desc(), F.desc("n"), "node")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def topic_members(members: DataFrame, node: str, limit: int = 80) -> DataFrame:
    """The first members of a node by id: a page of a list."""
    return members.filter((F.col("path") == node) | F.col("path").startswith(node + "/")).orderBy("doc_id").limit(limit)


def related_edges(edges: DataFrame, members: DataFrame, node: str, k: int = 8) -> DataFrame:
    """The strongest k cross edges that touch a node or what is below it."""
    inside = members.filter((F.col("path") == node) | F.col("path").startswith(node + "/")).select("doc_id")
    a = edges.join(inside.withColumnRenamed("doc_id", "src"), "src", "left_semi")
    b = edges.join(inside.withColumnRenamed("doc_id", "dst"), "dst", "left_semi")
    return a.unionByName(b.select(*a.columns)).distinct().orderBy(F.desc("score"), "src", "dst").limit(k)


TEXT_ZOOM = 0.85


def text_nodes(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Documents as nodes below their leaves: node (path/number of the document, filled up with zeros), depth, parent."""
    leaf = nodes.select(F.col("node").alias("path"), (F.col("depth") + 1).alias("depth"))
    return members.join(leaf, "path").select(F.concat("path", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 20, "0")).alias("node"), F.lit("text").alias("kind"), "depth", F.col("path").alias("parent"))


def visible_frontier(nodes: DataFrame, depth: int, focus: str | None, budget: int, members: DataFrame | None = None, matches: Column | None = None, zoom: float = 1.0) -> DataFrame:
    """(position, node, depth, on): nodes to show, up to a budget.

    All roots come first, then nodes in pre-order down to `depth` and below the nodes on
    the way to the focus, those on the way before their siblings, which are in the order
    of their names. With members (doc_id, path, ...) documents are nodes too, shown from a
    zoom of TEXT_ZOOM on or below a leaf on the way; with matches, a condition on members,
    only nodes that hold a matching document are shown. Each task keeps `budget` nodes.
    """
    focus = focus or ""
    every = nodes.select("node", "kind", "depth", "parent")
    if members is not None:
        if matches is not None:
            every = every.join(matching_nodes(members, matches).select("node"), "node", "left_semi")
            members = members.filter(matches)
        every = every.unionByName(text_nodes(members, nodes))
    on = lambda c: F.coalesce(F.lit(focus + "/").startswith(F.concat(c, F.lit("/"))), F.lit(False))
    open_parent = (F.col("depth") <= depth) | on(F.col("parent"))
    shown = every.filter(open_parent & ((F.col("kind") != "text") | F.lit(zoom >= TEXT_ZOOM) | on(F.col("parent"))))
    way = F.transform(prefixes(F.col("node")), lambda p: F.struct((~on(p)).alias("off"), p.alias("node")))
    key = [F.col("depth") > 0, F.when(F.col("depth") > 0, way), F.col("node")]
    top = shown.withColumn("on", on(F.col("node"))).orderBy(*key).limit(budget)
    return top.withColumn("position", F.row_number().over(W.orderBy(*key))).select("position", "node", "depth", "on")  # at most budget rows


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, name, n): nodes by kind, members by root and edges by type."""
    kinds = nodes.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), "name", "n")
    roots = nodes.filter("parent is null").select(F.lit("members").alias("what"), F.col("node").alias("name"), "n")
    types = edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "name", "n")
    return kinds.unionByName(roots).unionByName(types)


def graph_violations(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """(rule, id): what is wrong with a graph of nodes (node, kind, depth, root, parent, n, x, y, z, radius), edges (src, dst, type, score) and members (doc_id, path)."""
    found = []
    rule = lambda name, df, c: found.append(df.select(F.lit(name).alias("rule"), F.col(c).cast("string").alias("id")))
    rule("repeated node", nodes.groupBy("node").count().filter("count > 1"), "node")
    rule("kind", nodes.filter(~F.col("kind").isin("root", "branch", "leaf", "text")), "node")
    far = lambda c: F.col(c).isNull() | F.isnan(F.col(c)) | (F.abs(F.col(c)) > 1e7)
    rule("position", nodes.filter(far("x") | far("y") | far("z")), "node")
    rule("radius", nodes.filter(~F.coalesce((F.col("radius") > 0) & (F.col("radius") <= 1e5), F.lit(False))), "node")
    rule("root", nodes.filter((F.col("kind") == "root") & (F.col("parent").isNotNull() | (F.col("root") != F.col("node")))), "node")
    up = nodes.select(F.col("node").alias("parent"), F.col("root").alias("up_root"), F.col("depth").alias("up_depth"))
    met = nodes.filter("parent is not null").join(up, "parent", "left")
    rule("parent", met.filter("up_root is null"), "node")
    rule("parent's root", met.filter("up_root <> root"), "node")
    rule("depth", met.filter("depth <> up_depth + 1"), "node")
    # A depth that grows by one from the parent rules cycles out; what is left is a node without a way to a root.
    rule("no way up", nodes.filter("parent is null and kind <> 'root'"), "node")
    rule("document in several leaves", members.groupBy("doc_id").agg(F.count_distinct("path").alias("c")).filter("c > 1"), "doc_id")
    rule("member of no node", members.join(nodes.select(F.col("node").alias("path")), "path", "left_anti"), "doc_id")
    rule("score", edges.filter(F.col("score").isNull() | F.isnan("score") | (F.abs("score") > 1.000001)), "src")
    rule("loop", edges.filter("src = dst"), "src")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def check_build(nodes: DataFrame, members: DataFrame, edges: DataFrame, vecs: DataFrame, tau: float, cap: int) -> DataFrame:
    """(rule, n): broken invariants of a built graph, with edges (src, dst, type, score) between documents."""
    from vecforest.functions.vectors import dot

    v = vecs.select("doc_id", "vector", "root", "leaf")
    a = v.select(F.col("doc_id").alias("src"), F.col("vector").alias("x"), F.col("root").alias("root_a"), F.col("leaf").alias("leaf_a"))
    b = v.select(F.col("doc_id").alias("dst"), F.col("vector").alias("y"), F.col("root").alias("root_b"), F.col("leaf").alias("leaf_b"))
    met = edges.join(a, "src").join(b, "dst")
    wrong = met.agg(
        F.count_if(F.abs(F.col("score") - dot(F.col("x"), F.col("y"))) > 1e-5).alias("score"), F.count_if((F.col("type") == "knn") & (F.col("root_a") != F.col("root_b"))).alias("knn root"),
        F.count_if((F.col("type") == "cross") & (F.col("root_a") == F.col("root_b"))).alias("cross root"), F.count_if((F.col("type") == "cross") & (F.col("score") < tau)).alias("cross score"),
    )
    degree = met.filter("type = 'cross'").select(F.explode(F.array("leaf_a", "leaf_b")).alias("leaf")).groupBy("leaf").count().filter(F.col("count") > cap)
    counts = nodes.agg((F.count_if(F.col("parent").isNotNull()) - (F.count("*") - F.count_if(F.col("kind") == "root"))).alias("n"))
    lost = vecs.join(members, "doc_id", "left_anti")
    parts = [wrong.select(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("n")) for c in ("score", "knn root", "cross root", "cross score")]
    parts += [degree.agg(F.count("*").alias("n")).select(F.lit("cross degree").alias("rule"), "n"), counts.select(F.lit("tree edges").alias("rule"), "n"), lost.agg(F.count("*").alias("n")).select(F.lit("lost documents").alias("rule"), "n")]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def build_scopes(leaves: DataFrame) -> DataFrame:
    """(scope_id, role, parent, semantic_id) over leaves (leaf, branch, root, distance to the root).

    A root is a galaxy and a leaf a system. Where a root has more than three leaves,
    the farthest stays free; a branch with two or more of the others is a region.
    """
    w = W.partitionBy("root")
    ranked = leaves.withColumns({"leaves": F.count("*").over(w), "far": F.row_number().over(w.orderBy(F.desc("distance"), "leaf"))})
    field = (F.col("leaves") > 3) & (F.col("far") == 1)
    marked = ranked.withColumn("free", field)
    sizes = marked.filter("not free").groupBy("root", "branch").agg(F.count("*").alias("m"))
    placed = marked.join(sizes, ["root", "branch"], "left")
    region = (F.col("leaves") > 3) & ~F.col("free") & (F.col("m") >= 2)
    galaxy = F.concat(F.lit("galaxy:"), "root")
    region_id = F.concat(F.lit("region:"), "branch")
    systems = placed.select(F.concat(F.lit("system:"), "leaf").alias("scope_id"), F.lit("system").alias("role"), F.when(region, region_id).otherwise(galaxy).alias("parent"), F.col("leaf").alias("semantic_id"))
    regions = placed.filter(region).select(region_id.alias("scope_id"), F.lit("region").alias("role"), galaxy.alias("parent"), F.col("branch").alias("semantic_id")).distinct()
    galaxies = leaves.select(galaxy.alias("scope_id"), F.lit("galaxy").alias("role"), F.lit("universe").alias("parent"), F.col("root").alias("semantic_id")).distinct()
    return systems.unionByName(regions).unionByName(galaxies)


def routes(scopes: DataFrame) -> DataFrame:
    """(scope_id, route): scopes from the universe down to each system; three joins on few rows, as scopes are at most four deep."""
    up = lambda n: scopes.select(F.col("scope_id").alias(f"s{n}"), F.col("parent").alias(f"p{n}"))
    s = scopes.filter("role = 'system'").select("scope_id", F.col("parent").alias("p0"))
    met = s.join(up(1), F.col("p0") == F.col("s1"), "left").join(up(2), F.col("p1") == F.col("s2"), "left")
    route = F.filter(F.array("p2", "p1", "p0", "scope_id"), lambda x: x.isNotNull())
    return met.select("scope_id", route.alias("route"))


def scope_counts(route_rows: DataFrame, docs_per_system: DataFrame) -> DataFrame:
    """(scope_id, n_docs, n_children): documents below each scope and its direct children."""
    each = route_rows.join(docs_per_system, "scope_id", "left").fillna(0, ["n"]).select("scope_id", F.posexplode("route").alias("at", "up"), "n", "route")
    child = F.try_element_at("route", F.col("at") + 2)
    return each.groupBy(F.col("up").alias("id")).agg(F.sum("n").alias("n_docs"), F.count_distinct(child).alias("n_children")).withColumnRenamed("id", "scope_id")


def fibonacci_sphere(galaxies: DataFrame, order: str, radius: float = 68.0) -> DataFrame:
    """Places of the galaxies, evenly on a sphere. Galaxies are roots: a handful of rows."""
    rows = galaxies.withColumns({"i": F.row_number().over(W.orderBy(order)) - 1, "m": F.count("*").over(W.partitionBy(F.lit(1)))})
    y = 1 - 2 * (F.col("i") + 0.5) / F.col("m")
    flat, angle = F.sqrt(1 - y * y), F.col("i") * 2.399963229728653
    return rows.select(*galaxies.columns, (radius * flat * F.cos(angle)).alias("x"), (radius * y).alias("y"), (radius * flat * F.sin(angle)).alias("z"))


def farthest_distance(leaves: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds each leaf's distance to its root: leaves (leaf, root, x, y, z), roots (root, x, y, z)."""
    r = roots.select("root", *[F.col(c).alias(f"r{c}") for c in "xyz"])
    return leaves.join(r, "root").withColumn("distance", distance3([F.col(c) for c in "xyz"], [F.col(f"r{c}") for c in "xyz"])).drop("rx", "ry", "rz")


CELL, REACH, SPREAD = 15.0, 65.0, 58.0


def scene_layout(children: DataFrame) -> DataFrame:
    """(scope, node, x, y, z, moved) of children (scope, node, role, x, y, z) around their scope's middle.

    Where all children of a scope are galaxies, and more than one, they lie evenly on a
    sphere. Else places are centred and scaled to REACH, and one after another, by name,
    a child whose cell of CELL units is taken moves to a place on a smaller sphere that
    its name chooses. A child other than the first of its cell moves in any case, as the
    first or what drove that away sits there. The first moves if an earlier child that
    has moved landed in its cell, which rounds over the cluster find until none is added.
    """
    rows = ranks(children.select(F.col("scope").alias("g"), "node", "role", "x", "y", "z"), ["node"], "i")
    about = rows.groupBy("g").agg(F.count("*").alias("n"), F.bool_and(F.col("role") == "galaxy").alias("galaxies"), *[F.avg(c).alias(f"m{c}") for c in "xyz"])
    rows = rows.join(about, "g").withColumns({f"d{c}": F.col(c) - F.col(f"m{c}") for c in "xyz"})
    far = rows.groupBy("g").agg(F.greatest(F.lit(1.0), F.max(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")))).alias("extent"))
    around = lambda z, angle, radius: {"x": F.cos(angle) * F.sqrt(1 - z * z) * radius, "y": z * radius, "z": F.sin(angle) * F.sqrt(1 - z * z) * radius}
    phase = fnv1a32(F.col("node")) / F.lit(4294967296.0) * (2 * math.pi)
    away = around((F.col("i") + 0.5) / F.col("n") * 2 - 1, phase, SPREAD)
    even = around(1 - 2 * (F.col("i") + 0.5) / F.col("n"), F.col("i") * (math.pi * (3 - math.sqrt(5))), 68.0)
    cell = lambda p: F.concat_ws(",", *[F.floor(F.col(f"{p}{c}") / CELL + 0.5).cast("string") for c in "xyz"])
    rows = rows.join(far, "g").withColumns({f"p{c}": F.col(f"d{c}") / F.col("extent") * REACH for c in "xyz"} | {f"q{c}": v for c, v in away.items()} | {f"e{c}": v for c, v in even.items()})
    rows = rows.withColumns({"sphere": F.col("galaxies") & (F.col("n") > 1), "own": cell("p"), "to": cell("q"), "crowded": (F.col("n") > 1) & (F.col("extent") <= 1)})
    rows = materialize(rows.select("g", "node", "i", "sphere", "own", "to", "crowded", *[f"{s}{c}" for s in "pqe" for c in "xyz"]))
    first = rows.filter("not sphere").groupBy("g", "own").agg(F.min("i").alias("i"))
    still = rows.filter("not sphere and not crowded").join(first, ["g", "own", "i"], "left_semi").select("g", "own", "i")
    moved = rows.filter("not sphere").join(still, ["g", "own", "i"], "left_anti").select("g", "i", "to")
    still, moved = materialize(still), materialize(moved)
    fresh = moved
    while True:
        landed = fresh.groupBy("g", F.col("to").alias("own")).agg(F.min("i").alias("least"))
        driven = still.join(landed, ["g", "own"]).filter("least < i").select("g", "i")
        fresh = materialize(rows.join(driven, ["g", "i"], "left_semi").select("g", "i", "to"))
        if fresh.isEmpty():
            break
        still = materialize(still.join(driven, ["g", "i"], "left_anti"))
        moved = moved.unionByName(fresh)
    out = rows.join(moved.select("g", "i", F.lit(True).alias("moved")), ["g", "i"], "left")
    place = [F.when(F.col("sphere"), F.col(f"e{c}")).when(F.col("moved"), F.col(f"q{c}")).otherwise(F.col(f"p{c}")).alias(c) for c in "xyz"]
    return out.select(F.col("g").alias("scope"), "node", *place, F.coalesce("moved", F.lit(False)).alias("moved"))
