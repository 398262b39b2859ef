"""Fixpoints over edge tables: components, street speeds, reachability.

Every round writes its result and reads it back, so plans stay small and a
lost executor re-reads a table. Rounds are few: what lies in one map tile is
solved there first, all tiles at once; components then hook and jump
(logarithmic), and strong components contract two-way streets, then chains by
pointer doubling, before they spread anything along arcs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..session import Workspace, ship
from .spatial import dealt

CELL_DEG = 0.02  # side of the tiles that are solved by themselves, about two kilometres
HELD = 500_000  # links that a task contracts at once
HUBS = 32  # of a component graph, whose reach is known in full
CELL_BITS = 4  # a cell of the next level is sixteen times as wide
CELL_LEVELS = 4  # up to 82 degrees
HOPS = 3  # arcs that a round follows: a round costs more than a join
LAYERS = 2  # ends cut off one after the other before chains are sought again


def connected_components(links: DataFrame, ws: Workspace, label: str = "cc") -> DataFrame:
    """(node, comp) for links (u, v); comp is the smallest node of the set.

    Each vertex keeps a parent. A round looks at the grandparents across
    every link, hooks the vertex and its parent to the smallest, and jumps.
    """
    both = ws.write(links.select("u", "v").union(links.select("v", "u")).distinct(), f"{label}-links")
    start = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near"))
    tree = start.select("node", F.least("node", "near").alias("parent")).withColumn("grand", F.col("parent"))
    done = 0
    while True:
        seen = both.join(dealt(tree.select(F.col("node").alias("v"), "grand")), "v").groupBy(F.col("u").alias("node")).agg(F.min("grand").alias("low"))
        state = ws.write(tree.join(dealt(seen), "node"), f"{label}-{done}")
        if done:
            ws.drop(f"{label}-{done - 1}")
        if state.where("low < grand or parent <> grand").isEmpty():
            return state.select("node", F.col("grand").alias("comp"))
        hooks = state.select(F.explode(F.array(
            F.struct(F.col("parent").alias("node"), F.least("low", "grand").alias("to")),
            F.struct(F.col("node").alias("node"), F.least("low", "grand", "parent").alias("to")),
        )).alias("h")).select("h.*")
        parents = hooks.groupBy("node").agg(F.min("to").alias("parent"))
        tree = parents.join(parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand")), "parent")
        done += 1


def _stars(links: DataFrame) -> DataFrame:
    """(u, v): as few links as connect the same sets within each task. A task works on HELD links at a time."""
    ship()

    def contract(frames):
        held, count = [], 0

        def out():
            names, at = np.unique(np.concatenate([f[c].to_numpy() for c in ("u", "v") for f in held]), return_inverse=True)
            a, b, root = at[:count], at[count:], np.arange(len(names))
            while (root[a] != root[b]).any():
                low = np.minimum(root[a], root[b])
                np.minimum.at(root, root[a], low)
                np.minimum.at(root, root[b], low)
                while (root[root] != root).any():
                    root = root[root]
            return pd.DataFrame({"u": names, "v": names[root]})

        for frame in frames:
            held.append(frame)
            count += len(frame)
            if count >= HELD:
                yield out()
                held, count = [], 0
        if count:
            yield out()

    return links.select("u", "v").mapInPandas(contract, links.select("u", "v").schema)


def street_speeds(segments: DataFrame, ws: Workspace) -> DataFrame:
    """(seg_id, inferred): limits for unposted blocks, from posted blocks of
    the same name and class they connect to through unposted ones; the
    highest wins. Written as components of unposted blocks, so the number of
    rounds does not grow with the length of a street."""
    ends = segments.where("coalesce(name, '') <> ''").select("seg_id", "name", "class", "speed", F.explode("conns.connector_id").alias("at")).distinct()
    meets = ws.write(ends.groupBy("name", "class", "at").agg(
        F.min(F.when(F.col("speed").isNull(), F.col("seg_id"))).alias("head"), F.max("speed").alias("posted")).where("head is not null"), "street-meets")
    open_ends = ends.where("speed is null").join(dealt(meets), ["name", "class", "at"]).select("seg_id", "head", "posted", "name", "class")
    open_ends = ws.write(open_ends, "street-ends")
    # dealt by street, so that most are whole in one task; a street of very many blocks is split
    links = open_ends.select(F.col("seg_id").alias("u"), F.col("head").alias("v"), "name", "class").hint("rebalance", "name", "class")
    comps = connected_components(_stars(links), ws, "street")
    member = open_ends.select(F.col("seg_id").alias("node"), "posted").join(dealt(comps), "node")
    best = member.groupBy("comp").agg(F.max("posted").alias("inferred")).where("inferred is not null")
    return comps.join(dealt(best), "comp").select(F.col("node").alias("seg_id"), "inferred")


def _contracted(arcs: DataFrame, merged: DataFrame) -> DataFrame:
    """Arcs between the sets their ends were merged into, without loops."""
    a = merged.select(F.col("node").alias("u"), F.col("comp").alias("cu"))
    b = merged.select(F.col("node").alias("v"), F.col("comp").alias("cv"))
    return (
        arcs.join(dealt(a), "u", "left").join(dealt(b), "v", "left")
        .select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).where("u <> v").distinct()
    )


def strong_components(arcs: DataFrame, ws: Workspace, vertices: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """(node, comp) for directed arcs (u, v); comp is the smallest member.

    cells: (node, set, cx, cy), where nodes lie: arcs within a cell are solved there first, all
    cells at once, and what they contract to again in cells 16 times as wide, CELL_LEVELS
    times or until no arc is left. What no arc from outside leads through a cell is
    finished there, so that a cell holds ways from border to border only. Then, over and over: mutual arcs are merged by
    connected_components; chains of vertices with one way in and one way out become one
    arc each (a ring of them is a component); vertices without a way in or out are
    finished; and if none of that changes anything, loops are split by spreading the
    largest name forward from all vertices and sweeping back from its owners.
    """
    vertices = vertices if vertices is not None else arcs.select("u").union(arcs.select("v")).distinct()
    vertices = vertices.toDF("node")
    part = ws.write(vertices.withColumn("comp", F.col("node")), "scc-part-0")
    live = ws.write(arcs.where("u <> v").select("u", "v").distinct(), "scc-arcs-0")
    step, links = 0, []

    def merge(sets: DataFrame) -> None:
        """Rename current sets (node -> comp), in the partition and the arcs."""
        nonlocal part, live, step
        step += 1
        names = sets.select(F.col("node").alias("comp"), F.col("comp").alias("into"))
        part = ws.write(part.join(dealt(names), "comp", "left").select("node", F.coalesce("into", "comp").alias("comp")), f"scc-part-{step}")
        live = ws.write(_contracted(live, sets), f"scc-arcs-{step}")

    for k in range(CELL_LEVELS if cells is not None else 0):
        at = cells.select("node", F.struct("set", F.shiftright("cx", CELL_BITS * k).alias("x"), F.shiftright("cy", CELL_BITS * k).alias("y")).alias("cell"))
        found = ws.write(_in_cells(live, at), f"scc-cells-{k}")
        over = found.where("not crossed").select(F.col("node").alias("u"))
        live = live.join(dealt(over), "u", "left_anti").join(dealt(over.withColumnRenamed("u", "v")), "v", "left_anti").select("u", "v")
        merge(found.where("node <> comp").select("node", "comp"))
        if live.isEmpty():  # every component was whole in its cell
            return _least(part)
    while True:
        mutual = live.join(live.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_semi").where("u < v")
        mutual = ws.write(mutual, f"scc-mutual-{step}")
        if not mutual.isEmpty():
            merge(connected_components(mutual, ws, f"scc-cc-{step}"))
            continue
        chains = _chains(live, ws, f"scc-chain-{step}")
        if chains is not None:
            ring = chains.where("ring").select("node", F.col("low").alias("comp"))
            inner = chains.where("not ring").select("node", "head", "tail")
            links.append(inner)
            gone = inner.select(F.col("node").alias("u"))
            rest = live.join(gone, "u", "left_anti").join(gone.withColumnRenamed("u", "v"), "v", "left_anti").select("u", "v")
            step += 1
            live = ws.write(rest.unionByName(inner.select(F.col("head").alias("u"), F.col("tail").alias("v")).where("u <> v")).distinct(), f"scc-arcs-{step}")
            if not ring.isEmpty():
                merge(ring)
        size, trimmed = live.count(), False
        for _ in range(LAYERS):
            through = live.select(F.col("u").alias("n")).intersect(live.select(F.col("v").alias("n")))
            kept = live.join(through.select(F.col("n").alias("u")), "u", "left_semi").join(through.select(F.col("n").alias("v")), "v", "left_semi").select("u", "v")
            step += 1
            live = ws.write(kept, f"scc-arcs-{step}")
            was, size = size, live.count()
            if size == was:
                break
            trimmed = True
        if not size:
            break
        if not trimmed and chains is None:
            merge(_one_way_loops(live, ws, f"scc-loop-{step}"))
    for k, inner in enumerate(reversed(links)):
        # a chain belongs to a component if both its ends do
        of = lambda c: part.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
        closed = inner.join(of("head"), "head").join(of("tail"), "tail").where("head_comp = tail_comp").select(F.col("node").alias("comp"), F.col("head_comp").alias("into"))
        part = ws.write(part.join(closed, "comp", "left").select("node", F.coalesce("into", "comp").alias("comp")), f"scc-closed-{k}")
    return _least(part)


def _least(part: DataFrame) -> DataFrame:
    """Sets by their smallest member."""
    least = part.groupBy("comp").agg(F.min("node").alias("least"))
    return part.join(dealt(least), "comp").select("node", F.col("least").alias("comp"))


def _loops_within(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of a small graph and the least vertex of the strong set of each: depth first, sets closed on the way back."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    n, ahead = len(names), [[] for _ in range(len(names))]
    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        ahead[a].append(b)
    seen, low, closed, comp, stack, count = [-1] * n, [0] * n, [False] * n, list(range(n)), [], 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        path = [(root, 0)]
        while path:
            x, i = path.pop()
            if i == 0:
                seen[x] = low[x] = count
                count += 1
                stack.append(x)
            elif seen[ahead[x][i - 1]] >= 0 and not closed[ahead[x][i - 1]]:
                low[x] = min(low[x], low[ahead[x][i - 1]])
            if i < len(ahead[x]):
                path.append((x, i + 1))
                if seen[ahead[x][i]] < 0:
                    path.append((ahead[x][i], 0))
                continue
            if low[x] == seen[x]:
                members = []
                while not members or members[-1] != x:
                    members.append(stack.pop())
                least = min(members)
                for m in members:
                    closed[m], comp[m] = True, least
    return names, names[np.array(comp, np.int64)] if n else names


def _reached(frm: np.ndarray, to: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The vertices that arcs lead to from those marked, themselves included."""
    ahead: dict = {}
    for a, b in zip(frm.tolist(), to.tolist()):
        ahead.setdefault(a, []).append(b)
    seen = seen.copy()
    line = np.flatnonzero(seen).tolist()
    while line:
        for y in ahead.get(line.pop(), ()):
            if not seen[y]:
                seen[y] = True
                line.append(y)
    return seen


def _in_cells(arcs: DataFrame, cells: DataFrame) -> DataFrame:
    """(node, comp, crossed): the strong sets of the arcs that stay within a cell, and whether a
    way from another cell leads by the node and on to another cell: only such a set can grow."""
    ship()
    at = lambda c: dealt(cells.select(F.col("node").alias(c), F.col("cell").alias(f"{c}_cell")))
    placed = arcs.join(at("u"), "u", "left").join(at("v"), "v", "left")  # a vertex without a place is in no cell
    apart = ~F.coalesce(F.col("u_cell") == F.col("v_cell"), F.lit(False))
    ends = F.when(apart, F.array(F.struct(F.col("u_cell").alias("cell"), "u", F.lit(None).cast(arcs.schema["v"].dataType).alias("v")), F.struct(F.col("v_cell").alias("cell"), F.lit(None).cast(arcs.schema["u"].dataType).alias("u"), "v")))
    rows = placed.select(F.explode(F.coalesce(ends, F.array(F.struct(F.col("u_cell").alias("cell"), "u", "v")))).alias("e")).select("e.*").where("cell is not null")
    rows = rows.select("cell", F.coalesce("u", "v").alias("u"), F.coalesce("v", "u").alias("v"), F.col("v").isNull().alias("leaves"), F.col("u").isNull().alias("enters"))
    kind = arcs.schema["u"].dataType.simpleString()

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        u, v = rows["u"].to_numpy(), rows["v"].to_numpy()
        node, comp = _loops_within(u, v)
        a, b = np.searchsorted(node, comp[np.searchsorted(node, u)]), np.searchsorted(node, comp[np.searchsorted(node, v)])
        come, go = np.zeros(len(node), bool), np.zeros(len(node), bool)
        come[b[rows["enters"].to_numpy(bool)]] = True
        go[a[rows["leaves"].to_numpy(bool)]] = True
        crossed = _reached(a, b, come) & _reached(b, a, go)
        return pd.DataFrame({"node": node, "comp": comp, "crossed": crossed[np.searchsorted(node, comp)]})

    return rows.groupBy("cell").applyInPandas(solve, f"node {kind}, comp {kind}, crossed boolean")


def _chains(arcs: DataFrame, ws: Workspace, label: str) -> DataFrame | None:
    """(node, ring, head, tail, low) of vertices with one arc in and one out: the first other vertex behind and ahead, or, in
    a ring of such vertices, the least of them. None if there are none. Pointers double each round, both ways."""
    out = arcs.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n_out"), F.min("v").alias("tail"))
    into = arcs.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("n_in"), F.min("u").alias("head"))
    mid = ws.write(out.join(into, "node").where("n_out = 1 and n_in = 1").select("node", "head", "tail"), f"{label}-mid")
    if mid.isEmpty():
        return None
    known = lambda c: mid.select(F.col("node").alias(c), F.lit(True).alias(f"{c}_open"))
    state = mid.join(known("head"), "head", "left").join(known("tail"), "tail", "left").select(
        "node", "head", "tail", F.coalesce("head_open", F.lit(False)).alias("head_open"), F.coalesce("tail_open", F.lit(False)).alias("tail_open"), F.col("node").alias("low"), F.lit(True).alias("changed"))
    state = ws.write(state, f"{label}-0")
    done = 0
    # a chain's ends are found at last; a ring has none, and its least vertex is known to all when nothing changes
    while (s := state.agg(F.max(F.col("head_open") | F.col("tail_open")), F.max("changed")).head())[0] and s[1]:
        back = state.select(F.col("node").alias("head"), F.col("head").alias("head2"), F.col("head_open").alias("head_open2"))
        on = state.select(F.col("node").alias("tail"), F.col("tail").alias("tail2"), F.col("tail_open").alias("tail_open2"), F.col("low").alias("low2"))
        met = state.drop("changed").join(back, "head", "left").join(on, "tail", "left")
        further = {c: F.when(F.col(f"{side}_open"), F.col(f"{c}2")).otherwise(F.col(c) if c == side else F.lit(False)) for side in ("head", "tail") for c in (side, f"{side}_open")}
        low = F.when(F.col("tail_open"), F.least("low", "low2")).otherwise(F.col("low"))
        changed = (low < F.col("low")) | (further["head_open"] != F.col("head_open")) | (further["tail_open"] != F.col("tail_open"))
        done += 1
        state = ws.write(met.select("node", *(e.alias(c) for c, e in further.items()), low.alias("low"), changed.alias("changed")), f"{label}-{done}")
    return state.select("node", F.col("tail_open").alias("ring"), "head", "tail", "low")


def class_components(edges: DataFrame, access: DataFrame | None, nodes: DataFrame, ws: Workspace) -> DataFrame:
    """(who, node, comp): strong components of the whole network (who = any)
    and, if access is given, of each routing class, found in one run over (who, node) vertices.
    The vertices are numbered first (written, so the numbers stay): the rounds
    then join and compare plain integers. comp is the smallest node of a set.
    """
    arcs = edges.select(F.lit("any").alias("who"), "from_node", "to_node")
    arcs = arcs if access is None else access.select("who", "from_node", "to_node").unionByName(arcs)
    arcs = ws.write(arcs.distinct(), "class-arcs")
    seen = arcs.select("who", F.col("from_node").alias("node")).union(arcs.select("who", "to_node")).union(nodes.select(F.lit("any"), "node_id"))
    ids = ws.write(seen.distinct().withColumn("id", F.monotonically_increasing_id()), "class-vertices")
    side = F.lit(CELL_DEG)
    where = nodes.select(F.col("node_id").alias("node"), F.floor(F.col("lon") / side).alias("cx"), F.floor(F.col("lat") / side).alias("cy"))
    cells = ids.join(where, "node").select(F.col("id").alias("node"), F.col("who").alias("set"), "cx", "cy")
    numbered = (
        arcs.join(dealt(ids.select("who", F.col("node").alias("from_node"), F.col("id").alias("u"))), ["who", "from_node"])
        .join(dealt(ids.select("who", F.col("node").alias("to_node"), F.col("id").alias("v"))), ["who", "to_node"]).select("u", "v")
    )
    found = strong_components(numbered, ws, ids.select("id"), cells)
    member = ids.join(dealt(found.withColumnRenamed("node", "id")), "id")
    names = member.groupBy("comp").agg(F.min("node").alias("least"))
    return member.join(dealt(names), "comp").select("who", "node", F.col("least").alias("comp"))


def _one_way_loops(arcs: DataFrame, ws: Workspace, label: str) -> DataFrame:
    """(node, comp) for the strong sets owned by a colour root: a forward pass
    gives each vertex the largest vertex that reaches it, and the vertices
    that reach their own colour's owner form its set."""
    vertices = arcs.select(F.col("u").alias("node")).union(arcs.select(F.col("v").alias("node"))).distinct()
    colour = ws.write(vertices.withColumn("colour", F.col("node")), f"{label}-fwd-0")
    done = 0
    while True:
        done += 1
        pushed = arcs.join(colour.select(F.col("node").alias("u"), "colour"), "u").select(F.col("v").alias("node"), "colour")
        both = colour.select("node", "colour", F.col("colour").alias("was")).unionByName(pushed.withColumn("was", F.lit(None).cast(colour.schema["colour"].dataType)))
        nxt = ws.write(both.groupBy("node").agg(F.max("colour").alias("colour"), F.max("was").alias("was")), f"{label}-fwd-{done}")
        colour = nxt.select("node", "colour")
        if nxt.where("colour <> was").isEmpty():
            break
    same = arcs.join(colour.select(F.col("node").alias("u"), F.col("colour").alias("cu")), "u").join(
        colour.select(F.col("node").alias("v"), F.col("colour").alias("cv")), "v").where("cu = cv").select("u", "v", F.col("cu").alias("colour"))
    same = ws.write(same, f"{label}-same")
    swept = ws.write(colour.where("node = colour").withColumn("fresh", F.lit(True)), f"{label}-bwd-0")
    done = 0
    while True:
        done += 1
        back = same.join(swept.where("fresh").select(F.col("node").alias("v"), "colour"), ["v", "colour"]).select(F.col("u").alias("node"), "colour").distinct()
        both = swept.select("node", "colour", F.lit(1).alias("old")).unionByName(back.withColumn("old", F.lit(0)))
        swept = ws.write(both.groupBy("node", "colour").agg((F.max("old") == 0).alias("fresh")), f"{label}-bwd-{done}")
        if swept.where("fresh").isEmpty():
            break
    low = swept.groupBy("colour").agg(F.min("node").alias("comp"))
    return swept.join(low, "colour").select("node", "comp")


def component_arcs(arcs: DataFrame, comps: DataFrame) -> DataFrame:
    """Distinct arcs between strong components."""
    return _contracted(arcs, comps).select(F.col("u").alias("src_comp"), F.col("v").alias("dst_comp"))


def label_components(access: DataFrame, turns: DataFrame, nodes: DataFrame, ws: Workspace) -> DataFrame:
    """(who, edge_id, comp): strong components of the edges a class may ride, joined by the turns it may make; comp is a number.

    Unlike those of junctions they know of turn bans: what no component leads to cannot be ridden to.
    """
    side = F.lit(CELL_DEG)
    where = nodes.select(F.col("node_id").alias("to_node"), F.floor(F.col("lon") / side).alias("cx"), F.floor(F.col("lat") / side).alias("cy"))
    ids = access.select("who", "edge_id", "to_node").join(where, "to_node").withColumn("id", F.monotonically_increasing_id())
    ids = ws.write(ids.select("who", "edge_id", "id", "cx", "cy"), "label-vertices")
    of = lambda edge, name: ids.select("who", F.col("edge_id").alias(edge), F.col("id").alias(name))
    arcs = turns.select("who", "in_edge", "out_edge").join(dealt(of("in_edge", "u")), ["who", "in_edge"]).join(dealt(of("out_edge", "v")), ["who", "out_edge"]).select("u", "v")
    found = strong_components(arcs, ws, ids.select("id"), ids.select(F.col("id").alias("node"), F.col("who").alias("set"), "cx", "cy"))
    return ids.join(dealt(found.withColumnRenamed("node", "id")), "id").select("who", "edge_id", "comp")


def _spread(begin: DataFrame, arcs: DataFrame, ws: Workspace, label: str) -> DataFrame:
    """(src, at): all that arcs (at, next) lead to from begin (src, at), itself included. A round is HOPS arcs, for all at once."""
    key = [c for c in begin.columns if c in arcs.columns and c != "at"]  # arcs of several kinds, each followed by itself
    seen = ws.write(begin.select(*key, "src", "at", F.lit(True).alias("fresh")).distinct(), f"{label}-0")
    arcs, done = dealt(arcs), 0
    while not seen.where("fresh").isEmpty():
        front, both = seen.where("fresh").drop("fresh"), seen.select(*key, "src", "at", F.lit(0).alias("hop"))
        for hop in range(1, HOPS + 1):
            front = front.join(arcs, [*key, "at"]).select(*key, "src", F.col("next").alias("at")).distinct()
            both = both.unionByName(front.withColumn("hop", F.lit(hop)))
        done += 1
        # what was met before the last hop has been followed already
        seen = ws.write(both.groupBy(*key, "src", "at").agg((F.min("hop") == HOPS).alias("fresh")), f"{label}-{done}")
    return seen.select(*key, "src", "at")


def hub_index(dag: DataFrame, ws: Workspace, hubs: int = HUBS) -> dict[str, DataFrame]:
    """An index of a component graph (src_comp, dst_comp): what leads to each of its hubs (`into`), what they lead to
    (`out`), and the arcs between other components (`rest`).

    Hubs are the components with most arcs; in a street network the large one is
    among them, and what is left are pockets. The sets of all hubs grow together.
    """
    ends = dag.select(F.explode(F.array("src_comp", "dst_comp")).alias("hub")).groupBy("hub").agg(F.count("*").alias("n"))
    top = ws.write(ends.orderBy(F.desc("n"), "hub").limit(hubs).select("hub"), "hubs")
    # both ways in the same rounds
    begin = top.select(F.explode(F.array(F.lit(True), F.lit(False))).alias("out"), F.col("hub").alias("src"), F.col("hub").alias("at"))
    ways = dag.select(F.explode(F.array(
        F.struct(F.lit(True).alias("out"), F.col("src_comp").alias("at"), F.col("dst_comp").alias("next")),
        F.struct(F.lit(False).alias("out"), F.col("dst_comp").alias("at"), F.col("src_comp").alias("next")))).alias("w")).select("w.*")
    both = _spread(begin, ways, ws, "hubs")
    out, into = both.where("out").drop("out"), both.where("not out").drop("out")
    none = lambda c: top.select(F.col("hub").alias(c))
    rest = dag.join(none("src_comp"), "src_comp", "left_anti").join(none("dst_comp"), "dst_comp", "left_anti")
    return {"out": out, "into": into, "rest": ws.write(rest.select("src_comp", "dst_comp"), "hubs-rest")}


def reachable_pairs(pairs: DataFrame, dag: DataFrame, ws: Workspace, hubs: int = HUBS, index: dict[str, DataFrame] | None = None) -> DataFrame:
    """The (src_comp, dst_comp) pairs of `pairs` with a way from one to the other.

    A way meets a hub, which two joins with the hubs' sets tell, or stays among the
    other components, where frontiers grow from the sources that are left. The
    rounds follow from the graph, not from the pairs; a pocket's frontier is a pocket.
    index: the hub_index of `dag`, if it is there already.
    """
    want = ws.write(pairs.select("src_comp", "dst_comp").distinct(), "reach-want")
    same = want.where("src_comp = dst_comp")
    apart = want.where("src_comp <> dst_comp")
    if apart.isEmpty():
        return same
    index = index or hub_index(dag, ws, hubs)
    into = index["into"].select(F.col("at").alias("src_comp"), F.col("src").alias("hub"))
    out = index["out"].select(F.col("at").alias("dst_comp"), F.col("src").alias("hub"))
    by_hub = apart.join(into, "src_comp").join(out, ["dst_comp", "hub"]).select("src_comp", "dst_comp").distinct()
    by_hub = ws.write(by_hub, "reach-by-hub")
    left = ws.write(apart.join(by_hub, ["src_comp", "dst_comp"], "left_anti"), "reach-left")
    if left.isEmpty():
        return same.unionByName(by_hub)
    arcs = index["rest"].select(F.col("src_comp").alias("at"), F.col("dst_comp").alias("next"))
    begin = left.select("src_comp").distinct().join(index["rest"].select("src_comp").distinct(), "src_comp", "left_semi")
    seen = _spread(begin.select(F.col("src_comp").alias("src"), F.col("src_comp").alias("at")), arcs, ws, "reach")
    met = left.join(seen.select(F.col("src").alias("src_comp"), F.col("at").alias("dst_comp")), ["src_comp", "dst_comp"], "left_semi")
    return same.unionByName(by_hub).unionByName(met)


def _joined_in_cells(access: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """(who, forward, node) of junctions whose own map cell shows that they are joined: from a strong set of more than `limit` others a way leads
    to them, or back. What needs more than a cell, and what lies nowhere, is left out."""
    ship()
    side = F.lit(CELL_DEG)
    where = nodes.select(F.col("node_id").alias("node"), F.struct(F.floor(F.col("lon") / side).alias("x"), F.floor(F.col("lat") / side).alias("y")).alias("cell")).distinct()
    at = lambda c: dealt(where.select(F.col("node").alias(c), F.col("cell").alias(f"{c}_cell")))
    arcs = access.where("from_node <> to_node").groupBy(F.col("from_node").alias("u"), F.col("to_node").alias("v")).agg(F.collect_set("who").alias("all"))
    rows = arcs.join(at("u"), "u").join(at("v"), "v").where("u_cell = v_cell").select(F.explode("all").alias("who"), F.col("u_cell").alias("cell"), "u", "v")
    kind = arcs.schema["u"].dataType.simpleString()

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        u, v = rows["u"].to_numpy(), rows["v"].to_numpy()
        node, comp = _loops_within(u, v)
        _, at, n = np.unique(comp, return_inverse=True, return_counts=True)
        large = n[at] > limit + 1
        a, b = np.searchsorted(node, u), np.searchsorted(node, v)
        sides = [(True, _reached(b, a, large)), (False, _reached(a, b, large))]
        return pd.concat([pd.DataFrame({"who": rows["who"].iat[0], "forward": f, "node": node[yes]}) for f, yes in sides])

    return rows.groupBy("who", "cell").applyInPandas(solve, f"who string, forward boolean, node {kind}").distinct()


def joined_nodes(access: DataFrame, ws: Workspace, limit: int = params.POCKET_NODES, comps: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(who, forward, node) of every junction from which (or, backward, to
    which) `who` can ride more than `limit` others.

    comps (who, node, comp): strong components, or nodes (node_id, lon, lat): where junctions lie, settle at once
    what is in, or near by, a large one. A junction with an arc to such a one is joined too. Each other junction holds a set of junctions it reaches, cut off once the answer
    is yes, so a row stays a few dozen ids. A round joins the sets of a set's
    members, which doubles the distance covered; and a junction that reaches
    a joined one is joined, for it reaches at least as many. Junctions that
    are settled drop out, so only pockets live past the third round.
    """
    out = access.select("who", F.lit(True).alias("forward"), F.col("from_node").alias("node"), F.col("to_node").alias("next"))
    into = access.select("who", F.lit(False).alias("forward"), F.col("to_node").alias("node"), F.col("from_node").alias("next"))
    key = ["who", "forward", "node"]
    need = limit + 2
    hops = out.unionByName(into).where("node <> next")
    settled = None
    if nodes is not None:
        settled = ws.write(_joined_in_cells(access, nodes, limit), "joined-settled")
    elif comps is not None:
        large = comps.groupBy("who", "comp").agg(F.count("*").alias("n")).where(F.col("n") > limit + 1)
        one = comps.join(dealt(large), ["who", "comp"], "left_semi").select("who", "node")
        settled = ws.write(one.select("who", F.lit(True).alias("forward"), "node").unionByName(one.select("who", F.lit(False).alias("forward"), "node")), "joined-settled")
    if settled is None:
        beside = hops.limit(0).select(*key)
        every = hops.distinct()
    else:
        every = ws.write(hops.join(dealt(settled), key, "left_anti").distinct(), "joined-hops")
        # what leads to a settled one is settled: the rounds are left with ways among the others
        beside = ws.write(every.join(dealt(settled.withColumnRenamed("node", "next")), ["who", "forward", "next"], "left_semi").select(*key).distinct(), "joined-beside")
    hops = every.join(beside, key, "left_anti")
    few = hops.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("next"))).where(F.col("nth") <= need)
    sets = few.groupBy(*key).agg(F.collect_set("next").alias("seen"))
    # the other ends of edges may have no way on themselves
    bare = hops.select("who", "forward", F.col("next").alias("node")).distinct().join(every.select(*key).distinct(), key, "left_anti")
    sets = sets.select(*key, F.array_union(F.array("node"), "seen").alias("seen")).unionByName(bare.select(*key, F.array("node").alias("seen")))
    state = sets.withColumn("joined", F.size("seen") > limit + 1).withColumn("grew", F.lit(True))
    state = state.unionByName(beside.select(*key, F.array("node").alias("seen"), F.lit(True).alias("joined"), F.lit(True).alias("grew")))
    state = ws.write(state, "joined-0")
    done = 0
    while True:
        live = state.where("not joined and grew")
        if live.isEmpty():
            found = state.where("joined").select(*key)
            return found if settled is None else found.unionByName(settled.select(*key))
        member = live.select(*key, F.explode("seen").alias("m")).where("m <> node")
        other = state.select("who", "forward", F.col("node").alias("m"), F.when(~F.col("joined"), F.col("seen")).alias("more"), F.col("joined").alias("yes"))
        met = member.join(dealt(other), ["who", "forward", "m"])
        wider = met.groupBy(*key).agg(F.max("yes").alias("yes"), F.array_distinct(F.flatten(F.collect_list("more"))).alias("more"))
        nxt = state.join(wider, key, "left").select(
            *key, F.when(F.col("joined") | F.coalesce("yes", F.lit(False)), F.array("node")).otherwise(F.array_union("seen", F.coalesce("more", F.slice("seen", 1, 0)))).alias("all"),
            (F.col("joined") | F.coalesce("yes", F.lit(False))).alias("was"), F.size("seen").alias("n"))
        done += 1
        state = ws.write(nxt.select(*key, F.slice("all", 1, need).alias("seen"), (F.col("was") | (F.size("all") > limit + 1)).alias("joined"), (F.size("all") > F.col("n")).alias("grew")), f"joined-{done}")
