"""Strong components against a plain search, and how many rounds long chains and loops take."""

import random
import sys

import pytest

from curbline.operators import components
from curbline.session import Workspace


class Rounds(Workspace):
    """Counts the tables that are written."""

    def __init__(self, spark):
        super().__init__(spark, "rounds")
        self.written = 0

    def write(self, df, name):
        self.written += 1
        return super().write(df, name)


def plain(arcs, nodes):
    ahead = {}
    for a, b in arcs:
        ahead.setdefault(a, set()).add(b)
    reach = {}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for m in ahead.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        reach[n] = seen
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


def random_graph(rng):
    n = rng.randint(4, 14)
    arcs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(3, 22))]
    for _ in range(rng.randint(0, 3)):  # long one-way stretches between them
        a, b, k = rng.randrange(n), rng.randrange(n), rng.randint(1, 6)
        line = [a, *range(100 * len(arcs), 100 * len(arcs) + k), b]
        arcs += list(zip(line, line[1:]))
    if rng.random() < 0.5:  # a ring of its own
        ring = list(range(50_000, 50_000 + rng.randint(2, 5)))
        arcs += list(zip(ring, ring[1:] + ring[:1]))
    return arcs


def test_small_graphs_by_depth_first():
    import numpy as np

    rng = random.Random(2)
    for _ in range(300):
        arcs = random_graph(rng)
        nodes = {x for a in arcs for x in a}
        found = components._loops_within(np.array([a for a, _ in arcs]), np.array([b for _, b in arcs]))
        assert dict(zip(*(x.tolist() for x in found))) == plain(arcs, nodes)


@pytest.mark.parametrize("celled", [False, True])
def test_many_graphs_at_once(spark, celled):
    rng = random.Random(5)
    arcs, want = [], {}
    for k in range(60):
        some = [(a + 1_000_000 * k, b + 1_000_000 * k) for a, b in random_graph(rng)]
        arcs += some
        want |= plain(some, {x for a in some for x in a})
    df = spark.createDataFrame(arcs, "u long, v long")
    cells = spark.createDataFrame([(n, "x", n % 40 - 20, n // 1_000_000 * 300) for n in want], "node long, set string, cx long, cy long") if celled else None
    got = components.strong_components(df, Workspace(spark, "t"), None, cells).collect()
    assert {r.node: r.comp for r in got} == want and len(got) == len(want)


def test_long_chain_and_ring_take_few_rounds(spark):
    n = 100_000
    chain = spark.range(n - 1).selectExpr("id as u", "id + 1 as v")
    ring = spark.range(n).selectExpr("id + 1000000 as u", f"(id + 7919) % {n} + 1000000 as v")
    back = spark.createDataFrame([(2_000_000, 0), (5, 2_000_000), (3_000_000, 3_000_001)], "u long, v long")
    ws = Rounds(spark)
    got = components.strong_components(chain.union(ring).union(back), ws)
    assert ws.written < 40
    sets = got.groupBy("comp").count().where("count > 1").collect()
    assert {r.comp: r["count"] for r in sets} == {0: 7, 1_000_000: n}


@pytest.mark.parametrize("hubs", [1, 3, 32])
def test_pairs_by_hubs_and_pockets(spark, hubs):
    rng = random.Random(hubs)
    n = 60
    arcs = sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(90)) if a < b} | {(a, 30) for a in range(0, 20, 3)} | {(30, b) for b in range(40, 60, 4)})
    ahead = {}
    for a, b in arcs:
        ahead.setdefault(a, []).append(b)

    def reach(a):
        seen, todo = {a}, [a]
        while todo:
            for b in ahead.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    pairs = [(a, b) for a in range(n) for b in range(n)]
    ws = Rounds(spark)
    got = components.reachable_pairs(spark.createDataFrame(pairs, "src_comp long, dst_comp long"), spark.createDataFrame(arcs, "src_comp long, dst_comp long"), ws, hubs)
    assert sorted((r.src_comp, r.dst_comp) for r in got.collect()) == sorted((a, b) for a in range(n) for b in reach(a))
    few = Rounds(spark)
    components.reachable_pairs(spark.createDataFrame(pairs[::7], "src_comp long, dst_comp long"), spark.createDataFrame(arcs, "src_comp long, dst_comp long"), few, hubs).count()
    assert abs(few.written - ws.written) <= 2


def test_a_turn_ban_parts_edges(spark):
    """Two streets that meet at one junction, where every turn from the one into the other is banned."""
    access = spark.createDataFrame([("x", e, a, b) for e, a, b in (("1f", 1, 2), ("1b", 2, 1), ("2f", 2, 3), ("2b", 3, 2))], "who string, edge_id string, from_node long, to_node long")
    nodes = spark.createDataFrame([(k, -122.4 + k / 1000, 37.7) for k in (1, 2, 3)], "node_id long, lon double, lat double")
    turns = [("x", a, b) for a, b in (("1f", "1b"), ("1b", "1f"), ("2f", "2b"), ("2b", "2f"), ("2b", "1b"))]
    got = {r.edge_id: r.comp for r in components.label_components(access, spark.createDataFrame(turns, "who string, in_edge string, out_edge string"), nodes, Workspace(spark, "t")).collect()}
    assert got["1f"] == got["1b"] != got["2f"] == got["2b"]


def test_a_round_follows_several_arcs_and_both_ways_of_hubs_share_it(spark):
    written = []

    class Counted(Workspace):
        def write(self, df, name):
            written.append(name)
            return super().write(df, name)

    dag = spark.range(12).selectExpr("id as src_comp", "id + 1 as dst_comp")  # 0 -> 1 -> ... -> 12
    index = components.hub_index(dag, Counted(spark, "hops"), 1)
    hub = index["out"].head().src
    assert sorted(r["at"] for r in index["out"].collect()) == list(range(hub, 13))
    assert sorted(r["at"] for r in index["into"].collect()) == list(range(hub + 1))
    assert sum(n.startswith("hubs-") and n != "hubs-rest" for n in written) <= 1 + 12 // components.HOPS + 1


def test_pockets_inside_a_cell_are_finished_there(spark):
    # cell 0: a ring with a blind way in and one out; a way from cell 1 through 5 and 6 and back: one set of both cells
    arcs = [(1, 2), (2, 3), (3, 1), (4, 1), (3, 7), (5, 6), (6, 101), (101, 5), (7, 8), (9, 999), (999, 9)]  # 999 lies nowhere
    nodes = sorted({n for a in arcs for n in a})
    cells = spark.createDataFrame([(n, 0, n // 100, 0) for n in nodes if n != 999], "node long, set int, cx long, cy long")
    frame = spark.createDataFrame(arcs, "u long, v long")
    found = components._in_cells(frame, cells.selectExpr("node", "struct(set, cx as x, cy as y) as cell")).collect()
    assert {r.node for r in found if r.crossed} == {5, 6, 9, 101} and {r.node: r.comp for r in found if r.node < 5} == {1: 1, 2: 1, 3: 1, 4: 4}
    written = []

    class Watched(Workspace):
        def write(self, df, name):
            written.append(name)
            return super().write(df, name)

    got = components.strong_components(frame, Watched(spark, "pockets"), None, cells)
    assert {r.node: r.comp for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 101: 5, 7: 7, 8: 8, 9: 9, 999: 9}
    assert "scc-mutual-4" in written  # only for the vertex that lies nowhere
    written.clear()
    assert components.strong_components(frame.where("u <> 999 and v <> 999"), Watched(spark, "pockets"), None, cells).count() == 9
    assert not any("mutual" in n for n in written)
