"""Shortest paths, strong components and seeded routes against brute force on random graphs."""

import heapq
import random

import numpy as np
import pytest

from roadspark.operators import endpoints as N
from roadspark.operators import graph as G
from roadspark.operators import routes as P


def graph(seed, n, m):
    draw = random.Random(seed)
    return [(f"n{draw.randrange(n)}", f"n{draw.randrange(n)}", float(draw.randrange(1, 9))) for _ in range(m)]


def costs(arcs, src):
    out, heap = {}, [(0.0, src)]
    while heap:
        d, u = heapq.heappop(heap)
        if u not in out:
            out[u] = d
            for a, b, w in arcs:
                if a == u and b not in out:
                    heapq.heappush(heap, (d + w, b))
    return out


def strong(arcs):
    ends = {x for a, b, _ in arcs for x in (a, b)}
    reach = {x: set(costs(arcs, x)) for x in ends}
    groups = {frozenset(y for y in reach[x] if x in reach[y]) for x in ends}
    return max(groups, key=lambda g: (len(g), [-ord(c) for c in min(g)])), groups


def least_path(arcs, src):
    """The least (cost, hops) of each node, and the path that ties decide backward by the least node before."""
    best = {src: (0.0, 0, "")}
    for _ in range(len({x for a, b, _ in arcs for x in (a, b)}) + 1):
        for a, b, w in arcs:
            if a in best and a != b and b != src:
                best[b] = min(best.get(b, (float("inf"), 0, "")), (best[a][0] + w, best[a][1] + 1, a))
    out = {}
    for n in best:
        path = [n]
        while path[-1] != src:
            path.append(best[path[-1]][2])
        out[n] = (best[n][0], path[::-1])
    return out


def test_paths_by_joins_and_by_search(spark):
    """Zero weights and ties everywhere: both ways give the same path."""
    draw = random.Random(2)
    arcs = [(f"n{draw.randrange(14)}", f"n{draw.randrange(14)}", float(draw.choice((0, 0, 1, 1, 2, 5)))) for _ in range(34)]
    edges = spark.createDataFrame(arcs, "src string, dst string, weight_sec double")
    od = [(k, f"n{k % 14}", f"n{k * 5 % 15}") for k in range(60)] + [(60, "nowhere", "n1"), (61, "lost", "lost")]
    table = spark.createDataFrame(od, "od_id long, src string, dst string")
    by_joins = {r.od_id: r for r in P.route_paths(edges, table, most_edges=0).collect()}
    by_search = {r.od_id: r for r in P.route_paths(edges, table).collect()}
    for k, a, b in od:
        cost, path = least_path(arcs, a).get(b, (None, []))
        assert [tuple(x[k]) for x in (by_joins, by_search)] == [(k, cost is not None, cost, path)] * 2


def test_zero_arcs_and_a_long_path(spark):
    arcs = [("a", "b", 1.0), ("b", "c", 0.0), ("c", "d", 1.0)] + [(f"p{k}", f"p{k + 1}", 0.5) for k in range(60)] + [("p0", "p60", 1000.0)]
    od = [(1, "a", "c"), (2, "a", "d"), (3, "p0", "p60"), (4, "p60", "p0")]
    got = {r.od_id: r for r in G.shortest_paths(spark.createDataFrame(arcs, "src string, dst string, weight_sec double"), spark.createDataFrame(od, "od_id long, src string, dst string"), hops=20, paths=True).collect()}
    assert (got[1].path, got[2].path, got[3].path, got[4].path) == (["a", "b", "c"], ["a", "b", "c", "d"], [f"p{k}" for k in range(61)], [])
    assert got[3].cost_sec == 30.0 and not got[4].found


@pytest.mark.parametrize("seed", [3])
def test_largest_scc(spark, seed):
    arcs = graph(seed, 15, 22)
    got = {r.node_id for r in P.largest_scc(spark.createDataFrame(arcs, "src string, dst string, w double").select("src", "dst")).collect()}
    _, groups = strong(arcs)
    most = max(map(len, groups))
    assert got == min((g for g in groups if len(g) == most), key=min)


def test_roads_both_ways_and_long_one_ways_shrink_before_any_search(spark, monkeypatch):
    """rounds of labels along arcs grew with the length of roads."""
    row = [(f"a{k:03}", f"a{k + 1:03}") for k in range(120)]
    loop = [(f"b{k:03}", f"b{(k + 1) % 90:03}") for k in range(90)]
    detour = [("a000", "c000"), *((f"c{k:03}", f"c{k + 1:03}") for k in range(40)), ("c040", "a120")]
    off = [("a005", "d000"), ("d000", "d001"), ("d001", "b007")]
    monkeypatch.setattr(P, "_reach", lambda *a: 1 / 0)
    got = P.strong_components(spark.createDataFrame(row + [(b, a) for a, b in row] + loop + detour + off, "src string, dst string")).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.component, set()).add(r.node_id)
    want = [{x for e in row + detour for x in e}, {x for e in loop for x in e}, {"d000"}, {"d001"}]
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want))


def test_largest_scc_of_nothing(spark):
    assert P.largest_scc(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_seeded_costs(spark):
    """Two points on one segment may go straight; others leave by the nodes that their directions allow."""
    edges = spark.createDataFrame([("a", "b", 10.0), ("b", "a", 10.0), ("b", "c", 5.0)], "src string, dst string, weight_sec double")
    ends = spark.createDataFrame(
        [(1, None, "a", "b", 2.0, 8.0, "both"), (2, None, "a", "b", 7.0, 3.0, "both"), (3, None, "b", "c", 1.0, 4.0, "AtoB"), (4, "c", None, None, None, None, None), (5, None, "b", "x", 1.0, 1.0, "both")],
        "point_id long, node_id string, node_a string, node_b string, to_a_sec double, to_b_sec double, directions string",
    )
    od = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 3, 4), (4, 3, 1), (5, 5, 1)], "od_id long, start_id long, end_id long")
    got = {r.od_id: r.cost_sec for r in N.seeded_costs(edges, od, ends).collect()}
    assert got == {1: 5.0, 2: 9.0, 3: 4.0, 4: None, 5: None}


def test_a_limit_of_costs_by_joins_and_by_search(spark):
    draw = random.Random(5)
    edges = spark.createDataFrame([(f"n{draw.randrange(14)}", f"n{draw.randrange(14)}", float(draw.choice((0, 1, 1, 2, 5)))) for _ in range(40)], "src string, dst string, weight_sec double")
    od = [(f"v{k}", f"n{k % 14}", f"n{k * 5 % 15}", draw.choice((None, 0.0, 1.0, 2.0, 3.5))) for k in range(120)]
    table = spark.createDataFrame(od, "od_id string, src string, dst string, most_sec double")
    by_joins, by_search = (sorted(tuple(r) for r in P.route_paths(edges, table, most_edges=n).select("od_id", "found", "cost_sec", "path").collect()) for n in (0, P.MOST_EDGES))
    assert by_joins == by_search and 0 < sum(r[1] for r in by_search) < 120


def _graph(arcs, n):
    a, b, w = (np.array(x) for x in zip(*arcs, strict=True))

    def listed(at, far):
        order = np.lexsort((far, at))
        return np.searchsorted(at[order], np.arange(n + 1)).astype(np.int32), far[order].astype(np.int32), w[order].astype(float)

    return P._Graph(*listed(a, b), *listed(b, a))


@pytest.mark.parametrize("weights", [(0.0, 1.0, 1.0, 2.0), (0.1, 0.2, 0.3, 0.7)])
def test_origins_searched_for_together(weights):
    """Each origin's rows were searched for by themselves."""
    rng, n = np.random.default_rng(8), 150
    arcs = {(int(a), int(b)): weights[int(k)] for a, b, k in zip(rng.integers(0, n, 420), rng.integers(0, n - 5, 420), rng.integers(0, 4, 420), strict=True) if a != b}
    arcs |= {(k, k + 1): weights[k % 4] for k in range(0, 60)}
    graph = _graph([(a, b, w) for (a, b), w in arcs.items()], n)
    origins = np.arange(20, 50)
    rows = [(s, t) for s in origins.tolist() for t in range(0, n, 7) if s != t]
    together = P._Searches(graph, origins)
    cost, begins, flat = together.routes(np.array([s - 20 for s, _ in rows]), np.array([t for _, t in rows]))
    alone = {s: P._Search(graph, s) for s in origins.tolist()}
    for k, (s, t) in enumerate(rows):
        want, path = alone[s].route(t, None)
        assert flat[begins[k] : begins[k + 1]].tolist() == path and (cost[k] == want if path else np.isinf(cost[k]))
    assert any(begins[1:] == begins[:-1]) and any(np.diff(begins) > 4)


def test_origins_are_grouped_with_their_neighbours():
    wide, deep = 20, 40
    arcs = [(r * wide + c, x * wide + y, 1.0) for r in range(deep) for c in range(wide) for x, y in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)) if 0 <= x < deep and 0 <= y < wide]
    n = wide * deep
    graph = _graph(arcs, n)
    dealt, group, split = P._dealt(graph, np.arange(n), np.full(n, 3 * P.ROWS_A_SEARCH // n))
    assert len(dealt) == n + len(split) + 1 and sorted(dealt[:n].tolist()) == list(range(n)) and len(split) <= 3 * n // P.TOGETHER
    for k in range(len(split)):
        own = np.flatnonzero(group == k)
        assert sorted(dealt[dealt[n + k] : dealt[n + k + 1]].tolist()) == own.tolist() and len(own) <= 2 * P.TOGETHER
        assert np.ptp(own // wide) <= 30
    assert max(P._dealt(graph, np.array([5]), np.array([4 * P.ROWS_A_SEARCH]))[2]) == 5


def test_routes_of_a_large_graph_are_not_searched_by_joins():
    """A graph of 3,400,000 edges was beyond the bound; what goes to the workers is numbers, and each node's id once."""
    assert P.MOST_EDGES >= 3_500_000
    graph = _graph([(k, k + 1, 1.0) for k in range(1000)], 1001)
    assert sum(x.nbytes for x in graph) <= 28 * 1000 + 4 * 1001 * 2
