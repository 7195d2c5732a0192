"""List ranking, the merging of ways against a sequential merge on random chains, rings and groups, and joined nodes."""

import random

from roadspark.operators.chains import merge_through_ways, rank_lists, remap_phases
from roadspark.operators.joins import join_nodes, ungroup


def test_rank_lists(spark):
    links = [(f"a{k:04}", f"a{k + 1:04}" if k < 999 else None, f"m{k}") for k in range(1000)] + [(f"r{k}", f"r{(k + 1) % 7}", f"x{9 - k}") for k in range(7)] + [("one", None, None)]
    ranked, rings = rank_lists(spark.createDataFrame(links, "state string, succ string, mark string"))
    got = {r.state: (r.last, r.hops) for r in ranked.collect()}
    assert got == {f"a{k:04}": ("a0999", 999 - k) for k in range(1000)} | {"one": ("one", 0)}
    assert {(r.state, r.mark) for r in rings.collect()} == {(f"r{k}", "x3") for k in range(7)}


def merged_by_hand(ways, kept, group):
    """Joints are removed one after the other; the least way of two stays and keeps its direction; a ring's least joint stays."""
    ways = {w: list(n) for w, n in ways.items()}
    unit = lambda n: group.get(n, n)
    loops = {w for w, n in ways.items() if n[0] == n[-1]}

    def ends():
        at = {}
        for w, nodes in ways.items():
            for k, n in enumerate(nodes):
                at.setdefault(unit(n), []).append((w, k in (0, len(nodes) - 1)))
        return at

    joints = sorted(u for u, uses in ends().items() if u not in kept and len(uses) == 2 and len({w for w, _ in uses}) == 2 and all(e and w not in loops for w, e in uses))
    for u in sorted(joints, reverse=True):
        uses = [(w, [unit(n) for n in nodes]) for w, nodes in ways.items() if u in (unit(nodes[0]), unit(nodes[-1]))]
        if len(uses) < 2:
            continue  # the last joint of a ring
        a, b = sorted(w for w, _ in uses)
        x, y = ways[a], ways[b]
        if unit(x[-1]) == u:
            y = y if unit(y[0]) == u else y[::-1]
            ways[a] = x + y[1:]
        else:
            y = y if unit(y[-1]) == u else y[::-1]
            ways[a] = y + x[1:]
        del ways[b]
    return ways


def test_merge_is_the_sequential_merge(spark):
    rng = random.Random(8)
    ways, tags, group, kept, n = {}, {}, {}, set(), 0
    for c in range(12):
        m = rng.choice((1, 2, 5, 30))
        names = [f"p{n + k:03}" for k in range(m + 1)]
        n += m + 1
        if c % 4 == 3 and m > 2:
            names[-1] = names[0]  # a ring of ways
        ids = [f"w{rng.randrange(10**6):06}" for _ in range(m)]
        for k, w in enumerate(ids):
            piece = [names[k], f"{w}x", names[k + 1]]
            ways[w] = piece if rng.random() < 0.5 else piece[::-1]
            tags[w] = {"oneway": rng.choice(["yes", "-1", "no"])}
        if m == 30 and names[-1] != names[0]:  # the two sides of a joint are nodes of one group; a third leg keeps another joint
            ways[ids[10]] = [x + "b" if x == names[10] else x for x in ways[ids[10]]]
            group |= {names[10]: f"g{c}", names[10] + "b": f"g{c}"}
            ways[f"v{c}"] = [names[20], f"v{c}x"]
            kept |= {names[5], names[15]}
    ways["loop"] = ["l1", "l2", "l1"]
    ways["tail"] = ["l1", "l3"]
    all_nodes = sorted({x for w in ways.values() for x in w})
    node_rows = [(x, {k: v for k, v in (("join_group", group.get(x)), ("uturn", "yes" if x in kept and x > "p100" else None)) if v}) for x in all_nodes]
    nodes = spark.createDataFrame(node_rows, "node_id string, tags map<string,string>")
    table = spark.createDataFrame([(w, 0, tags.get(w, {}), x, "extra") for w, x in ways.items()], "way_id string, ord long, tags map<string,string>, nodes array<string>, pos string")
    signals = spark.createDataFrame([(x,) for x in kept if x <= "p100"], "node_id string")
    left, out, merged = merge_through_ways(nodes, table, None, signals)
    got = {r.way_id: r.nodes for r in out.collect()}
    want = merged_by_hand(ways, kept, group)
    plain = lambda x: [group.get(n, n) for n in x]  # noqa: E731  which of a joint's nodes stays is free
    assert set(got) == set(want)
    for w in want:
        if want[w][0] == want[w][-1] and w != "loop":
            assert len(got[w]) == len(want[w]) and got[w][0] == got[w][-1] == min(x for x in got[w] if x.startswith("p"))
        else:
            assert plain(got[w]) == plain(want[w]), w
    assert {r.way_id: r.tags for r in out.collect()} == {w: tags.get(w, {}) for w in want}
    assert {r.node_id for r in left.collect()} == {x for w in got.values() for x in w}
    into = {r.way_id: r.into_id for r in merged.collect()}
    some = [w for w in into if into[w] != w][:2]
    phases = spark.createDataFrame([("s", [("a", [some[0], into[some[0]], "other", some[1]]), ("b", [])]), ("t", [])], "node_id string, phases array<struct<id:string,wayIds:array<string>>>")
    got = {r.node_id: r.phases for r in remap_phases(phases, merged).collect()}
    assert [tuple(p) for p in got["s"]] == [("a", list(dict.fromkeys([into[some[0]], "other", into[some[1]]]))), ("b", [])] and got["t"] == []


def test_only_chosen_joints(spark):
    nodes = spark.createDataFrame([(x, {}) for x in "abcd"], "node_id string, tags map<string,string>")
    ways = spark.createDataFrame([("w1", 1, {}, ["a", "b"]), ("w2", 2, {}, ["c", "b"]), ("w3", 3, {}, ["c", "d"])], "way_id string, ord long, tags map<string,string>, nodes array<string>")
    _, out, _ = merge_through_ways(nodes, ways, nodes.where("node_id = 'b'").select("node_id"))
    assert {r.way_id: r.nodes for r in out.collect()} == {"w1": ["a", "b", "c"], "w3": ["c", "d"]}
    left, out, merged = merge_through_ways(nodes, ways.where("way_id = 'x'"))
    assert out.count() == merged.count() == 0 and left.count() == 4


def test_join_nodes_and_ungroup(spark):
    """Overlapping selections, earlier groups, a connector with a branch, one with a shape point, a loop."""
    groups = {"c": "g2", "d": "g2", "e": "g1"}
    nodes = spark.createDataFrame([(x, {"join_group": groups[x], "k": "v"} if x in groups else {}) for x in [*"abcdefghuvw", "far"]], "node_id string, tags map<string,string>")
    ways = [("short", ["a", "u", "b"]), ("branch", ["b", "v", "c"]), ("side", ["v", "far"]), ("loop", ["a", "w", "a"]), ("out", ["d", "far"]), ("tiny", ["d", "e"]), ("other", ["f", "g"]), ("alone", ["far", "h"])]
    table = spark.createDataFrame([(w, i, n) for i, (w, n) in enumerate(ways)], "way_id string, ord long, nodes array<string>")
    picked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "e"), (3, "d"), (4, "f"), (4, "g"), (5, "missing")], "join_id int, node_id string")
    left, kept, summary = join_nodes(nodes, table, picked)
    got = {r.node_id: r.tags for r in left.collect()}
    assert {x for x in got if got[x].get("join_group") == "g1"} == set("abcde") and got["c"]["k"] == "v"
    assert got["f"] == got["g"] == {"join_group": "jg_4"} and got["h"] == {} and "u" not in got and "v" in got
    assert {r.way_id for r in kept.collect()} == {"branch", "side", "loop", "out", "alone"}
    assert sorted(map(tuple, summary.collect())) == [("g1", 5, 2), ("jg_4", 2, 1)]
    apart = {r.node_id: r.tags for r in ungroup(left, spark.createDataFrame([("a",), ("h",)], "node_id string")).collect()}
    assert apart["e"] == {"k": "v"} and apart["a"] == {} and apart["f"] == {"join_group": "jg_4"}
    again, same, nothing = join_nodes(nodes, table, picked.where("join_id = 5"))
    assert again.count() == 12 and same.count() == 8 and nothing.count() == 0
