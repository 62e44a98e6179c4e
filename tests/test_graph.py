"""Components, strong parts, chains and reachability."""

import random

import pytest

from duelframe.operators import connected, graph, growing


def links(spark, pairs):
    return spark.createDataFrame(pairs, "winner string, loser string")


def chains_of(pairs, extra=()):
    down, up = {}, {}
    names = set(extra)
    for a, b in pairs:
        down.setdefault(a, []).append(b)
        up.setdefault(b, []).append(a)
        names |= {a, b}
    return {n: c for c, owners in graph.main_chains(sorted(names), down, up) for n in owners}, down, up


def test_transitive_link_gives_one_chain():
    c, _, _ = chains_of([("a", "b"), ("b", "c"), ("a", "c")])
    assert set(c.values()) == {("a", "b", "c")}


def test_two_lines():
    c, _, _ = chains_of([("a1", "a2"), ("a2", "a3"), ("a3", "a4"), ("b1", "b2"), ("b2", "b3")])
    assert set(c.values()) == {("a1", "a2", "a3", "a4"), ("b1", "b2", "b3")}


def test_cycle_with_a_way_out_reaches_the_bottom():
    c, _, _ = chains_of([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")])
    assert all(x[-1] == "d" and len(set(x)) == len(x) for x in c.values())


def test_isolated_nodes_are_their_own_chain():
    c, _, _ = chains_of([("a", "b")], ["x", "y"])
    assert c["x"] == ("x",) and c["y"] == ("y",)


def test_long_line_is_quick():
    n = 3000
    c, _, _ = chains_of([(f"i{k:05d}", f"i{k + 1:05d}") for k in range(n)])
    assert all(len(x) == n + 1 for x in c.values())


def test_chains_of_acyclic_graphs_are_longest_paths():
    rng = random.Random(1)
    for _ in range(50):
        pairs = sorted({tuple(sorted(rng.sample("abcdefgh", 2))) for _ in range(9)})
        c, down, up = chains_of(pairs)

        def depth(n, step):
            return 1 + max((depth(m, step) for m in step.get(n, ())), default=0)

        for n, path in c.items():
            assert len(path) == depth(n, down) + depth(n, up) - 1
            assert all(b in down[a] for a, b in zip(path, path[1:], strict=False)) and n in path


def test_strong_parts():
    rng = random.Random(2)
    for _ in range(100):
        pairs = [(rng.choice("abcdefg"), rng.choice("abcdefg")) for _ in range(10)]
        down = {}
        for a, b in pairs:
            down.setdefault(a, []).append(b)
        nodes = sorted({x for p in pairs for x in p})

        def below(n, down=down):
            seen, todo = set(), [n]
            while todo:
                for m in down.get(todo.pop(), ()):
                    if m not in seen:
                        seen.add(m)
                        todo.append(m)
            return seen

        part = graph.strong_parts(nodes, down)
        for a in nodes:
            for b in nodes:
                assert (part[a] == part[b]) == (a == b or (b in below(a) and a in below(b)))


def test_components_and_merge(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(50)] + [(f"z{k:03d}", f"z{k + 1:03d}") for k in range(80)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root}
    e = links(spark, pairs)
    got = graph.components(graph.universe(e), e)
    assert {r.node: r.component for r in got.collect()} == want
    old = links(spark, pairs[:60])
    merged = graph.merge_edges(graph.components(graph.universe(old), old), links(spark, pairs[60:]))
    assert {r.node: r.component for r in merged.collect()} == want


def test_reach_stops_at_the_depth(spark):
    e = links(spark, [(f"a{k}", f"a{k + 1}") for k in range(9)])
    got = graph.reachable(e, spark.createDataFrame([("a0",)], "node string"), 5)
    assert {(r.node, r.depth) for r in got.collect()} == {(f"a{k}", k) for k in range(1, 6)}


def test_levels_need_an_acyclic_graph(spark):
    e = links(spark, [("a", "b"), ("b", "a")])
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(graph.universe(e), e)


def test_strong_components_of_frames(spark):
    e = links(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("x", "y")])
    labels = graph.components(graph.universe(e), e)
    scc = graph.strong_components(labels, e)
    assert {(r.node, r.scc, r.size) for r in scc.collect()} == {("a", "a", 2), ("b", "a", 2), ("c", "c", 1), ("x", "x", 1), ("y", "y", 1)}
    assert {(r.winner, r.loser) for r in graph.condensation(scc, e).collect()} == {("a", "c"), ("x", "y")}


def test_rounds_of_joins_give_what_one_task_gives(spark):
    """Strong components and chains of giant components, against the grouped functions; some graphs at once, cyclic and not."""
    rng, pairs = random.Random(1), set()
    for g in range(12):
        n, cyclic = rng.randrange(3, 16), g % 3
        for _ in range(rng.randrange(2, 3 * n)):
            a, b = rng.randrange(n), rng.randrange(n)
            if a != b:
                a, b = (a, b) if cyclic else (min(a, b), max(a, b))
                pairs.add((f"g{g:02}n{a:02}", f"g{g:02}n{b:02}"))
    pairs |= {("line0", "line1"), *((f"line{k}", f"line{k + 1}") for k in range(1, 8)), ("loop0", "loop1"), ("loop1", "loop0")}
    e = links(spark, sorted(pairs))
    labels = graph.components(graph.universe(e), e)
    parts = [sorted(map(tuple, graph.strong_components(labels, e, limit).select("component", "node", "scc", "size").collect())) for limit in (1000, 0)]
    assert parts[0] == parts[1]
    found = [sorted((r.component, r.chain_id, tuple(r.nodes), r.length, tuple(r.owners)) for r in graph.chains(labels, e, limit).collect()) for limit in (1000, 0)]
    assert found[0] == found[1]


def test_paths_of_asked_pairs(spark, monkeypatch):
    """With and without an index, few and many nodes on a side, against a search by hand; the index lets every path through."""
    rng = random.Random(9)
    edges = sorted({(f"n{rng.randrange(70):02}", f"n{rng.randrange(70):02}") for _ in range(110)} | {("z1", "z2")})
    e = links(spark, [p for p in edges if p[0] != p[1]])
    down = {}
    for a, b in edges:
        if a != b:
            down.setdefault(a, set()).add(b)

    def near(a, depth):
        out = front = {a}
        for _ in range(depth):
            front = {m for n in front for m in down.get(n, ())} - out
            out = out | front
        return out

    asked = sorted({(rng.choice(edges)[0], rng.choice(edges)[1]) for _ in range(250)} | {("n01", "n01"), ("z1", "n01"), ("nobody", "n01")})
    want = {(a, b): a == b or b in near(a, 5) or a in near(b, 5) for a, b in asked}
    p, labels, index = spark.createDataFrame(asked, "a string, b string"), graph.components(graph.universe(e), e), graph.reach_index(e)
    for few in (0, 1000):
        monkeypatch.setattr(graph, "_FEW", few)
        for i in (None, index):
            assert {(r.a, r.b): r.same_path for r in graph.same_path(p, e, labels, index=i).collect()} == want
    allowed = {(r.a, r.b) for r in graph._may_reach(p, index).collect()}
    assert {(a, b) for a, b in asked if a in down and b in near(a, 5)} <= allowed and len(allowed) < len(asked)


def test_a_growing_graph_is_the_whole_one(spark, tmp_path):
    """Labels and extremes after each of some batches, one of them applied twice; what a small batch writes is small."""
    rng, folder = random.Random(11), f"{tmp_path}/graph"
    batches = [[(f"n{k:04}", f"n{k + 1:04}") for k in range(1, 900, 2)], [(f"n{rng.randrange(900):04}", f"n{rng.randrange(900):04}") for _ in range(60)], [("n0700", "m1"), ("m1", "n0003"), ("x", "x")], [("a", "n0899"), ("q1", "q2")], []]
    g, so_far, written = growing.GrowingGraph(spark, folder), [], []
    for k, batch in enumerate(batches):
        for _ in range(2 if k == 2 else 1):
            g.apply(spark.createDataFrame(batch, "winner string, loser string"), k)
        so_far += [p for p in batch if p[0] != p[1]]
        written.append(sum(spark.read.parquet(f"{folder}/{name}/batch={k}").count() for name in ("nodes", "aliases", "counts")))
        if k in (2, 4):
            e = links(spark, so_far)
            assert {tuple(r) for r in g.labels().collect()} == {tuple(r) for r in graph.components(graph.universe(e), e).collect()}
            assert {tuple(r) for r in g.extremes().collect()} == {tuple(r) for r in graph.extremes(graph.universe(e), e).collect()}
    assert written[0] == 1800 and written[2] <= 3 * len(batches[2]) + 2 and written[3] <= 12 and written[4] == 0


@pytest.mark.parametrize("few", [0, 100_000])
def test_rounds_of_components_shrink(spark, monkeypatch, few):
    """Many small components: what all rounds write is little more than the first round's links, and the labels are right."""
    pairs = [(f"c{k:03d}n{(i * 7) % 12:02d}", f"c{k:03d}n{((i + 1) * 7) % 12:02d}") for k in range(60) for i in range(11)]
    sizes, plain = [], connected.scratch
    monkeypatch.setattr(connected, "_FEW", few, raising=False)
    monkeypatch.setattr(connected, "scratch", lambda df, name="table", *a: (out := plain(df, name, *a), sizes.append(out.count() if name == "links" else 0))[0])
    found = {r.node: r.component for r in connected.connected_components(links(spark, pairs), "winner", "loser").collect()}
    assert found == {n: f"{n[:4]}n00" for p in pairs for n in p}
    assert sum(sizes) < 2.5 * len(pairs)


def test_small_components_are_streams(spark):
    e = links(spark, [("a", "b"), ("b", "c"), ("x", "y")])
    labels = graph.components(graph.universe(e), e)
    for df in (graph.chains(labels, e), graph.strong_components(labels, e)):
        assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()


def test_acyclic_chains_are_main_chains():
    """The walk over places gives what paths with hashes give, chain for chain; cyclic graphs are left to the latter."""
    rng, cyclic = random.Random(4), 0
    for k in range(2000):
        n = rng.randrange(2, 14)
        pairs = {(f"n{a * 5 % 17:02}", f"n{b * 5 % 17:02}") for a, b in (sorted(rng.sample(range(14), 2), reverse=k % 5 == 0 and rng.random() < 0.3) for _ in range(2 * n))}
        ws, ls = [p[0] for p in pairs], [p[1] for p in pairs]
        nodes, down, up = graph._graph(ws, ls)
        found = graph.acyclic_chains(nodes, ws, ls)
        cyclic += found is None
        assert found is None or found == [(list(c), o) for c, o in graph.main_chains(nodes, down, up)]
    assert 0 < cyclic < 1000


def test_chains_need_no_labels(spark):
    """Chains and strong components by the links alone are those by labels; chains give the labels too."""
    rng = random.Random(8)
    pairs = {(f"g{g:02}n{rng.randrange(6)}", f"g{g:02}n{6 + rng.randrange(6)}") for g in range(9) for _ in range(2 + g)} | {("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("x3", "x4")}
    e = links(spark, sorted(pairs))
    labels = graph.components(graph.universe(e), e)
    found = graph.chains(None, e).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, graph.chains(labels, e).collect()))
    assert {(n, r.component) for r in found for n in r.owners} == {tuple(r) for r in labels.collect()} == {tuple(r) for r in graph.components(None, e).collect()}
    parts = [sorted(map(tuple, graph.strong_components(x, e, limit).collect())) for x, limit in ((labels, 1000), (None, 1000), (None, 12))]
    assert parts[0] == parts[1] == parts[2]


def test_parts_that_share_a_number_are_told_apart(spark):
    rows = spark.createDataFrame([(7, "a", "b"), (7, "x", "y"), (7, "b", "c"), (7, "solo", None), (7, "y", "z")], "part long, winner string, loser string")
    got = graph._by_component(rows, lambda ws, ls: [(min(ws), len(ws))], "least string, n long").collect()
    assert sorted(map(tuple, got)) == [("a", 2), ("solo", 1), ("x", 2)]


def test_components_whose_nodes_share_a_hash(spark, monkeypatch):
    """Hashes of a few values only: nodes are numbered instead; nulls and links of a node to itself add the node."""
    plain = connected.F.xxhash64
    monkeypatch.setattr(connected.F, "xxhash64", lambda *c: connected.F.pmod(plain(*c), connected.F.lit(3)))
    e = links(spark, [("a", "b"), ("b", "c"), ("x", "y"), ("s", "s"), ("n", None), (None, None)])
    got = {r.node: r.component for r in connected.connected_components(e, "winner", "loser").collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "s": "s", "n": "n"}


def test_extremes_of_the_ends(spark):
    e = links(spark, [("a", "b"), ("b", "c"), ("x", "c")])
    assert sorted(map(tuple, graph.extremes(None, e).collect())) == sorted(map(tuple, graph.extremes(graph.universe(e), e).collect()))


def test_two_of_a_kind_are_not_searched(spark, monkeypatch):
    """Tops with tops and bottoms with bottoms are on no common path, so nothing is searched for them."""
    monkeypatch.setattr(graph, "_met", lambda *a: 1 / 0)
    e = links(spark, [("a", "m"), ("b", "m"), ("m", "y"), ("m", "z"), ("p", "q")])
    ends, labels = graph.extremes(None, e), graph.components(None, e)
    p = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("y", "z"), ("a", "z"), ("a", "m"), ("a", "p"), (None, "a")], "a string, b string")
    assert sorted(map(tuple, graph.collapsible_pairs(p, ends, labels).collect())) == [("a", "b"), ("b", "a"), ("y", "z")]


def test_one_node_against_many_is_searched_from_it(spark, monkeypatch):
    """Without labels, and each way from the one node: no search starts at the many."""
    starts, plain = [], graph._hops
    monkeypatch.setattr(graph, "_FEW", 2)
    monkeypatch.setattr(graph, "_hops", lambda links, pairs, hops, name: (starts.append(pairs.select(name).distinct().count()), plain(links, pairs, hops, name))[1])
    e = links(spark, [(f"n{k:02}", f"n{k + 1:02}") for k in range(30)] + [("u", "v")])
    p = spark.createDataFrame([("n15", f"n{k:02}") for k in range(31)] + [("n15", "u"), ("n15", "nobody")], "a string, b string")
    got = {r.b: r.same_path for r in graph.same_path(p, e, None).collect()}
    assert got == {**{f"n{k:02}": abs(k - 15) <= 5 for k in range(31)}, "u": False, "nobody": False} and starts == [1, 1]
