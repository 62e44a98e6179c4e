"""The win-loss digraph: components, strong components, extremes, chains and reachability.

Edges are (winner, loser). Components, extremes and reachability are iterated joins over DataFrames, with
results written to the shared folder. Strong components and chains are found per weak component by a
stream by component where a component has few links, and by rounds of joins (strong.py, paths.py) where it has many.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..config import RANKING
from ..scratch import scratch
from .connected import connected_components, contracted, hashed
from .paths import giant_chains
from .strong import coloured_parts
from .tables import with_loser


def edges(comparisons: DataFrame) -> DataFrame:
    """Different (winner, loser), without self-links."""
    return with_loser(comparisons).where("winner <> loser").select("winner", "loser").distinct()


def universe(links: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    out = links.select(F.col("winner").alias("node")).union(links.select("loser"))
    return (out if extra is None else out.union(extra.select("filename"))).distinct()


def extremes(nodes: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, is_top, is_bottom): never lost, never won; an isolated node is both. Without nodes they are the links' ends, from one exchange."""
    if nodes is None:
        sides = [F.struct(F.col(c).alias("node"), F.lit(c == "loser").alias("lost")) for c in ("winner", "loser")]
        ends = links.select(F.inline(F.array(*sides)))
        return ends.groupBy("node").agg((~F.max("lost")).alias("is_top"), F.min("lost").alias("is_bottom"))
    lost, won = links.select(F.col("loser").alias("node")).distinct(), links.select(F.col("winner").alias("node")).distinct()
    j = nodes.join(lost.withColumn("_l", F.lit(True)), "node", "left").join(won.withColumn("_w", F.lit(True)), "node", "left")
    return j.select("node", F.col("_l").isNull().alias("is_top"), F.col("_w").isNull().alias("is_bottom"))


def components(nodes: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable, edges taken both ways; nodes without links are their own. Without nodes they are the links' ends."""
    found = connected_components(links, "winner", "loser")
    if nodes is None:
        return scratch(found, "labels")
    return scratch(nodes.distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "labels")


def component_sizes(labels: DataFrame, ends: DataFrame) -> DataFrame:
    """(component, size, tops, bottoms, collapsible): collapsible with two tops or two bottoms at least."""
    g = labels.join(ends, "node").groupBy("component").agg(F.count("*").alias("size"), F.count_if("is_top").alias("tops"), F.count_if("is_bottom").alias("bottoms"))
    return g.withColumn("collapsible", (F.col("tops") >= 2) | (F.col("bottoms") >= 2))


def same_component(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs (a, b) with same: null if a node is unknown."""
    a, b = labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").select("a", "b", (F.col("ca") == F.col("cb")).alias("same"))


def links_of(links: DataFrame, node: str) -> DataFrame:
    """(other, side): whom the node beat, and by whom it was beaten."""
    beat = links.where(F.col("winner") == node).select(F.col("loser").alias("other"), F.lit("worse").alias("side"))
    return beat.union(links.where(F.col("loser") == node).select("winner", F.lit("better"))).distinct()


def levels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, level): length of the longest path from a top, for acyclic links; a topological order. Cyclic links raise.

    Peeled from the tops: each round gives its number to the nodes that no remaining link leads to and drops their links, so
    a link is read only until its winner is peeled. A round that peels nothing finds a cycle.
    """
    left, done = links.select("winner", "loser").distinct(), []
    rest, level = nodes.distinct(), 0
    while True:
        blocked = left.select(F.col("loser").alias("node")).distinct()
        top = scratch(rest.join(blocked, "node", "left_anti").select("node", F.lit(level).alias("level")), "level")
        if top.isEmpty():
            if not rest.isEmpty():
                raise ValueError("the links have a cycle")
            break
        done.append(top)
        rest = scratch(rest.join(top, "node", "left_anti").select("node"), "rest")
        left = scratch(left.join(top.select(F.col("node").alias("winner")), "winner", "left_anti").select("winner", "loser"), "rest-links")
        level += 1
    return reduce(DataFrame.union, done) if done else nodes.select("node", F.lit(0).alias("level"))


def reachable(links: DataFrame, starts: DataFrame, depth: int = RANKING.transitive_depth) -> DataFrame:
    """(start, node, depth): nodes at most `depth` wins below each start, at their least depth."""
    front = starts.select(F.col("node").alias("start"), F.col("node")).distinct()
    seen = front.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        step = front.join(links, front["node"] == links["winner"]).select("start", F.col("loser").alias("node")).distinct()
        front = scratch(step.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        seen = seen.union(front.withColumn("depth", F.lit(d)))
    return seen.where("depth > 0")


def strong_parts(nodes: list[str], down: dict[str, list[str]]) -> dict[str, int]:
    """Strong component numbers in reverse topological order, by an iterative depth-first search."""
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    part: dict[str, int] = {}
    stack: list[str] = []
    count = 0
    for root in nodes:
        if root in number:
            continue
        number[root] = low[root] = len(number)
        stack.append(root)
        work = [(root, iter(down.get(root, ())))]
        while work:
            n, rest = work[-1]
            for m in rest:
                if m not in number:
                    number[m] = low[m] = len(number)
                    stack.append(m)
                    work.append((m, iter(down.get(m, ()))))
                    break
                if m not in part:
                    low[n] = min(low[n], number[m])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[n])
                if low[n] == number[n]:
                    while True:
                        m = stack.pop()
                        part[m] = count
                        if m == n:
                            break
                    count += 1
    return part


def _graph(winners: list[str], losers: list[str | None]) -> tuple[list[str], dict[str, list[str]], dict[str, list[str]]]:
    down, up = defaultdict(list), defaultdict(list)
    names = set(winners)
    for w, lo in zip(winners, losers, strict=True):
        if lo is not None:
            names.add(lo)
            down[w].append(lo)
            up[lo].append(w)
    for d in (down, up):
        for v in d.values():
            v.sort()
    return sorted(names), down, up


def _parted(labels: DataFrame | None, links: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(part, winner, loser) for every link of components with at most `limit` links, part being a number that a component's links share; labels and
    links of the others, or None twice if there are none. With labels, each component's first node comes as (part, node, null), as it may have no link.

    Two components may share a number (they are hashes), so who reads them has to tell them apart by their links.
    """
    if labels is None:
        part = contracted(hashed(links, "winner", "loser")).select(F.col("u").alias("_id"), F.col("m").alias("part"))
        own = links.join(part, F.xxhash64("winner") == F.col("_id"))
    else:
        own = links.join(labels.select("node", F.xxhash64("component").alias("part")), F.col("winner") == F.col("node"))
    own = scratch(own.select("part", "winner", "loser"), "own-links")
    giants = scratch(own.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("part"), "giants")
    rows = own
    if labels is not None:
        rows = own.union(labels.where("node = component").select(F.xxhash64("component"), "node", F.lit(None).cast("string")))
    if giants.isEmpty():
        return rows, None, None
    many = scratch(own.join(giants, "part", "left_semi").select("winner", "loser"), "giant-links")
    named = components(None, many) if labels is None else labels.join(giants, F.xxhash64("component") == F.col("part"), "left_semi").select("node", "component")
    return rows.join(giants, "part", "left_anti"), scratch(named, "giant-labels"), many


def _apart(winners: list[str], losers: list[str | None]) -> list[tuple[list[str], list[str | None]]]:
    """The links of one part by component: nearly always one, as parts are numbered by 64 bits."""
    up: dict[str, str] = {}

    def root(x: str) -> str:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for w, lo in zip(winners, losers, strict=True):
        up.setdefault(w, w)
        if lo is not None:
            up.setdefault(lo, lo)
            x, y = root(w), root(lo)
            if x != y:
                up[max(x, y)] = min(x, y)
    tops = {root(w) for w in winners}
    if len(tops) == 1:
        return [(winners, losers)]
    found = {t: ([], []) for t in sorted(tops)}
    for w, lo in zip(winners, losers, strict=True):
        at = found[root(w)]
        at[0].append(w)
        at[1].append(lo)
    return list(found.values())


def _by_component(rows: DataFrame, run: Callable[[list[str], list[str | None]], list[tuple]], schema: str) -> DataFrame:
    """The rows that run(winners, losers) gives for each component of (part, winner, loser).

    Rows are dealt by part and sorted, and each partition is one stream, which holds one part at a time: most components are so small that
    a grouped call for each would cost more than its work.
    """
    out = StructType.fromDDL(schema)
    shape = to_arrow_schema(out)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ws, ls, full = None, [], [], []

        def packed(full: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*full, strict=True), shape, strict=True)], schema=shape)

        for b in batches:
            parts, winners, losers = (c.to_pylist() for c in b.columns)
            i = 0
            while i < len(parts):
                if parts[i] != at:
                    for w, lo in _apart(ws, ls) if ws else ():
                        full += run(w, lo)
                    at, ws, ls = parts[i], [], []
                    if len(full) >= 10_000:
                        yield packed(full)
                        full = []
                j = i + 1
                while j < len(parts) and parts[j] == at:
                    j += 1
                ws += winners[i:j]
                ls += losers[i:j]
                i = j
        for w, lo in _apart(ws, ls) if ws else ():
            full += run(w, lo)
        if full:
            yield packed(full)

    return rows.select("part", "winner", "loser").repartition("part").sortWithinPartitions("part").mapInArrow(stream, out)


def _giant_parts(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(component, node, scc, size) by colouring."""
    found = labels.join(coloured_parts(links), "node", "left").select("component", "node", F.coalesce("scc", "node").alias("scc"))
    found = scratch(found, "strong")
    return found.join(scratch(found.groupBy("scc").agg(F.count("*").alias("size")), "sizes"), "scc").select("component", "node", "scc", "size")


def strong_components(labels: DataFrame | None, links: DataFrame, limit: int = 100_000) -> DataFrame:
    """(component, node, scc, size): scc is the smallest node of the strong component; labels as for chains.

    Weak components of at most `limit` links are searched depth first, one after another in streams; larger ones are trimmed and coloured by rounds of joins.
    """
    rows, giant_labels, giant_links = _parted(labels, links, limit)

    def run(winners: list[str], losers: list[str | None]) -> list[tuple]:
        nodes, down, _ = _graph(winners, losers)
        part = strong_parts(nodes, down)
        members = defaultdict(list)
        for n in nodes:
            members[part[n]].append(n)
        return [(nodes[0], n, min(m), len(m)) for m in members.values() for n in m]

    out = _by_component(rows, run, "component string, node string, scc string, size long")
    return out if giant_links is None else out.union(_giant_parts(giant_labels, giant_links))


def condensation(scc: DataFrame, links: DataFrame) -> DataFrame:
    """Different (winner, loser) between strong components."""
    w, lo = scc.select(F.col("node").alias("winner"), F.col("scc").alias("ws")), scc.select(F.col("node").alias("loser"), F.col("scc").alias("ls"))
    return links.join(w, "winner").join(lo, "loser").where("ws <> ls").select(F.col("ws").alias("winner"), F.col("ls").alias("loser")).distinct()


def _longest(order: list[list[str]], step: dict[str, list[str]], part: dict[str, int], is_end) -> dict[str, tuple[str | None, int, bool]]:
    """(next node, length, whether it reaches an end) of each node's path along `step` that reaches an end, or else the longest one.

    Strong parts come in the order given. Inside a strong part a path may go on through members until it leaves;
    members are settled outwards from those that can leave, so no node is entered twice.
    """
    path: dict[str, tuple[str | None, int, bool]] = {}
    for members in order:
        inside = defaultdict(list)
        for n in members:
            best = (None, 1, is_end(n))
            for m in step.get(n, ()):
                if part[m] == part[n]:
                    inside[m].append(n)
                elif (path[m][2], path[m][1] + 1) > (best[2], best[1]):
                    best = (m, path[m][1] + 1, path[m][2])
            path[n] = best
        if len(members) > 1:
            front = sorted((n for n in members if path[n][1] > 1), key=lambda n: (not path[n][2], -path[n][1], n))
            settled = set(front)
            for n in front:  # grows while it is read
                for m in inside[n]:
                    if m not in settled:
                        settled.add(m)
                        path[m] = (n, path[n][1] + 1, path[n][2])
                        front.append(m)
    return path


_PRIME, _STEP = (1 << 61) - 1, 1_000_003


def _hashes(path: dict[str, tuple[str | None, int, bool]], order: list[str], own: dict[str, int], downwards: bool) -> dict[str, int]:
    """A hash of each node's path as a sequence from the top down; order has a node's next one before it."""
    out: dict[str, int] = {}
    for n in order:
        m, length, _ = path[n]
        if m is None:
            out[n] = own[n]
        elif downwards:
            out[n] = (own[n] * pow(_STEP, length - 1, _PRIME) + out[m]) % _PRIME
        else:
            out[n] = (out[m] * _STEP + own[n]) % _PRIME
    return out


def main_chains(nodes: list[str], down: dict[str, list[str]], up: dict[str, list[str]]) -> list[tuple[tuple[str, ...], list[str]]]:
    """[(chain, the nodes it is the main chain of)]: the best way up from a node, turned round, then the best way down; no node twice.

    Paths are kept as next nodes; nodes with the same chain are found by hashes of their paths, and each chain is written out once.
    """
    part = strong_parts(nodes, down)
    groups = defaultdict(list)
    for n in nodes:
        groups[part[n]].append(n)
    order = [groups[k] for k in sorted(groups)]  # losers' parts first
    fall = _longest(order, down, part, lambda n: not down.get(n))
    rise = _longest(order[::-1], up, part, lambda n: not up.get(n))
    own = {n: int.from_bytes(blake2b(n.encode(), digest_size=7).digest(), "big") for n in nodes}
    below = _hashes(fall, sorted(nodes, key=lambda n: fall[n][1]), own, True)
    above = _hashes(rise, sorted(nodes, key=lambda n: rise[n][1]), own, False)
    same = defaultdict(list)
    for n in nodes:  # the node itself is in both paths
        length = fall[n][1]
        key = (above[n] * pow(_STEP, length - 1, _PRIME) + below[n] - own[n] * pow(_STEP, length - 1, _PRIME)) % _PRIME
        same[rise[n][1] + length, key].append(n)
    out = defaultdict(list)
    for owners in same.values():
        head, at = [], rise[owners[0]][0]
        while at is not None:
            head.append(at)
            at = rise[at][0]
        head.reverse()
        seen, at = set(head), owners[0]
        while at is not None:
            if at not in seen:
                head.append(at)
            at = fall[at][0]
        out[tuple(head)] += owners
    return sorted((c, sorted(v)) for c, v in out.items())


def acyclic_chains(nodes: list[str], winners: list[str], losers: list[str | None]) -> list[tuple[list[str], list[str]]] | None:
    """What main_chains gives for the sorted nodes of an acyclic graph, or None if there is a cycle.

    Nodes are handled as places in their order, winners before losers. Where a node is the next one up of its next one down, both have the same
    chain, and nodes of one chain follow each other in this way; so no paths are compared.
    """
    n = len(nodes)
    place = {x: i for i, x in enumerate(nodes)}
    down: list[list[int]] = [[] for _ in nodes]
    waits = [0] * n
    for w, lo in zip(winners, losers, strict=True):
        if lo is not None:
            b = place[lo]
            down[place[w]].append(b)
            waits[b] += 1
    order = [i for i in range(n) if not waits[i]]
    above, height = [-1] * n, [1] * n  # the next one up and the length of the way up
    for i in order:  # grows while it is read
        h = height[i] + 1
        for b in down[i]:
            if h > height[b]:
                height[b], above[b] = h, i
            elif h == height[b] and i < above[b]:
                above[b] = i
            waits[b] -= 1
            if not waits[b]:
                order.append(b)
    if len(order) < n:
        return None
    below, depth = [-1] * n, [1] * n
    for i in reversed(order):
        for b in down[i]:
            d = depth[b] + 1
            if d > depth[i]:
                depth[i], below[i] = d, b
            elif d == depth[i] and b < below[i]:
                below[i] = b
    out = []
    for i in range(n):
        u = above[i]
        if u >= 0 and below[u] == i:
            continue
        head, at = [], u
        while at >= 0:
            head.append(at)
            at = above[at]
        head.reverse()
        owners, at = [i], below[i]
        while at >= 0 and above[at] == owners[-1]:
            owners.append(at)
            at = below[at]
        head += owners
        while at >= 0:
            head.append(at)
            at = below[at]
        owners.sort()
        out.append((head, owners))
    out.sort()
    return [([nodes[i] for i in c], [nodes[i] for i in o]) for c, o in out]


def chains(labels: DataFrame | None, links: DataFrame, limit: int = 100_000) -> DataFrame:
    """(component, chain_id, nodes, length, owners): the different main chains and the nodes they are main for.

    labels are those of the links' components, and may have nodes without links; where there are none, None spares their making (see chain_labels).
    A weak component of at most `limit` links (some 300 bytes each) is held at once; larger ones are handled by rounds of joins (giant_chains), with
    the same results. Chain ids are the component and the chain's place among its chains, so they do not depend on partitioning.
    """
    rows, giant_labels, giant_links = _parted(labels, links, limit)

    def run(winners: list[str], losers: list[str | None]) -> list[tuple]:
        nodes = sorted({*winners, *(x for x in losers if x is not None)})
        found = acyclic_chains(nodes, winners, losers)
        if found is None:
            found = main_chains(*_graph(winners, losers))
        component = nodes[0]
        return [(component, f"{component}#{i}", c, len(c), owners) for i, (c, owners) in enumerate(found)]

    out = _by_component(rows, run, "component string, chain_id string, nodes array<string>, length long, owners array<string>")
    if giant_links is None:
        return out
    parts = _giant_parts(giant_labels, giant_links).select("node", F.col("scc").alias("part"))
    return out.union(giant_chains(giant_labels, giant_links, scratch(parts, "giant-parts")))


def chain_labels(chain: DataFrame) -> DataFrame:
    """(node, component) from the chains: each node is the owner of one."""
    return chain.select(F.explode("owners").alias("node"), "component")


def chain_members(chain: DataFrame) -> DataFrame:
    """(chain_id, length, node, place, is_main)."""
    return chain.select("chain_id", "length", "owners", F.posexplode("nodes").alias("place", "node")).select("chain_id", "length", "node", "place", F.array_contains("owners", F.col("node")).alias("is_main"))


def heights(chain: DataFrame) -> DataFrame:
    """(node, height): the longest chain through the node."""
    return chain_members(chain).groupBy("node").agg(F.max("length").alias("height"))


def placed(chain: DataFrame) -> DataFrame:
    """(node, component, height): chain_labels and heights from one exchange, as each node is on the chain that it owns."""
    return chain.select("component", "length", F.explode("nodes").alias("node")).groupBy("node").agg(F.min("component").alias("component"), F.max("length").alias("height"))


def chain_extremes(chain: DataFrame) -> DataFrame:
    """(chain_id, length, first, last, middle)."""
    return chain.select("chain_id", "length", F.element_at("nodes", 1).alias("first"), F.element_at("nodes", -1).alias("last"), F.get("nodes", F.floor(F.size("nodes") / 2).cast("int")).alias("middle"))


def main_counts(chain: DataFrame) -> DataFrame:
    return chain.select("chain_id", F.size("owners").alias("n"))


def sorted_chains(chain: DataFrame, least: int = 1, ascending: bool = True) -> DataFrame:
    key = F.asc("length") if ascending else F.desc("length")
    return chain.where(F.col("length") >= least).orderBy(key, "chain_id")


def chain_map(chain: DataFrame) -> DataFrame:
    """(length, n, nodes): chains grouped by length."""
    return chain.groupBy("length").agg(F.count("*").alias("n"), F.sum("length").alias("nodes"))


def common_chain(pairs: DataFrame, chain: DataFrame) -> DataFrame:
    """pairs (a, b) whose two nodes share a main chain, with its id."""
    m = chain.select("chain_id", F.explode("owners").alias("node"))
    a, b = m.select(F.col("node").alias("a"), F.col("chain_id").alias("ca")), m.select(F.col("node").alias("b"), F.col("chain_id").alias("cb"))
    return pairs.join(a, "a").join(b, "b").where("ca = cb").select("a", "b", F.col("ca").alias("chain_id"))


_ORDERS = 3  # random orders of a reach index


def reach_index(links: DataFrame, depth: int = RANKING.transitive_depth) -> DataFrame:
    """(node, low0, high0, low1, ...): for some random orders of the nodes, the first and the last place that occurs at most `depth` wins below a node, itself included.

    Whom a node reaches has its own place within that range in every order; so one place outside tells that there is no path. A round for each
    win widens the ranges by those of the nodes below, which combine before their exchange: its cost grows with the links, not with the paths.
    """
    places = [F.xxhash64("node", F.lit(k)) for k in range(_ORDERS)]
    own = universe(links).select("node", *[x.alias(n) for k, x in enumerate(places) for n in (f"low{k}", f"high{k}")])
    now = scratch(own, "ranges")
    for _ in range(depth):
        below = links.join(now.withColumnRenamed("node", "loser"), "loser").groupBy(F.col("winner").alias("node")).agg(*[x for k in range(_ORDERS) for x in (F.min(f"low{k}").alias(f"l{k}"), F.max(f"high{k}").alias(f"h{k}"))])
        now = scratch(now.join(below, "node", "left").select("node", *[x for k in range(_ORDERS) for x in (F.least(f"low{k}", f"l{k}").alias(f"low{k}"), F.greatest(f"high{k}", f"h{k}").alias(f"high{k}"))]), "ranges")
    return now


def _may_reach(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """The pairs (a, b) whose b lies within all ranges of a."""
    inside = F.lit(True)
    for k in range(_ORDERS):
        inside = inside & F.xxhash64("b", F.lit(k)).between(F.col(f"low{k}"), F.col(f"high{k}"))
    return pairs.join(index.withColumnRenamed("node", "a"), "a").where(inside).select("a", "b")


def _hops(links: DataFrame, starts: DataFrame, hops: int, name: str) -> DataFrame:
    """(name, node): all nodes at most `hops` links from each start (name), itself included."""
    out = front = starts.select(F.col(name), F.col(name).alias("node")).distinct()
    for _ in range(hops):
        step = front.join(links, front["node"] == links["winner"]).select(name, F.col("loser").alias("node")).distinct()
        front = scratch(step.join(out, [name, "node"], "left_anti"), "hops")
        out = out.union(front)
    return out


def _met(pairs: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """The pairs (a, b) with a path from a to b of at most `depth` wins."""
    back = links.select(F.col("loser").alias("winner"), F.col("winner").alias("loser"))
    tops, ends = (pairs.select(c).distinct().limit(_FEW + 1).count() for c in "ab")
    if min(tops, ends) <= _FEW:  # all that a few nodes reach: at most that many times the nodes
        name, other, way = ("a", "b", links) if tops <= ends else ("b", "a", back)
        return pairs.join(_hops(way, pairs, depth, name).withColumnRenamed("node", other), ["a", "b"], "left_semi")
    down, up = _hops(links, pairs, (depth + 1) // 2, "a"), _hops(back, pairs, depth // 2, "b")
    return pairs.join(down, "a").join(up, ["b", "node"], "left_semi").select("a", "b").distinct()


_FEW = 100


def same_path(pairs: DataFrame, links: DataFrame, labels: DataFrame | None, chain: DataFrame | None = None, depth: int = RANKING.transitive_depth, index: DataFrame | None = None) -> DataFrame:
    """pairs (a, b) with same_path: a shared main chain, or one reaches the other within depth wins.

    Only pairs of one component (or of nodes without a label) that no chain answers are searched, and of these, with an index (see reach_index), those that its ranges allow.
    The search meets in the middle: half the wins down from the upper ends, the rest up from the lower ends, of the pairs that are left; where one side
    has a few nodes only, all is searched from there, each way by itself. Labels only spare searches, so with few nodes on a side None will do.
    """
    both = scratch(pairs.select("a", "b").distinct(), "asked")
    hit = both.where("a = b")
    if chain is not None:
        hit = hit.union(common_chain(both, chain).select("a", "b"))
    hit = scratch(hit.distinct(), "answered")
    asked = both.join(hit, ["a", "b"], "left_anti")
    if labels is not None:
        a, b = labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        asked = asked.join(a, "a", "left").join(b, "b", "left").where("coalesce(ca = cb, true)").select("a", "b")
    asked = scratch(asked, "unanswered")
    back = asked.select(F.col("b").alias("a"), F.col("a").alias("b"))
    few = min(asked.select(c).distinct().limit(_FEW + 1).count() for c in "ab") <= _FEW
    found = reduce(DataFrame.union, [_met(scratch(w if index is None else _may_reach(w, index), "searched"), links, depth) for w in ((asked, back) if few else (asked.union(back),))])
    hit = hit.union(found).union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(hit.distinct().withColumn("_h", F.lit(True)), ["a", "b"], "left").withColumn("same_path", F.col("_h").isNotNull()).drop("_h")


def stats(nodes: DataFrame, links: DataFrame, labels: DataFrame, chain: DataFrame) -> DataFrame:
    """One row of totals."""
    e = extremes(nodes, links).agg(F.count("*").alias("nodes"), F.count_if("is_top").alias("tops"), F.count_if("is_bottom").alias("bottoms"))
    out = e.crossJoin(links.agg(F.count("*").alias("links"))).crossJoin(labels.agg(F.count_distinct("component").alias("components")))
    return out.crossJoin(chain.agg(F.count("*").alias("chains"), F.coalesce(F.max("length"), F.lit(0)).alias("longest")))


def graph_data(nodes: DataFrame | None, images: DataFrame, labels: DataFrame | None, height: DataFrame) -> DataFrame:
    """(node, score, mu, sigma, comparison_count, component, height), with defaults for unknown images. Without labels, height has the components (see placed); without nodes, it has all of them."""
    i = images.select(F.col("filename").alias("node"), "score", "rating_mu", "rating_sigma", "comparison_count")
    if nodes is None:
        j = height.join(i, "node", "left")
    else:
        j = nodes.join(i, "node", "left").join(height, "node", "left")
    if labels is not None:
        j = j.join(labels, "node", "left")
    return j.select(
        "node", F.coalesce("score", F.lit(0.5)).alias("score"), F.coalesce("rating_mu", F.lit(25.0)).alias("mu"), F.coalesce("rating_sigma", F.lit(25.0 / 3)).alias("sigma"),
        F.coalesce("comparison_count", F.lit(0)).alias("comparison_count"), "component", F.coalesce("height", F.lit(1)).cast("long").alias("height"),
    )


def surviving_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links whose two ends are among the nodes."""
    a = links.join(nodes.select(F.col("node").alias("winner")), "winner", "left_semi")
    return a.join(nodes.select(F.col("node").alias("loser")), "loser", "left_semi").select("winner", "loser")


def collapsible_pairs(pairs: DataFrame, ends: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs (a, b) of one component, both tops or both bottoms, on no common path; ends and labels are those of the same links.

    No link leads to a top and none from a bottom, so no path joins two of a kind, however long: only a node paired with itself is left out.
    """
    e = scratch(ends.where("is_top or is_bottom").join(labels, "node"), "ends")
    a = e.select(F.col("node").alias("a"), F.col("component").alias("ca"), F.col("is_top").alias("ta"), F.col("is_bottom").alias("ba"))
    b = e.select(F.col("node").alias("b"), F.col("component").alias("cb"), F.col("is_top").alias("tb"), F.col("is_bottom").alias("bb"))
    return pairs.where("a <> b").join(a, "a").join(b, "b").where("ca = cb and ((ta and tb) or (ba and bb))").select("a", "b")


def merge_edges(labels: DataFrame, new: DataFrame) -> DataFrame:
    """labels after new links: only components that a new link touches get another label."""
    known = universe(new).join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    w, lo = known.select(F.col("node").alias("winner"), F.col("component").alias("cw")), known.select(F.col("node").alias("loser"), F.col("component").alias("cl"))
    bridge = new.join(w, "winner").join(lo, "loser").where("cw <> cl").select(F.col("cw").alias("winner"), F.col("cl").alias("loser")).distinct()
    joined = components(universe(bridge), bridge).select(F.col("node").alias("component"), F.col("component").alias("_new"))
    every = labels.union(known.join(labels, "node", "left_anti").select("node", "component")).distinct()
    return every.join(joined, "component", "left").select("node", F.coalesce("_new", "component").alias("component"))


def stale(comparisons: DataFrame, built: int) -> bool:
    """Whether the number of comparisons differs from that at the last build."""
    return comparisons.count() != built
