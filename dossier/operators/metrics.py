"""Iterative graph metrics over all cases at once: PageRank, betweenness, communities, view clusters.

Nodes that share a key are one node: metrics have one row a key, so that joining several of them doesn't multiply rows.
"""

from __future__ import annotations

import math
from collections import deque
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.operators.components import connected_components, stored
from dossier.operators.graph import both_ways
from dossier.operators.ranking import ranked


#: Hubs there may be at most, and links that a source must have to be one.
MOST_HUBS, HUB = 10_000, 10_000


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85, cut: int = 4) -> DataFrame:
    """(key, pagerank), directed, weighted by confidence (0.5 where missing): 1 - d + d * what the in-edges bring.

    The out-weights are joined once, and the links stay dealt by their source, so a round shuffles ranks and what they
    bring alone. Nodes without links of their own pass nothing on, so their ranks are worked out in the last round alone, from
    all links; the rounds before go over the others. Sources with more than one in MOST_HUBS of all links, of which there are
    fewer than MOST_HUBS, are sent to all tasks instead, and their links are spread evenly. Every `cut` rounds the ranks are
    written to cut the lineage.
    """
    w = F.coalesce(F.col("confidence"), F.lit(0.5))
    share = edges.groupBy("src").agg(F.sum(w).alias("total"))
    links = stored(edges.join(share, "src").select("src", "dst", (w / F.col("total")).alias("share")), "links")
    hubs = stored(links.groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") > max(HUB, links.count() // MOST_HUBS)).select("src"), "hubs")
    some_hubs = bool(hubs.limit(1).count())
    cut = 1 if some_hubs else cut  # the ranks are read twice then
    base = stored(nodes.select("key").distinct(), "nodes")
    if not rounds:
        return base.withColumn("pagerank", F.lit(1.0))
    lead = stored(base.join(links.select(F.col("src").alias("key")).distinct(), "key", "left_semi"), "leading")
    inner = links.join(lead.withColumnRenamed("key", "dst"), "dst", "left_semi")
    usual = inner.join(F.broadcast(hubs), "src", "left_anti").repartition("src").persist()
    wide = inner.join(F.broadcast(hubs), "src").repartition("dst").persist()

    def turn(to: DataFrame, usual: DataFrame, wide: DataFrame, ranks: DataFrame) -> DataFrame:
        at = ranks.withColumnRenamed("key", "src")
        sent = usual.join(at, "src")
        if some_hubs:
            sent = sent.unionByName(wide.join(F.broadcast(at.join(F.broadcast(hubs), "src", "left_semi")), "src"))
        brought = sent.groupBy(F.col("dst").alias("key")).agg(F.sum(F.col("share") * F.col("rank")).alias("in"))
        return to.join(brought, "key", "left").select("key", (F.lit(1 - damping) + damping * F.coalesce("in", F.lit(0.0))).alias("rank"))

    ranks = lead.withColumn("rank", F.lit(1.0))
    for i in range(1, rounds):
        ranks = turn(lead, usual, wide, ranks)
        if i % cut == 0:
            ranks = stored(ranks, "ranks")
    ranks = stored(turn(base, links.join(F.broadcast(hubs), "src", "left_anti"), links.join(F.broadcast(hubs), "src").repartition("dst"), ranks), "ranks")
    usual.unpersist()
    wide.unpersist()
    return ranks.withColumnRenamed("rank", "pagerank")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, component): weakly connected, a component named by its smallest key."""
    found = connected_components(edges, "src", "dst").withColumnRenamed("node", "key")
    return nodes.select("key").distinct().join(found, "key", "left").select("key", F.coalesce("component", "key").alias("component"))


def betweenness(nodes: DataFrame, edges: DataFrame, max_depth: int | None = None, sources: DataFrame | None = None, parts: tuple | None = None) -> DataFrame:
    """(key, betweenness), directed and unweighted, over all (or the given) sources.

    Parallel edges count as one. The graph falls into the parts of `graph_parts` (made here unless given); with a max_depth,
    levels of all sources advance together by joins, and state rows are (source, node, depth, paths).
    """
    starts = sources if sources is not None else nodes
    if max_depth is None:
        sums = _part_sums(parts or graph_parts(edges), starts)
    else:
        sums = _dependencies(stored(edges.select("src", "dst").distinct(), "hops"), starts, max_depth).groupBy("key").agg(F.sum("dep").alias("dep"))
    return nodes.select("key").distinct().join(sums.select("key", F.col("dep").alias("betweenness")), "key", "left").fillna(0.0, ["betweenness"])


#: Links of a part up to which a task holds them; links times sources that make a group, and groups that share a part at most;
#: cells of an array in a task; groups at least and at most; sources that a part's links cost beside its own.
PART_LINKS, WORK, SHARERS, CELLS, GROUPS, FEW = 1_000_000, 20_000_000, 96, 2_000_000, (48, 2000), 64


def graph_parts(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hops (src, dst), nodes (src, part), links (part, src, dst, w)) for betweenness.

    Only nodes with links of their own lead on, so paths stay within the weak components of the links between these (the
    parts), but for a last step to an end. Ends with one link from a part are but a number at its start (w of a link to
    itself), others stay nodes of each part that links them.
    """
    hop = stored(edges.filter("src <> dst").select("src", "dst").distinct(), "hops")
    begins = hop.select(F.col("src").alias("dst")).distinct()
    inner = stored(hop.join(begins, "dst", "left_semi"), "inner")
    part = stored(connected_components(inner, "src", "dst").select(F.col("node").alias("src"), F.col("component").alias("part")), "parts")
    ends = stored(hop.join(begins, "dst", "left_anti").join(part, "src"), "ends")
    met = ends.groupBy("part", "dst").agg(F.count("*").alias("n"), F.min("src").alias("src"))
    alone = met.filter("n = 1").groupBy("part", "src").agg(F.count("*").alias("w")).select("part", "src", F.col("src").alias("dst"), "w")
    shared = ends.join(met.filter("n > 1").select("part", "dst"), ["part", "dst"]).select("part", "src", "dst", F.lit(0).cast("long").alias("w"))
    links = stored(inner.join(part, "src").select("part", "src", "dst", F.lit(0).cast("long").alias("w")).unionByName(shared).unionByName(alone), "links")
    return hop, part, links


def _part_sums(parts: tuple[DataFrame, DataFrame, DataFrame], sources: DataFrame) -> DataFrame:
    """(key, dep, squares): the dependencies of `_dependencies` and their squares, summed over the sources.

    The sources of a part of much work are dealt to several groups, each of which gets the part's links; small parts share
    a group, so that groups follow the work and not the number of parts. Parts of more than PART_LINKS links advance level
    by level in joins instead.
    """
    hop, part, links = parts
    begun = stored(sources.select(F.col("key").alias("src")).distinct().join(part, "src"), "begun")
    sizes = links.groupBy("part").agg(F.count("*").alias("m")).join(begun.groupBy("part").agg(F.count("*").alias("n")), "part")
    sizes = stored(sizes.withColumn("tasks", F.least(F.lit(SHARERS), F.col("n"), F.ceil(F.col("n") * F.col("m") / WORK)).cast("int")), "sizes")
    dealt = sizes.filter(F.col("m") <= PART_LINKS).select("part", "tasks")
    work = sizes.filter(F.col("m") <= PART_LINKS).agg(F.sum(F.col("m") * (F.col("n") + FEW))).first()[0] or 0
    groups = min(GROUPS[1], max(GROUPS[0], math.ceil(work / WORK)))
    group = F.pmod(F.xxhash64("part", "task"), F.lit(groups)).cast("int").alias("group")
    left = links.join(dealt, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "src", "dst", "w")
    right = begun.join(dealt, "part").select("part", F.pmod(F.xxhash64("src"), F.col("tasks")).cast("int").alias("task"), "src")
    own = lambda df: df.withColumn("group", group).withColumn("part", F.struct("part", "task").cast("string")).drop("task").repartition(groups, "group").groupBy("group")
    out = own(left).cogroup(own(right)).applyInPandas(_brandes, f"key {hop.schema['src'].dataType.simpleString()}, dep double, squares double")
    large = sizes.filter(F.col("m") > PART_LINKS).select("part")
    if large.limit(1).count():
        far = _dependencies(hop, begun.join(large, "part", "left_semi").select(F.col("src").alias("key")))
        out = out.unionByName(far.select("key", "dep", (F.col("dep") * F.col("dep")).alias("squares")))
    return out.groupBy("key").agg(F.sum("dep").alias("dep"), F.sum("squares").alias("squares"))


def _brandes(links: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """The sums of some parts over their given sources; a link to itself tells how many ends only its node has.

    A state is a source and a node of its own part. A level holds the states first reached in it, and only their links are
    followed, so a source costs the links that it reaches once each way, however deep and many the parts are.
    """
    m = len(links)
    kinds, _ = pd.factorize(pd.concat([links["part"], links["part"], sources["part"]], ignore_index=True))
    codes, names = pd.factorize(pd.concat([links["src"], links["dst"], sources["src"]], ignore_index=True))
    nodes, places = np.unique(kinds.astype(np.int64) * len(names) + codes, return_inverse=True)  # a part's nodes stand together
    n, w = len(nodes), links["w"].to_numpy()
    a, b, starts = places[:m], places[m : 2 * m], np.sort(places[2 * m :])
    alone = np.bincount(a, weights=w, minlength=n)
    order = np.argsort(a[w == 0], kind="stable")
    to, degree = b[w == 0][order], np.bincount(a[w == 0], minlength=n)
    first = np.cumsum(degree) - degree
    part = nodes // len(names)
    size, links_of, base = np.bincount(part), np.bincount(kinds[:m], minlength=part[-1] + 1), np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    dep, squares = np.zeros(n), np.zeros(n)
    cells = np.cumsum((size + links_of)[part[starts]]) // CELLS if len(starts) else starts
    for own in np.split(starts, np.flatnonzero(np.diff(cells)) + 1) if len(starts) else ():
        p = part[own]
        end = np.cumsum(size[p])
        shift, total = end - size[p] - base[p], end[-1]
        reached, owner, paths = np.zeros(total, bool), np.empty(total, np.int64), np.zeros(total)
        node, state = own, own + shift
        reached[state], paths[state] = True, 1.0
        steps = []
        while len(node):
            many = degree[node]
            begin = np.cumsum(many) - many
            step = np.arange(many.sum())
            came = np.repeat(np.arange(len(node)), many)
            node, moved = to[step + (first[node] - begin)[came]], (state - node)[came]
            state, before = node + moved, state[came]
            new = ~reached[state]
            node, state, before = node[new], state[new], before[new]
            np.add.at(paths, state, paths[before])
            reached[state] = True
            steps.append((before, state))
            owner[state] = np.arange(len(state))
            once = owner[state] == np.arange(len(state))
            node, state = node[once], state[once]
        stands = np.arange(total) - np.repeat(shift, size[p])
        led = alone[stands]
        for before, state in reversed(steps):
            np.add.at(led, before, paths[before] / paths[state] * (1 + led[state]))
        reached[own + shift] = False
        led[~reached] = 0
        dep += np.bincount(stands, weights=led, minlength=n)
        squares += np.bincount(stands, weights=led * led, minlength=n)
    return pd.DataFrame({"key": names[nodes % len(names)], "dep": dep, "squares": squares})[dep > 0]


def _dependencies(hop: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(s, key, dep): how much of the shortest paths from a source lead on through a node, summed over their ends."""
    start = sources.select(F.col("key").alias("s"), F.col("key").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("paths"))
    levels = [stored(start, "level")]
    seen = levels[0].select("s", "v")
    for d in count(1) if max_depth is None else range(1, max_depth + 1):
        step = levels[-1].join(hop.withColumnRenamed("src", "v"), "v").select("s", F.col("dst").alias("v"), "paths")
        step = step.join(seen, ["s", "v"], "left_anti").groupBy("s", "v").agg(F.sum("paths").alias("paths"))
        level = stored(step.select("s", "v", F.lit(d).alias("d"), "paths"), "level")
        if not level.limit(1).count():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("s", "v"))
    parts, below = [], None
    for level in reversed(levels):
        if below is None:
            here = level.withColumn("dep", F.lit(0.0))
        else:
            flow = below.select("s", F.col("v").alias("dst"), F.col("paths").alias("p"), "dep").join(hop, "dst").select("s", F.col("src").alias("v"), "p", "dep")
            got = flow.join(level.select("s", "v", "paths"), ["s", "v"]).groupBy("s", "v").agg(F.sum(F.col("paths") / F.col("p") * (1 + F.col("dep"))).alias("dep"))
            here = level.join(got, ["s", "v"], "left").fillna(0.0, ["dep"])
        below = stored(here, "dependencies")
        parts.append(below.filter("s <> v").select("s", F.col("v").alias("key"), "dep"))
    return reduce(DataFrame.unionByName, parts)


def sampled_betweenness(nodes: DataFrame, edges: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """(key, betweenness) estimated from a drawn share of the sources, scaled to all of them."""
    nodes = nodes.select("key").distinct()
    drawn = nodes.filter(F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
    found = betweenness(nodes, edges, sources=drawn)
    return found.withColumn("betweenness", F.col("betweenness") * F.lit(nodes.count() / max(1, drawn.count())))


#: Draws that an estimate may take at most, each twice the one before; a constant of the bound (Bardenet and Maillard 2015).
DRAWS, KAPPA = 21, 7 / 3 + 3 / 2**0.5


def estimated_betweenness(nodes: DataFrame, edges: DataFrame, error: float = 0.1, doubt: float = 0.1, seed: int = 0, parts: tuple | None = None) -> DataFrame:
    """(key, betweenness, margin): estimated from drawn sources until the margin is small enough at every node.

    With probability 1 - doubt no node is off by more than its margin, and no margin is over error * n * r, of n nodes with
    r others in the largest weak component: what a source can add at most is r. Sources are drawn without replacement, and
    the margin is the empirical Bernstein-Serfling bound over all nodes and draws; while the widest is too wide, as many
    sources again are drawn. If that takes all of them, the result is exact and margins are 0.
    """
    parts = parts or graph_parts(edges)
    nodes = stored(nodes.select("key").distinct(), "nodes")
    n, largest = nodes.count(), components(nodes, edges).groupBy("component").count().agg(F.max("count")).first()[0]
    reach, log = max(1, (largest or 1) - 1), math.log(10 * max(1, n) * DRAWS / doubt)
    place = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << DRAWS - 1))
    cut = lambda share: round(share * (1 << DRAWS - 1))
    sums, taken, low, share = None, 0, 0, min(1.0, max(0.5 ** (DRAWS - 1), KAPPA * log / error / max(1, n)))
    while True:
        drawn = stored(nodes.select("key").filter((place >= low) & (place < cut(share))), "drawn")
        taken += drawn.count()
        part = _part_sums(parts, drawn).select("key", (F.col("dep") / reach).alias("x"), (F.col("squares") / reach**2).alias("xx"))
        part = part if sums is None else sums.unionByName(part).groupBy("key").agg(F.sum("x").alias("x"), F.sum("xx").alias("xx"))
        sums, k = stored(part, "sums"), max(1, taken)
        rho = 1 - (k - 1) / max(1, n) if 2 * k <= n else (1 - k / max(1, n)) * (1 + 1 / k)
        mean = F.coalesce(F.col("x") / k, F.lit(0.0))
        spread = F.sqrt(F.greatest(F.coalesce(F.col("xx") / k, F.lit(0.0)) - mean * mean, F.lit(0.0)))
        margin = F.lit(0.0) if share >= 1 else spread * math.sqrt(2 * max(0.0, rho) * log / k) + KAPPA * log / k
        out = nodes.select("key").join(sums, "key", "left").select("key", (mean * n * reach).alias("betweenness"), margin.alias("margin"))
        if share >= 1 or taken and (out.agg(F.max("margin")).first()[0] or 0.0) <= error:
            return out.withColumn("margin", F.col("margin") * n * reach)
        low, share = cut(share), min(1.0, 2 * share)


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, community) by modularity gain, weighted by confidence; a community is named by its smallest key.

    Nodes move to the neighbouring community of highest strictly positive gain (ties: smallest name) until none gains.
    First the nodes of a piece, which is a connected part or, of a large one, some of its nodes, move one after another within
    it (`_moved`); where parts are no larger than a piece, none gains after that. Rounds over the whole graph do the rest:
    moves of neighbours at once may cost more than they gain, so a round moves some of those that want to (by a hash that
    changes each round), and one after which modularity is not higher is taken back and fewer move. Communities that fall
    apart into several connected parts are cut into these. Then communities become the nodes of the next level, until a
    level moves nothing. Modularity grows with every kept round, so the rounds end; the driver sees a few sums of each.
    """
    w = F.coalesce(F.col("confidence"), F.lit(0.5))
    links = stored(both_ways(edges.filter("src <> dst").withColumn("w", w), "w").groupBy("a", "b").agg(F.sum("w").alias("w")), "links")
    members = nodes.select("key", F.col("key").alias("node")).distinct()
    twice = links.agg(F.sum("w")).first()[0] or 0.0
    part = connected_components(links.filter("a < b")).select(F.col("node").alias("a"), "component") if twice else None
    while twice:
        moved = stored(_moved(links, part, twice), "moved")
        start = moved.select("node", "k", "c")
        settled = _settled(links, start, twice)
        if settled is start and not start.filter("c <> node").limit(1).count():
            break
        at = moved.select("node", F.col("part").alias("c")) if settled is start else _connected(links, settled)
        members = stored(members.join(at, "node", "left").select("key", F.coalesce("c", "node").alias("node")), "members")
        ends = links.join(at.select(F.col("node").alias("a"), F.col("c").alias("x")), "a").join(at.select(F.col("node").alias("b"), F.col("c").alias("y")), "b")
        links = stored(ends.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")), "links")
    names = members.groupBy("node").agg(F.min("key").alias("community"))
    return members.join(names, "node").select("key", "community")


#: Links, counted both ways, of nodes that move in one task; links from which a node's are summed up in arrays.
PIECE, MANY = 4_000_000, 64


def _least(twice: float) -> float:
    """A gain must be more than this: modularity, which is compared to twelve places, has to show a single move, or rounds never end."""
    return 1e-9 + 1e-11 * twice


def _moved(links: DataFrame, part: DataFrame, twice: float) -> DataFrame:
    """(node, k, c, part): nodes moved from communities of their own to better ones within their piece, one after another.

    part is the smallest node of the node's connected part of its community.

    part: (a, component); communities keep the names of their level's nodes, so those of later levels stand in it too. Parts of
    over PIECE links are cut by a hash of their nodes. A node joins communities of its piece alone, so what it gains is as in
    the whole graph, and modularity grows with each move. Small pieces share a task.
    """
    placed = links.join(part, "a", "left").withColumn("component", F.coalesce("component", "a"))
    size = stored(placed.groupBy("component").agg(F.count("*").alias("m")), "parts")
    groups = max(links.sparkSession.sparkContext.defaultParallelism, -(-4 * (size.agg(F.sum("m")).first()[0] or 0) // PIECE))
    piece = F.pmod(F.xxhash64("a"), F.ceil(F.col("m") / PIECE))
    dealt = placed.join(size, "component").withColumn("group", F.pmod(F.xxhash64("component", piece), F.lit(groups)).cast("int"))
    kind = links.schema["a"].dataType.simpleString()

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        return _settle_piece(rows, twice)

    return dealt.select("group", "a", "b", "w").repartition(groups, "group").groupBy("group").applyInPandas(settle, f"node {kind}, k double, c {kind}, part {kind}")


def _settle_piece(links: pd.DataFrame, twice: float) -> pd.DataFrame:
    """Nodes that a neighbour's move may concern wait in a queue; one moves to the community of highest gain (ties: smallest name).

    All nodes wait again until none of them has moved.
    """
    names, a = np.unique(links["a"].to_numpy(), return_inverse=True)
    b = pd.Index(names).get_indexer(links["b"])  # -1: a node of another piece
    w, n = links["w"].to_numpy(), len(names)
    order = np.lexsort((b, a))
    a, b, w = a[order], b[order], w[order]
    k = np.bincount(a, weights=w, minlength=n)
    inner = (b >= 0) & (a != b)
    to, weight = b[inner], w[inner]
    first = np.r_[0, np.cumsum(np.bincount(a[inner], minlength=n))].tolist()
    c, total, ks = np.arange(n), k.tolist(), k.tolist()
    waiting, queue, moved = bytearray(n), deque(), True
    while queue or moved:
        if not queue:  # sums of communities have changed for others too
            queue, moved = deque(range(n)), False
            waiting = bytearray(b"\1") * n
        i = queue.popleft()
        waiting[i] = 0
        near, own, mine = to[first[i] : first[i + 1]], int(c[i]), ks[i]
        if len(near) < MANY:
            into = {}
            for x, v in zip(c[near].tolist(), weight[first[i] : first[i + 1]].tolist(), strict=True):
                into[x] = into.get(x, 0.0) + v
        else:
            found, at = np.unique(c[near], return_inverse=True)
            into = dict(zip(found.tolist(), np.bincount(at, weights=weight[first[i] : first[i + 1]]).tolist(), strict=True))
        total[own] -= mine
        share = mine / twice
        best, most, least = own, 0.0, into.get(own, 0.0) - share * total[own] + _least(twice) / 2
        for x, v in into.items():
            gain = v - share * total[x]
            if gain > least and x != own:
                gain = round(gain, 9)
                if best == own or gain > most or gain == most and x < best:
                    best, most = x, gain
        total[best] += mine
        if best != own:
            c[i], moved = best, True
            for x in near[c[near] != best].tolist():
                if not waiting[x]:
                    waiting[x] = 1
                    queue.append(x)
    together = inner & (c[a] == c[b])
    x, y, root, before = a[together], b[together], np.arange(n), None
    while before is None or (root != before).any():
        before = root.copy()
        np.minimum.at(root, x, before[y])
        root = root[root]
    return pd.DataFrame({"node": names, "k": k, "c": names[c], "part": names[root]})


def _settled(links: DataFrame, at: DataFrame, twice: float) -> DataFrame:
    """at (node, k, c) after moves to better communities until none gains; at itself if none does."""
    divisor, turn, kept, best_now, held, left = 2, 0, at, -2.0, None, 0
    loops = links.filter("a = b").agg(F.sum("w")).first()[0] or 0.0
    while True:
        total = at.groupBy("c").agg(F.sum("k").alias("total"))
        near = links.filter("a <> b").join(at.select(F.col("node").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("into"))
        mine = at.select(F.col("node").alias("a"), F.col("c").alias("own"), "k").join(total.select(F.col("c").alias("own"), F.col("total").alias("own_total")), "own")
        options = mine.join(near, "a", "left").join(total, "c", "left")
        gain = F.round(F.coalesce("into", F.lit(0.0)) - F.col("k") * (F.col("total") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / twice, 9)
        alone = F.round(-F.col("k") * (F.col("own_total") - F.col("k")) / twice, 9)
        other = F.min(F.when(F.col("c") != F.col("own"), F.struct((-gain).alias("loss"), "c")))
        stay = F.max(F.when(F.col("c") == F.col("own"), F.struct(gain.alias("gain"), "into")))
        each = stored(options.groupBy("a", "own", "k", "own_total").agg(other.alias("other"), stay.alias("stay")).withColumn("now", F.coalesce("stay.gain", alone)), "options")
        gains = F.coalesce(-F.col("other.loss") - F.col("now") > _least(twice), F.lit(False))
        inside, squares, n = each.agg(F.coalesce(F.sum("stay.into"), F.lit(0.0)), F.sum(F.col("k") * F.col("own_total")), F.count_if(gains)).first()
        now = (inside + loops) / twice - squares / twice**2
        if now <= best_now + 1e-12:
            divisor *= 2
        else:
            kept, best_now, held, left = at, now, each, n
        if not left:
            return kept
        wants = held.filter(gains).select(F.col("a").alias("node"), F.col("other.c").alias("to"))
        own = min(divisor, left)
        some = lambda: wants.filter(F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(own)) == 0)  # noqa: B023, E731
        moves, turn = some(), turn + 1
        while left < 8 * own and not moves.limit(1).count():
            moves, turn = some(), turn + 1
        at = stored(kept.join(moves, "node", "left").select("node", "k", F.coalesce("to", "c").alias("c")), "at")


def _connected(links: DataFrame, at: DataFrame) -> DataFrame:
    """(node, c): communities cut into their connected parts, each named by its smallest node."""
    of = lambda end, name: at.select(F.col("node").alias(end), F.col("c").alias(name))
    inside = links.filter("a < b").join(of("a", "x"), "a").join(of("b", "y"), "b").filter("x = y").select("a", "b")
    parts = connected_components(inside)
    return stored(at.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("c")), "connected")


def modularity(edges: DataFrame, membership: DataFrame) -> float:
    """Of a partition (key, community), edges weighted by confidence."""
    w = F.coalesce(F.col("confidence"), F.lit(0.5))
    links = both_ways(edges.filter("src <> dst").withColumn("w", w), "w")
    of = lambda c, name: membership.select(F.col("key").alias(c), F.col("community").alias(name))
    total = links.agg(F.sum("w")).first()[0]
    inside = links.join(of("a", "x"), "a").join(of("b", "y"), "b").filter("x = y").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    squares = links.join(of("a", "x"), "a").groupBy("x").agg(F.sum("w").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0]
    return inside / total - squares / total**2


def view_clusters(component: DataFrame, edges: DataFrame, chunk: int = 5, most: int = 6, letters: int = 4) -> DataFrame:
    """(case_id, key, cluster): each case's components cut into chunks for display.

    component: key, case_id, component. Components of over `most` nodes are cut into runs of `chunk` sorted keys; the
    largest `letters` chunks of a case get the letters A, B, ..., and what is left joins the last of them.
    """
    size = component.groupBy("component").agg(F.count("*").alias("n"))
    placed = ranked(component, ["component"], [F.col("key")], "place").join(size, "component")
    cut = stored(placed.withColumn("part", F.when(F.col("n") > most, F.floor((F.col("place") - 1) / chunk)).otherwise(0)), "chunks")
    sizes = cut.groupBy("case_id", "component", "part").agg(F.count("*").alias("m"), F.min("key").alias("first"))
    rank = F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("m"), "first"))
    lettered = sizes.withColumn("rank", rank).filter(F.col("rank") < letters).select("component", "part", F.char(F.lit(64) + F.col("rank")).alias("letter"))
    rest = F.coalesce("letter", F.lit(chr(64 + letters)))
    return cut.join(lettered, ["component", "part"], "left").select("case_id", "key", rest.alias("cluster"))


#: Which domain an edge type stands for (fixed values); money transfers are financial.
DOMAINS = {"CALLED": "COMMUNICATION", "TRANSFERRED_MONEY_TO": "FINANCIAL", "PRESENT_AT": "LOCATION", "MET_AT": "LOCATION", "OWNS": "OWNERSHIP", "EMPLOYED_BY": "ORGANIZATION"}


def cluster_domains(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, cluster, nodes, domain): the domain of the most frequent edge type inside a cluster (ties: by name)."""
    of = lambda end, name: clusters.select(F.col("key").alias(end), F.col("cluster").alias(name))
    inside = edges.join(of("src", "x"), "src").join(of("dst", "y"), "dst").filter("x = y").groupBy("case_id", F.col("x").alias("cluster"), "edge_type").agg(F.count("*").alias("n"))
    top = inside.groupBy("case_id", "cluster").agg(F.min(F.struct(-F.col("n"), "edge_type"))["edge_type"].alias("edge_type"))
    domain = F.coalesce(*[F.when(F.col("edge_type") == k, F.lit(v)) for k, v in DOMAINS.items()], F.lit("GENERAL"))
    return clusters.groupBy("case_id", "cluster").agg(F.count("*").alias("nodes")).join(top, ["case_id", "cluster"], "left").select("case_id", "cluster", "nodes", domain.alias("domain"))
