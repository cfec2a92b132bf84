"""Graph reads: subgraphs, neighbourhoods, paths, timelines, degrees, bridges, rosters, snapshots.

nodes: key, case_id, node_type, value, confidence, ...; edges: src, dst, edge_type, case_id, confidence,
valid_from, ... All cases are in the same frames; keys carry the case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.operators.components import stored


def edge_id(edges: DataFrame) -> DataFrame:
    return edges.withColumn("edge_id", F.concat_ws("->", "src", "edge_type", "dst"))


def subgraph(nodes: DataFrame, edges: DataFrame, node_types: tuple[str, ...] | None = None, min_confidence: float = 0.0, since: str | None = None, until: str | None = None, dangling: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) by type, confidence and dates; undated edges pass date filters.

    Edges need both ends of an allowed type; with dangling, an end below min_confidence may be missing from the nodes.
    """
    from dossier.sources.domain import NODE_TYPES

    if unknown := set(node_types or ()) - set(NODE_TYPES):
        raise ValueError(f"unknown node types: {sorted(unknown)}")
    typed = nodes.filter(F.col("node_type").isin(*node_types)) if node_types else nodes
    kept = typed.filter(F.col("confidence") >= min_confidence)
    ends = (typed if dangling else kept).select("key")
    e = edges.filter(F.col("confidence") >= min_confidence)
    for bound, op in ((since, lambda c, v: c >= v), (until, lambda c, v: c <= v)):
        if bound:
            e = e.filter(F.col("valid_from").isNull() | op(F.col("valid_from"), F.lit(bound).cast("date")))
    e = e.join(ends.withColumnRenamed("key", "src"), "src", "left_semi").join(ends.withColumnRenamed("key", "dst"), "dst", "left_semi")
    return kept, e


def both_ways(edges: DataFrame, *extra: str) -> DataFrame:
    """(a, b, ...): every edge from either end."""
    there = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), *extra)
    return there.unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), *extra))


def neighbourhood(edges: DataFrame, centres: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes (key, hops), edges between them) within `depth` (1 to 3) steps of centres (key), whichever way edges point."""
    near = both_ways(edges).distinct()
    seen = centres.select("key", F.lit(0).alias("hops"))
    front = seen
    for hop in range(1, max(1, min(3, depth)) + 1):
        front = near.join(front.select(F.col("key").alias("a")), "a").select(F.col("b").alias("key")).distinct().join(seen, "key", "left_anti").withColumn("hops", F.lit(hop))
        front = stored(front, "front")
        seen = seen.unionByName(front)
    inside = seen.select("key")
    induced = edges.join(inside.withColumnRenamed("key", "src"), "src", "left_semi").join(inside.withColumnRenamed("key", "dst"), "dst", "left_semi")
    return seen, induced


#: Ends of a start from which on its paths are searched from the start alone: one search then serves them all.
MANY_ENDS = 8


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 4, many: int = MANY_ENDS) -> DataFrame:
    """(a, b, hops, path, evidence) for pairs (a, b) connected within max_hops (1 to 5), whichever way edges point.

    Parallel edges stand for their most confident one. Of equally short paths the one whose confidences, in order, are
    higher wins, then the smaller keys; a pair without a path has no row, a repeated pair has one. All pairs advance
    together: those of starts with up to `many` ends from both ends, so that no front is deeper than half of max_hops,
    the others from their start. Either way gives the same rows.
    """
    hops = max(1, min(5, max_hops))
    best = both_ways(edges, "edge_type", "confidence").groupBy("a", "b").agg(F.max(F.struct("confidence", "edge_type")).alias("e"))
    best = stored(best.select(F.col("a").alias("at"), F.col("b").alias("to"), "e.confidence", "e.edge_type"), "best-edges")
    asked = stored(pairs.select("a", "b").distinct(), "pairs")
    wide = asked.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > many).select("a")
    done = _from_starts(best, stored(asked.join(wide, "a", "left_semi"), "many-ends"), hops).unionByName(_from_both_ends(best, stored(asked.join(wide, "a", "left_anti"), "few-ends"), hops))
    return done.select("a", "b", (F.size("path") - 1).alias("hops"), F.concat_ws(" > ", "path").alias("path"), F.concat_ws(",", "types").alias("evidence"))


def distances(edges: DataFrame, pairs: DataFrame, max_hops: int = 4, many: int = MANY_ENDS) -> DataFrame:
    """(a, b, hops) for pairs (a, b) connected within max_hops (1 to 5), whichever way edges point: shortest_paths without the paths.

    Starts with more than `many` ends are searched together, 64 in a long (`_fronts`); pairs look up their bits at the node they
    end at. Other pairs are searched for themselves (`_closing`), so that few ends cost no front over the whole graph.
    """
    hops = max(1, min(5, max_hops))
    near = stored(both_ways(edges).distinct(), "near")
    asked = stored(pairs.select("a", "b").distinct(), "pairs")
    wide = asked.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > many).select("a")
    starts, fronts = _fronts(near, asked.join(wide, "a", "left_semi").select("a"), hops)
    told = asked.join(starts, "a").withColumnRenamed("b", "at")
    met = fronts.join(told, ["at", "block"]).filter(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("a", F.col("at").alias("b"), F.col("d").alias("hops"))
    return met.unionByName(_closing(near, asked.join(wide, "a", "left_anti"), hops))


def reached(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_hops: int = 4) -> DataFrame:
    """(a, b, hops) for starts (a, case_id) and ends (b, case_id) of one case connected within max_hops (1 to 5); further columns of both stay.

    The pairs are not spelt out before they are found: fronts that stand at ends are cut into their starts, as the last step.
    """
    numbered, fronts = _fronts(stored(both_ways(edges).distinct(), "near"), starts.select("a"), max(1, min(5, max_hops)))
    at = fronts.join(ends.withColumn("at", F.col("b")), "at")
    met = at.join(starts.join(numbered, "a"), ["block", "case_id"]).filter(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    return met.withColumnRenamed("d", "hops").drop("block", "case_id", "at", "bits", "bit")


def _fronts(near: DataFrame, asked: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """(starts (a, block, bit), fronts (at, block, bits, d)): which starts of a block first meet a node after d hops.

    Starts are numbered in order, and the fronts of 64 of them are one row a node, a bit for each, so a step moves a long for
    64 searches.
    """
    starts = asked.filter("a is not null").distinct().repartitionByRange("a").sortWithinPartitions("a").withColumn("n", F.monotonically_increasing_id())
    starts = stored(starts.select("a", F.shiftright("n", 6).alias("block"), F.expr("shiftleft(1L, cast(n % 64 as int))").alias("bit")), "starts")
    front = stored(starts.groupBy(F.col("a").alias("at"), "block").agg(F.bit_or("bit").alias("bits")).withColumn("d", F.lit(0)), "front")
    fronts = [front]
    for d in range(1, hops + 1):
        seen = reduce(DataFrame.unionByName, fronts).groupBy("at", "block").agg(F.bit_or("bits").alias("old"))
        step = front.join(near.withColumnRenamed("a", "at"), "at").groupBy(F.col("b").alias("at"), "block").agg(F.bit_or("bits").alias("bits"))
        new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0))))
        front = stored(step.join(seen, ["at", "block"], "left").select("at", "block", new.alias("bits"), F.lit(d).alias("d")).filter("bits <> 0"), "front")
        fronts.append(front)
    return starts, reduce(DataFrame.unionByName, fronts)


def _closing(near: DataFrame, asked: DataFrame, hops: int) -> DataFrame:
    """(a, b, hops): pairs are brought together step by step from whichever end has fewer neighbours.

    A step makes a pair one of a neighbour and the other end; pairs that several come to (two hubs, say) are one, so each is
    carried on once, and the hubs' links are read for pairs of hubs alone. How far pairs are apart is then told back, step by step.
    """
    degree = near.groupBy("a").agg(F.count("*").alias("n"))
    to = stored(near.join(degree.select(F.col("a").alias("b"), "n"), "b").select("a", "b", "n"), "links")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = asked.filter("a <> b").select(low.alias("x"), high.alias("y")).distinct()
    for end in ("x", "y"):
        now = now.join(degree.select(F.col("a").alias(end), F.col("n").alias(f"n{end}")), end)
    steps = []
    for _ in range(hops - 1):
        first = F.col("nx") <= F.col("ny")
        ends = now.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("o"), F.greatest("nx", "ny").alias("no"))
        less = F.col("b") <= F.col("o")
        step = ends.join(to, "a").select(
            F.least("a", "o").alias("x"), F.greatest("a", "o").alias("y"), F.least("b", "o").alias("u"), F.greatest("b", "o").alias("v"),
            F.when(less, F.col("n")).otherwise(F.col("no")).alias("nu"), F.when(less, F.col("no")).otherwise(F.col("n")).alias("nv"),
        )
        step = stored(step, "step")
        met = step.filter("u = v").select("x", "y")
        on = step.join(met, ["x", "y"], "left_anti")
        steps.append((met, on.select("x", "y", "u", "v")))
        now = stored(on.select(F.col("u").alias("x"), F.col("v").alias("y"), F.col("nu").alias("nx"), F.col("nv").alias("ny")).distinct(), "open")
    found = now.join(near.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_semi").select("x", "y", F.lit(1).alias("hops"))
    for met, on in reversed(steps):
        back = found.select(F.col("x").alias("u"), F.col("y").alias("v"), (F.col("hops") + 1).alias("hops")).join(on, ["u", "v"]).select("x", "y", "hops")
        found = back.unionByName(met.withColumn("hops", F.lit(1))).groupBy("x", "y").agg(F.min("hops").alias("hops"))
    own = asked.filter("a = b").select("a", "b", F.lit(0).alias("hops"))
    apart = asked.filter("a <> b").withColumns({"x": low, "y": high}).join(found, ["x", "y"]).select("a", "b", "hops")
    return own.unionByName(apart)


def _front(pairs: DataFrame, end: str) -> DataFrame:
    """(start, at, cost, path, types): where a search starts, a row for each different end."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return pairs.select(F.col(end).alias("start")).distinct().select("start", F.col("start").alias("at"), none("double").alias("cost"), F.array("start").alias("path"), none("string").alias("types"))


def _advanced(front: DataFrame, best: DataFrame, seen: DataFrame, onward: bool = True) -> DataFrame:
    """The next front: the best way to each node not seen yet, put together in the path's own order."""
    put = (lambda old, new: F.concat(old, F.array(new))) if onward else (lambda old, new: F.concat(F.array(new), old))
    step = front.join(best, "at").select("start", F.col("to").alias("at"), put(F.col("cost"), -F.col("confidence")).alias("cost"), put(F.col("path"), F.col("to")).alias("path"), put(F.col("types"), F.col("edge_type")).alias("types"))
    step = step.join(seen, ["start", "at"], "left_anti")
    return stored(step.groupBy("start", "at").agg(F.min(F.struct("cost", "path", "types")).alias("p")).select("start", "at", "p.cost", "p.path", "p.types"), "front")


def _from_starts(best: DataFrame, asked: DataFrame, hops: int) -> DataFrame:
    """(a, b, path, types): a front a start, which stops when all its ends are found."""
    front = _front(asked, "a")
    reached = lambda front: asked.join(front.select(F.col("start").alias("a"), F.col("at").alias("b"), "path", "types"), ["a", "b"])
    done, seen, left = reached(front), front.select("start", "at"), asked.filter("a <> b")
    for _ in range(hops):
        if not left.limit(1).count():
            break
        front = _advanced(front.join(left.select(F.col("a").alias("start")).distinct(), "start", "left_semi"), best, seen)
        seen, done = seen.unionByName(front.select("start", "at")), done.unionByName(reached(front))
        left = left.join(front.select(F.col("start").alias("a"), F.col("at").alias("b")), ["a", "b"], "left_anti")
    return done


def _from_both_ends(best: DataFrame, asked: DataFrame, hops: int) -> DataFrame:
    """(a, b, path, types): the fronts of both ends take turns and meet halfway; a pair that has met goes on no more.

    On a shortest path of d hops the node after (d + 1) // 2 of them is that far from a and d // 2 hops from b, so the first
    pair of fronts with a common node gives the distance, and the best halves at a node give the best path through it.
    """
    front = {end: _front(asked, end) for end in ("a", "b")}
    seen = {end: f.select("start", "at") for end, f in front.items()}
    done, left = asked.select("a", "b", F.array("a").alias("path"), F.array().cast("array<string>").alias("types")).filter("a = b"), asked.filter("a <> b")
    half = lambda end: front[end].select(F.col("start").alias(end), "at", F.struct("cost", "path", "types").alias(f"from_{end}"))
    for d in range(1, hops + 1):
        if not left.limit(1).count():
            break
        end = "a" if d % 2 else "b"
        front[end] = _advanced(front[end].join(left.select(F.col(end).alias("start")).distinct(), "start", "left_semi"), best, seen[end], onward=end == "a")
        seen[end] = seen[end].unionByName(front[end].select("start", "at"))
        met = left.join(half("a"), "a").join(half("b"), ["b", "at"])
        rest = F.slice("from_b.path", F.lit(2), F.size("from_b.path"))
        whole = F.struct(F.concat("from_a.cost", "from_b.cost").alias("cost"), F.concat("from_a.path", rest).alias("path"), F.concat("from_a.types", "from_b.types").alias("types"))
        found = stored(met.groupBy("a", "b").agg(F.min(whole).alias("p")).select("a", "b", "p.path", "p.types"), "met")
        done, left = done.unionByName(found), stored(left.join(found, ["a", "b"], "left_anti"), "left")
    return done


def timeline(nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Dated edges in order, with the values of both ends."""
    names = nodes.select("key", "value")
    out = edges.filter("valid_from is not null")
    for end in ("src", "dst"):
        out = out.join(names.select(F.col("key").alias(end), F.col("value").alias(f"{end}_value")), end)
    out = out.select("case_id", "valid_from", "edge_type", "src_value", "dst_value", "confidence")
    return out if limit is None else out.orderBy("valid_from", "src_value", "dst_value", "edge_type").limit(limit)


#: Which words in a line of the timeline make its category (checked in this order).
CATEGORIES = [("communication", "call|phone|contact"), ("financial", "money|transfer|paid"), ("movement", "present|location|met"), ("ownership", "own|vehicle")]


def timeline_category(edge_type_column: str = "edge_type"):
    t = F.lower(edge_type_column)
    return F.coalesce(*[F.when(t.rlike(words), F.lit(name)) for name, words in CATEGORIES], F.lit("other"))


def timeline_range(edges: DataFrame) -> DataFrame:
    return edges.filter("valid_from is not null").groupBy("case_id").agg(F.count("*").alias("n"), F.min("valid_from").alias("first"), F.max("valid_from").alias("last"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, case_id, degree), a row for each row of nodes: edges at a node, parallel ones each counting; lonely nodes have 0."""
    n = both_ways(edges).groupBy(F.col("a").alias("key")).agg(F.count("*").alias("degree"))
    return nodes.select("key", "case_id").join(n, "key", "left").fillna(0, ["degree"])


def bridges(metrics: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes whose neighbours span communities, or that lie on shortest paths; metrics: key, degree, betweenness, community."""
    near = both_ways(edges).distinct().join(metrics.select(F.col("key").alias("b"), "community").distinct(), "b")
    spans = near.groupBy(F.col("a").alias("key")).agg(F.count_distinct("community").alias("spans"))
    kinds = F.array_compact(F.array(F.when(F.col("spans") >= 2, F.lit("community")), F.when((F.col("betweenness") > 0) & (F.col("degree") >= 2), F.lit("broker"))))
    out = metrics.join(spans, "key", "left").fillna(0, ["spans"]).withColumn("kinds", kinds)
    return out.filter(F.size("kinds") > 0).select("key", "betweenness", "degree", "spans", F.concat_ws(",", "kinds").alias("kinds"))


def rosters(membership: DataFrame) -> DataFrame:
    """(community, key, size) from (key, community): a row a member, with the size of its community."""
    return membership.join(membership.groupBy("community").agg(F.count("*").alias("size")), "community").select("community", "key", "size")


def overview(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("case_id").agg(F.count("*").alias("nodes"), F.count_distinct("component").alias("components"), F.count_distinct("community").alias("communities"))


def top_players(metrics: DataFrame, n: int = 15) -> DataFrame:
    """The first n nodes of each case by PageRank, then degree; the window keeps n rows a case before it shuffles."""
    rank = F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("pagerank"), F.desc("degree"), "key"))
    return metrics.withColumn("rank", rank).filter(F.col("rank") <= n)


def snapshot(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node rows, edge rows, counts) as they are written under a snapshot id."""
    e = edge_id(edges)
    counts = nodes.agg(F.count("*").alias("nodes")).crossJoin(e.agg(F.count("*").alias("edges")))  # one row each
    return nodes, e, counts


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows only in new (added) or only in old (removed), by key, each with its own columns."""
    return new.join(old.select(key), key, "left_anti").withColumn("change", F.lit("added")).unionByName(old.join(new.select(key), key, "left_anti").withColumn("change", F.lit("removed")))


def evidence_trail(entities: DataFrame, relations: DataFrame, key: str, limit: int = 100) -> DataFrame:
    """An entity's relations from either side, the most confident first: two equi-joins rather than an OR."""
    own = entities.filter(F.col("key") == key).select("key")
    sides = [relations.join(own.withColumnRenamed("key", end), end, "left_semi").select("relation_id", "src", "dst", "edge_type", "confidence", "evidence_id") for end in ("src", "dst")]
    return reduce(DataFrame.union, sides).distinct().orderBy(F.desc("confidence"), "relation_id").limit(limit)


def latest_presence(edges: DataFrame) -> DataFrame:
    """The newest presence of each node at a place; undated ones are the oldest."""
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc_nulls_last("valid_from"), "relation_id"))
    return edges.filter("edge_type = 'PRESENT_AT'").withColumn("rank", rank).filter("rank = 1").drop("rank")


def trail(edges: DataFrame) -> DataFrame:
    """Each node's dated presences, the most confident for a place and date."""
    rank = F.row_number().over(W.partitionBy("src", "dst", "valid_from").orderBy(F.desc("confidence"), "relation_id"))
    return edges.filter("edge_type = 'PRESENT_AT' and valid_from is not null").withColumn("rank", rank).filter("rank = 1").select("case_id", "src", "dst", "valid_from", "confidence")
