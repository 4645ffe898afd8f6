"""Connected components: hash-to-min, and consolidation of pairwise matches by strip, compress, solve and restore.

All state is rows of two ids; no cluster is ever one value, and hot vertices meet broadcasts of bounded size.
Every round is a written table.  Rounds end on exact counts of changed rows, never on sums of hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.skew import HOT_ROWS, hot_list, skew_join
from vigil.session import Scratch

NEW, OLD = 1, 2  # a row of this round, of the round before


def _both_ways(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each edge once in each direction, by one pass over the edges."""
    return edges.select(F.explode(F.array(F.struct(F.col(a).alias("v"), F.col(b).alias("u")), F.struct(F.col(b).alias("v"), F.col(a).alias("u")))).alias("e")).select("e.*")


def _join(left: DataFrame, unique: DataFrame, key: str, how: str, most: int, hot: DataFrame) -> DataFrame:
    """A join with a side that is unique by the key; ``most`` is the number of rows of the hottest key on the left."""
    return skew_join(left, unique, key, how, hot) if most >= HOT_ROWS else left.join(unique, key, how)


def hash_to_min(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of a graph given as edges (a, b); the component is its smallest node.

    Every node v holds a cluster, at first its neighbours and itself, as rows (v, u).  In a round v sends its whole
    cluster to the smallest member and that member to the whole cluster; what a node receives is its next cluster.
    When nothing changes, the smallest node of each component holds all of it and the others hold that node.  The rows of
    the round before go through the aggregate that makes the next ones distinct, so that rows which only one of the two rounds
    has are counted there, exactly.
    Edges with a null end are left out; an edge of a node with itself keeps that node.
    """
    edges = edges.where("a is not null and b is not null").select("a", "b")
    start = _both_ways(edges).unionByName(_both_ways(edges.select("a", F.col("a").alias("b"))).unionByName(_both_ways(edges.select("b", F.col("b").alias("a")))))
    held = scratch.save(start.distinct())
    while True:
        least = scratch.save(held.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n")), most=F.max("n"))
        sent = _join(held, least.select("v", "m"), "v", "inner", scratch.watched(least, "most") or 0, hot_list(least, "v", "n"))
        rows = sent.select(F.explode(F.array(
            F.struct(F.col("m").alias("v"), F.col("u").alias("u"), F.lit(NEW).alias("i")),
            F.struct(F.col("u").alias("v"), F.col("m").alias("u"), F.lit(NEW).alias("i")),
            F.struct(F.col("v").alias("v"), F.col("u").alias("u"), F.lit(OLD).alias("i")),
        )).alias("e")).groupBy("e.v", "e.u").agg(F.bit_or("e.i").alias("_in"))
        following = scratch.save(rows, F.col("_in") != OLD, ("_in",), changed=F.count_if(F.col("_in") != NEW + OLD))
        scratch.drop(held)
        held = following
        if not scratch.watched(following, "changed"):
            return least.select(F.col("v").alias("node"), F.col("m").alias("component"))
        scratch.drop(least)


def _degrees(edges: DataFrame) -> DataFrame:
    return _both_ways(edges).groupBy("v").agg(F.count(F.lit(1)).alias("d"), F.min("u").alias("n1"), F.max("u").alias("n2"))


def _with_degrees(edges: DataFrame, degrees: DataFrame, most: int) -> DataFrame:
    """Edges with the degrees of both ends; hubs are looked up by broadcast."""
    hot = hot_list(degrees, "v", "d")
    for end, name in (("a", "da"), ("b", "db")):
        by = degrees.select(F.col("v").alias(end), F.col("d").alias(name))
        edges = _join(edges, by, end, "inner", most, hot.withColumnRenamed("v", end))
    return edges


def _strip(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Take off all vertices of degree one: (child, parent) and the edges left.  Of a lone edge the larger end goes."""
    degrees = scratch.save(_degrees(edges), most=F.max("d"))
    known = scratch.save(_with_degrees(edges, degrees, scratch.watched(degrees, "most") or 0))
    b_goes = F.col("db") == 1
    gone = known.where("da = 1 or db = 1").select(
        F.when(b_goes, F.col("b")).otherwise(F.col("a")).alias("child"), F.when(b_goes, F.col("a")).otherwise(F.col("b")).alias("parent")
    )
    gone = scratch.save(gone)
    left = scratch.save(known.where("da > 1 and db > 1").select("a", "b"))
    scratch.drop(degrees, known)
    return gone, left


def _compress(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Replace chains of degree-two vertices by one edge between their ends: (child, parent) and the new edges.

    List ranking by pointer doubling: each chain vertex v looks out both ways.  (v, first) reaches ``head`` over
    ``hops`` steps and would go on to ``onward``; after k rounds it has seen 2^k vertices, so chains of any depth
    take a logarithmic number of rounds.  A cycle of chain vertices has no end.  Once a round ends no chain and lowers the
    smallest member seen from no vertex (both are counted), the cycles' vertices all know their smallest: along steps of 2^k that
    member can't fall all the way round a cycle, and windows of 2^k vertices at these steps cover it.
    """
    degrees = scratch.save(_degrees(edges), most=F.max("d"))
    known = scratch.save(_with_degrees(edges, degrees, scratch.watched(degrees, "most") or 0))
    inner = degrees.where("d = 2").select("v", "n1", "n2")
    looks = inner.select("v", F.explode(F.array("n1", "n2")).alias("first"))
    heads = inner.select(F.col("v").alias("head"), "n1", "n2")
    rank = scratch.save(
        looks.withColumn("head", F.col("first")).join(heads, "head", "left").select(
            "v", "first", "head", F.when(F.col("n1") == F.col("v"), F.col("n2")).otherwise(F.col("n1")).alias("onward"),
            F.lit(1).cast("long").alias("hops"), F.least("v", "head").alias("low"),
        ),
        open=F.count("onward"),
    )
    while scratch.watched(rank, "open"):
        there = rank.select(F.col("v").alias("head"), F.col("first").alias("onward"), F.col("head").alias("head2"), F.col("onward").alias("onward2"), F.col("hops").alias("hops2"), F.col("low").alias("low2"))
        stepped = rank.where("onward is not null").join(there, ["head", "onward"]).select(
            "v", "first", F.col("head2").alias("head"), F.col("onward2").alias("onward"), (F.col("hops") + F.col("hops2")).alias("hops"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("_fell")
        )
        following = scratch.save(
            rank.where("onward is null").withColumn("_fell", F.lit(False)).unionByName(stepped), F.lit(True), ("_fell",), open=F.count("onward"), fell=F.count_if("_fell"),
        )
        still = scratch.watched(following, "open") == scratch.watched(rank, "open") and not scratch.watched(following, "fell")
        scratch.drop(rank)
        rank = following
        if still:
            break
    ends = rank.groupBy("v").agg(F.min(F.when(F.col("onward").isNull(), F.col("head"))).alias("e1"), F.max(F.when(F.col("onward").isNull(), F.col("head"))).alias("e2"), F.min("low").alias("low"))
    ends = scratch.save(ends)
    gone = scratch.save(ends.select(F.col("v").alias("child"), F.coalesce("e1", "low").alias("parent")).where("child <> parent"))
    chains = ends.where("e1 < e2").select(F.col("e1").alias("a"), F.col("e2").alias("b"))
    left = scratch.save(known.where("da <> 2 and db <> 2").select("a", "b").unionByName(chains).distinct())
    scratch.drop(degrees, known, rank, ends)
    return gone, left


def _resolve(points: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, up) with every pointer (node, up) followed to its end, by pointer doubling; pointers have no cycle.

    All removed vertices are resolved together, in as many rounds as the logarithm of the number of layers they were removed in.
    """
    points = scratch.save(points)
    while True:
        counts = scratch.save(points.groupBy("up").agg(F.count(F.lit(1)).alias("n")), most=F.max("n"))
        further = points.select(F.col("node").alias("up"), F.col("up").alias("_up"))
        joined = _join(points, further, "up", "left", scratch.watched(counts, "most") or 0, hot_list(counts, "up", "n"))
        following = scratch.save(joined.select("node", F.coalesce("_up", "up").alias("up"), F.col("_up").isNotNull().alias("_moved")), F.lit(True), ("_moved",), moved=F.count_if("_moved"))
        scratch.drop(points, counts)
        points = following
        if not scratch.watched(following, "moved"):
            return points


def consolidate(pairs: DataFrame, a: str, b: str, scratch: Scratch | None = None, shrink: float = 0.8) -> DataFrame:
    """(node, group): every node of a pair with both ends, and the smallest node it is tied to, directly or not.

    Degree-one vertices are stripped and chains compressed as long as a round leaves at most ``shrink`` of the
    edges; the reduced core is solved by hash-to-min.  Removed vertices point to the vertex that stood for them, core vertices to
    their component, and all pointers are followed together.  Pairs with a null end are left out, repeated and turned pairs
    count once, and a node paired only with itself is its own group.  No pairs give no rows.
    """
    scratch = scratch or Scratch(pairs.sparkSession)
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    all_edges = scratch.save(both)
    edges = scratch.save(all_edges.where("a <> b"))
    removed: list[DataFrame] = []
    while scratch.count(edges):
        before = scratch.count(edges)
        for step in (_strip, _compress):
            if not scratch.count(edges):
                break
            gone, left = step(edges, scratch)
            scratch.drop(edges)
            edges = left
            removed.append(gone)
        if scratch.count(edges) > shrink * before:
            break
    points = None
    for gone in (x for x in removed if scratch.count(x)):
        up = gone.select(F.col("child").alias("node"), F.col("parent").alias("up"))
        points = up if points is None else points.unionByName(up)
    if scratch.count(edges):
        core = hash_to_min(edges, scratch).where("node <> component").select("node", F.col("component").alias("up"))
        points = core if points is None else points.unionByName(core)
    alone = all_edges.where("a = b").select(F.col("a").alias("node"))
    if points is None:
        return alone.select("node", F.col("node").alias("group"))
    ends = _resolve(points, scratch)
    # a class is known by its end, which is itself a member; its smallest member names it
    tops = scratch.save(ends.groupBy("up").agg(F.least(F.min("node"), F.col("up")).alias("group"), F.count(F.lit(1)).alias("n")), most=F.max("n"))
    low = _join(ends, tops.select("up", "group"), "up", "inner", scratch.watched(tops, "most") or 0, hot_list(tops, "up", "n"))
    tied = low.select("node", "group").unionByName(tops.select(F.col("up").alias("node"), "group"))
    lone = alone.join(edges_nodes(all_edges), "node", "left_anti")
    return tied.unionByName(lone.select("node", F.col("node").alias("group")))


def edges_nodes(edges: DataFrame) -> DataFrame:
    """Nodes of edges between two different nodes."""
    return edges.where("a <> b").select(F.explode(F.array("a", "b")).alias("node")).distinct()
