"""Common neighbours, triangles, clustering, and the steps of a merge intersection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.operators import merges
from fathom.operators.graph import Graph, small
from fathom.plans.staging import Workspace, checkpoint, free_shuffles

#: So many neighbours, in the lists of whole vertices, are broadcast at a time (32 MB).
BLOCK = 4_000_000
#: Vertices of more neighbours are hubs: their edges are counted by triangles, since to compare lists would cost the square of the degree.
HUB = 5_000


def oriented(graph: Graph) -> DataFrame:
    """Each edge once, from lower to higher (degree, id), which bounds the out-degree by the root of twice the edge count: a hub does not
    make the square of its degree in wedges."""
    deg = graph.degrees()
    ranked = graph.edges.join(deg.select(F.col("id").alias("src"), F.col("deg").alias("ds")), "src").join(deg.select(F.col("id").alias("dst"), F.col("deg").alias("dd")), "dst")
    return ranked.where("ds < dd or (ds = dd and src < dst)").select("src", "dst")


def triangle_count(graph: Graph) -> DataFrame:
    """(triangles): one row, from the short neighbour lists of oriented edges, without a row a wedge."""
    lists = oriented(graph).groupBy("src").agg(F.collect_list("dst").alias("out"))
    ends = lists.select("out", F.explode("out").alias("dst")).join(lists.select(F.col("src").alias("dst"), F.col("out").alias("far")), "dst")
    return ends.agg(F.coalesce(F.sum(F.size(F.array_intersect("out", "far"))), F.lit(0)).cast("long").alias("triangles"))


def triangles_oriented(graph: Graph) -> DataFrame:
    """Each triangle once as (a, b, c)."""
    up = oriented(graph)
    wedges = up.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(up.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b")
    return wedges.join(up.select(F.col("src").alias("a"), F.col("dst").alias("c")), ["a", "c"]).select("a", "b", "c")


def edge_counts(graph: Graph) -> DataFrame:
    """(src, dst, triangles, intersect_ops) for every directed edge, edges without a common neighbour included; ``intersect_ops`` is the
    sum of both degrees, which is what intersecting two sorted lists costs.

    Neighbour lists are written once.  Those of a block of vertices at a time are broadcast and meet the edges in the lists of all others,
    so neither a wedge nor a list on an edge is ever shuffled.  Only what touches a hub goes by triangles.
    """
    space = Workspace(graph.edges.sparkSession)
    lists = space.put("lists", graph.adjacency())
    total, most = lists.agg(F.coalesce(F.sum("deg"), F.lit(0)), F.coalesce(F.max("deg"), F.lit(0))).first()
    blocks = max(1, -(-total // BLOCK))
    free_shuffles(space.spark)
    light = lists.where(F.col("deg") <= HUB)
    near = light.select(F.col("id").alias("src"), F.col("deg").alias("a"), "nbrs", F.explode("nbrs").alias("dst")).where("src < dst")
    far = light.select(F.col("id").alias("dst"), F.col("deg").alias("b"), F.col("nbrs").alias("far"))

    def part(k: int) -> DataFrame:
        here = F.pmod(F.xxhash64("dst"), F.lit(blocks)) == k
        both = near.where(here).join(F.broadcast(far.where(here)), "dst")
        return both.select("src", "dst", F.size(F.array_intersect("nbrs", "far")).cast("long").alias("triangles"), (F.col("a") + F.col("b")).alias("intersect_ops"))

    if blocks == 1:
        once = part(0)
    else:
        for k in range(blocks):
            space.put(f"counts/block={k}", part(k))
        once = space.get("counts", part(0).schema)
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    out = once.select(F.explode(ends).alias("e"), "triangles", "intersect_ops").select("e.*", "triangles", "intersect_ops")
    return out.unionByName(hub_counts(lists, space)) if most > HUB else out


def hub_counts(lists: DataFrame, space: Workspace) -> DataFrame:
    """``edge_counts`` of the edges with an end of more than HUB neighbours, from the triangles with such a vertex.  The last vertex of an
    oriented triangle has the largest degree, so it is one."""
    edges = lists.select(F.col("id").alias("src"), F.col("deg").alias("a"), F.explode("nbrs").alias("dst"))
    edges = space.put("ends", edges.join(lists.select(F.col("id").alias("dst"), F.col("deg").alias("b")), "dst"))
    up = edges.where("a < b or (a = b and src < dst)")
    top = up.where(F.col("b") > HUB)
    t = up.select(F.col("src").alias("v"), F.col("dst").alias("w")).join(top.select(F.col("src").alias("v"), F.col("dst").alias("hub")), "v").join(top.select(F.col("src").alias("w"), F.col("dst").alias("hub")), ["w", "hub"])
    names = ("v", "w", "hub")
    pairs = t.select(F.explode(F.array(*[F.struct(F.col(p).alias("src"), F.col(q).alias("dst")) for p in names for q in names if p != q])).alias("e")).select("e.*")
    found = pairs.groupBy("src", "dst").agg(F.count("*").alias("triangles"))
    heavy = edges.where((F.col("a") > HUB) | (F.col("b") > HUB))
    return heavy.join(found, ["src", "dst"], "left").select("src", "dst", F.coalesce("triangles", F.lit(0)).alias("triangles"), (F.col("a") + F.col("b")).alias("intersect_ops"))


def edge_triangles(graph: Graph) -> DataFrame:
    """(src, dst, triangles) for every directed edge, edges without a common neighbour included."""
    return edge_counts(graph).select("src", "dst", "triangles")


def edge_intersections(graph: Graph) -> DataFrame:
    """(src, dst, triangles, intersect_ops): see ``edge_counts``."""
    return edge_counts(graph)


def triangle_total(per_edge: DataFrame) -> DataFrame:
    """Sum over directed edges, which is six times the number of triangles."""
    return per_edge.agg(F.coalesce(F.sum("triangles"), F.lit(0)).cast("long").alias("directed_sum")).withColumn("triangles", F.col("directed_sum").cast("long") / 6).withColumn("triangles", F.col("triangles").cast("long"))


def intersect_ops(graph: Graph) -> DataFrame:
    """Sum over directed edges of both end degrees = twice the sum of squared degrees; no join needed."""
    return graph.degrees().agg(F.coalesce(F.sum(2 * F.col("deg") * F.col("deg")), F.lit(0)).cast("long").alias("intersect_ops"))


def vertex_triangles(graph: Graph, per_edge: DataFrame | None = None) -> DataFrame:
    """(id, deg, triangles): sum of the common-neighbour counts of a vertex's out-edges, of which it has one a neighbour."""
    each = (edge_triangles(graph) if per_edge is None else per_edge).select(F.col("src").alias("id"), F.lit(1).cast("long").alias("deg"), "triangles")
    if graph.isolated is not None:
        zero = F.lit(0).cast("long")
        each = each.unionByName(graph.isolated.select(F.col("id").cast("long"), zero.alias("deg"), zero.alias("triangles")))
    return each.groupBy("id").agg(F.sum("deg").alias("deg"), F.sum("triangles").cast("long").alias("triangles"))


def clustering(per_vertex: DataFrame, legacy: bool = False) -> DataFrame:
    """(id, deg, triangles, cc).  ``legacy`` divides by deg^2 - 1 instead of deg * (deg - 1); degree below 2 gives 0 in both."""
    d = F.col("deg")
    return per_vertex.withColumn("cc", F.when(d > 1, F.col("triangles") / (d * d - 1 if legacy else d * (d - 1))).otherwise(F.lit(0.0)))


def mean_clustering(local: DataFrame, extra_vertices: int = 0) -> DataFrame:
    """Mean over all vertices; ``extra_vertices`` counts dummies into the divisor."""
    return local.agg(F.try_divide(F.sum("cc"), F.count("*") + F.lit(extra_vertices)).alias("mean_cc"))


def merge_steps(graph: Graph) -> DataFrame:
    """(src, dst, steps): memory operations of a two-pointer merge, 2 per match and 1 per mismatch, in closed form.

    With overlapping ranges the merge consumes exactly the elements not above the smaller of both maxima.  How many neighbours of a vertex
    those are is a running count over its neighbours and the limits of its edges together, so a hub costs its degree, not its square.
    """
    ends = graph.edges.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("low"), F.max("dst").alias("high"))
    e = graph.edges.join(ends.select(F.col("id").alias("src"), F.col("low").alias("la"), F.col("high").alias("ha")), "src").join(ends.select(F.col("id").alias("dst"), F.col("low").alias("lb"), F.col("high").alias("hb")), "dst")
    e = e.select("src", "dst", F.greatest("la", "lb").alias("lo"), F.least("ha", "hb").alias("hi"))
    # a neighbour counts for limits from its own value on
    marks = e.select("src", F.col("dst").alias("at"), F.lit(1).alias("n"), F.lit(None).cast("long").alias("dst"), "lo", "hi").unionByName(e.select("src", F.col("hi").alias("at"), F.lit(0).alias("n"), "dst", "lo", "hi"))
    upto = Window.partitionBy("src").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = marks.withColumn("c", F.sum("n").over(upto)).where("dst is not null").select("src", "dst", F.when(F.col("lo") <= F.col("hi"), F.col("c")).otherwise(0).alias("c"))
    both = own.join(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("c").alias("other")), ["src", "dst"])
    return both.select("src", "dst", (F.col("c") + F.col("other")).cast("long").alias("steps"))


def list_offsets(degrees: DataFrame) -> DataFrame:
    """(id, off): where a vertex's list begins in the concatenation of all by ascending id.  The running sum has two levels, blocks of ids
    and then inside each block, so no window holds the whole graph."""
    d = degrees.select("id", "deg", (F.col("id").cast("long") - F.pmod("id", F.lit(65536))).alias("block"))
    heads = d.groupBy("block").agg(F.sum("deg").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.coalesce(F.sum("deg").over(Window.partitionBy("block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("inside", inside).join(heads, "block").select("id", (F.col("base") + F.col("inside")).cast("long").alias("off"))


def steps_of(edges: DataFrame, adj: DataFrame) -> DataFrame:
    """The merge trace of ``edges(src, dst)`` from ``adj(id, nbrs, off)``."""
    e = edges.join(adj.select(F.col("id").alias("src"), F.col("nbrs").alias("a"), F.col("off").alias("oa")), "src").join(adj.select(F.col("id").alias("dst"), F.col("nbrs").alias("b"), F.col("off").alias("ob")), "dst")
    lo, hi = F.greatest(F.element_at("a", 1), F.element_at("b", 1)), F.least(F.element_at("a", -1), F.element_at("b", -1))
    side = lambda c, off, k: F.transform(F.filter(c, lambda x: (x <= hi) & (lo <= hi)), lambda x, i: F.struct(x.alias("v"), F.lit(k).alias("side"), (F.col(off) + i).cast("long").alias("addr")))
    merged = F.array_sort(F.concat(side("a", "oa", 0), side("b", "ob", 1)))
    return e.select("src", "dst", F.posexplode(merged).alias("step", "x")).select("src", "dst", F.col("step").cast("long"), F.col("x.side").alias("side"), F.col("x.addr").alias("addr"))


def packed_lists(graph: Graph) -> DataFrame:
    """The blocks of ``merges.pack``, one a partition.  Each edge is written once before its two directions are shuffled."""
    space = Workspace(graph.edges.sparkSession)
    once = space.put("once", graph.edges.where("src < dst"))
    free_shuffles(space.spark, 0.5)
    lists = space.put("lists", Graph(once.unionByName(once.select(F.col("dst").alias("src"), F.col("src").alias("dst")))).adjacency())
    space.drop("once")
    off = space.put("offsets", list_offsets(lists))
    free_shuffles(space.spark)
    vertices, total = lists.agg(F.count("*"), F.coalesce(F.sum("deg"), F.lit(0))).first()
    size = min(merges.BLOCK, max(merges.LEAST_BLOCK, -(-total // merges.SPREAD)))
    part = F.floor(F.col("off") / size).cast("int")
    starts = sorted(tuple(r) for r in off.groupBy(part.alias("block")).agg(F.min("id")).collect())
    dealt = lists.join(small(off, vertices), "id").withColumn("block", part)
    dealt = dealt.repartitionById(max([0, *dict(starts)]) + 1, "block").sortWithinPartitions("block", "id")
    blocks = checkpoint(merges.pack(dealt, starts))
    space.drop()
    return blocks


def merge_trace(graph: Graph) -> DataFrame:
    """(src, dst, step, side, addr): the positions a merge touches, the first list before the second on ties.

    ``addr`` is the position in the concatenation of all neighbour lists by ascending vertex id.  Lists are packed in blocks of vertices, and
    each pair of blocks meets in a task, so no list goes through a shuffle with an edge, or once for each of its neighbours' blocks.
    """
    blocks = packed_lists(graph)
    free_shuffles(blocks.sparkSession, 0.5)
    return merges.merge(blocks)


def merge_trace_start(graph: Graph, n: int) -> DataFrame:
    """``merge_trace`` of the first edges by (src, dst), so many that it has the first ``n`` rows of the whole: the steps of an edge ask
    for no other edge's, so only their lists are merged.  Edges may have no steps; then more are taken, up to all."""
    space = Workspace(graph.edges.sparkSession)
    lists = space.put("lists", graph.adjacency())
    free_shuffles(space.spark)
    edges, off, k = lists.select(F.col("id").alias("src"), F.explode("nbrs").alias("dst")), space.put("offsets", list_offsets(lists)), max(n, 1)
    while True:
        some = space.put(f"first{k}", edges.orderBy("src", "dst").limit(k))
        ids = some.select(F.col("src").alias("id")).unionByName(some.select(F.col("dst").alias("id"))).distinct()
        trace = steps_of(some, space.put(f"near{k}", lists.join(small(ids, 2 * k), "id", "left_semi").join(off, "id")))
        if some.count() < k or trace.limit(n).count() >= n:
            return trace
        k *= 16
