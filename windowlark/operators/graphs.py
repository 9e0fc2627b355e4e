"""Closeness of the nodes of any graph, by a distinct-count sketch of each node's ball.

A node starts with a sketch of itself. In round t every node unites its sketch with those of its neighbours, so that it
estimates how many nodes lie within t steps; what a round adds, times t, sums up to the distances to all nodes that can
be reached. Nobody holds a set of nodes, and the work is one join and one grouping of sketches a round. Only nodes
whose sketch grew in the last round send it on. Nodes with the same neighbours (the leaves of a hub, say) are equally far from all
others, so they share a row: what it sends is a sketch of all their balls, and its own ball is that of one of them. Sketches and their unions are Spark's own functions, so all of it stays in the JVM.

Small balls are counted exactly (to about 2^lg_k / 11 nodes); beyond, the relative standard error of a ball is about 1.04 / sqrt(2^lg_k).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowlark.session import discard, materialize

#: 2^LG_K registers a sketch: 4 KB, 1.6 percent error.
LG_K = 12


def closeness_edges(
    edges: DataFrame, src: str = "src", dst: str = "dst", nodes: DataFrame | None = None, node: str = "node", directed: bool = False,
    lg_k: int = LG_K, max_rounds: int | None = None,
) -> DataFrame:
    """(node, reach, distances, closeness) of every node, as a written table.

    reach counts the nodes with a path to the node, itself included, distances sums their shortest paths, and
    closeness is ``(reach - 1) / distances * (reach - 1) / (n - 1)``, 0 for a node that nothing reaches. Edges go both ways unless
    ``directed``; loops and repeated edges change nothing; an edge with a null end only names its other end. ``nodes`` adds nodes
    without edges. There are as many rounds as the longest shortest path has steps, unless ``max_rounds`` ends earlier. A hub
    receives unions combined map-side, and what it sends is a skewed join that adaptive execution splits.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    turned = ends.select(F.col("b").alias("a"), F.col("a").alias("b"))
    named = ends.select(F.explode(F.array("a", "b")).alias("node"))
    if nodes is not None:
        named = named.unionByName(nodes.select(F.col(node).alias("node")))
    named = materialize(named.where("node is not null").distinct())
    steps = materialize((ends if directed else ends.unionByName(turned)).where("a is not null and b is not null and a != b").distinct())

    members = materialize(_twins(named, steps, directed))
    of = members.select(F.col("node").alias("a"), F.col("twins").alias("from")), members.select(F.col("node").alias("b"), F.col("twins").alias("to"))
    between = materialize(steps.join(of[0], "a").join(of[1], "b").select("from", "to").distinct())
    discard(steps)

    whole = F.hll_sketch_agg(F.col("node").cast("string"), F.lit(lg_k)).alias("sketch")
    groups = members.groupBy("twins").agg(whole, F.min("node").alias("one"), F.count("*").alias("size"))
    # every group is one node: the sketch of a single value
    single = F.hll_sketch_agg(F.col("one").cast("string"), F.lit(lg_k)).alias("own")
    shared = groups.where("size > 1").groupBy("twins").agg(single)
    state = materialize(groups.select("twins", "sketch").join(shared, "twins", "left").withColumns(
        {"reach": F.lit(1).cast("bigint"), "distances": F.lit(0).cast("bigint"), "grew": F.lit(True)}))
    done = 0
    while max_rounds is None or done < max_rounds:
        done += 1
        sent = state.where("grew").select(F.col("twins").alias("from"), "sketch").join(between, "from").select(F.col("to").alias("twins"), F.col("sketch").alias("sent"))
        here = state.select("twins", "sketch", "own", "reach", "distances")
        met = sent.unionByName(here, allowMissingColumns=True)
        merged = met.groupBy("twins").agg(
            F.hll_union_agg("sent").alias("sent"), F.max("sketch").alias("sketch"), F.max("own").alias("own"),
            F.max("reach").alias("was"), F.max("distances").alias("so_far"), F.count("sent").alias("came"),
        )
        # the sketch of nothing would not fit: it does not know lg_k
        merged = merged.withColumns({c: F.when(F.col("came") > 0, F.hll_union(c, "sent")).otherwise(F.col(c)) for c in ("sketch", "own")})
        # an estimate of a union is never let fall below what was reached before
        reach = F.greatest(F.hll_sketch_estimate(F.coalesce("own", "sketch")), "was")
        grown = merged.withColumn("reach", reach).select(
            "twins", "sketch", "own", "reach", (F.col("so_far") + done * (F.col("reach") - F.col("was"))).alias("distances"), (F.col("reach") > F.col("was")).alias("grew")
        )
        after = materialize(grown)
        discard(state)
        state = after
        if state.where("grew").isEmpty():
            break
    n = named.count()
    near = (F.col("reach") - 1) / F.col("distances") * (F.col("reach") - 1) / F.lit(max(n - 1, 1))
    closeness = F.when(F.col("distances") > 0, near).otherwise(0.0).alias("closeness")
    result = materialize(members.join(state.select("twins", "reach", "distances"), "twins").select("node", "reach", "distances", closeness))
    discard(state, named, members, between)
    return result


def _twins(named: DataFrame, steps: DataFrame, directed: bool) -> DataFrame:
    """(node, twins): nodes with the same neighbours, in both directions, have the same ``twins``.

    A set of neighbours is known by its size and two differently seeded 64-bit hashes, added up map-side, so that no set is collected.
    """

    def known(own: str, other: str) -> DataFrame:
        hashes = [F.bit_xor(F.xxhash64(other)), F.bit_xor(F.xxhash64(F.lit(1), other))]
        return steps.groupBy(F.col(own).alias("node")).agg(F.struct(F.count("*").alias("n"), *[h.alias(n) for h, n in zip(hashes, "hg", strict=True)]).alias(own))

    found = named.join(known("b", "a"), "node", "left")
    if directed:
        found = found.join(known("a", "b"), "node", "left")
    # a node without any neighbours has zeros
    sides = [F.coalesce(f"{side}.{c}", F.lit(0).cast("bigint")).alias(f"{side}_{c}") for side in ("ba" if directed else "b") for c in "nhg"]
    return found.select("node", F.struct(*sides).alias("twins"))
