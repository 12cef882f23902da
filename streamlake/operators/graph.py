"""Reachability over inheritance and lineage edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from streamlake.session import run_dir


def closure(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """All pairs ``(src, dst)`` joined by a path of at least one edge; cycles are fine.

    Every round doubles the path length: the pairs found last are extended by all known pairs,
    and what is already known is dropped. Rounds number the logarithm of the longest shortest
    path. New pairs are written to the shared folder, which keeps plans short, survives lost
    executors and tells the next join their true size. (A recursive CTE neither ends on a cycle
    nor passes a million rows by default.)
    """
    spark = edges.sparkSession
    root = run_dir(spark, "closure")
    rounds = [f"{root}/round=1"]
    edges.select(src, dst).distinct().write.parquet(rounds[0])
    fresh = known = spark.read.parquet(rounds[0])
    schema = known.schema
    while True:
        path = f"{root}/round={len(rounds) + 1}"
        step = known.select(F.col(src).alias(dst), F.col(dst).alias("next"))
        (fresh.join(step, dst).select(src, F.col("next").alias(dst)).distinct()
         .join(known, [src, dst], "left_anti").write.parquet(path))
        fresh = spark.read.schema(schema).parquet(path)
        if fresh.isEmpty():
            return known
        rounds.append(path)
        known = spark.read.schema(schema).parquet(*rounds)


def reflexive_closure(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """The closure with every node also reaching itself."""
    nodes = edges.select(F.explode(F.array(src, dst)).alias(src)).distinct()
    return (closure(edges.where(F.col(src) != F.col(dst)), src, dst)
            .where(F.col(src) != F.col(dst))
            .unionByName(nodes.withColumn(dst, F.col(src))))


def role_edges(roles: DataFrame) -> DataFrame:
    """Declared roles ``(name, includes)`` -> inheritance edges ``(role, parent)``."""
    return roles.select(F.col("name").alias("role"), F.explode("includes").alias("parent"))


def expand_roles(edges: DataFrame) -> DataFrame:
    """``(role, effective_role)``: what each role holds, itself included."""
    return reflexive_closure(edges, "role", "parent").withColumnRenamed("parent", "effective_role")


def role_holders(edges: DataFrame) -> DataFrame:
    """``(role, holder)``: who effectively holds each role, itself included."""
    return expand_roles(edges).select(F.col("effective_role").alias("role"),
                                      F.col("role").alias("holder"))


def group_roles(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """``(group_name, effective_role)`` of groups ``(name, roles)``."""
    direct = groups.select(F.col("name").alias("group_name"),
                           F.explode(F.array_distinct("roles")).alias("role"))
    inherited = direct.join(closure(edges, "role", "parent"), "role").select(
        "group_name", F.col("parent").alias("effective_role"))
    return direct.withColumnRenamed("role", "effective_role").unionByName(inherited).distinct()


def _kept(df: DataFrame, root: str, name: str) -> DataFrame:
    path = f"{root}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SPLICE_ROUNDS_LEFT = 0.01  # chain contraction stops when a round splices fewer nodes than this share


def strongly_connected(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``(node, component)``: the strongly connected component of every node of the edges, named by
    its smallest node; ``cyclic`` says whether the node lies on a cycle (a component of two or more
    nodes, or a loop of its own). No pairs of the closure are built.

    1. Chains are contracted: a node with one edge in and one edge out (``u -> v -> w``) is spliced
       out for an edge ``u -> w``; nodes are picked by a coin flip of their own and not when their
       predecessor is picked too, so a long chain halves in a few rounds and a cycle of any length
       ends as a loop. A spliced node belongs to the component of ``w`` exactly when ``u`` does.
    2. What is left is coloured: every node takes the smallest node that reaches it (forward labels);
       from each colour's own node, the nodes of its colour that reach it back form its component
       (backward reach). Found components are peeled off and the rest is coloured again.
    3. Spliced nodes are given their components in the reverse order of their rounds.
    Rounds are written below the shared folder.
    """
    spark = edges.sparkSession
    root = run_dir(spark, "components")
    graph = _kept(edges.select(F.col(src).alias("s"), F.col(dst).alias("d"))
                  .where(F.col("s").isNotNull() & F.col("d").isNotNull()).distinct(), root, "edges-0")
    nodes = graph.select(F.explode(F.array("s", "d")).alias("node")).distinct()
    spliced, turn = [], 0
    while True:
        turn += 1
        out = graph.groupBy(F.col("s").alias("node")).agg(F.count("*").alias("n_out"), F.first("d").alias("w"))
        into = graph.groupBy(F.col("d").alias("node")).agg(F.count("*").alias("n_in"), F.first("s").alias("u"))
        flip = F.pmod(F.xxhash64(F.col("node"), F.lit(turn)), F.lit(2)) == 1
        chain = (out.join(into, "node").where("n_out = 1 AND n_in = 1 AND u <> node AND w <> node")
                 .withColumn("heads", flip))
        heads = chain.where("heads").select("node", "u", "w")
        picked_before = heads.select(F.col("node").alias("u"))
        picked = _kept(heads.join(picked_before, "u", "left_anti").withColumn("round", F.lit(turn)),
                       root, f"spliced-{turn}")
        count = picked.count()
        if not count:
            break
        spliced.append(picked)
        gone = picked.select(F.col("node").alias("gone"))
        kept_edges = (graph.join(gone, graph["s"] == gone["gone"], "left_anti")
                      .join(gone, graph["d"] == gone["gone"], "left_anti"))
        graph = _kept(kept_edges.unionByName(picked.select(F.col("u").alias("s"), F.col("w").alias("d")))
                      .distinct(), root, f"edges-{turn}")
        if count < SPLICE_ROUNDS_LEFT * nodes.count():
            break

    left = graph.select(F.explode(F.array("s", "d")).alias("node")).distinct()
    found = []
    rest, rest_edges, peel = left, graph, 0
    while not rest.isEmpty():
        peel += 1
        colour = _kept(rest.withColumn("colour", F.col("node")), root, f"colour-{peel}-0")
        step = 0
        while True:
            step += 1
            offered = (rest_edges.join(colour.withColumnRenamed("node", "s"), "s")
                       .groupBy(F.col("d").alias("node")).agg(F.min("colour").alias("offer")))
            new = colour.join(offered, "node", "left").select(
                "node", F.least("colour", F.coalesce("offer", "colour")).alias("colour"),
                (F.col("offer") < F.col("colour")).alias("moved"))
            colour = _kept(new, root, f"colour-{peel}-{step}")
            if colour.where("moved").isEmpty():
                colour = colour.drop("moved")
                break
        reach = _kept(colour.withColumn("back", F.col("node") == F.col("colour")), root, f"back-{peel}-0")
        step = 0
        while True:
            step += 1
            c_s = reach.select(F.col("node").alias("s"), F.col("colour").alias("cs"))
            c_d = reach.where("back").select(F.col("node").alias("d"), F.col("colour").alias("cd"))
            reached = (rest_edges.join(c_s, "s").join(c_d, "d").where("cs = cd")
                       .select(F.col("s").alias("node")).distinct().withColumn("hit", F.lit(True)))
            new = reach.join(reached, "node", "left").select(
                "node", "colour", (F.col("back") | F.coalesce("hit", F.lit(False))).alias("back"),
                (~F.col("back") & F.coalesce("hit", F.lit(False))).alias("moved"))
            reach = _kept(new, root, f"back-{peel}-{step}")
            if reach.where("moved").isEmpty():
                break
        done = reach.where("back").select("node", F.col("colour").alias("component"))
        found.append(_kept(done, root, f"found-{peel}"))
        rest = reach.where("NOT back").select("node")
        rest = _kept(rest, root, f"rest-{peel}")
        gone = done.select(F.col("node").alias("gone"))
        rest_edges = _kept(rest_edges.join(gone, rest_edges["s"] == gone["gone"], "left_anti")
                           .join(gone, rest_edges["d"] == gone["gone"], "left_anti"), root, f"rest-edges-{peel}")

    components = found[0] if found else spark.createDataFrame([], "node string, component string")
    for more in found[1:]:
        components = components.unionByName(more)
    components = _kept(components, root, "components-residual")
    for picked in reversed(spliced):
        cu = components.select(F.col("node").alias("u"), F.col("component").alias("cu"))
        cw = components.select(F.col("node").alias("w"), F.col("component").alias("cw"))
        placed = picked.join(cu, "u").join(cw, "w").select(
            "node", F.when(F.col("cu") == F.col("cw"), F.col("cu")).otherwise(F.col("node")).alias("component"))
        components = _kept(components.unionByName(placed), root, f"components-{picked.first()['round']}")
    loops = graph.where("s = d").select(F.col("s").alias("node")).distinct().withColumn("loop", F.lit(True))
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    named = components.join(sizes, "component").join(loops, "node", "left")
    smallest = named.groupBy("component").agg(F.min("node").alias("name"))
    return (named.join(smallest, "component")
            .select("node", F.col("name").alias("component"),
                    ((F.col("size") > 1) | F.coalesce("loop", F.lit(False))).alias("cyclic")))
