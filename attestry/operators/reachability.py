"""Reachability over a reference graph by condensation.

Sources are peeled off in rounds, which gives each node its level in a graph without cycles. What can't be peeled holds cycles:
its strongly connected components are found by colouring (the greatest name that reaches a node is its colour; of a colour,
what reaches the node of that name is one component), each becomes one node, and the peeling is done again. Then the asked roots
walk down level by level. A root reaches a component at one level only, after all that could bring it there, so each pair of root
and component is expanded once and never compared with what was seen before. Rounds are bounded by the depth of the graph.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.session import new_table, stored, tune

#: Rounds planned at once; their joins share one partitioning.
UNROLL = 4


def _clean(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()


def peeled(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst, level) of the edges whose source could be peeled off, in the round of that level, and (src, dst) of the others."""
    spark = edges.sparkSession
    done, live, level = None, stored(edges), 0
    left = live.count()
    while left:
        now = live.withColumn("level", F.lit(None).cast("int"))
        for _ in range(UNROLL):
            entered = now.filter("level IS NULL").select(F.col("dst").alias("src")).distinct().withColumn("entered", F.lit(True))
            gone = F.col("level").isNull() & F.col("entered").isNull()
            now = now.join(entered, "src", "left").select("src", "dst", F.when(gone, level).otherwise(F.col("level")).cast("int").alias("level"))
            level += 1
        now = stored(now)
        off, live = now.filter("level IS NOT NULL"), now.filter("level IS NULL").select("src", "dst")
        done = off if done is None else done.unionByName(off)
        before, left = left, live.count()
        if left == before:
            break
    return (done if done is not None else spark.createDataFrame([], edges.schema).withColumn("level", F.lit(0))), live


def _flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def components_of_cycles(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of strongly connected components of several nodes; a component is named by its greatest node."""
    found = None
    while True:
        # Only nodes between cycles are left once both ends are peeled off.
        _, edges = peeled(edges)
        _, edges = peeled(_flipped(edges))
        edges = stored(_flipped(edges))
        if edges.isEmpty():
            return found
        nodes = edges.select(F.col("src").alias("node")).distinct()
        colours = stored(nodes.withColumn("colour", F.col("node")))
        while True:
            now = colours.withColumn("first", F.col("colour"))
            for _ in range(UNROLL):
                sent = edges.join(now.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("sent"))
                now = now.join(sent, "node", "left").select("node", F.greatest("colour", "sent").alias("colour"), "first")
            now = stored(now)
            colours = now.select("node", "colour")
            if now.filter("colour <> first").isEmpty():
                break
        of = lambda end: colours.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))
        inside = stored(edges.join(of("src"), "src").join(of("dst"), "dst").filter("src_colour = dst_colour").select("src", "dst"))
        frontier = reached = stored(colours.filter("node = colour"))
        while True:
            back = frontier.select(F.col("node").alias("dst"), "colour").join(inside, "dst").select(F.col("src").alias("node"), "colour").distinct()
            frontier = stored(back.join(reached.select("node"), "node", "left_anti"))
            if frontier.isEmpty():
                break
            reached = reached.unionByName(frontier)
        named = stored(reached.select("node", F.col("colour").alias("component")))
        found = named if found is None else found.unionByName(named)
        gone = named.select("node")
        edges = edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")


def condensed(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(src, dst, level) between components, level being that of the source, and (node, component) of those of several nodes."""
    edges = stored(_clean(edges))
    levels, rest = peeled(edges)
    if rest.isEmpty():
        return levels, None
    groups = components_of_cycles(rest)
    dag = _clean(_renamed(_renamed(edges, groups, "src"), groups, "dst"))
    levels, rest = peeled(dag)
    assert rest.isEmpty()
    return levels, groups


def _renamed(df: DataFrame, groups: DataFrame | None, column: str) -> DataFrame:
    """`column` by its component; a node that is in none of several nodes is its own."""
    if groups is None:
        return df
    named = groups.select(F.col("node").alias(column), F.col("component").alias("_component"))
    joined = df.join(named, column, "left")
    return joined.withColumn(column, F.coalesce("_component", column)).drop("_component")


def _level(spark: SparkSession, table: str, level: int, schema: T.StructType) -> DataFrame | None:
    """The rows of one level of a table that is partitioned by level, None where there are none; no other folder is listed."""
    try:
        return spark.read.schema(schema).parquet(f"{table}/level={level}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class Reach:
    """What the asked roots reach: `pairs` (root, component), and `groups` (node, component) of components of several nodes.

    A root without edges reaches itself. Null roots reach nothing and are left out.
    """

    def __init__(self, edges: DataFrame, roots: DataFrame):
        spark = tune(edges.sparkSession)
        levels, self.groups = condensed(edges)
        placed = levels.groupBy("dst").agg((F.max("level") + 1).alias("dst_level"))
        steps = new_table(spark)
        levels.join(placed, "dst").write.partitionBy("level").parquet(steps)
        at = levels.select(F.col("src").alias("component"), "level").unionByName(placed.select(F.col("dst").alias("component"), F.col("dst_level").alias("level"))).groupBy("component").agg(F.max("level").alias("level"))
        asked = _renamed(roots.select("root", F.col("root").alias("component")).filter("root IS NOT NULL").distinct(), self.groups, "component")
        asked = asked.join(at, "component", "left").select("root", "component", F.coalesce("level", F.lit(0)).alias("level"))
        inbox = new_table(spark)
        asked.write.partitionBy("level").parquet(inbox)
        pairs = asked.select("root", "component").schema
        down = levels.select(F.col("src"), "dst", F.col("level").alias("dst_level")).schema
        for level in range((levels.agg(F.max("level")).first()[0] or 0) + 1):
            now, step = _level(spark, inbox, level, pairs), _level(spark, steps, level, down)
            if now is not None and step is not None:
                now = now.distinct().withColumnRenamed("component", "src").join(step, "src")
                now.select("root", F.col("dst").alias("component"), F.col("dst_level").alias("level")).write.mode("append").partitionBy("level").parquet(inbox)
        self.pairs = spark.read.schema(asked.schema).parquet(inbox).select("root", "component").distinct()

    def components_of(self, nodes: DataFrame, column: str) -> DataFrame:
        """`nodes` with `component`, that of `column`."""
        return _renamed(nodes.withColumn("component", F.col(column)), self.groups, "component")

    def summed(self, **sums) -> DataFrame:
        """(root, ...) with sums over what each root reaches of expressions of `node`; each component is summed once."""
        own = {name: make(F.col("component")) for name, make in sums.items()}
        if self.groups is None:
            return self.pairs.groupBy("root").agg(*[F.sum(c).alias(n) for n, c in own.items()])
        big = self.groups.groupBy("component").agg(*[F.sum(make(F.col("node"))).alias(f"_{n}") for n, make in sums.items()])
        return self.pairs.join(big, "component", "left").groupBy("root").agg(*[F.sum(F.coalesce(F.col(f"_{n}"), c)).alias(n) for n, c in own.items()])

    def expanded(self) -> DataFrame:
        """(root, decl), one row for each node that a root reaches. For few roots; counts and questions need no such table."""
        if self.groups is None:
            return self.pairs.withColumnRenamed("component", "decl")
        members = self.groups.select(F.col("node").alias("_node"), "component")
        return self.pairs.join(members, "component", "left").select("root", F.coalesce("_node", "component").alias("decl"))


def depends_on(reached: Reach, claims: DataFrame) -> DataFrame:
    """claims(root, impl): VACUOUS when the theorem never reaches the subject it claims to constrain."""
    asked = reached.components_of(claims.select("root", "impl"), "impl")
    hits = reached.pairs.withColumn("hit", F.lit(True))
    return asked.join(hits, ["root", "component"], "left").select("root", "impl", F.when(F.col("hit"), "DEPENDS").otherwise("VACUOUS").alias("status"))


def declaration_evidence(reached: Reach, axioms: DataFrame, suspicious: list[str]) -> DataFrame:
    """Per root: size of its reach, axioms inside it, and whether none of them is suspicious."""
    named = reached.components_of(axioms.select("axiom").distinct(), "axiom")
    basis = reached.pairs.join(named, "component").groupBy("root").agg(F.sort_array(F.collect_set("axiom")).alias("axioms"))
    none = F.coalesce("axioms", F.array().cast("array<string>"))
    return reached.summed(dep_count=lambda node: F.lit(1)).join(basis, "root", "left").select(
        "root", "dep_count", none.alias("axioms"), (~F.arrays_overlap(none, F.array(*[F.lit(s) for s in suspicious]))).alias("clean")
    )
