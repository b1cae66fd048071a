"""Connected components of a table of links: a union-find whose finds and unions are joins.

Each round every node points at its smallest neighbour, pointers are followed twice, and the links are rewritten between what
their ends point at; links inside a component vanish. Groups of copies fall together in one round, chains in logarithmically
many. Nothing leaves the cluster, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b); root is the smallest node of the component. Null ends are no links."""
    links = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = written(links)
    rounds = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up")))
        for _ in range(2):
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up = up.join(above, "up").select("node", F.col("top").alias("up"))
        up = written(up)
        rounds.append(up)
        ends = links.join(up.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        links = written(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return followed(rounds)


def followed(rounds: list[DataFrame]) -> DataFrame:
    """(node, root) from the (node, up) of each round, the last first: a round's nodes are read once, and later rounds have few."""
    roots = rounds[-1].select("node", F.col("up").alias("root"))
    for up in reversed(rounds[:-1]):
        above = roots.select(F.col("node").alias("up"), "root")
        roots = written(up.join(above, "up", "left").select("node", F.coalesce("root", "up").alias("root")))
    return roots
