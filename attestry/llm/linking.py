"""From an index of candidates to components, without the pairs inside a component.

An index has rows (key, cls); two classes that are linked stand together under at least one key. Under each key all classes are
first verified against the smallest one, which joins groups of near copies without looking at their pairs. What is left are keys
whose classes lie in several components. Small keys give the pairs across components. The classes of large ones are indexed anew by
what they do not have in common with one of them (`rebased`), which tells near copies apart that differ too much to be linked; keys
that are still large after a few turns of this are worked off by a few pivots at a time until nothing is left across components. So
every candidate pair that could join two components is verified or cannot reach the threshold, and the components are those of all
links.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import written
from attestry.llm.components import components

SMALL_KEY = 128
PIVOTS = 32
TURNS = 3
# Differences are told apart by levels of this share of a set, or of so many items.
LEVEL_SHARE = 1 / 16
LEVEL_LEAST = 4


def shared_keys(raw: DataFrame) -> DataFrame:
    """(key, cls, least) of the keys of `raw` (key, cls) under which several classes stand, written."""
    of_key = Window.partitionBy("key")
    ends = raw.withColumn("least", F.min("cls").over(of_key)).withColumn("most", F.max("cls").over(of_key))
    return written(ends.filter("least <> most").select("key", "cls", "least"))


def _open(index: DataFrame, roots: DataFrame, *more: str) -> DataFrame:
    """(key, cls, root, size) and `more` columns of the keys whose classes lie in several components."""
    of_key = Window.partitionBy("key")
    labelled = index.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("root"), *more)
    ends = labelled.withColumn("low", F.min("root").over(of_key)).withColumn("high", F.max("root").over(of_key)).withColumn("size", F.count("*").over(of_key))
    return written(ends.filter("low <> high").select("key", "cls", "root", "size", *more))


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, a, b) of classes in different components."""
    right = right.select("key", F.col("cls").alias("b"), F.col("root").alias("other"))
    both = left.join(right, "key").filter("cls <> b AND root <> other")
    return both.select("key", F.least("cls", "b").alias("a"), F.greatest("cls", "b").alias("b"))


def _differences(rows: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(grp, cls, n, at_home, pivot_n, delta) of the groups of `rows` (cls, least), written.

    A group is of one `least` and of sets whose sizes are of one level, or of the level below it (not at home): sets of two levels
    that are no neighbours are too different in size. `delta` is the symmetric difference to one set of the group.
    """
    rows = written(rows.select("cls", "least").distinct())
    items = sets(rows.select("cls").distinct()).withColumn("n", F.size("items"))
    step = math.log(100 / percent) * 1.0001 if percent < 100 else 1e-12
    sized = rows.join(items.select("cls", "n"), "cls").withColumn("level", F.floor(F.log("n") / F.lit(step)))
    both = F.array(F.struct(F.lit(True).alias("at_home"), F.col("level").alias("of")), F.struct(F.lit(False).alias("at_home"), (F.col("level") + 1).alias("of")))
    grouped = sized.select("least", "cls", F.explode(both).alias("g")).select(F.xxhash64("least", "g.of").alias("grp"), "least", "cls", "g.at_home")
    chosen = grouped.groupBy("grp").agg(F.min(F.struct(F.col("cls") != F.col("least"), "cls"))["cls"].alias("pivot"), F.max("at_home").alias("home"), F.count("*").alias("members"))
    grouped = grouped.drop("least").join(chosen.filter("home AND members > 1").select("grp", "pivot"), "grp")
    with_pivot = grouped.join(items.select(F.col("cls").alias("pivot"), F.col("n").alias("pivot_n"), F.col("items").alias("base")), "pivot")
    delta = F.concat(F.array_except("items", "base"), F.array_except("base", "items"))
    return written(with_pivot.join(items, "cls").select("grp", "cls", "n", "at_home", "pivot_n", delta.alias("delta")))


def rebased(rows: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int) -> tuple[DataFrame, DataFrame]:
    """Of classes (cls, least), of which those with one `least` may be linked: (a, b) that are linked for certain, and a new index
    (key, cls, least, mine, other, at_home), under which any other two that can be linked stand together.

    Let da and db be the differences of two sets of a group to its pivot. The sets differ in |da| + |db| - 2 |da & db| items and are
    linked if that is at most c = (100 - percent) / (100 + percent) of the sum of their sizes. With s = |d| - c |set| they need
    (sa + sb) / 2 common items of da and db. Where that is not positive they are linked whatever they have in common: all of these
    are linked to the set of smallest s. For the others, if o is needed, the first |d| - o + 1 items of both have one in common,
    in any order; here rare ones of the group come first. What is needed is taken for each level of s in the group by itself.
    Items of one set only count in its order and have no key.
    """
    whole, part = 100 + percent, 100 - percent
    made = _differences(rows, sets, percent)
    d = F.size("delta")
    made = made.withColumn("d", d).withColumn("s", (whole * d - part * F.col("n")).cast("long"))
    made = made.withColumn("mine", F.floor(F.col("s") / (whole * F.greatest(F.lit(LEVEL_LEAST), F.floor(F.col("pivot_n") * LEVEL_SHARE)))))
    centre = made.groupBy("grp").agg(F.min(F.struct("s", "cls")).alias("m")).select("grp", F.col("m.s").alias("low"), F.col("m.cls").alias("a"))
    near = made.select("grp", "cls", "s").join(centre, "grp").filter("low + s <= 0 AND a <> cls")
    sure = written(near.select(F.least("a", "cls").alias("a"), F.greatest("a", "cls").alias("b")).distinct())
    levels = made.groupBy("grp", "mine").agg(F.min("s").alias("low"), F.max("d").alias("most"))
    levels = levels.groupBy("grp").agg(F.collect_list(F.struct(F.col("mine").alias("other"), "low", "most")).alias("levels"))
    items = made.select("grp", "cls", F.explode("delta").alias("item"))
    shared = items.groupBy("grp", "item").agg(F.count("*").alias("times")).filter("times > 1")
    common = items.join(shared, ["grp", "item"]).groupBy("grp", "cls").agg(F.sort_array(F.collect_list(F.struct("times", "item"))).alias("common"))
    facts = made.select("grp", "cls", "at_home", "d", "s", "mine").join(common, ["grp", "cls"]).join(levels, "grp")
    each = facts.select("grp", "cls", "at_home", "d", "s", "mine", "common", F.explode("levels").alias("l"))
    need = F.greatest(F.lit(1), F.ceil((F.col("s") + F.col("l.low")) / (2 * whole)))
    each = each.withColumn("need", need.cast("int")).filter(F.col("need") <= F.least("d", "l.most"))
    first = F.slice("common", F.lit(1), F.greatest(F.lit(0), F.size("common") - F.col("need") + 1))
    each = each.select("grp", "cls", "at_home", "mine", F.col("l.other").alias("other"), F.explode(first).alias("at"))
    key = F.xxhash64("grp", F.least("mine", "other"), F.greatest("mine", "other"), "at.item")
    raw = each.select(key.alias("key"), "cls", "mine", "other", "at_home")
    of_key = Window.partitionBy("key")
    ends = raw.withColumn("least", F.min("cls").over(of_key)).withColumn("most", F.max("cls").over(of_key))
    return sure, written(ends.filter("least <> most").drop("most"))


def _across(rows: DataFrame) -> DataFrame:
    """(a, b) of the classes of `rows` in different components whose levels ask for each other, of which one is at home."""
    right = rows.select("key", F.col("cls").alias("b"), F.col("root").alias("root_b"), F.col("mine").alias("other"), F.col("other").alias("mine"), F.col("at_home").alias("home_b"))
    both = rows.join(right, ["key", "mine", "other"]).filter("cls <> b AND root <> root_b AND (at_home OR home_b) AND (mine <> other OR cls < b) AND mine <= other")
    return both.select(F.least("cls", "b").alias("a"), F.greatest("cls", "b").alias("b")).distinct()


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of `roots` and `links` (a, b) together, written: the components of the links between components."""
    side = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    ends = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    top = components(ends)
    known = roots.unionByName(top.select("node", F.col("node").alias("root"))).distinct()
    above = top.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return written(known.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def linked(
    index: DataFrame,
    verified: Callable[[DataFrame], DataFrame],
    sets: Callable[[DataFrame], DataFrame],
    percent: int,
    star_filter: Callable[[DataFrame], DataFrame] = lambda star: star,
    pair_filter: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
    small: int = SMALL_KEY,
    turns: int = TURNS,
) -> DataFrame:
    """(node, root) of the components of `index` (key, cls, least), as `shared_keys` gives it.

    `verified` takes (a, b) and returns, written, those that are linked: whose sets have at least `percent` of their union in
    common. `sets` takes (cls) and gives (cls, items), the distinct items of each set as an array, written. `star_filter` takes
    (a, b, shared) of the first round and may drop what it likes. `pair_filter` takes (a, b, shared, odd), the number of common
    small keys and of odd ones among them, and must keep each link that stands under small keys only. `turns` and `small` choose
    between ways of equal result.
    """
    star = index.filter("cls <> least").groupBy(F.col("least").alias("a"), F.col("cls").alias("b")).agg(F.count("*").alias("shared"))
    roots = components(verified(star_filter(star).select("a", "b")))

    def joined(found: DataFrame) -> None:
        nonlocal roots
        if not found.isEmpty():
            roots = _merged(roots, found)

    rest = _open(index, roots, "least")
    few, many = rest.filter(F.col("size") <= small), rest.filter(F.col("size") > small)
    twice = _pairs(few, few).groupBy("a", "b").agg((F.count("*") / 2).alias("shared"), (F.count_if(F.col("key") % 2 != 0) / 2).alias("odd"))
    joined(verified(pair_filter(twice).select("a", "b")))
    many, turn = _open(many.select("key", "cls", "least"), roots, "least"), 0
    while turn < turns and not many.isEmpty():
        sure, index = rebased(many, sets, percent)
        joined(sure)
        asked = ("least", "mine", "other", "at_home")
        rest = _open(index, roots, *asked)
        large = rest.filter(F.col("size") > small)
        if not large.isEmpty():
            joined(verified(large.filter("cls <> least").select(F.least("least", "cls").alias("a"), F.greatest("least", "cls").alias("b")).distinct()))
            rest = _open(rest.select("key", "cls", *asked), roots, *asked)
        joined(verified(_across(rest.filter(F.col("size") <= small))))
        many, turn = _open(rest.filter(F.col("size") > small).select("key", "cls", "least"), roots, "least"), turn + 1
    while not many.isEmpty():
        turned = _open(many.select("key", "cls"), roots)
        # Smallest components first: when only the largest is left, the key needs no more pivots.
        turned = turned.withColumn("mates", F.count("*").over(Window.partitionBy("key", "root")))
        turned = written(turned.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("mates", "root", "cls"))))
        joined(verified(_pairs(turned.filter(F.col("place") <= PIVOTS), turned).select("a", "b").distinct()))
        many = turned.filter(F.col("place") > PIVOTS)
    return roots
