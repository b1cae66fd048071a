"""Secrets told from widely copied examples by corpus-wide ownership.

Every candidate value of the corpus is hashed, and the distinct repositories and owners of each hash are counted. A value that
many owners hold is a copied example; a value of few owners that also looks random is taken for a live credential. Candidates are
the values of the base patterns and, besides, long mixed tokens that no base pattern reaches; of those, the owner-specific ones
are added to the spans as kind `owned`. The text is read once; what moves between tasks are hashes and positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import prepare, texts, written

ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# A run that is too short holds no later match that is long enough, so the length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIXED = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your"

WIDE_OWNERS = 3
WIDE_REPOS = 6
MIN_DISTINCT = 8


def _located(text: Column, pattern: str, group: int, kind: int) -> Column:
    """Array of (start, kind, end, value) of the pattern's matches, from the lengths of the matches and of what lies between."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.arrays_zip(between.alias("gap"), whole.alias("whole"), value.alias("value"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))

    def add(acc: Column, s: Column) -> Column:
        start = last(acc) + s["gap"]
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(s["whole"])).alias("end"), s["value"].alias("value"))
        return F.concat(acc, F.array(one))

    found = F.aggregate(F.filter(steps, lambda s: s["whole"].isNotNull()), empty, add)
    return F.when(text.rlike(pattern), found).otherwise(empty)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def candidates(docs: DataFrame, id_col: str, text_col: str, owner: Column, repo: Column) -> DataFrame:
    """(doc_id, text_hash, owner, repo, base, mixed) with arrays of (start, kind, end, value)."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), owner.alias("owner"), repo.alias("repo"))
    text = F.col("text")
    long_enough = F.filter(_located(text, ASSIGN, 2, 0), lambda s: F.length(s["value"]) >= 12)
    rows = rows.withColumn("base", F.concat(long_enough, _located(text, ACCESS, 0, 1), _located(text, HEX, 0, 2)))
    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    mixed = lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]") & apart(s)
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "owner", "repo", "base", F.filter(_located(text, MIXED, 0, 3), mixed).alias("mixed"))


def ownership(values: DataFrame) -> DataFrame:
    """(value_hash, owners, repos) of (value_hash, owner, repo); one value in a third of all rows is combined before each shuffle."""
    pairs = values.distinct().groupBy("value_hash", "owner").agg(F.count("*").alias("repos"))
    return pairs.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def find_secrets(
    docs: DataFrame, owner: Column, repo: Column, id_col: str = "doc_id", text_col: str = "text", wide_owners: int = WIDE_OWNERS, wide_repos: int = WIDE_REPOS
) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied), one row for each input row.

    `repo` is counted within its owner. A value is copied if at least `wide_owners` owners or `wide_repos` repositories hold it;
    otherwise it is live if it looks random (MIN_DISTINCT different characters, no placeholder word). n_live and n_copied count
    the base and mixed candidates of a row. Null text counts as empty; all null owners (repos) are one owner (repo). Rows that
    repeat an id and a text are rows of the result each. An empty table gives an empty result; extra columns are not read.
    """
    prepare(docs.sparkSession)
    found = written(candidates(docs, id_col, text_col, F.coalesce(owner.cast("string"), F.lit("")), F.coalesce(repo.cast("string"), F.lit(""))))
    key = [F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), "text_hash"]
    single = found.filter((F.size("base") > 0) | (F.size("mixed") > 0)).select(*key, "owner", "repo", F.explode(F.concat("base", "mixed")).alias("span"))
    single = written(single.select("key", "text_hash", "owner", "repo", "span", F.sha2("span.value", 256).alias("value_hash")))
    held = written(ownership(single.select("value_hash", "owner", "repo")))
    placed = single.select("key", "text_hash", "span", "value_hash").distinct()
    copied = (F.col("owners") >= wide_owners) | (F.col("repos") >= wide_repos)
    varied = F.size(F.array_distinct(F.split("span.value", ""))) >= MIN_DISTINCT
    live = ~copied & varied & ~F.col("span.value").rlike(PLACEHOLDER)
    judged = placed.join(held, "value_hash").select("key", "text_hash", "span", copied.alias("copied"), live.alias("live"))
    added = F.collect_list(F.when(F.col("live") & (F.col("span.kind") == 3), F.col("span")))
    per_text = judged.groupBy("key", "text_hash").agg(added.alias("added"), F.count_if("live").alias("n_live"), F.count_if("copied").alias("n_copied"))
    rows = found.select("doc_id", *key, "base").join(per_text, ["key", "text_hash"], "left")
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select(
        "doc_id",
        *[of(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added"))).alias("spans"),
        zero("n_live"),
        zero("n_copied"),
    )
