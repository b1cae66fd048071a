"""Merkle manifest of a dataset by time-forward processing.

A tree is worked off in the order of its node labels: a node's digest is a message to its parent, and the queue of messages hands
them out by label. The external part of that queue is Spark's sort: the messages to a block of `FAN` consecutive nodes are dealt to
one task and arrive sorted; the part inside a block is a heap. A block gives one message to the next round, so there are as many
rounds as the logarithm of the leaves to the base `FAN`, and a hot source is many blocks. Then the sweep runs backwards: each
block gets the proof suffix of its top ahead of its nodes, the smallest label of the block, and hands longer suffixes down.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import prepare, remainder, written
from attestry.llm.ordering import ranked

ARITY = 3
LEVELS = 6
FAN = ARITY**LEVELS
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TAMPER_MODULUS = 2
NODE = "tree long, n long, at long, digest binary"
SUFFIX = "tree long, at long, suffix string, top binary"
DIGEST = 64


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels that a round adds to a tree of n nodes: all of a block's, or as many as there are up to the top."""
    if n > FAN:
        return LEVELS
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def forward(digests: list[str], levels: int) -> list[list[str]]:
    """The digests of a block, level by level from its nodes to its top, by a queue of messages ordered by the receiver's label."""
    out = [digests] + [[] for _ in range(levels)]
    queue = [(1, i // ARITY, i % ARITY, d) for i, d in enumerate(digests)] if levels else []
    heapq.heapify(queue)
    while queue:
        level, place = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, place):
            children.append(heapq.heappop(queue)[3])
        digest = _hash("".join(children))
        out[level].append(digest)
        if level < levels:
            heapq.heappush(queue, (level + 1, place // ARITY, place % ARITY, digest))
    return out


def backward(nodes: list[list[str]], suffix: str) -> list[str]:
    """Of each node of a block its proof suffix: by level the numbers of left and right siblings, then their digests."""
    above = [suffix]
    for row in reversed(nodes[:-1]):
        now = []
        for i in range(len(row)):
            start = i - i % ARITY
            left, right = row[start:i], row[i + 1 : start + ARITY]
            now.append(f"{len(left)}{len(right)}" + "".join(left) + "".join(right) + above[i // ARITY])
        above = now
    return above


def siblings(suffix: str) -> Iterator[tuple[str, str]]:
    """(left, right) digests of each level of a proof suffix."""
    at = 0
    while at < len(suffix):
        left, right = int(suffix[at]) * DIGEST, int(suffix[at + 1]) * DIGEST
        at += 2
        yield suffix[at : at + left], suffix[at + left : at + left + right]
        at += left + right


def fold(digest: str, suffix: str) -> str:
    """The root that a leaf and its proof give."""
    for left, right in siblings(suffix):
        digest = _hash(left + digest + right)
    return digest


def proof(suffix: str) -> str:
    return _hash("".join(left + right for left, right in siblings(suffix)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows sorted by (tree, block) as lists of one block each."""
    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and (held[0]["tree"], held[0]["block"]) != (r["tree"], r["block"]):
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 4000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _raise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("tree", pa.int64()), ("n", pa.int64()), ("at", pa.int64()), ("digest", pa.binary())])

    def tops():
        for block in _blocks(batches):
            n = block[0]["n"]
            top = forward([r["digest"].hex() for r in block], levels_of(n))[-1][0]
            yield {"tree": block[0]["tree"], "n": -(-n // FAN), "at": block[0]["block"], "digest": bytes.fromhex(top)}

    yield from _batched(tops(), schema)


def _lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("tree", pa.int64()), ("at", pa.int64()), ("suffix", pa.string()), ("top", pa.binary())])

    def handed():
        for first, *block in _blocks(batches):
            nodes = forward([r["digest"].hex() for r in block], levels_of(block[0]["n"]))
            for r, suffix in zip(block, backward(nodes, first["suffix"])):
                yield {"tree": r["tree"], "at": r["at"], "suffix": suffix, "top": first["top"]}

    yield from _batched(handed(), schema, 500)


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "proof_sha256", "folded_root")]])

    def proven():
        for first, *block in _blocks(batches):
            nodes = forward([r["digest"].hex() for r in block], levels_of(block[0]["n"]))
            subroot = first["top"].hex()
            for r, leaf, suffix in zip(block, nodes[0], backward(nodes, first["suffix"])):
                now = leaf if r["tampered"] is None else r["tampered"].hex()
                yield {"doc_id": r["doc_id"], "leaf": leaf, "subroot": subroot, "proof_sha256": proof(suffix), "folded_root": fold(now, suffix)}

    yield from _batched(proven(), schema)


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")


def _block() -> Column:
    return F.floor(F.col("at") / FAN).cast("long").alias("block")


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The node tables (tree, n, at, digest) of all rounds, the first of them `nodes`, and (tree, top) of all trees."""
    rounds, tops = [nodes], nodes.filter("n = 1").select("tree", F.col("digest").alias("top"))
    while not (open_ := rounds[-1].filter("n > 1")).isEmpty():
        up = written(_dealt(open_.select("tree", "n", "at", "digest", _block())).mapInArrow(_raise, NODE))
        tops = tops.unionByName(up.filter("n = 1").select("tree", F.col("digest").alias("top")))
        rounds.append(up)
    return rounds, tops


def _with_suffixes(nodes: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Nodes behind their block's suffix, which stands at place -1."""
    heads = suffixes.select("tree", F.col("at").alias("block"), F.lit(-1).cast("long").alias("at"), "suffix", "top")
    return _dealt(nodes.withColumn("block", _block()).unionByName(heads, allowMissingColumns=True))


def descend(rounds: list[DataFrame], ends: DataFrame) -> DataFrame:
    """(tree, at, suffix, top) of the blocks of the first node table, from `ends` (tree, suffix, top), what each tree's top gets.

    A round has the trees that were not finished before it. A tree's top is the only block of the last round in which it stands
    with several nodes, or its only node.
    """
    given = None
    for number in range(max(0, len(rounds) - 2), -1, -1):
        below = rounds[number]
        last = below.filter(F.col("n") <= FAN) if number == 0 else below.filter((F.col("n") > 1) & (F.col("n") <= FAN))
        last = last.filter("at = 0").select("tree").join(ends, "tree").select("tree", F.lit(0).cast("long").alias("at"), "suffix", "top")
        given = last if given is None else given.unionByName(last)
        if number:
            given = written(_with_suffixes(below.filter("n > 1").select("tree", "n", "at", "digest"), given).mapInArrow(_lower, SUFFIX))
    return given


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, digest, tampered, salt): leaf digests, and those after tampering where it changes a text; written."""
    text = docs["text"].cast("string")
    tampered = F.when(remainder(docs["doc_id"], TAMPER_MODULUS) == 0, F.translate(text, "\n", ""))
    fields = [field(docs[c]) for c in FIELDS[:-1]]
    leaf = lambda body: F.unhex(F.sha2(F.concat(*fields, field(body)), 256))
    return written(
        docs.select(
            docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), leaf(text).alias("digest"),
            F.when(tampered != text, leaf(tampered)).alias("tampered"), F.monotonically_increasing_id().alias("salt"),
        )
    )


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row for each row of `docs` (the columns of FIELDS).

    Leaves of a source ascend by doc_id, null first; rows of one doc_id by their leaf, equal rows stand side by side. A null
    source is the first source. A null doc_id is not tampered with, a null text stays null. A long text is hashed where it is
    read and never moved. An empty table gives an empty result; of extra columns none is read.
    """
    prepare(docs.sparkSession)
    placed = ranked(leaves(docs), ["source", "doc_id", "digest", "salt"])
    sources = ranked(placed.groupBy("source").agg(F.min("rank").alias("first"), F.count("*").alias("n")), ["source"])
    sources = sources.select(F.col("source").alias("_source"), "first", "n", F.col("rank").alias("tree"))
    at = (F.col("rank") - F.col("first")).alias("at")
    found = placed.join(sources, placed["source"].eqNullSafe(sources["_source"])).select("tree", "n", at, "digest", "doc_id", "tampered")
    found = written(found)
    rounds, subroots = climb(found)
    subroots = written(subroots)
    trees = subroots.count()
    top = written(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("at"), F.col("top").alias("digest")))
    upper, roots = climb(top)
    root = roots.first()
    if root is None:
        root = {"top": b""}
    end = docs.sparkSession.createDataFrame([(0, "", bytes(root["top"]))], "tree long, suffix string, top binary")
    ends = _with_suffixes(top, descend(upper, end)).mapInArrow(_lower, SUFFIX)
    ends = written(ends.select(F.col("at").alias("tree"), "suffix").join(subroots, "tree"))
    out = _with_suffixes(found, descend(rounds, ends)).mapInArrow(_prove, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return out.select("doc_id", "leaf", "subroot", F.lit(bytes(root["top"]).hex()).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == bytes(root["top"]).hex()).alias("verified"))
