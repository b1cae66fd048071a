"""From function bodies to flat node tables, and the per-function facts read off them."""

from __future__ import annotations

import json
import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import rules, schemas
from attestry.functions import names
from attestry.operators.opened import QUOTE, Opened

# A function is a place in its corpus; the name is a label, and two functions may share it.
KEY = ["module", "fn", "fn_pos"]

_TOKEN = re.compile(r'[{}\[\],:]|"(?:[^"\\]|\\.)*"|[^\s{}\[\],:"]+')
_ROWS_PER_BATCH = 20_000
_BYTES_PER_PIECE = 1 << 20
# Key holding the node's own name, by kind.
_NAME_KEYS = {
    "call": "f", "mcall": "m", "field": "f", "setField": "f", "alloc": "cls", "name": "v", "fnref": "v",
    "closure": "f", "classClosure": "c", "kwargE": "n", "assign": "x", "forIn": "x", "setGlobal": "x",
    "declGlobal": "x", "del": "x", "tryCatch": "x",
}
_RECEIVER_KEYS = {"field": "a", "setField": "r", "mcall": "recv"}


def _decode(text: str):
    """JSON text to objects. Bodies nested past the parser's recursion limit are built with an explicit stack."""
    try:
        return json.loads(text)
    except RecursionError:
        pass
    root: list = []
    stack, key = [root], None
    keys: list = []
    for token in _TOKEN.findall(text):
        top = stack[-1]
        if token in ",:":
            continue
        if token in "}]":
            stack.pop()
            key = keys.pop()
            continue
        if isinstance(top, dict) and key is None:
            key = json.loads(token)
            continue
        value = {} if token == "{" else [] if token == "[" else json.loads(token)
        if isinstance(top, dict):
            top[key] = value
            key = None
        else:
            top.append(value)
        if token in "{[":
            stack.append(value)
            keys.append(key)
            key = None
    return root[0]


def _as_text(value):
    if value is None or type(value) is str:
        return value
    return str(value) if type(value) is int else json.dumps(value)


def _walk(body, kinds=None):
    """Preorder over every object of a body, with an explicit stack: real code nests hundreds of levels deep.

    With `kinds`, only objects of these kinds come out, under the numbers they have among all.
    """
    names_of, receivers_of, pruning = _NAME_KEYS.get, _RECEIVER_KEYS.get, set(rules.PRUNED_BELOW)
    stack = [(body, -1, 1, "body", 0, False, False, True)]
    push = stack.append
    me = -1
    while stack:
        node, parent, depth, role, pos, pruned, under_index, leading = stack.pop()
        if type(node) is list:
            for i in range(len(node) - 1, -1, -1):
                if type(node[i]) in (dict, list):
                    push((node[i], parent, depth, role, i, pruned, under_index, leading))
            continue
        me += 1
        get = node.get
        k, value = get("k"), get("v")
        # `leading` is True down the docstring spine, "docslot" on its statement and "doc" on the literal itself.
        starts_with_doc = False
        if leading is True and k == "seq":
            first = get("a") or {}
            starts_with_doc = first.get("k") == "exprS" and (first.get("e") or {}).get("k") == "str"
        if kinds is None or k in kinds:
            key = names_of(k)
            name = get(key) if key else None
            key = receivers_of(k)
            receiver = get(key) if key else None
            op = get("op")
            if op is None and k in ("isOp", "inOp"):
                op = get("neg")
            yield (
                me, parent, depth, role, pos, k, _as_text(op), _as_text(name),
                _as_text(receiver.get("v")) if type(receiver) is dict else None,
                get("label"), None if type(value) is dict else _as_text(value), None if value is None else type(value).__name__, pruned, under_index, leading == "doc",
                leading is True and not starts_with_doc,
            )
        children = [(key, c) for key, c in node.items() if type(c) is dict or (type(c) is list and c)]
        if children:
            below_pruned, below_index = pruned or k in pruning, under_index or k == "setIndex"
            for key, child in reversed(children):
                lead = False
                if starts_with_doc:
                    lead = "docslot" if key == "a" else key == "b"
                elif leading == "docslot" and key == "e":
                    lead = "doc"
                push((child, me, depth + 1, key, 0, below_pruned, below_index, lead))


def _facts(body) -> tuple:
    """Of one body: counts of objects by the three conventions, holes, risk, deepest level, and its distinct calls."""
    holes, risky, pruning, names_of = set(rules.HOLE_KINDS), set(rules.RISKY_KINDS), set(rules.PRUNED_BELOW), _NAME_KEYS
    objects = kinds = seqs = holed = risk = deepest = 0
    calls = set()
    stack = [(body, 1, False, False)]
    while stack:
        node, depth, pruned, under_index = stack.pop()
        if type(node) is list:
            stack += [(x, depth, pruned, under_index) for x in node if type(x) in (dict, list)]
            continue
        objects += 1
        deepest = max(deepest, depth)
        k = node.get("k")
        if k is not None:
            kinds += 1
            seqs += k == "seq"
            holed += k in holes
            risk += k in risky and not pruned and not under_index
            if (k == "call" or k == "mcall") and not pruned:
                calls.add((k == "mcall", _as_text(node.get(names_of[k]))))
        pruned, under_index = pruned or k in pruning, under_index or k == "setIndex"
        stack += [(x, depth + 1, pruned, under_index) for x in node.values() if type(x) in (dict, list)]
    return kinds - seqs, kinds, objects, holed, risk, deepest, [{"is_method": m, "callee": c} for m, c in calls]


COUNTS = ["ledger_nodes", "matrix_nodes", "shape_nodes", "holes", "risk"]
FACTS = ", ".join(f"{c} BIGINT" for c in COUNTS) + ", max_depth INT, calls ARRAY<STRUCT<is_method: BOOLEAN, callee: STRING>>"


def _pieces(batch, column: int, size: int = _BYTES_PER_PIECE):
    """A batch in runs of rows with about a megabyte of bodies, so that the arrays over their signs stay small."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    cuts = np.flatnonzero(np.diff(sizes // size, prepend=0))
    edges = np.unique(np.concatenate([[0], cuts, [batch.num_rows]]))
    return (batch.slice(a, b - a) for a, b in zip(edges, edges[1:]))


def _spans(o: Opened, wanted, key: str):
    """Spans of the text under a key of the wanted objects; a value that isn't text makes a body odd."""
    has, start, length, other = o.values(key, numbers=True)
    o.odd_where(wanted & other)
    return has & wanted, start, length


def _facts_together(bodies):
    """`_facts` of all bodies of an array, by columns; the odd ones are walked."""
    o, n = Opened(bodies), len(bodies)
    count = lambda mask: np.bincount(o.doc[mask], minlength=n)
    pruned, under_index, kinds = o.below(*rules.PRUNED_BELOW), o.below("setIndex"), count(o.kind[0])
    counted = [
        kinds - count(o.is_kind("seq")), kinds, np.bincount(o.doc, minlength=n), count(o.is_kind(*rules.HOLE_KINDS)),
        count(o.is_kind(*rules.RISKY_KINDS) & ~pruned & ~under_index), np.zeros(n, np.int64),
    ]
    np.maximum.at(counted[5], o.doc, o.depth)
    calls, data = [set() for _ in range(n)], o.data.tobytes()
    for kind in ("call", "mcall"):
        wanted = o.is_kind(kind) & ~pruned
        has, start, length = _spans(o, wanted, _NAME_KEYS[kind])
        o.odd_where(wanted & ~has)
        at = np.flatnonzero(has)
        for d, a, b in zip(o.doc[at].tolist(), start[at].tolist(), (start[at] + length[at]).tolist()):
            calls[d].add((kind == "mcall", data[a:b]))
    columns = [c.tolist() for c in counted] + [[[{"is_method": m, "callee": c} for m, c in found] for found in calls]]
    for i in np.flatnonzero(o.odd).tolist():
        for column, fact in zip(columns, _facts(_decode(bodies[i].as_py()))):
            column[i] = fact
    return columns


def _facts_batches(batches):
    types = [pa.int64()] * 5 + [pa.int32(), pa.list_(pa.struct([("is_method", pa.bool_()), ("callee", pa.string())]))]
    columns = [*KEY, *COUNTS, "max_depth", "calls"]
    for batch in batches:
        for piece in _pieces(batch, 3) if batch.num_rows else ():
            found = _facts_together(piece.column(3))
            yield pa.RecordBatch.from_arrays([*piece.columns[:3], *(pa.array(f, type=t) for f, t in zip(found, types))], names=columns)


def function_facts(functions: DataFrame) -> DataFrame:
    """Counts and distinct calls of each function with a body, counted in the walk: a row for each function leaves Python, not one for each node."""
    bodies = identified(functions.where(F.col("body").isNotNull()), "body")
    return bodies.mapInArrow(_facts_batches, "module STRING, fn STRING, fn_pos BIGINT, " + FACTS)


def identified(functions: DataFrame, *columns: str) -> DataFrame:
    """The key of each function, its place from `pos` (0 where a table has none), and the named columns."""
    pos = F.col("pos") if "pos" in functions.columns else F.lit(0)
    return functions.select("module", F.col("name").alias("fn"), pos.cast("bigint").alias("fn_pos"), *columns)


_ARROW_TYPES = {"STRING": pa.string(), "INT": pa.int32(), "BOOLEAN": pa.bool_()}
_NODE_TYPES = dict(c.strip().split(" ") for c in schemas.NODES.split(","))
_WALK_COLUMNS = list(_NODE_TYPES)[2:]


def _flatten_batches(columns: list[str], kinds: frozenset | None):
    """An Arrow batch function emitting the key and the wanted columns, in batches of bounded size."""
    picked = [(c, _WALK_COLUMNS.index(c), _ARROW_TYPES[_NODE_TYPES[c]]) for c in columns]

    def emit(heads, rows):
        owners = np.repeat(np.arange(len(heads)), [h[3] for h in heads])
        keys = [pa.array([h[i] for h in heads], type=t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
        for start in range(0, len(rows), _ROWS_PER_BATCH):
            by_column = list(zip(*rows[start : start + _ROWS_PER_BATCH]))
            owner = pa.array(owners[start : start + _ROWS_PER_BATCH])
            arrays = [k.take(owner) for k in keys] + [pa.array(by_column[i], type=t) for _, i, t in picked]
            yield pa.RecordBatch.from_arrays(arrays, names=KEY + columns)

    def walked(piece):
        heads, rows = [], []
        for *key, body in zip(*(c.to_pylist() for c in piece.columns)):
            before = len(rows)
            rows.extend(_walk(_decode(body), kinds))
            heads.append((*key, len(rows) - before))
            if len(rows) >= _ROWS_PER_BATCH:
                yield from emit(heads, rows)
                heads, rows = [], []
        yield from emit(heads, rows)

    def flatten(batches):
        for batch in batches:
            for piece in _pieces(batch, 3) if batch.num_rows else ():
                if not set(columns) <= _TOGETHER:
                    yield from walked(piece)
                    continue
                together, odd = _nodes_together(piece, columns, kinds)
                for start in range(0, together.num_rows, _ROWS_PER_BATCH):
                    yield together.slice(start, _ROWS_PER_BATCH)
                if odd.any():
                    yield from walked(piece.filter(pa.array(odd)))

    return flatten


_TOGETHER = {"node_id", "k", "op", "name", "v", "v_type", "label", "under_pruned", "under_set_index", "is_doc"}


def _odd_where_documented(o: Opened) -> None:
    """Bodies that may hold a docstring are odd: only a literal of the first statement opens a docstring run."""
    third = np.zeros(len(o.odd), bool)
    third[o.doc[(o.depth == 3) & o.is_kind("str")]] = True
    o.odd_where((o.depth == 2) & o.is_kind("exprS") & third[o.doc])


def _nodes_together(piece, columns: list[str], kinds):
    """The node rows of a piece of a batch, and which of its bodies are odd: these have no rows here."""
    o = Opened(piece.column(3))
    spans, made = {}, {}
    if "k" in columns:
        spans["k"] = o.kind[:3]
    if "name" in columns:
        spans["name"] = [np.zeros(len(o.doc), t) for t in (bool, np.int64, np.int64)]
        for key in set(_NAME_KEYS.values()):
            found = _spans(o, o.is_kind(*[k for k, named in _NAME_KEYS.items() if named == key]), key)
            for whole, part in zip(spans["name"], found):
                whole[found[0]] = part[found[0]]
    if "v" in columns:
        *spans["v"], other = o.values("v", numbers=True)
        o.odd_where(other & ~o.holds_object("v"))
    if "v_type" in columns:
        has, start, _, other = o.values("v", numbers=True)
        nested = o.holds_object("v")
        o.odd_where(other & ~nested)
        types = np.where(has, np.where(o.data[start - 1] == QUOTE, 0, 1), 2)
        made["v_type"] = pa.array(["str", "int", "dict"]).take(pa.array(types, mask=~has & ~nested))
    if "op" in columns:
        *spans["op"], other = o.values("op", numbers=True)
        o.odd_where(other | o.is_kind("isOp", "inOp"))
    if "label" in columns:
        *spans["label"], other = o.values("label")
        o.odd_where(other)
    if "is_doc" in columns:
        _odd_where_documented(o)
        made["is_doc"] = np.zeros(len(o.doc), bool)
    if "under_pruned" in columns:
        made["under_pruned"] = o.below(*rules.PRUNED_BELOW)
    if "under_set_index" in columns:
        made["under_set_index"] = o.below("setIndex")
    if "node_id" in columns:
        made["node_id"] = (np.arange(len(o.doc)) - o.first[o.doc]).astype(np.int32)
    wanted = ~o.odd[o.doc] if kinds is None else ~o.odd[o.doc] & o.is_kind(*kinds)
    of = lambda c: o.texts(*(x[wanted] for x in spans[c])) if c in spans else pa.array(made[c]).filter(pa.array(wanted))
    owner = pa.array(o.doc[wanted])
    arrays = [piece.column(i).cast(t).take(owner) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays + [of(c) for c in columns], names=KEY + columns), o.odd


def flatten_ast(functions: DataFrame, columns: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """One row per object of every body, or per object of the named kinds. The only step that opens a tree in Python.

    Catalyst cannot prune columns or rows through it, so a caller names the ones it needs: a body that holds none of the kinds as
    a string (nor an escape that could hide one) is not opened at all. Parallelism is that of the scan below; `session.spread` a
    corpus read from too few splits.
    """
    columns = columns or _WALK_COLUMNS
    schema = ", ".join(["module STRING, fn STRING, fn_pos BIGINT", *(f"{c} {_NODE_TYPES[c]}" for c in columns)])
    bodies = identified(functions.where(F.col("body").isNotNull()), "body")
    if kinds is not None:
        held = [F.contains("body", F.lit(f'"{k}"')) for k in kinds]
        bodies = bodies.where(reduce(lambda a, b: a | b, held, F.contains("body", F.lit("\\u"))))
    return bodies.mapInArrow(_flatten_batches(columns, None if kinds is None else frozenset(kinds)), schema)


def holes_of(functions: DataFrame) -> DataFrame:
    """The holes of function bodies, as `extract_holes` finds them in a node table; no other node leaves the walk."""
    return extract_holes(flatten_ast(functions, ["node_id", "k", "label"], rules.HOLE_KINDS))


def is_hole() -> Column:
    return F.col("k").isin(rules.HOLE_KINDS)


def extract_holes(nodes: DataFrame, unlabelled: str = "<unlabelled>") -> DataFrame:
    return nodes.where(is_hole()).select(
        *KEY, "node_id", F.coalesce("label", F.lit(unlabelled)).alias("label"), F.col("k").alias("kind")
    )


def hole_free(functions: DataFrame, holes: DataFrame) -> DataFrame:
    holed = holes.select("module", F.col("fn").alias("name"), F.col("fn_pos").alias("pos")).distinct()
    return functions.join(holed, [c for c in ("module", "name", "pos") if c in functions.columns], "left_anti")


def extract_calls(nodes: DataFrame, strict_compat: bool = True) -> DataFrame:
    """Free and method calls. The strict mode does not see calls below pruned constructs; the complete one does."""
    calls = nodes.where(F.col("k").isin("call", "mcall"))
    if strict_compat:
        calls = calls.where(~F.col("under_pruned"))
    return calls.select(*KEY, (F.col("k") == "mcall").alias("is_method"), F.col("name").alias("callee"))


def risk_weight() -> Column:
    counted = F.col("k").isin(rules.RISKY_KINDS) & ~F.col("under_pruned") & ~F.col("under_set_index")
    return F.when(counted, 1).otherwise(0)


def dynamic_risk(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(*KEY).agg(F.sum(risk_weight()).alias("risk"))


def size_weight(convention: str) -> Column:
    """*ledger* leaves `seq` out; *matrix* counts every object with a kind; *shape* counts every object."""
    if convention == "ledger":
        return F.when(F.col("k").isNotNull() & (F.col("k") != "seq"), 1).otherwise(0)
    if convention == "matrix":
        return F.when(F.col("k").isNotNull(), 1).otherwise(0)
    if convention == "shape":
        return F.lit(1)
    raise ValueError(f"unknown size convention: {convention}")


def node_size(nodes: DataFrame, convention: str) -> DataFrame:
    return nodes.groupBy(*KEY).agg(F.sum(size_weight(convention)).alias("size"))


def fn_stats(nodes: DataFrame) -> DataFrame:
    """All per-function counts in one aggregation, so a ledger reads the nodes once."""
    return nodes.groupBy(*KEY).agg(
        F.sum(size_weight("ledger")).alias("ledger_nodes"),
        F.sum(size_weight("matrix")).alias("matrix_nodes"),
        F.count("*").alias("shape_nodes"),
        F.count_if(is_hole()).alias("holes"),
        F.sum(risk_weight()).alias("risk"),
        F.max("depth").alias("max_depth"),
    )


def calls_of(facts: DataFrame) -> DataFrame:
    return facts.select(*KEY, F.explode("calls").alias("c")).select(*KEY, "c.is_method", "c.callee")


def class_fields(functions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sorted fields of `self` each class reads or writes; a class touching none keeps an empty list."""
    classes = functions.select("module", names.class_of(F.col("name")).alias("cls"))
    touched = nodes.where(F.col("k").isin("field", "setField") & (F.col("recv") == "self")).select(
        "module", names.class_of(F.col("fn")).alias("cls"), F.col("name").alias("field")
    )
    both = classes.withColumn("field", F.lit(None).cast("string")).unionByName(touched)
    return (
        both.where(F.col("cls").isNotNull())
        .distinct()
        .groupBy("module", "cls")
        .agg(F.sort_array(F.collect_set("field")).alias("fields"))
    )


def _mentions(body: Column, kinds: list[str]) -> Column:
    found = F.lit(False)
    for kind in kinds:
        found = found | F.contains(body, F.lit(f'"{kind}"'))
    return found


def body_flags(functions: DataFrame) -> DataFrame:
    """Three flags on the body text itself. A string equal to a kind sets the flag too, as the rule demands."""
    body = F.col("body")
    return functions.select(
        "module",
        F.col("name").alias("fn"),
        _mentions(body, ["tryFinally"]).alias("has_try_finally"),
        _mentions(body, rules.HEAP_WRITING_KINDS).alias("writes_heap"),
        _mentions(body, rules.HOLING_OR_LOOPING_KINDS).alias("can_hole_or_loop"),
    )


def docstrings(nodes: DataFrame) -> DataFrame:
    """The last literal of the leading docstring run of each function."""
    return (
        nodes.where(F.col("is_doc"))
        .groupBy(*KEY)
        .agg(F.max_by("v", "node_id").alias("doc"))
        .where(F.col("doc") != "")
    )


def _census_together(bodies):
    """Of each body of an array: its `raise` nodes and the last literal of its leading docstring run; the odd ones are walked."""
    o = Opened(bodies)
    _odd_where_documented(o)
    raises, docs = np.bincount(o.doc[o.is_kind("raise")], minlength=len(bodies)), [None] * len(bodies)
    k, v, is_doc = (_WALK_COLUMNS.index(c) for c in ("k", "v", "is_doc"))
    for i in np.flatnonzero(o.odd).tolist():
        nodes = list(_walk(_decode(bodies[i].as_py())))
        raises[i] = sum(node[k] == "raise" for node in nodes)
        docs[i] = next((node[v] for node in reversed(nodes) if node[is_doc]), None)
    return pa.array(raises, pa.int64()), pa.array(docs, pa.string())


def _census_batches(batches):
    for batch in batches:
        for piece in _pieces(batch, 1) if batch.num_rows else ():
            bodies = pc.fill_null(piece.column(1), "{}")
            yield pa.RecordBatch.from_arrays([piece.column(0), *_census_together(bodies)], names=["module", "raises", "doc"])


def census_facts(functions: DataFrame) -> DataFrame:
    """Of each function its `raise` nodes and its docstring, read where the body is opened: a row for each function leaves Python."""
    return functions.select("module", "body").mapInArrow(_census_batches, "module STRING, raises BIGINT, doc STRING")


def artifact_census(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Per module: docstrings, doctests and raises from `census_facts`; asserts, property tests, test files from text.

    A row for each module of either side, none (NULL) among them; asserts are NULL where no code was read.
    """
    one = lambda condition: F.when(condition, 1).otherwise(0).cast("bigint")
    counts = ["docstrings", "doctests", "asserts", "raises", "pbt_files", "pbt_properties", "test_files"]
    counted = lambda df, **found: df.select("module", *[found.get(c, F.lit(None)).cast("bigint").alias(c) for c in counts])
    from_bodies = counted(facts, docstrings=one(F.col("doc") != ""), doctests=one(F.col("doc").rlike(r"(?m)^\s*>>> ")), raises=F.col("raises"))
    path, text = F.col("path"), F.col("text")
    code = sources.where(path.rlike(r"\.(py|c|cc|cpp|h|hpp)$") & ~path.contains(".git"))
    hypothesis = text.contains("hypothesis")
    from_text = counted(
        code, test_files=one(path.rlike(r"(^|/)test[^/]*$") | path.contains("/tests")), asserts=F.regexp_count(text, F.lit(r"(?m)^\s*assert\b")), pbt_files=one(hypothesis),
        pbt_properties=F.when(hypothesis, F.regexp_count(text, F.lit(r"(?m)^\s*@given\b"))),
    )
    zero = lambda c: F.sum(c) if c == "asserts" else F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    return from_bodies.unionByName(from_text).groupBy("module").agg(*[zero(c).alias(c) for c in counts])


def dialect_vote(functions: DataFrame, ext_map: dict[str, str] | None = None, on_unknown: str = "default") -> DataFrame:
    """Majority dialect per corpus by file extension.

    on_unknown: *default* falls back to python (matrix), *refuse* gives status `refused` (renderer),
    *refuse_if_more* refuses when unknown files outnumber known ones and adds the exactness flag (comparison).
    """
    tables = {
        "default": rules.MATRIX_DIALECTS, "refuse": rules.RENDER_DIALECTS, "refuse_if_more": rules.LANGUAGES,
    }
    table = ext_map or tables[on_unknown]
    ext = names.extension(F.coalesce("file", F.lit("")))
    ext = F.lower(ext) if on_unknown == "refuse_if_more" else ext
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    votes = (
        functions.select("module", ext.alias("ext"))
        .groupBy("module", "ext")
        .count()
        .withColumn("vote", F.try_element_at(known, F.col("ext")))
    )
    per_vote = votes.groupBy("module", "vote").agg(
        F.sum("count").alias("n"), F.sum(F.when(F.col("ext") == "", F.col("count")).otherwise(0)).alias("no_ext")
    )
    unknown = F.col("vote").isNull()
    picked = per_vote.groupBy("module").agg(
        F.max(F.when(~unknown, F.struct(F.col("n"), F.col("vote")))).getField("vote").alias("winner"),
        F.coalesce(F.sum(F.when(~unknown, F.col("n"))), F.lit(0)).alias("known_files"),
        F.coalesce(F.sum(F.when(unknown, F.col("n") - F.col("no_ext"))), F.lit(0)).alias("unknown_files"),
    )
    winner = F.col("winner")
    if on_unknown == "default":
        return picked.select(
            "module", F.coalesce(winner, F.lit("python")).alias("dialect"),
            F.when(winner.isNull(), "defaulted").otherwise("voted").alias("status"),
        )
    if on_unknown == "refuse":
        return picked.select(
            "module", winner.alias("dialect"), F.when(winner.isNull(), "refused").otherwise("voted").alias("status")
        )
    refused = winner.isNull() | (F.col("unknown_files") > F.col("known_files"))
    dialect = F.create_map(*[F.lit(x) for k, v in rules.LANGUAGE_DIALECTS.items() for x in (k, v[0])])
    exact = F.create_map(*[F.lit(x) for k, v in rules.LANGUAGE_DIALECTS.items() for x in (k, v[1])])
    language = F.when(~refused, winner)
    return picked.select(
        "module", language.alias("language"), F.try_element_at(dialect, language).alias("dialect"),
        F.try_element_at(exact, language).alias("exact"),
        F.when(refused, "refused").otherwise("voted").alias("status"),
    )


def name_kinds(functions: DataFrame) -> DataFrame:
    kind = names.name_kind(F.col("name"))
    return functions.select("module", "name", kind.alias("kind")).where(F.col("kind").isNotNull()).select(
        "module", "name", "kind.file", "kind.qualname", "kind.is_method"
    )
