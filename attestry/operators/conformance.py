"""Three-valued comparison of recorded and recomputed outcomes: agree, diverge, inconclusive.

A case that was not compared is never a pass, and ignorance (a hole, exhausted fuel) is never agreement.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions import names
from attestry.operators.ledger import percent, tally

CONTAINERS = ("list", "tuple", "dict")
# Words in a reason that put a function beyond the value model rather than beyond the semantics.
VALUE_MODEL_REASONS = [
    "float", "set", "opaque", "complex", "bytes", "frozenset", "container-subclass", "object-as-dict-key", "wide",
    "self-not-object", "representation",
]


# ------------------------------------------------------------------ nested values (JSON arrays [tag, payload])


def _opened(value, base: int):
    """Tag and payload: what a builtin-based object wraps, references shifted, function names as parts from the last one on."""
    tag, *payload = value
    while tag == "bobj":
        tag, *payload = payload[1]
    if tag == "ref":
        return tag, payload[0] + base
    if tag == "fn":
        parts = payload[0].rpartition(":")[2].split(".")
        return tag, tuple(p for p in reversed(parts) if p not in ("<locals>", "<module>"))
    return tag, payload[0] if payload and tag != "unit" else None


def canonical_text(value, base: int = 0) -> str:
    """JSON text of the normal form: dicts as sorted pairs."""
    tag, payload = _opened(value, base)
    if tag in ("list", "tuple"):
        return f'["{tag}", [{", ".join(canonical_text(v, base) for v in payload)}]]'
    if tag == "dict":
        pairs = sorted(f"[{canonical_text(k, base)}, {canonical_text(v, base)}]" for k, v in payload)
        return f'["{tag}", [{", ".join(pairs)}]]'
    if tag == "fn":
        payload = ".".join(reversed(payload))
    return json.dumps([tag] if tag == "unit" else [tag, payload])


def _tokens(value, base: int) -> list[tuple]:
    """The value as a flat list. Pairs of a dict are sorted with function names read backwards, so names that match fall together."""
    tag, payload = _opened(value, base)
    if tag in ("list", "tuple"):
        return [(tag, len(payload)), *(t for v in payload for t in _tokens(v, base))]
    if tag == "dict":
        pairs = sorted((_tokens(k, base) + _tokens(v, base) for k, v in payload), key=repr)
        return [(tag, len(payload)), *(t for pair in pairs for t in pair)]
    return [(tag, payload if tag == "fn" else json.dumps(payload))]


def _matches(a: tuple, b: tuple) -> bool:
    """Tokens are equal; of two function names one may lack leading parts."""
    if a[0] == b[0] == "fn":
        known = min(len(a[1]), len(b[1]))
        return known > 0 and a[1][:known] == b[1][:known]
    return a == b


def compare_values(left, right, base: int) -> str:
    """`clash` where one side hands an object and the other a container, since nobody can say who is right; `same`; `differ`."""
    places = [(left, right)]
    for a, b in places:  # grows while it is read
        kinds = {a[0], _opened(b, 0)[0]}
        if "ref" in kinds and kinds.intersection(CONTAINERS):
            return "clash"
        if kinds in ({"list"}, {"tuple"}):
            places += zip(a[1], _opened(b, 0)[1])
    a, b = _tokens(left, base), _tokens(right, 0)
    return "same" if len(a) == len(b) and all(map(_matches, a, b)) else "differ"


UNREADABLE = (ValueError, TypeError, IndexError, AttributeError, RecursionError)


@F.pandas_udf(T.StringType())
def canonical_json(value: pd.Series, base: pd.Series) -> pd.Series:
    def one(text, shift):
        try:
            return None if text is None else canonical_text(json.loads(text), int(shift))
        except UNREADABLE:
            return None

    return pd.Series([one(t, s) for t, s in zip(value, base)], dtype=object)


@F.pandas_udf(T.StringType())
def _compare_nested(expected: pd.Series, actual: pd.Series, base: pd.Series) -> pd.Series:
    def one(left, right, shift):
        if left is None or right is None:
            return None
        try:
            return compare_values(json.loads(left), json.loads(right), int(shift))
        except UNREADABLE:
            return "unparsable"

    return pd.Series([one(*row) for row in zip(expected, actual, base)], dtype=object)


def canonical_value(df: DataFrame, value: str, base: int = 0, out: str = "canonical") -> DataFrame:
    """Adds the canonical JSON of a nested value. Scalars other than references and functions need no Python."""
    plain = F.col(value).rlike(r'^\["(int|bool|str|float|unit)"')
    nested = F.when(~plain, F.col(value))
    return df.withColumn(out, F.when(plain, F.col(value)).otherwise(canonical_json(nested, F.lit(base))))


# ------------------------------------------------------------------ comparison


def compare_outcomes(cases: DataFrame, answers: DataFrame, base: int = 0) -> DataFrame:
    """One verdict per case with the reason when inconclusive. The order of the tests is part of the meaning.

    cases(case_id, fn, origin, outcome<tag, value>), answers(case_id, tag, value, label), one answer per case.
    Values are JSON arrays [tag, payload]; an exception's value is its name on the case side and a value on the
    answer side. Only values with structure or names in them go through Python; scalars compare as text.
    """
    got = answers.select(
        "case_id", F.col("tag").alias("got_tag"), F.col("value").alias("got_value"), F.col("label").alias("got_label"),
        F.lit(True).alias("answered"),
    )
    scalar = r'^\["(int|bool|str|float|unit)"'
    both = cases.select(
        "case_id", "fn", "origin", F.col("outcome.tag").alias("want_tag"), F.col("outcome.value").alias("want_value")
    ).join(got, "case_id", "left")
    values = (F.col("want_tag") == "val") & (F.col("got_tag") == "val")
    easy = F.col("want_value").rlike(scalar) & F.col("got_value").rlike(scalar)
    deep = values & ~easy
    compared = both.withColumn(
        "nested",
        _compare_nested(F.when(deep, F.col("want_value")), F.when(deep, F.col("got_value")), F.lit(base)),
    )
    got_is_name = F.col("got_value").startswith('["str"')
    got_name = F.when(got_is_name, F.get_json_object("got_value", "$[1]"))
    ignorance = F.col("got_tag").isin("hole", "outOfFuel")
    exceptions = (F.col("want_tag") == "exn") & (F.col("got_tag") == "exn")
    same_name = F.coalesce(got_name == F.col("want_value"), F.lit(False))
    reason = (
        F.when(F.col("answered").isNull(), "no-answer")
        .when(
            ~F.col("got_tag").isin("val", "exn", "hole", "outOfFuel")
            | (F.col("got_tag").isin("val", "exn") & F.col("got_value").isNull())
            | (F.col("nested") == "unparsable"),
            "unparsable",
        )
        .when(ignorance, F.when(F.col("got_tag") == "hole", F.coalesce("got_label", F.lit("?"))).otherwise("outOfFuel"))
        .when(F.col("nested") == "clash", "representation:value-vs-object")
        .when(exceptions & ~same_name & ~got_is_name, "exception-payload-unmodelled")
    )
    agreed = F.when(
        values, F.when(easy, F.col("want_value") == F.col("got_value")).otherwise(F.col("nested") == "same")
    ).otherwise(exceptions & same_name)
    return compared.withColumn("reason", reason).select(
        "case_id", "fn", "origin",
        F.when(F.col("reason").isNotNull(), "inconclusive").when(agreed, "agree").otherwise("diverge").alias("verdict"),
        "reason",
    )


def _counts():
    return [
        F.count_if(F.col("verdict") == "agree").alias("agree"),
        F.count_if(F.col("verdict") == "diverge").alias("diverge"),
        F.count_if(F.col("verdict") == "inconclusive").alias("inconclusive"),
    ]


def rollup_by_origin(verdicts: DataFrame) -> DataFrame:
    """Counts per origin and, in the row `(all)`, over all of them."""
    return (
        verdicts.select(F.coalesce("origin", F.lit("?")).alias("origin"), "verdict")
        .rollup("origin")
        .agg(*_counts(), F.grouping("origin").alias("g"))
        .select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("origin")).alias("origin"), "agree", "diverge", "inconclusive")
    )


def conformance_rate(verdicts: DataFrame, functions: DataFrame, hole_free: DataFrame) -> DataFrame:
    """One row: agree/(agree+diverge), and the functions compared out of all and out of the hole-free."""
    compared = F.when(F.col("verdict") != "inconclusive", F.col("fn"))
    totals = verdicts.agg(*_counts(), F.count_distinct(compared).alias("compared"))
    sizes = functions.agg(F.count("*").alias("functions")).join(hole_free.agg(F.count("*").alias("hole_free")))
    adjudicated = F.col("agree") + F.col("diverge")
    return totals.join(sizes).select(
        "agree", "diverge", "inconclusive", percent(F.col("agree"), adjudicated).alias("rate"), "compared",
        percent("compared", "functions").alias("compared_of_all"),
        percent("compared", "hole_free").alias("compared_of_hole_free"),
    )


def function_status(functions: DataFrame, holed: DataFrame, verdicts: DataFrame, why: DataFrame | None = None) -> DataFrame:
    """One status per function; later tests override earlier ones only where the function was not compared.

    functions(fn), holed(fn), verdicts, why(name, reason): a reason recorded under a dotted tail of the function name.
    """
    label = F.split("reason", ":", -1).getItem(0)
    # Unparsable answers are inconclusive but explain nothing, so they leave no label.
    seen = verdicts.groupBy("fn").agg(
        F.bool_or(F.col("verdict") != "inconclusive").alias("compared"),
        F.sort_array(F.collect_set(F.when(F.col("reason") != "unparsable", label))).alias("labels"),
    )
    flags = functions.select("fn").distinct().join(seen, "fn", "left").join(
        holed.select("fn").distinct().withColumn("holed", F.lit(True)), "fn", "left"
    )
    if why is None:
        flags = flags.withColumn("why", F.lit(None).cast("string"))
    else:
        tails = functions.select("fn").distinct().select("fn", F.explode(names.dotted_tails(F.col("fn"))).alias("name"))
        given = tails.join(why.select("name", F.col("reason").alias("r")), "name").groupBy("fn").agg(F.max("r").alias("why"))
        flags = flags.join(given, "fn", "left")
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    beyond = F.array(F.lit("representation"), F.lit("exception-payload-unmodelled"))
    only_beyond = F.size(F.array_except(labels, beyond)) == 0
    joined = F.array_join(labels, ", ")
    cases_built = F.col("compared").isNotNull()
    text = F.when(cases_built, "cases built, all inconclusive").otherwise(
        F.concat(F.lit("hole-free, no case built"), F.coalesce(F.concat(F.lit(": "), F.col("why")), F.lit("")))
    )
    hit = F.try_element_at(F.filter(F.array(*[F.lit(w) for w in VALUE_MODEL_REASONS]), lambda w: F.contains(text, w)), F.lit(1))
    last = F.element_at(F.split(text, ": ", -1), -1)
    status = (
        F.when(F.coalesce("compared", F.lit(False)), "compared")
        .when(
            F.col("holed"),
            F.when(cases_built, "cases built, all inconclusive").otherwise(
                "not-translated-fully (holes): untestable until translated"
            ),
        )
        .when((F.size(labels) > 0) & only_beyond, F.concat(F.lit("blocked (value model): "), joined))
        .when(F.size(labels) > 0, F.concat(F.lit("blocked (semantics/transpiler): runtime holes "), joined))
        .when(hit.isNotNull(), F.concat(F.lit("blocked (value model): "), hit))
        .otherwise(F.concat(F.lit("blocked (unexercised): "), last))
    )
    return flags.select("fn", status.alias("status"))


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy(F.split("status", ":", -1).getItem(0).alias("status")).agg(F.count("*").alias("n"))


def status_ceiling(statuses: DataFrame) -> DataFrame:
    """How many functions are compared now, and how many more are reachable in principle."""
    blocked = F.col("status").startswith("blocked (value model)")
    return statuses.agg(
        F.count("*").alias("functions"),
        F.count_if(F.col("status") == "compared").alias("compared_now"),
        F.count_if(blocked).alias("blocked_by_value_model"),
        F.count_if(~blocked).alias("reachable_in_principle"),
    )


def tally_reasons(verdicts: DataFrame, top: int = 10) -> DataFrame:
    """`function: reason` counts of the inconclusive cases; unparsable answers are counted but not listed."""
    listed = verdicts.where(F.col("reason").isNotNull() & (F.col("reason") != "unparsable"))
    return tally(listed.select(F.concat_ws(": ", "fn", "reason").alias("why")), "why", top=top)


# ------------------------------------------------------------------ two native runs against another target


def adjudicate_two(duals: DataFrame, width_sensitive: DataFrame | None = None) -> DataFrame:
    """First matching rule per call; functions of pointer-width types are taken out of `ub-suspected`."""
    native, again, other = F.col("native"), F.col("native2"), F.col("other_value")
    has_value = F.col("other_status") == "val"
    memory = F.coalesce("mem_bytes", F.lit(0))
    kind = (
        F.when(
            has_value & native.isNotNull(),
            F.when(other == native, "agree")
            .when(again.isNotNull() & (again != native), "nondeterministic")
            .when((memory != 0) & (other > 0) & (other < memory) & (F.abs(native) > 2**24), "address-valued")
            .otherwise("ub-suspected"),
        )
        .when(F.col("other_status") == "trap", "trap")
        .when(has_value, "native-crash")
        .when(F.col("other_status").isin("unsupported", "missing", "timeout"), "unsupported")
        .otherwise("incomparable")
    )
    judged = duals.withColumn("kind", kind)
    if width_sensitive is None:
        return judged
    wide = width_sensitive.select("fn").distinct().withColumn("wide", F.lit(True))
    return (
        judged.join(wide, "fn", "left")
        .withColumn("kind", F.when((F.col("kind") == "ub-suspected") & F.col("wide"), "width-sensitive").otherwise(F.col("kind")))
        .drop("wide")
    )


def ub_hints(rows: DataFrame) -> DataFrame:
    """Readings of a suspected disagreement, for a human; the attribution is a hint, never a finding."""
    native, other = F.col("native"), F.col("other_value")
    two32, two31 = F.lit(2**32), F.lit(2**31)
    difference = native.cast("decimal(38,0)") - other.cast("decimal(38,0)")
    hints = [
        F.when(native.isNotNull() & (difference % two32 == 0) & (native != other), "width"),
        F.when(F.exists("args", lambda a: F.abs(a) >= 2**16), "large-operands"),
        F.when(
            F.exists("args", lambda a: (a >= 0) & (a < 64)) & F.exists("args", lambda a: a >= 32), "shift-past-width"
        ),
        F.when(native.isNotNull() & ((native >= two31) | (native < -two31)), "beyond-int32"),
    ]
    found = F.array_compact(F.array(*hints))
    return rows.withColumn("hints", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unattributed"))))


# Types whose width follows the pointer, and the shape of a C definition's head.
WIDTH_TYPES = r"\b(long|size_t|ssize_t|uintptr_t|intptr_t|ptrdiff_t|off_t|time_t)\b"
C_DEFINITION = r"^[A-Za-z_][\w \t\*]*?\b(\w+)\s*\([^;{]*\)\s*\{"


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("fn", T.StringType()), T.StructField("text", T.StringType())])))
def _c_definitions(texts: pd.Series) -> pd.Series:
    import re

    head, brace = re.compile(C_DEFINITION, re.M), re.compile(r"[{}]")

    def one(text):
        out = []
        for m in head.finditer(text or ""):
            depth, end = 0, len(text)
            for b in brace.finditer(text, m.end() - 1):
                depth += 1 if b.group() == "{" else -1
                if depth == 0:
                    end = b.end()
                    break
            out.append({"fn": m.group(1), "text": text[m.start():end]})
        return out

    return texts.map(one)


def width_sensitive(sources: DataFrame) -> DataFrame:
    """C functions whose text, comments included, mentions a pointer-width type. Over-approximates on purpose."""
    c_files = sources.where(F.col("path").rlike(r"\.[ch]$"))
    return (
        c_files.select(F.explode(_c_definitions("text")).alias("d"))
        .where(F.col("d.text").rlike(WIDTH_TYPES))
        .select("d.fn")
        .distinct()
    )


# ------------------------------------------------------------------ execution oracle


def execution_verdict(core: DataFrame, cases: DataFrame, answers: DataFrame, examples: int = 4) -> DataFrame:
    """Per claimed-core function: verified, holed or inconclusive. Labels `harness:` count as no answer at all."""
    got = answers.select("case_id", "tag", F.coalesce("label", F.lit("?")).alias("label"))
    harness = (F.col("tag") == "hole") & F.col("label").startswith("harness:")
    joined = (
        core.select("fn").distinct()
        .join(cases.select("case_id", "fn", "origin", "args"), "fn", "left")
        .join(got, "case_id", "left")
        .withColumn("tag", F.when(~harness & F.col("tag").isin("val", "exn", "hole", "outOfFuel"), F.col("tag")))
    )
    hole, real = F.col("tag") == "hole", F.col("origin") == "test-suite"
    counted = joined.groupBy("fn").agg(
        F.count("case_id").alias("cases"),
        F.count("tag").alias("answered"),
        F.count_if(F.col("tag").isin("val", "exn")).alias("ok"),
        F.count_if(hole).alias("holes"),
        F.count_if(F.col("tag") == "outOfFuel").alias("fuel"),
        F.count_if(F.col("case_id").isNotNull() & F.col("tag").isNull()).alias("no_answer"),
        F.count_if(real).alias("real_cases"),
        F.count_if(hole & real).alias("real_holes"),
        F.count_if(hole & ~real).alias("synth_holes"),
    )
    first = Window.partitionBy("fn").orderBy("case_id")
    shown = (
        joined.where(hole)
        .withColumn("r", F.row_number().over(first))
        .where(F.col("r") <= examples)
        .groupBy("fn")
        .agg(F.sort_array(F.collect_list(F.struct("r", "label", "origin", "args"))).alias("hole_examples"))
    )
    verdict = (
        F.when((F.col("answered") == 0) | ((F.col("ok") == 0) & (F.col("holes") == 0)), "inconclusive")
        .when(F.col("holes") > 0, "holed")
        .otherwise("verified")
    )
    return counted.join(shown, "fn", "left").withColumn("verdict", verdict)


def execution_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(
        F.count("*").alias("claimed"),
        F.count_if(F.col("verdict") == "verified").alias("verified"),
        F.count_if(F.col("verdict") == "holed").alias("holed"),
        F.count_if((F.col("verdict") == "holed") & (F.col("real_holes") > 0)).alias("holed_on_real_cases"),
        F.count_if(F.col("verdict") == "inconclusive").alias("inconclusive"),
        F.count_if((F.col("real_cases") > 0) & (F.col("real_holes") == 0) & (F.col("ok") > 0)).alias("verified_on_real_cases"),
    ).withColumn("overstatement", overstatement(F.col("claimed"), F.col("verified")))


def overstatement(claimed, survived):
    """Claimed over what survived execution."""
    return claimed / F.greatest(survived, F.lit(1))


def staleness(ast_functions: DataFrame, module_functions: DataFrame) -> DataFrame:
    """Both sides (name, holes): names missing from the module are fatal, extra ones a note, hole totals a flag."""
    ast = ast_functions.groupBy("name").agg(F.sum("holes").alias("ast_holes"))
    module = module_functions.groupBy("name").agg(F.sum("holes").alias("module_holes"))
    totals = ast.join(module, "name", "full_outer").agg(
        F.count_if(F.col("module_holes").isNull()).alias("missing"),
        F.count_if(F.col("ast_holes").isNull()).alias("extra"),
        F.coalesce(F.sum("ast_holes"), F.lit(0)).alias("ast_holes"),
        F.coalesce(F.sum("module_holes"), F.lit(0)).alias("module_holes"),
    )
    return totals.withColumn(
        "status",
        F.when(F.col("missing") > 0, "fatal")
        .when(F.col("ast_holes") != F.col("module_holes"), "body-stale")
        .otherwise("fresh"),
    )


def quota_sample(
    cases: DataFrame, per_fn: int, max_total: int | None = None, seed: str = "20260819",
    key: str = "fn", order: str = "case_id", identity: list[str] | None = None,
) -> DataFrame:
    """At most `per_fn` cases per function in arrival order, then a seeded global cap.

    `identity` names the columns of a canonical input: of equal inputs the first to arrive is kept.
    """
    if identity:
        first = cases.groupBy(key, *identity).agg(F.min(order).alias(order))
        cases = cases.join(first.select(order), order, "left_semi")
    ranked = cases.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    kept = ranked.where(F.col("_r") <= per_fn).drop("_r")
    if max_total is None:
        return kept
    return kept.orderBy(F.md5(F.concat_ws(":", F.col(order).cast("string"), F.lit(seed))), order).limit(max_total)
