"""Comparison, truth, membership and the modelled library, as Column expressions.

Scalars carry their kind beside their text; NULL means "cannot say", which callers report as inconclusive.
Lists are ARRAY<STRING> of canonical texts, dicts ARRAY<STRUCT<k, v>> in insertion order with unique keys.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions.numeric import INT, power_of_two, whole

# ------------------------------------------------------------------ comparison


def as_int(text) -> Column:
    return text.try_cast(INT)


def as_float(text) -> Column:
    return text.try_cast("double")


def compare_floats(x: Column, y: Column) -> Column:
    """-1, 0, 1, or NULL when unordered. Spark's own `=` calls NaN equal to NaN."""
    return F.when(F.isnan(x) | F.isnan(y), F.lit(None)).otherwise(
        F.when(x < y, -1).when(x > y, 1).otherwise(0)
    )


def float_floor_as_int(y: Column) -> Column:
    """The integer part of a finite double below 2**126, exactly. A plain cast goes through decimal text and rounds."""
    magnitude = F.abs(y)
    exponent = F.floor(F.log2(F.when(magnitude >= 2.0**62, magnitude))) - 53
    mantissa = (y / F.pow(F.lit(2.0), exponent)).cast("bigint").cast(INT)
    big = F.try_multiply(mantissa, power_of_two(exponent)).cast(INT)
    small = F.when(magnitude < 2.0**62, y).cast("bigint").cast(INT)
    return F.when(magnitude < 2.0**62, small).otherwise(big)


def compare_int_float(n: Column, y: Column, exact: Column) -> Column:
    """Exact where `exact` (python), else after promotion to double (C)."""
    finite = ~F.isnan(y) & (F.abs(y) < float("inf"))
    small = F.when(finite & (F.abs(y) < 2.0**126), y)
    floor = float_floor_as_int(small)
    fraction = F.when(F.abs(small) < 2.0**62, small - small.cast("bigint").cast("double")).otherwise(F.lit(0.0))
    exactly = (
        F.when(F.isnan(y), F.lit(None))
        .when(small.isNull(), F.when(y > 0, -1).otherwise(1))
        .when(n < floor, -1)
        .when(n > floor, 1)
        .when(fraction > 0, -1)
        .when(fraction < 0, 1)
        .otherwise(0)
    )
    return F.when(exact, exactly).otherwise(compare_floats(n.cast("double"), y))


def compare_scalars(a_kind, a, b_kind, b, python) -> Column:
    """-1, 0, 1 or NULL over (int|float) x (int|float) and, where strings are values, str x str."""
    i, j, x, y = as_int(a), as_int(b), as_float(a), as_float(b)
    ints = F.when(i < j, -1).when(i > j, 1).when(i == j, 0)
    strs = F.when(a < b, -1).when(a > b, 1).otherwise(0)
    kinds = F.concat_ws(" ", a_kind, b_kind)
    return (
        F.when(kinds == "int int", ints)
        .when(kinds == "float float", compare_floats(x, y))
        .when(kinds == "int float", compare_int_float(i, y, python))
        .when(kinds == "float int", -compare_int_float(j, x, python))
        .when((kinds == "str str") & python, strs)
    )


def relation(op: Column, a_kind, a, b_kind, b, python) -> Column:
    """Truth of a relational operator; NULL when it cannot be said. NaN is false everywhere except `!=`."""
    order = compare_scalars(a_kind, a, b_kind, b, python)
    numeric = a_kind.isin("int", "float") & b_kind.isin("int", "float")
    strings = (a_kind == "str") & (b_kind == "str")
    is_zero = F.coalesce(order == 0, F.lit(False))
    ordered = (
        F.when(op == "<", F.coalesce(order < 0, F.lit(False)))
        .when(op == "<=", F.coalesce(order <= 0, F.lit(False)))
        .when(op == ">", F.coalesce(order > 0, F.lit(False)))
        .when(op == ">=", F.coalesce(order >= 0, F.lit(False)))
        .when(op == "==", is_zero)
        .when(op == "!=", ~is_zero)
    )
    # Only < and > are modelled on strings besides equality.
    comparable = numeric | (strings & python & op.isin("<", ">", "==", "!="))
    other_equality = F.when(~strings & op.isin("==", "!="), ((a_kind == b_kind) & a.eqNullSafe(b)) == (op == "=="))
    return F.when(comparable, ordered).otherwise(other_equality)


def truthy(kind: Column, text: Column) -> Column:
    return (
        F.when(kind == "bool", F.lower(text) == "true")
        .when(kind == "int", as_int(text) != 0)
        .when(kind == "float", F.isnan(as_float(text)) | (as_float(text) != 0))
        .when(kind == "str", text != "")
        .when(kind == "unit", F.lit(False))
        .when(kind.isin("list", "tuple", "dict"), ~text.isin("[]", "{}"))
        .otherwise(F.lit(True))
    )


def identical(a_kind, a, b_kind, b) -> Column:
    """Three-valued: two ints or two strings may or may not be one object."""
    by_value = F.when(a_kind.isin("ref", "fn", "bool"), a == b).when(a_kind == "unit", F.lit(True))
    closures = F.when(a_kind.isin("clos", "clsClos") & (a != b), F.lit(False))
    return F.when(a_kind != b_kind, F.lit(False)).otherwise(F.coalesce(by_value, closures))


def contains(item_kind, item, box_kind, elements: Column, text: Column) -> Column:
    """Element of a list or tuple, key of a dict (`elements` holds its keys), substring of a string; else NULL."""
    within = F.when(box_kind.isin("list", "tuple", "dict"), F.array_contains(elements, item))
    return within.otherwise(F.when((box_kind == "str") & (item_kind == "str"), F.contains(text, item)))


# ------------------------------------------------------------------ float arithmetic


def float_arithmetic(op: Column, x: Column, y: Column, python: Column) -> Column:
    """STRUCT<outcome, value>. A zero divisor raises under python and follows IEEE 754 under C."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    zero = y == 0
    safe = F.when(~zero, y)
    signed_inf = F.when(F.isnan(x) | (x == 0), nan).when((x > 0) == _positive(y), inf).otherwise(-inf)
    r = x % safe
    py_mod = F.when((r != 0) & ((r < 0) != (safe < 0)), r + safe).otherwise(r)
    value = (
        F.when(op == "+", x + y)
        .when(op == "-", x - y)
        .when(op == "*", x * y)
        .when(op == "/", F.when(zero, signed_inf).otherwise(x / safe))
        .when(op == "%", F.when(zero, nan).otherwise(py_mod))
    )
    raises = python & zero & op.isin("/", "%")
    return F.struct(
        F.when(raises, "divZero").when(value.isNull(), "unmodelled").otherwise("ok").alias("outcome"),
        F.when(~raises, value).alias("value"),
    )


def _positive(y: Column) -> Column:
    """Sign of a zero: negative zero prints its sign."""
    return ~y.cast("string").startswith("-")


# ------------------------------------------------------------------ modelled library on lists and dicts


def int_list_call(name: str, ints: Column) -> Column:
    """len, sum, min, max, sorted of an all-int list; min and max of an empty one are NULL (ValueError)."""
    return {
        "len": F.size(ints).cast("bigint"),
        "sum": F.aggregate(ints, F.lit(0).cast(INT), lambda acc, v: (acc + v).cast(INT)),
        "min": F.array_min(ints),
        "max": F.array_max(ints),
        "sorted": F.sort_array(ints),
    }[name]


def str_len(text: Column) -> Column:
    return F.char_length(text)


def code_point(text: Column) -> Column:
    """`ord` of a one-character string; NULL (TypeError) otherwise."""
    return F.when(F.char_length(text) == 1, F.ascii(text))


def character(code: Column) -> Column:
    """`chr` of a code point, through UTF-32 bytes: Spark's own `chr` wraps at 256. Surrogates are unanswered.

    The bytes begin with a mark of their order, since the decoder takes the first U+FEFF for one.
    """
    valid = (code >= 0) & (code < 1114112) & ~code.between(55296, 57343)
    return F.when(valid, F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(F.when(valid, code)), 8, "0"))), "UTF-32"))


def list_count(items: Column, x: Column) -> Column:
    return F.size(F.filter(items, lambda v: v == x))


def list_index(items: Column, x: Column) -> Column:
    """Zero-based index of the first occurrence; NULL (ValueError) when absent."""
    return F.nullif(F.array_position(items, x), F.lit(0).cast("bigint")) - 1


def _mutated(value: Column, receiver: Column, raised: Column | None = None) -> Column:
    return F.struct(value.alias("value"), receiver.alias("receiver"), (raised if raised is not None else F.lit(None).cast("string")).alias("raised"))


def _take(items, n):
    return F.slice(items, F.lit(1), n)


def _drop(items, n):
    return F.slice(items, n + 1, F.greatest(F.size(items) - n, F.lit(0)))


def list_append(items, x):
    return _mutated(F.lit(None), F.concat(items, F.array(x)))


def list_extend(items, more):
    return _mutated(F.lit(None), F.concat(items, more))


def list_insert(items, i, x):
    """A negative index counts from the end; out of range clamps, and nothing is raised."""
    n = F.size(items)
    at = F.when(i < 0, F.greatest(F.lit(0), n + i)).otherwise(F.least(i, n)).cast("int")
    return _mutated(F.lit(None), F.concat(_take(items, at), F.array(x), _drop(items, at)))


def list_remove(items, x):
    at = (F.array_position(items, x) - 1).cast("int")
    missing = at < 0
    safe = F.greatest(at, F.lit(0))
    rest = F.concat(_take(items, safe), _drop(items, safe + 1))
    return _mutated(F.lit(None), F.when(missing, items).otherwise(rest), F.when(missing, "ValueError"))


def list_pop(items, i=None):
    """The last element, or the one at a Python index; IndexError out of range."""
    n = F.size(items)
    i = F.lit(-1) if i is None else i
    at = F.when(i < 0, n + i).otherwise(i).cast("int")
    missing = (at < 0) | (at >= n)
    safe = F.when(missing, 0).otherwise(at)
    rest = F.concat(_take(items, safe), _drop(items, safe + 1))
    value = F.when(~missing, F.try_element_at(items, safe + 1))
    return _mutated(value, F.when(missing, items).otherwise(rest), F.when(missing, "IndexError"))


def dict_get(pairs, k, default=None):
    hit = F.try_element_at(F.filter(pairs, lambda p: p["k"] == k), F.lit(1))
    return F.when(hit.isNotNull(), hit["v"]).otherwise(F.lit(None).cast("string") if default is None else default)


def dict_has(pairs, k):
    return F.exists(pairs, lambda p: p["k"] == k)


def dict_keys(pairs):
    return F.transform(pairs, lambda p: p["k"])


def dict_values(pairs):
    return F.transform(pairs, lambda p: p["v"])


def _without(pairs, k):
    return F.filter(pairs, lambda p: p["k"] != k)


def dict_set(pairs, k, v):
    """Replace in place when present, else append: the insertion-order rule."""
    new = F.struct(k.alias("k"), v.alias("v"))
    replaced = F.transform(pairs, lambda p: F.when(p["k"] == k, new).otherwise(p))
    return F.when(dict_has(pairs, k), replaced).otherwise(F.concat(pairs, F.array(new)))


def dict_pop(pairs, k, default=None):
    found = dict_has(pairs, k)
    raised = F.when(~found, "KeyError") if default is None else None
    return _mutated(dict_get(pairs, k, default), _without(pairs, k), raised)


def dict_popitem(pairs):
    """The last inserted pair; KeyError when empty."""
    n = F.size(pairs)
    return _mutated(
        F.try_element_at(pairs, F.lit(-1)), F.slice(pairs, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.when(n == 0, "KeyError"),
    )


def dict_setdefault(pairs, k, default):
    found = dict_has(pairs, k)
    return _mutated(dict_get(pairs, k, default), F.when(found, pairs).otherwise(dict_set(pairs, k, default)))


def dict_update(pairs, other):
    """Existing keys keep their place and take the new value; new ones follow in the order of `other`."""
    updated = F.transform(
        pairs, lambda p: F.struct(p["k"].alias("k"), F.when(dict_has(other, p["k"]), dict_get(other, p["k"])).otherwise(p["v"]).alias("v"))
    )
    return _mutated(F.lit(None), F.concat(updated, F.filter(other, lambda p: ~dict_has(pairs, p["k"]))))


def int_value(kind, text) -> Column:
    """`int` of an int or a bool; no string parsing."""
    return F.when(kind == "int", as_int(text)).when(kind == "bool", F.when(F.lower(text) == "true", whole(1)).otherwise(whole(0)))


def str_value(kind, text) -> Column:
    """`str` of an int or a bool only: a string value may stand for an exception."""
    return F.when(kind == "int", as_int(text).cast("string")).when(kind == "bool", F.initcap(text))
