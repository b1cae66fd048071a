"""Column rules for qualified names: dotted tails, owning class, mangling, identifiers, import paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dotted_tails(name) -> Column:
    """Every string after a dot, longest first; a name without a dot has none."""
    parts = F.split(name, "[.]", -1)
    n = F.size(parts)
    tails = F.transform(
        F.sequence(F.lit(2), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), ".")
    )
    return F.when(n >= 2, tails).otherwise(F.array().cast("array<string>"))


def module_qualname(name) -> Column:
    """What follows `:<module>.`, or NULL when the name has no such part."""
    found = F.regexp_extract(name, r"^[^\n]+?:<module>\.([^\n]+)$", 1)
    return F.when(found != "", found)


def class_of(name) -> Column:
    """Owning class of a qualified name; the signature of `ns.C.m:sig` is cut off before looking for dots."""
    head = F.coalesce(module_qualname(name), F.split(name, ":").getItem(0))
    parts = F.split(head, "[.]", -1)
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2)))


def name_kind(name) -> Column:
    """STRUCT<file, qualname, is_method>; NULL for names outside a module or holding `<`."""
    qual = module_qualname(name)
    file = F.regexp_extract(name, r"^([^\n]+?):<module>\.[^\n]+$", 1)
    return F.when(
        qual.isNotNull() & ~qual.contains("<"),
        F.struct(file.alias("file"), qual.alias("qualname"), qual.contains(".").alias("is_method")),
    )


def extension(file) -> Column:
    """Last extension of the base name, dot included; a leading dot is not an extension."""
    base = F.regexp_extract(file, r"([^/]*)$", 1)
    return F.regexp_extract(base, r"^\.*[^.].*(\.[^.]*)$", 1)


def mangle(name, cls) -> Column:
    """`__x` inside class `C` is `_C__x`: two leading underscores, not two trailing ones, and a class name
    that is not all underscores."""
    bare = F.ltrim(cls, F.lit("_"))
    private = (bare != "") & name.startswith("__") & ~name.endswith("__")
    return F.when(private, F.concat(F.lit("_"), bare, name)).otherwise(name)


def plain_ident(name, limit: int = 120) -> Column:
    """Identifier made of [A-Za-z0-9_] only, prefixed and cut."""
    return F.substring(F.concat(F.lit("f_"), F.regexp_replace(name, "[^A-Za-z0-9_]", "_")), 1, limit)


def trimmed_fn_name(name) -> Column:
    """A function value's name without the segments no program can refer to."""
    last = F.element_at(F.split(name, ":", -1), -1)
    return F.array_join(
        F.filter(F.split(last, "[.]", -1), lambda p: ~p.isin("<locals>", "<module>")), "."
    )


def suffix_names_equal(a, b) -> Column:
    """Equal, or one is a dotted suffix of the other. Not transitive, so never a join key."""
    return (a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a))


def path_suffixes(path) -> Column:
    """The path and what is left after dropping leading segments one at a time, longest first."""
    parts = F.split(path, "/", -1)
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "/"))
