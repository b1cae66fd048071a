"""Program-graph operators: effects, call resolution and closure, imports, scopes, reachability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry import rules
from attestry.functions import names
from attestry.operators.ranking import rank_in_group


# ------------------------------------------------------------------ effects and priority


def classify_effects(
    calls_code: DataFrame, patterns: dict[str, list[str]] | None = None, key: list[str] | None = None, code: str = "code"
) -> DataFrame:
    """Per function the effect classes with a pattern inside its lower-cased call texts.

    The texts are tested row by row and the classes unioned, so no function's texts are gathered in one place.
    A pattern spanning two joined texts needs a space in it; such patterns are refused rather than missed.
    """
    patterns = patterns or rules.EFFECT_PATTERNS
    if any(" " in p for ps in patterns.values() for p in ps):
        raise ValueError("effect patterns must not contain a space")
    key = key or ["module", "fn"]
    lowered = F.lower(F.coalesce(F.col(code), F.lit("")))
    flags = [
        F.max(reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(p)) for p in ps])).alias(f"_e{i}")
        for i, ps in enumerate(patterns.values())
    ]
    hits = [F.when(F.col(f"_e{i}"), F.lit(cls)) for i, cls in enumerate(patterns)]
    return (
        calls_code.groupBy(*key)
        .agg(*flags)
        .select(*key, F.array_compact(F.array(*hits)).alias("effects"))
    )


def fanout(calls: DataFrame, key: list[str] | None = None, callee: str = "callee", functions: DataFrame | None = None) -> DataFrame:
    """Distinct resolved callees per function and their count; with `functions` (its key), also of those that call nothing."""
    key = key or ["module", "fn"]
    found = (
        calls.where(F.col(callee).isNotNull())
        .select(*key, callee)
        .distinct()
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list(callee)).alias("callees"), F.count("*").alias("fanout"))
    )
    if functions is None:
        return found
    none = F.array().cast("array<string>")
    return functions.select(*key).join(found, key, "left").select(
        *key, F.coalesce("callees", none).alias("callees"), F.coalesce("fanout", F.lit(0)).alias("fanout")
    )


def priority_score(stats: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds `formalizability` and `pure`. Needs n_effects, fanout, loc, branches."""
    w = weights or rules.PRIORITY_WEIGHTS
    score = (
        F.lit(w["base"])
        - F.col("n_effects") * w["effect"]
        - F.col("fanout") * w["fanout"]
        - F.col("loc") * w["loc"]
        - F.col("branches") * w["branch"]
    )
    return stats.withColumn("formalizability", score).withColumn("pure", F.col("n_effects") == 0)


def pure_leaves(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("functions"), F.count_if(F.col("pure") & (F.col("fanout") == 0)).alias("pure_leaves")
    )


# ------------------------------------------------------------------ call resolution and closure


def resolve_index(functions: DataFrame) -> DataFrame:
    """One row per name something may be called by: is it a full name, and how many full names end in `.name`."""
    table = functions.select("module", "name")
    exact = table.select("module", F.col("name").alias("key"), F.lit(1).alias("exact"), F.lit(0).alias("tail"))
    tails = table.select("module", F.explode(names.dotted_tails(F.col("name"))).alias("key")).select(
        "module", "key", F.lit(0).alias("exact"), F.lit(1).alias("tail")
    )
    return (
        exact.unionByName(tails)
        .groupBy("module", "key")
        .agg((F.max("exact") == 1).alias("is_name"), F.sum("tail").alias("suffix_count"))
    )


def answered(is_method, index_is_name, suffix_count, builtin):
    count = F.coalesce(suffix_count, F.lit(0))
    free = F.coalesce(index_is_name, F.lit(False)) | (count == 1) | builtin
    return F.when(is_method, count >= 1).otherwise(free)


def resolve_calls(
    calls: DataFrame, functions: DataFrame, builtins: list[str] | None = None, dialects: DataFrame | None = None
) -> DataFrame:
    """Resolution of each distinct callee on its own path.

    Free: exact name, else a unique dotted suffix, else a modelled builtin (python dialect only); two suffix
    matches resolve to nothing. Method: any suffix match. `dialects` is (module, dialect); without it, python.
    """
    builtins = rules.BUILTIN_FREE_NAMES if builtins is None else builtins
    callees = calls.select("module", "is_method", "callee").distinct()
    joined = callees.join(
        resolve_index(functions).withColumnRenamed("key", "callee"), ["module", "callee"], "left"
    )
    known = F.col("callee").isin(builtins)
    if dialects is not None:
        joined = joined.join(dialects.select("module", "dialect"), "module", "left")
        known = known & (F.coalesce("dialect", F.lit("python")) == "python")
    resolved = answered(F.col("is_method"), F.col("is_name"), F.col("suffix_count"), known)
    return joined.select("module", "is_method", "callee", resolved.alias("resolved"))


def resolve_method(requests: DataFrame, functions: DataFrame) -> DataFrame:
    """Dispatch target of each (cls, meth): first function in table order ending in `.cls.meth`, else the free
    rule on `meth`. `functions` carries its table order in `pos`."""
    tails = functions.select(
        "module", "name", "pos", F.explode(names.dotted_tails(F.col("name"))).alias("key")
    )
    by_tail = tails.groupBy("module", "key").agg(
        F.min_by("name", "pos").alias("first_name"), F.count("*").alias("n")
    )
    exact = functions.select("module", F.col("name").alias("meth")).distinct().withColumn("is_name", F.lit(True))
    qualified = by_tail.select("module", F.col("key").alias("qual"), F.col("first_name").alias("qualified_name"))
    suffix = by_tail.where(F.col("n") == 1).select(
        "module", F.col("key").alias("meth"), F.col("first_name").alias("suffix_name")
    )
    target = F.coalesce(
        "qualified_name", F.when(F.col("is_name"), F.col("meth")), "suffix_name"
    )
    return (
        requests.select("module", "cls", "meth")
        .distinct()
        .withColumn("qual", F.concat_ws(".", "cls", "meth"))
        .join(qualified, ["module", "qual"], "left")
        .join(exact, ["module", "meth"], "left")
        .join(suffix, ["module", "meth"], "left")
        .select("module", "cls", "meth", target.alias("target"))
    )


def class_defines(requests: DataFrame, functions: DataFrame) -> DataFrame:
    """The (cls, meth) pairs the class itself defines; no free-function fallback."""
    tails = functions.select("module", F.explode(names.dotted_tails(F.col("name"))).alias("qual"))
    return (
        requests.select("module", "cls", "meth")
        .distinct()
        .withColumn("qual", F.concat_ws(".", "cls", "meth"))
        .join(tails, ["module", "qual"], "left_semi")
        .select("module", "cls", "meth")
    )


def call_closed(hole_free: DataFrame, calls: DataFrame, resolved: DataFrame) -> DataFrame:
    """Hole-free functions all of whose calls resolve on the path each call takes."""
    unresolved = resolved.where(~F.col("resolved"))
    leaking = calls.join(unresolved, ["module", "is_method", "callee"], "left_semi").select(
        "module", F.col("fn").alias("name"), *([F.col("fn_pos").alias("pos")] if "fn_pos" in calls.columns else [])
    )
    return hole_free.join(leaking, [c for c in leaking.columns if c in hole_free.columns], "left_anti")


def resolve_calls_by_scan(
    calls: DataFrame, functions: DataFrame, builtins: list[str] | None = None, dialects: DataFrame | None = None
) -> DataFrame:
    """A second derivation of `resolve_calls`, from the definition `name ends with "." + callee`.

    A name can only end with "." + callee when its last s segments are the callee, s being the callee's own
    segment count; that makes the suffix test an equality without building the tail index.
    """
    builtins = rules.BUILTIN_FREE_NAMES if builtins is None else builtins
    callees = calls.select("module", "is_method", "callee").distinct().withColumn(
        "segments", F.size(F.split("callee", "[.]", -1))
    )
    lengths = callees.groupBy("module").agg(F.collect_set("segments").alias("lengths"))
    table = functions.select("module", "name").join(lengths, "module")
    n = F.size(F.split("name", "[.]", -1))
    cut = table.select("module", "name", n.alias("n"), F.explode("lengths").alias("segments")).where(
        F.col("n") > F.col("segments")
    )
    suffixes = cut.groupBy("module", F.expr("substring_index(name, '.', -segments)").alias("callee")).agg(
        F.count("*").alias("suffix_count")
    )
    exact = functions.select("module", F.col("name").alias("callee")).distinct().withColumn("is_name", F.lit(True))
    joined = callees.join(suffixes, ["module", "callee"], "left").join(exact, ["module", "callee"], "left")
    known = F.col("callee").isin(builtins)
    if dialects is not None:
        joined = joined.join(dialects.select("module", "dialect"), "module", "left")
        known = known & (F.coalesce("dialect", F.lit("python")) == "python")
    resolved = answered(F.col("is_method"), F.col("is_name"), F.col("suffix_count"), known)
    return joined.select("module", "is_method", "callee", resolved.alias("resolved"))


def closure_agrees(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names in one closure and not the other, with the side they are on; empty means the two agree."""
    left, right = a.select("module", "name"), b.select("module", "name")
    return (
        left.exceptAll(right).withColumn("only_in", F.lit("first"))
        .unionByName(right.exceptAll(left).withColumn("only_in", F.lit("second")))
    )


# ------------------------------------------------------------------ imports and modules


def _module_path(full_name):
    """`a/__init__.py:<module>` is `a`, and the parse root is the empty path."""
    stem = F.regexp_replace(full_name, r"\.py:<module>$", "")
    return F.when(stem == "__init__", F.lit("")).otherwise(F.regexp_replace(stem, r"/__init__$", ""))


def module_spellings(modules: DataFrame) -> DataFrame:
    """The path each module answers to; a plain file wins over a package of the same path."""
    name = F.col("full_name")
    return (
        modules.where(name.endswith(".py:<module>"))
        .select(
            _module_path(name).alias("path"),
            F.when(name.rlike(r"(^|/)__init__\.py:<module>$"), 1).otherwise(0).alias("package"),
            name.alias("module_name"),
        )
        .groupBy("path")
        .agg(F.min_by("module_name", "package").alias("module_name"))
    )


def resolve_module(paths: DataFrame, modules: DataFrame, path: str = "path") -> DataFrame:
    """Module of each path; if missing, leading segments are dropped one at a time and the longest hit wins.

    Dropping every segment never happens: the empty path would answer for any import.
    """
    segments = F.filter(F.split("path", "/", -1), lambda s: s != "")
    clean = paths.select(F.col(path).alias("path")).distinct().withColumn("clean", F.array_join(segments, "/"))
    suffixes = clean.where(F.col("clean") != "").select(
        "path", F.posexplode(names.path_suffixes(F.col("clean"))).alias("dropped", "suffix")
    )
    spelled = module_spellings(modules).withColumnRenamed("path", "suffix")
    best = (
        suffixes.join(spelled, "suffix")
        .groupBy("path")
        .agg(F.min_by("module_name", "dropped").alias("module_name"), F.min("dropped").alias("dropped"))
    )
    return clean.select("path").join(best, "path", "left")


def classify_import(
    imports: DataFrame, modules: DataFrame, functions: DataFrame, classes: DataFrame, aliases: DataFrame
) -> DataFrame:
    """What each import binds: function, class, alias, submodule, module, unit, or one of the absence labels.

    imports(file, prefix, name, aliased); modules/functions/classes(full_name); aliases(module_name, name).
    """
    dots = F.length(F.regexp_extract("prefix", r"^(\.*)", 1))
    rest = F.expr("substring(prefix, length(regexp_extract(prefix, '^([.]*)', 1)) + 1)")
    plain = (dots == 0) & (rest == "")
    name_segs = F.filter(F.split("name", "[.]", -1), lambda s: s != "")
    bound = F.when(F.col("aliased"), name_segs).otherwise(F.slice(name_segs, 1, 1))
    file_segs = F.split("file", "/", -1)
    kept = F.greatest(F.size(file_segs) - 1 - F.greatest(dots - 1, F.lit(0)), F.lit(0))
    base = F.when(dots == 0, F.array().cast("array<string>")).otherwise(F.slice(file_segs, F.lit(1), kept))
    rest_segs = F.filter(F.split(rest, "[.]", -1), lambda s: s != "")
    path = F.array_join(F.when(plain, bound).otherwise(F.concat(base, rest_segs)), "/")
    wanted = imports.select(
        "file", "prefix", "name", "aliased", plain.alias("plain"), (dots > 0).alias("relative"), path.alias("path")
    )
    resolved = resolve_module(wanted, modules)
    target = F.concat_ws(".", "module_name", "name")
    child = F.when(F.col("module_path") == "", F.col("name")).otherwise(F.concat_ws("/", "module_path", "name"))
    located = (
        wanted.join(resolved, "path", "left")
        .withColumn("module_path", _module_path(F.col("module_name")))
        .withColumn("target", target)
        .withColumn("child", child)
    )
    flag = lambda df, cols, name: df.select(*cols).distinct().withColumn(name, F.lit(True))
    members = (
        located.join(flag(functions, [F.col("full_name").alias("target")], "is_fn"), "target", "left")
        .join(flag(classes, [F.col("full_name").alias("target")], "is_cls"), "target", "left")
        .join(flag(aliases, ["module_name", "name"], "is_alias"), ["module_name", "name"], "left")
        .join(flag(module_spellings(modules), [F.col("path").alias("child")], "is_sub"), "child", "left")
        .join(_prefix_known(wanted, modules), "path", "left")
    )
    segs = F.split("path", "/", -1)
    future = F.element_at(segs, -1).contains("__future__") | F.element_at(segs, 1).contains("__future__")
    absent = (
        F.when(future, "unit")
        .when(F.col("relative"), "import:absent:relative")
        .when(F.col("prefix_known"), "import:absent:prefix-in-cpg")
        .otherwise("import:absent:external")
    )
    outcome = (
        F.when(F.col("module_name").isNull(), absent)
        .when(F.col("plain"), "module")
        .when(F.col("is_fn"), "function")
        .when(F.col("is_cls"), "class")
        .when(F.col("is_alias"), "alias")
        .when(F.col("is_sub"), "submodule")
        .otherwise("import:member-not-found")
    )
    return members.select("file", "prefix", "name", "aliased", "path", "module_name", outcome.alias("outcome"))


def _prefix_known(wanted: DataFrame, modules: DataFrame) -> DataFrame:
    """Paths some proper prefix of which resolves to a module of the corpus."""
    segs = F.filter(F.split("path", "/", -1), lambda s: s != "")
    prefixes = (
        wanted.select("path").distinct().withColumn("segs", segs).where(F.size("segs") > 1).select(
            "path",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.size("segs") - 1), lambda i: F.array_join(F.slice("segs", F.lit(1), i), "/")
                )
            ).alias("prefix_path"),
        )
    )
    hits = resolve_module(prefixes, modules, "prefix_path").where(F.col("module_name").isNotNull())
    return (
        prefixes.join(hits.select(F.col("path").alias("prefix_path")), "prefix_path", "left_semi")
        .select("path")
        .distinct()
        .withColumn("prefix_known", F.lit(True))
    )


def vocabulary_violations(outcomes: DataFrame, vocabulary: list[str] | None = None, column: str = "outcome") -> DataFrame:
    """Import labels outside the closed vocabulary."""
    vocabulary = vocabulary or rules.IMPORT_LABELS
    return outcomes.where(F.col(column).startswith("import:") & ~F.col(column).isin(vocabulary))


# ------------------------------------------------------------------ scopes


def _prefix_chain(df: DataFrame, column: str = "full_name", with_self: bool = False) -> DataFrame:
    """Each name with the prefixes before its dots, nearest first (level 0 is the name itself)."""
    parts = F.split(column, "[.]", -1)
    n = F.size(parts)
    steps = F.sequence(F.lit(0 if with_self else 1), n - 1)
    ancestors = F.transform(steps, lambda i: F.struct(i.alias("level"), F.array_join(F.slice(parts, F.lit(1), n - i), ".").alias("ancestor")))
    usable = df if with_self else df.where(F.col(column).contains("."))
    return usable.select(column, F.explode(ancestors).alias("a")).select(column, "a.level", "a.ancestor")


def _nearest_binder(uses: DataFrame, binders: DataFrame) -> DataFrame:
    """uses(full_name, ident) with `bound_at`, how many levels up the innermost scope is that binds the name; null where none does.

    Scopes in the order of their names, dots first, are a walk through the scope tree: what lies below a scope follows it in one
    run, its interval. Of the binders of one depth only the last before a use can hold it, so one pass over the uses and binders
    of a name finds the innermost, with a row for each of them and none for the scopes in between.
    """
    depth = F.size(F.split("full_name", "[.]", -1))
    events = binders.select("full_name", "ident").distinct().withColumn("use", F.lit(0)).unionByName(uses.select("full_name", "ident").distinct().withColumn("use", F.lit(1)))
    deepest = binders.agg(F.max(depth)).first()[0] or 0
    walk = Window.partitionBy(F.substring_index("full_name", ".", 1), "ident").orderBy(F.translate("full_name", ".", "\x01"), "use")
    so_far = walk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.last(F.when((F.col("use") == 0) & (depth == d), F.col("full_name")), True).over(so_far).alias(f"at_{d}") for d in range(1, deepest + 1)]
    seen = events.select("full_name", "ident", "use", *last).where("use = 1")
    holds = [F.when((F.col("full_name") == F.col(f"at_{d}")) | F.startswith("full_name", F.concat(F.col(f"at_{d}"), F.lit("."))), d) for d in range(1, deepest + 1)]
    none = F.lit(None).cast("int")
    return seen.select("full_name", "ident", (depth - F.greatest(none, none, *holds)).alias("bound_at"))


def _above(name, level):
    """The name without its last `level` segments."""
    return F.array_join(F.slice(F.split(name, "[.]", -1), F.lit(1), F.size(F.split(name, "[.]", -1)) - level), ".")


def free_names(methods: DataFrame, uses: DataFrame, binds: DataFrame) -> DataFrame:
    """Names free in each method: used by it or left free by a method nested directly in it, and not bound by it.

    A name used in m is free at every ancestor below the nearest binder, as long as the chain of methods has no gap.
    """
    known = methods.select(F.col("full_name").alias("ancestor")).distinct().withColumn("exists", F.lit(True))
    chain = _prefix_chain(methods.select("full_name").distinct(), with_self=True).join(known, "ancestor", "left")
    gaps = chain.groupBy("full_name").agg(F.min(F.when(F.col("exists").isNull(), F.col("level"))).alias("gap"), F.count("*").alias("levels"))
    nearest = _nearest_binder(uses, binds).join(gaps, "full_name")
    free_for = F.least("gap", "bound_at", "levels")
    free = nearest.withColumn("n", free_for).where("n > 0").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    return free.select(_above(F.col("full_name"), F.col("level")).alias("full_name"), "ident").distinct()


def captures(methods: DataFrame, free: DataFrame, binds: DataFrame) -> DataFrame:
    """Is each method a closure: does an enclosing *function* scope bind one of its free names?"""
    scopes = methods.where(~F.col("name").startswith("<")).select("full_name").distinct()
    outer = _nearest_binder(free, binds.join(scopes, "full_name", "left_semi"))
    captured = outer.where("bound_at > 0").select("full_name").distinct().withColumn("is_closure", F.lit(True))
    return (
        methods.select("full_name")
        .distinct()
        .join(captured, "full_name", "left")
        .select("full_name", F.coalesce("is_closure", F.lit(False)).alias("is_closure"))
    )


def closures(methods: DataFrame, uses: DataFrame, binds: DataFrame) -> DataFrame:
    """`captures` of the `free_names`, in one pass over uses and binds.

    All binders of a name around a use are as far up as the innermost one, or further. So where the name is free below that, all
    binders of it are around, and the scopes in which it is free are closures if one of these is a function.
    """
    depth = lambda name: F.size(F.split(name, "[.]", -1))
    known = methods.select("full_name").distinct()
    # A use outside the methods counts nowhere, so no binder deeper than they are can hold one that does.
    deepest = methods.agg(F.max(depth("full_name"))).first()[0] or 0
    functions = methods.where(~F.col("name").startswith("<")).select("full_name").distinct().withColumn("fn", F.lit(True))
    names = binds.select("full_name", "ident", F.lit(0).alias("use")).unionByName(uses.select("full_name", "ident", F.lit(1).alias("use"))).distinct()
    events = names.join(functions, "full_name", "left")
    walk = Window.partitionBy(F.substring_index("full_name", ".", 1), "ident").orderBy(F.translate("full_name", ".", "\x01"), "use")
    so_far = walk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.last(F.when((F.col("use") == 0) & (depth("full_name") == d), F.struct(F.col("full_name").alias("name"), "fn")), True).over(so_far).alias(f"at_{d}") for d in range(1, deepest + 1)]
    seen = events.select("full_name", "use", *last).where("use = 1")
    holds = [(F.col("full_name") == F.col(f"at_{d}.name")) | F.startswith("full_name", F.concat(F.col(f"at_{d}.name"), F.lit("."))) for d in range(1, deepest + 1)]
    none = F.lit(None).cast("int")
    bound_at = depth("full_name") - F.greatest(none, none, *[F.when(h, d) for d, h in enumerate(holds, 1)])
    around = F.greatest(F.lit(False), F.lit(False), *[h & F.col(f"at_{d}.fn") for d, h in enumerate(holds, 1)])
    farthest = seen.where(around).select("full_name", bound_at.alias("bound_at")).groupBy("full_name").agg(F.max("bound_at").alias("bound_at"))
    chain = _prefix_chain(known, with_self=True).join(known.select(F.col("full_name").alias("ancestor"), F.lit(True).alias("exists")), "ancestor", "left")
    gaps = chain.groupBy("full_name").agg(F.min(F.when(F.col("exists").isNull(), F.col("level"))).alias("gap"))
    free = farthest.join(gaps, "full_name").withColumn("n", F.least("gap", "bound_at")).where("n > 0")
    free = free.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    captured = free.select(_above(F.col("full_name"), F.col("level")).alias("full_name")).distinct().withColumn("is_closure", F.lit(True))
    return known.join(captured, "full_name", "left").select("full_name", F.coalesce("is_closure", F.lit(False)).alias("is_closure"))


def class_captures(classes: DataFrame, method_captures: DataFrame) -> DataFrame:
    """A class captures when any method below it does."""
    inside = (
        _prefix_chain(method_captures.where(F.col("is_closure")).select("full_name"))
        .select(F.col("ancestor").alias("full_name"))
        .distinct()
        .withColumn("captures", F.lit(True))
    )
    return (
        classes.select("full_name")
        .distinct()
        .join(inside, "full_name", "left")
        .select("full_name", F.coalesce("captures", F.lit(False)).alias("captures"))
    )


def enclosing_class(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """Innermost lexical class of each function, by simple name, with the mangled form of its own name."""
    known = classes.select(F.col("full_name").alias("ancestor"), F.col("name").alias("cls")).distinct()
    found = (
        _prefix_chain(functions.select("full_name").distinct())
        .join(known, "ancestor")
        .groupBy("full_name")
        .agg(F.min_by("cls", "level").alias("cls"))
    )
    return (
        functions.select("full_name", "name")
        .distinct()
        .join(found, "full_name", "left")
        .select(
            "full_name", "name", "cls",
            F.coalesce(names.mangle(F.col("name"), F.col("cls")), "name").alias("mangled"),
        )
    )


def builtin_bases(classes: DataFrame, modelled: list[str] | None = None) -> DataFrame:
    """Classes with exactly one non-object base, a modelled builtin; short names with two bases are dropped."""
    modelled = modelled or rules.BUILTIN_BASES
    real = F.filter(
        "bases", lambda b: (b != "") & (b != "ANY") & (b != "object") & ~b.endswith(".object")
    )
    base = F.element_at(F.split(F.element_at(F.split(F.element_at(real, 1), "[.]", -1), -1), ":", -1), -1)
    rows = (
        classes.where(~F.col("name").contains("<") & (F.size(real) == 1))
        .select("name", base.alias("base"))
        .where(F.col("base").isin(modelled))
    )
    return (
        rows.groupBy("name")
        .agg(F.min("base").alias("base"), F.max("base").alias("other"))
        .where(F.col("base") == F.col("other"))
        .select("name", "base")
    )


def module_aliases(assignments: DataFrame, definitions: DataFrame) -> DataFrame:
    """`k = v` at module scope, bound once, where `v` is a top-level function or class there and `k` is not."""
    defined = definitions.select("full_name").distinct()
    once = (
        assignments.groupBy("scope", "target")
        .agg(F.count("*").alias("n"), F.first("value_ident").alias("value_ident"))
        .where((F.col("n") == 1) & (F.col("target") != F.col("value_ident")))
    )
    return (
        once.withColumn("full_name", F.concat_ws(".", "scope", "value_ident"))
        .join(defined, "full_name", "left_semi")
        .withColumn("full_name", F.concat_ws(".", "scope", "target"))
        .join(defined, "full_name", "left_anti")
        .select(F.col("scope").alias("module_name"), F.col("target").alias("name"), "value_ident")
    )


def bound_methods(attr_assignments: DataFrame) -> DataFrame:
    """`t = r.attr` bound exactly once in its scope: attr_assignments(scope, target, receiver, attr)."""
    return (
        attr_assignments.groupBy("scope", "target")
        .agg(F.count("*").alias("n"), F.first("receiver").alias("receiver"), F.first("attr").alias("attr"))
        .where(F.col("n") == 1)
        .drop("n")
    )


def module_members(modules: DataFrame, functions: DataFrame, classes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Functions, classes, aliases and immediate submodules; the first source in that order wins a name."""

    def direct(df: DataFrame, source: str, rank: int) -> DataFrame:
        full = F.col("full_name")
        return df.select(
            F.regexp_extract(full, r"^(.*)\.[^.]+$", 1).alias("module_name"),
            F.element_at(F.split(full, "[.]", -1), -1).alias("name"),
            F.lit(source).alias("source"), F.lit(rank).alias("rank"),
        ).where(~F.col("name").contains("<") & (F.col("name") != ""))

    known = modules.select(F.col("full_name").alias("module_name")).distinct()
    python = modules.where(F.col("full_name").endswith(".py:<module>")).select(
        F.col("full_name").alias("child"), _module_path(F.col("full_name")).alias("path")
    )
    parent = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise("")
    children = python.where(F.col("path") != "").select(
        parent.alias("path"), F.element_at(F.split("path", "/", -1), -1).alias("name")
    )
    subs = children.join(python.withColumnRenamed("child", "module_name"), "path").select(
        "module_name", "name", F.lit("submodule").alias("source"), F.lit(3).alias("rank")
    )
    named = aliases.select("module_name", "name", F.lit("alias").alias("source"), F.lit(2).alias("rank"))
    found = direct(functions, "function", 0).unionByName(direct(classes, "class", 1)).join(
        known, "module_name", "left_semi"
    )
    return (
        found.unionByName(named)
        .unionByName(subs)
        .groupBy("module_name", "name")
        .agg(F.min_by("source", "rank").alias("source"))
    )


def drop_synthetic(methods: DataFrame, denylist: list[str] | None = None) -> DataFrame:
    """Methods to export: no generated wrappers, and one initializer per file, marked as such."""
    denylist = denylist or rules.SYNTHETIC_NAME_PARTS
    full = F.col("full_name")
    internal = methods.where(~F.col("is_external"))
    wrapper = reduce(lambda a, b: a | b, [F.contains(full, F.lit(d)) for d in denylist])
    plain = internal.where(~wrapper & (F.col("name") != "<module>")).withColumn("is_initializer", F.lit(False))
    inits = internal.where(F.col("name").isin(rules.INITIALIZER_NAMES) & ~full.contains("<includes>"))
    return plain.unionByName(inits.withColumn("is_initializer", F.lit(True)))


def elided_calls(calls: DataFrame, primitives: list[str] | None = None, callee: str = "callee") -> DataFrame:
    """Per module how many calls are elided as sequentially void locking, and how many remain."""
    elided = F.col(callee).isin(primitives or rules.SYNC_PRIMITIVES)
    return calls.groupBy("module").agg(
        F.count_if(elided).alias("elided"), F.count_if(~elided).alias("kept")
    )


def kernel_metadata(code) -> object:
    """Does an unparsed declaration start with a metadata macro?"""
    return F.regexp_extract(F.trim(code), r"^([\p{L}\p{Nd}_]*)", 1).isin(rules.KERNEL_METADATA_MACROS)


def operator_coverage(operators: DataFrame) -> DataFrame:
    """operators(module, operator, operand_type, c_family) -> core operator or a named hole, counted by label.

    A C `char*` operand and an unsigned `>>` have their own outcome; what the vocabulary lacks is `op:<name>`.
    """
    op, kind = F.col("operator"), F.regexp_replace(F.coalesce("operand_type", F.lit("")), r"\s|\bconst\b", "")
    vocabulary = {**rules.BINARY_OPERATORS, **rules.AUGMENTED_OPERATORS, **rules.UNARY_OPERATORS}
    lookup = lambda table: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), op)
    unsafe = F.when(F.col("c_family") & (kind == "char*"), lookup(rules.C_STRING_UNSAFE))
    shift = (
        F.when(~F.col("c_family") | kind.isin(rules.SIGNED_TYPES), ">>")
        .when(kind.isin(rules.UNSIGNED_TYPES), ">>>")
    )
    core = F.when(op == rules.SHIFT_RIGHT_OPERATOR, shift).otherwise(lookup(vocabulary))
    short = F.regexp_replace(op, "^<operator>[.]", "")
    missing = F.when(op == rules.SHIFT_RIGHT_OPERATOR, "shift:unknown-signedness").otherwise(
        F.concat(F.lit("op:"), short)
    )
    labelled = operators.select(
        "module",
        F.when(unsafe.isNull(), core).alias("core_op"),
        F.coalesce(unsafe, F.when(core.isNull(), missing)).alias("hole_label"),
    )
    return labelled.groupBy("module", "core_op", "hole_label").agg(F.count("*").alias("n"))


def unique_ident(functions: DataFrame, limit: int = 120) -> DataFrame:
    """Identifiers per function; the i-th collision in table order gets i apostrophes. Needs `pos`, one for each function of a module."""
    cut = functions.select("module", "name", "pos", names.plain_ident(F.col("name"), limit).alias("base"))
    seen = rank_in_group(cut, ["module", "base"], ["pos"], "seen")
    return seen.select("module", "name", "pos", F.concat("base", F.expr("repeat(\"'\", CAST(seen AS INT))")).alias("ident"))


# ------------------------------------------------------------------ axioms


SUSPICIOUS_AXIOMS = ["sorryAx", "Lean.ofReduceBool", "Lean.ofReduceNat"]
STANDARD_AXIOMS = ["propext", "Quot.sound", "Classical.choice"]


def axiom_basis(
    decls: DataFrame, suspicious: list[str] | None = None, standard: list[str] | None = None
) -> DataFrame:
    """decls(name, module, kind, axioms): each with leaked and non-standard axioms and its own status."""
    bad = F.array(*[F.lit(a) for a in suspicious or SUSPICIOUS_AXIOMS])
    usual = F.array(*[F.lit(a) for a in standard or STANDARD_AXIOMS])
    leaked = F.sort_array(F.array_intersect("axioms", bad))
    odd = F.sort_array(F.array_except(F.array_except("axioms", usual), bad))
    return decls.select(
        "name", "module", "kind", leaked.alias("leaked"), odd.alias("nonstandard"),
        (F.col("kind") == "axiom").alias("declared_axiom"),
        F.when(F.size(leaked) > 0, "LEAK").otherwise("CLEAN").alias("status"),
    )


def axiom_histogram(decls: DataFrame) -> DataFrame:
    return decls.select(F.explode("axioms").alias("axiom")).groupBy("axiom").agg(F.count("*").alias("n"))


def resolve_root(rel_paths: DataFrame, candidate_roots: DataFrame, files: DataFrame, given: str) -> DataFrame:
    """Root under which most relative paths exist; the given one is kept on ties.

    candidate_roots(root, rank) are directories in order of preference. Every folder above a file is looked up among them.
    """
    parts, joined = F.split("path", "/", -1), lambda *a: F.array_join(F.slice("parts", *a), "/")
    above = files.select("path").distinct().select(parts.alias("parts")).where(F.size("parts") > 1)
    above = above.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("n"))
    split = above.select(joined(F.lit(1), F.col("n")).alias("root"), joined(F.col("n") + 1, F.size("parts")).alias("rel"))
    found = split.join(candidate_roots, "root").join(rel_paths.select("rel").distinct(), "rel", "left_semi")
    hits = found.groupBy("root", "rank").agg(F.count("*").alias("hits"))
    order = F.struct(F.col("hits"), (F.col("root") == given).alias("is_given"), (-F.col("rank")).alias("r"))
    return hits.agg(F.max_by("root", order).alias("root"), F.max("hits").alias("hits")).select(
        F.coalesce("root", F.lit(given)).alias("root"), F.coalesce("hits", F.lit(0)).alias("hits")
    )
