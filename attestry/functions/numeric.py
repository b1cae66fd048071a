"""Integer semantics under a numeric configuration, as Column expressions in DECIMAL(38,0).

Every operation yields STRUCT<outcome, value, reason>: ok, divZero, ub, trap, or unrepresentable beyond 38 digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.session import inline

INT = "decimal(38,0)"
RESULT = f"struct<outcome: string, value: {INT}, reason: string>"

# Name, signed (NULL = unbounded), bits, signed overflow, shift count, negative right shift, rounding.
CONFIGS = [
    ("python", None, 0, "wrap", "trap", "arithmetic", "floor"),
    ("c32", True, 32, "undefined", "undefined", "arithmetic", "trunc"),
    ("c32Wrapv", True, 32, "wrap", "undefined", "arithmetic", "trunc"),
    ("c64Wrapv", True, 64, "wrap", "undefined", "arithmetic", "trunc"),
    ("u32", False, 32, "wrap", "undefined", "arithmetic", "trunc"),
    ("java32", True, 32, "wrap", "wrap", "arithmetic", "trunc"),
    ("java64", True, 64, "wrap", "wrap", "arithmetic", "trunc"),
    ("go64", True, 64, "trap", "undefined", "arithmetic", "trunc"),
]
CONFIG_SCHEMA = (
    "config STRING, is_signed BOOLEAN, bits INT, on_overflow STRING, on_shift STRING, neg_shift STRING, rounding STRING"
)
CONFIG_FIELDS = ["config", "is_signed", "bits", "on_overflow", "on_shift", "neg_shift", "rounding"]
CASTS = {
    "cast:i8": (True, 8), "cast:u8": (False, 8), "cast:i16": (True, 16), "cast:u16": (False, 16),
    "cast:i32": (True, 32), "cast:u32": (False, 32), "cast:i64": (True, 64), "cast:u64": (False, 64),
}


def configs(spark: SparkSession) -> DataFrame:
    """The eight configurations; a fixed table, so broadcasting it is safe."""
    return F.broadcast(inline(spark, CONFIGS, CONFIG_SCHEMA))


def whole(value) -> Column:
    return (F.lit(str(value)) if isinstance(value, int) else value).cast(INT)


def let(value: Column, body) -> Column:
    """Binds a value used several times below, so that expressions do not double with every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


# 2**126 is the largest power of two below 10**38.
MAX_POWER = 126


def power_of_two(exponent: Column) -> Column:
    """Exact 2**exponent for 0..126, NULL beyond."""
    n = exponent.cast("int")
    high = F.when(n < 63, whole(1)).when(n < 126, whole(2**63)).otherwise(whole(2**126))
    return F.when((exponent >= 0) & (exponent <= MAX_POWER), (_shifted_one(n % 63).cast(INT) * high).cast(INT))


def _shifted_one(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n)


def floored_mod(a: Column, m: Column) -> Column:
    """Remainder with the sign of the divisor. `pmod` is not this: it gives 1 for (7, -3) where -2 is right."""
    return (((a % m).cast(INT) + m).cast(INT) % m).cast(INT)


def _result(outcome, value=None, reason=None) -> Column:
    value = F.lit(None) if value is None else value
    return F.struct(
        F.lit(outcome).alias("outcome"), value.cast(INT).alias("value"), F.lit(reason).cast("string").alias("reason")
    ).cast(RESULT)


def _ok(value: Column) -> Column:
    """`ok`, or `unrepresentable` where the value went beyond 38 digits."""
    return F.struct(
        F.when(value.isNull(), "unrepresentable").otherwise("ok").alias("outcome"), value.cast(INT).alias("value"),
        F.lit(None).cast("string").alias("reason"),
    ).cast(RESULT)


class Machine:
    """The operations of one configuration, whose fields are columns (or literals) of the row."""

    def __init__(self, is_signed=None, bits=None, on_overflow=None, on_shift=None, neg_shift=None, rounding=None):
        field = lambda given, name: F.col(name) if given is None else given
        self.is_signed, self.bits = field(is_signed, "is_signed"), field(bits, "bits")
        self.on_overflow, self.on_shift = field(on_overflow, "on_overflow"), field(on_shift, "on_shift")
        self.neg_shift, self.rounding = field(neg_shift, "neg_shift"), field(rounding, "rounding")
        self.unbounded = self.is_signed.isNull()
        by_bits = lambda f: F.when(self.bits == 32, whole(f(32))).when(self.bits == 64, whole(f(64))).when(
            self.bits == 16, whole(f(16))
        ).when(self.bits == 8, whole(f(8)))
        self.modulus = by_bits(lambda n: 2**n)
        # Half the modulus for signed types, nothing for unsigned: the distance of the lowest value from zero.
        self.offset = F.when(self.is_signed, by_bits(lambda n: 2 ** (n - 1))).otherwise(whole(0))

    @staticmethod
    def fixed(is_signed: bool, bits: int) -> "Machine":
        none = F.lit(None).cast("string")
        machine = Machine(F.lit(is_signed), F.lit(bits), none, none, none, none)
        machine.modulus, machine.offset = whole(2**bits), whole(2 ** (bits - 1) if is_signed else 0)
        return machine

    def in_range(self, x: Column) -> Column:
        moved = (x + self.offset).cast(INT)
        return self.unbounded | moved.between(whole(0), (self.modulus - 1).cast(INT))

    def wrap(self, x: Column) -> Column:
        wrapped = (floored_mod((x + self.offset).cast(INT), self.modulus) - self.offset).cast(INT)
        return F.when(self.unbounded, x).otherwise(wrapped)

    def _by_policy(self, policy: Column, wrapped: Column, reason: str) -> Column:
        return (
            F.when(policy == "undefined", _result("ub", reason=reason))
            .when(policy == "trap", _result("trap", reason=reason))
            .otherwise(wrapped)
        )

    def finish(self, exact: Column) -> Column:
        """An exact result put through the overflow policy; unsigned always wraps."""
        return let(
            exact,
            lambda x: F.when(
                F.coalesce(~self.in_range(x) & self.is_signed, F.lit(False)),
                self._by_policy(self.on_overflow, _ok(self.wrap(x)), "signed integer overflow"),
            ).otherwise(_ok(self.wrap(x))),
        )

    def add(self, a, b):
        return self.finish(F.try_add(a, b).cast(INT))

    def sub(self, a, b):
        return self.finish(F.try_subtract(a, b).cast(INT))

    def mul(self, a, b):
        return self.finish(F.try_multiply(a, b).cast(INT))

    def neg(self, a):
        return self.finish((-a).cast(INT))

    def _divide(self, a, b, use):
        """`use(quotient, remainder)` under the configured rounding; the divisor is not zero in there."""
        divisor = F.nullif(b, whole(0))
        rest = F.when(self.rounding == "floor", floored_mod(a, divisor)).otherwise((a % divisor).cast(INT))
        done = let(rest, lambda r: use(F.try_divide((a - r).cast(INT), divisor).cast(INT), r))
        return F.when(b == 0, _result("divZero")).otherwise(done)

    def div(self, a, b):
        return self._divide(a, b, lambda q, r: self.finish(q))

    def mod(self, a, b):
        """Overflow is tested on the quotient: INT_MIN % -1 is a fault although its remainder 0 is in range."""

        def use(q, r):
            wrapped = _ok(self.wrap(r))
            overflows = F.coalesce(~self.in_range(q) & self.is_signed, F.lit(False))
            return F.when(
                overflows, self._by_policy(self.on_overflow, wrapped, "remainder with overflowing quotient")
            ).otherwise(wrapped)

        return self._divide(a, b, use)

    def _shift(self, k, shifted) -> Column:
        """`shifted(count)` under the count policy. Spark's own shifts mask the count silently."""
        in_width = (k >= 0) & (self.unbounded | (k < self.bits))
        masked = F.when(self.unbounded, whole(0)).otherwise(floored_mod(k, F.nullif(self.bits, F.lit(0)).cast(INT)))
        count = F.when(in_width, k).when(self.on_shift == "wrap", masked)
        fault = self._by_policy(self.on_shift, _result("ub"), "shift count out of range")
        return let(count, lambda n: F.when(n.isNull(), fault).otherwise(shifted(n)))

    def shl(self, a, k):
        return self._shift(k, lambda n: self.finish(F.try_multiply(a, power_of_two(n)).cast(INT)))

    @staticmethod
    def _floor_shift(a, n):
        exact = let(power_of_two(n), lambda d: F.try_divide((a - floored_mod(a, d)).cast(INT), d).cast(INT))
        return F.when(n > MAX_POWER, F.when(a < 0, whole(-1)).otherwise(whole(0))).otherwise(exact)

    def shr(self, a, k, logical: bool = False):
        policy = F.lit("logical") if logical else self.neg_shift
        negative = a < 0

        def shifted(n):
            pattern = F.when(negative & (policy == "logical"), floored_mod(a, self.modulus)).otherwise(a)
            return (
                F.when(negative & (policy == "undefined"), _result("ub", reason="right shift of a negative value"))
                .when(
                    negative & (policy == "logical") & self.unbounded,
                    _result("ub", reason="logical right shift of an unbounded negative value"),
                )
                .otherwise(let(pattern, lambda p: _ok(self.wrap(self._floor_shift(p, n)))))
            )

        return self._shift(k, shifted)

    def bitwise(self, op: str, a, b):
        """On 64-bit patterns; exact for every fixed width, and for unbounded operands that fit 64 bits."""
        word = Machine.fixed(True, 64)
        x, y = word.wrap(a).cast("bigint"), word.wrap(b).cast("bigint")
        bits = {"&": x.bitwiseAND(y), "|": x.bitwiseOR(y), "^": x.bitwiseXOR(y)}[op].cast(INT)
        too_wide = self.unbounded & ~(word.in_range(a) & word.in_range(b))
        return F.when(too_wide, _result("unrepresentable")).otherwise(let(bits, lambda x: _ok(self.wrap(x))))

    def invert(self, a):
        return let((-a - 1).cast(INT), lambda x: _ok(self.wrap(x)))


def apply_int(op: Column, a: Column, b: Column, machine: Machine | None = None, only: list[str] | None = None) -> Column:
    """The integer operation named by `op`, of those in `only` if given; NULL when the name is none of them."""
    m = machine or Machine()
    table = {
        "+": m.add(a, b), "-": m.sub(a, b), "*": m.mul(a, b), "/": m.div(a, b), "//": m.div(a, b), "%": m.mod(a, b),
        "&": m.bitwise("&", a, b), "|": m.bitwise("|", a, b), "^": m.bitwise("^", a, b), "<<": m.shl(a, b),
        ">>": m.shr(a, b), ">>>": m.shr(a, b, logical=True), "neg": m.neg(a), "~": m.invert(a),
        **{name: _ok(Machine.fixed(*spec).wrap(a)) for name, spec in CASTS.items()},
    }
    chosen = F
    for name, result in table.items():
        if only is None or name in only:
            chosen = chosen.when(op == name, result)
    return chosen.otherwise(F.lit(None).cast(RESULT))


# Operands whose product fits 64 bits.
SHORT = 3_037_000_499


def apply_rows(rows: DataFrame, ops: list[str]) -> DataFrame:
    """rows(op, a, b, fields of a configuration): adds `outcome` and the value, as `short` (BIGINT) or as `wide` (DECIMAL).

    Operands up to SHORT are computed in BIGINT by generated code, one plain expression a row; larger or missing ones, and left shifts
    that may leave 64 bits, by `apply_int`. The value is in one of the two columns, and in none where the outcome isn't ok.
    """
    op, c = F.col("op"), F.col
    # An operand beyond 64 bits is null here, so that its row goes to `apply_int`.
    cells = rows.withColumn("_a", c("a").try_cast("bigint")).withColumn("_b", c("b").try_cast("bigint"))
    a, b, unbounded = c("_a"), c("_b"), c("is_signed").isNull()
    left, right = op == "<<", op.isin(">>", ">>>")
    in_width = (b >= 0) & (unbounded | (b < c("bits")))
    width = F.nullif("bits", F.lit(0))
    masked = F.when(unbounded, 0).otherwise((b % width + width) % width)
    cells = cells.withColumn("_n", F.when(left | right, F.when(in_width, b).when(c("on_shift") == "wrap", masked)))
    n = c("_n")
    wraps_64 = c("is_signed") & (c("bits") == 64) & ~c("on_overflow").isin("undefined", "trap")
    kept = ~left | n.isNull() | (n <= 31) | F.coalesce(wraps_64, F.lit(False))
    known = unbounded | (c("bits") < 64) | c("is_signed")
    quick = F.coalesce(a.between(-SHORT, SHORT) & b.between(-SHORT, SHORT) & known & kept, F.lit(False))

    cut = F.when(unbounded, 0).otherwise(64 - c("bits")).cast("int")
    shift = lambda name, x, by: F.call_function(name, x, by.cast("int"))
    logical = (a < 0) & ((op == ">>>") | F.coalesce(c("neg_shift") == "logical", F.lit(False)))
    # A negative pattern of the width, moved to the top of the word and back by its missing bits and the count at once.
    zero_filled = F.when(n + cut > 63, 0).otherwise(shift("shiftrightunsigned", shift("shiftleft", a, cut), n + cut))
    shifted = F.when(logical, zero_filled).otherwise(shift("shiftright", a, F.least(n, F.lit(63))))
    divisor = F.nullif(b, F.lit(0))
    rest = F.when(c("rounding") == "floor", (a % divisor + divisor) % divisor).otherwise(a % divisor)
    forms = {
        "+": a + b, "-": a - b, "*": a * b, "neg": -a, "~": -a - 1, "&": a.bitwiseAND(b), "|": a.bitwiseOR(b), "^": a.bitwiseXOR(b),
        "<<": shift("shiftleft", a, n), ">>": shifted, ">>>": shifted, "/": c("_q"), "//": c("_q"), "%": c("_rest"),
    }
    exact = F
    for name, form in forms.items():
        if name in ops:
            exact = exact.when(op == name, form)
    fast = cells.where(quick).withColumn("_cut", cut)
    if {"/", "//", "%"} & set(ops):
        fast = fast.withColumn("_rest", rest).withColumn("_q", F.call_function("div", a - c("_rest"), divisor))
    fast = fast.withColumn("_x", exact.otherwise(F.lit(None).cast("bigint")))
    within = lambda x: F.when(F.coalesce(c("is_signed"), F.lit(True)), shift("shiftright", shift("shiftleft", x, c("_cut")), c("_cut"))).otherwise(
        shift("shiftrightunsigned", shift("shiftleft", x, c("_cut")), c("_cut"))
    )
    fast = fast.withColumn("_w", within(c("_x")))
    tested = (F.when(op == "%", c("_q") != within(c("_q"))).otherwise(c("_x") != c("_w"))) if "%" in ops else c("_x") != c("_w")
    leaves = F.coalesce(c("is_signed"), F.lit(False)) & op.isin("+", "-", "*", "neg", "<<", "/", "//", "%") & tested
    by_policy = lambda policy, otherwise: F.when(policy == "undefined", "ub").when(policy == "trap", "trap").otherwise(otherwise)
    refused = right & (a < 0) & F.when(op == ">>>", unbounded).otherwise((c("neg_shift") == "undefined") | logical & unbounded)
    outcome = (
        F.when(op.isin("/", "//", "%") & (b == 0), "divZero")
        .when((left | right) & n.isNull(), by_policy(c("on_shift"), "ub"))
        .when(F.coalesce(refused, F.lit(False)), "ub")
        .when(leaves, by_policy(c("on_overflow"), "ok"))
        .otherwise("ok")
    )
    none = lambda kind: F.lit(None).cast(kind)
    fast = fast.withColumn("outcome", outcome).select(
        *rows.columns, "outcome", F.when(c("outcome") == "ok", c("_w")).alias("short"), none(INT).alias("wide")
    )
    slow = cells.where(~quick).withColumn("_r", apply_int(op, c("a").cast(INT), c("b").cast(INT), only=ops))
    return fast.unionByName(slow.select(*rows.columns, c("_r.outcome").alias("outcome"), none("bigint").alias("short"), c("_r.value").alias("wide")))
