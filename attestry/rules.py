"""Vocabularies, tables and patterns that results depend on. All are defaults; callers may pass their own."""

# ---- node kinds of a function body
EXPR_KINDS = [
    "int", "str", "bool", "unit", "float", "name", "binop", "unop", "index", "call", "hole", "field", "mcall",
    "alloc", "fnref", "closure", "classClosure", "listE", "tupleE", "dictE", "cond", "isOp", "inOp", "starred",
    "kwargE", "dstarred",
]
STMT_KINDS = [
    "skip", "brk", "cont", "holeS", "exprS", "assign", "ret", "seq", "ifte", "loop", "setField", "setIndex",
    "forIn", "tryCatch", "tryFinally", "raise", "del", "setGlobal", "declGlobal",
]
HOLE_KINDS = ["hole", "holeS"]
# Subtrees the call and risk passes do not look into.
PRUNED_BELOW = ["tryFinally", "setGlobal", "starred", "kwargE", "dstarred"]
# Constructs that may still become a hole when run.
RISKY_KINDS = ["field", "index", "mcall", "binop", "call", "alloc", "inOp", "setField", "setIndex", "forIn"]
HEAP_WRITING_KINDS = ["setField", "setIndex", "alloc"]
HOLING_OR_LOOPING_KINDS = [
    "field", "index", "mcall", "call", "alloc", "inOp", "binop", "loop", "forIn", "setIndex",
]

# ---- dialects by file extension; the two tables differ on purpose and are never mixed in one ratio
MATRIX_DIALECTS = {
    ".py": "python", ".c": "cLike", ".h": "cLike", ".cpp": "cLike", ".java": "cLike", ".js": "cLike",
    ".ts": "cLike", ".kt": "cLike", ".go": "cLike",
}
RENDER_DIALECTS = {
    ".py": "python", ".c": "cLike", ".h": "cLike", ".cpp": "cLike", ".cc": "cLike", ".cxx": "cLike",
    ".hh": "cLike", ".hpp": "cLike", ".java": "cLike", ".js": "cLike", ".ts": "cLike", ".kt": "cLike",
    ".go": "cLike",
}
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".c": "c", ".h": "c", ".java": "java", ".go": "go", ".js": "js",
    ".mjs": "js", ".cjs": "js", ".ts": "ts", ".tsx": "ts", ".mts": "ts", ".kt": "kotlin", ".kts": "kotlin",
}
# language -> (dialect it runs under, whether that dialect is exact for it)
LANGUAGE_DIALECTS = {
    "python": ("python", True), "c": ("cLike", True), "java": ("cLike", False), "go": ("cLike", False),
    "js": ("python", False), "ts": ("python", False), "kotlin": ("cLike", False),
}

# ---- free names answered by the modelled library under the python dialect
EXCEPTION_NAMES = [
    "Exception", "BaseException", "ArithmeticError", "AssertionError", "AttributeError", "EOFError",
    "FloatingPointError", "ImportError", "IndentationError", "IndexError", "KeyError", "KeyboardInterrupt",
    "LookupError", "MemoryError", "NameError", "NotImplementedError", "OverflowError", "RecursionError",
    "ReferenceError", "RuntimeError", "StopIteration", "StopAsyncIteration", "SyntaxError", "SystemError",
    "SystemExit", "TypeError", "UnboundLocalError", "ValueError", "ZeroDivisionError",
]
BUILTIN_FREE_NAMES = EXCEPTION_NAMES + [
    "len", "abs", "sum", "min", "max", "sorted", "bool", "str", "repr", "int", "ord", "chr", "callable",
    "isinstance", "getattr", "hasattr", "list", "tuple", "dict",
]

# ---- effect classes and the patterns that betray them; `Class.forName` can never match lower-cased text
EFFECT_PATTERNS = {
    "io": ["open", "read", "write", "print", "recv", "send", "socket"],
    "ffi": ["dlopen", "ctypes", "jni", "extern", "unsafe"],
    "reflection": ["eval", "exec", "getattr", "setattr", "reflect", "Class.forName"],
    "concurrency": ["thread", "spawn", "async", "await", "mutex", "lock"],
    "nondeterm": ["random", "time", "now", "uuid", "getenv"],
}
PRIORITY_WEIGHTS = {"base": 100.0, "effect": 25.0, "fanout": 2.0, "loc": 0.1, "branch": 1.5}

# ---- program graph
BUILTIN_BASES = ["tuple", "list", "dict", "str"]
SYNTHETIC_NAME_PARTS = ["<metaClassAdapter>", "<metaClassCallHandler>", "<global>", "<body>", "<fakeNew>"]
INITIALIZER_NAMES = ["<module>", "<global>"]
KERNEL_METADATA_MACROS = [
    "MODULE_LICENSE", "MODULE_AUTHOR", "MODULE_DESCRIPTION", "MODULE_VERSION", "MODULE_ALIAS",
    "MODULE_PARM_DESC", "MODULE_FIRMWARE", "MODULE_DEVICE_TABLE", "MODULE_SOFTDEP", "MODULE_INFO",
    "MODULE_IMPORT_NS", "EXPORT_SYMBOL", "EXPORT_SYMBOL_GPL", "EXPORT_SYMBOL_NS", "EXPORT_SYMBOL_NS_GPL",
    "EXPORT_TRACEPOINT_SYMBOL", "EXPORT_TRACEPOINT_SYMBOL_GPL",
]
SYNC_PRIMITIVES = [
    "spin_lock", "spin_unlock", "spin_lock_irq", "spin_unlock_irq", "spin_lock_bh", "spin_unlock_bh",
    "spin_lock_nested", "spin_lock_nest_lock", "raw_spin_lock", "raw_spin_unlock", "raw_spin_lock_irq",
    "raw_spin_unlock_irq", "read_lock", "read_unlock", "write_lock", "write_unlock", "read_lock_irq",
    "read_unlock_irq", "write_lock_irq", "write_unlock_irq", "mutex_lock", "mutex_unlock",
    "mutex_lock_nested", "rcu_read_lock", "rcu_read_unlock", "down_read", "up_read", "down_write", "up_write",
    "local_lock", "local_unlock", "local_irq_save", "local_irq_restore", "preempt_disable", "preempt_enable",
]
BINARY_OPERATORS = {
    "<operator>.addition": "+", "<operator>.subtraction": "-", "<operator>.multiplication": "*",
    "<operator>.division": "/", "<operator>.floorDiv": "/", "<operator>.modulo": "%",
    "<operator>.lessThan": "<", "<operator>.lessEqualsThan": "<=", "<operator>.greaterThan": ">",
    "<operator>.greaterEqualsThan": ">=", "<operator>.equals": "==", "<operator>.notEquals": "!=",
    "<operator>.logicalAnd": "&&", "<operator>.logicalOr": "||", "<operator>.and": "&", "<operator>.or": "|",
    "<operator>.xor": "^", "<operator>.shiftLeft": "<<", "<operator>.logicalShiftRight": ">>>",
}
AUGMENTED_OPERATORS = {
    "<operator>.assignmentPlus": "+", "<operator>.assignmentMinus": "-",
    "<operator>.assignmentMultiplication": "*", "<operator>.assignmentDivision": "/",
    "<operator>.assignmentModulo": "%", "<operator>.assignmentAnd": "&", "<operator>.assignmentOr": "|",
    "<operator>.assignmentXor": "^", "<operator>.assignmentShiftLeft": "<<",
    "<operator>.assignmentLogicalShiftRight": ">>>",
}
UNARY_OPERATORS = {"<operator>.minus": "-", "<operator>.logicalNot": "!", "<operator>.not": "~"}
SHIFT_RIGHT_OPERATOR = "<operator>.arithmeticShiftRight"
C_STRING_UNSAFE = {
    "<operator>.addition": "cstr:pointer-arith", "<operator>.subtraction": "cstr:pointer-arith",
    "<operator>.assignmentPlus": "cstr:pointer-arith", "<operator>.assignmentMinus": "cstr:pointer-arith",
    "<operator>.lessThan": "cstr:address-compare", "<operator>.lessEqualsThan": "cstr:address-compare",
    "<operator>.greaterThan": "cstr:address-compare", "<operator>.greaterEqualsThan": "cstr:address-compare",
    "<operator>.equals": "cstr:address-equality", "<operator>.notEquals": "cstr:address-equality",
}
UNSIGNED_TYPES = [
    "uint8_t", "unsignedchar", "uint16_t", "unsignedshort", "uint32_t", "unsignedint", "unsigned", "uint64_t",
    "unsignedlonglong", "unsignedlong", "longunsigned", "size_t", "uintptr_t", "u8", "u16", "u32", "u64",
    "__u8", "__u16", "__u32", "__u64", "__be16", "__be32", "__be64", "__le16", "__le32", "__le64", "gfp_t",
    "dev_t", "sector_t", "phys_addr_t", "dma_addr_t", "resource_size_t", "uid_t", "gid_t",
]
SIGNED_TYPES = [
    "int8_t", "signedchar", "int16_t", "short", "shortint", "int32_t", "int", "signedint", "long",
    "signedlong", "int64_t", "longlong", "ptrdiff_t", "s8", "s16", "s32", "s64", "__s8", "__s16", "__s32",
    "__s64", "ssize_t", "loff_t", "off_t", "pid_t", "cycles_t", "ktime_t", "intptr_t",
]
IMPORT_LABELS = [
    "import:absent:relative", "import:absent:prefix-in-cpg", "import:absent:external", "import:member-not-found",
]
