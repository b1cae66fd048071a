"""A function corpus that Spark derives from `documents`: one function per document, a statement per line and an
expression per word, so every AST operator runs over whole tables and whole texts.

Line kinds by word count, word kinds by length; the SQL side (`LINES`, `WORDS`, `FUNCS`) states the same rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import ast_tables
from attestry.plans.registry import table
from attestry.session import spread

HOLE_LENGTH = 19

_BLANK, _LINE_FEED = 32, 10
_BYTES_PER_PIECE = 1 << 18  # of texts; their bodies are some seven times as long
_IN_IDENT = np.isin(np.arange(256), [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"])
# An expression by word length modulo 7, and a hole: text, the identifier or the length, text, either again or nothing, text.
_WORD_PARTS = [
    ('{"k":"call","f":"', '","args":[{"k":"name","v":"', '"}]}'), ('{"k":"name","v":"', '"}', ""), ('{"k":"str","v":"', '"}', ""), ('{"k":"int","v":', "}", ""),
    ('{"k":"mcall","recv":{"k":"name","v":"self"},"m":"', '","args":[]}', ""), ('{"k":"field","a":{"k":"name","v":"self"},"f":"', '"}', ""),
    ('{"k":"binop","op":"+","a":{"k":"name","v":"', '"},"b":{"k":"int","v":', "}}"), ('{"k":"hole","label":"len:', '"}', ""),
]
_CALL, _INT, _BINOP, _HOLE = 0, 3, 6, 7
# A statement by word count modulo 5, and a `skip` for a line without words: text, its words, text, the word count or nothing, text.
_LINE_PARTS = [
    ('{"k":"exprS","e":{"k":"listE","items":[', "]}}", ""), ('{"k":"assign","x":"l","e":{"k":"listE","items":[', "]}}", ""), ('{"k":"ret","e":{"k":"tupleE","items":[', "]}}", ""),
    ('{"k":"tryFinally","body":{"k":"exprS","e":{"k":"listE","items":[', ']}},"fin":{"k":"skip"}}', ""),
    ('{"k":"setIndex","r":{"k":"name","v":"self"},"i":{"k":"listE","items":[', ']},"v":{"k":"int","v":', "}}"), ('{"k":"skip"}', "", ""),
]
_SET_INDEX, _SKIP = 4, 5
# The first word of seven, fourteen, ... characters with one of an identifier among them.
_CALLED_WORD = r"(?<![^ \n])(?=[^ \nA-Za-z0-9_]*[A-Za-z0-9_])((?:[^ \n]{7})++)(?![^ \n])"


class _Words:
    """The words of an array of texts: code points and identifier of each, its line among all lines; lines of each text."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        edges, upto = offsets - offsets[0], lambda mask: np.concatenate([[0], np.cumsum(mask)])
        blank = (data == _BLANK) | (data == _LINE_FEED)
        first, last = np.ones(len(data) + 1, bool), np.ones(len(data) + 1, bool)
        first[1:], last[1:-1] = blank, blank[1:]
        first[edges[:-1]] = last[edges[1:]] = True  # words end with their text
        starts, stops = np.flatnonzero(~blank & first[:-1]), np.flatnonzero(~blank & last[1:]) + 1
        characters, feeds, kept = upto((data & 0xC0) != 0x80), upto(data == _LINE_FEED), _IN_IDENT[data]
        self.length = characters[stops] - characters[starts]
        self.line = feeds[starts] + np.searchsorted(edges, starts, "right") - 1
        self.lines = np.diff(feeds[edges]) + 1
        places = upto(kept)
        bounds = np.append(places[starts], places[-1]).astype(np.int32)  # no sign of an identifier stands between words
        self.ident = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[kept]))


def _joined(numbers: np.ndarray, parts: list[tuple], *between) -> pa.Array:
    """The three texts of each number with two arrays between them."""
    at = pa.array(numbers)
    before, inside, after = (pa.array([p[i] for p in parts], pa.string()).take(at) for i in range(3))
    return pc.binary_join_element_wise(before, between[0], inside, between[1], after, "")


def _in_lists(items: pa.Array, sizes: np.ndarray, comma: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), items), comma)


def _bodies_together(texts: pa.Array) -> pa.Array:
    words, text = _Words(pc.fill_null(texts, "")), lambda numbers: pa.array(numbers).cast(pa.string())
    kind = np.where(words.length >= HOLE_LENGTH, _HOLE, words.length % 7)
    only = lambda mask, found, other="": pc.if_else(pa.array(mask), found, other)
    length = text(words.length)
    expressions = _joined(
        kind, _WORD_PARTS, only((kind == _INT) | (kind == _HOLE), length, words.ident), only(kind == _CALL, words.ident, only(kind == _BINOP, length))
    )
    count = np.bincount(words.line, minlength=int(words.lines.sum()))
    shape = np.where(count == 0, _SKIP, count % 5)
    statements = _joined(shape, _LINE_PARTS, _in_lists(expressions, count, ","), only(shape == _SET_INDEX, text(count)))
    statements = pc.binary_join_element_wise('{"k":"seq","a":', statements, ',"b":', "")
    bodies = pc.binary_join_element_wise(_in_lists(statements, words.lines, ""), '{"k":"skip"}', pc.binary_repeat("}", pa.array(words.lines)), "")
    return pc.if_else(texts.is_valid(), bodies, None)


def _bodies(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The body of each text, made of few texts at a time."""
    for texts in batches:
        for piece in ast_tables._pieces(pa.RecordBatch.from_arrays([texts], names=["text"]), 0, _BYTES_PER_PIECE):
            yield _bodies_together(piece.column(0))


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """functions(module, name, file, params, body, pos): lang is the module, doc_id the table order.

    Bodies are made by array operations, as a column that Catalyst drops where nobody asks for it. Calling it not deterministic
    keeps it from being made twice, once for a filter above. A function is named after the first word that reads as a call.
    """
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    ext = F.expr("CASE doc_id % 4 WHEN 2 THEN '.c' WHEN 3 THEN '.txt' ELSE '.py' END")
    called = F.regexp_replace(F.regexp_extract("text", _CALLED_WORD, 1), "[^A-Za-z0-9_]", "")
    made = docs.select(
        F.col("lang").alias("module"), F.concat(F.col("source"), F.lit("/d"), F.col("doc_id"), ext).alias("file"),
        F.coalesce(F.nullif(called, F.lit("")), F.lit("f")).alias("last"), F.arrow_udf(_bodies, "string").asNondeterministic()("text").alias("body"), "doc_id",
    )
    return made.select(
        "module",
        F.concat(F.col("file"), F.lit(":<module>.C"), F.col("doc_id") % 97, F.lit("."), "last").alias("name"),
        "file",
        F.array(F.lit("self")).alias("params"),
        "body",
        F.col("doc_id").alias("pos"),
    )


def nodes(spark: SparkSession, sf_dir: str, columns: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    return ast_tables.flatten_ast(functions(spark, sf_dir), columns, kinds)


# ---- the same corpus as SQL over `documents`

WITH_LINES = """
  lines AS (
    SELECT doc_id, lang AS module, i - 1 AS i, [w FOR w IN string_split(ls[i], ' ') IF w <> ''] AS ws
    FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls,
                 unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
  )"""
WITH_WORDS = (
    WITH_LINES
    + """,
  words AS (
    SELECT doc_id, module, i, len(ws) AS m, j, ws[j] AS w, length(ws[j]) AS n,
           regexp_replace(ws[j], '[^A-Za-z0-9_]', '', 'g') AS id
    FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS j FROM lines)
  )"""
)
WITH_FUNCS = (
    WITH_WORDS
    + """,
  firsts AS (
    SELECT doc_id, arg_min(id, i * 1000000 + j) AS first_id FROM words WHERE n % 7 = 0 AND id <> '' GROUP BY doc_id
  ),
  funcs AS (
    SELECT d.doc_id, d.lang AS module,
           d.source || '/d' || d.doc_id || CASE d.doc_id % 4 WHEN 2 THEN '.c' WHEN 3 THEN '.txt' ELSE '.py' END AS file,
           d.source || '/d' || d.doc_id || CASE d.doc_id % 4 WHEN 2 THEN '.c' WHEN 3 THEN '.txt' ELSE '.py' END
             || ':<module>.C' || (d.doc_id % 97) || '.' || coalesce(f.first_id, 'f') AS name
    FROM documents d LEFT JOIN firsts f USING (doc_id)
  )"""
)
