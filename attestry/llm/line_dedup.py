"""Fuzzy line dedup by MinHash, in DataFrame operations only.

A line's signature is the sketch of the smallest hashes of its character shingles that begin a word; in scripts that are written
without blanks, of those at every character. Bands are windows of neighbouring hashes of the sorted sketch, so an inserted or lost
shingle moves no band but those around it. A line with fewer than SKETCH such shingles has few of these bands, so it also gets
those of the sketch of all its character shingles. Lines that share a band are verified by the exact Jaccard similarity of all their
character shingles, links become components (`linking`, `components`), and of each component the first line by document id and
place stays. Equal lines are one class from the start; texts move only for lines that share a band with another one, and once to
write the shortened documents.

If two signatures share a hash with probability s, three shared neighbours among SKETCH are missing with probability 0.02 at
s = 0.8 and 0.001 at 0.9. The tests measure recall on lines of known similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import let, prepare, whole_row, written
from attestry.llm.linking import linked, shared_keys

SHINGLE = 8
PERCENT = 80
# Up to MARK characters from the begin of a word, or from any character after one of a script without blanks.
MARK = 12
BEGINS = r"(?s)(?:(?<![\p{L}\p{N}])|(?<=[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]))(?=(\S.{0,%d}))"
SKETCH = 14
BAND = 3
SENT_LINES = 1_000_000
NO_ID = -(2**63)
COUNTS = ("_n_lines", "_n_dropped")


def shingle_hashes(line: Column, width: int) -> Column:
    """Hashes of all character shingles; the whole line if it is shorter. Characters are UTF-16 units, so each is found by its place."""
    last = lambda units: F.greatest(F.lit(1), F.octet_length(units) - (2 * width - 1))
    each = lambda units: F.transform(F.sequence(F.lit(1), last(units), F.lit(2)), lambda at: F.xxhash64(F.substring(units, at, F.lit(2 * width))))
    return let(F.encode(line, "UTF-16BE"), each)


def sketch_of(line: Column, sketch: int, mark: int) -> Column:
    """Sorted smallest hashes of the shingles that begin a word."""
    marks = F.regexp_extract_all(line, F.lit(BEGINS % (mark - 1)), F.lit(1))
    return F.slice(F.sort_array(F.array_distinct(F.transform(marks, lambda m: F.xxhash64(m)))), 1, sketch)


def bands(smallest: str, band: int) -> Column:
    """Hashes of the windows of `band` neighbours of a sketch; of a shorter sketch, one of the whole."""
    windows = F.sequence(F.lit(1), F.size(smallest) - (band - 1))
    of = F.transform(windows, lambda j: F.xxhash64(*[F.element_at(smallest, j + k) for k in range(band)]))
    return F.when(F.size(smallest) >= band, of).otherwise(F.array(F.xxhash64(smallest)))


def all_bands(smallest: str, chars: str, sketch: int, band: int) -> Column:
    """Bands of a line's sketch, and of `chars`, the one of all shingles, where that of word begins is not full. Of 4 or 5 shingles
    with one more in the other line no three need be neighbours, so few hashes have bands of two besides."""
    few = F.when(F.size(chars) < 2 * band, bands(chars, min(band, 2))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(smallest) < sketch, F.array_distinct(F.concat(bands(smallest, band), bands(chars, band), few))).otherwise(bands(smallest, band))


def lines_of(rows: DataFrame) -> DataFrame:
    """(key, text_hash, pos, line, cls) of all lines that are not blank."""
    cut = rows.select("key", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return cut.filter(F.col("line").rlike(r"\S")).withColumn("cls", F.xxhash64("line"))


def line_components(lines: DataFrame, width: int, percent: int, sketch: int, band: int, mark: int) -> DataFrame:
    """(node, root) of classes of lines that are linked to others."""
    marked = lines.filter(F.length("line") > width).select("cls", "line", sketch_of(F.col("line"), sketch, mark).alias("smallest"))
    chars = F.when(F.size("smallest") < sketch, F.slice(F.sort_array(F.array_distinct(shingle_hashes(F.col("line"), width))), 1, sketch))
    marked = marked.select("cls", "smallest", chars.alias("chars"))
    marked = marked.select("cls", all_bands("smallest", "chars", sketch, band).alias("keys"))
    index = shared_keys(marked.groupBy("cls").agg(F.any_value("keys").alias("keys")).select("cls", F.explode("keys").alias("key")))
    wanted = written(index.select("cls").distinct())
    some = F.broadcast(wanted) if wanted.count() <= SENT_LINES else wanted
    found = lines.join(some, "cls", "left_semi").groupBy("cls").agg(F.min("line").alias("line"))
    found = written(found.withColumn("n", F.size(F.array_distinct(shingle_hashes(F.col("line"), width)))))

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda x, c: found.select(F.col("cls").alias(x), F.col(c).alias(f"{c}_{x}"))
        sized = pairs.join(side("a", "n"), "a").join(side("b", "n"), "b")
        sized = sized.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        both = sized.join(side("a", "line"), "a").join(side("b", "line"), "b")
        shared = F.size(F.array_intersect(shingle_hashes(F.col("line_a"), width), shingle_hashes(F.col("line_b"), width)))
        return written(both.filter((100 + percent) * shared >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b"))

    def sets(classes: DataFrame) -> DataFrame:
        return written(found.join(classes, "cls", "left_semi").select("cls", F.array_distinct(shingle_hashes(F.col("line"), width)).alias("items")))

    return linked(index, verified, sets, percent)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, key, text_hash, text): whole rows as a struct, so that no column of theirs can clash."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(whole_row(docs, *COUNTS), F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def dropped_lines(rows: DataFrame, width: int = SHINGLE, percent: int = PERCENT, sketch: int = SKETCH, band: int = BAND, mark: int = MARK) -> DataFrame:
    """(key, text_hash, gone): places of the lines that an earlier one stands for, for texts that have some."""
    lines = lines_of(rows)
    roots = line_components(lines, width, percent, sketch, band, mark)
    places = written(lines.select("key", "text_hash", "pos", "cls").distinct())
    placed = written(places.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("key", "text_hash", "pos", F.coalesce("root", "cls").alias("root")))
    order = F.struct((F.col("key") == NO_ID).alias("none"), "key", "text_hash", "pos")
    firsts = written(placed.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("root", "first"))
    dropped = placed.join(firsts, "root").filter(order != F.col("first"))
    return written(dropped.groupBy("key", "text_hash").agg(F.collect_list("pos").alias("gone")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns as they are but the text, which lacks the lines that an earlier one stands for; then
    _n_lines, _n_dropped (long).

    Two lines are linked if 100 * common shingles >= percent * all shingles of both. Of each component the first line by document
    id (null last) and place stays. Blank lines are neither counted nor dropped; lines up to `width` characters are only equal or
    different. A text whose lines are all dropped is empty. Null text counts as empty, and becomes it. Rows that repeat an id and
    a text are one document and each get its result; rows of one id with several texts are ordered by a hash of the text. An empty
    table gives an empty result; no other column than id and text is read, and columns with the names of the counts are replaced.
    A line of a million characters is an array of as many shingle hashes in its task.
    """
    prepare(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    gone = dropped_lines(rows.drop("row"), **options)
    out = rows.join(gone, ["key", "text_hash"], "left").withColumn("lines", F.split("text", "\n", -1))
    kept = F.filter("lines", lambda line, i: ~F.array_contains("gone", i))
    counted = F.size(F.filter("lines", lambda line: line.rlike(r"\S")))
    new_text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    columns = [new_text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in COUNTS]
    return out.select(*columns, counted.cast("long").alias("_n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("_n_dropped"))
