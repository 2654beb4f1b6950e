"""Op 5, line dedup by overlapping windows of three lines. DataFrame functions only.

Every three consecutive lines of a text make a window, told apart by two 64-bit hashes, each of
its own hashes of the lines. A window that stands elsewhere before (in order of doc_id and line)
is a repeat; the lines that repeats cover, merged over all windows of a text, are removed. A
window that begins inside the first one like it is a repeat too, so of a run of equal lines only
the first line stays; else the lines of a first occurrence stay.

Windows are counted by hash with partial sums, and only the hashes that occur twice come back to
their windows, by a join that the engine may split where a window is very frequent. What a text
loses is an array of its own line numbers; texts themselves are dealt out once, to meet it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, reserve

LINES = 3
RESERVED = ("_doc", "_key", "_lost", "_tie", "_starts", "_ends", "_lines", "_kept")


def windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """The windows of each text of docs (doc_id, text): doc_id, tie, at (first line from 0), h1, h2."""
    rows = docs.filter(F.instr("text", "\n") > 0).select("doc_id", F.xxhash64("text").alias("tie"), F.split("text", "\n", -1).alias("lines"))
    both = lambda x: F.struct(F.xxhash64(x, F.length(x)).alias("a"), F.xxhash64(F.lit(7), x).alias("b"))
    rows = rows.filter(F.size("lines") >= lines).select("doc_id", "tie", F.transform("lines", both).alias("h"))
    rows = rows.select("doc_id", "tie", "h", F.posexplode(F.slice("h", 1, F.size("h") - (lines - 1))).alias("at", "h0"))
    own = F.slice("h", F.col("at") + 1, lines)
    return rows.select("doc_id", "tie", "at", F.xxhash64(own["a"]).alias("h1"), F.xxhash64(own["b"]).alias("h2"))


def repeats(found: DataFrame) -> DataFrame:
    """The windows that stand elsewhere before, of windows()."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie", "at")
    twice = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").select("h1", "h2", "first")
    return found.join(twice, ["h1", "h2"]).filter(place > F.col("first")).select("doc_id", "tie", "at")


def dedup_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """Removes from each text of docs (doc_id, text, any other columns) the lines of repeated windows.

    Returns all rows and columns, text without its removed lines, and n_removed (int, of lines).
    Order is by doc_id (null last), then a hash of the text, then line; rows alike in doc_id and
    text are one occurrence and are cut alike. A text of fewer lines, empty or null, stays as it
    is, with n_removed 0; one all of whose lines go becomes empty. Empty lines are lines like
    others. An empty table gives an empty result. Raises ValueError for a column by the name of
    n_removed or one of RESERVED; others may have any name.
    """
    reserve(docs, "n_removed", *RESERVED)
    lost = repeats(windows(docs.select("doc_id", "text"), lines)).groupBy(F.col("doc_id").alias("_doc"), F.col("tie").alias("_key")).agg(F.sort_array(F.collect_set("at")).alias("_lost"))
    rows = docs.withColumn("_tie", F.xxhash64("text")).join(lost, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_tie") == F.col("_key")), "left")
    # runs of covered lines: a window that starts at most `lines` after the one before goes on with its run
    starts = F.filter("_lost", lambda x, i: (i == 0) | (x > F.get("_lost", i - 1) + lines))
    ends = F.filter("_lost", lambda x, i: (i == F.size("_lost") - 1) | (F.get("_lost", i + 1) > x + lines))
    rows = rows.withColumn("_starts", starts).withColumn("_ends", F.transform(ends, lambda x: x + lines)).withColumn("_lines", F.when(F.col("_lost").isNotNull(), F.split("text", "\n", -1)))
    kept = F.transform("_ends", lambda e, k: F.slice("_lines", e + 1, F.coalesce(F.get("_starts", k + 1), F.size("_lines")) - e))
    kept = F.concat(F.slice("_lines", F.lit(1), F.get("_starts", F.lit(0))), F.flatten(kept))
    rows = rows.withColumn("_kept", F.when(F.col("_lost").isNotNull(), kept))
    text = F.when(F.col("_lost").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n"))
    gone = F.when(F.col("_lost").isNull(), 0).otherwise(F.size("_lines") - F.size("_kept"))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], gone.alias("n_removed"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


OP5_SQL = """
WITH lines AS (
  SELECT doc_id, i, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)
), windows AS (
  SELECT doc_id, i, l, lead(l) OVER w AS l1, lead(l, 2) OVER w AS l2, lead(i, 2) OVER w AS e FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY l, l1, l2 ORDER BY doc_id, i) AS k FROM windows WHERE e IS NOT NULL
), covered AS (
  SELECT DISTINCT doc_id, i + d AS i FROM ranked, (VALUES (0), (1), (2)) AS t(d) WHERE k > 1
), cut AS (
  SELECT n.doc_id, coalesce(string_agg(n.l, chr(10) ORDER BY n.i) FILTER (WHERE c.i IS NULL), '') AS text, count(c.i) AS n_removed
  FROM lines n LEFT JOIN covered c ON n.doc_id = c.doc_id AND n.i = c.i GROUP BY n.doc_id
)
SELECT d.doc_id, coalesce(c.text, d.text) AS text, CAST(coalesce(c.n_removed, 0) AS INTEGER) AS n_removed FROM documents d LEFT JOIN cut c ON d.doc_id = c.doc_id
"""
