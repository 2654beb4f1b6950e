"""Op 8, quality rules with adaptive thresholds. DataFrame functions only.

Statistics of each text are found within its row. A quantile sketch of each statistic is kept for
each language and source: counts of logarithmic buckets of one per cent relative width (as in
DDSketch). Such sketches merge by adding counts, so groups are partial sums on every task, a hot
source included, and a language's and the whole corpus's are merged from the groups' own, without
a second look at the documents. They give the same thresholds however the rows are dealt.

A group's quartiles are blended with its language's, and those with the corpus's, by the number
of documents: what is above weighs as much as BLEND documents would, so a small group leans on
its language and grows out of it smoothly. A group's thresholds lie six spreads (between blended
quartiles) beyond them; no fixed cutoff takes part. Most texts have no symbol and no repeat, so a
spread counts as a least one where it is smaller. Thresholds are joined to the statistics and
applied; a value on its threshold is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_RX, documents, reserve, stored

WINDOW = 8  # words; hashes of windows double their width, so a power of two
#: What is measured against its group: whether low values are bad too, and the least spread that counts.
RULES = {
    "symbols_per_word": (False, 0.02),
    "chars_per_word": (True, 0.25),
    "repeated_words": (False, 0.04),
    "repeated_lines": (False, 0.06),
    "capitals": (False, 0.01),
    "top_word": (False, 0.01),
}
FAR = 6.0  # spreads beyond a quartile
BLEND = 20.0  # documents that a language weighs beside a group's own, and the corpus beside a language's
SLACK = 0.5  # short texts' statistics vary: this over the root of n_words is allowed besides
GAMMA = 1.02  # ratio of a bucket's bounds


def base_statistics(docs: DataFrame) -> DataFrame:
    """Adds to docs (text and any columns) n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_top_word and n_capitals (long). Null counts as empty."""
    rows = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("_words", F.filter(F.split("_text", SPACE_RX, -1), lambda w: w != ""))
    rows = rows.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w)))
    # hashes of windows of 2, 4 and then 8 words, each from two of the ones before, the second so many words on
    for half in (1, 2, 4):
        rows = rows.withColumn(f"_h{2 * half}", F.zip_with(f"_h{half}", F.slice(f"_h{half}", half + 1, F.size(f"_h{half}")), lambda x, y: F.xxhash64(x, y)))
    grams = F.slice("_h8", 1, F.greatest(F.size("_h8") - (WINDOW - 1), F.lit(0)))
    rows = rows.withColumn("_grams", grams)
    # windows found twice: equal neighbours once sorted; their starts, in order
    placed = F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).otherwise(F.array().cast("array<struct<g:long,i:int>>"))
    rows = rows.withColumn("_placed", placed)
    twice = F.filter("_placed", lambda p, k: (p["g"] == F.get("_placed", k - 1)["g"]) | (p["g"] == F.get("_placed", k + 1)["g"]))
    rows = rows.withColumn("_starts", F.sort_array(F.transform(twice, lambda p: p["i"])))
    # each covers its words up to the next one's start
    own = F.zip_with("_starts", F.slice("_starts", 2, F.size("_starts")), lambda i, after: F.coalesce(F.least(after - i, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(own, F.lit(0).cast("long"), lambda n, x: n + x)
    # the most frequent word: the longest run of equal hashes once sorted, between the places where runs begin
    rows = rows.withColumn("_sorted", F.sort_array("_h1"))
    rows = rows.withColumn("_runs", F.filter(F.transform("_sorted", lambda x, k: F.when(F.get("_sorted", k - 1) == x, F.lit(None)).otherwise(k)), lambda k: k.isNotNull()))
    most = F.array_max(F.transform("_runs", lambda at, k: F.coalesce(F.get("_runs", k + 1), F.size("_sorted")) - at))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(most, F.lit(0)).cast("long").alias("n_top_word"),
        F.length(F.regexp_replace("_text", "[^\\p{Lu}]", "")).cast("long").alias("n_capitals"),
    )


def _ratios() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "chars_per_word": F.col("word_chars") / words,
        "repeated_words": F.col("n_repeat_words") / words,
        "repeated_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "capitals": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
        "top_word": F.col("n_top_word") / words,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def sketches(stats: DataFrame) -> DataFrame:
    """Bucket counts (lang, source, rule, bucket, n) of what each rule measures, over rows that the base rules keep."""
    ratios = _ratios()
    pairs = F.array(*[F.struct(F.lit(k).alias("rule"), v.cast("double").alias("value")) for k, v in ratios.items()])
    rows = stats.filter(~base_failed()).select("lang", "source", F.explode(pairs).alias("p")).select("lang", "source", "p.rule", "p.value")
    bucket = F.when(F.col("value") < 1e-6, F.lit(-1000)).otherwise(F.ceil(F.log(F.col("value")) / math.log(GAMMA))).cast("int")
    return rows.groupBy("lang", "source", "rule", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quartiles(counts: DataFrame, by: list[str]) -> DataFrame:
    """Quartiles q1, q3 and the number of documents from bucket counts, for each of by and rule."""
    whole = W.partitionBy(*by, "rule")
    run = F.sum("n").over(whole.orderBy("bucket"))
    value = F.when(F.col("bucket") <= -1000, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1))
    rows = counts.select(*by, "rule", value.alias("value"), run.alias("run"), F.sum("n").over(whole).alias("docs"))
    reach = lambda q: F.min(F.when(F.col("run") >= q * F.col("docs"), F.col("value")))
    return rows.groupBy(*by, "rule").agg(reach(0.25).alias("q1"), reach(0.75).alias("q3"), F.max("docs").alias("docs"))


def thresholds(counts: DataFrame) -> DataFrame:
    """A row for each (lang, source): low and high for every rule, as columns <rule>_low and <rule>_high."""
    langs = counts.groupBy("lang", "rule", "bucket").agg(F.sum("n").alias("n"))
    every = langs.groupBy("rule", "bucket").agg(F.sum("n").alias("n"))
    named = lambda df, tag: df.select(*[c for c in ("lang", "source") if c in df.columns], "rule", F.struct("q1", "q3", "docs").alias(tag))
    rows = named(quartiles(counts, ["lang", "source"]), "own").join(named(quartiles(langs, ["lang"]), "lang_"), ["lang", "rule"]).join(named(quartiles(every, []), "all_"), "rule")
    mixed = lambda own, docs, above: (own * docs + BLEND * above) / (docs + BLEND)
    blend = lambda q: mixed(F.col(f"own.{q}"), F.col("own.docs"), mixed(F.col(f"lang_.{q}"), F.col("lang_.docs"), F.col(f"all_.{q}"))).alias(q)
    rows = rows.select("lang", "source", "rule", blend("q1"), blend("q3"))
    out = []
    for rule, (low, least) in RULES.items():
        spread = FAR * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        one = F.col("rule") == rule
        out.append(F.max(F.when(one, F.col("q3") + spread)).alias(f"{rule}_high"))
        if low:
            out.append(F.max(F.when(one, F.col("q1") - spread)).alias(f"{rule}_low"))
    return rows.groupBy("lang", "source").agg(*out)


def judge(docs: DataFrame) -> DataFrame:
    """Statistics and verdict for each row of docs (doc_id, text, lang, source): base_failed and kept.

    A null text counts as empty: without words, it fails. Null languages and sources count as
    empty names. A text that the base rules keep is kept unless a statistic lies beyond its
    group's threshold. Repeated rows are counted and judged each. An empty table gives an empty
    result; other columns are ignored. Statistics and thresholds are found and written when this
    is called.
    """
    named = docs.select("doc_id", "text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    stats = stored(base_statistics(named).drop("text"))
    # written first, so that the engine knows its size: few groups are broadcast, and a hot one is not dealt to one task
    limits = stored(thresholds(sketches(stats)))
    rows = stats.join(limits, ["lang", "source"], "left")
    slack = SLACK / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    bad = F.lit(False)
    for rule, value in _ratios().items():
        bad = bad | F.coalesce(value > F.col(f"{rule}_high") + slack, F.lit(False))
        if RULES[rule][0]:
            bad = bad | F.coalesce(value < F.col(f"{rule}_low") - slack, F.lit(False))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~bad)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with all columns. Rows alike in doc_id, text, lang and source share a verdict. Raises ValueError for a column by the name of _gone or _tie."""
    reserve(docs, "_gone", "_tie")
    tie = F.xxhash64("text", "lang", "source")
    verdict = judge(docs.select(F.struct("doc_id", tie.alias("tie")).alias("doc_id"), "text", "lang", "source"))
    gone = verdict.filter(~F.col("kept")).select(F.col("doc_id.doc_id").alias("_gone"), F.col("doc_id.tie").alias("_tie")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")) & (tie == F.col("_tie")), "left_anti")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    values = {"symbols_per_word": "n_symbols / w", "chars_per_word": "word_chars / w", "repeated_words": "n_repeat_words / w", "repeated_lines": "n_dup_lines / greatest(n_lines, 1)", "capitals": "n_capitals / greatest(word_chars, 1)", "top_word": "n_top_word / w"}
    long = " UNION ALL ".join(f"SELECT doc_id, lang, source, n_words, '{k}' AS rule, {v} AS value, CAST({RULES[k][1]} AS DOUBLE) AS least, {str(RULES[k][0]).lower()} AS low FROM s" for k, v in values.items())
    quartile = lambda by: f"SELECT {by}rule, min(value) FILTER (WHERE run >= 0.25 * docs) AS q1, min(value) FILTER (WHERE run >= 0.75 * docs) AS q3, any_value(docs) AS docs FROM (SELECT {by}rule, CASE WHEN bucket <= -1000 THEN 0 ELSE 2 * pow({GAMMA}, bucket) / ({GAMMA} + 1) END AS value, sum(n) OVER (PARTITION BY {by}rule ORDER BY bucket) AS run, sum(n) OVER (PARTITION BY {by}rule) AS docs FROM (SELECT {by}rule, bucket, count(*) AS n FROM b GROUP BY ALL)) GROUP BY ALL"
    blend = lambda q: f"(q1.{q} * q1.docs + {BLEND} * ((q2.{q} * q2.docs + {BLEND} * q3.{q}) / (q2.docs + {BLEND}))) / (q1.docs + {BLEND})"
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(ws, i, i + 7)) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM t WHERE len(ws) >= {WINDOW})
), covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM windows, (SELECT unnest(range({WINDOW})) AS d) WHERE k > 1 GROUP BY 1
), tops AS (
  SELECT doc_id, max(c) AS n FROM (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS word FROM t) GROUP BY 1, 2) GROUP BY 1
), s AS (
  SELECT t.doc_id, lang, source, len(ws) AS n_words, CAST(greatest(len(ws), 1) AS DOUBLE) AS w, length(array_to_string(ws, '')) AS word_chars, length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, CAST(len(ls) AS DOUBLE) AS n_lines, coalesce(m.n, 0) AS n_top_word, CAST(length(regexp_replace(x, '[^\\p{{Lu}}]', '', 'g')) AS DOUBLE) AS n_capitals,
    len(ws) < 20 OR 100 * coalesce(c.n, 0) > 30 * len(ws) AS base_failed
  FROM t LEFT JOIN covered c ON c.doc_id = t.doc_id LEFT JOIN tops m ON m.doc_id = t.doc_id
), v AS ({long}
), b AS (
  SELECT v.*, CASE WHEN value < 1e-6 THEN -1000 ELSE CAST(ceil(ln(value) / ln({GAMMA})) AS INTEGER) END AS bucket FROM v JOIN s ON s.doc_id = v.doc_id AND NOT s.base_failed
), q1 AS ({quartile("lang, source, ")}), q2 AS ({quartile("lang, ")}), q3 AS ({quartile("")}
), u AS (
  SELECT q1.lang, q1.source, q1.rule, {blend("q1")} AS a, {blend("q3")} AS z
  FROM q1 JOIN q2 ON q1.lang = q2.lang AND q1.rule = q2.rule JOIN q3 ON q1.rule = q3.rule
), bad AS (
  SELECT DISTINCT v.doc_id FROM v JOIN u ON u.lang = v.lang AND u.source = v.source AND u.rule = v.rule
  WHERE value > z + {FAR} * greatest(z - a, least) + {SLACK} / sqrt(greatest(n_words, 1)) OR (low AND value < a - {FAR} * greatest(z - a, least) - {SLACK} / sqrt(greatest(n_words, 1)))
)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND b.doc_id IS NULL AS kept FROM s LEFT JOIN bad b ON b.doc_id = s.doc_id
"""


OP8_SQL = _sql()
