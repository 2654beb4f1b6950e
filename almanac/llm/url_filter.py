"""Op 10, URL filters with rules indexed by their rarest literal token. DataFrame functions only.

Place rules (host and path) are found by equality: a URL looks up each of its host's suffixes
with each prefix of its path that ends with a slash. Pattern rules are regular expressions with
the literal tokens that any match must hold, by branch where a rule has alternatives; each branch
is indexed under the one of its tokens that the fewest URLs have. A URL's own tokens fetch
candidate rules from the index, and only those candidates run their regular expression.

URLs are judged once each, however often they occur, and verdicts are joined back to the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The place rules of the query; the longest that fits wins.
PLACES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
TOKEN_RX = "[^a-z0-9]+"


@dataclass(frozen=True)
class Pattern:
    """A rule for a whole URL, A to Z in lower case: a Java regular expression and, for each of its branches, the tokens that any match by it holds whole."""

    verdict: str
    regex: str
    branches: tuple[tuple[str, ...], ...]


#: The pattern rules of the query. A URL that no rule speaks for is allowed.
PATTERNS = [
    Pattern("block", "://([^/?#]*[.-])?cheap-pills[.-]", (("cheap", "pills"),)),
    Pattern("block", "://([^/?#]*[.-])?spam-farm[.-]", (("spam", "farm"),)),
    Pattern("block", "://([^/?#]*[.-])?online-casino[.-]", (("online", "casino"),)),
    Pattern("block", "://([^/?#]*[.-])?free-money[.-]", (("free", "money"),)),
    Pattern("block", "://([^/?#]*[.-])?adult-videos?[.-]", (("adult", "video"), ("adult", "videos"))),
    Pattern("block", "://([^/?#]*[.-])?payday-loans?[.-]", (("payday", "loan"), ("payday", "loans"))),
    Pattern("block", "[/?&]tracker[/=]", (("tracker",),)),
    Pattern("block", "/(wp-login|wp-admin)([/.?#]|$)", (("wp", "login"), ("wp", "admin"))),
    Pattern("block", "\\.(exe|scr|apk)([?#]|$)", (("exe",), ("scr",), ("apk",))),
]


def lower(column: Column) -> Column:
    """A to Z in lower case; other letters stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, lower(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(lower(url), TOKEN_RX, -1), lambda t: t != ""))


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of literals."""
    names = [x.split() for x in schema.split(", ")]
    literals = [F.struct(*[F.lit(v).cast(kind).alias(c) for v, (c, kind) in zip(row, names, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*literals).cast(f"array<struct<{', '.join(f'{c}:{kind}' for c, kind in names)}>>")))


def place_verdicts(urls: DataFrame, places: list[tuple[str, str]]) -> DataFrame:
    """url, rule and verdict of the longest place rule that fits each url; urls without one are left out.

    A rule's host fits itself and its subdomains, its path what the URL's path starts with. Rules
    have few sizes, so each URL looks up only host suffixes of as many labels, and path prefixes of
    as many characters, as rules have.
    """
    parts = [(verdict, rule, *rule.partition("/")[::2]) for verdict, rule in places]
    table = _table(urls.sparkSession, [(v, r, h, "/" + p, len(r)) for v, r, h, p in parts], "verdict string, rule string, _host string, _path string, _length int")
    lengths = sorted({len(p) + 1 for *_, p in parts})
    labels = sorted({h.count(".") + 1 for _, _, h, _ in parts})
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in labels]).cast("array<string>"))
    prefixes = F.array_distinct(F.array(*[F.substring("path", 1, n) for n in lengths]))
    rows = urls.select("url", F.explode(suffixes).alias("_host"), prefixes.alias("_prefixes"))
    fits = rows.join(table, "_host").filter(F.array_contains("_prefixes", F.col("_path")))
    return fits.groupBy("url").agg(F.max(F.struct("_length", "rule", "verdict")).alias("best")).select("url", "best.rule", "best.verdict")


def index(urls: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """The pattern rules under the rarest token of each branch (rule, branch, regex, verdict, token). Raises ValueError for a rule or branch without a token, which no URL could fetch."""
    if any(not p.branches or not all(p.branches) for p in patterns):
        raise ValueError("a pattern rule needs a literal token in each of its branches")
    rows = [(k, j, p.regex, p.verdict, t) for k, p in enumerate(patterns) for j, tokens in enumerate(p.branches) for t in tokens]
    rules = _table(urls.sparkSession, rows, "rule int, branch int, regex string, verdict string, token string")
    known = rules.select("token").distinct()
    seen = urls.select(F.explode(_tokens(F.col("url"))).alias("token")).join(known, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rare = rules.join(seen, "token", "left").groupBy("rule", "branch", "regex", "verdict").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"))
    return rare.select("rule", "branch", "regex", "verdict", F.col("least.token").alias("token"))


def pattern_verdicts(urls: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """url and verdict of the first pattern rule, in the order given, that matches each url; urls without one are left out."""
    if not patterns:
        return urls.select("url", F.lit(None).cast("string").alias("verdict")).limit(0)
    rules = index(urls, patterns).select("rule", "regex", "verdict", "token").distinct()
    tokens = urls.select("url", F.explode(_tokens(F.col("url"))).alias("token"))
    found = tokens.join(rules, "token").filter(F.regexp_like(lower(F.col("url")), F.col("regex")))
    return found.groupBy("url").agg(F.min(F.struct("rule", "verdict")).alias("first")).select("url", "first.verdict")


def judge(pages: DataFrame, places: list[tuple[str, str]], patterns: list[Pattern]) -> DataFrame:
    """Judges each row of pages (page_id, url): page_id, host, path, rule (place rule or null) and verdict.

    The longest place rule that fits decides; where none does, the first pattern rule that
    matches; else the URL is allowed. A null URL, or one without ``://``, has an empty host and
    path; a null one is allowed, another is still held against pattern rules. Repeated rows and
    URLs are judged alike. Other columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select("page_id", "url")
    urls = rows.filter("url is not null").select("url").distinct()
    split = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    place = place_verdicts(split, places).select(F.col("url").alias("_u1"), "rule", F.col("verdict").alias("_by_place"))
    pattern = pattern_verdicts(urls, patterns).select(F.col("url").alias("_u2"), F.col("verdict").alias("_by_pattern"))
    out = rows.join(place, F.col("url") == F.col("_u1"), "left").join(pattern, F.col("url") == F.col("_u2"), "left")
    url = F.coalesce("url", F.lit(""))
    return out.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "rule", F.coalesce("_by_place", "_by_pattern", F.lit("allow")).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), PLACES, PATTERNS)


def _sql_patterns() -> str:
    url = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return " ".join(f"WHEN regexp_matches({url}, '{p.regex}') THEN '{p.verdict}'" for p in PATTERNS)


OP10_SQL = f"""
WITH parts AS (
  SELECT page_id, url,
    CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN translate(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), rules(verdict, rule, rhost, rpath) AS (VALUES {", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in PLACES)}
), fits AS (
  SELECT p.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC) AS k
  FROM parts p JOIN rules r ON (p.host = r.rhost OR suffix(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE {_sql_patterns()} ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1
"""
