"""Op 6, secret scans with multipart credential linking. DataFrame functions only.

Strong patterns are reported wherever they match. Weak candidates (an account's name, a token of
forty characters, an endpoint) mean nothing alone; they are reported only where complementary
parts co-occur: an identifier and a secret whose scopes meet, and with such a pair the endpoints
in the scope of either part. A part's scope is its span and ``reach`` characters on either side. Scopes meet by
an interval join: parts of identifiers are dealt to every bin that their scope touches, secrets
and endpoints to every bin that they touch themselves, bins join by equality within a text, and a
pair counts in the first bin that its parts share.

A row's matches and their places are found within the row, so texts are not shuffled; only the
parts of texts that hold weak candidates of both kinds are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, reserve, stored

#: The strong kinds in their order, the pattern and the least length of what counts (of group 2, or of the match).
STRONG = {
    "assign": ("(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8),
    "access": ("AKIA[A-Z0-9]+", 16),
    "hex": ("[0-9a-f]+", 32),
}
#: Weak candidates: the pattern, and which part of a credential it is.
WEAK = {
    "user": ("(?i)(?<![A-Za-z0-9_])(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9@._-]{3,}", "identifier"),
    "key40": ("(?<![A-Za-z0-9+/=])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", "secret"),
    "pass": ("(?i)(?<![A-Za-z0-9_])(?:pwd|pass|credentials?|auth|private_?key)[\"']?\\x20*[:=]\\x20*[\"']?[^\\x20\\x09-\\x0D\"']{6,}", "secret"),
    "endpoint": ("(?i)(?<![A-Za-z0-9_])(?:https?|s3|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\\x20\\x09-\\x0D\"'<>]+", "endpoint"),
}
#: The part that each strong kind can be.
PARTS = {"access": "identifier", "assign": "secret", "hex": "secret"} | {k: part for k, (_, part) in WEAK.items()}
ORDER = [*STRONG, *WEAK]
REACH = 200
STEP = 256  # values that a running sum takes in one go
RESERVED = ("_doc", "_key", "_tie")


def _let(value: Column, then) -> Column:
    """then(value), with value computed once however often then names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _running(values: Column, op) -> Column:
    """For each whole number in an array what op (a sum or a maximum, from 0) makes of all before it.

    op runs within blocks of STEP values and over the blocks' totals, so the work grows with the
    values, not with their square.
    """

    def within(rows, at):
        step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(rows, F.struct(at.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def over(blocks):
        totals = F.transform(blocks, lambda rows: F.aggregate(rows, F.lit(0), op))
        starts = F.aggregate(totals, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))
        return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), within))

    cut = lambda rows: F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / STEP).cast("int")), lambda k: F.slice(rows, k * STEP + 1, STEP))
    return _let(values, lambda rows: F.when(F.size(rows) > 0, _let(cut(rows), over)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost matches that do not overlap, as an array of (start, end, kind, match); places in code points, end exclusive."""
    none = F.array().cast("array<struct<start:int,end:int,kind:string,match:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # lengths of what lies before each match and of the match; what lies after the last one has no match
    sizes = F.zip_with(F.split(text, pattern, -1), found, lambda b, m: F.struct(F.length(b).alias("before"), F.length(m).alias("size"), m.alias("match")))
    sizes = F.filter(sizes, lambda x: x["match"].isNotNull())

    def placed(rows):
        at = _running(F.transform(rows, lambda x: x["before"] + x["size"]), lambda a, x: a + x)
        return F.zip_with(rows, at, lambda x, a: F.struct((a + x["before"]).alias("start"), (a + x["before"] + x["size"]).alias("end"), F.lit(kind).alias("kind"), x["match"].alias("match")))

    return F.when(text.rlike(pattern), _let(sizes, placed)).otherwise(none)


def _strong(text: Column, kind: str) -> Column:
    pattern, least = STRONG[kind]
    if kind == "assign":
        value = lambda m: F.regexp_extract(m["match"], "^" + pattern, 2)
        return F.filter(matches(text, pattern, kind), lambda m: F.length(value(m)) >= least)
    # a match is a whole run, so a run that is long enough is the match that counts
    pattern = pattern[:-1] + f"{{{least - len('AKIA') if kind == 'access' else least},}}"
    return matches(text, pattern, kind)


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,kind:string>>")


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind")))


def _ranked(spans: Column) -> Column:
    """Spans by start, then kind in the order listed."""
    rank = lambda m: F.array_position(F.array(*map(F.lit, ORDER)), m["kind"])
    return _bare(F.array_sort(F.transform(spans, lambda m: F.struct(m["start"].alias("start"), rank(m).alias("rank"), m["end"].alias("end"), m["kind"].alias("kind")))))


def spans(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, tie (a hash of the text), base and linked.

    base has the strong spans by start, then kind, linked the weak ones that links report: arrays
    of (start, end, kind); places in code points, end exclusive. Null and empty texts have none.
    Rows alike in doc_id and text have the same spans. Other columns are ignored; an empty table
    gives an empty result. Texts are read once, when this is called: what is found in each is
    written to the shared folder, and links are made from that.
    """
    text = F.col("text")
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text", F.coalesce(_ranked(F.concat(*[_bare(_strong(text, k)) for k in STRONG])), _none()).alias("base"))
    # weak candidates only matter where a secret and an identifier can be found
    known = {part: [k for k in STRONG if PARTS[k] == part] for part in ("identifier", "secret")}
    has = {part: F.arrays_overlap(F.col("base")["kind"], F.array(*map(F.lit, kinds))) for part, kinds in known.items()}
    for pattern, part in WEAK.values():
        if part in has:
            has[part] = has[part] | text.rlike(pattern)
    weak = F.concat(*[_bare(matches(text, p, k)) for k, (p, _) in WEAK.items()])
    rows = stored(rows.select("doc_id", "tie", "base", F.when(has["identifier"] & has["secret"], weak).alias("weak")))

    part = F.create_map(*[F.lit(x) for kv in PARTS.items() for x in kv])
    parts = rows.filter("weak is not null").select("doc_id", "tie", F.explode(F.concat("base", "weak")).alias("s")).select("doc_id", "tie", "s.*").distinct()
    parts = parts.withColumn("part", F.element_at(part, F.col("kind")))
    first = lambda at: F.floor(F.greatest(at, F.lit(0)) / reach)
    bins = lambda a, b: F.explode(F.sequence(first(a), F.floor(b / reach)))
    scoped = lambda of: parts.filter(F.col("part") == of).select("doc_id", "tie", F.struct("start", "end", "kind").alias(of), bins(F.col("start") - reach, F.col("end") + reach).alias("bin"))
    placed = lambda of: parts.filter(F.col("part") == of).select(F.col("doc_id").alias("_doc"), F.col("tie").alias("_key"), F.struct("start", "end", "kind").alias(of), bins(F.col("start"), F.col("end")).alias("_bin"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_key"))
    met = same & (F.col("bin") == F.col("_bin"))

    def near(a: str, b: str) -> Column:
        once = F.col("bin") == F.greatest(first(F.col(f"{a}.start") - reach), first(F.col(f"{b}.start")))
        return once & (F.col(f"{b}.start") < F.col(f"{a}.end") + reach) & (F.col(f"{b}.end") > F.col(f"{a}.start") - reach)

    apart = (F.col("secret.start") >= F.col("identifier.end")) | (F.col("secret.end") <= F.col("identifier.start"))
    pairs = scoped("identifier").join(placed("secret"), met & near("identifier", "secret") & apart).select("doc_id", "tie", F.explode(F.array("identifier", "secret")).alias("linked")).distinct()
    # endpoints in the scope of either part of a pair
    around = pairs.select("doc_id", "tie", "linked", bins(F.col("linked.start") - reach, F.col("linked.end") + reach).alias("bin"))
    ends = around.join(placed("endpoint"), met & near("linked", "endpoint")).select("doc_id", "tie", F.col("endpoint").alias("s"))
    links = pairs.select("doc_id", "tie", F.col("linked").alias("s")).union(ends).filter(F.col("s.kind").isin(list(WEAK)))
    links = links.groupBy(F.col("doc_id").alias("_doc"), F.col("tie").alias("_key")).agg(F.collect_set("s").alias("linked"))
    able = rows.filter("weak is not null").select("doc_id", "tie", "base").join(links, same, "left").select("doc_id", "tie", "base", F.coalesce(_ranked(F.col("linked")), _none()).alias("linked"))
    return able.union(rows.filter("weak is null").select("doc_id", "tie", "base", _none().alias("linked")))


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """docs (doc_id, text, any other columns) with base and linked, the arrays of spans().

    Raises ValueError for a column by the name of base, linked or one of RESERVED; others may have
    any name. Repeated rows stay; an empty table gives an empty result.
    """
    reserve(docs, "base", "linked", *RESERVED)
    found = spans(docs, reach).filter((F.size("base") > 0) | (F.size("linked") > 0)).dropDuplicates(["doc_id", "tie"])
    found = found.select(F.col("doc_id").alias("_doc"), F.col("tie").alias("_key"), "base", "linked")
    out = docs.withColumn("_tie", F.xxhash64("text")).join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_tie") == F.col("_key")), "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.coalesce(c, _none()).alias(c) for c in ("base", "linked")])


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the strong kinds, the hash of the strong spans and all spans as text, for rows with doc_id, base and linked."""
    count = lambda k: F.size(F.filter("base", lambda m: m["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select("doc_id", *map(count, STRONG), F.sha2(_said(F.col("base")), 256).alias("base_sha256"), _said(_ranked(F.concat("base", "linked"))).alias("spans"))


def redact(docs: DataFrame, mask: str = "*", reach: int = REACH) -> DataFrame:
    """docs with every found span's characters replaced by the mask; lengths and other columns stay. Null stays null; else as scan()."""
    found = scan(docs, reach)

    def piece(chars: Column, start: Column, size: Column) -> Column:
        """Code points of a text in four bytes each, which are cut without a walk from its start; the letter keeps a byte order mark from being one."""
        return F.substring(F.decode(F.concat(F.lit(b"\0\0\0A"), F.substring(chars, start * 4 + 1, size * 4)), "UTF-32"), 2, size)

    def masked(chars: Column, spans: Column, done: Column) -> Column:
        """done: for each span the end of all before it; what a span covers is masked from there."""
        own = lambda m, at: F.concat(piece(chars, at, F.greatest(m["start"] - at, F.lit(0))), F.repeat(F.lit(mask), F.greatest(m["end"] - F.greatest(m["start"], at), F.lit(0))))
        end = F.greatest(F.element_at(spans, -1)["end"], F.element_at(done, -1))
        return F.concat(F.array_join(F.zip_with(spans, done, own), ""), piece(chars, end, F.length("text") - end))

    spans_ = F.array_sort(F.concat("base", "linked"))
    done = lambda spans: _running(F.transform(spans, lambda m: m["end"]), lambda a, x: F.greatest(a, x))
    cut = _let(F.encode("text", "UTF-32"), lambda chars: _let(spans_, lambda spans: _let(done(spans), lambda at: masked(chars, spans, at))))
    text = F.when(F.size("base") + F.size("linked") > 0, cut).otherwise(F.col("text"))
    return found.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spans(documents(spark, sf_dir)))


def _sql() -> str:
    """The rules once more, with matches found by RE2, which has no look-around, and parts linked by comparing all of a text's."""
    either = lambda words: "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words) + ")"
    quote, space, name = "[\"\\x27]?", "\\x20*[:=]\\x20*", "[^\\x20\\x09-\\x0D\"\\x27"
    rx = {
        "assign": (either(["password", "passwd", "secret", "token", "api_?key"]) + quote + space + quote + "[A-Za-z0-9+/_.=-]+", ""),
        "access": ("AKIA[A-Z0-9]+", "length(m) >= 16"),
        "hex": ("[0-9a-f]+", "length(m) >= 32"),
        "user": ("\\b" + either(["username", "user_name", "user", "login", "account", "client_?id", "access_?key_?id", "access_?key"]) + quote + space + quote + "[A-Za-z0-9@._-]{3,}", ""),
        "key40": ("[A-Za-z0-9+/=]+", "length(m) = 40 AND NOT contains(m, '=') AND regexp_matches(m, '[0-9]')"),
        "pass": ("\\b" + either(["pwd", "pass", "credentials", "credential", "auth", "private_?key"]) + quote + space + quote + name + "]{6,}", ""),
        "endpoint": ("\\b(?:" + either(["https?", "s3", "ftp", "postgresql", "postgres", "mysql", "mongodb", "redis", "amqp"]) + "|" + either(["jdbc"]) + ":[A-Za-z]+)://" + name + "<>]+", ""),
    }
    rx["assign"] = (rx["assign"][0], f"length(regexp_extract(m, '^{either(['password', 'passwd', 'secret', 'token', 'api_?key'])}{quote}{space}{quote}(.*)$', 1)) >= 8")
    found = " UNION ALL ".join(f"SELECT doc_id, {k} AS rank, '{kind}' AS kind, '{PARTS[kind]}' AS part, a, a + length(m) AS z FROM (SELECT doc_id, m, sum(length(b) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS a FROM (SELECT doc_id, unnest(regexp_extract_all(x, '{p}')) AS m, unnest(string_split_regex(x, '{p}')[1:len(regexp_extract_all(x, '{p}'))]) AS b, unnest(range(len(regexp_extract_all(x, '{p}')))) AS i FROM t WHERE regexp_matches(x, '{p}'))) WHERE {also or 'true'}" for k, (kind, (p, also)) in enumerate(rx.items()))
    near = lambda p, q: f"{q}.a < {p}.z + {REACH} AND {q}.z > {p}.a - {REACH}"
    said = "kind || ':' || a || ':' || z"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), found AS MATERIALIZED ({found}
), parts AS (
  SELECT doc_id, kind, part, rank, CAST(a AS INTEGER) AS a, CAST(z AS INTEGER) AS z FROM found
), pairs AS (
  SELECT i.doc_id, i.a AS ia, i.z AS iz, i.kind AS ik, s.a AS sa, s.z AS sz, s.kind AS sk FROM parts i JOIN parts s ON i.doc_id = s.doc_id AND i.part = 'identifier' AND s.part = 'secret' AND {near("i", "s")} AND (s.a >= i.z OR s.z <= i.a)
), ends AS (
  SELECT DISTINCT e.doc_id, e.a, e.z, e.kind FROM parts e JOIN (SELECT doc_id, ia AS a, iz AS z FROM pairs UNION SELECT doc_id, sa, sz FROM pairs) l ON e.doc_id = l.doc_id AND e.part = 'endpoint' AND {near("l", "e")}
), spans AS (
  SELECT doc_id, rank, kind, a, z FROM parts WHERE rank < {len(STRONG)}
  UNION SELECT p.doc_id, p.rank, p.kind, p.a, p.z FROM parts p JOIN (SELECT doc_id, ia AS a, ik AS kind FROM pairs UNION SELECT doc_id, sa, sk FROM pairs UNION SELECT doc_id, a, kind FROM ends) l ON p.doc_id = l.doc_id AND p.a = l.a AND p.kind = l.kind WHERE p.rank >= {len(STRONG)}
), said AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in STRONG)}, string_agg({said}, ',' ORDER BY a, rank) FILTER (WHERE rank < {len(STRONG)}) AS base, string_agg({said}, ',' ORDER BY a, rank) AS spans FROM spans GROUP BY 1
)
SELECT d.doc_id, {", ".join(f"coalesce(s.n_{k}, 0) AS n_{k}" for k in STRONG)}, sha256(coalesce(s.base, '')) AS base_sha256, coalesce(s.spans, '') AS spans FROM documents d LEFT JOIN said s ON s.doc_id = d.doc_id
"""


OP6_SQL = _sql()
