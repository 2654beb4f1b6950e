"""Op 4, document fingerprints: a Merkle tree over sections and paragraphs.

Blank lines part a text into sections and line ends part a section into paragraphs; a paragraph
is parted further into runs that end with a sentence or after eight words, so that one edit in
a long paragraph leaves most of it alike. A leaf is the hash of such a run. A paragraph hashes
its leaves, a section its paragraphs, the root its sections. Equal roots mean equal texts; where
roots differ, only branches that differ need to be followed to find the edits.

The fingerprint is the tree in one string: the root (32 hex digits), then the leaves (8 hex digits
each, ``.`` between paragraphs and ``/`` between sections), then the inner nodes (8 hex digits
each: a section, then its paragraphs, ``/`` between sections), parted by ``:``. Likeness compares
leaves; edits are found by going down from two roots, from section to paragraph, into branches
that differ alone.

Neighbours in order of doc_id come from a range partitioning whose bounds are quantiles of the
ids: each partition is sorted and streamed, so the next document is the next row; only the last
row of a partition needs another partition's first row, of which there is one for each.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, lean, partitions

_BLANK = re.compile(r"\n(?:[ \t\r]*\n)+")
_EDITS = pa.list_(pa.struct([("section", pa.int32()), ("paragraph", pa.int32())]))
_RUN = re.compile(r"(?:[^ .!?]* ){0,7}[^ .!?]*(?:[.!?]+ *| +|\Z)")


def tree(text: str) -> list[list[list[str]]]:
    """Sections of paragraphs of runs; joined they are the text again."""
    out, at = [], 0
    for end in [*(m.end() for m in _BLANK.finditer(text)), len(text)]:
        if end > at:
            section = text[at:end]
            body = section.rstrip("\n \t\r") if end < len(text) else section
            lines = body.split("\n")
            paragraphs = [x + "\n" for x in lines[:-1]] + [lines[-1] + section[len(body) :]]
            out.append([[r for r in _RUN.findall(p) if r] for p in paragraphs if p])
            at = end
    return out


def fingerprint(text: str) -> str:
    """The tree of a text as a string; the empty text has a root and no leaves."""
    hash_, leaves, inner, roots = xxhash.xxh3_64_intdigest, [], [], []
    for section in tree(text):
        own, branches = [], []
        for paragraph in section:
            runs = [hash_(run) for run in paragraph]
            branches.append(xxhash.xxh3_128_digest(repr(runs)))
            own.append("".join([f"{x >> 32:08x}" for x in runs]))
        root = xxhash.xxh3_128_digest(b"".join(branches))
        roots.append(root)
        leaves.append(".".join(own))
        inner.append(root[:4].hex() + "".join([x[:4].hex() for x in branches]))
    return f"{hashlib.blake2b(b''.join(roots), digest_size=16).hexdigest()}:{'/'.join(leaves)}:{'/'.join(inner)}"


def _leaves(print_: str) -> list[str]:
    body = print_[33 : print_.index(":", 33)].replace("/", "").replace(".", "")
    return [body[k : k + 8] for k in range(0, len(body), 8)]


def _inner(print_: str) -> list[tuple[str, list[str]]]:
    """Sections with their paragraphs."""
    parts = [x for x in print_[print_.index(":", 33) + 1 :].split("/") if x]
    return [(x[:8], [x[k : k + 8] for k in range(8, len(x), 8)]) for x in parts]


def likeness(a: str, b: str) -> float:
    """From two fingerprints: leaves in common over all leaves, counted with their number (0 to 1). Equal roots give 1."""
    if a[:32] == b[:32]:
        return 1.0
    x, y = Counter(_leaves(a)), Counter(_leaves(b))
    common = sum((x & y).values())
    return common / max(1, sum(x.values()) + sum(y.values()) - common)


def _unmatched(old: list[str], new: list[str]) -> tuple[list[int], list[int]]:
    """Places in old and new whose nodes differ: common ones at the front, then at the end, then one for one among the others are matched."""
    lo, top = 0, min(len(old), len(new))
    while lo < top and old[lo] == new[lo]:
        lo += 1
    hi = 0
    while hi < top - lo and old[-1 - hi] == new[-1 - hi]:
        hi += 1
    have, gone, left = Counter(old[lo : len(old) - hi]), [], []
    for places, nodes, out in ((range(lo, len(new) - hi), new, left), (range(lo, len(old) - hi), old, gone)):
        for k in places:
            matched = (have[nodes[k]] > 0) == (out is left)  # of old nodes those stay that no new one took
            have[nodes[k]] -= have[nodes[k]] > 0
            if not matched:
                out.append(k)
    return gone, left


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """Where texts differ: (section, paragraph) of the second that the first has not, found by going down branches that differ alone."""
    if a[:32] == b[:32]:
        return []
    old, new = _inner(a), _inner(b)
    gone, left = _unmatched([x for x, _ in old], [x for x, _ in new])
    before, after = [p for k in gone for p in old[k][1]], [(k, j, p) for k in left for j, p in enumerate(new[k][1])]
    return [after[k][:2] for k in _unmatched(before, [p for _, _, p in after])[1]]


def _count(bounds, column, test):
    """How many of the ascending bounds pass a test that holds for the first ones: a binary search."""
    n = F.size(bounds)

    def step(at, k):
        to = at + k
        return F.when((to <= n) & test(F.get(bounds, F.least(to, n) - 1), column), to).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(24, -1, -1)]), F.lit(0), step)


def _place(docs: DataFrame, n: int) -> DataFrame:
    """Adds part, which ascends with doc_id (null ids below all others), and tie, a hash that orders and spreads the rows of one id."""
    docs = docs.withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 1))
    if n == 1:
        return docs.withColumn("part", F.lit(0))
    edge = docs.agg(F.coalesce(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n), F.array().cast("array<long>")).alias("bounds"))
    docs = docs.withColumn("bounds", edge.scalar())  # a subquery of one value
    share = F.col("tie").cast("double") / F.lit(2.0**63)
    under = _count(F.col("bounds"), F.col("doc_id"), lambda b, x: b < x)
    equal = _count(F.col("bounds"), F.col("doc_id"), lambda b, x: b <= x) - under
    # an id that is a bound itself spreads over as many parts as it has bounds
    part = F.when(F.col("doc_id").isNull(), F.floor(share * n) - n).otherwise(under + F.floor(share * equal))
    return docs.withColumn("part", part.cast("int")).drop("bounds")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints every text of docs (doc_id, text) and its edited text.

    The edited text's last quarter (rounded down, in code points) is replaced by as many first
    code points of the next document in order of doc_id, or all if it has fewer; the last
    document takes the first one's. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next and edits, the places (section, paragraph) of the
    edited text that the text has not. A null text counts as empty. Rows of one
    doc_id are in order of a hash of their texts, then of the texts; rows with null ids come
    first. One document alone is its own next. Other columns are ignored; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _place(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), n)
    # the first row of each part, sent to the filled part before it; the lowest part's goes to the highest
    heads = rows.groupBy("part").agg(F.min(F.struct("doc_id", "tie", "text")).alias("head"))
    order = W.orderBy("part")  # two rows of two numbers for each partition at most, which are sent to the heads and not the other way round
    to = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.lag("part").over(order), F.max("part").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("to"))
    heads = heads.join(F.broadcast(to), "part").select(F.col("to").alias("part"), F.lit(True).alias("last"), F.col("head.text").alias("text"))
    both = rows.select("part", F.lit(False).alias("last"), "doc_id", "tie", "text").unionByName(heads, allowMissingColumns=True)
    # a task for each part; those of null ids, which are below 0, go along with others
    dealt = both.repartitionById(n, F.pmod("part", F.lit(n))).sortWithinPartitions("part", "last", "doc_id", "tie", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edits"]

    def run(batches):
        before = None  # part, doc_id, text, fingerprint
        for batch in batches:
            out = []
            for last, doc, text in zip(batch["last"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                print_ = fingerprint(text)
                if before is not None:
                    own, t, p = before
                    k = len(t) // 4
                    edited = t[: len(t) - k] + text[:k]
                    e = fingerprint(edited)
                    out.append((own, len(t), hashlib.sha256(edited.encode()).hexdigest(), p, e, likeness(p, e), likeness(p, print_), [{"section": k, "paragraph": j} for k, j in differing(p, e)]))
                before = None if last else (doc, text, print_)  # the part's end
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 8, (batch["doc_id"].type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), _EDITS), strict=True)], names)

    return dealt.select("last", "doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits array<struct<section:int,paragraph:int>>")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints(documents(spark, sf_dir))
    return out.withColumn("n_edits", F.size("edits").cast("long")).drop("edits")
