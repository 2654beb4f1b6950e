"""Op 3, n-gram Jaccard join by vertical partitioning.

Every document is a set of word n-grams (64-bit hashes). Which n-grams of a set come first, where
candidates are sought, is told by one order over all documents: rarer first, by a count sketch of
a fixed size, then by hash. Any order gives the same links; a rare-first one gives few
candidates. Overlaps are counted along the order of hashes, cut into fragments of equal share.
Jobs for steps 1 to 4 run when the join is asked for, before its result does. The join has these
steps:

1. Equal sets become one class (any number of copies is one row from here on).
2. Candidates: two sets with the overlap o that their sizes demand share an n-gram among the
   first (size - o + 1) of each. Those n-grams are listed by blocks of sets; lists meet by ranges
   of n-grams, where each block learns which of its n-grams other sets have, and only these
   become postings. (A block lists an n-gram once, so a frequent one is no large group. Blocks and
   ranges follow the number of n-grams, so what one task holds does not grow with it.)
   Of more first n-grams, sets that overlap enough share more (size - o + k of each: k), so a
   pair is held against two-byte tags of them, which may overstate what is shared, never less.
3. Exact overlaps: the global order of hashes is cut into fragments; a set is cut into the same
   fragments; for a pair, partial overlaps are counted in each fragment alone and summed.
4. Links become components by label propagation with shortcuts.

Candidates come in two rounds, so that a group of k near copies doesn't make k * k pairs. In
the first each posting meets only the posting that stands earliest in its own set (the least
edited copy). The second takes what is left: postings of one n-gram whose sets are in different
components. Pairs inside a component can't change the result, and no other pair is left out,
so the components are those of all links.

Classes and n-grams are told apart by 64-bit hashes: of N distinct sets, N * N / 2**65 pairs
are expected to be taken for equal (3e-2 for a billion).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SKETCH_SCHEMA, bit_batch, blocks_of, documents, lean, lowered, merged_bits, merged_sketch, mix, reserve, sketch_batch, slices, span_hashes, stored, words

BITS = 22  # the count sketch has 2**22 counters
BITS_SEEN = 25  # the sketch of sets that are asked for has 2**25 bits
FRAGMENTS = 8
SALTS = 32  # places that a component's label is dealt to


def shingle_sets(texts: pa.Array, n: int):
    """Yields (row, sorted distinct n-gram hashes); with fewer than n words the whole sequence is one, without words there is none."""
    for lo, hi, data, offsets in slices(texts):
        data = lowered(data)
        s, e, row = words(data, offsets)
        h = span_hashes(data, s, e)
        first = np.searchsorted(row, np.arange(hi - lo + 1))
        grams = np.zeros(len(h), np.uint64)
        if len(h):
            for k in range(n):
                grams = mix(grams + np.append(h[k:], np.zeros(min(k, len(h)), np.uint64))[: len(h)] + np.uint64(k + 1))
        for k in range(hi - lo):
            a, b = first[k], first[k + 1]
            if b - a >= n:
                yield lo + k, np.unique(grams[a : b - n + 1])
            elif b > a:
                g = np.array([b - a], np.uint64) << np.uint64(56)
                for i in range(a, b):
                    g = mix(g + h[i : i + 1])
                yield lo + k, g
            else:
                yield lo + k, np.zeros(0, np.uint64)


def set_id(grams: np.ndarray) -> int:
    """The class of a set."""
    with np.errstate(over="ignore"):
        return int(mix(mix(grams).sum(keepdims=True) + np.uint64(len(grams)))[0].view(np.int64))


def _slot(grams: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (grams >> np.uint64(64 - bits)).astype(np.int64)


def least_overlap(n: np.ndarray | int, m, percent: int):
    """The least intersection of sets of n and m with 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def _bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return bits[at >> 3] >> (7 - (at & 7)) & 1 == 1


def _block(ids: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(33)).astype(np.int64) % blocks


_TYPES = {"block": pa.int32(), "part": pa.int32(), "fragment": pa.int32(), "n": pa.int32(), "id": pa.int64(), "grams": pa.binary(), "twice": pa.binary()}


def _batch(rows: list[tuple], *names: str) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, _TYPES[c]) for x, c in zip(columns, names, strict=True)], list(names))


def _longest_prefix(n: int, percent: int) -> int:
    """The most first n-grams of a set of n that any partner demands."""
    return n - -(-percent * n // 100) + 1 if n else 0


def components(links: DataFrame) -> DataFrame:
    """(id, label) of the nodes of links (a, b): label is the smallest id of the component.

    Each round a node takes the smallest label among its neighbours' and then that label's own
    label (a shortcut), until none changes; rounds grow with the logarithm of a path's length.
    """
    bound = 2 * links.count()
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), bound)
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), bound)
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        low = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # hooking: the old root learns of the lower label too
        roots = low.filter("label < old").groupBy(F.col("old").alias("id")).agg(F.min("label").alias("hook"))
        low = low.join(roots, "id", "left").select("id", "old", F.least("label", F.coalesce("hook", "label")).alias("label"))
        up = low.select(F.col("id").alias("label"), F.col("label").alias("up"))
        step = stored(low.join(up, "label", "left").select("id", "old", F.coalesce("up", "label").alias("label")), bound)
        labels = step.select("id", "label")
        if step.filter("label < old").isEmpty():
            return labels


def _overlaps(pairs: DataFrame, docs: DataFrame, n: int, percent: int, fragments: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b) whose sets overlap enough: partial overlaps by fragment, summed by pair."""
    spark = pairs.sparkSession
    # the sets that are asked for, in a bit sketch of a fixed size: it may let others through, never miss one
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def mark(batches):
        bits = np.zeros(1 << (BITS_SEEN - 3), np.uint8)
        for batch in batches:
            at = _slot(mix(batch["id"].to_numpy().view(np.uint64)), BITS_SEEN)
            np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        yield bit_batch(bits)

    wanted = spark.sparkContext.broadcast(merged_bits(ids.mapInArrow(lean(mark), SKETCH_SCHEMA), BITS_SEEN))
    edges = np.linspace(0, 2.0**64, fragments + 1)[1:-1].astype(np.uint64)

    def cut(batches):
        want = wanted.value
        for batch in batches:
            sent: set[int] = set()
            rows = []
            for _, grams in shingle_sets(batch["text"], n):
                if len(grams) and (c := set_id(grams)) not in sent and _bit(want, _slot(mix(np.array([c]).view(np.uint64)), BITS_SEEN))[0]:
                    sent.add(c)
                    rows += [(c, f, x.tobytes()) for f, x in enumerate(np.split(grams, np.searchsorted(grams, edges)))]
            yield _batch(rows, "id", "fragment", "grams")

    # copies of a set meet here; a set that slipped through the sketch meets no pair below
    sets = docs.select("text").mapInArrow(lean(cut), "id long, fragment int, grams binary")
    sets = stored(sets.groupBy("id", "fragment").agg(F.first("grams").alias("grams")))

    def count(batches):
        for batch in batches:
            got = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("a", "b", "n_a", "n_b")), pa.array(got, pa.int64())], ["a", "b", "n_a", "n_b", "partial"])

    # pairs have no bound, so they are never broadcast: the join is the same at every size
    met = pairs.join(sets.select(F.col("id").alias("a"), "fragment", F.col("grams").alias("x")).hint("merge"), "a")
    met = met.join(sets.select(F.col("id").alias("b"), "fragment", F.col("grams").alias("y")).hint("merge"), ["b", "fragment"])
    partial = met.select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(lean(count), "a long, b long, n_a int, n_b int, partial long")
    total = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("partial").alias("common"))
    return total.filter(F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent).select("a", "b")


def join(docs: DataFrame, n: int = 5, percent: int = 80, fragments: int = FRAGMENTS) -> DataFrame:
    """Links texts of docs (doc_id, text) whose n-gram sets have a Jaccard likeness of percent/100 or more.

    Returns a row for each row of docs: doc_id, n_shingles, set_id (equal sets have one; null
    without words) and component_id, the smallest doc_id that links reach. Null and empty texts
    have n_shingles 0 and are in a component of their own; a null doc_id is passed through and
    comes after all others. Repeated rows are copies of each other. Texts may be of any length;
    other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    # 1: sets, classes, and a sketch of how many documents have each n-gram
    def first(batches):
        counts, ids, sizes, classes = np.zeros(1 << BITS, np.uint32), [], [], []
        for batch in batches:
            for row, grams in shingle_sets(batch["text"], n):
                sizes.append(len(grams))
                classes.append(set_id(grams) if len(grams) else None)
                if len(grams):
                    at, many = np.unique(_slot(grams), return_counts=True)
                    counts[at] += many.astype(np.uint32)
            ids.append(batch["doc_id"])
        ids = pa.chunked_array(ids).combine_chunks() if ids else pa.array([])
        m, own = len(sizes), sketch_batch(counts)
        names = ["doc_id", "n", "id", "part", "counts"]
        if m:
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int32()), pa.array(classes, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
            k = len(own)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, ids.type), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), own["part"], own["counts"]], names)

    seen = stored(docs.mapInArrow(lean(first), f"doc_id {kind}, n int, id long, part int, counts binary"))
    common = spark.sparkContext.broadcast(merged_sketch(seen.filter("part is not null").select("part", "counts"), BITS))
    seen = seen.filter("part is null").select("doc_id", "n", "id")

    # 2: the first n-grams of each set in the rare-first order, in blocks of sets
    grams = seen.agg(F.sum("n")).first()[0] or 0
    blocks = blocks_of(spark, 8 * grams * (100 - percent) // 100)

    def prefixes(batches):
        for batch in batches:
            done: set[int] = set()
            rows = []
            for _, grams in shingle_sets(batch["text"], n):
                if len(grams) and (c := set_id(grams)) not in done:
                    done.add(c)
                    known = common.value[_slot(grams)]
                    at = np.lexsort((grams, known))[: _longest_prefix(len(grams), percent)]
                    if (known[at] > 1).any():  # else no other document has any of them
                        rows.append((int(_block(np.array([c]), blocks)[0]), c, len(grams), grams[at].tobytes()))
            yield _batch(rows, "block", "id", "n", "grams")

    def gather(table: pa.Table) -> pa.Table:
        """Copies of a set become one; and the block's distinct n-grams are listed by range."""
        block = table["block"][0].as_py()
        _, at = np.unique(table["id"].to_numpy(), return_index=True)
        own = table.take(pa.array(at)).select(["block", "id", "n", "grams"])
        found, many = np.unique(np.frombuffer(b"".join(own["grams"].to_pylist()), np.uint64), return_counts=True)
        part = _slot(found, 32) * blocks >> 32  # ascending
        cuts = np.searchsorted(part, np.arange(blocks + 1))
        lists = [(block, k, found[i:j].tobytes(), np.packbits(many[i:j] > 1).tobytes()) for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if j > i]
        listed = pa.Table.from_batches([_batch(lists, "block", "part", "grams", "twice")])
        return pa.concat_tables([own, listed], promote_options="default").select(["block", "id", "n", "grams", "part", "twice"])

    kept = stored(docs.select("text").mapInArrow(lean(prefixes), "block int, id long, n int, grams binary").repartitionById(blocks, "block").groupBy("block").applyInArrow(gather, "block int, id long, n int, grams binary, part int, twice binary"))
    sets = kept.filter("id is not null").select("block", "id", "n", "grams")

    def answer(table: pa.Table) -> pa.Table:
        """For each block's list a bit for each n-gram: whether two sets have it."""
        lists = [np.frombuffer(x, np.uint64) for x in table["grams"].to_pylist()]
        twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(g)) for x, g in zip(table["twice"].to_pylist(), lists, strict=True)]
        found, place, many = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        many[place[np.concatenate(twice) > 0]] = 2
        bits = np.split(many[place] > 1, np.cumsum([len(g) for g in lists])[:-1])
        return pa.Table.from_batches([_batch([(b, table["part"][0].as_py(), np.packbits(x).tobytes()) for b, x in zip(table["block"].to_pylist(), bits, strict=True)], "block", "part", "twice")])

    answers = kept.filter("part is not null").select("block", "part", "grams", "twice").repartitionById(blocks, "part").groupBy("part").applyInArrow(answer, "block int, part int, twice binary")

    def post(own: pa.Table, got: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint64) for x in own["grams"].to_pylist()]
        found = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
        part = _slot(found, 32) * blocks >> 32
        cuts = np.searchsorted(part, np.arange(blocks + 1))
        shared = np.zeros(len(found), bool)
        for k, x in zip(got["part"].to_pylist(), got["twice"].to_pylist(), strict=True):
            shared[cuts[k] : cuts[k + 1]] = np.unpackbits(np.frombuffer(x, np.uint8), count=int(cuts[k + 1] - cuts[k]))
        flat, sizes = np.concatenate([*lists, np.zeros(0, np.uint64)]), [len(g) for g in lists]
        pos = np.concatenate([*map(np.arange, sizes), np.zeros(0, np.int64)]).astype(np.int32)
        at = np.flatnonzero(shared[np.searchsorted(found, flat)]) if len(flat) else np.zeros(0, np.int64)
        whose = np.repeat(np.arange(len(lists)), sizes)[at]
        return pa.table({"gram": flat[at].view(np.int64), "id": own["id"].to_numpy()[whose], "n": own["n"].to_numpy()[whose], "pos": pos[at]})

    dealt = sets.repartitionById(blocks, "block").groupBy("block"), answers.repartitionById(blocks, "block").groupBy("block")
    postings = stored(dealt[0].cogroup(dealt[1]).applyInArrow(post, "gram long, id long, n int, pos int"))
    bound = postings.count()  # each posting gives at most a pair in round 1

    def tag(batches):
        for batch in batches:
            tags = [np.sort((mix(np.frombuffer(x, np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)).tobytes() for x in batch["grams"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(tags, pa.binary())], ["id", "tags"])

    tags = sets.select("id", "grams").mapInArrow(lean(tag), "id long, tags binary")

    def may_link(batches):
        for batch in batches:
            keep = []
            for n_a, n_b, x, y in zip(batch["n_a"].to_pylist(), batch["n_b"].to_pylist(), batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)
                need = least_overlap(n_a, n_b, percent)
                shared = max(np.isin(x, y).sum(), np.isin(y, x).sum())  # at least as many as the n-grams shared
                keep.append(bool(shared >= min(len(x) - n_a, len(y) - n_b) + need))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b", "n_a", "n_b"])

    def likely(pairs: DataFrame) -> DataFrame:
        """The pairs that the tags of their first n-grams don't rule out."""
        met = pairs.join(tags.select(F.col("id").alias("a"), F.col("tags").alias("x")).hint("merge"), "a").join(tags.select(F.col("id").alias("b"), F.col("tags").alias("y")).hint("merge"), "b")
        return stored(met.select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(lean(may_link), "a long, b long, n_a int, n_b int"))

    def fits(a: str, b: str) -> str:
        need = f"ceil({percent} * ({a}.n + {b}.n) / {100 + percent}.0D - 1e-9)"
        return f"{a}.pos + {need} <= {a}.n and {b}.pos + {need} <= {b}.n"

    # round 1: each posting meets the least edited set of its n-gram
    lead = postings.groupBy("gram").agg(F.min(F.struct("pos", "n", "id")).alias("y"))
    star = postings.alias("x").join(lead, "gram").filter("x.id <> y.id and " + fits("x", "y"))
    star = stored(star.select(F.col("y.id").alias("a"), F.col("x.id").alias("b"), F.col("y.n").alias("n_a"), F.col("x.n").alias("n_b")).distinct(), bound)
    links = stored(_overlaps(likely(star), docs, n, percent, fragments), bound)
    found = components(links)

    # round 2: n-grams whose sets are in different components
    labelled = postings.join(found, "id", "left").select("gram", "id", "n", "pos", F.coalesce("label", "id").alias("label"))
    mixed = labelled.groupBy("gram").agg(F.min(F.struct("pos", "n", "id", "label")).alias("y"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("gram", F.col("y.label").alias("main"))
    labelled = labelled.join(mixed, "gram")
    rest = labelled.filter("label <> main").alias("x").join(labelled.alias("y"), "gram")
    rest = rest.filter("x.label <> y.label and (y.label = y.main or x.id < y.id) and " + fits("x", "y"))
    rest = rest.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.when(F.expr("x.id < y.id"), F.col("x.n")).otherwise(F.col("y.n")).alias("n_a"), F.when(F.expr("x.id < y.id"), F.col("y.n")).otherwise(F.col("x.n")).alias("n_b")).distinct()
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stored(rest.join(tried, ["a", "b"], "left_anti"))
    bound = rest.count()
    if bound:
        found = components(links.union(stored(_overlaps(likely(rest), docs, n, percent, fragments), bound)))

    # the smallest doc_id of each component, by way of its classes; one that nothing links is its own
    # component, and a component's label is dealt out by salt, as many classes may have it
    classes = seen.filter("id is not null").groupBy("id").agg(F.min("doc_id").alias("least")).join(found, "id", "left")
    joined = classes.filter("label is not null").withColumn("salt", F.pmod("id", F.lit(SALTS)))
    least = joined.groupBy("label").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    final = joined.join(least.hint("merge"), ["label", "salt"]).select("id", "component_id").union(classes.filter("label is null").select("id", "least"))
    return seen.join(final, "id", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("id").alias("set_id"), F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs (doc_id, text, any other columns) that stand for their component: of each, one row of the smallest doc_id.

    A null doc_id comes after all others; of different texts under one doc_id the least hash
    stands first. Texts that nothing links all stay, whatever their doc_id, and so do texts
    without words, which are linked with nothing. An empty table gives an empty result. Raises
    ValueError for a column by the name of _first, _tie or _own; others may have any name.
    """
    reserve(docs, "_first", "_tie", "_own")
    worded = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    # a doc_id may be null or have several texts: (doc_id, hash of the text) tells them apart and orders them
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"))
    first = join(docs.select(key.alias("doc_id"), "text"), n, percent).filter("set_id is not null and doc_id = component_id").select(F.col("doc_id.id").alias("_first"), F.col("doc_id.tie").alias("_tie")).distinct()
    kept = docs.filter(worded).withColumn("_own", F.xxhash64("text")).join(first, F.col("doc_id").eqNullSafe(F.col("_first")) & (F.col("_own") == F.col("_tie")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_own"]).drop("_own").unionByName(docs.filter(~worded))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


OP3_SQL = """
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM texts WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY 1
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= 90 * (s.n + t.n - c)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY 1) m ON m.a = d.doc_id
"""
