"""Op 7, best-fit packing into bins with several capacities.

A bin (sequence) has a residual vector: tokens, documents and attention cost (the sum of squared
piece lengths). A piece may go where every residual allows it; among those bins it takes the one
of the largest weighted dot product of demand and residual, or of the least weighted norm of what
would be left. Pieces go longest first.

A demand follows from a piece's length alone, so pieces of one length are alike, and so are bins
with one residual. The plan is made from the number of pieces of each length (one count for each
possible length, however many documents): runs of equal pieces go to ranges of equal bins. Every
piece then finds its bin from its rank among those of its length. Ranks come from counts by
length and salt, so neither a frequent length nor the whole table meets in one task.
"""

from __future__ import annotations

import base64
import zlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, lean, partitions, stored

RULES = ("norm", "dot")
#: Runs of white space that are encoded apart; ids don't depend on the least length, only the time does.
_BLANKS = regex.compile(r"\p{White_Space}{64,}")


def plan(lengths: np.ndarray, tokens: int, documents_: int, cost: int, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> np.ndarray:
    """Packs lengths[k] pieces of each length k: rows (length, first rank, first bin, number, offset, place) by length and rank.

    ``place`` is how many pieces the bin held before. Capacities are of one bin; a piece alone
    must fit, else ValueError. Bins are numbered from 0 without gaps.
    """
    if rule not in RULES:
        raise ValueError(f"the rule is one of {RULES}")
    if len(lengths) > tokens + 1 and lengths[tokens + 1 :].any():
        raise ValueError("a piece is longer than a bin")
    full, w = np.array([tokens, documents_, cost], np.float64), np.array(weights)
    #: ranges of equal bins by residual: (tokens, documents, cost) -> [(first bin, number)]
    open_: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    states = np.zeros((0, 3), np.int64)
    bins, out = 0, []
    for length in range(len(lengths) - 1, 0, -1):
        left, rank = int(lengths[length]), 0
        if not left:
            continue
        if documents_ < 1 or length * length > cost:
            raise ValueError("a piece alone breaks a capacity")
        demand = np.array([length, 1, length * length], np.int64)
        states = np.array(list(open_), np.int64).reshape(-1, 3)
        able = states[(states >= demand).all(axis=1)]
        if rule == "norm":
            value = (w * ((able - demand) / full) ** 2).sum(axis=1)
        else:
            value = -(w * (demand / full) * (able / full)).sum(axis=1)
        heap = [(v, tuple(s)) for v, s in zip(value.tolist(), able.tolist(), strict=True)]
        heap.sort()
        while left:
            if heap:
                _, state = heappop(heap)
            else:
                state = (tokens, documents_, cost)
                fit = min(tokens // length, documents_, cost // (length * length))
                need = -(-left // fit)
                open_.setdefault(state, []).append((bins, need))
                bins += need
            ranges, kept = open_.pop(state), []
            after = (state[0] - length, state[1] - 1, state[2] - length * length)
            for at, m in ranges:
                k = min(m, left)
                if k:
                    out.append((length, rank, at, k, tokens - state[0], documents_ - state[1]))
                    if after[0]:
                        open_.setdefault(after, []).append((at, k))
                    rank, left = rank + k, left - k
                if k < m:
                    kept.append((at + k, m - k))
            if kept:
                open_[state] = kept
            if left and after[0] >= length and after[1] >= 1 and after[2] >= length * length:
                left_over = (np.array(after) - demand) / full if rule == "norm" else None
                v = float((w * left_over**2).sum()) if rule == "norm" else -float((w * (demand / full) * (np.array(after) / full)).sum())
                if all(s != after for _, s in heap):
                    heappush(heap, (v, after))
    return np.array(out, np.int64).reshape(-1, 6)


_CODERS: dict[tuple[str, str | None], object] = {}


def encode_by_ranks(fast, text: str) -> list[int]:
    """Ids of a text by a rank-file encoding whose pattern takes white space by ``\\s+(?!\\S)|\\s+`` last.

    Its matcher runs out of stack on about a million characters of white space in a row. The
    pattern makes one pre-token of a run but for its last character, which begins what follows
    (at the text's end: of the whole run), so long runs are cut out by that rule; what lies
    between begins and ends where the pattern does too.
    """
    at, ids = 0, []
    for m in _BLANKS.finditer(text):
        last = m.end() - (m.end() < len(text))
        ids += fast.encode_ordinary(text[at : m.start()]) if m.start() > at else []
        ids += fast._core_bpe.encode_single_piece(text[m.start() : last].encode())
        at = last
    return ids + fast.encode_ordinary(text[at:]) if at else fast.encode_ordinary(text)


def coder(path: str, ranks: str | None):
    """Encodes a list of texts to lists of ids as the tokenizers library would.

    ``ranks`` is the same vocabulary as a rank file, which is faster to encode with; a text that
    holds a special token's string goes to the library itself.
    """
    from tokenizers import Tokenizer

    if (path, ranks) not in _CODERS:
        library = Tokenizer.from_file(path)
        special = [t.content for t in library.get_added_tokens_decoder().values()]
        if ranks is None:
            _CODERS[path, ranks] = lambda texts: [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        else:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            _CODERS[path, ranks] = lambda texts: [library.encode(t, add_special_tokens=False).ids if any(s in t for s in special) else encode_by_ranks(fast, t) for t in texts]
    return _CODERS[path, ranks]


def pieces(docs: DataFrame, vocabulary: str, tokens: int, end_id: int = 0, ranks: str | None = None) -> DataFrame:
    """Cuts the ids of each text of docs (doc_id, text), with end_id after them, into pieces of at most ``tokens``.

    Only a longer document is cut; its first piece takes what is over, the others are full.
    Returns doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit).
    """

    def run(batches):
        encode = coder(vocabulary, ranks)
        for batch in batches:
            texts, lo = [t or "" for t in batch["text"].to_pylist()], 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= 1 << 20):
                    size, hi = size + len(texts[hi]), hi + 1
                rows = []
                for k, ids in enumerate(encode(texts[lo:hi]), lo):
                    ids = np.array([*ids, end_id], "<u4")
                    first = (len(ids) - 1) % tokens + 1
                    at = [0, *range(first, len(ids) + 1, tokens)]
                    rows += [(k, j, a, b - a, ids[a:b].tobytes()) for j, (a, b) in enumerate(zip(at, at[1:], strict=False))]
                k, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(k)), *(pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True))], ["doc_id", "piece", "start", "length", "ids"])
                lo = hi

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, piece int, start long, length long, ids binary")


def pack(rows: DataFrame, tokens: int, documents_: int | None = None, cost: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> DataFrame:
    """Adds sequence_id, offset and place to pieces (doc_id, piece, start, length of 1 to tokens, crc).

    Capacities of a sequence: tokens, documents (default: as many as tokens, so never short) and
    attention cost (default: tokens squared, likewise). Equal rows are pieces of their own. An
    empty table gives an empty result. rows are read twice: store them before, so that both
    readings are alike.
    """
    documents_, cost = documents_ or tokens, cost or tokens * tokens
    n = partitions(rows.sparkSession)
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "crc"), F.lit(n)).cast("int"))
    counts = stored(rows.groupBy("length", "_salt").agg(F.count("*").alias("_n")))
    lengths = np.zeros(tokens + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # a row for each length of 1 to tokens
        lengths[r["length"]] = r["n"]
    steps = plan(lengths, tokens, documents_, cost, rule, weights)
    before = counts.select("length", "_salt", (F.sum("_n").over(W.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "crc"))
    ranked = rows.withColumn("_own", own - 1).join(before.hint("merge"), ["length", "_salt"]).withColumn("_rank", F.col("_own") + F.col("_before"))
    sent = rows.sparkSession.sparkContext.broadcast((np.searchsorted(steps[:, 0] * -1, -np.arange(tokens + 2), "left"), np.searchsorted(-steps[:, 0], -np.arange(tokens + 2), "right"), steps))
    ranked = ranked.drop("_salt", "_own", "_before")

    def find(batches):
        lo, hi, steps = sent.value
        top = int(steps[:, 1].max(initial=0)) + 1
        keys = -steps[:, 0] * (top + 1) + np.minimum(steps[:, 1], top)  # ascending, as steps are by length downwards and rank
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy().astype(np.int64)
            at = np.searchsorted(keys, -length * (top + 1) + np.minimum(rank, top), "right") - 1
            s = steps[at] if len(at) else np.zeros((0, 6), np.int64)
            kept = [k for k, c in enumerate(batch.schema.names) if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(s[:, 2] + rank - s[:, 1]), pa.array(s[:, 4]), pa.array(s[:, 5])], [*(batch.schema.names[k] for k in kept), "sequence_id", "offset", "place"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(lean(find), schema + ", sequence_id long, offset long, place long")


def pack_documents(docs: DataFrame, vocabulary: str, tokens: int = 2048, ranks: str | None = None, **capacities) -> DataFrame:
    """Packs all docs (doc_id, text): a row for each piece with doc_id, piece, start, length, ids_crc32, sequence_id, offset and place.

    A null text counts as empty: one piece, the end alone. Repeated rows are packed each. Other
    columns are ignored. A very long text gives many full pieces.
    """

    def checked(batches):
        for batch in batches:
            crc = pa.array([zlib.crc32(x) for x in batch["ids"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "piece", "start", "length")), crc], ["doc_id", "piece", "start", "length", "crc"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(pieces(docs, vocabulary, tokens, ranks=ranks).mapInArrow(lean(checked), f"doc_id {kind}, piece int, start long, length long, crc long"))
    return pack(rows, tokens, **capacities).select("doc_id", "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset", "place")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2048, public_tokenizers.path("byte_bpe_50k.tiktoken"))
