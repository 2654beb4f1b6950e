"""Op 1, LM scoring: marginal probability of a text over all segmentations of a subword lattice.

The pieces are those of an existing byte-level vocabulary file; their unigram scores are
learned from the training documents by expectation maximisation over the same lattice. A
text's probability sums over every segmentation into pieces, by a forward recursion in log
space, times the probability of the end.

No piece of the vocabulary holds white space after another character (checked when it is
loaded), so every lattice splits exactly at the start of each white-space run: a text's
probability is the product over its chunks (white space and the word after it). Equal chunks
have equal probability, so each is scored once:

1. documents are dealt into blocks by hash; each block lists its distinct chunks;
2. the lists meet by shards of the word hash, where chunks and training counts are merged;
3. expectation maximisation and the final forward recursion run over distinct chunks;
4. each block gets back a count and a score for each of its chunks and sums them by document.

Blocks and shards follow the bytes of the input, so what one task holds does not grow with it; a
task has one block or one shard. The vocabulary (at most some 50,000 scores) is all that is sent
everywhere; word counts grow with the corpus and stay in shards. Lists, the learning rounds and
their sums run when a score is asked for, before the result does.
"""

from __future__ import annotations

import base64
import math
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _IS_SPACE, SPACES, blocks_of, documents, id_remainder, lean, lowered, pack, slices, span_hashes, stored, unpack, words

LONGEST = 48  # bytes of a chunk that the recursions over matrices take; longer ones run along an automaton


def read_pieces(path: str) -> list[bytes]:
    """The byte pieces of a rank file in order of rank, without upper-case A to Z, which lower-cased text never holds."""
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    pieces = [p for p in pieces if p == p.lower()]
    for p in pieces:
        if any(a not in SPACES and b in SPACES for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece holds white space after another character; chunks would not be exact")
    have = set(pieces)
    return pieces + [bytes([b]) for b in range(256) if bytes([b]) not in have and not 65 <= b <= 90]


class Lattice:
    """Forward and backward recursions over chunks; ``scores`` are natural log probabilities of pieces."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray):
        self.pieces, self.scores = pieces, np.asarray(scores, np.float64)
        self.sizes = np.array([len(p) for p in pieces])
        self.score_list, self.size_list, self.longest = self.scores.tolist(), self.sizes.tolist(), int(self.sizes.max())
        self.automata: dict[bool, ahocorasick.Automaton] = {}
        blob = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        keys = span_hashes(blob, np.concatenate([[0], ends[:-1]]), ends)
        self.bits = 20
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids = keys[order], order.astype(np.int32)
        #: where each range of leading bits starts among the sorted keys; runs are short
        starts = np.searchsorted(self.keys >> np.uint64(64 - self.bits), np.arange(1 << self.bits).astype(np.uint64))
        self.first = starts.astype(np.int32)
        self.run = int(np.bincount((self.keys >> np.uint64(64 - self.bits)).astype(np.int64)).max())
        self.keys = np.concatenate([self.keys, np.zeros(self.run, np.uint64)])
        self.ids = np.concatenate([self.ids, np.full(self.run, -1, np.int32)])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers of span hashes, -1 where there is none."""
        at = self.first[(keys >> np.uint64(64 - self.bits)).astype(np.int64)]
        out = np.full(len(keys), -1, np.int32)
        for k in range(self.run):
            hit = self.keys[at + k] == keys
            out[hit] = self.ids[at[hit] + k]
        return out

    def _edges(self, rows: np.ndarray):
        """For equally long chunks (a byte matrix): piece numbers by (start, end)."""
        n, length = rows.shape
        flat, base = np.ascontiguousarray(rows).reshape(-1), np.arange(n) * length
        s, e = np.array([(s, e) for e in range(1, length + 1) for s in range(max(0, e - self.longest), e)], np.int64).T
        keys = span_hashes(flat, (base[:, None] + s).reshape(-1), (base[:, None] + e).reshape(-1))
        return s, e, self.find(keys).reshape(n, len(s))

    def _matrices(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        lengths = ends - starts
        for length in np.unique(lengths):
            if 0 < length <= LONGEST:
                of = np.flatnonzero(lengths == length)
                step = max(1, 400_000 // (int(length) * min(int(length), self.longest)))
                for k in range(0, len(of), step):
                    some = of[k : k + step]
                    yield some, data[starts[some][:, None] + np.arange(length)]

    @staticmethod
    def _sum(terms: np.ndarray) -> np.ndarray:
        top = terms.max(axis=1)
        safe = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore"):
            return np.log(np.exp(terms - safe[:, None]).sum(axis=1)) + safe

    def _forward(self, s, e, logs, length):
        alpha = np.full((len(logs), length + 1), -np.inf)
        alpha[:, 0] = 0
        for k in range(1, length + 1):
            into = np.flatnonzero(e == k)
            alpha[:, k] = self._sum(alpha[:, s[into]] + logs[:, into])
        return alpha

    def _automaton(self, back: bool):
        """Finds the pieces (or, for the way back, the reversed pieces) that end at each place of a chunk in one walk."""
        if back not in self.automata:
            made = self.automata[back] = ahocorasick.Automaton()
            for k, p in enumerate(self.pieces):
                made.add_word((p[::-1] if back else p).decode("latin-1"), k)
            made.make_automaton()
        return self.automata[back]

    def _along(self, chunk: bytes, back: bool = False) -> np.ndarray:
        """The recursion over one long chunk, for each place: forward, or backward from the end."""
        scores, size, out, terms, at = self.score_list, self.size_list, [0.0], [], 0
        for end, k in self._automaton(back).iter((chunk[::-1] if back else chunk).decode("latin-1")):
            if end > at:
                top = max(terms)
                out.append(top + math.log(sum(math.exp(t - top) for t in terms)))
                terms, at = [], end
            terms.append(out[end + 1 - size[k]] + scores[k])
        top = max(terms)
        out.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        return np.array(out[::-1] if back else out)

    def _alone(self, chunk: bytes) -> float:
        return float(self._along(chunk)[-1])

    def _count_alone(self, chunk: bytes, weight: float, total: np.ndarray) -> None:
        """Adds the expected counts of one long chunk to total, some of its edges at a time."""
        alpha, beta = self._along(chunk), self._along(chunk, back=True)
        edges = self._automaton(False).iter(chunk.decode("latin-1"))
        while some := list(islice(edges, 1 << 20)):
            end, k = np.array(some, np.int64).T
            total += np.bincount(k, weight * np.exp(alpha[end + 1 - self.sizes[k]] + self.scores[k] + beta[end + 1] - alpha[-1]), len(total))

    def log_probability(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural log of the summed probability of each chunk's segmentations."""
        out = np.zeros(len(starts))
        table = np.append(self.scores, -np.inf)
        for some, rows in self._matrices(data, starts, ends):
            s, e, ids = self._edges(rows)
            out[some] = self._forward(s, e, table[ids], rows.shape[1])[:, -1]
        for k in np.flatnonzero(ends - starts > LONGEST):
            out[k] = self._alone(data[starts[k] : ends[k]].tobytes())
        return out

    def expected_counts(self, data, starts, ends, weights) -> np.ndarray:
        """How often each piece is expected in the chunks' segmentations, by forward and backward sums."""
        total = np.zeros(len(self.pieces))
        table = np.append(self.scores, -np.inf)
        for some, rows in self._matrices(data, starts, ends):
            length = rows.shape[1]
            s, e, ids = self._edges(rows)
            logs = table[ids]
            alpha = self._forward(s, e, logs, length)
            beta = np.full((len(rows), length + 1), -np.inf)
            beta[:, length] = 0
            for k in range(length - 1, -1, -1):
                out = np.flatnonzero(s == k)
                beta[:, k] = self._sum(beta[:, e[out]] + logs[:, out])
            share = np.exp(alpha[:, s] + logs + beta[:, e] - alpha[:, -1:]) * weights[some][:, None]
            hit = ids >= 0
            total += np.bincount(ids[hit], share[hit], len(total))
        for k in np.flatnonzero(ends - starts > LONGEST):
            self._count_alone(data[starts[k] : ends[k]].tobytes(), weights[k], total)
        return total


def _chunks(data: np.ndarray, offsets: np.ndarray):
    """Chunks of lower-cased rows: (start, end, word start, row); white space after the last word is a chunk without a word."""
    ws, we, row = words(data, offsets)
    first = np.ones(len(ws), bool)
    first[1:] = row[1:] != row[:-1]
    starts = np.where(first, offsets[row], np.concatenate([[0], we[:-1]]) if len(we) else 0)
    last = offsets[:-1].copy()
    last[row] = we  # ascending, so each row keeps its last word's end
    tail = np.flatnonzero(last < offsets[1:])
    return np.concatenate([starts, last[tail]]), np.concatenate([we, offsets[1:][tail]]), np.concatenate([ws, offsets[1:][tail]]), np.concatenate([row, tail])


def _block_chunks(texts):
    """The distinct chunks of a block in order of (shard key, chunk hash): for each run of rows its chunks' hashes, and the bytes of each distinct one."""
    runs, seen_h, seen_b = [], [], []
    for lo, hi, data, offsets in slices(texts):
        data = lowered(data)
        s, e, w, row = _chunks(data, offsets)
        h = span_hashes(data, s, e)
        u, at = np.unique(h, return_index=True)
        seen_h.append(u)
        key = np.where(w[at] < e[at], span_hashes(data, w[at], e[at]), 0)
        raw = data.tobytes()
        seen_b.append((key, [raw[a:b] for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)]))
        runs.append((lo, hi, h, row, w < e))
    if not runs:
        return [], np.zeros(0, np.uint64), np.zeros(0, np.uint64), []
    h, at = np.unique(np.concatenate(seen_h), return_index=True)
    key, flat = np.concatenate([k for k, _ in seen_b])[at], [b for _, bs in seen_b for b in bs]
    return runs, h, key, [flat[k] for k in at.tolist()]


LISTS = "shard int, block int, chunks binary, ends binary, counts binary"
SHARDS = "shard int, chunks binary, ends binary, counts binary, word_counts binary, blocks binary, sizes binary, uses binary, n_tokens long, n_words long"
ANSWERS = "block int, shard int, word_counts binary, scores binary"


def _list_block(shards: int):
    def run(table: pa.Table) -> pa.Table:
        runs, h, key, chunks = _block_chunks(table["text"])
        train = table["train"].to_numpy().astype(bool)
        counts = np.zeros(len(h), np.uint64)
        for lo, _, hashes, row, _ in runs:
            mine = hashes[train[lo + row]]
            counts += np.bincount(np.searchsorted(h, mine), minlength=len(h)).astype(np.uint64)
        shard = (key % np.uint64(shards)).astype(np.int64)
        rows = []
        for k in np.unique(shard):
            at = np.flatnonzero(shard == k)
            some = [chunks[i] for i in at.tolist()]
            rows.append((k, table["block"][0].as_py(), b"".join(some), pack(np.cumsum([len(c) for c in some]).astype(np.int64)), pack(counts[at])))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["shard", "block", "chunks", "ends", "counts"])

    return run


def _merge_shard(table: pa.Table) -> pa.Table:
    """Merges the lists of a shard: distinct chunks, counts of chunks and of their words, and each block's chunks as places in the list."""
    lists = [(np.frombuffer(c, np.uint8), unpack(e, np.int64)) for c, e in zip(table["chunks"].to_pylist(), table["ends"].to_pylist(), strict=True)]
    data = np.concatenate([d for d, _ in lists])
    shift = np.cumsum([0, *(len(d) for d, _ in lists)])
    ends = np.concatenate([e + k for (_, e), k in zip(lists, shift, strict=False)])
    starts = np.concatenate([[0], ends[:-1]])
    h = span_hashes(data, starts, ends)
    _, at, use = np.unique(h, return_index=True, return_inverse=True)
    counts = np.zeros(len(at), np.uint64)
    np.add.at(counts, use, np.concatenate([unpack(c, np.uint64) for c in table["counts"].to_pylist()]))
    s, e = starts[at], ends[at]
    # the word of a chunk begins after its leading white space
    solid = np.append(np.flatnonzero(~_IS_SPACE[data]), len(data))
    w = np.minimum(solid[np.searchsorted(solid, s)], e)
    word, of = np.unique(np.where(w < e, span_hashes(data, w, e), 0), return_inverse=True)
    word_counts = np.zeros(len(word), np.uint64)
    np.add.at(word_counts, of, np.where(w < e, counts, 0).astype(np.uint64))
    raw = data.tobytes()
    chunks = [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]
    sizes = np.array([len(x) for _, x in lists], np.int64)
    row = (table["shard"][0].as_py(), b"".join(chunks), pack(np.cumsum([len(c) for c in chunks]).astype(np.int64)), pack(counts), pack(word_counts[of]), pack(np.array(table["block"].to_pylist(), np.int64)), pack(sizes), pack(use.astype(np.uint32)), int(word_counts.sum()), int((word_counts > 0).sum()))
    return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int32(), *[pa.binary()] * 7, pa.int64(), pa.int64()], strict=True)], [x.split()[0] for x in SHARDS.split(", ")])


def _spans(ends: bytes):
    ends = unpack(ends, np.int64)
    return np.concatenate([[0], ends[:-1]]), ends


def learn_scores(shards: DataFrame, pieces: list[bytes], ends: int, rounds: int) -> tuple[np.ndarray, float]:
    """Piece scores by expectation maximisation from scores by rank; and the end's score. Natural logs."""
    spark = shards.sparkSession
    guess = 1 / (np.arange(len(pieces)) + 50.0)
    scores, end = np.log(guess / guess.sum() * 0.99), math.log(0.01)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, scores))

        def expect(batches, sent=sent):
            lattice, total = Lattice(*sent.value), np.zeros(len(sent.value[0]))
            for batch in batches:
                for c, e, n in zip(batch["chunks"].to_pylist(), batch["ends"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                    (s, e), n = _spans(e), unpack(n, np.uint64)
                    some = np.flatnonzero(n)
                    total += lattice.expected_counts(np.frombuffer(c, np.uint8), s[some], e[some], n[some].astype(np.float64))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["piece", "n"])

        counts = np.zeros(len(pieces))
        for r in shards.select("chunks", "ends", "counts").mapInArrow(lean(expect), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():  # a row for each piece at most
            counts[r["piece"]] = r["n"]
        counts += 0.1
        total = counts.sum() + ends + 0.5
        scores, end = np.log(counts / total), math.log((ends + 0.5) / total)
        sent.unpersist()
    return scores, end


def score(docs: DataFrame, train, vocabulary: str, rounds: int = 3) -> DataFrame:
    """Scores every text of docs (doc_id, text); ``train`` is a Boolean column that marks rows to learn from.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score and score (log10). A null text
    counts as empty: it has the end alone. Repeated rows are scored each, and teach each. Without
    training rows, scores come from the ranks of the vocabulary and base_score is 0. An empty
    table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = read_pieces(vocabulary)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    seen = rows.agg(F.sum(F.octet_length("text")).alias("size"), F.count_if("train").alias("ends")).first()
    n, ends = blocks_of(spark, seen["size"]), seen["ends"]
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    lists = rows.select("text", "train", "block").repartitionById(n, "block").groupBy("block").applyInArrow(_list_block(n), LISTS)
    shards = stored(lists.repartitionById(n, "shard").groupBy("shard").applyInArrow(_merge_shard, SHARDS))
    seen = shards.agg(F.sum("n_tokens"), F.sum("n_words")).first()
    tokens, distinct = (seen[0] or 0) + ends, (seen[1] or 0) + (ends > 0)
    scores, end = learn_scores(shards, pieces, ends, rounds if ends else 0)
    sent = spark.sparkContext.broadcast((pieces, scores))

    def answer(batches):
        lattice = Lattice(*sent.value)
        for batch in batches:
            for r in batch.to_pylist():
                s, e = _spans(r["ends"])
                got = lattice.log_probability(np.frombuffer(r["chunks"], np.uint8), s, e).astype(np.float32)
                counts, use, at = unpack(r["word_counts"], np.uint64), unpack(r["uses"], np.uint32), 0
                rows = []
                for block, size in zip(unpack(r["blocks"], np.int64).tolist(), unpack(r["sizes"], np.int64).tolist(), strict=True):
                    mine = use[at : at + size]
                    rows.append((block, r["shard"], pack(counts[mine]), got[mine].tobytes()))
                    at += size
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "shard", "word_counts", "scores"])

    answers = shards.select("shard", "chunks", "ends", "word_counts", "blocks", "sizes", "uses").mapInArrow(lean(answer), ANSWERS)
    whole = tokens + 0.5 * (distinct + 1)

    def finish(table: pa.Table, got: pa.Table) -> pa.Table:
        runs, h, key, _ = _block_chunks(table["text"])
        counts, logs = np.zeros(len(h), np.uint64), np.zeros(len(h))
        shard = (key % np.uint64(n)).astype(np.int64)
        for k, c, x in zip(got["shard"].to_pylist(), got["word_counts"].to_pylist(), got["scores"].to_pylist(), strict=True):
            at = np.flatnonzero(shard == k)
            counts[at], logs[at] = unpack(c, np.uint64), np.frombuffer(x, np.float32)
        m = len(table)
        n_tokens, n_known = np.ones(m, np.int64), np.full(m, int(ends > 0), np.int64)
        base, scored = np.full(m, math.log10((ends + 0.5) / whole)), np.full(m, end)
        logs10 = np.log10((counts + 0.5) / whole)
        for lo, hi, hashes, row, solid in runs:
            at = np.searchsorted(h, hashes)
            scored[lo:hi] += np.bincount(row, logs[at], hi - lo)
            at, row = at[solid], row[solid]
            n_tokens[lo:hi] += np.bincount(row, minlength=hi - lo)
            n_known[lo:hi] += np.bincount(row[counts[at] > 0], minlength=hi - lo)
            base[lo:hi] += np.bincount(row, logs10[at], hi - lo)
        return pa.Table.from_arrays([table["doc_id"], pa.array(n_tokens), pa.array(n_known), pa.array(np.full(m, tokens, np.int64)), pa.array(base), pa.array(scored / math.log(10))], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts, answers = rows.select("doc_id", "text", "block").repartitionById(n, "block"), answers.repartitionById(n, "block")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = score(documents(spark, sf_dir), id_remainder("doc_id", 5) != 1, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return out.select("doc_id", (id_remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
