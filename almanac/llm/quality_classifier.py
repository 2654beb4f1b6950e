"""Op 9, quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of texts are found in numpy over runs of many texts at once. Trees grow on a bounded
sample of labelled rows: values are put in quantile bins, and splits come from sums of gradients
by bin. Each tree is a full binary tree in flat arrays (feature, bound, leaf value), so scoring
goes down one level of all trees for all rows in each numpy step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, id_remainder, lowered, mix, slices, span_hashes, stored, words

SAMPLE = 20_000  # labelled rows to learn from, at most; those of the least hash of their id
FEATURES = [
    "log_words", "bytes_per_word", "symbols_per_word", "marks_per_word", "shouts_per_word", "capitals", "digits", "wide_bytes",
    "capital_words", "lines_per_word", "repeated_lines", "distinct_words", "top_word", "repeated_triples", "longest_word", "bars_per_word",
]


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOLS, _MARKS, _DIGITS, _UPPER = _class(b"#*$%&<>@^~_=+\\{}[]"), _class(b".,;:?"), _class(b"0123456789"), _class(bytes(range(65, 91)))


def _runs(key: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row: how many distinct keys it has, and how often its most frequent one occurs."""
    order = np.lexsort((key, row))
    k, r = key[order], row[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    starts = np.flatnonzero(first)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, r[starts], np.diff(np.append(starts, len(k))))
    return np.bincount(r[starts], minlength=n), top


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text (float32); a null text counts as empty, an empty one has zeros."""
    out = np.zeros((len(texts), len(FEATURES)), np.float32)
    for lo, hi, data, offsets in slices(texts):
        n = hi - lo
        s, e, row = words(data, offsets)
        count = np.bincount(row, minlength=n)
        per_word, size = np.maximum(count, 1), np.maximum(np.diff(offsets), 1)

        def by_row(mask, offsets=offsets):
            total = np.concatenate([[0], np.cumsum(mask)])
            return total[offsets[1:]] - total[offsets[:-1]]

        latin = np.zeros(len(data), bool)
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        upper = _UPPER[data] | latin
        upper_from = upper.copy()
        upper_from[:-1] |= latin[1:]
        length = e - s
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, row, length)
        h = span_hashes(lowered(data), s, e)
        distinct, top = _runs(h, row, n)
        triple = row[2:] == row[:-2]
        t = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:])[triple] if len(h) > 2 else h[:0]
        t_row = row[2:][triple]
        t_distinct, _ = _runs(t, t_row, n)
        triples = np.bincount(t_row, minlength=n)
        # lines that hold a word: from a word's line start to the next line end
        ends = np.flatnonzero(data == 10)
        line_of = np.searchsorted(ends, s) + np.searchsorted(offsets, s, "right")  # differs between lines and between rows
        begin = np.ones(len(s), bool)
        begin[1:] = line_of[1:] != line_of[:-1]
        at = np.flatnonzero(begin)
        last = np.append(at[1:], len(s)) - 1 if len(at) else at
        l_row = row[at]
        lines = np.bincount(l_row, minlength=n)
        l_distinct, _ = _runs(span_hashes(data, s[at], e[last]), l_row, n)
        columns = [
            np.log1p(count), np.bincount(row, length, n) / per_word, by_row(_SYMBOLS[data]) / per_word, by_row(_MARKS[data]) / per_word,
            by_row(data == 33) / per_word, by_row(upper) / size, by_row(_DIGITS[data]) / size, by_row(data >= 128) / size,
            np.bincount(row, upper_from[s], n) / per_word, lines / per_word, (lines - l_distinct) / np.maximum(lines, 1), distinct / per_word,
            top / per_word, (triples - t_distinct) / np.maximum(triples, 1), np.log1p(longest), by_row(data == 124) / per_word,
        ]
        out[lo:hi] = np.stack(columns, axis=1)
    return out


@dataclass
class Trees:
    """Full binary trees in flat arrays: node k has children 2k + 1 and 2k + 2."""

    feature: np.ndarray  # trees x inner nodes
    bound: np.ndarray  # go right where the value is larger
    value: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        total = np.full(len(x), self.start)
        trees, inner = self.feature.shape if self.feature.size else (0, 0)
        if trees:
            base, depth = np.arange(trees) * inner, int(np.log2(inner + 1))
            flat_f, flat_b, flat_v = self.feature.ravel(), self.bound.ravel(), self.value.ravel()
            leaf_base = np.arange(trees) * (inner + 1)
            for lo in range(0, len(x), 4096):
                rows = x[lo : lo + 4096]
                at, own = np.zeros((len(rows), trees), np.int64), np.arange(len(rows))[:, None]
                for _ in range(depth):
                    node = base + at
                    at = 2 * at + 1 + (rows[own, flat_f[node]] > flat_b[node])
                total[lo : lo + 4096] += flat_v[leaf_base + at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 10) -> Trees:
    """Boosts trees on logistic loss. Without rows, or with one label alone, there are no trees and the score is the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    start, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)), start)
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins, method="lower").astype(np.float32)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)  # bin <= k: value <= cuts[k]
    score, made = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, bound = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            local = at - first
            best, choice = np.full(nodes, 1e-6), [None] * nodes
            gn, hn = np.bincount(local, g, nodes), np.bincount(local, h, nodes)
            whole = gn**2 / (hn + l2)
            for f, c in enumerate(cuts):
                width = len(c) + 1
                cell = local * width + binned[:, f]
                gl, hl, nl = (np.cumsum(np.bincount(cell, w, nodes * width).reshape(nodes, width), axis=1)[:, :-1] for w in (g, h, None))
                if not gl.size:
                    continue
                total = np.bincount(local, minlength=nodes)[:, None]
                gain = gl**2 / (hl + l2) + (gn[:, None] - gl) ** 2 / (hn[:, None] - hl + l2) - whole[:, None]
                gain[(nl < least) | (total - nl < least)] = -1
                k = gain.argmax(axis=1)
                top = gain[np.arange(nodes), k]
                for node in np.flatnonzero(top > best):
                    best[node], choice[node] = top[node], (f, c[k[node]])
            for node, chosen in enumerate(choice):
                if chosen:
                    feature[first + node], bound[first + node] = chosen
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > bound[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        score += value[leaf]
        made.append((feature, bound, value))
    return Trees(*(np.stack(a) for a in zip(*made, strict=True)), start)


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text of docs (doc_id, text), as one array of floats."""

    def run(batches):
        for batch in batches:
            x = statistics(batch["text"])
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], flat], ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, x array<float>")


def classify(docs: DataFrame, labels: DataFrame, learn, sample: int = SAMPLE, bar: float = 0.7) -> DataFrame:
    """Scores every text of docs (doc_id, text) by trees learned from labels (doc_id, quality 0 or 1).

    ``learn`` is a Boolean column over doc_id: which rows may teach. At most ``sample`` rows teach,
    those of the least hash of their doc_id. Returns doc_id, score and predicted (1 from ``bar``
    on). Null labels teach nothing; null texts count as empty and are scored too; repeated rows
    are scored each. Without labels of both kinds every score is the share of label 1. Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = stored(features(docs))
    known = labels.filter(F.col("quality").isNotNull()).select(F.col("doc_id").alias("_id"), "quality")
    taught = rows.filter(F.coalesce(learn, F.lit(False))).join(known, F.col("doc_id") == F.col("_id"))
    # a range of hashes that holds somewhat fewer than the bound; only these rows are ordered and sent
    share = min(1.0, 0.95 * sample / max(1, taught.count()))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1).cast("double") / F.lit(2.0**63)
    taught = taught if share == 1.0 else taught.filter(place < share)
    taught = taught.orderBy(F.xxhash64("doc_id"), "doc_id", "x", "quality").limit(sample).select("x", "quality").toPandas()
    x = np.array(taught["x"].tolist(), np.float32).reshape(-1, len(FEATURES))
    sent = docs.sparkSession.sparkContext.broadcast(fit(x, taught["quality"].to_numpy().astype(np.float64)))

    def run(batches):
        for batch in batches:
            x = batch["x"]
            got = sent.value.score(x.flatten().to_numpy().reshape(len(x), -1)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(got), pa.array((got >= bar).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, score double, predicted int")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = id_remainder("doc_id", 4) == 2
    out = classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
