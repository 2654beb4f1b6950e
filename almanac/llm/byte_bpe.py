"""Op 2, byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves pre-tokens that are whole tokens.
Tier two: the others start as linked bytes; a heap of neighbouring pairs by rank merges the
lowest rank, leftmost first, and relinks, until no pair has a rank.

Each batch resolves its distinct pre-tokens once; a worker keeps a bounded number of results.
Nothing is shuffled: encoding is a map over documents.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, mix

KEPT = 400_000  # pre-tokens that a worker remembers; it forgets all when it has more


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file; a token's id is its rank, its place in the list."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


class MinimalPerfectHash:
    """Hash and displace: n distinct keys to n places, none left empty.

    Keys fall into about n / 4 buckets by one part of a 128-bit hash. Largest buckets first, a
    displacement d is sought that puts a bucket's keys on places still free: a hash of f and d,
    modulo n. Buckets of one key take what places remain directly.
    """

    def __init__(self, keys: list[bytes], seed: int = 1):
        n = self.n = len(keys)
        self.seed, self.buckets = seed, max(1, n // 4)
        b, f = self._parts(keys)
        order = np.argsort(b, kind="stable")
        bounds = np.searchsorted(b[order], np.arange(self.buckets + 1))
        sizes = np.diff(bounds)
        self.shift = np.zeros(self.buckets, np.int64)  # below zero: a place, as -1 - place
        places, free = np.full(n, -1, np.int64), np.ones(n, bool)
        for k in np.argsort(-sizes, kind="stable"):
            own = order[bounds[k] : bounds[k + 1]]
            if len(own) <= 1:
                break
            start, step = 0, 64
            while True:
                at = self._place(f[own], np.arange(start, start + step)[:, None])
                good = free[at].all(axis=1)
                s = np.sort(at, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if good.any():
                    d = int(np.argmax(good))
                    self.shift[k], places[own] = start + d, at[d]
                    free[at[d]] = False
                    break
                start, step = start + step, 4096
                if start > 1 << 24:
                    raise ValueError("no displacement was found; use another seed")
        left = np.flatnonzero(free)
        single = np.flatnonzero(sizes == 1)
        places[order[bounds[single]]] = left
        self.shift[single] = -1 - left
        self.places = places

    def _parts(self, keys: list[bytes]):
        h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(k, self.seed) for k in keys]), ">u8").astype(np.uint64).reshape(-1, 2)
        return (h[:, 0] % np.uint64(self.buckets)).astype(np.int64), h[:, 1]

    def _place(self, f: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (mix(f + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def __call__(self, keys: list[bytes]) -> np.ndarray:
        """A place for each key; a key that is not in the set gets one too, so compare."""
        if not keys or not self.n:
            return np.zeros(len(keys), np.int64)
        b, f = self._parts(keys)
        d = self.shift[b]
        return np.where(d < 0, -1 - d, self._place(f, np.maximum(d, 0)))


class ByteBpe:
    """Encodes and decodes text; ids are ranks of a rank file."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, regex.compile(pattern)
        keys = [t for t in tokens if t]
        ids = [k for k, t in enumerate(tokens) if t]
        self.hash = MinimalPerfectHash(keys)
        self.at_keys, self.at_ids = [b""] * len(keys), np.zeros(len(keys), np.int64)
        for place, key, k in zip(self.hash.places.tolist(), keys, ids, strict=True):
            self.at_keys[place], self.at_ids[place] = key, k
        rank = dict(zip(keys, ids, strict=True))
        self.byte = [rank[bytes([b])] for b in range(256)]
        #: the merged id of two ids, for every split of every token; ids take 20 bits
        self.pairs = {}
        for key, k in rank.items():
            for cut in range(1, len(key)):
                a, b = rank.get(key[:cut]), rank.get(key[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = k
        self.known: dict[str, bytes] = {}
        self.values = pa.array(tokens, pa.binary())

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token that is no token: a heap of pairs over linked bytes."""
        n, pairs = len(word), self.pairs
        ids = [self.byte[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for k in range(n - 1):
            rank = pairs.get(ids[k] << 20 | ids[k + 1])
            if rank is not None:
                heap.append(rank << 40 | k)
        heapify(heap)
        mask = (1 << 40) - 1
        while heap:
            top = heappop(heap)
            k, rank = top & mask, top >> 40
            nxt = after[k]
            if ids[k] < 0 or nxt >= n or pairs.get(ids[k] << 20 | ids[nxt]) != rank:
                continue  # a neighbour has changed since
            ids[k], ids[nxt] = rank, -1
            nxt = after[k] = after[nxt]
            if nxt < n:
                before[nxt] = k
                r = pairs.get(rank << 20 | ids[nxt])
                if r is not None:
                    heappush(heap, r << 40 | k)
            prev = before[k]
            if prev >= 0:
                r = pairs.get(ids[prev] << 20 | rank)
                if r is not None:
                    heappush(heap, r << 40 | prev)
        return [x for x in ids if x >= 0]

    def learn(self, texts: set[str]) -> None:
        """Resolves pre-tokens, by the perfect hash or else by merging."""
        texts = list(texts)
        raw = [t.encode() for t in texts]
        known = self.known
        for text, word, place in zip(texts, raw, self.hash(raw).tolist(), strict=True):
            if self.at_keys[place] == word:
                known[text] = int(self.at_ids[place]).to_bytes(4, "little")
            else:
                known[text] = np.array(self.merge(word), "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > KEPT:
            self.known.clear()
        parts = [self.pattern.findall(t) for t in texts]
        new = set().union(*parts).difference(self.known)
        if new:
            self.learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each text."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        got = self.values.take(pa.array(flat.astype(np.int64)))
        ends = np.frombuffer(got.buffers()[1], np.int32)[: len(flat) + 1]
        data = memoryview(got.buffers()[2] or b"")
        at = ends[np.cumsum([0, *(len(x) // 4 for x in ids)])].tolist() if len(flat) else [0] * (len(ids) + 1)
        return [bytes(data[a:b]) for a, b in zip(at, at[1:], strict=False)]


_MADE: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """A worker makes one coder for each vocabulary."""
    if (path, pattern) not in _MADE:
        _MADE[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _MADE[path, pattern]


def encode(docs: DataFrame, vocabulary: str, pattern: str, step: int = 1 << 20) -> DataFrame:
    """Encodes each text of docs (doc_id, text) and decodes the ids again.

    Returns doc_id, ids (binary, little-endian unsigned 32-bit integers), n_tokens and decoded
    (binary). A null text counts as empty: no ids. Rows keep their number; repeated rows are
    encoded each. ``vocabulary`` must be readable where executors run. Texts are taken in turns
    of about ``step`` characters; one longer text is a turn of its own. Other columns are
    ignored.
    """

    def run(batches):
        bpe = coder(vocabulary, pattern)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= step):
                    size += len(texts[hi])
                    hi += 1
                ids = bpe.encode(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(bpe.decode(ids), pa.binary())], ["doc_id", "ids", "n_tokens", "decoded"])
                lo = hi

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, ids binary, n_tokens long, decoded binary")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
