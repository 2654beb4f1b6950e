"""The pipeline against a brute-force version of its five stages."""

import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Fixed values of the rules: low values bad too, and the least spread.
RULES = {"symbols": (0, 0.02), "chars": (1, 0.25), "words": (0, 0.04), "lines": (0, 0.06), "capitals": (0, 0.01), "top": (0, 0.01)}


def ratios(text):
    w = WORD.findall(text)
    n = max(1, len(w))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    chars = sum(map(len, w))
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return failed, len(w), {"symbols": len(re.findall(r"[#*$%&|<>]", text)) / n, "chars": chars / n, "words": len(covered) / n, "lines": (len(lines) - len(set(lines))) / max(1, len(lines)), "capitals": sum(c.isupper() for c in text) / max(1, chars), "top": max(collections.Counter(w).values(), default=0) / n}


def quartile(values, q):
    buckets = sorted(-1000 if v < 1e-6 else math.ceil(math.log(v) / math.log(1.02)) for v in values)
    b = buckets[math.ceil(q * len(buckets)) - 1]
    return 0.0 if b <= -1000 else 2 * 1.02**b / 2.02


def quality(rows):
    stats = {k: ratios(t or "") for k, (t, _, _) in rows.items()}
    kept = {}
    for k, (text, lang, source) in rows.items():
        failed, n, own = stats[k]
        if failed:
            continue
        base = [s for s in stats.values() if not s[0]]
        same = [stats[j] for j, r in rows.items() if r[1] == lang and not stats[j][0]]
        group = [stats[j] for j, r in rows.items() if r[1:] == (lang, source) and not stats[j][0]]
        good = True
        for rule, (low, least) in RULES.items():
            q = []
            for at in (0.25, 0.75):
                all_, lang_, own_ = (quartile([s[2][rule] for s in x], at) for x in (base, same, group))
                above = (lang_ * len(same) + 20 * all_) / (len(same) + 20)
                q.append((own_ * len(group) + 20 * above) / (len(group) + 20))
            spread, slack = 6 * max(q[1] - q[0], least), 0.5 / math.sqrt(n)
            good &= own[rule] <= q[1] + spread + slack and (not low or own[rule] >= q[0] - spread - slack)
        if good:
            kept[k] = text
    return kept


def lines(rows):
    seen, out = set(), {}
    for k in sorted(rows):
        own, covered = rows[k].split("\n"), set()
        for i in range(len(own) - 2):
            w = tuple(own[i : i + 3])
            covered |= {i, i + 1, i + 2} if w in seen else set()
            seen.add(w)
        out[k] = "\n".join(x for i, x in enumerate(own) if i not in covered)
    return out


def one_of_each(rows):
    sets = {}
    for k, t in rows.items():
        w = WORD.findall(t.translate(LOW))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    holders, label = collections.defaultdict(list), {k: k for k in rows}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for k, s in sets.items():
        common = collections.Counter(j for g in s for j in holders[g])
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = root(j), root(k)
                label[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(k)
    return {k: t for k, t in rows.items() if root(k) == k}


def masked(text):
    chars = list(text)
    spans = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 8] + [m.span() for m in re.finditer("AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", text)]
    for a, b in spans:
        chars[a:b] = "*" * (b - a)
    return "".join(chars)


def test_pipeline_equals_brute_force(spark):
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: (r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    expected = {k: masked(t) for k, t in one_of_each(lines(quality(rows))).items()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got == expected and 0 < len(got) < len(rows)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = collections.defaultdict(list)
    load = collections.Counter()
    for r in corpus_pipeline.run(spark, sf).collect():
        packed[r["doc_id"]].append(r)
        load[r["sequence_id"]] += r["length"]
    assert set(packed) == set(expected) and max(load.values()) <= 2048
    for k, own in packed.items():
        ids = np.array([*library.encode(expected[k], add_special_tokens=False).ids, 0], "<u4")
        for r in own:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        assert sum(r["length"] for r in own) == len(ids)
    least = -(-sum(load.values()) // 2048)
    assert len(load) <= least + 1


def test_stages_take_odd_rows(spark):
    text = lambda k: " ".join(f"word{k}x{j}" for j in range(30))
    rows = [(1, text(1)), (1, text(2)), (None, text(3)), (None, text(1)), (2, None), (3, ""), (4, text(4) + "\n" + text(5) + "\npassword=abcdefgh1"), (4, text(4) + "\n" + text(5) + "\npassword=abcdefgh1"), (5, " \n "), (6, " ".join(f"word{k}" for k in range(60_000)))]
    docs = spark.createDataFrame([(d, t, "en", None, 7, k, 0) for k, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, id long, n long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, "unused"))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "id", "n"]
        kept[name] = sorted(r["id"] for r in docs.collect())
    assert kept["quality rules"] == kept["line dedup"] == [0, 1, 2, 3, 6, 7, 9]
    # the copy under a null id goes, as does one of two equal rows; both texts of document 1 stay
    assert kept["n-gram Jaccard join"] in ([0, 1, 2, 6, 9], [0, 1, 2, 7, 9]) and kept["secret scans"] == kept["n-gram Jaccard join"]
    assert [r["text"][-18:] for r in docs.filter("doc_id = 4").collect()] == ["*" * 18]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "unused").collect()
    assert {r["doc_id"] for r in pieces} == {1, None, 4, 6} and sum(r["doc_id"] == 6 for r in pieces) > 50


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, "unused"))
        assert docs.count() == 0


def test_run_leaves_its_result_alone(spark):
    import os

    from almanac.llm import common

    common.clean(spark)
    docs = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert common.written() == 1 and docs.count() > 0
    where = common.shared_dir(spark).removeprefix("file://")
    assert len([x for x in os.listdir(where) if x.startswith("almanac-")]) == 1
