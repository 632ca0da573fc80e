"""Brute-force comparisons and edge cases of the exact search, the prefix trie and the resampling by word runs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from steadyframe.llm import nearest, reweight, trie

# --- op11


def brute_search(rows, k):
    fine = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for i, q in fine:
        if i % 50 == 0:
            found = sorted((-max(min(sum(a * b for a, b in zip(q, v)), 2**63 - 1), -(2**63)), j) for j, v in fine if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("rows,query_rows", [(32_768, 4_096), (37, 5)])
def test_search_matches_brute_force(spark, rows, query_rows):
    rng = random.Random(4)
    vectors = [(k, [rng.gauss(0, 0.3) for _ in range(20)]) for k in range(400)]
    vectors += [(1000 + k, vectors[3][1]) for k in range(150)] + [vectors[50], vectors[50], vectors[51]]  # copies, and repeated rows
    vectors += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")]), (2050, [float("inf")] * 20), (None, [1.0] * 20), (2100, []), (2150, [0.0] * 20), (2200, [0.5] * 3), (2201, [1.0] * 40)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash")).repartition(3)
    got = sorted(map(tuple, nearest.top_k(frame, frame.where("vec_id % 50 = 0"), k=5, rows=rows, query_rows=query_rows).collect()))
    assert got == brute_search(vectors, 5)


def test_search_of_few_large_and_no_vectors(spark):
    large = [(0, [3e9, -2e9]), (50, [1e8, 7.0]), (1, [-3e9, 3e9]), (2, [1e-3, 5.0]), (3, [1e17, 1e17])]
    frame = spark.createDataFrame(large, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, nearest.top_k(frame, frame.where("vec_id % 50 = 0")).collect())) == brute_search(large, 5)
    assert nearest.top_k(frame.where("vec_id < 0")).collect() == []
    alone = frame.where("vec_id = 0")
    assert nearest.top_k(alone).collect() == []


def test_bounds_hold_at_every_level():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(200, 64)) + rng.normal(size=(200, 1)), rng.normal(size=(20, 64))
    for s in nearest.LEVELS:
        assert (nearest.statistics(x, s) @ nearest.statistics(q, s).T + 1e-3 >= x @ q.T).all()


# --- op12


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + v[h:]
    members, below, out = defaultdict(list), defaultdict(list), {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            below[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        saved = (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        saved += sum(out[z][6] for z in below[k])
        leaves = sum(out[z][5] for z in below[k]) or 1
        ends = ",".join(map(str, sorted(c for c in members[k] if len(built[c]) == len(k))))
        out[k] = (min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(below[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def tried(frame, **more):
    c = F.col("conv_id")
    return sorted(map(tuple, trie.prefix_trie(frame, c - c % 100, F.crc32(c.cast("string")) % 6, 5, **more).collect()), key=repr)


@pytest.mark.parametrize("heavy", [200_000, 12, 0])
def test_trie_matches_brute_force(spark, heavy, monkeypatch):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé\U0001f600", "", None, "long " * 9])) for c in [*range(40), *range(100, 130), 205, 310] for t in range(rng.randint(1, 7))]
    rows += [(7, None, "user", "before"), (7, 2, "user", "same turn"), (7, 2, "user", "same turn"), (None, 0, "user", "nobody's"), (400, 0, None, None), (401, 0, "user", "x" * 100_000)]
    rows += [(500 + k, t, "user", f"copy {t}") for k in range(30) for t in range(6)] + [(600, t, "user", f"turn {t % 3}") for t in range(60)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash")).repartition(5)
    monkeypatch.setattr(trie, "STRETCH", 8)
    assert tried(frame, heavy=heavy) == brute_trie(rows)


def test_trie_without_turns(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert tried(none) == []
    one = [(100 + k, 0, "user", "only") for k in range(8)]  # no conversation 100 - 100 % 100 has more than a turn
    assert tried(spark.createDataFrame(one, none.schema)) == brute_trie(one)


def test_louds_keeps_the_tree():
    rng = np.random.default_rng(3)
    up = np.array([-1 if k < 3 else rng.integers(0, k) for k in range(300)])
    keys = rng.integers(-(2**62), 2**62, size=(300, 2))
    keys[:, 0] //= 2**61  # many keys share their first half
    above = np.where(up[:, None] < 0, 5, keys[up])
    order, degrees = trie.level_order(keys, above, np.arange(300))
    read = trie.Louds(trie.bitvector(degrees))
    assert (read.degrees == degrees).all()
    assert [(-1 if p == 0 else order[p - 1]) for p in read.parents[1:]] == up[order].tolist()
    sizes = read.rolled_up(np.ones(301, dtype=np.int64))
    assert sizes[0] == 301 and sizes[1:].sum() == sum(1 + _height(up, k) for k in range(300))


def _height(up, k):
    n = 0
    while up[k] >= 0:
        k, n = up[k], n + 1
    return n


# --- op13


def split(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(b"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower.encode())


@pytest.mark.parametrize("stretch", [4 << 20, 61])
def test_run_crcs_are_those_of_the_texts(monkeypatch, stretch):
    rng = random.Random(1)
    monkeypatch.setattr(reweight, "STRETCH", stretch)
    texts = ["", "A b", "é" * 50 + " xX9-z" * 20, "w" * 300 + " q" * 3, "end", "start"]
    texts += ["".join(rng.choice("abcXYZ é,\n09") for _ in range(rng.randint(0, 200))) for _ in range(150)]
    want = sorted((i, zlib.crc32(b" ".join(w[k : k + n]))) for i, t in enumerate(texts) for w in [split(t)] for n in (1, 2, 3, 4) for k in range(len(w) - n + 1))
    for array in (pa.array(texts), pa.array(["skip", *texts]).slice(1)):
        assert sorted((int(r), int(c)) for rows, crcs in reweight.runs(*reweight.words(array), 1, 4) for r, c in zip(rows, crcs)) == want


@pytest.mark.parametrize("longest", [1, 3])
def test_reweighting_matches_brute_force(spark, longest):
    rng = random.Random(8)
    docs = [(k, " ".join(rng.choice("alpha Beta gamma délta x1 y2".split()) for _ in range(rng.randint(0, 60)))) for k in range(200)]
    docs += [(900, None), (901, ""), (None, docs[1][1]), (902, "word " * 200_000), docs[5], docs[5], (903, docs[6][1])]
    targets = ["gamma délta gamma", None, "", "other words"]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("clash")).withColumn("part", F.lit(1)).repartition(4)
    got = reweight.reweight(frame, spark.createDataFrame([(t,) for t in targets], "text string"), longest=longest, buckets=97).collect()
    grams = lambda t: [b" ".join(w[k : k + n]) for w in [split(t)] for n in range(1, longest + 1) for k in range(len(w) - n + 1)]
    s, t = (Counter(zlib.crc32(g) % 97 for x in texts for g in grams(x)) for texts in ([x for _, x in docs], targets))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 97) / ((s[b] + 1) * (t.total() + 97)))) for b in range(97)}
    want = []
    for i, x in docs:
        weight = sum(gain[zlib.crc32(g) % 97] for g in grams(x))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(split(x)), len(grams(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_words, r.n_features, r.weight, r.score)) for r in got)
    able = sorted((w for w in want if w[1] >= 20), key=lambda w: (-w[4], w[0] is None, w[0]))
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(able) * 10 // 100 + 1))
    assert [r.doc_id for r in drawn] == [w[0] for w in able[: len(drawn)]]


def test_reweighting_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert reweight.reweight(none, none.select("text")).collect() == []
