import hashlib
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from steadyframe.llm import suffix

W = 50


def brute(rows, window=W):
    """By definition: a window goes if it starts in a document with a smaller id."""
    key = lambda i: suffix.NONE if i is None else i
    least = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - window + 1):
            w = raw[k : k + window]
            least[w] = min(least.get(w, suffix.NONE), key(i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - window + 1):
            if least[raw[k : k + window]] < key(i):
                gone[k : k + window] = b"\1" * window
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = suffix.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted(map(tuple, got), key=repr)


def texts(seed, n, alphabet):
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(40, 400))) for _ in range(12)]
    out = []
    for i in range(n):
        t = "".join(b[(a := rng.randrange(len(b))) : a + rng.randint(20, 200)] for b in rng.choices(base, k=rng.randint(1, 5)))
        out.append((i, t))
    rng.shuffle(out)
    return out


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SHARD", 3000)  # many shards
    monkeypatch.setattr(suffix, "ENTRIES", 40)  # many ranges
    monkeypatch.setattr(suffix, "BROADCAST_BYTES", 100)
    rows = texts(1, 150, "abcdefgh ") + texts(2, 40, "ab")
    rows = [(k if k % 17 else None, t) for k, (_, t) in enumerate(rows)]
    rows += [(500, "x" * 3000), (501, "x" * 200), (502, "xy" * 1500), (503, None), (504, ""), (3, "é" * 80), (505, "é" * 90), (505, "é" * 90), (506, "ha " * 900), (507, "a " + "ha " * 700)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("window", [24, 27, 50])
def test_other_windows(spark, window):
    rows = texts(3, 60, "abc ")
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, window)


def test_chance_meetings_send_little(spark, monkeypatch):
    """Where nearly every anchor is in other documents too, though few windows are, the second merge takes the texts' bytes about, not a hash a window."""
    monkeypatch.setattr(suffix, "SHARD", 20_000)
    rng = random.Random(4)
    rows = [(k, "".join(rng.choices(("ab ", "cd ", "ef "), k=300))) for k in range(300)]
    sent, exchange = [], suffix._exchange

    def counted(frame, *more):
        sent.append(frame.agg(F.sum(F.octet_length("keys") + F.octet_length("ids"))).first()[0])
        return exchange(frame, *more)

    monkeypatch.setattr(suffix, "_exchange", counted)
    assert run(spark, rows) == brute(rows)
    assert len(sent) == 2 and sent[1] < 2 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("entries", [1, 30, 10_000])
def test_windows_of_a_range(monkeypatch, entries):
    """The second merge's answers, whole anchors at a time, against a table of all windows by anchor."""
    monkeypatch.setattr(suffix, "ENTRIES", entries)
    rng, pack, rows, made = np.random.default_rng(5), zstandard.ZstdCompressor().compress, [], []
    for shard in range(4):
        n = 25
        anchor, count, ids = np.sort(rng.integers(0, 9, n)).astype(np.uint64), rng.integers(1, 7, n), rng.integers(0, 50, n)
        strings = [rng.choice(list(b"ab"), c + 4).astype(np.uint8).tobytes() for c in count]
        made.append(list(zip(anchor.tolist(), strings, ids.tolist())))
        rows.append((0, shard, n, suffix.five(anchor) + count.astype(np.uint8).tobytes() + pack(b"".join(strings)), pack(ids.astype(np.int64).tobytes())))
    least = {}
    for a, t, i in (x for m in made for x in m):
        for k in range(len(t) - 4):
            least[a, t[k : k + 5]] = min(i, least.get((a, t[k : k + 5]), i))
    got = suffix.window_answers(rows, 5).to_pylist()
    assert [r["shard"] for r in got] == [0, 1, 2, 3]
    for r, m in zip(got, made):
        assert suffix.read_flags([r]).tolist() == [int(least[a, t[k : k + 5]] < i) for a, t, i in m for k in range(len(t) - 4)]
